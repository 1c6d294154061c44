"""Queries over stored tables that are edited, ledgers that rows are put into, and the company's block within the whole ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts
from ..operators import placing, rules
from ..sources import stored
from ..sources.tables import settled, table
from . import further
from .further import BLOCK_SQL, BLOCK_TEXTS, LADDER_SQL, LADDER_TEXTS, texts, texts_sql
from .ledger import TX, query, small, transactions
from .more import OVERRIDE_SCHEMA
from .tabular import scratch

ENTRY = f"request_id string, ts long, status string, total {amounts.MONEY}"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("request_id"), F.col("o_orderkey").alias("ts"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast(amounts.MONEY).alias("total"))


@query("""WITH e AS (SELECT o_custkey AS k, o_orderkey AS ts, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest FROM orders)
SELECT CAST(k AS VARCHAR) AS request_id, ts, CASE WHEN newest AND k % 3 = 0 THEN 'sent' ELSE status END AS status, CAST(CASE WHEN newest AND k % 2 = 0 AND k % 3 = 0 THEN 0.5 ELSE total END AS DOUBLE) AS total FROM e WHERE k % 5 <> 0""")
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of entries: appended in two parts, the newest entry of some requests updated, others deleted."""
    t = stored.StoredTable(spark, scratch(spark, "history"), ["request_id"], ENTRY)
    e = _entries(spark, sf_dir)
    t.append(e.filter("ts % 2 = 0"))
    t.append(e.filter("ts % 2 = 1"))
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    changes = c.filter(k % 3 == 0).select(k.cast("string").alias("request_id"), F.lit("sent").alias("status"), F.when(k % 2 == 0, F.lit(0.5).cast(amounts.MONEY)).alias("total"))
    t.update_latest(changes, ["ts"])
    t.delete(c.filter(k % 5 == 0).select(k.cast("string").alias("request_id")))
    return t.read().withColumn("total", F.col("total").cast("double"))


@query("""WITH l AS (SELECT l_orderkey AS k, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND n IS NOT NULL THEN 'lines' ELSE 'order' END AS said_by, CASE WHEN o_orderkey % 2 = 0 THEN n END AS n_lines, o_orderstatus AS status FROM orders LEFT JOIN l ON k = o_orderkey WHERE o_orderkey % 7 <> 0
UNION ALL SELECT -r_regionkey - 1, 'region', NULL, r_name FROM region WHERE (-r_regionkey - 1) % 7 <> 0""")
def stored_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with one row a key: orders, of which lines change some columns (the last by line number), rows with new keys, deletes, and an older version that reads as before."""
    t = stored.StoredTable(spark, scratch(spark, "orders"), ["id"], "id long, said_by string, n_lines int, status string")
    o = table(spark, sf_dir, "orders")
    first = t.upsert(o.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("said_by"), F.lit(None).cast("int").alias("n_lines"), F.col("o_orderstatus").alias("status")))
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("id"), F.lit("lines").alias("said_by"), F.col("l_linenumber").alias("n_lines"))
    t.upsert(lines.join(o.select(F.col("o_orderkey").alias("id")), "id", "left_semi"), order="n_lines")
    t.upsert(table(spark, sf_dir, "region").select((-F.col("r_regionkey") - 1).cast("long").alias("id"), F.lit("region").alias("said_by"), F.lit(None).cast("int").alias("n_lines"), F.col("r_name").alias("status")))
    t.delete(t.read(first.number).filter("id % 7 = 0").select("id").unionByName(t.read().filter("id < 0 and id % 7 = 0").select("id")))
    return t.read()


@query(f"WITH {TX} SELECT account_number, row_pos, row_number() OVER (PARTITION BY account_number ORDER BY row_pos) AS place FROM tx")
def placed_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored ledger without the pending rows, which then enter it above the next row of their account, or below the last: read back by its labels it is in order."""
    t = transactions(spark, sf_dir).select("account_number", "row_pos", (F.col("description").endswith("-P")).alias("pending"))
    ledger = stored.StoredTable(spark, scratch(spark, "ledger"), ["account_number", "row_pos"], f"account_number string, row_pos long, label {placing.LABEL}")
    ledger.append(placing.labelled(t.filter("not pending").select("account_number", "row_pos"), [F.col("row_pos")]))
    there, new = ledger.read(), t.filter("pending").select("account_number", "row_pos")
    other = there.select(F.col("account_number").alias("_a"), F.col("row_pos").alias("_r"))
    near = new.join(other, F.col("account_number") == F.col("_a"), "left").groupBy("account_number", "row_pos").agg(F.max(F.when(F.col("_r") < F.col("row_pos"), F.col("_r"))).alias("upper_row"), F.min(F.when(F.col("_r") > F.col("row_pos"), F.col("_r"))).alias("lower_row"))
    plan = near.select("account_number", "row_pos", F.col("row_pos").cast("int").alias("block"), F.lit(0).alias("seq"), "upper_row", "lower_row")
    added, _ = placing.inserted(there, plan)
    ledger.append(added)
    return stored.numbered(ledger.read(), [F.col("label")], "place", ["account_number"]).select("account_number", "row_pos", "place")


@query(f"""WITH {texts_sql(BLOCK_TEXTS)}, {BLOCK_SQL}
SELECT v.row_pos, CASE WHEN rule IS NOT NULL THEN 'RA' WHEN other IS NOT NULL THEN 'R1' WHEN d LIKE '%WILLOW HOMES%' THEN 'R2b' WHEN who = 'imprest' THEN 'R5' WHEN who = 'salary' THEN 'R7' ELSE 'R13' END AS classified_by,
  CASE WHEN rule IS NOT NULL THEN v.head WHEN other IS NOT NULL OR d LIKE '%WILLOW HOMES%' THEN 'Internal' WHEN who = 'imprest' THEN 'Imprest' WHEN who = 'salary' THEN 'Salary HO' END AS head
FROM v JOIN g USING (row_pos)""")
def ladder_with_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder with a company's block in it: what the block decides comes before accounts, payees and words, what it lets through goes on to them."""
    rows = texts(spark, sf_dir, BLOCK_TEXTS).withColumn("account_number", F.concat(F.lit("9000111100"), (F.col("account_number").cast("long") % 4).cast("string")))
    accounts = small(spark, [(a, "SW", s, i) for a, _, s, i in further._LADDER_ACCOUNTS], "account_number string, business_unit string, account_stage string, account_order int")
    payees = small(spark, [(n, h, None, None, "Confirmed") for n, h in further._BLOCK_PAYEES.items()], "name string, head1 string, head2 string, head3 string, status string")
    none = small(spark, [(1, "", "", "x", "x", "x", "x", "Disabled")], OVERRIDE_SCHEMA)
    x = rules.classify(rows, accounts, none, payees, rules.Business(own_names=["Willow Homes"]), stage_table=further._block(spark))
    return x.select("row_pos", "classified_by", "head")


def _explained_sql(name: str, column: str) -> str:
    return f"CASE WHEN {column} NOT IN ('?', '') THEN '{name}: ' || {column} || ' (' || classified_by || ')' END"


@query(f"""WITH now AS (SELECT * FROM ({LADDER_SQL})), t AS (SELECT row_pos, d, cr, own FROM (WITH {texts_sql(LADDER_TEXTS)} SELECT row_pos, d, cr, CASE WHEN custkey % 4 < 2 THEN 'SW' ELSE 'AR' END AS own FROM x)),
o AS (SELECT *, CASE row_pos % 3 WHEN 0 THEN '?' WHEN 1 THEN head ELSE 'DPL' END AS old_head, CASE WHEN row_pos % 5 = 0 THEN 'Elsewhere' ELSE business_unit END AS old_unit FROM now JOIN t USING (row_pos))
SELECT row_pos, old_head, head, business_unit, confidence, concat_ws(' | ', {_explained_sql('Head', 'head')}, {_explained_sql('BU', 'business_unit')}, {_explained_sql('Type', 'type')}, {_explained_sql('TCP', 'tcp_head')}) AS reason,
  CASE WHEN head = 'Internal' THEN 'Internal Transfer | Ref: N/A | Type: ' || type || ' | BU: ' || business_unit || ' | Head: Internal' WHEN cr AND type = 'Customer Collection' THEN 'Receipt Credit (Collection) | Ref: N/A | From: Party | BU: ' || business_unit
    WHEN cr THEN 'Receipt Credit from x' || right(trim(d), 4) || ' (Purpose: ' || business_unit || ') | Ref: N/A | BU: ' || business_unit || ' | Head: ' || head
    ELSE 'Payment Disbursement (Purpose: ' || CASE WHEN lower(head) LIKE '%salary%' THEN 'Salary' ELSE business_unit END || ') | To: Party | Ref: N/A | BU: ' || business_unit || ' | Head: ' || head END AS narration
FROM o WHERE d <> '' AND (old_head IN ('?', 'DPL') OR old_unit = '?' OR type = '?' OR tcp_head = '?' OR old_unit NOT IN ('?', 'HO', own)) AND (old_head <> head OR old_unit <> business_unit)""")
def resolved_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the rules see otherwise today, with their narration, reason and confidence made anew."""
    x = further._ladder(spark, sf_dir)
    now = x.select("row_pos", "account_number", "description", "credits", rules.final_head(F.col("head"), F.col("engine_head")).alias("head"), "business_unit", "type", "tcp_head", "confidence", "classified_by")
    now = settled(now)  # read three times
    third = F.col("row_pos") % 3
    old = now.withColumns({"head": F.when(third == 0, "?").when(third == 1, F.col("head")).otherwise("DPL"), "business_unit": F.when(F.col("row_pos") % 5 == 0, "Elsewhere").otherwise(F.col("business_unit"))})
    accounts = small(spark, further._LADDER_ACCOUNTS, "account_number string, business_unit string, account_stage string, account_order int").select("account_number", "business_unit")
    return rules.resolved_in_full(old, accounts, now, ["row_pos"], ("DPL",)).select("row_pos", "old_head", "head", "business_unit", "confidence", "reason", "narration")

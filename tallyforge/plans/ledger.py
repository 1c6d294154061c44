"""Registered queries of the ledger engine: its operators on the driver's tables, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import amounts, dates, names, text
from ..operators import balance, geometry, ingest, lookups, master, narrate, parse, reconcile, rules, similar
from ..sources import tables
from ..sources.tables import table
from ..streaming import landing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(amounts.MONEY)


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension that is part of the query."""
    return spark.createDataFrame(rows, schema)


# Orders as transactions: the customer is the account, urgent and high orders are money in.
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    into = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    zero = F.lit(0).cast(amounts.MONEY)
    return o.select(
        F.col("o_custkey").cast("string").alias("account_number"), F.col("o_orderkey").alias("row_pos"), F.col("o_orderdate").cast("date").alias("txn_date"),
        F.when(into, money("o_totalprice")).otherwise(zero).alias("credits"), F.when(into, zero).otherwise(money("o_totalprice")).alias("debits"), money("o_totalprice").alias("reported_balance"),
        F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("description"),
    )


TX = """tx AS (SELECT CAST(o_custkey AS VARCHAR) AS account_number, o_orderkey AS row_pos, CAST(o_orderdate AS DATE) AS txn_date,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS credits,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS debits,
  CAST(o_totalprice AS DECIMAL(18,2)) AS reported_balance, concat_ws('-', o_orderpriority, o_orderstatus) AS description FROM orders)"""


@query(f"""WITH {TX} SELECT head, count(*) AS n, CAST(sum(credits) AS DOUBLE) AS credits, CAST(sum(debits) AS DOUBLE) AS debits FROM (
  SELECT *, CASE WHEN credits > 0 THEN 'Collection' WHEN description LIKE '%LOW%' THEN 'Vendor' WHEN description LIKE '%MEDIUM%' THEN 'Contractor' ELSE '?' END AS head FROM tx) GROUP BY head""")
def head_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    d = F.col("description")
    head = F.when(amounts.direction(F.col("credits"), F.col("debits")) == "credit", "Collection").when(rules.contains_any(d, ["LOW"]), "Vendor").when(rules.contains_any(d, ["MEDIUM"]), "Contractor").otherwise("?")
    return t.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n"), F.sum("credits").cast("double").alias("credits"), F.sum("debits").cast("double").alias("debits"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE trim(lang) <> '' AND trim(text) <> ''")
def validate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.col("lang").alias("txn_date"), F.col("text").alias("description"))
    return ingest.validated(d).select("doc_id", "source", "n_chars")


@query("SELECT CASE WHEN c_acctbal > 0 THEN 'credit' WHEN c_acctbal < 0 THEN 'debit' ELSE 'unknown' END AS direction, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer GROUP BY 1")
def direction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(amounts.direction(F.col("c_acctbal"), -F.col("c_acctbal")).alias("direction")).agg(F.count(F.lit(1)).alias("n"), F.sum(money("c_acctbal")).cast("double").alias("total"))


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"SELECT l_orderkey, l_returnflag, {_LINE_ORDER} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {_LINE_ORDER}) AS rn FROM lineitem) WHERE rn = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = _LINE_ORDER.split(", ")
    return ingest.keep_first(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *order), ["l_orderkey", "l_returnflag"], order)


@query(f"WITH {TX} SELECT row_pos, account_number, CAST(credits AS DOUBLE) AS credits FROM tx ANTI JOIN (SELECT * FROM tx WHERE description LIKE '%-F') e USING (txn_date, credits, debits, reported_balance)")
def anti_join_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return ingest.not_loaded(t, t.filter("description LIKE '%-F'")).select("row_pos", "account_number", F.col("credits").cast("double").alias("credits"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = 7 THEN 'B/F' ELSE l_returnflag END AS d FROM lineitem)
SELECT (SELECT count(*) FROM r) AS total, (SELECT count(DISTINCT (l_orderkey, l_partkey)) FROM r WHERE d <> 'B/F') AS new, (SELECT count(*) FROM r WHERE d = 'B/F') AS brought_forward,
  (SELECT count(*) FROM r) - (SELECT count(DISTINCT (l_orderkey, l_partkey)) FROM r WHERE d <> 'B/F') AS skipped""")
def dedup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_linenumber") == 7, ingest.BROUGHT_FORWARD).otherwise(F.col("l_returnflag")).alias("description"))
    new = ingest.without_brought_forward(r).select("l_orderkey", "l_partkey").distinct()
    return ingest.ingest_metrics(r, new).select("total", "new", "brought_forward", "skipped")


@query("SELECT l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'A'")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return reconcile.bag_difference(x.filter("l_returnflag = 'R'"), x.filter("l_returnflag = 'A'"), ["l_quantity", "l_discount"])


_BAG_ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
_BAG = f"""a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_tax ORDER BY {_BAG_ORDER}) AS rn, count(*) OVER (PARTITION BY l_suppkey, l_tax) AS c FROM lineitem WHERE l_returnflag = 'R'),
m AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_tax ORDER BY {_BAG_ORDER}) AS rn, count(*) OVER (PARTITION BY l_suppkey, l_tax) AS c FROM lineitem WHERE l_returnflag = 'A'),
ka AS (SELECT l_suppkey, l_tax, count(*) AS na FROM a GROUP BY ALL), km AS (SELECT l_suppkey, l_tax, count(*) AS nm FROM m GROUP BY ALL)"""


def _bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_tax", *_BAG_ORDER.split(", "), "l_returnflag")
    return reconcile.bag_matched(x.filter("l_returnflag = 'R'"), x.filter("l_returnflag = 'A'"), ["l_suppkey", "l_tax"], _BAG_ORDER.split(", "))


@query(f"WITH {_BAG} SELECT l_suppkey, l_tax, {_BAG_ORDER} FROM m LEFT JOIN ka USING (l_suppkey, l_tax) WHERE rn <= c - least(c, coalesce(na, 0))")
def bag_leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bags(spark, sf_dir)[2].drop("l_returnflag")


@query(f"WITH {_BAG} SELECT l_suppkey, l_tax, {_BAG_ORDER} FROM a LEFT JOIN km USING (l_suppkey, l_tax) WHERE rn > coalesce(nm, 0)")
def bag_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bags(spark, sf_dir)[1].drop("l_returnflag")


@query(f"""WITH {TX} SELECT account_number, row_pos, CAST(txn_date AS VARCHAR) AS txn_date, near_id, near_days FROM (
  SELECT a.account_number, a.row_pos, a.txn_date, b.row_pos AS near_id, abs(date_diff('day', a.txn_date, b.txn_date)) AS near_days,
    row_number() OVER (PARTITION BY a.row_pos ORDER BY abs(date_diff('day', a.txn_date, b.txn_date)), b.row_pos) AS rn
  FROM tx a JOIN tx b ON a.account_number = b.account_number AND a.row_pos <> b.row_pos AND abs(date_diff('day', a.txn_date, b.txn_date)) <= 3) WHERE rn = 1""")
def near_match_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("account_number", "row_pos", "txn_date")
    return reconcile.nearest_by_date(t, t, ["account_number"], "txn_date", "row_pos").withColumns({"txn_date": F.col("txn_date").cast("string"), "near_days": F.col("near_days").cast("long")})


_BALANCE = f"""{TX}, b AS (SELECT *, first_value(reported_balance - credits + debits) OVER w + sum(credits - debits) OVER w AS balance FROM tx
  WINDOW w AS (PARTITION BY account_number ORDER BY txn_date, row_pos ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_BALANCE} SELECT account_number, row_pos, CAST(balance AS DOUBLE) AS balance FROM b")
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balance.running_balance(transactions(spark, sf_dir), ["account_number"], ["txn_date", "row_pos"], block=F.year("txn_date"))
    return b.select("account_number", "row_pos", F.col("balance").cast("double").alias("balance"))


@query(f"WITH {_BALANCE} SELECT account_number, row_pos, CAST(round(reported_balance - balance, 2) AS DOUBLE) AS \"check\", abs(round(reported_balance - balance, 2)) >= 0.01 AS is_error FROM b")
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balance.balance_check(balance.running_balance(transactions(spark, sf_dir), ["account_number"], ["txn_date", "row_pos"]))
    return b.select("account_number", "row_pos", F.col("check").cast("double").alias("check"), "is_error")


@query(f"WITH {TX} SELECT account_number, CAST(arg_min(txn_date, row_pos) AS VARCHAR) AS first_day, CAST(arg_max(txn_date, row_pos) AS VARCHAR) AS last_day, CASE WHEN arg_min(txn_date, row_pos) < arg_max(txn_date, row_pos) THEN 'asc' WHEN arg_min(txn_date, row_pos) > arg_max(txn_date, row_pos) THEN 'desc' ELSE 'desc' END AS direction FROM tx GROUP BY account_number")
def sort_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(balance.direction(transactions(spark, sf_dir), ["account_number"]), "first_day", "last_day")


@query("SELECT 'Q' || CAST((month(o_orderdate) + 8) % 12 // 3 + 1 AS VARCHAR) AS quarter, month(o_orderdate) AS month, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS fiscal_year, count(*) AS n FROM orders GROUP BY ALL")
def fiscal_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(dates.fiscal_quarter(d).alias("quarter"), F.month(d).cast("long").alias("month"), dates.fiscal_year(d).alias("fiscal_year")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day, min(o_orderdate) >= DATE '1995-04-01' AND CAST(max(o_orderdate) AS DATE) <= DATE '1996-03-31' AS inside FROM orders GROUP BY o_orderstatus")
def fiscal_year_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderdate").cast("date").alias("d"))
    year = dates.fiscal_range(F.lit("1995-96"))
    x = o.groupBy("o_orderstatus").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day")).withColumn("inside", (F.col("first_day") >= year["first"]) & (F.col("last_day") <= year["last"]))
    return as_text(x, "first_day", "last_day")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderkey % 5 <> 4 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 4")
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    shown = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "dd-MM-yyyy")).when(k == 3, F.date_format(d, "dd-MMM-yyyy")).otherwise(F.lit("n/a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parsed_date(shown).cast("string").alias("day"))


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_linenumber = 6 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag")
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("l_linenumber") == 6, "bad").otherwise(amounts.formatted(money("l_extendedprice")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(amounts.parsed_amount(shown)).cast("double").alias("total"))


WORD_HEADS = [("Credentials", 1, 0, "TOKEN ="), ("Licence", 2, 0, "LICENSED"), ("Licence", 2, 1, "COPYRIGHT"), ("Contact", 3, 0, "@"), ("List", 4, 0, "|")]


@query("""SELECT doc_id, CASE WHEN upper(text) LIKE '%TOKEN =%' OR replace(upper(text), ' ', '') LIKE '%TOKEN=%' THEN 'Credentials'
  WHEN upper(text) LIKE '%LICENSED%' OR replace(upper(text), ' ', '') LIKE '%LICENSED%' OR upper(text) LIKE '%COPYRIGHT%' OR replace(upper(text), ' ', '') LIKE '%COPYRIGHT%' THEN 'Licence'
  WHEN text LIKE '%@%' THEN 'Contact' WHEN text LIKE '%|%' THEN 'List' END AS word_head FROM documents""")
def keyword_rule_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads: dict[str, tuple[int, list[str]]] = {}
    for h, p, _, w in WORD_HEADS:
        heads.setdefault(h, (p, []))[1].append(w)
    r = small(spark, [(h, p, None, [], ws, [], False) for h, (p, ws) in heads.items()], "head string, priority int, direction string, party_types array<string>, keywords array<string>, patterns array<string>, fallback boolean")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"), F.lit(0).alias("credits"), F.lit(0).alias("debits"))
    return rules.head_by_words(d, r, False).select("doc_id", "word_head")


OVERRIDES = [(1, "7", "URGENT", "Collection", "HO", "A", "T", "Active"), (2, "", "LOW", "Vendor", "HO", "A", "T", "Active"), (3, "3", "", "Bank", "HO", "A", "T", "Active"), (4, "", "", "Never", "HO", "A", "T", "Active"), (5, "", "MEDIUM", "Off", "HO", "A", "T", "Disabled"), (6, "", "HIGH", "", "HO", "A", "T", "Active")]


@query("SELECT o_orderkey AS row_pos, CASE WHEN CAST(o_custkey AS VARCHAR) LIKE '%7' AND o_orderpriority LIKE '%URGENT%' THEN 'Collection' WHEN o_orderpriority LIKE '%LOW%' THEN 'Vendor' WHEN CAST(o_custkey AS VARCHAR) LIKE '%3' THEN 'Bank' END AS head FROM orders")
def override_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lookups.active_overrides(small(spark, OVERRIDES, "rule_order int, account_suffix string, keyword string, head string, business_unit string, type string, tcp_head string, status string"))
    t = transactions(spark, sf_dir).select("row_pos", "account_number", "description")
    return lookups.first_override(t, r, ["head"]).select("row_pos", "head")


@query("SELECT s_suppkey, CASE WHEN s_name LIKE '%01' THEN 'North' WHEN s_name LIKE '%1' THEN 'South' WHEN s_name LIKE '%7' THEN 'East' END AS unit FROM supplier")
def suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = small(spark, [("01", "North", 1), ("1", "South", 2), ("7", "East", 3)], "suffix string, unit string, ord int")
    return lookups.suffix_lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", dim, "suffix", "ord", ["unit"]).select("s_suppkey", "unit")


COLOURS = ["red", "green", "blue", "black", "white", "ivory", "rose", "plum", "steel", "lace"]


@query("SELECT p_partkey, " + "CASE " + " ".join(f"WHEN contains(lower(p_name), '{c}') THEN '{c}'" for c in COLOURS) + " END AS colour FROM part")
def contains_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = small(spark, [(c, i) for i, c in enumerate(COLOURS)], "colour string, ord int")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lookups.contains_lookup(p, F.lower("p_name"), dim, "colour", "ord", ["colour"]).select("p_partkey", "colour")


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE least(a.n_regionkey, b.n_regionkey) || '+' || greatest(a.n_regionkey, b.n_regionkey) WHEN '0+1' THEN 'Atlantic' WHEN '1+2' THEN 'Pacific' WHEN '2+3' THEN 'Silk' END AS label
FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1""")
def pair_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").cast("string").alias("rb"))
    x = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").cast("string").alias("ra")).join(b, F.col("b") == F.col("a") + 1)
    return x.select("a", "b", lookups.pair_label(F.col("ra"), F.col("rb"), {"0+1": "Atlantic", "1+2": "Pacific", "2+3": "Silk"}).alias("label"))


@query("""SELECT p_partkey, heads FROM part LEFT JOIN (SELECT brand, string_agg(head, ',' ORDER BY head) AS heads FROM (VALUES ('Brand#11', 'Steel'), ('Brand#11', 'Works'), ('Brand#22', 'Works'), ('Brand#33', 'Steel'), ('Brand#33', 'Works')) v(brand, head) GROUP BY brand) ON brand = p_brand""")
def party_type_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = small(spark, [("Steel", 1, None, ["metal"], [], [], False), ("Works", 2, None, ["metal", "site"], [], [], False)], "head string, priority int, direction string, party_types array<string>, keywords array<string>, patterns array<string>, fallback boolean")
    parties = small(spark, [("Brand#11", "metal", ["Brand#33"], "high"), ("Brand#22", "site", [], "high"), ("Brand#44", "metal", [], "low"), ("Brand#55", "Unknown", [], "high")], "canonical string, type string, aliases array<string>, confidence string")
    x = rules.party_heads(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", parties, r)
    return x.select("p_partkey", F.when(F.col("party_heads").isNotNull(), F.array_join(F.array_sort("party_heads"), ",")).alias("heads"))


@query("""SELECT c_custkey, coalesce(e.route, r.route, 'default') AS route FROM customer JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (VALUES (1, 'BUILDING', 'exact-1'), (3, 'MACHINERY', 'exact-3')) e(nk, seg, route) ON e.nk = c_nationkey AND e.seg = c_mktsegment LEFT JOIN (VALUES (0, 'region-0'), (2, 'region-2')) r(rk, route) ON r.rk = n_regionkey""")
def coalesce_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = small(spark, [(1, "BUILDING", "exact-1"), (3, "MACHINERY", "exact-3")], "n_nationkey int, c_mktsegment string, route string")
    active = small(spark, [(0, "region-0"), (2, "region-2")], "n_regionkey int, route string")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").join(n, "n_nationkey")
    return lookups.routed(c, exact, active, ["n_nationkey", "c_mktsegment"], ["n_regionkey"], "route", "default").select("c_custkey", "route")


@query(r"SELECT page_id, nullif(regexp_split_to_array(url, '[-/]')[3], '') AS third, nullif(regexp_split_to_array(url, '[-/]')[-1], '') AS last FROM pages")
def segment_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.segments(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.try_element_at(s, F.lit(3)), F.lit("")).alias("third"), F.nullif(F.try_element_at(s, F.lit(-1)), F.lit("")).alias("last"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '^(https?)://([^/:?#]+)(?:/([a-z]{2}))?/(\d+)', 1), '') AS scheme, nullif(regexp_extract(url, '^(https?)://([^/:?#]+)(?:/([a-z]{2}))?/(\d+)', 2), '') AS host,
nullif(regexp_extract(url, '^(https?)://([^/:?#]+)(?:/([a-z]{2}))?/(\d+)', 3), '') AS lang, nullif(regexp_extract(url, '^(https?)://([^/:?#]+)(?:/([a-z]{2}))?/(\d+)', 4), '') AS number FROM pages""")
def regex_struct_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"^(https?)://([^/:?#]+)(?:/([a-z]{2}))?/(\d+)"
    return table(spark, sf_dir, "pages").select("page_id", *(F.nullif(F.regexp_extract("url", pattern, i), F.lit("")).alias(c) for i, c in enumerate(("scheme", "host", "lang", "number"), 1)))


@query("SELECT doc_id, regexp_matches(upper(text), '(^|[^A-Z])(THE|DER)([^A-Z]|$)') AS hit FROM documents")
def word_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.bounded_any(F.col("text"), ["THE", "DER"]).alias("hit"))


@query(r"SELECT s_suppkey, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS key, regexp_replace(upper(s_name), '\s+', '', 'g') AS squeezed, right(trim(s_name), 4) AS tail, regexp_replace(lower(s_name), '[^a-z]', '', 'g') AS letters FROM supplier")
def name_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alnum_key(n).alias("key"), text.squeezed_upper(n).alias("squeezed"), text.last4(n).alias("tail"), text.letters_only(n).alias("letters"))


@query(f"""WITH {TX} SELECT row_pos, CASE WHEN credits > 0 AND row_pos % 2 = 0 THEN 'Receipt Credit (Collection) | Ref: ' || row_pos || ' | From: Party | BU: SW'
  WHEN credits > 0 THEN 'Receipt Credit from x' || right(trim(description), 4) || ' (Purpose: SW) | Ref: ' || row_pos || ' | BU: SW | Head: Vendor'
  ELSE 'Payment Disbursement (Purpose: SW) | To: Party | Ref: ' || row_pos || ' | BU: SW | Head: Vendor' END AS narration FROM tx""")
def narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    kind = F.when(F.col("row_pos") % 2 == 0, "Customer Collection").otherwise("HO - Admin")
    return t.select("row_pos", narrate.narration(F.col("description"), F.col("credits"), F.lit("Vendor"), kind, F.lit("SW"), F.col("account_number"), F.lit(None).cast("string"), F.col("row_pos").cast("string"), F.lit(False)).alias("narration"))


@query("SELECT o_orderkey, concat_ws(' | ', 'Head: ' || o_orderpriority || ' (R1)', CASE WHEN o_orderstatus <> 'F' THEN 'BU: ' || o_orderstatus || ' (default)' END) AS reason FROM orders")
def reason_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise(F.lit("?"))
    return table(spark, sf_dir, "orders").select("o_orderkey", narrate.reason(narrate.explained("Head", F.col("o_orderpriority"), F.lit("R1")), narrate.explained("BU", unit, F.lit(None).cast("string"))).alias("reason"))


@query("""WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, l_returnflag || l_linestatus AS head, count(*) AS n, min(l_orderkey) AS first_pos FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, first_pos, head) AS rn FROM p)
SELECT name, max(CASE WHEN rn = 1 THEN head END) AS head1, max(CASE WHEN rn = 2 AND n >= 2 THEN head END) AS head2, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY name""")
def mode_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("name"), F.concat("l_returnflag", "l_linestatus").alias("head")).agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_pos"))
    return master.mode_and_runner_up(p)


_CONFLICT = """old AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS n, o_orderpriority AS h FROM orders WHERE o_orderstatus = 'F'), new AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS n, o_orderpriority AS h FROM orders WHERE o_orderstatus = 'O'),
fresh AS (SELECT * FROM new ANTI JOIN old USING (n, h))"""


def _conflicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderpriority").alias("head"), "o_orderstatus")
    return master.updates(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'").withColumnRenamed("head", "head1"))


@query(f"WITH {_CONFLICT} SELECT n AS name, h AS head1, CASE WHEN n IN (SELECT n FROM old) THEN 'Conflict' ELSE 'Pending' END AS status FROM fresh")
def conflict_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir)[0]


@query(f"WITH {_CONFLICT} SELECT DISTINCT fresh.n AS name, old.h AS head1, 'Conflict' AS status FROM fresh JOIN old ON fresh.n = old.n AND fresh.h <> old.h")
def conflict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir)[1]


@query("SELECT CAST(o_custkey AS VARCHAR) AS name, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS heads FROM orders GROUP BY 1")
def heads_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderpriority").alias("head"))
    return master.heads_of(p).select("name", F.array_join("heads", ",").alias("heads"))


# Part names are short texts of a few words, as descriptions are.
_TFIDF_OF_ALL = r"""w AS (SELECT p_partkey AS doc, regexp_extract_all(lower(p_name), '[\pL\pN_]{2,}') AS w FROM part),
t AS (SELECT doc, unnest(w) AS term FROM w UNION ALL SELECT doc, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w WHERE len(w) > 1),
tf AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM part)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
nw AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM raw),
sims AS (SELECT q.doc AS query, d.doc AS doc, sum(q.w * d.w) AS similarity FROM nw q JOIN nw d USING (term) GROUP BY ALL HAVING sum(q.w * d.w) >= 0.15),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, doc) AS rank FROM sims QUALIFY rank <= 5)"""
_TFIDF = _TFIDF_OF_ALL.replace("USING (term) GROUP BY ALL", "USING (term) WHERE q.doc % 20 = 0 GROUP BY ALL")


@query(f"WITH {_TFIDF} SELECT query, doc, round(similarity, 6) AS similarity, rank FROM top")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    near = similar.top_similar(p, p.filter("p_partkey % 20 = 0"), "p_partkey", "p_name", prepared=True)
    return near.select("query", "doc", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_TFIDF_OF_ALL}, v AS (SELECT query, CAST(p_size % 3 AS VARCHAR) AS head, count(*) AS votes FROM top JOIN part ON p_partkey = doc WHERE similarity >= 0.25 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, head DESC) AS rn FROM v)
SELECT query, head, votes, CASE WHEN votes >= 4 THEN 'High' ELSE 'Medium' END AS confidence FROM b WHERE rn = 1 AND votes >= 3""")
def vote_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part votes among those most similar to it."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 3).cast("string").alias("head"))
    return similar.votes_of_all(p.drop("head"), p.drop("p_name"), "p_partkey", "p_name", prepared=True)


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, '' FROM supplier")
def union_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return ingest.union_aligned(c, s)


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return ingest.latest_per_key(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.recent(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("SELECT CAST(user_id AS VARCHAR) AS file, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') >= 2")
def failure_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    return landing.failures(e)


@query("SELECT count(*) AS processed, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed FROM events")
def batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.batch_counters(table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status")))


@query("SELECT event_id, user_id, event_id = max(event_id) OVER (PARTITION BY user_id) AS is_active FROM events")
def single_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.single_active(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id").select("event_id", "user_id", "is_active")


@query("SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM events")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.sum((F.col("event_type") == "signup").cast("int")).over(w).alias("island"))


@query("SELECT event_id, round(value - lag(value) OVER w, 6) AS gap_before, round(lead(value) OVER w - value, 6) AS gap_after, coalesce(lead(value) OVER w - value < value - lag(value) OVER w - 2.0, false) AS joins_below FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)")
def nearest_neighbor_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    before, after = F.col("value") - F.lag("value").over(w), F.lead("value").over(w) - F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(before, 6).alias("gap_before"), F.round(after, 6).alias("gap_after"), F.coalesce(after < before - geometry.EPSILON, F.lit(False)).alias("joins_below"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'middle' ELSE 'high' END AS band FROM part")
def range_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = small(spark, [("low", None, 1000.0, 1), ("middle", 1000.0, 1500.0, 2), ("high", 1500.0, None, 3)], "band string, start double, end double, ord int")
    return lookups.range_bucket(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", r, "band", "ord").select("p_partkey", "band")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("carried"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    j = text.fenced_json(fenced, "page string, k string")
    return table(spark, sf_dir, "events").select("event_id", j["page"].alias("page"), j["k"].alias("k"))


@query("SELECT CASE WHEN d.n_chars IS NULL THEN 'skipped' WHEN l.quality = CASE WHEN d.n_chars >= 400 THEN 1 ELSE 0 END THEN 'matched' ELSE 'mismatched' END AS outcome, count(*) AS n FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY 1")
def ground_truth_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("quality"))
    return reconcile.cross_check(table(spark, sf_dir, "labels").select("doc_id", "quality"), live, ["doc_id"], ["doc_id"], "quality").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linestatus AS head, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS collected, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS cancelled, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS net FROM lineitem GROUP BY 1")
def totals_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, zero = money("l_extendedprice"), F.lit(0).cast(amounts.MONEY)
    into, out = F.when(F.col("l_returnflag") == "N", price).otherwise(zero), F.when(F.col("l_returnflag") == "R", price).otherwise(zero)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("head")).agg(F.sum(into).cast("double").alias("collected"), F.sum(out).cast("double").alias("cancelled"), (F.sum(into) - F.sum(out)).cast("double").alias("net"))


@query("SELECT event_id, coalesce(CAST(ts AS DATE) < (SELECT max(CAST(b.ts AS DATE)) FROM events b WHERE b.user_id = e.user_id AND b.event_type <> 'purchase'), false) AS is_late FROM events e WHERE event_type = 'purchase'")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("txn_date"))
    return balance.late_rows(e.filter("event_type = 'purchase'"), e.filter("event_type <> 'purchase'"), ["user_id"]).select("event_id", "is_late")


# Descriptions of several layouts, made from orders.


@query("""WITH x AS (SELECT o_orderkey AS row_pos, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderkey % 11 AS i FROM orders)
SELECT row_pos, CASE WHEN i = 3 THEN 'p' || c WHEN i IN (6, 10) THEN NULL ELSE 'Party ' || c END AS parsed_party,
  CASE i WHEN 0 THEN 'NEFT' WHEN 1 THEN 'NEFT' WHEN 2 THEN 'IMPS' WHEN 3 THEN 'UPI' WHEN 4 THEN 'NEFT' WHEN 5 THEN 'TPT' WHEN 6 THEN 'INB' WHEN 7 THEN 'CLG' WHEN 8 THEN 'BILLDESK' END AS parsed_payment_mode,
  CASE i WHEN 0 THEN 'REF' || k WHEN 1 THEN 'R' || k WHEN 2 THEN k WHEN 3 THEN k WHEN 4 THEN 'Y' || k WHEN 5 THEN 'T' || k WHEN 6 THEN k WHEN 8 THEN 'B' || k WHEN 9 THEN 'UTRA0000000' || k END AS parsed_reference,
  CASE i WHEN 2 THEN 'xxxx' || lpad(c, CAST(greatest(4, len(c)) AS INTEGER), '0') WHEN 8 THEN '9' || c WHEN 9 THEN '12345' || lpad(c, CAST(greatest(5, len(c)) AS INTEGER), '0') END AS parsed_account_number,
  CASE i WHEN 1 THEN 'WRONG ACCOUNT' WHEN 2 THEN 'Loan' WHEN 3 THEN 'rent' WHEN 4 THEN 'BANK' WHEN 6 THEN 'TAX PAYMENT' WHEN 7 THEN 'Bank' WHEN 8 THEN 'power' WHEN 9 THEN 'vendor' END AS parsed_note FROM x""")
def description_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.with_parsed(described(spark, sf_dir)).select("row_pos", *(f"parsed_{f}" for f in parse.FIELDS))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = transactions(spark, sf_dir).withColumn("k", F.col("row_pos").cast("string")).withColumn("c", F.col("account_number"))
    # lpad in Spark cuts longer text; here it only ever fills.
    fill = lambda n: F.when(F.length("c") >= n, F.col("c")).otherwise(F.lpad("c", n, "0"))
    forms = [
        F.concat(F.lit("NEFT CR-ABCD0"), F.lpad("k", 6, "0"), F.lit("-Party "), "c", F.lit("-Own Firm-REF"), "k"), F.concat(F.lit("NEFT-RETURN-R"), "k", F.lit("-Party "), "c", F.lit("-WRONG ACCOUNT")),
        F.concat(F.lit("IMPS-"), "k", F.lit("-Party "), "c", F.lit("-HDFC-xxxx"), fill(4), F.lit("-Loan")), F.concat(F.lit("UPI/"), "k", F.lit("/FROM:p"), "c", F.lit("@bank/TO:q@bank/rent")),
        F.concat(F.lit("YIB-NEFT-Y"), "k", F.lit("-Party "), "c", F.lit("-ABCD0123456-Vendor-BANK")), F.concat(F.lit("NET-TPT-Party "), "c", F.lit("-T"), "k"), F.concat(F.lit("INB/"), "k", F.lit("/TAX PAYMENT/NA")),
        F.concat(F.lit("BY CLG:Party "), "c", F.lit(":Bank")), F.concat(F.lit("BILLDESK-B"), "k", F.lit("-Party "), "c", F.lit("-power-9"), "c"), F.concat(F.lit("UTRA0000000"), "k", F.lit("-Party "), "c", F.lit("-12345"), fill(5), F.lit("-vendor")), F.concat(F.lit("unknown "), "k"),
    ]
    d = forms[-1]
    for i, f in enumerate(forms[:-1]):
        d = F.when(F.col("row_pos") % 11 == i, f).otherwise(d)
    return o.withColumn("description", d).drop("k", "c")


@query("SELECT o_orderkey AS row_pos, CASE o_orderkey % 11 WHEN 2 THEN 'PARTY ' || o_custkey WHEN 9 THEN 'PARTY ' || o_custkey END AS dashed FROM orders")
def payee_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("row_pos", names.dashed_payee_name(F.col("description")).alias("dashed"))


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("account_number"), F.when(F.col("c_nationkey") % 2 == 0, "SW").otherwise("HO").alias("business_unit"), F.element_at(F.array(*(F.lit(s) for s in ("Master", "Free", "IDW", "RERA"))), F.col("c_nationkey") % 4 + 1).alias("account_stage"), F.col("c_custkey").cast("int").alias("account_order"))


CLASSIFY_OVERRIDES = [(1, "7", "LOAN", "Loan", "HO", "Loan", "Loan", "Active")]


@query("""WITH x AS (SELECT o_orderkey AS row_pos, o_custkey, o_orderkey % 11 AS i, o_orderpriority IN ('1-URGENT', '2-HIGH') AS cr, CASE WHEN c_nationkey % 2 = 0 THEN 'SW' ELSE 'HO' END AS unit,
  CASE c_nationkey % 4 WHEN 0 THEN 'Master' WHEN 1 THEN 'Free' WHEN 2 THEN 'IDW' ELSE 'RERA' END AS stage FROM orders JOIN customer ON c_custkey = o_custkey),
y AS (SELECT *, CASE WHEN o_custkey % 10 = 7 AND i = 2 THEN 'R0' WHEN cr AND i = 7 THEN 'R3' WHEN cr AND i IN (0, 3, 5) THEN 'R4' WHEN i IN (4, 9) THEN 'R11' ELSE 'R13' END AS rule FROM x)
SELECT row_pos, CASE rule WHEN 'R0' THEN 'Loan' WHEN 'R3' THEN 'Collection' WHEN 'R4' THEN 'Collection' WHEN 'R11' THEN 'Vendor' ELSE '?' END AS head,
  CASE rule WHEN 'R0' THEN 'HO' WHEN 'R13' THEN '?' WHEN 'R11' THEN CASE WHEN stage = 'Free' THEN 'HO' ELSE unit END ELSE unit END AS business_unit,
  CASE rule WHEN 'R0' THEN 'Loan' WHEN 'R13' THEN '?' WHEN 'R11' THEN CASE stage WHEN 'Free' THEN 'HO - Admin' WHEN 'IDW' THEN 'Dev- Apt' ELSE '?' END ELSE 'Customer Collection' END AS type, rule AS classified_by,
  CASE rule WHEN 'R0' THEN 'green' WHEN 'R3' THEN 'red' WHEN 'R4' THEN 'red' ELSE 'navy' END AS review_flag FROM y""")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder. Accounts are given with long numbers, so that none stands in a reference by chance."""
    rows = described(spark, sf_dir).withColumn("key_account", F.concat(F.lit("ACCOUNT-"), "account_number")).drop("account_number").withColumnRenamed("key_account", "account_number")
    accounts = _accounts(spark, sf_dir).withColumn("account_number", F.concat(F.lit("ACCOUNT-"), "account_number"))
    o = small(spark, CLASSIFY_OVERRIDES, "rule_order int, account_suffix string, keyword string, head string, business_unit string, type string, tcp_head string, status string")
    payees = small(spark, [("nobody", "Vendor", None, None, "Confirmed")], "name string, head1 string, head2 string, head3 string, status string")
    x = rules.classify(rows, accounts, o, payees)
    return x.select("row_pos", rules.final_head(F.col("head"), F.lit(None).cast("string")).alias("head"), "business_unit", "type", "classified_by", rules.review_flag().alias("review_flag"))


# -- order-dependent operators, which SQL does not express -------------------------------------------------------


def _ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as the bank has them, and a ledger in which some are missing, some have another text and some another day."""
    a = transactions(spark, sf_dir).withColumn("account_number", (F.col("account_number").cast("long") % 1000).cast("string"))
    k = F.col("row_pos") % 10
    m = a.filter("description <> '5-LOW-P'").withColumn("description", F.when(k == 1, F.concat("description", F.lit(" edited"))).otherwise(F.col("description"))).withColumn("txn_date", F.when(k == 2, F.date_add("txn_date", 2)).when(k == 3, F.date_add("txn_date", 9)).otherwise(F.col("txn_date")))
    return a, m


@query()
def greedy_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.three_way(*_ledgers(spark, sf_dir)).select("account_number", "auto_pos", "main_pos", "status", "reason")


@query()
def chain_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balance.running_balance(transactions(spark, sf_dir), ["account_number"], ["txn_date", "row_pos"], block=F.year("txn_date"))
    return reconcile.placed(b.filter("description LIKE '%-P'"), b.filter("description NOT LIKE '%-P'"))


@query()
def fuzzy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return master.merged_names(p)


@query()
def one_to_one_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names written out against a list of the same made by hand: letters doubled or left out, numbers cut, some names missing."""
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 < 2)
    word = lambda k: F.element_at(F.array(*(F.lit(w) for w in ("RIVER", "COPPER", "MEADOW", "HARBOUR"))), (k % 4 + 1).cast("int"))
    k = F.col("c_custkey")
    name = F.concat(word(k), F.lit(" "), F.upper(F.substr(F.md5(k.cast("string").cast("binary")), F.lit(1), F.lit(14))), F.lit(" "), word((k / 4).cast("long")), F.lit(" TRADING"))
    at = F.col("c_custkey") % 20 + 3
    by_hand = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.substr(name, F.lit(1), at.cast("int")), F.substr(name, (at + 2).cast("int")))).otherwise(F.concat(F.substr(name, F.lit(1), at.cast("int")), F.substr(name, at.cast("int"))))
    return master.fuzzy_one_to_one(c.select(name.alias("name")), c.filter(F.col("c_custkey") % 7 > 0).select(by_hand.alias("name")))


@query(f"""WITH {TX}, l AS (SELECT account_number, max(txn_date) AS last_day FROM tx WHERE description NOT LIKE '%-P' GROUP BY 1), n AS (SELECT *, min(txn_date) OVER (PARTITION BY account_number) AS oldest FROM tx WHERE description LIKE '%-P')
SELECT row_pos, CASE WHEN CAST(account_number AS BIGINT) % 2 = 0 THEN CASE WHEN last_day IS NULL OR txn_date >= last_day THEN 'append' ELSE 'review' END WHEN last_day IS NULL OR oldest >= last_day THEN 'top' ELSE 'chain' END AS place FROM n LEFT JOIN l USING (account_number)""")
def placement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    way = t.select("account_number").distinct().withColumn("is_ascending", F.col("account_number").cast("long") % 2 == 0)
    return reconcile.placement_plan(t.filter("description LIKE '%-P'"), t.filter("description NOT LIKE '%-P'"), way).select("row_pos", "place")


@query("SELECT file, count(*) AS n_rows, min(row_pos) AS first_pos, max(row_pos) AS last_pos FROM (SELECT o_custkey % 100 AS file, o_orderkey AS row_pos FROM orders) GROUP BY file")
def table_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("file"), F.col("o_orderkey").alias("row_pos"))
    return tables.snapshot(o, ["file"])


def statement_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid out as statement pages: a header on each customer's first page, eight lines a page, and a wrapped description below each line."""
    w = Window.partitionBy("account_number").orderBy("txn_date", "row_pos")
    t = transactions(spark, sf_dir).withColumn("n", F.row_number().over(w) - 1).withColumn("page", (F.col("n") / 8).cast("int")).withColumn("y", 100.0 + (F.col("n") % 8) * 30.0)
    cell = lambda s, x0, x1, y: F.struct(s.alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), y.alias("top"))
    body = F.array(
        cell(F.date_format("txn_date", "dd-MM-yyyy"), 10.0, 50.0, F.col("y")), cell(F.concat(F.lit("PAY"), "row_pos"), 120.0, 180.0, F.col("y") + 1.0), cell(F.concat(F.lit("REF"), "row_pos"), 260.0, 300.0, F.col("y")),
        cell(F.when(F.col("debits") > 0, amounts.formatted(F.col("debits"))), 350.0, 400.0, F.col("y")), cell(F.when(F.col("credits") > 0, amounts.formatted(F.col("credits"))), 430.0, 480.0, F.col("y")),
        cell(amounts.formatted(F.col("reported_balance")), 510.0, 560.0, F.col("y")), cell(F.col("description"), 120.0, 190.0, F.col("y") + 10.0),
    )
    head = [("Transaction", 10.0, 60.0), ("Date", 62.0, 80.0), ("Description", 120.0, 180.0), ("Reference", 260.0, 300.0), ("Withdrawals", 350.0, 400.0), ("Deposits", 430.0, 480.0), ("Balance", 510.0, 560.0)]
    titles = F.array(*(cell(F.lit(s), a, b, F.lit(80.0)) for s, a, b in head))
    cells = F.when(F.col("n") == 0, F.concat(titles, body)).otherwise(body)
    out = t.select(F.col("account_number").alias("doc_id"), "page", F.col("n"), F.posexplode(cells).alias("word_no", "c")).filter("c.text is not null")
    return out.select("doc_id", "page", (F.col("n") * 20 + F.col("word_no")).cast("int").alias("word_no"), "c.text", F.col("c.x0").alias("x0"), F.col("c.x1").alias("x1"), F.col("c.top").alias("top"), (F.col("c.top") + 8.0).alias("bottom"))


@query(f"""WITH {TX} SELECT account_number AS source, row_number() OVER (PARTITION BY account_number ORDER BY txn_date, row_pos) - 1 AS row_pos, CAST(txn_date AS VARCHAR) AS txn_date, 'PAY' || row_pos || ' ' || description AS description, 'REF' || row_pos AS reference,
  CAST(credits AS DOUBLE) AS credits, CAST(debits AS DOUBLE) AS debits, CAST(reported_balance AS DOUBLE) AS balance FROM tx""")
def statement_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to lines, columns and records, back to the orders that they were laid out from."""
    rows = geometry.statement_rows(statement_words(spark, sf_dir))
    n = ingest.normalized(rows)
    return n.select("source", "row_pos", F.col("txn_date").cast("string").alias("txn_date"), "description", "reference", F.col("credits").cast("double").alias("credits"), F.col("debits").cast("double").alias("debits"), F.col("reported_balance").cast("double").alias("balance"))

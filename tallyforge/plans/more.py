"""Further registered queries: rules as tables, retroactive rules, lookups by tail and segment, filters and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, dates, names, text
from ..operators import ingest, lookups, master, parse, rules
from ..sources import tables
from ..sources.tables import table
from .ledger import ORACLES, OVERRIDES, QUERIES, TX, described, query, small, transactions

__all__ = ["ORACLES", "QUERIES"]

OVERRIDE_SCHEMA = "rule_order int, account_suffix string, keyword string, head string, business_unit string, type string, tcp_head string, status string"


@query(f"""WITH {TX}, n AS (SELECT *, CASE WHEN account_number LIKE '%7' AND description LIKE '%URGENT%' THEN 'Collection' WHEN description LIKE '%LOW%' THEN 'Vendor' WHEN account_number LIKE '%3' THEN 'Bank' END AS new_head FROM tx)
SELECT row_pos, new_head, coalesce(new_head <> CASE WHEN row_pos % 2 = 0 THEN 'Vendor' ELSE '' END OR row_pos % 2 = 1, true) AS is_changed FROM n WHERE new_head IS NOT NULL""")
def retroactive_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("row_pos") % 2 == 0
    t = transactions(spark, sf_dir).select("row_pos", "account_number", "description", F.when(done, "Vendor").otherwise("").alias("head"), F.when(done, "HO").otherwise("").alias("business_unit"), F.when(done, "A").otherwise("").alias("type"), F.when(done, "T").otherwise("").alias("tcp_head"))
    return rules.apply_overrides(t, small(spark, OVERRIDES, OVERRIDE_SCHEMA)).select("row_pos", "new_head", "is_changed")


STAGE_RULES = [
    (1, "Master", None, None, ["NOT SPEC"], "Bank Charges", "SW", "HO - Admin", "", "High"), (2, "Master", "credit", None, None, "Collection", "SW", "Customer Collection", "Credit- no effect", "High"),
    (3, "Master", "debit", "counterparty", None, "Internal", "SW", "{pair}", "Internal transfer", "High"), (4, "RERA", None, None, None, "Internal", "{unit}", "RERA 2 IDW", "Internal transfer", "High"), (5, "IDW", "debit", "payee", None, "{payee}", "SW", "Dev- Infra", "IDW Civil Works", "High"),
]


@query("""WITH x AS (SELECT o_orderkey AS row_pos, o_orderpriority AS p, o_orderpriority IN ('1-URGENT', '2-HIGH') AS cr, o_custkey % 4 AS s, o_custkey % 3 = 0 AS other, o_custkey % 5 = 0 AS payee FROM orders)
SELECT row_pos, CASE WHEN s = 0 AND p LIKE '%NOT SPEC%' THEN 'Bank Charges' WHEN s = 0 AND cr THEN 'Collection' WHEN s = 0 AND other THEN 'Internal' WHEN s = 1 THEN 'Internal' WHEN s = 2 AND NOT cr AND payee THEN 'Vendor' END AS head,
  CASE WHEN s = 0 AND p LIKE '%NOT SPEC%' THEN 'HO - Admin' WHEN s = 0 AND cr THEN 'Customer Collection' WHEN s = 0 AND other THEN 'Master to Free' WHEN s = 1 THEN 'RERA 2 IDW' WHEN s = 2 AND NOT cr AND payee THEN 'Dev- Infra' END AS type FROM x""")
def stage_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("account_number").cast("long")
    t = transactions(spark, sf_dir).select(
        "row_pos", "description", "credits", "debits", F.element_at(F.array(*(F.lit(s) for s in ("Master", "RERA", "IDW", "Free"))), (k % 4 + 1).cast("int")).alias("account_stage"),
        F.when(k % 3 == 0, "Free").alias("other_stage"), F.lit("U").alias("own_unit"), F.when(k % 5 == 0, "Vendor").alias("payee_head"), F.lit(False).alias("own_company"), F.lit(False).alias("salary"), F.lit(False).alias("imprest"),
    )
    return rules.stage_rules(t, small(spark, STAGE_RULES, rules.STAGE_RULES)).select("row_pos", F.col("s_head").alias("head"), F.col("s_type").alias("type"))


HEADS = [("Internal", 1, "both", ["Own"], ["SELF"], [], False), ("Vendor", 2, "debit", ["Shop"], ["LOW", "MEDIUM"], [], False), ("Refund", 3, "credit", ["Shop"], ["URGENT"], ["^2-H.*F$"], False), ("Others", 99, None, [], [], [], True)]


@query("""SELECT o_orderkey AS row_pos, CASE WHEN o_custkey % 7 = 0 THEN 'Internal' WHEN o_orderpriority IN ('5-LOW', '3-MEDIUM') THEN 'Vendor' WHEN o_orderpriority = '1-URGENT' THEN 'Refund' WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'Refund'
  WHEN o_custkey % 7 = 1 THEN CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Refund' ELSE 'Vendor' END ELSE 'Others' END AS engine_head FROM orders""")
def head_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = small(spark, HEADS, "head string, priority int, direction string, party_types array<string>, keywords array<string>, patterns array<string>, fallback boolean")
    p = small(spark, [("Own Firm", "Own", ["OWN"], "high"), ("Shop A", "Shop", [], "high")], "canonical string, type string, aliases array<string>, confidence string")
    k = F.col("account_number").cast("long") % 7
    t = transactions(spark, sf_dir).withColumn("parsed_party", F.when(k == 0, "own").when(k == 1, "Shop A"))
    return rules.engine_head(t, p, h).select("row_pos", "engine_head")


@query("""SELECT tail, account_number, company, is_ambiguous FROM (SELECT s_suppkey, right(s_name, 1) AS tail FROM supplier) JOIN (SELECT right(CAST(c_custkey AS VARCHAR), 1) AS t, arg_min(CAST(c_custkey AS VARCHAR), c_custkey) AS account_number, arg_min(c_mktsegment, c_custkey) AS company, count(DISTINCT c_mktsegment) > 1 AS is_ambiguous FROM customer GROUP BY 1) ON t = tail""")
def account_by_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("account_number"), F.col("c_mktsegment").alias("company"), F.col("c_custkey").cast("int").alias("account_order"))
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.right("s_name", F.lit(1)).alias("tail"))
    return lookups.account_by_tail(t, a, 1).select("tail", "account_number", "company", "is_ambiguous")


@query(r"""WITH s AS (SELECT page_id, upper(trim(seg)) AS part, pos FROM (SELECT page_id, unnest(regexp_split_to_array(url, '[-/]')) AS seg, generate_subscripts(regexp_split_to_array(url, '[-/]'), 1) AS pos FROM pages)),
k AS (SELECT DISTINCT upper(regexp_extract(url, '//([^/]+)', 1)) AS host FROM pages WHERE url LIKE 'https:%')
SELECT page_id, first.host FROM pages LEFT JOIN (SELECT page_id, arg_min(host, pos) AS host FROM s JOIN k ON host = part WHERE length(part) >= 3 GROUP BY page_id) first USING (page_id)""")
def known_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    dim = p.filter("url LIKE 'https:%'").select(F.upper(F.regexp_extract("url", "//([^/]+)", 1)).alias("host")).distinct()
    return lookups.first_known_segment(p, "url", dim.withColumn("name", F.col("host")), "name", ["host"], ["page_id"]).select("page_id", "host")


@query("SELECT o_orderkey AS row_pos FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderpriority <> ''")
def unclassified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("row_pos") % 4 == 0, "x").otherwise(" ")
    return rules.unclassified(transactions(spark, sf_dir).withColumns({"head": F.lit("x"), "business_unit": F.lit("x"), "type": done, "tcp_head": F.lit("x"), "narration": F.lit("x")})).select("row_pos")


@query("SELECT o_orderkey AS row_pos, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus ELSE o_orderpriority END AS head FROM orders")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_pos"), F.col("o_orderpriority").alias("head"))
    new = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("row_pos"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).otherwise(F.lit("")).alias("head"))
    return tables.merged_update(old, new, ["row_pos"], ["head"])


@query("SELECT s_suppkey, 'XXXX' || right(s_name, 4) AS masked, coalesce(CASE WHEN s_suppkey % 5 = 0 THEN 'override' END, 'Bank - ' || right(trim(s_name), 4)) AS name FROM supplier")
def account_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.masked_account(n).alias("masked"), lookups.table_name(F.when(F.col("s_suppkey") % 5 == 0, "override"), F.lit("Bank"), n).alias("name"))


@query("SELECT o_orderkey AS row_pos, CASE o_orderkey % 11 WHEN 4 THEN 'Vendor' WHEN 9 THEN 'Vendor' END AS role FROM orders")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("row_pos", names.role_in(F.col("description")).alias("role"))


@query(f"WITH {TX} SELECT head, count(*) AS n, min(row_pos) AS first_pos, name FROM (SELECT 'PARTY ' || account_number AS name, CASE WHEN row_pos % 11 = 2 THEN 'Loan' ELSE 'Vendor' END AS head, row_pos FROM tx WHERE row_pos % 11 IN (2, 9)) GROUP BY name, head")
def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = described(spark, sf_dir)
    return master.discoveries(d.select("row_pos", names.dashed_payee_name(F.col("description")).alias("payee"), F.when(F.col("row_pos") % 11 == 2, "Loan").otherwise("Vendor").alias("head")))


@query("SELECT parsed_payment_mode AS mode, count(*) AS n FROM (SELECT CASE o_orderkey % 11 WHEN 0 THEN 'NEFT' WHEN 1 THEN 'NEFT' WHEN 2 THEN 'IMPS' WHEN 3 THEN 'UPI' WHEN 4 THEN 'NEFT' WHEN 5 THEN 'TPT' WHEN 6 THEN 'INB' WHEN 7 THEN 'CLG' WHEN 8 THEN 'BILLDESK' END AS parsed_payment_mode FROM orders) GROUP BY 1")
def mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.with_parsed(described(spark, sf_dir)).groupBy(F.col("parsed_payment_mode").alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS row_pos, o_orderpriority AS value FROM orders WHERE o_orderstatus <> CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END")
def changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_pos"), F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("old"), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise(F.col("o_orderstatus")).alias("new"))
    return ingest.changed_rows(o, ["old"], ["new"]).select("row_pos", "value")


@query("SELECT o_orderkey AS row_pos, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'Q' || CAST((month(o_orderdate) + 8) % 12 // 3 + 1 AS VARCHAR) END AS quarter FROM orders")
def filled_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_pos"), "o_orderdate", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(" ").alias("quarter"))
    return ingest.fill_blanks(o, {"quarter": dates.fiscal_quarter(F.col("o_orderdate"))}).select("row_pos", "quarter")


@query("SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS price FROM lineitem WHERE l_linenumber = 1")
def strict_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only text that is an amount passes: line 1 is printed as statements do, the others with a currency sign."""
    shown = amounts.formatted(F.col("l_extendedprice").cast(amounts.MONEY))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, shown).otherwise(F.concat(F.lit("Rs "), shown)).alias("t"))
    return x.select("l_orderkey", amounts.strict_amount(F.col("t")).cast("double").alias("price")).filter("price is not null")

"""Queries for sources and sinks, filters and edits of tables, payees and the functions on texts, names and dates, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, dates, names, text
from ..operators import balance, ingest, master, narrate, rules, similar
from ..sources import tables
from ..sources.stored import numbered
from ..sources.tables import table
from .further import templated, templated_sql
from .ledger import TX, query, small, transactions

K, C = "CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)"


def made(spark: SparkSession, sf_dir: str, templates: list[str]) -> DataFrame:
    """Orders as (row_pos, t): t is the template of the order's number."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("row_pos"), templated(templates, F.pmod(k, F.lit(len(templates))), k=k.cast("string"), c=F.col("o_custkey").cast("string")).alias("t"), F.col("o_custkey").alias("custkey"))


def made_sql(templates: list[str]) -> str:
    return f"x AS (SELECT o_orderkey AS row_pos, o_custkey AS custkey, {templated_sql(templates, f'o_orderkey % {len(templates)}', k=K, c=C)} AS t FROM orders)"


def scratch(spark: SparkSession, name: str) -> str:
    """A folder beside the checkpoints; where the session names none, a temporary one (tests)."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tallyforge-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


# -- names and texts ------------------------------------------------------------------------------------------------

COMPANIES = ["Alpha {c} Private Limited", "Alpha {c} Pvt. Ltd.", "Alpha {c} Pvt Ltd", "Alpha {c} Limited", "Alpha {c} Ltd", "Alpha {c} LLP", "Limitedly {c}"]


@query(rf"WITH {made_sql(COMPANIES)} SELECT row_pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(t), '\bPRIVATE LIMITED\b', 'PVTLTD'), '\bPVT\.?\s*LTD\.?\b', 'PVTLTD'), '\bLIMITED\b', 'LTD'), '[^A-Z0-9]', '', 'g') AS key FROM x")
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, COMPANIES).select("row_pos", text.company_key(F.col("t")).alias("key"))


MAILS = ["Account No: {k}1234 was credited", "Your A/c no. XXXX{c}", "a/c XX99{k} debited", "Account Number - {k}", "account of Mr X ending {k}.", "no account 12", "nothing"]


@query(f"""WITH {made_sql(MAILS)}, m AS (SELECT row_pos, string_split(replace(lower(t), 'a/c', 'account'), 'account')[2] AS b FROM x),
w AS (SELECT row_pos, list_filter(string_split(translate(b, ':-.', '   '), ' '), lambda p: p <> '') AS w, b FROM m)
SELECT row_pos, CASE WHEN w[1] IN ('no', 'number') THEN CASE WHEN TRY_CAST(right(w[2], 4) AS INT) IS NOT NULL AND length(w[2]) >= 4 THEN right(w[2], 4) END
  ELSE right(list_filter(w, lambda p: TRY_CAST(right(p, 4) AS INT) IS NOT NULL AND length(p) >= 4 AND strpos(b, p) <= 16)[-1], 4) END AS tail FROM w""")
def account_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, MAILS).select("row_pos", text.account_tail(F.col("t")).alias("tail"))


FILES = ["statement {k}.PDF", "../up/of {c}.txt", "a b/c-{k}", "é{k}.pdf", "x_{k}.Pdf"]


@query(rf"WITH {made_sql(FILES)}, n AS (SELECT row_pos, regexp_replace(regexp_extract(t, '[^/]*$'), '[^a-zA-Z0-9._-]', '_', 'g') AS f FROM x) SELECT row_pos, '20260405_' || CASE WHEN lower(f) LIKE '%.pdf' THEN f ELSE f || '.pdf' END AS name FROM n")
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, FILES).select("row_pos", text.safe_filename(F.col("t"), F.lit("20260405")).alias("name"))


ERRORS = ["Wrong PASSWORD {k}", "unsupported layout", "duplicate file {k}", "tab not found", "", "e" * 90 + "{k}"]


@query(f"""WITH {made_sql(ERRORS)}, s AS (SELECT *, custkey % 11 AS stage, lower(t) AS e FROM x)
SELECT row_pos, CASE WHEN stage = 5 THEN 'Account not found' WHEN stage = 6 THEN CASE WHEN e LIKE '%password%' THEN 'Invalid PDF password' ELSE 'Corrupted PDF' END WHEN stage = 7 THEN CASE WHEN e LIKE '%unsupported%' THEN 'Unsupported bank format' ELSE 'Parsing failed' END WHEN stage = 8 THEN 'Financial Year mismatch'
  WHEN stage = 9 THEN CASE WHEN e LIKE '%duplicate%' THEN 'Duplicate statement' WHEN e LIKE '%not found%' THEN 'Account not found' ELSE 'Failed to upload to Google Sheets' END ELSE CASE WHEN t = '' THEN 'Processing failed' WHEN length(t) > 80 THEN t[:77] || '...' ELSE t END END AS category FROM s""")
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, ERRORS).select("row_pos", text.failure_category(F.col("custkey") % 11, F.col("t")).alias("category"))


NOTES = ["neft-HDFC0AB{k}/Party {c}", "PAY ELECTRICITY BILL CONTRACTOR {k}", "imps/SBIN{k}x/9{c}9-rent", "x{k} YESMEABCDEF12-q", "a--b//c"]


@query(rf"WITH {made_sql(NOTES)} SELECT row_pos, trim(regexp_replace(translate(regexp_replace(regexp_replace(upper(t), '\b({'|'.join(text.BANK_CODES)})[A-Z0-9]{{6,}}\b', ' ', 'g'), '\b\d{{4,}}\b', ' ', 'g'), '-/', '  '), '\s+', ' ', 'g')) AS terms FROM x")
def term_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, NOTES).select("row_pos", text.term_text(F.col("t")).alias("terms"))


BATCH = [
    "BY CLG:Party {c}:Some Bank - 01", "DD ISSUED/QQ/Party {c}/atPar", "DD Cancln {k}", "NEFT CR-QRST0{k}-Party {c}-Own Firm-QRSTN000{k}000", "NEFT QRSTN123456{k}000 Party {c} Works QRST0004114", "RTGS QRSTN123456{k}000 Party {c}", "INB/IFT/PARTY {c} AXIS/TPARTY TRANSFER", "NEFT/K{k}/Party {c}/Bank/NA",
    "RTGS/K{k}/Party {c}/Bank/x", "IMPS-{k}-Party {c}-QRST-xx12-rent", "BILLDESK-B{k}-Party {c}-x-9", "NEFT-RETURN-K{k}-Party {c}-WRONG", "INB/{k}/Party {c}/NA", "INB/{k}/EPFO PAYMENT/NA", "QRSTH000123456{k}-Party {c}-123456789012-vendor", "QRSTH000123456{k}-Party {c}-salary", "SMS CHARGES {k}", "plain {k}",
]


@query(rf"""WITH {made_sql(BATCH)}
SELECT row_pos, nullif(trim(CASE WHEN t LIKE 'BY CLG:%' THEN split_part(t, ':', 2) WHEN t LIKE 'DD ISSUED/%' THEN regexp_replace(regexp_extract(t, '^DD ISSUED/[^/]+/(.+)$', 1), '/atPar$', '') WHEN t LIKE 'DD Cancln%' THEN NULL WHEN t LIKE 'NEFT CR-%' THEN split_part(t, '-', 3)
  WHEN regexp_matches(t, '^(NEFT|RTGS) [A-Z0-9]{{10,}} ') THEN regexp_replace(regexp_extract(t, '^(NEFT|RTGS) [A-Z0-9]{{10,}} (.+)$', 2), ' [A-Z]{{2,6}}\d{{4,}}$', '') WHEN t LIKE 'INB/IFT/%' THEN regexp_replace(split_part(t, '/', 3), 'AXIS$', '') WHEN regexp_matches(t, '^(NEFT|RTGS)/') THEN split_part(t, '/', 3)
  WHEN t LIKE 'IMPS-%' THEN split_part(t, '-', 3) WHEN t LIKE 'BILLDESK-%' THEN split_part(t, '-', 3) WHEN t LIKE 'NEFT-RETURN-%' THEN split_part(t, '-', 4) WHEN t LIKE 'INB/%/NA' AND t NOT LIKE '%EPFO%' THEN split_part(t, '/', 3) WHEN regexp_matches(t, '^QRSTH\d{{6,}}-') THEN split_part(t, '-', 2) END), '') AS name FROM x""")
def batch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, BATCH).select("row_pos", names.any_payee_name(F.col("t")).alias("name"))


PAYEES = ["YIB-NEFT-Y{k}-Party {c} VENDOR-WXYZ0123456-x", "YIB-TPT-Y{k}-Party {c} ADVANCE-1", "YIB-NEFT-Y{k}-WXYZ0123456-z", "YIB-NEFT-Y{k}-{k}-z", "IMPS/{k}/Party {c} REFUND/x", "IMPS/{k}/RRN{k}/x", "NEFT QRST{k} Party {c} Works WXYZ0123456", "plain {k}", "x-a salary-IMPREST", "pay/im prest/x"]


@query(r"""WITH """ + made_sql(PAYEES) + r""", p AS (SELECT row_pos, t, upper(trim(CASE WHEN t LIKE 'YIB-%' THEN split_part(t, '-', 4) WHEN t LIKE 'IMPS/%' THEN split_part(t, '/', -2) WHEN t LIKE 'NEFT %' THEN regexp_extract(t, '^NEFT \S+ (.+) [A-Z]{4}0[A-Z0-9]{6}$', 1) END)) AS n FROM x)
SELECT row_pos, nullif(trim(regexp_replace(CASE WHEN n = '' OR regexp_matches(n, '^\d+$') OR t LIKE 'YIB%' AND regexp_matches(n, '^[A-Z]{4}0[A-Z0-9]{6}$') OR t LIKE 'IMPS%' AND n LIKE 'RRN%' THEN NULL ELSE n END, '\s+(IMPREST|SALARY|CONTRACTOR|PROFESSIONAL|VENDOR|ADVANCE|REFUND)$', '')), '') AS payee,
  len([s for s in regexp_split_to_array(t, '[-/]') if replace(lower(trim(s)), ' ', '') = 'imprest' OR regexp_matches(lower(trim(s)), '\simprest$')]) > 0 AS imprest, len([s for s in regexp_split_to_array(t, '[-/]') if replace(lower(trim(s)), ' ', '') = 'salary' OR regexp_matches(lower(trim(s)), '\ssalary$')]) > 0 AS salary FROM p""")
def payee_and_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return made(spark, sf_dir, PAYEES).select("row_pos", names.payee_name(t).alias("payee"), names.mentions_segment(t, "imprest").alias("imprest"), names.mentions_segment(t, "salary").alias("salary"))


SHAPES = ["https://host/d/Ab-{k}_x/edit", "{k}", "QRST0{c}ABCDEF", "Alpha beta {k}", " gamma", ""]


@query(rf"""WITH {made_sql(SHAPES)} SELECT row_pos, coalesce(nullif(regexp_extract(t, '/d/([A-Za-z0-9_-]+)', 1), ''), nullif(trim(t), '')) AS table_id, regexp_matches(t, '^\d+$') AS digits, regexp_matches(t, '^[A-Z]{{4}}0[A-Z0-9]{{6}}$') AS ifsc,
  regexp_split_to_array(trim(t), '\s+')[1] AS first_word, regexp_split_to_array(trim(t), '\s+')[-1] AS last_word, array_to_string([upper(w[1]) for w in regexp_split_to_array(trim(t), '\s+') if w <> ''], '') AS initials,
  decode(from_base64(translate(replace(replace(to_base64(encode(t)), '+', '-'), '/', '_'), '-_', '+/'))) AS decoded, upper(t) LIKE '%ALPHABETA%' OR replace(upper(t), ' ', '') LIKE '%ALPHABETA%' AS own_bare, upper(t) LIKE '%ALPHA BETA%' AS own_spaced FROM x""")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    encoded = F.translate(F.base64(F.encode(t, "UTF-8")), "+/", "-_")
    return made(spark, sf_dir, SHAPES).select(
        "row_pos", text.table_id(t).alias("table_id"), text.is_digits(t).alias("digits"), text.is_ifsc(t).alias("ifsc"), text.first_word(t).alias("first_word"), text.last_word(t).alias("last_word"), text.initials(t).alias("initials"),
        F.decode(text.from_base64url(encoded), "UTF-8").alias("decoded"), rules.names_own_company(t, ["Alpha Beta"]).alias("own_bare"), rules.names_own_company(t, ["Alpha Beta"], True).alias("own_spaced"),
    )


@query(r"""SELECT o_orderkey AS row_pos, CASE o_orderkey % 4 WHEN 3 THEN 'XXXX' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, strftime(o_orderdate + INTERVAL 330 MINUTE, '%d %b %Y, %I:%M %p') AS shown,
  array_to_string([CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') for y in range(year(o_orderdate), year(o_orderdate) + 3)], ',') AS years, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_orderkey END AS DECIMAL(18,2))::DOUBLE AS amount, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS number FROM orders""")
def dates_and_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    told = F.when(k % 4 == 0, F.date_format(d, "d-MMM-yyyy")).when(k % 4 == 1, F.date_format(d, " dd-MMM-yyyy ")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("XXXX")
    into, out = F.when(k % 2 == 0, F.col("o_totalprice")).otherwise(0.0).cast(amounts.MONEY), k.cast(amounts.MONEY)
    years = F.transform(F.sequence(F.year(d), F.year(d) + 2), lambda y: F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0")))
    return table(spark, sf_dir, "orders").select(
        k.alias("row_pos"), dates.canonical_date(told).alias("day"), dates.shown_time(d.cast("timestamp_ntz")).alias("shown"), F.array_join(years, ",").alias("years"), amounts.amount_of(into, out).cast("double").alias("amount"),
        amounts.number_or_null(F.when(k % 3 == 0, "n/a").otherwise(F.format_number(k, 0))).alias("number"),
    )


@query("""WITH y AS (SELECT min(year(o_orderdate - INTERVAL 3 MONTH)) AS a, max(year(o_orderdate - INTERVAL 3 MONTH)) AS b FROM orders WHERE o_orderdate IS NOT NULL)
SELECT CAST(k AS VARCHAR) || '-' || lpad(CAST((k + 1) % 100 AS VARCHAR), 2, '0') AS year FROM (SELECT unnest(range(a, b + 1)) AS k FROM y)""")
def fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fiscal years, which begin in April, from a ledger's first date to its last."""
    began = F.year(F.add_months(F.col("o_orderdate").cast("date"), -3))
    ends = table(spark, sf_dir, "orders").agg(F.min(began).alias("a"), F.max(began).alias("b")).filter("a is not null")
    return ends.select(F.explode(dates.fiscal_year_options(F.col("a"), F.col("b") - F.col("a") + 1)).alias("year"))


@query("""WITH x AS (SELECT o_orderkey AS row_pos, o_orderpriority IN ('1-URGENT', '2-HIGH') AS cr, 'to ACCT' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS d, o_orderkey % 3 = 0 AS own FROM orders)
SELECT row_pos, CASE WHEN NOT own THEN 'Internal Transfer' WHEN cr THEN 'Internal Fund Transfer (From x' || right(d, 4) || ' to x4321)' ELSE 'Internal Fund Transfer (From x4321 to x' || right(d, 4) || ')' END || ' | Ref: N/A | Type: Master to Free | BU: SW | Head: Internal' AS narration FROM x""")
def internal_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("d", F.concat(F.lit("to ACCT"), F.lpad("account_number", 8, "0")))
    return t.select("row_pos", narrate.narration(F.col("d"), F.col("credits"), F.lit("Internal"), F.lit("Master to Free"), F.lit("SW"), F.lit("987654321"), F.lit(None).cast("string"), F.lit(" "), F.col("row_pos") % 3 == 0).alias("narration"))


# -- tables: scans, sinks, edits --------------------------------------------------------------------------------------


@query(f"WITH {TX} SELECT account_number, row_pos, CAST(credits AS DOUBLE) AS credits, upper(description) AS description, CASE WHEN CAST(row_pos AS VARCHAR) LIKE '%7' THEN 0 ELSE row_pos END AS checked FROM tx")
def typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything as text, then typed: bad numbers are 0, texts upper and trimmed."""
    t = transactions(spark, sf_dir).select("account_number", "row_pos", "credits", "debits", F.concat(F.lit(" "), F.lower("description")).alias("description"), F.when(F.col("row_pos").cast("string").endswith("7"), "bad").otherwise(F.col("row_pos").cast("string")).alias("checked"))
    x = tables.typed_ledger(tables.as_strings(t), ("credits", "checked"))
    return x.select("account_number", F.col("row_pos").cast("long").alias("row_pos"), F.col("credits").cast("double").alias("credits"), "description", F.col("checked").cast("long").alias("checked"))


@query("SELECT n_name AS name, n_rows FROM nation JOIN (SELECT c_nationkey AS k, count(*) AS n_rows FROM customer GROUP BY 1) ON k = n_nationkey WHERE n_name NOT IN ('NATION_3', 'NATION_7')")
def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a catalogue but the reserved ones, with their rows."""
    n = tables.data_tables(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), "name", ["NATION_3", "NATION_7"])
    return n.join(tables.row_counts(table(spark, sf_dir, "customer"), ["c_nationkey"]), F.col("c_nationkey") == F.col("n_nationkey")).select("name", "n_rows")


@query("SELECT o_orderkey AS row_pos, o_custkey AS tab FROM orders WHERE o_orderkey % 5 NOT IN (3, 4) AND o_orderkey > (SELECT min(b.o_orderkey) FROM orders b WHERE b.o_custkey = orders.o_custkey AND b.o_orderkey % 5 = 3)")
def below_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with a header row somewhere, markers and spacers: data rows below the first header, those whose date can be read."""
    k = F.col("o_orderkey")
    cells = F.when(k % 5 == 3, F.array(F.lit("Date"), F.lit(" Description "))).when(k % 5 == 4, F.array(F.lit(""), F.lit("xxxx"))).otherwise(F.array(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("pay")))
    grid = table(spark, sf_dir, "orders").select(k.alias("row_pos"), F.col("o_custkey").alias("tab"), cells.alias("cells"))
    return tables.dated_rows(tables.below_header(grid, "description", ["tab"]).withColumn("txn_date", F.element_at("cells", 1)), "txn_date").select("row_pos", "tab")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, true AS no_comment FROM events")
def config_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON maps written to files and read back, without their comments."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.map_concat(F.create_map(F.lit("_comment"), F.lit("x")), F.from_json("props", "map<string,string>"))).alias("value"))
    path = scratch(spark, "config")
    e.select("event_id", "value").write.json(path)
    m = tables.json_config(spark, path, "event_id long, value string", False).select("event_id", tables.config_map(F.col("value")).alias("m"))
    return m.select("event_id", F.col("m")["k"].alias("k"), (~F.array_contains(F.map_keys("m"), "_comment")).alias("no_comment"))


@query(f"""WITH {TX}, a AS (SELECT * FROM tx WHERE description LIKE '%-F' OR description LIKE '%-O'), n AS (SELECT description[-1:] AS company, count(*) AS n_rows, CAST(sum(credits) AS DOUBLE) AS credits FROM a GROUP BY 1)
SELECT company, CASE WHEN company = 'O' THEN 2 * n_rows ELSE n_rows END AS n_rows, CASE WHEN company = 'O' THEN 2 * credits ELSE credits END AS credits FROM n""")
def appended_and_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by company and account: rows are appended twice for one company, and the other's partitions are replaced by themselves."""
    t = transactions(spark, sf_dir).withColumns({"company": F.right("description", F.lit(1)), "account_number": (F.col("account_number").cast("long") % 3).cast("string")}).filter("company <> 'P'")
    path = scratch(spark, "ledger")
    tables.append_ledger(t, path)
    tables.append_ledger(t.filter("company = 'O'"), path)
    tables.overwrite_partitions(t.filter("company = 'F'"), path)
    return spark.read.parquet(path).groupBy("company").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("credits").cast("double").alias("credits"))


@query("SELECT s_suppkey, s_acctbal AS amount, s_acctbal AS balance_ai, CAST(NULL AS VARCHAR) AS note FROM supplier")
def migrated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column put in behind another with its values (once, however often it runs), one added at the end, one dropped."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("amount"), F.lit("old").alias("reason"))
    for _ in range(2):
        s = tables.inserted_column(tables.extended(tables.dropped(s, "reason"), {"note": "string"}), "amount", "balance_ai", "amount")
    return s


@query("SELECT n_nationkey, CASE WHEN n_name = 'NATION_5' THEN 'C' ELSE n_name END AS new_name FROM nation WHERE n_name IN ('NATION_5', 'NATION_9')")
def renames_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    plan = tables.renamed_tables(n, {"NATION_5": "C", "NATION_9": "NATION_9"})
    return n.join(plan, F.col("name") == F.col("old_name")).select("n_nationkey", "new_name")


@query("SELECT o_orderpriority AS value, o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS is_extra, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'Pending' END AS held, CASE o_orderpriority WHEN '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS label, count(*) AS n FROM orders GROUP BY ALL")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a list allows, those in use beyond it, a default for them, and renamed labels."""
    allowed = ["1-URGENT", "2-HIGH"]
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value"), F.col("o_orderpriority").alias("held"), F.col("o_orderpriority").alias("label"))
    extra = ingest.extra_values(o, "value", allowed).withColumn("is_extra", F.lit(True))
    x = ingest.replaced_labels(ingest.enum_or_default(o, "held", allowed, "Pending"), "label", {"5-LOW": "LOW"})
    return x.join(extra, "value", "left").groupBy("value", F.coalesce("is_extra", F.lit(False)).alias("is_extra"), "held", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%BOLT%' AND p_size = 9 OR p_brand ILIKE '%BOLT%' AND p_size = 9")
def searched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.searched(table(spark, sf_dir, "part"), ["p_name", "p_brand"], "Bolt", p_size=9).select("p_partkey")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) || '.5' END AS shown FROM customer WHERE c_custkey % 4 <> 0")
def numbers_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns with numbers as they are shown, whole ones without decimals; rows without anything in them go."""
    k = F.col("c_custkey")
    t = F.when(k % 4 == 0, " ").when(k % 3 == 0, "n/a").when(k % 3 == 1, F.concat(F.format_number(k, 0), F.lit(".00"))).otherwise(F.concat(k.cast("string"), F.lit(".50")))
    x = table(spark, sf_dir, "customer").select("c_custkey", t.alias("shown"), F.when(k % 4 == 0, F.lit(None)).otherwise(F.lit("x")).alias("other"))
    return ingest.whole_numbers(ingest.without_empty_rows(x, ["shown", "other"]), ["shown"]).select("c_custkey", "shown")


@query("""WITH l AS (SELECT user_id, event_id, event_type, value FROM events), p AS (SELECT user_id, arg_max(event_type, event_id) AS op, arg_max(value, CASE WHEN event_type <> 'view' THEN event_id END) AS value FROM l GROUP BY user_id)
SELECT user_id, value FROM p WHERE op <> 'error'""")
def log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is only appended to: values of views are null and so leave the older ones, errors delete."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return tables.log_state(e, "user_id").select("user_id", "value")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id DESC) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS f FROM events)
SELECT event_id, n <= 500 AS in_log, f > 10 AS is_deleted, n FROM r WHERE n <= 500 OR f > 10""")
def logs_and_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 of a log, files beyond a folder's newest ten, and a reversed order by number."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("folder"), F.col("ts").alias("modified"), F.col("event_id").alias("name"))
    log = tables.capped_log(e, [F.desc("event_id")]).select("event_id", F.lit(True).alias("in_log"))
    gone = tables.newest_files(e, 10).select("event_id", F.lit(True).alias("is_deleted"))
    total = e.agg(F.max("event_id")).scalar()
    x = log.join(gone, "event_id", "full")
    return x.select("event_id", F.coalesce("in_log", F.lit(False)).alias("in_log"), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), (total - F.col("event_id") + 1).alias("n"))


@query("""WITH k AS (SELECT c_custkey, o.link, n_name AS tab FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS link FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_custkey)
SELECT CAST(c_custkey AS VARCHAR) AS account_number, link, tab FROM k""")
def account_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("account_number"))
    links = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("account_number"), F.col("o_orderpriority").alias("link"), F.col("o_orderkey").alias("added"))
    tabs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("account_number"), F.col("n_name").alias("tab"))
    return tables.with_links(a, links, tabs)


@query("""WITH e AS (SELECT n_nationkey + 1 AS row_no, CASE WHEN n_nationkey % 5 = 1 THEN NULL WHEN n_nationkey % 5 = 2 THEN lower(n_name) ELSE n_name END AS name FROM nation), k AS (SELECT name, row_no AS o FROM e WHERE name IS NOT NULL UNION ALL SELECT r_name, 100 + r_regionkey FROM region)
SELECT row_number() OVER (ORDER BY o) AS row_no, name FROM k""")
def edited_payees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list after edits by row number: some rows replaced, some deleted, some appended."""
    n = table(spark, sf_dir, "nation")
    rows = n.select((F.col("n_nationkey") + 1).alias("row_no"), F.col("n_name").alias("name"))
    k = F.col("n_nationkey")
    edits = n.filter(k % 5 < 3).filter(k % 5 > 0).select(F.when(k % 5 == 1, "delete").otherwise("update").alias("action"), k.alias("edit_no"), (k + 1).alias("row_no"), F.lower("n_name").alias("name"))
    more = table(spark, sf_dir, "region").select(F.lit("append").alias("action"), F.col("r_regionkey").alias("edit_no"), F.lit(None).cast("int").alias("row_no"), F.col("r_name").alias("name"))
    return tables.edited(rows, edits.unionByName(more)).select(F.col("row_no").cast("long").alias("row_no"), "name")


@query(f"WITH {TX}, d AS (SELECT txn_date, credits, debits, reported_balance, count(*) AS n FROM (SELECT * FROM tx UNION ALL SELECT * FROM tx WHERE description LIKE '%-F') GROUP BY ALL HAVING count(*) > 1) SELECT CAST(txn_date AS VARCHAR) AS txn_date, CAST(reported_balance AS DOUBLE) AS balance, n FROM d")
def duplicates_on_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a ledger holds twice: each order that is done stands there once more."""
    t = transactions(spark, sf_dir)
    return tables.duplicates_on_file(t.unionByName(t.filter("description LIKE '%-F'"))).select(F.col("txn_date").cast("string").alias("txn_date"), F.col("reported_balance").cast("double").alias("balance"), "n")


@query("SELECT o_orderkey AS row_pos, 100 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sl, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS top FROM orders")
def serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial numbers that go on from 100, and the same rows from the top."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_pos"), "o_custkey")
    x = balance.serial_numbers(o, ["o_custkey"], ["row_pos"], 100).withColumnRenamed("sl", "s")
    return balance.serial_numbers(x, ["o_custkey"], [F.desc("row_pos")]).select("row_pos", F.col("s").cast("long").alias("sl"), F.col("sl").cast("long").alias("top"))


# -- payees and answers -------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT l_suppkey % 7 AS name, l_returnflag AS head, count(*) AS n, min(l_orderkey) AS first_pos FROM lineitem GROUP BY ALL), c AS (SELECT name, CASE WHEN name < 3 THEN 0 ELSE name END AS canonical FROM (SELECT DISTINCT name FROM p))
SELECT CAST(canonical AS VARCHAR) AS name, head, CAST(sum(n) AS BIGINT) AS n, min(first_pos) AS first_pos, row_number() OVER (ORDER BY sum(n) DESC, CAST(canonical AS VARCHAR), head) AS place FROM p JOIN c USING (name) GROUP BY canonical, head""")
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of heads after names that mean the same have become one, by count and name."""
    p = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).cast("string").alias("name"), F.col("l_returnflag").alias("head")).agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_pos"))
    canonical = p.select("name").distinct().withColumn("canonical", F.when(F.col("name").cast("int") < 3, "0").otherwise(F.col("name")))
    return numbered(master.merged_counts(p, canonical), [F.desc("n"), F.col("name"), F.col("head")], "place")


LOOK_TEXTS = ["YIB-NEFT-Y{k}-Party {c}-WXYZ0123456-x", "YIB-NEFT-Y{k}-Known Person-WXYZ0123456-x", "plain {k}", ""]
_HEAD_OF = "CASE o_custkey % 5 WHEN 0 THEN '?' WHEN 1 THEN 'Vendor' WHEN 2 THEN 'Contractor' WHEN 3 THEN 'Collection' ELSE 'Imprest' END"


@query(f"""WITH x AS (SELECT o_orderkey AS row_pos, {templated_sql(LOOK_TEXTS, 'o_orderkey % 4', k=K, c=C)} AS t, {_HEAD_OF} AS head FROM orders)
SELECT row_pos, head = '?' AS is_unknown, CASE WHEN t LIKE 'YIB-%' THEN upper(split_part(t, '-', 4)) END AS payee FROM x WHERE t <> '' AND (head = '?' OR head IN ('Vendor', 'Contractor') AND t LIKE 'YIB-%' AND t NOT LIKE '%Known Person%')""")
def second_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked: unknown heads, and word heads of payees that are not on file."""
    head = F.element_at(F.array(*(F.lit(h) for h in ("?", "Vendor", "Contractor", "Collection", "Imprest"))), (F.col("custkey") % 5 + 1).cast("int"))
    rows = made(spark, sf_dir, LOOK_TEXTS).select("row_pos", F.col("t").alias("description"), head.alias("head"))
    return similar.second_look(rows, small(spark, [("Known Person",)], "name string")).select("row_pos", "is_unknown", "payee")


@query("""WITH x AS (SELECT o_orderkey AS row_pos, o_orderpriority AS said, CASE o_custkey % 5 WHEN 0 THEN '?' WHEN 1 THEN 'Vendor' WHEN 2 THEN 'Contractor' WHEN 3 THEN 'Collection' ELSE 'Imprest' END AS old,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Vendor' WHEN '2-HIGH' THEN 'Contractor' WHEN '3-MEDIUM' THEN 'Salary HO' WHEN '4-NOT SPECIFIED' THEN '?' END AS new FROM orders)
SELECT row_pos, old AS old_head, new AS head, 'Low' AS confidence, CASE WHEN old = '?' THEN 'AI: ' ELSE 'AI override from ' || old || ': ' END || said AS reason, CASE WHEN new = 'Vendor' THEN 'HO' ELSE '?' END AS business_unit FROM x WHERE new IS NOT NULL AND new <> '?' AND new <> old""")
def corrected_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugged-in model (here a table of answers): prompts go in, JSON comes out; heads off the list become unknown, others override, with the fields of their head."""
    import pandas as pd

    def ask(batches):
        said = {"1-URGENT": "Vendor", "2-HIGH": "Contractor", "3-MEDIUM": "Salary HO", "4-NOT SPECIFIED": "Nonsense"}
        for x in batches:
            answers = [f'```json\n{{"head": "{said[p]}", "reason": "{p}", "suggest_master": false}}\n```' if p in said else "no idea" for p in x["prompt"]]
            yield pd.DataFrame({"key": x["key"], "answer": answers})

    o = table(spark, sf_dir, "orders")
    head = F.element_at(F.array(*(F.lit(h) for h in ("?", "Vendor", "Contractor", "Collection", "Imprest"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    rows = o.select(F.col("o_orderkey").alias("row_pos"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("prompt"), head.alias("head"))
    x = similar.corrected(similar.model_answers(rows.withColumn("is_unknown", F.col("head") == "?"), ask))
    fields = small(spark, [("Vendor", "HO", "t", "c")], "head string, business_unit string, type string, tcp_head string")
    return similar.fields_by_head(x, fields).select("row_pos", "old_head", "head", "confidence", "reason", "business_unit")


@query("""SELECT DISTINCT 'PARTY ' || o_custkey AS name, 'Vendor' AS head1, 'AI Suggested' AS status FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 4 <> 0""")
def suggested_payees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    answer = F.struct((k % 3 == 0).alias("suggest_master"), F.concat(F.lit(" Party "), F.col("o_custkey").cast("string")).alias("beneficiary_name"), F.lit("Vendor").alias("head"))
    known = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("party "), F.col("c_custkey").cast("string")).alias("name"))
    return master.suggestions(table(spark, sf_dir, "orders").select(answer.alias("answer")), known)


@query("SELECT p_partkey AS doc_id FROM part WHERE p_name <> '' AND p_size % 5 NOT IN (0, 1)")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("p_size") % 5 == 0, "Internal").when(F.col("p_size") % 5 == 1, " ").otherwise("Vendor")
    return similar.training_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"), head.alias("head"))).select("doc_id")

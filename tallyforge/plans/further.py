"""Queries over texts that are made alike in both engines: layouts, the whole ladder, a company's block, and the functions of text, names and dates.

Texts come from templates with the order's and the customer's number in them. The SQL reads the texts as the
operators do, by patterns, and knows nothing of which template a text came from.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import amounts, names
from ..operators import geometry, ingest, lookups, rules
from ..operators import parse as parsing
from ..sources.tables import settled
from .ledger import TX, query, small, transactions
from .more import OVERRIDE_SCHEMA

INTO = "o_orderpriority IN ('1-URGENT', '2-HIGH')"


def templated(templates: list[str], index: Column, **values: Column) -> Column:
    """The template of the row's index, with {k} and {c} filled in."""
    out = F.lit(None).cast("string")
    for i, t in reversed(list(enumerate(templates))):
        pieces = [values[p[1]] if p[:1] == "{" else F.lit(p) for p in re.split(r"(\{[kc]\})", t) if p]
        out = F.when(index == i, F.concat(*pieces) if pieces else F.lit("")).otherwise(out)
    return out


def templated_sql(templates: list[str], index: str, **values: str) -> str:
    """The same in SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {i} THEN " + (" || ".join(values[p[1]] if p[:1] == "{" else quoted(p) for p in re.split(r"(\{[kc]\})", t) if p) or "''") for i, t in enumerate(templates))
    return f"CASE {index} {cases} END"


def texts(spark: SparkSession, sf_dir: str, templates: list[str]) -> DataFrame:
    t = transactions(spark, sf_dir)
    k, c = F.col("row_pos").cast("string"), F.col("account_number")
    return t.withColumn("description", templated(templates, F.pmod(F.col("row_pos") + F.col("account_number").cast("long"), F.lit(len(templates))), k=k, c=c))


def texts_sql(templates: list[str]) -> str:
    """x: row_pos, custkey, cr (money in) and d, the text."""
    d = templated_sql(templates, f"(o_orderkey + o_custkey) % {len(templates)}", k="CAST(o_orderkey AS VARCHAR)", c="CAST(o_custkey AS VARCHAR)")
    return f"x AS (SELECT o_orderkey AS row_pos, o_custkey AS custkey, {INTO} AS cr, {d} AS d FROM orders)"


# -- descriptions -------------------------------------------------------------------------------------------------

LAYOUT_TEXTS = [
    "NEFT CR-QRST0{k}-Party {c}-Own Firm-REF{k}", "RTGS CR-QRST0{k}-Party {c}-Own Firm-REF{k}", "NEFT-RETURN-R{k}-Party {c}-WRONG ACCOUNT", "IMPS-{k}-Party {c}-QRST-xxxx{c}-Loan of may", "IMPS/Party {c}/XXX {c} 77/RR N:{k}/Some Bank",
    "UPI/{k}/FROM:par ty{c}@bank/TO:q@bank/rent", "UPI-{k}-Party {c}-QRST-q{c}@bank-rent", "YIB-NEFT-Y{k}-Party {c}-WXYZ0123456-Vendor-BANK", "ABC-TPT-Party {c}-TFR {k}", "NET-TPT-Party {c}-T{k}", "NEFT/K{k}/Party {c}/Bank/NA/NAfor gas/NANA/NA",
    "INB/NEFT/K{k}/Party {c}/Bank//", "INB/{k}/TAX PAYMENT/NA", "BY CLG:Party {c}:Some Bank", "DD ISSUED/{k}/{c}/Party {c}/note", "BILLDESK-B{k}-Party {c}-power-9{c}", "K{k}-Party {c}-WILLOW HOMES-REF{k}", "UTRA0000000{k}-Party {c}-12345{c}-vendor",
    "unknown {k}", "NEFT CR-qrst-Party-x-y", "UPI-x{k}-Party-QRST-q-rent", "INB/{k}/TAX PAYMENT", "IMPS-{k}-Party {c}", "",
]
#: How the SQL tells layouts apart: by a text's parts between dashes (a), slashes (b) and colons (c), what some of them say and how many there are; then party, mode, reference, account and note.
_LAYOUT_SQL = [
    ("len(a) = 5 AND a[1] IN ('NEFT CR', 'RTGS CR') AND a[2] = upper(a[2])", "a[3]", "split_part(a[1], ' ', 1)", "a[5]", "NULL", "NULL"),
    ("a[1] = 'NEFT' AND a[2] = 'RETURN'", "a[4]", "'NEFT'", "a[3]", "NULL", "a[5]"),
    ("a[1] = 'IMPS' AND len(a) = 6", "a[3]", "'IMPS'", "a[2]", "a[5]", "a[6]"),
    ("b[1] = 'IMPS' AND len(b) = 5", "b[2]", "'IMPS'", "split_part(b[4], ':', 2)", "replace(replace(b[3], 'XXX', ''), ' ', '')", "b[5]"),
    ("b[1] = 'UPI' AND len(b) = 5", "replace(replace(split_part(b[3], '@', 1), 'FROM:', ''), ' ', '')", "'UPI'", "b[2]", "NULL", "b[5]"),
    ("a[1] = 'UPI' AND len(a) = 6 AND TRY_CAST(a[2] AS BIGINT) IS NOT NULL", "a[3]", "'UPI'", "a[2]", "a[5]", "a[6]"),
    ("a[1] = 'YIB' AND len(a) = 7", "a[4]", "'NEFT'", "a[3]", "NULL", "a[7]"),
    ("a[2] = 'TPT' AND starts_with(a[4], 'TFR ')", "a[3]", "'TPT'", "a[4][5:]", "NULL", "NULL"),
    ("a[2] = 'TPT' AND a[1] = 'NET'", "a[3]", "'TPT'", "a[4]", "NULL", "NULL"),
    ("b[1] = 'NEFT' AND len(b) = 8", "b[3]", "'NEFT'", "b[2]", "NULL", "b[6][3:]"),
    ("b[1] = 'INB' AND b[2] = 'NEFT'", "b[4]", "'NEFT'", "b[3]", "NULL", "NULL"),
    ("b[1] = 'INB' AND b[-1] = 'NA'", "NULL", "'INB'", "b[2]", "NULL", "b[3]"),
    ("c[1] = 'BY CLG'", "c[2]", "'CLG'", "NULL", "NULL", "c[3]"),
    ("b[1] = 'DD ISSUED'", "b[4]", "'DD'", "b[2] || '/' || b[3]", "NULL", "b[5]"),
    ("a[1] = 'BILLDESK'", "a[3]", "'BILLDESK'", "a[2]", "a[5]", "a[4]"),
    ("len(a) = 4 AND starts_with(a[3], 'WILLOW')", "a[2]", "NULL", "a[4]", "NULL", "NULL"),
    ("len(a) = 4 AND length(a[1]) >= 10 AND TRY_CAST(a[3] AS BIGINT) > 99999", "a[2]", "NULL", "a[1]", "a[3]", "a[4]"),
]


def _layout_column(j: int) -> str:
    return "CASE " + " ".join(f"WHEN {x[0]} THEN nullif(trim({x[j]}), '')" for x in _LAYOUT_SQL) + " END"


@query(f"WITH {texts_sql(LAYOUT_TEXTS)} SELECT row_pos, {', '.join(f'{_layout_column(j)} AS parsed_{n}' for j, n in enumerate(('party', 'payment_mode', 'reference', 'account_number', 'note'), 1))} FROM (SELECT row_pos, string_split(d, '-') AS a, string_split(d, '/') AS b, string_split(d, ':') AS c FROM x)")
def description_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layout, and texts that only look like one."""
    return parsing.with_parsed(texts(spark, sf_dir, LAYOUT_TEXTS), own_names=("WILLOW",)).select("row_pos", *(f"parsed_{f}" for f in parsing.FIELDS))


# -- the whole ladder ----------------------------------------------------------------------------------------------

LADDER_TEXTS = [
    "SPECIAL LOAN {k}", "plain money {k}", "NEFT/x/90001111001/y", "QRST0123456 WILLOW HOMES", "WILLOW HOMES RERAX {k}", "BY CLG:x:y", "UPI/{k}/FROM:a@b/TO:c@d/x", "a-imprest-{k}", "YIB-NEFT-Y{k}-DOUBLE PERSON-WXYZ0123456-vend", "YIB-NEFT-Y{k}-DOUBLE PERSON-WXYZ0123456",
    "YIB-NEFT-Y{k}-CEDAR PERSON-WXYZ0123456", "pay-salary-{k}", "x-EPF-{k}", "x-TDS-{k}", "MARKETING material {k}", "SMS CHARGES {k}", "GST TAX payment {k}", "DHBVN bill {k}", "x-Vendor-{k}", "SISTER FIRM {k}", "nothing known {k}", "a store {k}", "WILLOW HOMES {k}", "x-Cancellation-{k}", "x-Professional-{k}",
]
_LADDER_HEADS = [("Internal", 1, "both", ["Own"], ["SISTER"], [], False), ("Vendor", 2, "both", [], ["STORE"], [], False), ("Others", 99, None, [], [], [], True)]
_HEAD_SCHEMA = "head string, priority int, direction string, party_types array<string>, keywords array<string>, patterns array<string>, fallback boolean"
_LADDER_BUSINESS = rules.Business(own_names=["Willow Homes"], bank_ifsc="QRST0[A-Z0-9]{6}", always_collection=["3"], site_accounts=["2"], master_to_free=["0"], linked_codes={"RERAX": "Master 2 RERA"}, keywords={"Vendor": "vend", "Salary HO": "salary"})
_LADDER_ACCOUNTS = [("90001111000", "SW", "Master", 1), ("90001111001", "SW", "Free", 2), ("90001111002", "AR", "IDW", 3), ("90001111003", "AR", "RERA", 4)]

LADDER_SQL = f"""WITH {texts_sql(LADDER_TEXTS)},
f AS (SELECT *, custkey % 4 AS s, upper(d) AS u, replace(upper(d), ' ', '') AS b, CASE WHEN custkey % 4 < 2 THEN 'SW' ELSE 'AR' END AS unit, custkey % 4 = 1 AS free, custkey % 4 = 2 AS idw FROM x),
r AS (SELECT *, CASE
  WHEN u LIKE '%SPECIAL LOAN%' THEN 'R0' WHEN s = 3 AND cr THEN 'R0b' WHEN b LIKE '%90001111001%' AND s <> 1 THEN 'R1' WHEN regexp_matches(b, 'QRST0[A-Z0-9]{{6}}') AND b LIKE '%WILLOWHOMES%' THEN 'R2' WHEN b LIKE '%WILLOWHOMES%' THEN 'R2b'
  WHEN cr AND b LIKE '%BYCLG%' THEN 'R3' WHEN cr AND u LIKE 'UPI/%' THEN 'R4' WHEN regexp_matches(d, '(^|[-/])imprest([-/]|$)') THEN 'R5' WHEN d LIKE 'YIB-NEFT-%' AND split_part(d, '-', 4) = 'DOUBLE PERSON' THEN 'R6a' WHEN d LIKE 'YIB-NEFT-%' AND split_part(d, '-', 4) = 'CEDAR PERSON' THEN 'R6'
  WHEN regexp_matches(d, '(^|[-/])salary([-/]|$)') THEN 'R7' WHEN u LIKE '%EPF%' THEN 'R8' WHEN u LIKE '%-TDS-%' THEN 'R8b' WHEN u LIKE '%MARKETING%' THEN 'R9' WHEN u LIKE '%SMS CHA%' THEN 'R10' WHEN b LIKE '%GSTTAX%' THEN 'R10b' WHEN u LIKE '%DHBVN%' THEN 'R10c'
  WHEN regexp_matches(d, '(^|[-/])(Vendor|Professional|Cancellation)([-/]|$)') THEN 'R11' WHEN u LIKE '%SISTER%' THEN 'R12' ELSE 'R13' END AS rule FROM f),
h AS (SELECT *, CASE rule WHEN 'R0' THEN 'Loan' WHEN 'R0b' THEN 'Collection' WHEN 'R3' THEN 'Collection' WHEN 'R4' THEN 'Collection' WHEN 'R1' THEN 'Internal' WHEN 'R2' THEN 'Internal' WHEN 'R2b' THEN 'Internal' WHEN 'R12' THEN 'Internal' WHEN 'R5' THEN 'Imprest'
  WHEN 'R6a' THEN CASE WHEN u LIKE '%VEND%' THEN 'Vendor' WHEN idw THEN 'Salary Site' ELSE 'Salary HO' END WHEN 'R6' THEN 'Vendor' WHEN 'R7' THEN CASE WHEN idw THEN 'Salary Site' ELSE 'Salary HO' END WHEN 'R8' THEN 'EPF/ESI' WHEN 'R8b' THEN 'Statutory Dues' WHEN 'R9' THEN 'HO - Advert/Mkt'
  WHEN 'R10' THEN 'Bank Charges' WHEN 'R10b' THEN 'Tax' WHEN 'R10c' THEN 'Electricity' WHEN 'R11' THEN regexp_extract(d, '(Vendor|Professional|Cancellation)', 1) ELSE CASE WHEN u LIKE '%STORE%' THEN 'Vendor' ELSE '?' END END AS head FROM r),
o AS (SELECT *, rule IN ('R8', 'R8b') OR rule IN ('R5', 'R6', 'R6a', 'R7', 'R11') AND head <> 'Cancellation' AND (free OR head IN ('Salary HO', 'Professional')) AS office, rule IN ('R5', 'R6', 'R6a', 'R7', 'R11') AS own FROM h)
SELECT row_pos, head, rule AS classified_by,
  CASE WHEN office OR rule IN ('R0', 'R9') THEN 'HO' WHEN rule = 'R13' THEN '?' WHEN rule = 'R1' THEN 'SW' ELSE unit END AS business_unit,
  CASE WHEN office OR rule IN ('R9', 'R10', 'R10b') THEN 'HO - Admin' WHEN head = 'Cancellation' THEN 'Cust Cancellation' WHEN own THEN CASE WHEN idw THEN 'Dev- Apt' ELSE '?' END
    ELSE CASE rule WHEN 'R0' THEN 'Loan type' WHEN 'R1' THEN CASE WHEN s = 0 THEN 'Master to Free' ELSE 'Internal' END WHEN 'R2' THEN CASE WHEN s = 0 THEN 'Master to Free' ELSE 'Internal' END WHEN 'R2b' THEN CASE WHEN u LIKE '%RERAX%' THEN 'Master 2 RERA' ELSE 'Internal' END WHEN 'R12' THEN 'Internal' WHEN 'R10c' THEN 'Dev- Apt' WHEN 'R13' THEN '?' ELSE 'Customer Collection' END END AS type,
  CASE WHEN office THEN 'Other- Administrative Expenses' WHEN head = 'Cancellation' THEN '?' WHEN own THEN CASE WHEN idw THEN 'IDW Civil Works' ELSE '?' END
    ELSE CASE WHEN rule = 'R0' THEN 'Loan tcp' WHEN rule IN ('R1', 'R2', 'R2b', 'R12') THEN 'Internal transfer' WHEN rule = 'R9' THEN 'Other-Selling Expenses' WHEN rule = 'R10' THEN 'Other- Others' WHEN rule = 'R10b' THEN 'Other- Admin. Exp.' WHEN rule = 'R10c' THEN 'IDW Civil Works' WHEN rule = 'R13' THEN '?' ELSE 'Credit- no effect' END END AS tcp_head,
  CASE WHEN rule IN ('R0', 'R0b', 'R1', 'R2', 'R2b', 'R3', 'R4', 'R6') THEN 'High' WHEN rule = 'R6a' AND u LIKE '%VEND%' THEN 'Medium' ELSE 'Low' END AS confidence, rule IN ('R6', 'R6a') AS dual_head,
  CASE WHEN rule = 'R0' THEN 'green' WHEN rule IN ('R0b', 'R1', 'R2', 'R2b', 'R3', 'R4') THEN 'red' ELSE 'navy' END AS review_flag FROM o"""


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir, LADDER_TEXTS).withColumn("account_number", F.concat(F.lit("9000111100"), (F.col("account_number").cast("long") % 4).cast("string")))
    accounts = small(spark, _LADDER_ACCOUNTS, "account_number string, business_unit string, account_stage string, account_order int")
    overrides = small(spark, [(1, "", "special loan", "Loan", "HO", "Loan type", "Loan tcp", "Active")], OVERRIDE_SCHEMA)
    payees = small(spark, [("CEDAR PERSON", "Vendor", "Contractor", None, "Confirmed"), ("DOUBLE PERSON", "Vendor", None, None, "Conflict"), ("DOUBLE PERSON", "Salary HO", None, None, "Conflict")], "name string, head1 string, head2 string, head3 string, status string")
    heads = small(spark, _LADDER_HEADS, _HEAD_SCHEMA)
    parties = small(spark, [("Nobody", "Own", [], "high")], "canonical string, type string, aliases array<string>, confidence string")
    x = rules.engine_head(rows.withColumn("parsed_party", F.lit(None).cast("string")), parties, heads)
    return rules.classify(x, accounts, overrides, payees, _LADDER_BUSINESS, "engine_head", rules.internal_heads(heads, ("Own",)))


@query(LADDER_SQL)
def classify_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rung, from the rules to the final head: texts through the overrides, accounts, payees, words and the head engine."""
    x = _ladder(spark, sf_dir)
    return x.select("row_pos", rules.final_head(F.col("head"), F.col("engine_head")).alias("head"), "classified_by", "business_unit", "type", "tcp_head", "confidence", "dual_head", rules.review_flag().alias("review_flag"))


@query(f"""SELECT row_pos, old_head, head, old_business_unit, business_unit FROM (
  SELECT row_pos, CASE WHEN row_pos % 3 = 0 THEN '?' WHEN row_pos % 3 = 1 THEN head ELSE 'DPL' END AS old_head, head, CASE WHEN row_pos % 5 = 0 THEN 'Elsewhere' ELSE business_unit END AS old_business_unit, business_unit, own, type, tcp_head
  FROM ({LADDER_SQL}) JOIN (SELECT o_orderkey AS row_pos, CASE WHEN o_custkey % 4 < 2 THEN 'SW' ELSE 'AR' END AS own FROM orders) USING (row_pos))
WHERE (old_head IN ('?', 'DPL') OR old_business_unit = '?' OR type = '?' OR tcp_head = '?' OR old_business_unit NOT IN ('?', 'HO', own)) AND (old_head <> head OR old_business_unit <> business_unit)""")
def resolved_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with unknown heads, a head asked for again and wrong units: what the rules would change today."""
    x = _ladder(spark, sf_dir)
    now = x.select("row_pos", "account_number", "description", rules.final_head(F.col("head"), F.col("engine_head")).alias("head"), "business_unit", "type", "tcp_head")
    now = settled(now)  # read twice
    third = F.col("row_pos") % 3
    old = now.withColumns({"head": F.when(third == 0, "?").when(third == 1, F.col("head")).otherwise("DPL"), "business_unit": F.when(F.col("row_pos") % 5 == 0, "Elsewhere").otherwise(F.col("business_unit"))})
    accounts = small(spark, _LADDER_ACCOUNTS, "account_number string, business_unit string, account_stage string, account_order int").select("account_number", "business_unit")
    return rules.resolved_again(old, accounts, now, ["row_pos"], ("DPL",)).select("row_pos", "old_head", "head", "old_business_unit", "business_unit")


# -- a company's own block ------------------------------------------------------------------------------------------

BLOCK_TEXTS = [
    "PIER TOLL {k}", "berth fee {k}", "renewal of ANCHOR {k}", "anchor only {k}", "NORTH.Q U.AY {k}", "from 90001111000 {k}", "into 90001111002 {k}", "K{k}-ROPE MAKERS-770077123-coil", "K{k}-TUG CREW-770077123-shift",
    "note-WILLOW HOMES-ledger", "WILLOW HOMES {k}", "x-salary-{k}", "x-imprest-{k}", "buoys {k}",
]
_BLOCK_COLUMNS = ("account_stage", "direction", "needs", "keywords", "all_words", "bare_words", "other_stages", "payee_heads", "parties", "last_segment", "head", "business_unit", "type", "tcp_head", "confidence")


def _rule(stage: str, head: str | None, kind: str, unit: str = "{unit}", confidence: str = "High", **conditions) -> tuple:
    given = {"account_stage": stage, "head": head, "business_unit": unit, "type": kind, "tcp_head": f"tcp of {kind}", "confidence": confidence, **conditions}
    return tuple(given.get(c) for c in _BLOCK_COLUMNS)


#: A harbour company's rules, invented so that each condition and each filled-in output decides some rows.
BLOCK_RULES = [
    _rule("Free", "Anchors", "Moorings", all_words=["ANCHOR", "RENEWAL"]),
    _rule("Free", "Internal", "{pair}", needs="counterparty"),
    _rule("Free", "Crew", "Staff", parties=["TUG CREW"]),
    _rule("Free", "{payee}", "Stores", needs="payee"),
    _rule("Free", "Petty", "Petty cash", "Quay office", "Medium", needs="imprest"),
    _rule("Master", "Tolls", "Dues", keywords=["PIER TOLL", "BERTH FEE"]),
    _rule("Master", "Wages", "Staff", direction="debit", needs="salary"),
    _rule("IDW", "Quay", "Works", bare_words=["NORTHQUAY"]),
    _rule("IDW", "Internal", "{pair}", other_stages=["Master"]),
    _rule("IDW", "{payee}", "Ropes", direction="credit", payee_heads=["Cordage"]),
    _rule("IDW", None, "Dredging", confidence="Low", direction="debit"),
    _rule("RERA", "Book entry", "Ledger", needs="own", last_segment="LEDGER"),
    _rule("RERA", "Internal", "Homes", needs="own"),
    _rule("RERA", "Receipts", "Dues", direction="credit"),
]
_BLOCK_PAYEES = {"ROPE MAKERS": "Cordage", "TUG CREW": "Crew"}
BLOCK_SQL = f"""b AS (
  SELECT *, ['Master', 'Free', 'IDW', 'RERA'][CAST(custkey % 4 AS INT) + 1] AS stage, upper(d) AS u, CASE WHEN d LIKE '% 90001111000 %' THEN 'Master' WHEN d LIKE '% 90001111002 %' THEN 'IDW' END AS named, split_part(d, '-', 2) AS who FROM x),
p AS (SELECT *, CASE WHEN named <> stage THEN named END AS other, CASE who WHEN 'ROPE MAKERS' THEN 'Cordage' WHEN 'TUG CREW' THEN 'Crew' END AS ph FROM b),
g AS (SELECT *, CASE stage
  WHEN 'Free' THEN CASE WHEN starts_with(d, 'renewal') THEN 1 WHEN other IS NOT NULL THEN 2 WHEN who = 'TUG CREW' THEN 3 WHEN ph IS NOT NULL THEN 4 WHEN who = 'imprest' THEN 5 END
  WHEN 'Master' THEN CASE WHEN starts_with(u, 'PIER TOLL') OR starts_with(u, 'BERTH FEE') THEN 6 WHEN who = 'salary' AND NOT cr THEN 7 END
  WHEN 'IDW' THEN CASE WHEN starts_with(d, 'NORTH.Q') THEN 8 WHEN other = 'Master' THEN 9 WHEN ph = 'Cordage' AND cr THEN 10 WHEN NOT cr THEN 11 END
  ELSE CASE WHEN d LIKE '%WILLOW HOMES%' THEN CASE WHEN starts_with(d, 'note-') THEN 12 ELSE 13 END WHEN cr THEN 14 END END AS n FROM p),
v AS (SELECT row_pos, n AS rule, CASE n WHEN 1 THEN 'Anchors' WHEN 2 THEN 'Internal' WHEN 3 THEN 'Crew' WHEN 4 THEN ph WHEN 5 THEN 'Petty' WHEN 6 THEN 'Tolls' WHEN 7 THEN 'Wages' WHEN 8 THEN 'Quay' WHEN 9 THEN 'Internal' WHEN 10 THEN ph WHEN 12 THEN 'Book entry' WHEN 13 THEN 'Internal' WHEN 14 THEN 'Receipts' END AS head,
  CASE WHEN n = 5 THEN 'Quay office' WHEN n IS NOT NULL THEN 'SW' END AS unit,
  CASE n WHEN 1 THEN 'Moorings' WHEN 2 THEN CASE other WHEN 'Master' THEN 'Master to Free' ELSE 'Free & IDW Loan' END WHEN 3 THEN 'Staff' WHEN 4 THEN 'Stores' WHEN 5 THEN 'Petty cash' WHEN 6 THEN 'Dues' WHEN 7 THEN 'Staff' WHEN 8 THEN 'Works' WHEN 9 THEN 'Internal' WHEN 10 THEN 'Ropes' WHEN 11 THEN 'Dredging' WHEN 12 THEN 'Ledger' WHEN 13 THEN 'Homes' WHEN 14 THEN 'Dues' END AS type,
  CASE n WHEN 5 THEN 'Medium' WHEN 11 THEN 'Low' ELSE CASE WHEN n IS NOT NULL THEN 'High' END END AS confidence FROM g)"""


def _block_rows(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows with the stage of their account, its counterparty, the payee's head and the flags that the block asks for."""
    stage = F.element_at(F.array(*(F.lit(s) for _, _, s, _ in _LADDER_ACCOUNTS)), (F.col("account_number").cast("long") % 4 + 1).cast("int"))
    rows = rows.withColumn("account_stage", stage).withColumn("account_number", F.concat(F.lit("9000111100"), (F.col("account_number").cast("long") % 4).cast("string")))
    accounts = small(spark, _LADDER_ACCOUNTS, "account_number string, business_unit string, account_stage string, account_order int")
    payees = small(spark, list(_BLOCK_PAYEES.items()), "payee string, payee_head string")
    x = lookups.counterparty(rows.withColumn("payee", names.dashed_payee_name(F.col("description"))), accounts).join(payees, "payee", "left")
    flags = {"own_company": rules.names_own_company(F.col("description"), ["Willow Homes"]), "salary": names.mentions_segment(F.col("description"), "salary"), "imprest": names.mentions_segment(F.col("description"), "imprest"), "own_unit": F.lit("SW")}
    return x.withColumns(flags)


def _block(spark: SparkSession) -> DataFrame:
    schema = ", ".join(f"{c} {'array<string>' if c in ('keywords', 'all_words', 'bare_words', 'other_stages', 'payee_heads', 'parties') else 'string'}" for c in _BLOCK_COLUMNS)
    return small(spark, [(i, *r) for i, r in enumerate(BLOCK_RULES, 1)], f"rule_order int, {schema}")


@query(f"WITH {texts_sql(BLOCK_TEXTS)}, {BLOCK_SQL} SELECT * FROM v")
def company_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's rules by account stage, all names invented; null where the block lets a row fall through."""
    x = rules.stage_rules(_block_rows(spark, texts(spark, sf_dir, BLOCK_TEXTS)), _block(spark))
    return x.select("row_pos", F.col("s_rule").cast("long").alias("rule"), F.col("s_head").alias("head"), F.col("s_unit").alias("unit"), F.col("s_type").alias("type"), F.col("s_confidence").alias("confidence"))


# -- statements ------------------------------------------------------------------------------------------------------


def crowded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid out as crowded pages: headers of one line or two, row numbers before dates, descriptions that wrap above and below, words without digits among references,
    texts among amounts, opening balances, contact lines, and what stands after a closing balance or far below it."""
    w = Window.partitionBy("account_number").orderBy("txn_date", "row_pos")
    t = transactions(spark, sf_dir).withColumn("n", F.row_number().over(w) - 1).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("account_number")))
    t = t.withColumn("page", (F.col("n") / 8).cast("int")).withColumn("y", 130.0 + (F.col("n") % 8) * 45.0)
    cell = lambda s, x0, x1, y: F.struct(s.cast("string").alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), y.cast("double").alias("top"))
    y, k = F.col("y"), F.col("row_pos")
    last = (F.col("n") % 8 == 7) | (F.col("n") == F.col("of") - 1)
    body = F.array(
        cell(F.concat(F.lit("UP"), k), 120.0, 180.0, y - 9), cell(F.col("n") + 1, 2.0, 8.0, y), cell(F.date_format("txn_date", "dd-MM-yyyy"), 10.0, 50.0, y), cell(F.concat(F.lit("PAY"), k), 120.0, 180.0, y + 1), cell(F.concat(F.lit("REF"), k), 260.0, 300.0, y),
        cell(F.when(k % 2 == 0, "XY"), 302.0, 310.0, y), cell(F.when(F.col("debits") > 0, amounts.formatted(F.col("debits"))), 350.0, 400.0, y), cell(F.when(F.col("credits") > 0, amounts.formatted(F.col("credits"))), 430.0, 480.0, y),
        cell(F.lit("Cr"), 482.0, 490.0, y), cell(amounts.formatted(F.col("reported_balance")), 510.0, 560.0, y), cell(F.col("description"), 120.0, 190.0, y + 10), cell(F.when(F.col("n") % 3 == 0, "Opening Balance 5.00"), 120.0, 190.0, y + 17), cell(F.when(F.col("n") % 3 == 1, "tel: 1 | mail: 2"), 120.0, 190.0, y + 20),
        cell(F.when(last & (k % 2 == 0), "Closing Balance 7.00"), 120.0, 190.0, y + 30), cell(F.when(last & (k % 2 == 0), "left over"), 120.0, 190.0, y + 40), cell(F.when(last & (k % 2 == 1), "far below"), 120.0, 190.0, y + 95),
    )
    head = [("Transaction", 10.0, 60.0), ("Date", 62.0, 80.0), ("Description", 120.0, 180.0), ("Reference", 260.0, 300.0), ("Withdrawals", 350.0, 400.0), ("Deposits", 430.0, 480.0), ("Balance", 510.0, 560.0)]
    split = F.col("account_number").cast("long") % 2 == 0
    titles = F.array(*(cell(F.lit(s), a, b, F.when(split & F.lit(s in ("Transaction", "Withdrawals", "Deposits")), 68.0).otherwise(78.0)) for s, a, b in head))
    cells = F.when(F.col("n") == 0, F.concat(titles, body)).otherwise(body)
    out = t.select(F.col("account_number").alias("doc_id"), "page", "n", F.posexplode(cells).alias("word_no", "c")).filter("c.text is not null")
    return out.select("doc_id", "page", (F.col("n") * 40 + F.col("word_no")).cast("int").alias("word_no"), "c.text", F.col("c.x0").alias("x0"), F.col("c.x1").alias("x1"), F.col("c.top").alias("top"), (F.col("c.top") + 8.0).alias("bottom"))


@query(f"""WITH {TX} SELECT account_number AS source, row_number() OVER (PARTITION BY account_number ORDER BY txn_date, row_pos) - 1 AS row_pos, CAST(txn_date AS VARCHAR) AS txn_date, 'UP' || row_pos || ' PAY' || row_pos || CASE WHEN row_pos % 2 = 0 THEN ' XY' ELSE ' ' END || description AS description, 'REF' || row_pos AS reference,
  CAST(credits AS DOUBLE) AS credits, CAST(debits AS DOUBLE) AS debits, CAST(reported_balance AS DOUBLE) AS balance FROM tx""")
def crowded_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from crowded pages to the orders that they were laid out from."""
    n = ingest.normalized(geometry.statement_rows(crowded_words(spark, sf_dir)))
    return n.select("source", "row_pos", F.col("txn_date").cast("string").alias("txn_date"), "description", "reference", F.col("credits").cast("double").alias("credits"), F.col("debits").cast("double").alias("debits"), F.col("reported_balance").cast("double").alias("balance"))

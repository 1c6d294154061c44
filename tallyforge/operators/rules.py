"""Classification: ordered rules over flags, lookups joined beforehand, first match decides.

Business values (heads of one company, people, account numbers) are tables that
the caller gives; vocabularies that every bank shares are the fixed values
below. The ladder is one CASE over columns, built in stages so that the
generated code stays small.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import direction, direction_allows
from ..functions.names import dashed_payee_name, mentions_segment, payee_name, role_in
from ..functions.text import no_spaces
from . import lookups
from .narrate import explained, narration, reason
from .words import first_word

UNKNOWN = "?"
FIELDS = ("head", "business_unit", "type", "tcp_head", "confidence", "classified_by")

# Words by which banks' texts are known.
INCOMING = ["UPI/", "NEFT CR-", "IMPS/", "RTGS CR-", "NET-TPT-", "NET-"]
CHEQUES = ["CHQDEP", "CHEQDEP", "BYCLG"]
PF_ESI = ["PROVIDENT FUND", "EPF", "ESIC", " PF-", "-PF-", "/PF", "E.S.I", " ESI-", "-ESI-", "/ESI"]
PF_ESI_WORDS = ["PF", "ESI"]
TAX_AT_SOURCE = [" TDS-", "-TDS-", "/TDS", "TAX DEDUCTED", "PTAX", "PROFESSIONAL TAX"]
TAX_AT_SOURCE_WORDS = ["TDS"]
BANK_CHARGES = ["SBOX", "SAFE BOX", "LOCKER", "POS GST", "BANK CHARGE", "SERVICE CHARGE", "ANNUAL FEE", "PROCESSING FEE", "CHGS", "CHRGS", "SCREF", "AMB CHARGES", "LF CHG", "SMS CHA"]
TAX = ["GSTTAX", "GST TAX", "GST POOL ACCOUNT", "TINTAX", "TIN TAX", "CENTRAL GOVT TAX", "CENTRAL GOVERNMENT TAX"]
ELECTRICITY = ["DHBVN", "UHBVN", "ELECTRICITY BILL"]
MARKETING = ["MARKETING", "ADVERTISMENT", "ADVERTISEMENT", "ADVERTISING", "-MKT-", "/MKT", "PUBLICITY", "BRANDING", "HOARDING"]
STAGE_DEFAULTS = {"IDW": ("Dev- Apt", "IDW Civil Works"), "AH-IDW": ("Dev- Apt", "IDW Civil Works")}
OFFICE = ("HO", "HO - Admin", "Other- Administrative Expenses")
COLLECTION = ("Collection", "Customer Collection", "Credit- no effect")
SKIP_HEADS = ["Internal", "Collection", "Cancellation", "?", "", "HO-Admin"]
MIN_STRIPPED = 5


def contains_any(text: Column, words: Iterable[str], least: int = MIN_STRIPPED) -> Column:
    """Any word within the upper-cased text; words of at least so many characters also with all spaces taken out."""
    return holds_any(F.upper(text), no_spaces(F.upper(text)), words, least)


def holds_any(up: Column, bare: Column, words: Iterable[str], least: int = MIN_STRIPPED) -> Column:
    """contains_any of a text that is given in upper case, and so without spaces: what holds a word holds it without its spaces too."""
    hit = F.lit(False)
    for w in words:
        stripped = w.replace(" ", "")
        hit = hit | (bare.contains(stripped) if len(stripped) >= least else up.contains(w))
    return hit


def bounded_any(text: Column, words: list[str]) -> Column:
    """Any word with no letter on either side."""
    return holds_bounded(F.upper(text), words)


def holds_bounded(up: Column, words: list[str]) -> Column:
    # A pattern looks at each letter; most texts hold none of the words.
    return reduce(lambda hit, w: hit | up.contains(w), words, F.lit(False)) & up.rlike("|".join(f"(?<![A-Z]){w}(?![A-Z])" for w in words))


def starts_any(text: Column, prefixes: Iterable[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.upper(text).startswith(p)
    return hit


def names_own_company(text: Column, names: list[str], spaces: bool = False) -> Column:
    up, hit = F.upper(text) if spaces else no_spaces(F.upper(text)), F.lit(False)
    for n in names:
        hit = hit | up.contains(n.upper() if spaces else n.upper().replace(" ", ""))
    return hit


@dataclass
class Business:
    """What one business tells the rules about itself."""

    own_names: list[str] = field(default_factory=list)
    bank_ifsc: str = ""  # a pattern of the IFSC codes of the bank that holds the own accounts
    bank_names: list[str] = field(default_factory=list)
    always_collection: list[str] = field(default_factory=list)  # account suffixes
    site_accounts: list[str] = field(default_factory=list)  # suffixes whose salaries are of the site
    master_to_free: list[str] = field(default_factory=list)
    linked_codes: dict[str, str] = field(default_factory=dict)  # code in the text -> type of the transfer
    professionals: list[str] = field(default_factory=list)
    contractors: list[str] = field(default_factory=list)
    keywords: dict[str, str] = field(default_factory=dict)  # head -> the word that tells it from others of one payee


def ends_any(c: Column, suffixes: list[str]) -> Column:
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | c.endswith(s)
    return hit


def _fields(head, unit, kind, tcp, confidence, by: str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(*(as_column(v).alias(f) for f, v in zip(FIELDS, (head, unit, kind, tcp, confidence, by), strict=True)))


def with_payees(rows: DataFrame, payees: DataFrame) -> DataFrame:
    """Adds payee and what the payee table says of it: the confirmed head, its further heads, and the heads in conflict. Payees are looked up by name, an equality."""
    one = payees.groupBy(F.upper(F.trim("name")).alias("payee")).agg(
        F.min(F.when(F.col("status") == "Confirmed", F.col("head1"))).alias("payee_head"),
        F.array_compact(F.flatten(F.collect_set(F.when(F.col("status") == "Confirmed", F.array("head2", "head3"))))).alias("payee_more"),
        F.min(F.when(F.col("status") == "Conflict", F.col("head1"))).alias("conflict_head1"),
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set(F.when(F.col("status") == "Conflict", F.array("head1", "head2", "head3"))))))).alias("conflict_heads"),
    )
    return rows.withColumn("payee", payee_name(F.col("description"))).join(lookups.beside(one), "payee", "left")


def default_fields(head: Column, unit: Column, stage: Column, kind: Column, tcp: Column) -> tuple[Column, Column, Column]:
    """(unit, type, tcp) by head and stage: office heads and Free accounts take the office's, others the account's own and its stage's."""
    office = head.isin("Salary HO", "Professional") | (stage == "Free") | (stage.isNull() & (head != "Salary Site"))
    return tuple(F.when(office, F.lit(o)).otherwise(c) for o, c in zip(OFFICE, (unit, kind, tcp), strict=True))


def classify(rows: DataFrame, accounts: DataFrame, overrides: DataFrame, payees: DataFrame, business: Business | None = None, engine: str | None = None, internal_heads: list[str] | None = None, stage_table: DataFrame | None = None) -> DataFrame:
    """Adds head, business_unit, type, tcp_head, confidence, classified_by, dual_head, manual_override and payee to ledger rows.

    rows: account_number, row_pos, description, credits, debits. engine: the column of
    rows with the head engine's answer, which decides where it is one of internal_heads and no other rule
    does. stage_table: a company's own block of rules by account stage, tried after the overrides.
    Heads that no rule decides are null; the other fields are then "?". Rows that repeat a key, or have none, are judged each on its own.
    """
    b = business or Business()
    own = accounts.select("account_number", F.col("business_unit").alias("own_unit"), F.col("account_stage").alias("own_stage"))
    outputs = {"head": "o_head", "business_unit": "o_unit", "type": "o_type", "tcp_head": "o_tcp"}
    base = rows.drop("head", "business_unit", "type", "tcp_head", "confidence", "classified_by", "dual_head", "manual_override", "payee")
    # Among many accounts the rows are dealt out by the join with their counterparties.
    base = lookups.spread(base) if lookups.are_few(accounts) and not engine else base
    x = lookups.counterparty(base.withColumn("description", F.coalesce("description", F.lit(""))), accounts)
    x = x.join(lookups.beside(own), "account_number", "left")
    x = lookups.first_override(x, lookups.active_overrides(overrides), outputs)
    x = with_payees(x, payees)
    if stage_table is None:
        x = x.withColumns({c: F.lit(None).cast("string") for c in ("s_head", "s_unit", "s_type", "s_tcp", "s_confidence", "s_rule")})
    else:
        # The block reads payees from texts of its own layout, and knows those on file by the same table.
        on_file = payees.filter("status = 'Confirmed'").groupBy(F.upper(F.trim("name")).alias("_block_payee")).agg(F.min("head1").alias("_block_head"))
        flags = {"account_stage": F.col("own_stage"), "own_company": names_own_company(F.col("description"), b.own_names), "salary": mentions_segment(F.col("description"), "salary"), "imprest": mentions_segment(F.col("description"), "imprest")}
        x = x.withColumnsRenamed({"payee": "_payee", "payee_head": "_payee_head"}).withColumn("_block_payee", dashed_payee_name(F.col("description"))).join(lookups.beside(on_file), "_block_payee", "left")
        x = stage_rules(x.withColumnsRenamed({"_block_payee": "payee", "_block_head": "payee_head"}).withColumns(flags), stage_table).drop(*flags, "payee", "payee_head").withColumnsRenamed({"_payee": "payee", "_payee_head": "payee_head"})

    x = x.withColumn("_up", F.upper("description")).withColumn("_bare", no_spaces(F.col("_up")))
    d, up, bare = F.col("description"), F.col("_up"), F.col("_bare")
    credit = F.col("credits") > 0
    # Flags first, the ladder over them afterwards.
    x = x.withColumns({
        "_unit": F.coalesce("own_unit", F.lit(UNKNOWN)),
        "_kind": F.coalesce(*(F.when(F.col("own_stage") == s, F.lit(v[0])) for s, v in STAGE_DEFAULTS.items()), F.lit(UNKNOWN)),
        "_tcp": F.coalesce(*(F.when(F.col("own_stage") == s, F.lit(v[1])) for s, v in STAGE_DEFAULTS.items()), F.lit(UNKNOWN)),
        "_credit": credit,
        "_own": holds_any(up, bare, map(str.upper, b.own_names), 0),
        "_bank": (bare.rlike(b.bank_ifsc) if b.bank_ifsc else F.lit(False)) | holds_any(up, bare, map(str.upper, b.bank_names), 0),
        "_cheque": holds_any(bare, bare, CHEQUES),
        "_incoming": reduce(lambda hit, p: hit | up.startswith(p), INCOMING, F.lit(False)),
        "_imprest": mentions_segment(d, "imprest"),
        "_salary": mentions_segment(d, "salary"),
        "_role": role_in(d, b.professionals, b.contractors),
        "_site": ends_any(F.col("account_number"), b.site_accounts),
    }).withColumns({
        "_pf": holds_any(up, bare, PF_ESI) | holds_bounded(up, PF_ESI_WORDS),
        "_tds": holds_any(up, bare, TAX_AT_SOURCE) | holds_bounded(up, TAX_AT_SOURCE_WORDS),
        "_marketing": holds_any(up, bare, MARKETING),
        "_charge": (F.trim(up) == "GST") | holds_any(up, bare, BANK_CHARGES),
        "_tax": holds_any(up, bare, TAX),
        "_power": holds_any(up, bare, ELECTRICITY),
        "_always": ends_any(F.col("account_number"), b.always_collection),
        "_to_free": ends_any(F.col("account_number"), b.master_to_free),
        "_matched": F.filter(F.coalesce("conflict_heads", F.array().cast("array<string>")), lambda h: F.coalesce(*(F.when(h == k, up.contains(w.upper())) for k, w in b.keywords.items()), F.lit(False))),
    })

    unit, stage, kind, tcp = F.col("_unit"), F.col("own_stage"), F.col("_kind"), F.col("_tcp")
    office = lambda head, by, how="Low": _fields(head, *OFFICE, how, by)
    on_site = lambda head: F.when(F.col("_site") & (head == "Salary HO"), F.lit("Salary Site")).otherwise(head)
    known = on_site(F.col("payee_head"))
    one = on_site(F.when(F.size("_matched") == 1, F.element_at("_matched", 1)).when(F.size("_matched") == 0, F.col("conflict_head1")))
    conflict = F.when(one.isNull(), _fields(UNKNOWN, UNKNOWN, UNKNOWN, UNKNOWN, "Low", "R6a")).otherwise(
        F.struct(one.alias("head"), *(c.alias(f) for f, c in zip(FIELDS[1:4], default_fields(one, unit, stage, kind, tcp), strict=True)), F.when(F.size("_matched") == 1, "Medium").otherwise("Low").alias("confidence"), F.lit("R6a").alias("classified_by"))
    )
    role = F.col("_role")
    by_role = F.when(role == "Cancellation", _fields("Cancellation", unit, "Cust Cancellation", UNKNOWN, "Low", "R11")).when(
        (role == "Professional") | (stage == "Free"), office(role, "R11")
    ).otherwise(_fields(role, unit, kind, tcp, "Low", "R11"))
    salary = F.when(F.col("_site"), _fields("Salary Site", unit, kind, tcp, "Low", "R7")).otherwise(office("Salary HO", "R7"))
    label = F.when((F.col("other_unit") == F.col("own_unit")) & F.col("own_stage").isNotNull() & F.col("other_stage").isNotNull(), F.coalesce(lookups.pair_label(F.col("own_stage"), F.col("other_stage")), F.lit("Internal"))).otherwise(F.lit("Internal"))
    other_unit = F.when(F.col("other_unit").isNotNull() & (F.col("other_unit") != unit), F.col("other_unit")).otherwise(unit)
    linked = F.coalesce(*(F.when(up.contains(k.upper()), F.lit(v)) for k, v in b.linked_codes.items()), F.lit("Internal"))
    collection = lambda by: _fields(COLLECTION[0], unit, COLLECTION[1], COLLECTION[2], "High", by)

    ladder = [
        (F.col("o_head").isNotNull(), _fields(F.col("o_head"), F.col("o_unit"), F.col("o_type"), F.col("o_tcp"), "High", "R0")),
        (F.col("s_rule").isNotNull(), _fields(F.col("s_head"), F.coalesce("s_unit", F.lit(UNKNOWN)), F.coalesce("s_type", F.lit(UNKNOWN)), F.coalesce("s_tcp", F.lit("")), F.coalesce("s_confidence", F.lit("Low")), "RA")),
        (F.col("_always") & credit, collection("R0b")),
        (F.col("other_account").isNotNull(), _fields("Internal", other_unit, label, "Internal transfer", "High", "R1")),
        (F.col("_bank") & F.col("_own"), _fields("Internal", unit, F.when(F.col("_to_free"), F.lit("Master to Free")).otherwise(F.lit("Internal")), "Internal transfer", "High", "R2")),
        (F.col("_own"), _fields("Internal", unit, linked, "Internal transfer", "High", "R2b")),
        (credit & F.col("_cheque"), collection("R3")),
        (credit & F.col("_incoming"), collection("R4")),
        (F.col("_imprest"), F.when(stage == "Free", office("Imprest", "R5")).otherwise(_fields("Imprest", unit, kind, tcp, "Low", "R5"))),
        (F.size(F.coalesce("conflict_heads", F.array().cast("array<string>"))) > 0, conflict),
        (F.col("payee_head").isNotNull(), F.struct(known.alias("head"), *(c.alias(f) for f, c in zip(FIELDS[1:4], default_fields(known, unit, stage, kind, tcp), strict=True)), F.lit("High").alias("confidence"), F.lit("R6").alias("classified_by"))),
        (F.col("_salary"), salary),
        (F.col("_pf"), office("EPF/ESI", "R8")),
        (F.col("_tds"), office("Statutory Dues", "R8b")),
        (F.col("_marketing"), _fields("HO - Advert/Mkt", "HO", "HO - Admin", "Other-Selling Expenses", "Low", "R9")),
        (F.col("_charge"), _fields("Bank Charges", unit, "HO - Admin", "Other- Others", "Low", "R10")),
        (F.col("_tax"), _fields("Tax", unit, "HO - Admin", "Other- Admin. Exp.", "Low", "R10b")),
        (F.col("_power"), _fields("Electricity", unit, "Dev- Apt", "IDW Civil Works", "Low", "R10c")),
        (role.isNotNull(), by_role),
        (F.col(engine).isin(internal_heads or []) if engine else F.lit(False), _fields(F.col(engine) if engine else None, unit, "Internal", "Internal transfer", "Low", "R12")),
    ]
    # One CASE of many branches: one within the other would be a single method too large to be compiled.
    (condition, value), *others = ladder
    decided = F.when(condition, value)
    for condition, value in others:
        decided = decided.when(condition, value)
    x = x.withColumn("_r", decided.otherwise(_fields(None, UNKNOWN, UNKNOWN, UNKNOWN, "Low", "R13")))
    dual = F.when(F.col("_r.classified_by") == "R6a", F.lit(True)).when(F.col("_r.classified_by") == "R6", F.size(F.coalesce("payee_more", F.array().cast("array<string>"))) > 0).when(F.col("_r.classified_by") == "R5", F.size(F.coalesce("conflict_heads", F.array().cast("array<string>"))) > 0).otherwise(F.lit(False))
    return x.select(*base.columns, *(F.col(f"_r.{f}").alias(f) for f in FIELDS), dual.alias("dual_head"), (F.col("_r.classified_by") == "R0").alias("manual_override"), "payee")


# -- the head engine --------------------------------------------------------------------------------------------


def party_heads(rows: DataFrame, party: str, parties: DataFrame, head_rules: DataFrame) -> DataFrame:
    """Adds party_heads: heads that carry the type of the row's party, by name or alias; only parties of high confidence and a known type count."""
    names = parties.filter((F.col("confidence") == "high") & (F.col("type") != "Unknown")).select(F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_n"), "type")
    heads = head_rules.filter(~F.coalesce("fallback", F.lit(False))).select(F.explode("party_types").alias("type"), "head", "priority")
    by_name = names.select(F.upper(F.trim("_n")).alias("_n"), "type").join(heads, "type").groupBy("_n").agg(F.array_sort(F.collect_set(F.struct("priority", "head"))).alias("_h")).select("_n", F.col("_h.head").alias("party_heads"))
    by_name = lookups.beside(by_name)
    return rows.join(by_name, F.upper(F.trim(rows[party])) == by_name["_n"], "left").drop("_n")


def head_by_words(rows: DataFrame, head_rules: DataFrame, regular: bool) -> DataFrame:
    """Adds word_head or pattern_head: the first head by priority, then by the word's place, whose word or pattern is in the text and whose direction fits."""
    column, name = ("patterns", "pattern_head") if regular else ("keywords", "word_head")
    words = head_rules.filter(~F.coalesce("fallback", F.lit(False))).select("head", F.coalesce("priority", F.lit(999)).alias("priority"), "direction", F.posexplode(column).alias("place", "word"))
    text = F.coalesce("description", F.lit(""))
    way = direction(F.col("credits"), F.col("debits"))
    if not regular:
        shown = words.withColumns({"word": F.upper("word"), "way": F.nullif("direction", F.lit("both"))})
        bare = no_spaces(F.col("word"))
        return first_word(rows, F.upper(text), shown, "word", ["priority", "place", "head"], {"head": name}, bare=F.when(F.length(bare) >= MIN_STRIPPED, bare), way=F.nullif(way, F.lit("unknown")), ways="way")

    def holds(x: Column, r: Column) -> Column:
        return F.regexp_like(x["text"], r["word"]) & direction_allows(r["direction"], x["way"])

    return lookups.first_match(rows, words, holds, {"text": text, "way": way}, ["priority", "place", "head"], {"head": name})


def internal_heads(head_rules: DataFrame, types: tuple[str, ...]) -> list[str]:
    """Heads that carry one of the types of the own companies: a list that people keep, so it may come to the driver."""
    return sorted(r["head"] for r in head_rules.filter(F.arrays_overlap("party_types", F.array(*(F.lit(t) for t in types)))).select("head").distinct().limit(lookups.MAX_DIMENSION_ROWS).collect())


def engine_head(rows: DataFrame, parties: DataFrame, head_rules: DataFrame, party: str = "parsed_party", pool: int = 2) -> DataFrame:
    """Adds engine_head: the party's only head (whatever the direction); else words; else patterns; else, of a pool of at most two, the first that fits the direction; else the fallback."""
    x = party_heads(lookups.spread(rows), party, parties, head_rules)
    x = head_by_words(head_by_words(x, head_rules, False), head_rules, True)
    way = head_rules.filter(F.col("direction").isNotNull() & (F.col("direction") != "both")).agg(F.map_from_entries(F.collect_list(F.struct("head", "direction"))))
    x = x.withColumns({"_fallback": head_rules.filter("fallback").agg(F.min("head")).scalar(), "_way": way.scalar()})
    found = direction(F.col("credits"), F.col("debits"))
    fit = F.filter("party_heads", lambda h: direction_allows(F.try_element_at("_way", h), found))
    pooled = F.when(F.size("party_heads") <= pool, F.coalesce(F.try_element_at(fit, F.lit(1)), F.try_element_at("party_heads", F.lit(1))))
    head = F.when(F.coalesce(F.trim("description"), F.lit("")) == "", F.col("_fallback")).otherwise(
        F.coalesce(F.when(F.size("party_heads") == 1, F.element_at("party_heads", 1)), F.col("word_head"), F.col("pattern_head"), pooled, F.col("_fallback"))
    )
    return x.withColumn("engine_head", head).drop("_fallback", "_way")


# -- rules by stage, as a table -----------------------------------------------------------------------------------

STAGE_RULES = "rule_order int, account_stage string, direction string, needs string, keywords array<string>, head string, business_unit string, type string, tcp_head string, confidence string"
#: Further conditions that a table may have; those it lacks are null, that is, ask for nothing.
STAGE_CONDITIONS = {"all_words": "array<string>", "bare_words": "array<string>", "other_stages": "array<string>", "payee_heads": "array<string>", "parties": "array<string>", "last_segment": "string"}


def stage_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """A company's own block of rules by account stage: adds s_head, s_unit, s_type, s_tcp, s_confidence and s_rule; all null where the block lets a row fall through, s_rule alone where it decides the fields but not the head.

    rows bring account_stage, other_stage, payee_head and the flags own_company, salary, imprest, and payee where a rule names parties.
    A rule needs its stage, its direction (null: either), any of its keywords (null: none), all of all_words, any of
    bare_words with dots and spaces taken out of the text, the counterparty's stage or the payee's head or name among those it lists, the text's last segment, and what
    needs names: own, counterparty, payee, salary, imprest or nothing. The first rule in order decides. {payee}, {pair} and {unit} in its outputs
    stand for the payee's head, the pair's label and the account's unit.
    """
    table = rules.select("*", *(F.lit(None).cast(t).alias(c) for c, t in STAGE_CONDITIONS.items() if c not in rules.columns))
    table = table.withColumns({c: F.transform(c, lambda w: F.upper(w)) for c in ("keywords", "all_words", "bare_words", "parties")})
    up = F.upper(F.coalesce("description", F.lit("")))
    payee = F.upper("payee") if "payee" in rows.columns else F.lit(None).cast("string")
    values = {
        "stage": F.col("account_stage"), "other": F.col("other_stage"), "payee_head": F.col("payee_head"), "payee": payee, "way": direction(F.col("credits"), F.col("debits")), "up": up,
        "bare": F.translate(up, ". ", ""), "last": F.trim(F.element_at(F.split(F.trim(up), "-", -1), -1)), **{c: F.coalesce(F.col(c), F.lit(False)) for c in ("own_company", "salary", "imprest")},
    }

    def holds(x: Column, r: Column) -> Column:
        needs = r["needs"]
        needed = (
            needs.isNull() | ((needs == "own") & x["own_company"]) | ((needs == "counterparty") & x["other"].isNotNull())
            | ((needs == "payee") & x["payee_head"].isNotNull()) | ((needs == "salary") & x["salary"]) | ((needs == "imprest") & x["imprest"])
        )
        listed = lambda c, v: r[c].isNull() | F.coalesce(F.array_contains(r[c], v), F.lit(False))
        words = (r["keywords"].isNull() | F.exists(r["keywords"], lambda w: x["up"].contains(w))) & (r["all_words"].isNull() | F.forall(r["all_words"], lambda w: x["up"].contains(w))) & (r["bare_words"].isNull() | F.exists(r["bare_words"], lambda w: x["bare"].contains(w)))
        return (r["account_stage"] == x["stage"]) & direction_allows(r["direction"], x["way"]) & words & needed & listed("other_stages", x["other"]) & listed("payee_heads", x["payee_head"]) & listed("parties", x["payee"]) & (r["last_segment"].isNull() | (r["last_segment"] == x["last"]))

    outputs = {"head": "s_head", "business_unit": "s_unit", "type": "s_type", "tcp_head": "s_tcp", "confidence": "s_confidence", "rule_order": "s_rule"}
    x = lookups.first_match(rows, table, holds, values, ["rule_order"], outputs)
    pair = lookups.pair_label(F.col("account_stage"), F.col("other_stage"))
    put = lambda c: F.when(F.col(c) == "{payee}", F.col("payee_head")).when(F.col(c) == "{pair}", F.coalesce(pair, F.lit("Internal"))).when(F.col(c) == "{unit}", F.col("own_unit")).otherwise(F.col(c))
    return x.withColumns({c: put(c) for c in ("s_head", "s_unit", "s_type", "s_tcp")})


# -- after the rules -------------------------------------------------------------------------------------------------


def final_head(resolved: Column, engine: Column) -> Column:
    """The rules' head, else the engine's; Others is no answer."""
    head = F.coalesce(resolved, engine)
    return F.when(head.isNull() | (head == "Others"), F.lit(UNKNOWN)).otherwise(head)


def review_flag() -> Column:
    return F.when(F.col("manual_override"), "green").when(F.col("dual_head") | (F.col("confidence") == "Low"), "navy").otherwise("red")


def unclassified(rows: DataFrame) -> DataFrame:
    """Rows with a description in which any of the five fields is blank: a second run finds none of those already done."""
    blank = F.lit(False)
    for c in ("head", "business_unit", "type", "tcp_head", "narration"):
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    return rows.filter((F.coalesce(F.trim("description"), F.lit("")) != "") & blank)


def apply_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Retroactive rules: every matching row, classified or not, with its values before and after; is_changed tells them apart."""
    new = {c: f"new_{c}" for c in ("head", "business_unit", "type", "tcp_head")}
    x = lookups.first_override(rows, lookups.active_overrides(overrides), new).filter("new_head is not null")
    same = F.lit(True)
    for c, n in new.items():
        same = same & F.col(n).eqNullSafe(F.col(c))
    return x.withColumn("is_changed", ~same)


def unresolved(rows: DataFrame, accounts: DataFrame, again: tuple[str, ...] = ()) -> DataFrame:
    """Rows that want another pass: a description, and any field still "?", a head of those asked for again, or a unit that is neither "?", nor the office's, nor the account's own."""
    own = accounts.select("account_number", F.col("business_unit").alias("_own_unit"))
    x = rows.join(lookups.beside(own), "account_number", "left")
    wrong = F.col("_own_unit").isNotNull() & ~F.coalesce(F.col("business_unit").isin(UNKNOWN, OFFICE[0]) | (F.col("business_unit") == F.col("_own_unit")), F.lit(False))
    open_ = F.lit(False)
    for c in ("head", "business_unit", "type", "tcp_head"):
        open_ = open_ | F.coalesce(F.col(c) == UNKNOWN, F.lit(False))
    return x.filter((F.coalesce(F.trim("description"), F.lit("")) != "") & (open_ | F.col("head").isin(list(again)) | wrong)).drop("_own_unit")


def resolved_again(rows: DataFrame, accounts: DataFrame, classified: DataFrame, key: list[str], again: tuple[str, ...] = ()) -> DataFrame:
    """Unresolved rows whose fields the rules now see otherwise: their new values beside the old ones (old_<field>). classified: the rows' key and the four fields as the rules give them today."""
    fields = ("head", "business_unit", "type", "tcp_head")
    old = unresolved(rows, accounts, again).select(*key, "description", *(F.col(c).alias(f"old_{c}") for c in fields))
    x = old.join(classified.select(*key, *fields), key)
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return x.filter(changed)


def resolved_in_full(rows: DataFrame, accounts: DataFrame, classified: DataFrame, key: list[str], again: tuple[str, ...] = ()) -> DataFrame:
    """resolved_again with what a person reads of the rows made anew: narration, reason and confidence.

    classified also brings credits, confidence, classified_by, account_number, and party, reference and own_transfer (whether the text names an own company) where they are known.
    """
    changed = resolved_again(rows, accounts, classified, key, again)
    known = lambda c, kind: F.col(c) if c in classified.columns else F.lit(None).cast(kind)
    more = classified.select(*key, "credits", "confidence", "classified_by", "account_number", known("party", "string").alias("_party"), known("reference", "string").alias("_ref"), F.coalesce(known("own_transfer", "boolean"), F.lit(False)).alias("_own"))
    x = changed.join(more, key)
    told = narration(F.col("description"), F.col("credits"), F.col("head"), F.col("type"), F.col("business_unit"), F.col("account_number"), F.col("_party"), F.col("_ref"), F.col("_own"))
    why = reason(*(explained(name, F.col(c), F.col("classified_by")) for name, c in (("Head", "head"), ("BU", "business_unit"), ("Type", "type"), ("TCP", "tcp_head"))))
    return x.withColumns({"narration": told, "reason": why}).drop("_party", "_ref", "_own", "credits", "account_number")

"""Text functions on columns; every one of them is an expression that Catalyst sees through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each form of company name has a token of its own, longest first.
CORPORATE_FORMS = {r"\bPRIVATE LIMITED\b": "PVTLTD", r"\bPVT\.?\s*LTD\.?\b": "PVTLTD", r"\bLIMITED\b": "LTD"}
# Bank codes that begin a reference number in descriptions.
BANK_CODES = ("YESME", "YESB", "HDFC", "SBIN", "CNRB", "UBIN", "ICIC", "KKBK", "UTIB", "BARB", "PUNB", "IDIB", "FDRL", "IDFC", "MAHB")
#: How far behind its mention an account's number may begin.
NEAR_MENTION = 15


def clean(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def no_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def squeezed_upper(c: Column) -> Column:
    """Upper case without any white space: how descriptions are compared."""
    return F.regexp_replace(F.upper(c), r"\s+", "")


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def company_key(c: Column) -> Column:
    """alnum_key with one token for each form of company, so that PVT LTD and PRIVATE LIMITED are one and LTD is another."""
    c = F.upper(c)
    for pattern, put in CORPORATE_FORMS.items():
        c = F.regexp_replace(c, pattern, put)
    return alnum_key(c)


def last4(c: Column) -> Column:
    return F.right(F.trim(c), F.lit(4))


def segments(c: Column) -> Column:
    """The parts between dashes and slashes. One character needs no pattern, which a split would compile anew for each text."""
    return F.split(F.replace(c, F.lit("/"), F.lit("-")), "-", -1)


def segment(c: Column, sep: str, n: int) -> Column:
    """The n-th part from 1, or from the end if n is negative; null if there is none."""
    return F.try_element_at(F.split(c, sep, -1), F.lit(n))


def last_word(c: Column) -> Column:
    return F.try_element_at(F.split(F.trim(c), r"\s+", -1), F.lit(-1))


def first_word(c: Column) -> Column:
    return F.try_element_at(F.split(F.trim(c), r"\s+", -1), F.lit(1))


def is_digits(c: Column) -> Column:
    return c.rlike(r"^\d+$")


def is_ifsc(c: Column) -> Column:
    return c.rlike("^[A-Z]{4}0[A-Z0-9]{6}$")


def initials(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def masked_account(c: Column) -> Column:
    return F.concat(F.lit("XXXX"), F.right(c, F.lit(4)))


def account_tail(body: Column) -> Column:
    """The last four digits of the account that a mail names; null if it names none.

    A mention is the word account, or a/c. Where "no" or "number" follows one, the run of letters, digits and asterisks
    next to it is the account's number, if its last four characters are digits. Where no mention
    has a number so named, the last run that begins near the first mention that has such runs is taken.
    """
    parts = F.split(F.replace(F.lower(body), F.lit("a/c"), F.lit("account")), "account", -1)
    behind = F.slice(parts, F.lit(2), F.size(parts))
    run = "[a-z0-9*]*"

    def named(x: Column) -> Column:
        x = F.ltrim(x)
        after = F.when(x.startswith("number"), F.substr(x, F.lit(7))).when(x.startswith("no."), F.substr(x, F.lit(4))).when(x.startswith("no"), F.substr(x, F.lit(3)))
        return F.regexp_extract(after, rf"^\s*[:-]?\s*({run})", 1)

    def near(x: Column) -> Column:
        # As far as a number may begin, and on to the end of the run that goes on there.
        window = F.concat(F.left(x, F.lit(NEAR_MENTION)), F.regexp_extract(F.substr(x, F.lit(NEAR_MENTION + 1)), f"^{run}", 0))
        return F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(window, "[^a-z0-9*]+", -1), _ends_in_digits)), -1)

    first = lambda how: F.try_element_at(F.filter(F.transform(behind, how), lambda t: F.coalesce(_ends_in_digits(t), F.lit(False))), F.lit(1))
    return F.right(F.coalesce(first(named), first(near)), F.lit(4))


def _ends_in_digits(t: Column) -> Column:
    return t.rlike("[0-9]{4}$")


def safe_filename(c: Column, prefix: Column | None = None) -> Column:
    """The name without folders, other characters than letters, digits and . _ - as underscores, with .pdf at its end; prefix_ before it, such as a time and an id."""
    name = F.regexp_replace(F.regexp_extract(c, "([^/]*)$", 1), r"[^a-zA-Z0-9._\-]", "_")
    name = F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    return name if prefix is None else F.concat(prefix, F.lit("_"), name)


def table_id(url: Column) -> Column:
    """The id in a table's URL, or the text itself where it is no URL."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/d/([A-Za-z0-9_-]+)", 1), F.lit("")), clean(url))


def from_base64url(c: Column) -> Column:
    return F.unbase64(F.translate(c, "-_", "+/"))


def fenced_json(c: Column, schema: str) -> Column:
    """A JSON answer, with or without a code fence around it; null fields where it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.from_json(bare, schema)


def term_text(c: Column, bank_codes: tuple[str, ...] = BANK_CODES) -> Column:
    """What similarity looks at: upper case without reference numbers that begin with a bank's code and numbers of 4 digits or more, separators as spaces."""
    c = F.upper(F.coalesce(c, F.lit("")))
    if bank_codes:
        c = F.regexp_replace(c, rf"\b(?:{'|'.join(bank_codes)})[A-Z0-9]{{6,}}\b", " ")
    c = F.regexp_replace(c, r"\b\d{4,}\b", " ")
    return F.trim(F.regexp_replace(F.translate(c, "-/", "  "), r"\s+", " "))


def shortened(c: Column, size: int = 80) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size - 3)), F.lit("..."))).otherwise(c)


def failure_category(stage: Column, error: Column) -> Column:
    """What staff are told of a failed run; what no stage explains is the error itself, shortened."""
    e = F.lower(F.coalesce(error, F.lit("")))
    upload = F.when(e.contains("duplicate"), "Duplicate statement").when(e.contains("not found"), "Account not found").otherwise("Failed to upload to Google Sheets")
    return (
        F.when(stage == 5, F.lit("Account not found"))
        .when(stage == 6, F.when(e.contains("password"), "Invalid PDF password").otherwise("Corrupted PDF"))
        .when(stage == 7, F.when(e.contains("unsupported"), "Unsupported bank format").otherwise("Parsing failed"))
        .when(stage == 8, F.lit("Financial Year mismatch"))
        .when(stage == 9, upload)
        .otherwise(shortened(F.coalesce(F.nullif(error, F.lit("")), F.lit("Processing failed"))))
    )

"""Payee names and roles within descriptions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, is_digits, is_ifsc, segments

# What a segment of a description says about the payee's role.
ROLES = {"vendor": "Vendor", "contractor": "Contractor", "contract": "Contractor", "professional": "Professional", "prof": "Professional", "imprest": "Imprest"}
ROLE_PREFIXES = {"cancellation": "Cancellation"}
ROLE_SUFFIX = r"(?i)\s+(IMPREST|SALARY|CONTRACTOR|PROFESSIONAL|VENDOR|ADVANCE|REFUND)$"
# Words at the end of a text that tell what was paid for, and parts of texts that name no payee.
NOTE_WORDS = ("vendor", "contractor", "contract", "professional", "prof", "imprest", "salary", "advance", "refund", "broker", "internal", "commission", "rent")
NO_PAYEE = "epfo payment|esic payment|tin 2\\.0"


def _role(c: Column) -> Column:
    return reduce(lambda out, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(out), reversed(ROLES.items()), F.lit(None).cast("string"))


def _bare_holds(description: Column, words: Sequence[str]) -> Column:
    """Whether any of the words stands in the text in lower case without spaces; a word that begins with another adds nothing."""
    bare = F.replace(F.lower(description), F.lit(" "), F.lit(""))
    least = [w for w in words if not any(w != o and w.startswith(o) for o in words)]
    return reduce(lambda hit, w: hit | bare.contains(w), least[1:], bare.contains(least[0]))


def role_in(description: Column, professionals: list[str] | None = None, contractors: list[str] | None = None) -> Column:
    """The role that the first telling segment names: as a whole, without spaces, by its last word or by a prefix; then names known for a role."""

    def of(s: Column) -> Column:
        s = F.lower(F.trim(s))
        bare = F.replace(s, F.lit(" "), F.lit(""))
        words = F.split(s, r"\s+")
        tail = F.when(F.size(words) > 1, _role(F.element_at(words, -1)))
        prefix = F.coalesce(*(F.when(bare.startswith(p), F.lit(h)) for p, h in ROLE_PREFIXES.items()))
        return F.coalesce(_role(s), _role(bare), tail, prefix)

    found = F.filter(F.transform(segments(description), of), lambda r: r.isNotNull())
    # Texts without any of the words are not taken apart.
    out = [F.when(_bare_holds(description, (*ROLES, *ROLE_PREFIXES)), F.try_element_at(found, F.lit(1)))]
    squeezed = F.replace(F.upper(description), F.lit(" "), F.lit(""))
    for names, head in ((professionals, "Professional"), (contractors, "Contractor")):
        out += [F.when(squeezed.contains(n.replace(" ", "").upper()), F.lit(head)) for n in names or []]
    return F.coalesce(*out)


def mentions_segment(description: Column, word: str) -> Column:
    """Whether a segment is the word, with or without spaces, or ends in it."""
    return _bare_holds(description, (word,)) & F.exists(segments(description), lambda s: (F.replace(F.lower(F.trim(s)), F.lit(" "), F.lit("")) == word) | F.lower(F.trim(s)).rlike(rf"\s{word}$"))


def _named(name: Column, ok: Column) -> Column:
    name = F.upper(F.trim(name))
    return F.when((name != "") & ~is_digits(name) & ok, clean(F.regexp_replace(name, ROLE_SUFFIX, "")))


def payee_name(description: Column) -> Column:
    """The payee of YIB-NEFT and YIB-TPT texts (4th part), of IMPS/ texts (last but one) and of NEFT or RTGS texts with spaces."""
    up = F.upper(description)
    dash, slash = F.split(description, "-", -1), F.split(description, "/", -1)
    fourth = F.upper(F.trim(F.try_element_at(dash, F.lit(4))))
    beside = F.upper(F.trim(F.try_element_at(slash, F.lit(-2))))
    spaced = F.nullif(F.regexp_extract(description, r"(?i)^(?:NEFT|RTGS)\s+[A-Z0-9]+\s+(.+?)\s+[A-Z]{4}0[A-Z0-9]{6}\b", 1), F.lit(""))
    return (
        F.when(up.startswith("YIB-NEFT") | up.startswith("YIB-TPT"), F.when(F.size(dash) >= 4, _named(fourth, ~is_ifsc(fourth))))
        .when(up.startswith("IMPS/"), F.when(F.size(slash) >= 3, _named(beside, ~beside.startswith("RRN"))))
        .when(up.startswith("NEFT ") | up.startswith("RTGS "), _named(spaced, F.lit(True)))
    )


def dashed_payee_name(description: Column) -> Column:
    """The payee of texts <ref>-<name>-<account>-<note>: the part before a run of 9 digits or more; the third of IMPS- texts."""
    parts = F.transform(F.split(description, "-", -1), lambda p: F.trim(p))
    third = F.upper(F.try_element_at(parts, F.lit(3)))
    imps = F.when((F.upper(F.element_at(parts, 1)) == "IMPS") & (third != "") & ~is_digits(third), third)
    pairs = F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike(r"^\d{9,}$"), F.upper(F.try_element_at(parts, F.greatest(i, F.lit(1))))))
    before = F.try_element_at(F.filter(pairs, lambda n: n.isNotNull() & (n != "") & ~is_digits(n)), F.lit(1))
    return F.when(F.size(parts) >= 3, F.coalesce(imps, before))


def _is_number(c: Column) -> Column:
    """An account or transaction number: eight characters or more, mostly digits."""
    return c.rlike(r"^[A-Za-z]{0,6}[xX*\d]{8,}$")


def any_payee_name(description: Column) -> Column:
    """The batch extractor: one layout after another; null where a text names no payee, such as charges and taxes.

    A layout says how a text begins, how it is separated, and which of its parts is the name.
    """
    d = F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " "))
    up = F.upper(d)
    dash, slash, colon = (F.transform(F.split(d, sep, -1), lambda x: F.trim(x)) for sep in ("-", "/", ":"))
    part = lambda parts, n: F.try_element_at(parts, F.lit(n))
    joined = lambda parts, a, sep, less: F.array_join(F.slice(parts, F.lit(a), F.greatest(F.size(parts) - (a - 1) - less, F.lit(0))), sep)
    words = F.split(d, " ", -1)
    # NEFT <number> <name> <branch>: the branch is letters and four digits or more, and may be missing.
    branch = F.element_at(words, -1).rlike(r"(?i)^[A-Z]{2,6}\d{4,}$") & (F.size(words) > 3)
    spaced = joined(words, 3, " ", F.when(branch, 1).otherwise(0))
    # <number>-<name>[-<account>][-<note>]: account and note go from the end.
    size, last, second = F.size(dash), F.element_at(dash, -1), F.try_element_at(dash, F.lit(-2))
    noted = (size > 2) & F.lower(last).isin(*NOTE_WORDS)
    ends = F.when(_is_number(last), 1).when(noted & _is_number(second), 2).when(noted, 1).otherwise(0)
    plain = joined(dash, 2, "-", ends)
    issued = F.regexp_replace(joined(slash, 3, "/", 0), "(?i)/atPar$", "")
    layouts = [
        (up.startswith("BY CLG:") & (F.size(colon) > 2), part(colon, 2)),
        (up.startswith("DD ISSUED/") & (F.size(slash) > 2), F.when(F.length(issued) > 2, issued)),
        (up.rlike("^(DD CANCLN|DD CANC|BY DD NUM)\\b"), F.lit(None)),
        (up.rlike("^(NEFT|RTGS) CR-[A-Z0-9]+-") & last.rlike("(?i)^[A-Z0-9]{10,}$") & (size > 3), F.try_element_at(F.filter(F.slice(dash, 3, F.greatest(size - 3, F.lit(0))), lambda x: x != ""), F.lit(1))),
        (up.rlike("^(NEFT|RTGS) [A-Z0-9]{10,} ."), spaced),
        (up.startswith("INB/IFT/") & up.endswith("/TPARTY TRANSFER"), F.trim(F.regexp_replace(joined(slash, 3, "/", 1), "(?i)AXIS$", ""))),
        (up.rlike("^(NEFT|RTGS)/") & (F.size(slash) > 2) & ~_is_number(part(slash, 3)), part(slash, 3)),
        (up.startswith("IMPS-") & part(dash, 2).rlike("^\\d+$") & (size > 4), part(dash, 3)),
        (up.startswith("BILLDESK-") & (size > 3), part(dash, 3)),
        (up.startswith("NEFT-RETURN-") & (size > 4), part(dash, 4)),
        (up.startswith("INB/") & up.endswith("/NA") & part(slash, 2).rlike("^\\d+$") & ~d.rlike(f"(?i){NO_PAYEE}"), joined(slash, 3, "/", 1)),
        (part(dash, 1).rlike(r"^[A-Z]{4,5}[A-Z0-9]*\d{6,}$") & (size > 1), F.when((F.length(plain) > 1) & ~_is_number(plain), plain)),
    ]
    out = F.lit(None).cast("string")
    for holds, name in reversed(layouts):
        out = F.when(holds, name).otherwise(out)
    return clean(out)

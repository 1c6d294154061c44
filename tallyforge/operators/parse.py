"""Descriptions to (party, payment_mode, reference, account_number, note): ordered layouts, the first that fits decides.

A layout states how a text is separated, what its parts say or are made of, and which part holds which
field. Each text is split once a separator; no layout is tried on the text itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean

FIELDS = ("party", "payment_mode", "reference", "account_number", "note")

# What parts are made of.
CODE, DIGITS, LETTERS, MASKED, ADDRESS, NAME, ANY = "[A-Z0-9]+", "[0-9]+", "[A-Z]+", "[xX0-9]+", "[xX0-9@.a-zA-Z]+", "[^-/]+", ".*"
REST = 0  # a field that takes all parts from its first one on


@dataclass(frozen=True)
class Layout:
    """parts: what each of the first parts is made of, as a pattern for the whole part; literals among them are fixed values that banks print.

    ends: the same for the last parts, counted from the end. most: no more parts than this. fields: the part that holds a field, or (first, last) for several joined again,
    last counted from the end and REST for all. without: what is taken out of a field's text.
    """

    sep: str
    mode: str | None
    parts: tuple[str, ...]
    fields: dict[str, int | tuple[int, int]]
    most: int | None = None
    ends: tuple[str, ...] = ()
    any_case: bool = False
    without: dict[str, str] = field(default_factory=dict)
    mode_from: int | None = None


def layouts(own_names: tuple[str, ...] = ()) -> list[Layout]:
    """The layouts in the order in which they are tried. own_names: the first words of the own companies; without them, their layout is left out."""
    own = "(?:" + "|".join(own_names) + ").*"
    named = [
        Layout("-", None, (CODE, NAME, own), {"party": 2, "reference": 4}, 4, (r"\s*[A-Za-z0-9]+\s?[A-Za-z0-9]*",), True),
        Layout("-", None, (r"(?:NEFT|RTGS)\s+CR", CODE, NAME, own), {"party": 3, "reference": 5}, 5, (r"\s*[A-Za-z0-9]+\s?[A-Za-z0-9]*",), True),
    ]
    return [
        Layout("-", None, (r"(?:NEFT|RTGS)\s+CR", CODE, NAME, NAME, CODE), {"party": 3, "reference": 5}, 5, mode_from=1),
        Layout("-", "NEFT", ("NEFT", "RETURN", CODE, NAME, ANY), {"party": 4, "reference": 3, "note": (5, REST)}),
        Layout("-", "IMPS", ("IMPS", DIGITS, NAME, LETTERS, MASKED, ANY), {"party": 3, "reference": 2, "account_number": 5, "note": (6, REST)}),
        Layout("/", "IMPS", ("IMPS", ".+", r"\s*XXX\s*[\d\s]+", r"RR\s*N\s*:\s*\d+", ANY), {"party": 2, "reference": 4, "account_number": 3, "note": (5, REST)}, None, (), True, {"account_number": r"(?i)XXX|\s", "reference": r"(?i)^RR\s*N\s*:\s*"}),
        Layout("/", "UPI", ("UPI", DIGITS, "FROM:[^@]+@.+", "TO:[^@]+@.+", ANY), {"party": 3, "reference": 2, "note": (5, REST)}, None, (), True, {"party": r"(?i)^FROM:|@.*$|\s"}),
        Layout("-", "UPI", ("UPI", DIGITS, NAME, LETTERS, ADDRESS, ANY), {"party": 3, "reference": 2, "account_number": 5, "note": (6, REST)}),
        Layout("-", "NEFT", ("YIB", "NEFT", CODE, NAME, CODE, NAME, ANY), {"party": 4, "reference": 3, "note": (7, REST)}, None, (), True),
        Layout("-", "TPT", (LETTERS, "TPT", NAME), {"party": (3, 1), "reference": (-1, REST)}, None, (r"TFR\s.*",), True, {"reference": r"(?i)^TFR\s+"}),
        Layout("-", "TPT", (LETTERS, "TPT", NAME), {"party": (3, 2), "reference": (-1, REST)}, None, (r"TFR\s*", ".+"), True),
        Layout("-", "TPT", ("NET", "TPT", NAME, ANY), {"party": 3, "reference": (4, REST)}, None, (), True),
        Layout("/", "NEFT", ("NEFT", CODE, ".+", ".+", "NA", "NA.*", "NANA", "NA"), {"party": 3, "reference": 2, "note": 6}, 8, without={"note": "^NA"}),
        Layout("/", "NEFT", ("INB", "NEFT", CODE, ".+", ".+", ""), {"party": 4, "reference": 3}, None, ("",)),
        Layout("/", "INB", ("INB", DIGITS, ANY), {"reference": 2, "note": (3, 1)}, None, ("NA",)),
        Layout(":", "CLG", ("BY CLG", ".+", ANY), {"party": 2, "note": (3, REST)}),
        Layout("/", "DD", ("DD ISSUED", ".+", ".+", ".+", ANY), {"party": 4, "reference": (2, -3), "note": (5, REST)}),
        Layout("-", "BILLDESK", ("BILLDESK", CODE, NAME, NAME, r"\d.*"), {"party": 3, "reference": 2, "account_number": (5, REST), "note": 4}),
        *(named if own_names else []),
        Layout("-", None, ("[A-Z0-9]{10,}", NAME, r"\d{6,}", ANY), {"party": 2, "reference": 1, "account_number": 3, "note": (4, REST)}),
    ]


def _part(parts: Column, n: int) -> Column:
    return F.try_element_at(parts, F.lit(n))


def _fits(x: Layout, parts: Column) -> Column:
    ci = "(?i)" if x.any_case else ""
    fewest = max(len(x.parts), len(x.parts) + len(x.ends) if x.most is None and x.parts[-1] != ANY else len(x.parts))
    ok = F.size(parts) >= F.lit(x.most or fewest)
    if x.most:
        ok = ok & (F.size(parts) <= x.most)
    for i, made_of in enumerate(x.parts, 1):
        if made_of != ANY:
            plain = made_of.replace(" ", "").isalpha()
            here = F.upper(_part(parts, i)) if plain and x.any_case else _part(parts, i)
            ok = ok & ((here == made_of) if plain else here.rlike(f"{ci}^(?:{made_of})$"))
    for i, made_of in enumerate(reversed(x.ends), 1):
        ok = ok & _part(parts, -i).rlike(f"{ci}^(?:{made_of})$")
    # What takes the rest must have something in it, unless the layout allows it to be empty.
    for name, place in x.fields.items():
        if isinstance(place, tuple) and place[1] == REST and place[0] > 0 and x.parts[-1] == ANY and not (x.sep == "/" and x.any_case):
            ok = ok & (F.size(parts) >= place[0]) & (F.length(F.array_join(F.slice(parts, F.lit(place[0]), F.greatest(F.size(parts) - place[0] + 1, F.lit(0))), x.sep)) > 0)
    return F.coalesce(ok, F.lit(False))


def _text(x: Layout, parts: Column, name: str) -> Column:
    place = x.fields.get(name)
    if place is None:
        return F.lit(None).cast("string")
    if isinstance(place, int):
        out = _part(parts, place)
    elif place[0] < 0:
        out = _part(parts, place[0])
    else:
        # A negative end is a part's number, a positive one says how many parts are left out at the end.
        last = F.lit(-place[1]) if place[1] < 0 else F.size(parts) - place[1]
        out = F.array_join(F.slice(parts, F.lit(place[0]), F.greatest(last - place[0] + 1, F.lit(0))), x.sep)
    return clean(F.regexp_replace(out, x.without[name], "") if name in x.without else out)


def parsed_description(description: Column, own_names: tuple[str, ...] = ()) -> Column:
    """A struct of the five fields; all null where no layout fits or the text is blank."""
    d = F.trim(F.coalesce(description, F.lit("")))
    split = F.struct(*(F.split(d, f"[{sep}]", -1).alias(n) for n, sep in (("dash", "-"), ("slash", "/"), ("colon", ":"))))

    def chosen(s: Column) -> Column:
        of = {"-": s["dash"], "/": s["slash"], ":": s["colon"]}
        out = F.struct(*(F.lit(None).cast("string").alias(f) for f in FIELDS))
        for x in reversed(layouts(own_names)):
            parts = of[x.sep]
            mode = F.regexp_extract(_part(parts, x.mode_from), r"^(\S+)", 1) if x.mode_from else F.lit(x.mode).cast("string")
            values = {f: mode if f == "payment_mode" else _text(x, parts, f) for f in FIELDS}
            out = F.when(_fits(x, parts), F.struct(*(v.alias(f) for f, v in values.items()))).otherwise(out)
        return out

    # Bound once, so that the text is not split again for each field.
    return F.element_at(F.transform(F.array(split), chosen), 1)


def with_parsed(df: DataFrame, description: str = "description", own_names: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn("parsed", parsed_description(F.col(description), own_names)).select("*", *(F.col(f"parsed.{f}").alias(f"parsed_{f}") for f in FIELDS)).drop("parsed")

"""From positioned words of statement pages to rows of seven fields.

Lines are clustered by an anchor (a fold over ordered words), the header is
looked for page by page, and everything after that is relational: ranges
between neighbouring anchors, words to columns by a range join, records by
running sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import AMOUNT
from ..functions.dates import DATE_PATTERNS, date_in
from ..functions.text import letters_only

LINE_TOLERANCE, HEADER_GAP, EPSILON, SECTION_GAP = 3.0, 25.0, 2.0, 50.0
TEXT_FIELDS, AMOUNT_FIELDS = ("txn_date", "value_date", "description", "reference"), ("debits", "credits", "balance")
# The words by which header cells are known, and lines that are no transactions.
HEADER_TOKENS = {
    "transaction": "txn_date", "value": "value_date", "description": "description", "narration": "description", "particulars": "description",
    "reference": "reference", "number": "reference", "cheque": "reference", "withdrawal": "debits", "withdrawals": "debits", "debit": "debits", "debits": "debits",
    "deposit": "credits", "deposits": "credits", "credit": "credits", "credits": "credits", "running": "balance", "balance": "balance", "channel": "channel",
}
NOISE = ["opening balance", "closing balance", "total deposits", "total withdrawals", "summary", "page", "c/f", "toll free", "customer care", "call us"]
TERMINATORS = ["closing balance", "customer care", "call us"]
_DATE = re.compile("|".join(DATE_PATTERNS))


@dataclass(frozen=True)
class Profile:
    """What one bank's statements add to the vocabularies or leave out."""

    tokens: dict[str, str] = field(default_factory=dict)
    noise: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    anchors: dict[str, float] = field(default_factory=dict)

    def vocabulary(self) -> dict[str, str]:
        return {k: v for k, v in {**HEADER_TOKENS, **self.tokens}.items() if v not in self.excluded}


def _line_ends(tops) -> tuple[list[int], list[float], list[int], list[int]]:
    """Of a page's heights in order: each word's line and that line's height; each line's first place, from 1, and its number of words."""
    numbers, heights, starts, sizes = [], [], [], []
    anchor = None
    for at, top in enumerate(tops, 1):
        if anchor is None or abs(top - anchor) > LINE_TOLERANCE:
            anchor = top
            starts.append(at)
            sizes.append(0)
        sizes[-1] += 1
        numbers.append(len(starts) - 1)
        heights.append(anchor)
    return numbers, heights, starts, sizes


def clustered(words: DataFrame) -> DataFrame:
    """(doc_id, page, words, lines): one row a page. A word joins the line whose first word is within the tolerance; words stand by line, then from the left, and lines tell where each begins and how many words it has.

    A page's words are shuffled once; of them only the heights go to Python.
    """

    @F.pandas_udf("line_no array<int>, line_top array<double>, starts array<int>, sizes array<int>")
    def numbered(tops: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_line_ends(t.tolist()) for t in tops], columns=["line_no", "line_top", "starts", "sizes"])

    pages = words.filter("doc_id is not null and page is not null").repartition("doc_id", "page").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("top", "x0", "word_no", "text", "x1", "bottom"))).alias("w"))
    x = pages.withColumn("l", numbered(F.transform("w", lambda w: w["top"])))
    placed = F.transform("w", lambda w, i: F.struct(F.get("l.line_no", i).alias("line_no"), *(w[c].alias(c) for c in ("x0", "word_no", "text")), F.get("l.line_top", i).alias("line_top"), w["x1"].alias("x1"), w["bottom"].alias("bottom")))
    return x.select("doc_id", "page", F.sort_array(placed).alias("words"), F.zip_with("l.starts", "l.sizes", lambda a, b: F.struct(a.alias("start"), b.alias("n"))).alias("lines"))


def _norm(text: str) -> str:
    return re.sub("[^a-z]", "", str(text).lower())


def _header(words: list[dict], profile: Profile, vocabulary: dict[str, str]) -> list[tuple[str, float, float, int]]:
    """The anchors of a page's header: the first line with a description cell that, with its neighbours, names a date and an amount column."""
    by_line: dict[int, list[dict]] = {}
    for w in words:
        by_line.setdefault(w["line_no"], []).append(w)
    lines = [sorted(by_line[n], key=lambda w: (w["x0"], w["word_no"])) for n in sorted(by_line)]
    dated = lambda x: any(_DATE.search(str(w["text"])) for w in x)
    for i, line in enumerate(lines):
        cells = [vocabulary.get(_norm(w["text"])) for w in line]
        if "description" not in cells:
            continue
        block, top, last = [line], line[0]["line_top"], i
        if i and any(c in AMOUNT_FIELDS for c in cells) and top - lines[i - 1][0]["line_top"] <= HEADER_GAP and not dated(lines[i - 1]):
            block.insert(0, lines[i - 1])
        if i + 1 < len(lines) and lines[i + 1][0]["line_top"] - top <= HEADER_GAP and not dated(lines[i + 1]):
            block.append(lines[i + 1])
            last = i + 1
        places: dict[str, list[tuple[float, float]]] = {}
        bare = []
        for w in (w for x in block for w in x):
            word = _norm(w["text"])
            if vocabulary.get(word):
                places.setdefault(vocabulary[word], []).append((w["x0"], w["x1"]))
            elif word == "date" and "txn_date" not in profile.excluded:
                bare.append((w["x0"], w["x1"]))
        for x0, x1 in bare:
            near = [f for f in ("txn_date", "value_date") if f in places]
            target = min(near, key=lambda f: abs(places[f][0][0] - x0), default="txn_date")
            places.setdefault(target, []).append((x0, x1))
        if not ({"txn_date", "value_date"} & places.keys() and {"debits", "credits"} & places.keys()):
            continue
        anchors = {f: max(b for _, b in p) if f in AMOUNT_FIELDS else min(a for a, _ in p) for f, p in places.items()}
        anchors.update({f: v for f, v in profile.anchors.items() if f in anchors})
        bottom = float(max(w["bottom"] for x in block for w in x))
        return [(f, float(a), bottom, int(lines[last][0]["line_no"])) for f, a in anchors.items()]
    return []


def page_words(pages: DataFrame, profile: Profile | None = None) -> DataFrame:
    """(doc_id, page, words) of clustered pages: words are those of lines with a description cell and of the lines beside them, null for pages that have none."""
    p = profile or Profile()
    named = [t for t, f in p.vocabulary().items() if f == "description"]
    # By its length first, so that few words are stripped to their letters.
    cell = lambda w: (F.length(w["text"]) >= min(map(len, named), default=0)) & letters_only(w["text"]).isin(named)
    x = pages.select("doc_id", "page", "words", F.array_distinct(F.transform(F.filter("words", cell), lambda w: w["line_no"])).alias("_at"))
    beside = F.filter("words", lambda w: F.exists("_at", lambda n: F.abs(n - w["line_no"]) <= 1))
    return x.select("doc_id", "page", F.when(F.size("_at") > 0, beside).alias("words"))


def _headers(pages: DataFrame, profile: Profile | None) -> DataFrame:
    """headers, and one row without a field for each page that has none."""
    p = profile or Profile()
    vocabulary = p.vocabulary()
    none = [(None, None, None, None)]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, page, *h) for doc, page, words in zip(batch["doc_id"], batch["page"], batch["words"], strict=True) for h in (words is not None and _header(list(words), p, vocabulary)) or none]
            out = pd.DataFrame(rows, columns=["doc_id", "page", "field", "anchor", "header_bottom", "header_line"])
            yield out.astype({"anchor": "float64", "header_bottom": "float64", "header_line": "Int32"})

    return pages.mapInPandas(found, "doc_id string, page int, field string, anchor double, header_bottom double, header_line int")


def headers(pages: DataFrame, profile: Profile | None = None) -> DataFrame:
    """(doc_id, page, field, anchor, header_bottom, header_line) of page_words: only pages that have a description cell are looked at one by one, many in a batch."""
    return _headers(pages, profile).filter("field is not null")


def ranges(anchors: DataFrame) -> DataFrame:
    """(doc_id, page, field, start, end): from the middle to the left neighbour to the middle to the right one; open at either end."""
    w = Window.partitionBy("doc_id", "page").orderBy("anchor", "field")
    middle = lambda a, b: (a + b) / 2
    return anchors.select("doc_id", "page", "field", "header_line", middle(F.lag("anchor").over(w), F.col("anchor")).alias("start"), middle(F.col("anchor"), F.lead("anchor").over(w)).alias("end"), F.row_number().over(w).alias("range_no"))


def carried(found: DataFrame) -> DataFrame:
    """(doc_id, page, ranges, header_line) for every page of found, which has a row without a field for pages without a header: its own ranges in order, else those of the last page before that has a header; header_line is -1 where they are not its own."""
    one = F.when(F.col("field").isNotNull(), F.struct("range_no", "field", "start", "end", F.col("field").isin(*AMOUNT_FIELDS).alias("is_amount")))
    own = found.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(one)).alias("ranges"), F.max("header_line").alias("header_line"))
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.size("ranges") > 0, F.col("ranges")), ignorenulls=True).over(w)
    return own.select("doc_id", "page", last.alias("ranges"), F.coalesce("header_line", F.lit(-1)).alias("header_line")).filter("ranges is not null")


def bucketed(pages: DataFrame, column_ranges: DataFrame) -> DataFrame:
    """One row a line below the header, a column a field: text words by their left edge, amounts by their right one; the first range wins.

    Text in an amount column is dropped, and text without a digit in the reference
    column goes to the description (is_rescued). Pages meet their ranges as whole rows, and what is
    exploded are lines, so words are neither shuffled nor grouped again.
    """
    edge = lambda w, r: F.when(r["is_amount"], w["x1"]).otherwise(w["x0"])
    inside = lambda w: lambda r: (r["start"].isNull() | (r["start"] <= edge(w, r))) & (r["end"].isNull() | (edge(w, r) < r["end"]))
    range_of = lambda w: F.get(F.filter("ranges", inside(w)), F.lit(0))
    kept = lambda w: w["r"].isNotNull() & (~w["r"]["is_amount"] | w["text"].rlike(AMOUNT))
    rescued = lambda w: (w["r"]["field"] == "reference") & ~w["text"].rlike(r"\d")

    def line(s):
        words = F.filter(F.transform(F.slice("words", s["start"], s["n"]), lambda w: F.struct(w["text"].alias("text"), range_of(w).alias("r"))), kept)
        first = F.element_at("words", s["start"])
        return F.struct(first["line_no"].alias("line_no"), first["line_top"].alias("line_top"), F.transform(words, lambda w: F.struct(w["text"].alias("text"), F.when(rescued(w), "description").otherwise(w["r"]["field"]).alias("f"), rescued(w).alias("rescued"))).alias("w"))

    below = F.when(F.col("header_line") + 1 < F.size("lines"), F.slice("lines", F.col("header_line") + 2, F.size("lines"))).otherwise(F.slice("lines", 1, 0))
    # Dealt as pages are, or Spark would move pages to where a document's ranges are.
    placed = pages.join(column_ranges.repartition("doc_id", "page").hint("shuffle_hash"), ["doc_id", "page"])
    of_line = placed.select("doc_id", "page", F.explode(F.filter(F.transform(below, line), lambda x: F.size(x["w"]) > 0)).alias("l")).select("doc_id", "page", "l.line_no", "l.line_top", "l.w")
    words = lambda name: F.transform(F.filter("w", lambda s: s["f"] == name), lambda s: s["text"])
    return of_line.select("doc_id", "page", "line_no", "line_top", *(F.array_join(words(c), "" if c == "reference" else " ").alias(c) for c in (*TEXT_FIELDS, *AMOUNT_FIELDS)), F.exists("w", lambda s: s["rescued"]).alias("is_rescued"), F.concat_ws(" ", F.transform("w", lambda s: s["text"])).alias("line_text"))


def _has_any(c, words) -> object:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(c).contains(w.lower())
    return hit


def records(rows: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Statement rows: a line with a transaction date starts a record; lines without join the one above, or the one below if that is nearer."""
    p = profile or Profile()
    line = Window.partitionBy("doc_id", "page").orderBy("line_no")
    gap = F.col("line_top") - F.lag("line_top").over(line)
    ended = F.max((_has_any(F.col("line_text"), TERMINATORS) | (F.coalesce(gap, F.lit(0.0)) > SECTION_GAP)).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    x = rows.withColumn("_end", ended).filter("_end = 0").drop("_end").filter(~_has_any(F.col("line_text"), [*NOISE, *p.noise]))
    x = x.withColumn("start", date_in(F.col("txn_date")).isNotNull())
    contact = F.col("line_text").contains("|") | (F.regexp_count("line_text", F.lit(":")) >= 2)
    other = (F.length(F.concat("debits", "credits", "balance")) > 0) | date_in(F.col("line_text")).isNotNull()
    x = x.filter(F.col("start") | ~(contact | other))
    up, down = F.last(F.when(F.col("start"), F.col("line_top")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.first(F.when(F.col("start"), F.col("line_top")), ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    before, after = F.col("line_top") - F.lag("line_top").over(line), F.lead("line_top").over(line) - F.col("line_top")
    x = x.withColumn("n", F.sum(F.col("start").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_up", up).withColumn("_down", down).withColumn("_before", before).withColumn("_after", after)
    below = ~F.col("start") & F.col("_down").isNotNull() & (F.col("_up").isNull() | (F.col("_after") < F.col("_before") - EPSILON))
    x = x.withColumn("record", F.when(below, F.col("n") + 1).otherwise(F.col("n"))).filter("record > 0")
    parts = F.sort_array(F.collect_list(F.struct("line_no", "description", "is_rescued")))
    text = F.aggregate(parts, F.struct(F.lit("").alias("t"), F.lit(False).alias("r")), lambda s, q: F.struct(F.when(q["description"] == "", s["t"]).when((s["t"] == "") | s["r"], F.concat(s["t"], q["description"])).otherwise(F.concat_ws(" ", s["t"], q["description"])).alias("t"), q["is_rescued"].alias("r")), lambda s: s["t"])
    one = lambda c: F.coalesce(F.max(F.when(F.col("start"), F.col(c))), F.lit("")).alias(c)
    out = x.groupBy("doc_id", "page", "record").agg(F.coalesce(date_in(F.max(F.when(F.col("start"), F.col("txn_date")))), F.lit("")).alias("txn_date"), one("value_date"), text.alias("description"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "reference"))), lambda s: s["reference"]), "").alias("reference"), one("credits"), one("debits"), one("balance"))
    w = Window.partitionBy("doc_id").orderBy("page", "record")
    return out.select(F.col("doc_id").alias("source"), (F.row_number().over(w) - 1).cast("long").alias("row_pos"), "txn_date", "value_date", "description", "reference", "credits", "debits", "balance")


def statement_rows(words: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Words to raw statement rows."""
    pages = clustered(words)
    found = ranges(_headers(page_words(pages, profile), profile))
    return records(bucketed(pages, carried(found)), profile)

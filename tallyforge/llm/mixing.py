"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source, language and topic. The categories are
those that the targets name, and one more for the rest, so the table of cells
is bounded by the targets and not by the corpus. Raking scales the cells'
token weights to one marginal after another; each document is then kept with
the probability that brings its cell to its share of the token budget, decided
by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty, written

REST = "_rest"
DIMENSIONS = ("source", "lang", "topic")
#: Sweeps end when no marginal is further than this from its target (in shares of all tokens), when a block of sweeps no longer takes STALL of the error away,
#: as with targets that contradict each other, or after MOST_SWEEPS, where cells that the targets leave nothing still shrink.
TOLERANCE, STALL, MOST_SWEEPS = 1e-12, 1e-3, 160
#: Sweeps that one job does before the error is looked at.
BLOCK_SWEEPS = 8
#: The share of all tokens that the mix keeps.
BUDGET = 0.5

# What marks a text's topic, tried in this order.
TOPICS = {"legal": r"(?i)licen[sc]e|copyright", "table": r" \| ", "contact": r"[a-z0-9]@[a-z0-9]", "credential": r"(?i)token|secret|password", "loud": r"!!", "numeric": r"[0-9]{9,}"}
TARGETS = {
    "source": {**{f"src{i}": 0.04 for i in range(20)}, REST: 0.20},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.10, REST: 0.05},
    "topic": {"legal": 0.05, "table": 0.05, "contact": 0.10, "credential": 0.02, "loud": 0.03, "numeric": 0.05, "prose": 0.70},
}


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS.items()):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _category(value: Column, names: list[str]) -> Column:
    return F.when(value.isin([n for n in names if n != REST]), value).otherwise(F.lit(REST))


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone: the first 13 hexadecimal digits of its MD5. A null id draws as the empty text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def weighted(docs: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """Adds the document's cell (g_source, g_lang, g_topic) and its tokens, that is words between white space."""
    t = text_or_empty()
    return (
        docs.withColumn("g_source", _category(F.col("source"), list(targets["source"])))
        .withColumn("g_lang", _category(F.col("lang"), list(targets["lang"])))
        .withColumn("g_topic", _category(topic_of(t), list(targets["topic"])))
        .withColumn("n_tokens", F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    )


def _aim(dimension: str, aims: dict[str, float]) -> Column:
    pairs = [F.lit(x) for k, v in sorted(aims.items()) for x in (k, float(v))]
    return F.create_map(*pairs)[F.col(f"g_{dimension}")]


def raked(cells: DataFrame, targets: dict[str, dict[str, float]], tolerance: float = TOLERANCE, most: int = MOST_SWEEPS) -> DataFrame:
    """cells (g_source, g_lang, g_topic, n) in one partition: adds w, whose marginals are in proportion to the targets.

    Each step scales the weights to one marginal, a window sum over its categories. Targets of categories without
    tokens are left out, and the others of that marginal scaled to one. Sweeps go on in blocks until every marginal is
    within the tolerance; where the targets cannot all be met, until a block no longer lowers the error, or most
    sweeps are done.
    """
    found = cells.agg(*(F.collect_set(f"g_{d}").alias(d) for d in DIMENSIONS)).first()
    x = cells.withColumn("w", F.col("n").cast("double"))
    if not found[DIMENSIONS[0]]:
        return x
    total = lambda d: F.sum("w").over(Window.partitionBy(f"g_{d}"))
    aims = {}
    for d in DIMENSIONS:
        have = {k: float(targets[d].get(k, 0.0)) for k in found[d]}
        aims[d] = _aim(d, {k: v / (sum(have.values()) or 1.0) for k, v in have.items()})
    errors: list[float] = []
    for _ in range(0, most, BLOCK_SWEEPS):
        for _ in range(BLOCK_SWEEPS):
            for d in DIMENSIONS:
                x = x.withColumn("w", F.when(total(d) > 0, F.col("w") * aims[d] / total(d)).otherwise(F.lit(0.0)))
        x = checkpointed(x.coalesce(1)).coalesce(1)
        errors.append(x.select(F.greatest(*(F.abs(total(d) - aims[d]) for d in DIMENSIONS)).alias("e")).agg(F.max("e")).first()[0])
        if errors[-1] <= tolerance or len(errors) > 1 and errors[-2] - errors[-1] <= STALL * errors[-1]:
            break
    return x


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """cells (.., n, w), w summing to 1: adds p, by which a document of the cell is kept so that the cells' kept tokens are as w.

    A cell cannot give more than it has: p is 1 there, and what it lacks is dealt
    out to the other cells in proportion to w. Each round caps one cell more at
    least or is the last, so they end.
    """
    total = cells.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    aim = budget * float(total["n"] or 0)
    scale, full = aim / float(total["w"] or 1.0), -1
    while total["n"]:
        p = F.least(F.lit(1.0), F.lit(scale) * F.col("w") / F.col("n"))
        s = cells.agg(
            F.sum(F.when(p >= 1, F.col("n")).otherwise(F.lit(0))).alias("full"),
            F.sum(F.when(p < 1, F.col("w")).otherwise(F.lit(0.0))).alias("open"),
        ).first()
        if not s["open"] or s["full"] <= full:
            break
        full = s["full"]
        scale = max(0.0, aim - float(full)) / float(s["open"])
    return cells.withColumn("p", F.least(F.lit(1.0), F.lit(scale) * F.col("w") / F.col("n")) if total["n"] else F.lit(0.0))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, columns: list[str] | None = None) -> DataFrame:
    """All rows of docs (and of its columns those named, or all) with topic, n_tokens, probability and sampled.

    Texts are read once: cells and tokens are written with the columns asked for.
    Columns of docs with these names are replaced. Null sources and languages
    fall under the rest; texts without words weigh nothing, so they take no part
    in raking and have the probability of their cell (0 where the cell has no
    tokens at all). Rows with one id are kept or dropped together when they fall
    into one cell. An empty table gives an empty result.
    """
    targets = TARGETS if targets is None else targets
    own = [c for c in docs.columns if c.lower() not in ("topic", "n_tokens", "probability", "sampled", "g_source", "g_lang", "g_topic", "p", "n", "w")]
    kept = own if columns is None else [c for c in own if c in columns]
    w = written(weighted(docs.select(*own), targets).select(*dict.fromkeys([*kept, "doc_id"]), "g_source", "g_lang", "g_topic", "n_tokens"), "mixing-documents")
    # As many rows as the targets have combinations at most: one partition, so that the marginals need no shuffle.
    cells = checkpointed(w.groupBy("g_source", "g_lang", "g_topic").agg(F.sum("n_tokens").alias("n")).filter("n > 0").coalesce(1)).coalesce(1)
    chosen = checkpointed(probabilities(raked(cells, targets), budget).select("g_source", "g_lang", "g_topic", "p"))
    return (
        w.join(F.broadcast(chosen), ["g_source", "g_lang", "g_topic"], "left")
        .withColumn("probability", F.coalesce("p", F.lit(0.0)))
        .select(*kept, F.col("g_topic").alias("topic"), "n_tokens", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("sampled"))
    )

"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed from whole texts inside tasks; the trees are fitted
on the driver from the statistics of a bounded sample of labelled rows, and
flattened into three arrays that numpy walks level by level for all rows of a
batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled rows that a fit uses; those with the smallest hash of their id are taken.
MAX_FIT_ROWS = 16_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_sd", "upper", "lower", "digits", "high_bytes", "spaces",
    "symbols", "marks", "exclaims", "pipes", "stops", "quotes", "log_lines", "line_bytes", "dup_lines",
    "distinct_words", "top_word", "byte_entropy", "long_words", "word_end_symbols",
)


def _counts(b: np.ndarray) -> np.ndarray:
    return np.bincount(b, minlength=256)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; null and empty texts have all of them 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    c = _counts(np.frombuffer(raw, np.uint8)).astype(float)
    n = float(len(raw))
    words = raw.split()
    m = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    p = c[c > 0] / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    of = lambda s: float(c[np.frombuffer(s, np.uint8)].sum())
    ends = sum(1 for w in words if w[-1] in b"#*$%&|<>!~^=+_")
    return [
        np.log1p(n), np.log1p(len(words)), float(sizes.mean()), float(sizes.std()), float(c[65:91].sum()) / n,
        float(c[97:123].sum()) / n, float(c[48:58].sum()) / n, float(c[128:].sum()) / n, (c[32] + c[9]) / n,
        of(b"#*$%&|<>") / m, of(b".,;:") / m, c[33] / m, c[124] / m, of(b".!?") / m, of(b"\"'") / m,
        np.log1p(len(lines)), n / k, 1 - len(set(lines)) / k, len(seen) / m, max(seen.values(), default=0) / m,
        float(-(p * np.log2(p)).sum()), float((sizes > 14).mean()), ends / m,
    ]


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth as arrays: node i has the children 2i+1 and 2i+2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; x > threshold goes right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fitted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 1.0) -> Forest:
    """Boosting with the logistic loss; splits are sought between histogram bins. With one class or no rows, the score is constant."""
    share = (float(y.sum()) + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), base)
    all_feature, all_threshold, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            at = node - first
            best, gain_of = np.zeros(width), {}
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                size = len(c) + 1
                key = at * size + binned[:, j]
                gs = np.bincount(key, g, width * size).reshape(width, size).cumsum(axis=1)
                hs = np.bincount(key, h, width * size).reshape(width, size).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                k = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(width), k] > best + 1e-9):
                    best[i], gain_of[i] = gain[i, k[i]], (j, c[k[i]])
            for i, (j, t) in gain_of.items():
                feature[first + i], threshold[first + i] = j, t
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        score += leaf[at]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_leaf.append(leaf)
    return Forest(base, depth, np.array(all_feature), np.array(all_threshold), np.array(all_leaf))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fifth of the ids that no fit may learn from; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> Forest:
    """Fits on at most max_rows labelled documents outside the held-out fold.

    Labels other than 0 and 1 and null ids are passed over; where an id is
    labelled twice the larger label counts, and where documents repeat an id one
    of the largest texts stands for it.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    # The sample is bounded by max_rows, so it may be broadcast.
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "y", measured("text").alias("x"))
        .groupBy("doc_id").agg(F.max(F.struct("x", "y")).alias("r"))
        .select("doc_id", "r.x", "r.y").collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fitted(x, np.array([r["y"] for r in rows], float))


def quality_scores(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs and the score of each whole text; clashing column names are replaced by the score's own.

    Null and empty texts get the score of the all-zero statistics; repeated rows
    are scored alike. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x))

    return docs.withColumn("score", score("text")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))

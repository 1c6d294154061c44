"""Exact top-k by inner product over an index of pivots and distances.

Every vector is keyed by its nearest pivot and its distance from it; the vectors of a pivot are cut
into annuli of distances. A query meets annuli in the order in which they
may hold its best vectors, in rounds of growing numbers, and stops once the triangle
inequality tells that no annulus left can hold one that is as good as its k-th so far.

Inner products become distances by one more coordinate: with M the largest squared length, x gets
sqrt(M - |x|^2) and a query 0, and then |q - x|^2 = |q|^2 + M - 2 q.x. Components are
whole numbers, so scores are whole and exact; bounds are floating-point numbers with slack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, TOP = 1024, 10
#: Vectors that pivots and the limits of annuli are fitted on, chosen by a hash; they decide only how vectors are dealt out.
FIT_ROWS = 20_000
#: Pivots and annuli: so many vectors an annulus, within what one table of annuli may hold.
ANNULUS_ROWS, MOST_ANNULI, MOST_PIVOTS, ANNULI_A_PIVOT = 1_024, 1 << 16, 512, 4
#: Vectors and queries that one task multiplies.
TILE_ROWS, TILE_QUERIES = 8_192, 4_096
#: Bounds of queries for annuli that a task holds at once.
BOUNDS_AT_ONCE = 1 << 20
#: Annuli that a query meets in its first round, and how many times more in each further one.
FIRST_ANNULI, GROWTH = 4, 3
MOST_ROUNDS = 64
#: Beyond this, products of components are added as Python's integers.
EXACT = float(1 << 52)
LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): floor(1024 x) of each component x, as double; vectors that are null or hold a component whose 1024-fold is null, NaN or infinite are left out."""
    scaled = F.transform(F.col(column), lambda c: c.cast("double") * SCALE)
    fine = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(scaled, _floor)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v"))


def _floor(c: Column) -> Column:
    """floor as a double: Spark's own gives a long, which large numbers do not fit. From 2^53 on all doubles are whole."""
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of x with rows of q: as floating-point numbers while sums stay whole there, else as Python's integers, held within a long."""
    most = (np.abs(x).max(initial=0) * np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if most < EXACT:
        return (x @ q.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    return np.clip(np.dot(big(x), big(q).T), -LONG, LONG).astype(np.int64)


class Index:
    """Pivots in one coordinate more than the vectors have, and the limits of each pivot's annuli."""

    def __init__(self, sample: np.ndarray, most_squared: float, n: int, seed: int = 0) -> None:
        self.most_squared = most_squared
        annuli = int(np.clip(n // ANNULUS_ROWS, 1, MOST_ANNULI))
        x = self.lifted(sample)
        k = int(np.clip(annuli // ANNULI_A_PIVOT, 1, min(MOST_PIVOTS, max(1, len(x)))))
        rng = np.random.default_rng(seed)
        self.pivots = x[rng.choice(len(x), k, replace=False)] if len(x) else np.zeros((1, x.shape[1]))
        for _ in range(8):
            near, _ = self.nearest(x)
            for j in range(len(self.pivots)):
                if (near == j).any():
                    self.pivots[j] = x[near == j].mean(axis=0)
        near, far = self.nearest(x)
        rings = max(1, annuli // len(self.pivots))
        #: The same number of limits for each pivot, so that an annulus is pivot * rings + ring.
        cuts = np.linspace(0, 1, rings + 1)[1:-1]
        self.limits = np.array([np.quantile(far[near == j], cuts) if (near == j).any() else np.full(len(cuts), np.inf) for j in range(len(self.pivots))]).reshape(len(self.pivots), -1)
        self.rings = rings

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.most_squared - (x * x).sum(axis=1)))[:, None]])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of lifted rows from all pivots."""
        out = np.empty((len(x), len(self.pivots)))
        for j, p in enumerate(self.pivots):
            d = x - p
            out[:, j] = np.sqrt((d * d).sum(axis=1))
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x)
        near = d.argmin(axis=1)
        return near, d[np.arange(len(x)), near]

    def annuli(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The annulus of each row and its distance from the pivot."""
        near, far = self.nearest(self.lifted(x))
        ring = (far[:, None] > self.limits[near]).sum(axis=1) if self.rings > 1 else np.zeros(len(x), np.int64)
        return near * self.rings + ring, far


class Bounds:
    """The best score that an annulus may hold for a query, for the annuli that hold vectors: (annulus, least and greatest distance, number)."""

    def __init__(self, index: Index, held: pd.DataFrame) -> None:
        held = held.sort_values("annulus")
        self.index, self.annulus = index, held["annulus"].to_numpy(np.int64)
        self.least, self.greatest = held["least"].to_numpy(), held["greatest"].to_numpy()
        self.pivot = self.annulus // index.rings

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the annuli by falling bound, and the bounds in that order."""
        squared = (q * q).sum(axis=1)
        d = self.index.distances(np.hstack([q, np.zeros((len(q), 1))]))[:, self.pivot]
        away = np.maximum(0, np.maximum(d - self.greatest, self.least - d))
        total = squared + self.index.most_squared
        # Distances are off by rounding alone: slack of 1e-9 of the whole, and one more for the last digit.
        best = (total[:, None] - away * away) / 2 + 1e-9 * total[:, None] + 1
        # Lengths beyond a double tell nothing.
        best = np.where(np.isfinite(best), best, np.inf)
        order = np.argsort(-best, axis=1, kind="stable")
        return order, np.take_along_axis(best, order, axis=1)


def _best(frame: DataFrame, k: int) -> DataFrame:
    """(query_id, best): each query's k best as an array of (less, vec_id), less = -score, from rows and arrays of at most k a task."""
    return frame.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def top_k(vectors: DataFrame, queries: Column, k: int = TOP, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that queries holds of, the k rows with the largest inner products, ties to the smaller vec_id.

    A query does not find its own row, nor another that repeats its id; of such, the smallest vector asks. Vectors
    that are null or hold a component that is null or not finite take no part, neither do rows with a null
    vec_id. Vectors of different lengths are filled with zeros; repeated rows count each; scores beyond
    a long stay at its ends. An empty table gives an empty result; columns other than vec_id and the vectors are not looked at.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors.filter("vec_id is not null").select("vec_id", column), column), "pivot-vectors")
    squared = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    n, dims, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(squared), F.lit(0.0))).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toPandas()["v"]
    index = spark.sparkContext.broadcast(Index(matrix(sample, dims), most, n))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            annulus, far = index.value.annuli(matrix(x["v"], dims))
            yield x.assign(annulus=annulus.astype(np.int32), far=far)

    keys = written(rows.mapInPandas(keyed, "vec_id long, v array<double>, annulus int, far double").repartitionByRange("annulus", "far", "vec_id").sortWithinPartitions("annulus", "far"), "pivot-index")
    # One row an annulus, at most MOST_ANNULI.
    held = keys.groupBy("annulus").agg(F.min("far").alias("least"), F.max("far").alias("greatest"), F.count(F.lit(1)).alias("n"))
    bounds = spark.sparkContext.broadcast(Bounds(index.value, held.toPandas()))
    parts = F.broadcast(held.select("annulus", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("parts")))
    tiled = written(keys.join(parts, "annulus").select("annulus", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("tile"), "vec_id", "v"), "pivot-tiles")
    asked = keys.filter(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    # The annuli that a query has met, and its k best so far.
    live = written(asked.select("query_id", "v", F.lit(0).alias("met"), F.array().cast("array<struct<less:long,vec_id:long>>").alias("best")), "pivot-live")
    done: list[DataFrame] = []

    for step in range(MOST_ROUNDS):
        most_now = FIRST_ANNULI * GROWTH**step

        def routed(batches: Iterator[pd.DataFrame], most_now: int = most_now) -> Iterator[pd.DataFrame]:
            """(query_id, v, annulus) of the next annuli of each query; -1 once where no annulus is left that can matter."""
            own = bounds.value
            step = max(1, BOUNDS_AT_ONCE // max(1, len(own.annulus)))
            for x in (batch.iloc[i : i + step] for batch in batches for i in range(0, len(batch), step)):
                order, best = own.order(matrix(x["v"], dims))
                worst = np.array([-b[k - 1]["less"] if len(b) >= k else -np.inf for b in x["best"]], dtype=float)
                # The k-th score as a floating-point number may be off by its last digit; an equal one may still win by its id.
                matters = best >= (worst - np.abs(np.where(np.isfinite(worst), worst, 0)) * 1e-12)[:, None]
                at = np.arange(best.shape[1])[None, :]
                met = x["met"].to_numpy()[:, None]
                now = matters & (at >= met) & (at < met + most_now)
                i, j = np.nonzero(now)
                yield pd.DataFrame({"query_id": x["query_id"].to_numpy()[i], "v": x["v"].to_numpy()[i], "annulus": own.annulus[order[i, j]].astype(np.int32)})

        # Annuli by falling bound: if the next one cannot matter, none behind it can.
        visits = written(live.repartition("query_id").mapInPandas(routed, "query_id long, v array<double>, annulus int"), "pivot-visits")
        going = visits.select("query_id").distinct()
        done.append(live.join(going, "query_id", "left_anti").select("query_id", "best"))
        if not visits.limit(1).count():
            break
        crowd = F.broadcast(visits.groupBy("annulus").agg(F.ceil(F.count(F.lit(1)) / TILE_QUERIES).cast("int").alias("cols")))
        at_home = tiled.join(crowd, "annulus").select("annulus", "tile", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v")
        asking = visits.join(parts, "annulus").join(crowd, "annulus").select(
            "annulus", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("tile"), F.pmod(F.xxhash64("query_id"), "cols").cast("int").alias("col"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "v"
        )

        def multiplied(x: pd.DataFrame) -> pd.DataFrame:
            q, own = x[x["asks"]], x[~x["asks"]]
            ids, out = own["id"].to_numpy(np.int64), []
            s = scores(matrix(own["v"], dims), matrix(q["v"], dims))
            for c, query_id in enumerate(q["id"].tolist()):
                less, other = -s[:, c], ids != query_id
                near = np.flatnonzero(other)
                if len(near) > k:
                    # All that are as good as the k-th, then by id.
                    near = near[less[near] <= np.partition(less[near], k - 1)[k - 1]]
                near = near[np.lexsort((ids[near], less[near]))[:k]]
                out.append((query_id, [{"less": int(a), "vec_id": int(b)} for a, b in zip(less[near], ids[near], strict=True)]))
            return pd.DataFrame(out, columns=["query_id", "best"])

        shape = "query_id long, best array<struct<less:long,vec_id:long>>"
        met = at_home.unionByName(asking).groupBy("annulus", "tile", "col").applyInPandas(multiplied, shape)
        found = _best(met.unionByName(live.join(going, "query_id", "left_semi").select("query_id", "best")), k)
        live = written(live.select("query_id", "v", "met").join(found, "query_id").select("query_id", "v", (F.col("met") + most_now).alias("met"), "best"), "pivot-live")
    else:
        raise RuntimeError("queries have not met all annuli")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))

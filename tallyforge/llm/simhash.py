"""SimHash near-duplicates, linked by vantage-point trees over fingerprints.

Two fingerprints of 64 bits that differ in at most 4 bits differ in at most
one bit within one of three slices of 21, 21 and 22 bits. A vantage-point
tree a slice, fitted on a bounded sample, deals the fingerprints out to leaves
by their Hamming distance in the slice. Each fingerprint is at home in one leaf
of each tree and also visits the leaves that the triangle bound cannot
exclude for distance 1, that is those across a boundary it lies next to. Within a
leaf all visitors are compared with all at home on the whole fingerprint, so
the links found are exactly the pairs within distance 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bits of the fingerprint in each slice, and by how many of them a linked pair may differ in its best slice.
SLICES = ((0, 21), (21, 21), (42, 22))
SLICE_RADIUS = RADIUS // len(SLICES)
#: Fingerprints that a tree is fitted on: so many a leaf, FIT_ROWS at least and MOST_FIT_ROWS at most; the tree only decides how rows are dealt out, never which pairs link.
FIT_ROWS, FIT_A_LEAF, MOST_FIT_ROWS = 20_000, 4, 1 << 22
LEAF_ROWS = 1_000
#: Levels at which a leaf is one value of the slice: deeper trees would divide nothing. A fingerprint then visits at most one leaf more than the slice has bits.
MOST_LEVELS = max(bits for _, bits in SLICES)
#: Fingerprints that one task deals out to leaves.
DEALT_ROWS = 20_000
#: Rows at home, and visitors, that one task compares; larger leaves are compared in tiles.
TILE_ROWS = 16_000
#: Distances that a task holds at once.
PAIRS_AT_ONCE = 1 << 18


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the whole text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half the shingles' hashes; 0 for a text without words."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry, fp): the fingerprint as a signed 64-bit number. A null text counts as empty."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", *carry, fp(text).alias("fp"))


def _slice(fps: np.ndarray, k: int) -> np.ndarray:
    start, bits = SLICES[k]
    return (fps.view(np.uint64) >> np.uint64(start)) & np.uint64((1 << bits) - 1)


def fit_tree(sample: np.ndarray, k: int, levels: int) -> list[tuple[int, int] | None]:
    """A vantage-point tree over slice k: node i has (vantage point, threshold) or None for a leaf, children 2i+1 (at most the threshold away) and 2i+2."""
    nodes: list[tuple[int, int] | None] = [None] * (2 ** (levels + 1) - 1)
    members = {0: np.unique(_slice(sample, k))}
    rng = np.random.default_rng(k)
    for i in range(2**levels - 1):
        own = members.pop(i, None)
        if own is None or len(own) < 4:
            continue
        best = None
        for v in rng.choice(own, size=min(6, len(own)), replace=False):
            d = np.bitwise_count(own ^ v).astype(int)
            # The threshold next to the median that leaves fewest members where both sides must be searched.
            for t in {int(np.median(d)), int(np.median(d)) - 1}:
                inner = int((d <= t).sum())
                if 0 < inner < len(own):
                    cost = max(inner, len(own) - inner) + int(((d == t) | (d == t + 1)).sum()) / 2
                    if best is None or cost < best[0]:
                        best = (cost, int(v), t, d <= t)
        if best is None:
            continue
        _, v, t, inner = best
        nodes[i] = (v, t)
        members[2 * i + 1], members[2 * i + 2] = own[inner], own[~inner]
    return nodes


def visits(fps: np.ndarray, k: int, nodes: list[tuple[int, int] | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows that visit it, whether each is at home there)."""
    part = _slice(fps, k)
    stack = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        i, rows, home = stack.pop()
        if not len(rows):
            continue
        node = nodes[i]
        if node is None:
            yield i, rows, home
            continue
        v, t = node
        d = np.bitwise_count(part[rows] ^ np.uint64(v)).astype(np.int64)
        inner, outer = d - SLICE_RADIUS <= t, d + SLICE_RADIUS > t
        stack.append((2 * i + 1, rows[inner], home[inner] & (d[inner] <= t)))
        stack.append((2 * i + 2, rows[outer], home[outer] & (d[outer] > t)))


def linked(home: np.ndarray, visitors: np.ndarray, home_node: np.ndarray, visitor_node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all nodes within RADIUS: a star for each group, not all its pairs."""
    nodes, place = np.unique(np.concatenate([home_node, visitor_node]), return_inverse=True)
    h, q = place[: len(home)], place[len(home) :]
    label = np.arange(len(nodes))
    step = max(1, PAIRS_AT_ONCE // max(1, len(visitors)))
    for i in range(0, len(home), step):
        near = np.bitwise_count(home[i : i + step, None] ^ visitors[None, :]) <= RADIUS
        a, b = np.nonzero(near)
        a, b = h[i + a], q[b]
        keep = a != b
        a, b = a[keep], b[keep]
        while len(a):
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
            while (label[label] != label).any():
                label = label[label]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(u, v), v < u: edges whose components are those of all pairs of distinct (node, fp) within RADIUS. n: the number of rows."""
    spark = distinct.sparkSession
    levels = int(np.clip(np.ceil(np.log2(max(1, n / LEAF_ROWS))), 0, MOST_LEVELS))
    most = int(np.clip(FIT_A_LEAF << levels, FIT_ROWS, MOST_FIT_ROWS))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(most).select("fp").toPandas()["fp"].to_numpy(np.int64)
    trees = spark.sparkContext.broadcast([fit_tree(sample, k, levels) for k in range(len(SLICES))])

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fps, node = x["fp"].to_numpy(np.int64), x["node"].to_numpy(np.int64)
            for k, nodes in enumerate(trees.value):
                for leaf, rows, home in visits(fps, k, nodes):
                    yield pd.DataFrame({"leaf": np.full(len(rows), k << (MOST_LEVELS + 2) | leaf, np.int32), "home": home, "node": node[rows], "fp": fps[rows]})

    spread = distinct.repartition(max(spark.sparkContext.defaultParallelism, n // DEALT_ROWS), "fp")
    routed = written(spread.mapInPandas(dealt, "leaf int, home boolean, node long, fp long"), "simhash-leaves")
    # A leaf is a tree node, so this table is no larger than the trees are.
    sizes = F.broadcast(
        routed.groupBy("leaf").agg(F.sum(F.col("home").cast("long")).alias("at_home"), F.count(F.lit(1)).alias("all"))
        .select("leaf", F.ceil(F.col("at_home") / TILE_ROWS).cast("int").alias("rows"), F.ceil(F.col("all") / TILE_ROWS).cast("int").alias("cols"))
        .filter("rows > 0")
    )
    row, col = F.pmod(F.xxhash64("fp"), F.greatest("rows", F.lit(1))), F.pmod(F.xxhash64("fp", F.lit(1)), F.greatest("cols", F.lit(1)))
    tiled = routed.join(sizes, "leaf")
    at_home = tiled.filter("home").select("leaf", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(True).alias("home"), "node", "fp")
    visiting = tiled.select("leaf", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), col.alias("j"), F.lit(False).alias("home"), "node", "fp")

    def compared(x: pd.DataFrame) -> pd.DataFrame:
        home = x["home"].to_numpy(bool)
        fp, node = x["fp"].to_numpy(np.int64).view(np.uint64), x["node"].to_numpy(np.int64)
        u, v = linked(fp[home], fp[~home], node[home], node[~home])
        return pd.DataFrame({"u": u, "v": v})

    tiles = at_home.select("leaf", F.col("i").cast("long"), F.col("j").cast("long"), "home", "node", "fp").unionByName(visiting.select("leaf", F.col("i").cast("long"), F.col("j").cast("long"), "home", "node", "fp"))
    return tiles.groupBy("leaf", "i", "j").applyInPandas(compared, "u long, v long").distinct()


def components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (u, v), for every node with an edge but the smallest of each component.

    Alternates large-star and small-star contraction, which halve paths, until
    nothing changes; each round is checkpointed. A star's centre gathers its
    minimum by partial aggregation. Rather than lose a link, it raises an error
    if it has not ended after most_rounds, far more than halving can need.
    """
    e = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # Large star: each larger neighbour of c points to c's smallest neighbour.
        large = e.join(low, e["v"] == low["c"]).select("u", F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node's smaller neighbours, and itself, point to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, large["u"] == low["c"]).select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = checkpointed(small.select(F.col("x.a").alias("u"), F.col("x.b").alias("v")).filter("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled within {most_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Rows with a null text count as empty; texts without words have the
    fingerprint zero and are linked like any other; repeated ids keep their rows.
    Rows with a null id get their fingerprint and a null component_id where no
    id stands beside them. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, text), "simhash")
    # Copies share a fingerprint and stand behind one node: the smallest id that has it.
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"))
    found = components(links(distinct, distinct.count()))
    classes = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def groups(docs: DataFrame, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """(doc_id, carry, component) for every row: the smallest fingerprint that is reachable from the row's own, whatever ids stand there, null or repeated."""
    fps = written(fingerprints(docs, text, carry), "simhash")
    distinct = checkpointed(fps.select("fp").distinct().select(F.col("fp").alias("node"), "fp"))
    found = components(links(distinct, distinct.count()))
    return fps.join(found, fps["fp"] == found["node"], "left").select("doc_id", *carry, F.coalesce("component", "fp").alias("component"))

"""A trie of the turns of conversations, built level by level.

At each depth the conversations that still share a node are grouped by (parent
node, next turn), and the smallest conv_id of a group names its node. A conversation
leaves once all that share its node are equal to the end: what follows is a chain, which
needs no more levels. So there are as many levels as the longest prefix that
two different conversations share. Then leaves and savings go up by joins, level by level in reverse.

Equal conversations are one class from the start; a turn is its digest and its size from then on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A conversation c starts with the first crc32(c) % MOST_HEAD turns of conversation c - c % FAMILY.
FAMILY, MOST_HEAD = 5, 9
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
#: Ids that one row of a class's members holds, and turns of which one row holds the sum.
IDS_A_BLOCK, TURNS_A_BLOCK = 1024, 4096


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, idx, digest, size): turns of each conversation numbered from 1 in the order of turn (null first), role and text.

    The turns are sorted by ranges, within which they are numbered in passing; a conversation
    that goes on over several ranges is offset by what lies before. So a
    conversation of any length is dealt out over many tasks, repeated rows by a row number.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.filter("conv_id is not null").select(
        "conv_id", F.col("turn").alias("_t"), role.alias("_r"), F.sha2(whole, 256).alias("digest"), F.octet_length(text).cast("long").alias("size"), text.alias("_x"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("_s")
    )
    order = [F.col("conv_id"), F.asc_nulls_first("_t"), F.col("_r"), F.col("_x"), F.col("_s")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "size", F.spark_partition_id().alias("part"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, so_far = None, 0
        for x in batches:
            if not len(x):
                continue
            at = x.groupby("conv_id", sort=False).cumcount() + 1
            if last is not None:
                at = at.where(x["conv_id"] != last, at + so_far)
            last, so_far = x["conv_id"].iloc[-1], int(at.iloc[-1])
            yield x.assign(at=at.astype("int64"))

    local = written(ranged.mapInPandas(number, "conv_id long, digest string, size long, part int, at long"), "trie-numbered")
    held = local.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    # Only the first and the last conversation of a range can go on elsewhere: at most two rows a range.
    split = held.join(held.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("conv_id"), "conv_id", "left_semi")
    before = split.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    return local.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("idx"), "digest", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id), (conv_id, pos, digest, size)): every conversation and its rebuilt turns, numbered from 1 without gaps."""
    rows = written(numbered(turns), "trie-turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_HEAD))
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    lengths = rows.groupBy("conv_id").agg(F.max("idx").alias("n"))
    convs = lengths.select("conv_id", base, h.alias("h"))
    heads = lengths.select(F.col("conv_id").alias("base"), F.least("n", F.lit(MOST_HEAD - 1)).alias("most"))
    convs = written(convs.join(heads, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("most", F.lit(0))).alias("k")), "trie-convs")
    lent = convs.filter("k > 0").join(rows.filter((F.col("idx") < MOST_HEAD) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base"), "base").filter("idx <= k").select("conv_id", F.col("idx").alias("pos"), "digest", "size")
    own = rows.filter(F.col("idx") > h).join(convs.select("conv_id", "h", "k"), "conv_id").select("conv_id", (F.col("idx") - F.col("h") + F.col("k")).alias("pos"), "digest", "size")
    return convs.select("conv_id"), written(lent.unionByName(own), "trie-rebuilt")


def _whole() -> list[Column]:
    """A digest of a set of (pos, digest) that is put together in any order, so that no conversation has to lie in one task."""
    each = F.sha2(F.concat_ws(":", "pos", "digest"), 256)
    return [F.bit_xor(F.conv(F.substring(each, 16 * i + 1, 15), 16, 10).cast("long")).alias(f"w{i}") for i in range(4)]


def members_hash(members: DataFrame) -> DataFrame:
    """(rep, ends): SHA-256 of each class's conv_ids in ascending order, comma-joined.

    Ids are joined in blocks of a thousand by many tasks. The hash itself can only be taken
    in one go; a class's blocks stream through it, in order.
    """
    block = F.floor(F.col("conv_id") / IDS_A_BLOCK)
    blocks = members.groupBy("rep", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for x in batches:
            done = []
            for rep, ids in zip(x["rep"].tolist(), x["ids"], strict=True):
                if rep == now:
                    h.update(b"," + ids.encode())
                    continue
                if h is not None:
                    done.append((now, h.hexdigest()))
                now, h = rep, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["rep", "ends"]).astype({"rep": "int64"})
        if h is not None:
            yield pd.DataFrame([(now, h.hexdigest())], columns=["rep", "ends"])

    return blocks.repartition("rep").sortWithinPartitions("rep", "block").select("rep", "ids").mapInPandas(hashed, "rep long, ends string")


def classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(rep, n, length, ends): each distinct rebuilt conversation, named by its smallest conv_id."""
    whole = [f"w{i}" for i in range(4)]
    digests = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"), *_whole())
    each = written(convs.join(digests, "conv_id", "left").na.fill(0, ["length", *whole]), "trie-digests")
    grouped = written(each.groupBy("length", *whole).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n")), "trie-classes")
    several = each.join(grouped.filter("n > 1").select("length", *whole, "rep"), ["length", *whole]).select("rep", "conv_id")
    return written(grouped.join(members_hash(several), "rep", "left").select("rep", "n", "length", F.coalesce("ends", F.sha2(F.col("rep").cast("string"), 256)).alias("ends")), "trie-class-ends")


def _chains(left: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the classes (rep, n, length, ends, depth) from depth on, each the only child of the one before."""
    rows = left.join(turns.withColumnRenamed("conv_id", "rep"), "rep").filter("pos >= depth").select("rep", "n", "length", "ends", "depth", "pos", "size")
    # What is saved is a sum over the rest of the chain: sums of blocks first, then within blocks. Where one conversation stands, nothing is.
    shared = rows.filter("n > 1").withColumn("block", F.floor(F.col("pos") / TURNS_A_BLOCK))
    totals = shared.groupBy("rep", "block").agg(F.sum("size").alias("s"))
    behind = totals.select("rep", "block", (F.sum("s").over(Window.partitionBy("rep").orderBy(F.desc("block"))) - F.col("s")).alias("behind"))
    rest = F.sum("size").over(Window.partitionBy("rep", "block").orderBy(F.desc("pos")))
    summed = shared.withColumn("_rest", rest).join(behind, ["rep", "block"]).select("rep", "n", "length", "ends", "depth", "pos", ((F.col("n") - 1) * (F.col("_rest") + F.col("behind"))).alias("saved"))
    alone = rows.filter("n = 1").select("rep", "n", "length", "ends", "depth", "pos", F.lit(0).cast("long").alias("saved"))
    last = F.col("pos") == F.col("length")
    return summed.unionByName(alone).select(
        F.col("rep").alias("node"), F.col("pos").alias("at"), F.col("rep").alias("parent"), "n", F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved",
        F.when(last, F.col("ends")).otherwise(F.lit(NO_MEMBERS)).alias("ends"), (F.col("pos") == F.col("depth")).alias("top"),
    )


def _rolled_up(levels: list[DataFrame], tops: DataFrame) -> list[DataFrame]:
    """The nodes of each shared level with children, leaves and savings; levels[d] has those of depth d, tops the first nodes of all chains."""
    out: list[DataFrame] = []
    below: DataFrame | None = None
    for d in reversed(range(len(levels))):
        children = tops.filter(F.col("at") == d + 1).select("parent", "n_leaves", "saved")
        if below is not None:
            children = children.unionByName(below.select("parent", "n_leaves", "saved"))
        up = children.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        rolled = levels[d].join(up, "node", "left").select(
            "node", F.lit(d).cast("long").alias("at"), "parent", "n", F.coalesce("c", F.lit(0)).alias("n_children"), F.coalesce("l", F.lit(1)).alias("n_leaves"), ((F.col("n") - 1) * F.col("size") + F.coalesce("s", F.lit(0))).alias("saved"), "ends",
        )
        below = written(rolled, "trie-rolled")
        out.append(below)
    return out


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A null role or text is empty; a null turn comes first; turns that tie are ordered by role and
    text, and repeated rows are turns of their own. Rows with a null conv_id belong to no
    conversation and are left out. An empty table gives an empty result, without a root.
    Columns other than conv_id, turn, role and text are not looked at.
    """
    convs, rows = rebuilt(turns.select("conv_id", "turn", "role", "text"))
    known = classes(convs, rows)
    # Sorted by depth, so that a level reads its own turns only.
    own = rows.join(known.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
    reps = written(own.repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"), "trie-reps")
    # Depth 0: all classes stand in the root, whose name is the smallest conv_id of all.
    root = known.agg(F.min("rep")).first()[0]
    live = known.withColumn("node", F.lit(root).cast("long"))
    level = known.agg(F.lit(root).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("size"), F.sum("n").alias("n")).filter("n is not null")
    levels, tops, d = [], [], 0
    while True:
        # A class that ends here is the node's own; there is one at most.
        own = live.filter(F.col("length") == d).select("node", "ends")
        levels.append(level.join(own, "node", "left").select("node", "parent", "size", "n", F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends")))
        d += 1
        on = live.filter(F.col("length") >= d).withColumnRenamed("node", "parent").join(reps.filter(F.col("pos") == d).select(F.col("conv_id").alias("rep"), "digest", "size"), "rep")
        nodes = on.groupBy("parent", "digest").agg(F.min("rep").alias("node"), F.count(F.lit(1)).alias("n_classes"))
        placed = written(on.join(nodes, ["parent", "digest"]).select("rep", "n", "length", "ends", "parent", "node", "n_classes", "size"), "trie-live")
        shared = placed.filter("n_classes > 1")
        tops.append(placed.filter("n_classes = 1").select("rep", "n", "length", "ends", "parent", F.lit(d).cast("long").alias("depth")))
        if not shared.limit(1).count():
            break
        live = shared.select("rep", "n", "length", "ends", "node")
        level = shared.groupBy("node", "parent", "size").agg(F.sum("n").alias("n"))
    left = tops[0]
    for t in tops[1:]:
        left = left.unionByName(t)
    left = written(left, "trie-left")
    chains = written(_chains(left.drop("parent"), reps), "trie-chains")
    # A chain hangs from the node in which its class still had company.
    first = left.select(F.col("rep").alias("node"), F.col("parent").alias("_p"))
    chains = chains.join(first, "node").withColumn("parent", F.when(F.col("top"), F.col("_p")).otherwise(F.col("parent"))).drop("_p")
    out = chains.drop("top")
    for x in _rolled_up(levels, written(chains.filter("top"), "trie-tops")):
        out = out.unionByName(x)
    return out.select(
        F.col("node").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").cast("long").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved").cast("long").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )

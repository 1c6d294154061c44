"""Merkle fixity audit of WARC files kept as replicas.

A record's bytes are hashed into a leaf; runs of FANOUT leaves, in offset
order, are hashed into the nodes above until one root a file is left. Each
replica has a tree of its own. The audit compares roots first and then reads only
the children of nodes that differ, so a clean file costs one comparison and a
damaged record is found in as many steps as the tree has levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 16
#: Records of a file whose offsets are summed up together before the scan over the file's blocks.
SCAN_RECORDS = 4096
# What begins a record, and what ends it.
MARKER, END = "WARC/1.1\r\n", "\r\n\r\n"


def warc_record(url: Column, body: Column) -> Column:
    """A WARC/1.1 response record around the body, as text; a null body is empty, a null url too."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    return F.concat(
        F.lit(f"{MARKER}WARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit(END),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Writes (file, seq, record) as WARC files, one folder a file, in the order of seq; each record ends as warc_record ends it."""
    bare = F.expr(f"substring(record, 1, length(record) - {len(END)})")
    ordered = records.select("file", "seq", bare.alias("value")).repartition("file").sortWithinPartitions("file", "seq")
    ordered.select("file", "value").write.partitionBy("file").option("lineSep", END).text(path)


def _folder(spark: SparkSession, path: str) -> str:
    """The path part of a replica's folder, as file paths begin with it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getRawPath().rstrip("/") + "/"


def read_warc(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(file, seq, offset, n_bytes, record_id, record) of uncompressed WARC/1.1 files below the folder path: their records as bytes, in order.

    file is relative to the folder, so that replicas in two folders have the same files. Empty files, and files
    without a record, have no rows.

    Files are cut into splits, and records found by their first line, so no
    file goes through one task; a payload that holds such a line makes two
    leaves, which changes nothing for the audit. What stands before a file's first
    record is passed over but counted in the offsets. record_id is the record's
    URI. seq and offset come from a prefix scan over the splits.
    """
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        lines = spark.read.option("lineSep", MARKER).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
        lines = written(lines.withColumn("size", F.octet_length("value").cast("long")), "warc-lines")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    within, across = Window.partitionBy("path", "split").orderBy("line"), Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # Every line but a file's first has lost a marker in front of it.
    sums = lines.groupBy("path", "split").agg(F.sum(F.col("size") + len(MARKER)).alias("bytes"), F.count(F.lit(1)).alias("n"))
    starts = sums.select("path", "split", F.coalesce(F.sum("bytes").over(across), F.lit(0)).alias("from"), F.coalesce(F.sum("n").over(across), F.lit(0)).alias("seq0"))
    x = lines.join(starts, ["path", "split"])
    x = x.withColumn("at", F.col("from") + F.sum(F.col("size") + len(MARKER)).over(within) - F.col("size") - len(MARKER)).withColumn("seq", F.col("seq0") + F.row_number().over(within) - 2)
    record = F.concat(F.lit(MARKER).cast("binary"), F.col("value").cast("binary"))
    folder = _folder(spark, path)
    place = F.instr("path", folder)
    file = F.when(place > 0, F.substr(F.col("path"), place + len(folder))).otherwise(F.substring_index("path", "/", -1))
    uri = F.nullif(F.regexp_extract("value", r"(?m)^WARC-Target-URI: ([^\r\n]*)", 1), F.lit(""))
    # The first line of a file is what stands before its first marker; offsets are of the markers.
    return x.filter("seq >= 0").select(file.alias("file"), "seq", (F.col("at") - len(MARKER)).alias("offset"), (F.col("size") + len(MARKER)).alias("n_bytes"), uri.alias("record_id"), record.alias("record"))


def with_offsets(records: DataFrame, block: int = SCAN_RECORDS) -> DataFrame:
    """Adds offset, the bytes before each record (file, seq, n_bytes): sums over blocks of records, a scan over a file's blocks, a scan within each block."""
    x = records.withColumn("_b", F.floor(F.col("seq") / block))
    across, within = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file", "_b").orderBy("seq", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy("file", "_b").agg(F.sum("n_bytes").alias("_n")).select("file", "_b", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_from"))
    return x.join(sums, ["file", "_b"]).withColumn("offset", F.col("_from") + F.coalesce(F.sum("n_bytes").over(within), F.lit(0))).drop("_b", "_from")


def leaves(records: DataFrame) -> DataFrame:
    """(file, idx, record_id, hash, n_bytes): one leaf a record. Lost records (null) and those without a file or a position have none."""
    have = records.filter(F.col("record").isNotNull() & F.col("file").isNotNull() & F.col("seq").isNotNull())
    return have.select("file", F.col("seq").alias("idx"), "record_id", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("n_bytes"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above: each node hashes its children's hashes in order, and sums their bytes. A group has at most fanout children, where positions are not shared."""
    return (
        nodes.groupBy("file", F.floor(F.col("idx") / fanout).alias("idx"))
        .agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids"), F.sum("n_bytes").alias("n_bytes"))
        .select("file", "idx", F.sha2(F.concat_ws(",", F.col("kids.hash")), 256).alias("hash"), "n_bytes")
    )


def tree(leaf: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels 0 (leaves, as given) to levels (roots), each written."""
    out = [leaf]
    for k in range(levels):
        out.append(written(parents(out[-1], fanout), f"fixity-level-{k + 1}"))
    return out


def audit_replicas(first: DataFrame, second: DataFrame, levels: int = 1, fanout: int = FANOUT) -> DataFrame:
    """Replicas as (file, seq, record_id, record): one row a file of either, of any number of records.

    levels is the least height of the trees; it grows until the largest seq of
    either replica leaves one root a file. A record that one replica lacks, or has
    as null, is lost there, which an empty record is not; a file that one replica lacks
    has a null root there. Records that share a position are told apart by their id;
    repeats of one id there stand together. Rows without a file or a position are in no
    tree. Empty tables give an empty result; further columns are ignored.

    Files whose roots agree have no damage; for the others the differing branches are
    followed down to the leaves. Returns file, n_records and n_bytes (of the first replica, 0
    where it lacks the file), root_a, root_b, n_nodes_compared, n_corrupt and corrupt_ids (record ids joined
    by commas in offset order; at most one file's records stand in a row).
    """
    a0, b0 = (written(leaves(r), "fixity-leaves") for r in (first, second))
    last = max(x.agg(F.max("idx")).first()[0] or 0 for x in (a0, b0))
    while fanout**levels <= last:
        levels += 1
    a, b = tree(a0, levels, fanout), tree(b0, levels, fanout)

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.select("file", "idx", F.col("hash").alias("a")).join(y.select("file", "idx", F.col("hash").alias("b")), ["file", "idx"], "full")

    roots = written(joined(a[-1], b[-1]), "fixity-roots")
    compared = [roots.select("file")]
    differs = roots.filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", "idx")
    below = lambda x, d: x.withColumn("up", F.floor(F.col("idx") / fanout)).join(d.withColumnRenamed("idx", "up"), ["file", "up"], "left_semi").drop("up")
    for k in range(levels - 1, 0, -1):
        kids = written(joined(below(a[k], differs), below(b[k], differs)), "fixity-branches")
        compared.append(kids.select("file"))
        differs = kids.filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", "idx")
    # Leaves: repeats of one id at one position are one leaf with all their hashes.
    sides = [below(x, differs).groupBy("file", "idx", "record_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("hash"))).alias(n)) for x, n in ((a0, "a"), (b0, "b"))]
    y = sides[1].select(*(F.col(c).alias(f"_{c}") for c in ("file", "idx", "record_id")), "b")
    same = (sides[0]["file"] == y["_file"]) & (sides[0]["idx"] == y["_idx"]) & sides[0]["record_id"].eqNullSafe(y["_record_id"])
    found = written(sides[0].join(y, same, "full").select(F.coalesce("file", "_file").alias("file"), F.coalesce("idx", "_idx").alias("idx"), F.coalesce("record_id", "_record_id").alias("record_id"), "a", "b"), "fixity-damage")
    compared.append(found.select("file"))
    n_compared = compared[0]
    for x in compared[1:]:
        n_compared = n_compared.unionByName(x)
    bad = (
        found.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("file")
        .agg(F.count(F.lit(1)).alias("n_corrupt"), F.array_sort(F.collect_list(F.struct("idx", "record_id"))).alias("ids"))
        .select("file", "n_corrupt", F.concat_ws(",", F.transform("ids", lambda x: x["record_id"].cast("string"))).alias("corrupt_ids"))
    )
    counts = a0.groupBy("file").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_bytes").alias("n_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        roots.select("file", F.col("a").alias("root_a"), F.col("b").alias("root_b"))
        .join(n_compared.groupBy("file").agg(F.count(F.lit(1)).alias("n_nodes_compared")), "file")
        .join(counts, "file", "left").join(bad, "file", "left")
        .select("file", zero("n_records"), zero("n_bytes"), "root_a", "root_b", "n_nodes_compared", zero("n_corrupt"), F.coalesce("corrupt_ids", F.lit("")).alias("corrupt_ids"))
    )


def ranged_leaves(records: DataFrame, levels: int, fanout: int = FANOUT, block: int = SCAN_RECORDS) -> DataFrame:
    """(file, seq, record_id, n, hash, n_bytes, r1 ... r<levels>): leaves with the ordered ranges of offsets that they lie in at each level.

    A range of level k begins at a record whose id hashes to a multiple of fanout^k, and is named by that id; the
    first range of a file has the empty name. So ranges follow the records, not their numbers: a record that is lost or put in changes the
    range that it stands in, and no later one. n tells repeats of an id in a file apart. Names are carried on over a file's blocks of records first, then within blocks.
    """
    have = records.filter(F.col("record").isNotNull() & F.col("file").isNotNull() & F.col("seq").isNotNull())
    x = have.select("file", F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("record_id").cast("string"), F.lit("")).alias("record_id"), F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("n_bytes"))
    x = x.withColumn("_b", F.floor(F.col("seq") / block))
    names = [f"r{k}" for k in range(1, levels + 1)]
    x = x.withColumns({r: F.when(F.pmod(F.xxhash64("record_id"), F.lit(fanout**k)) == 0, F.col("record_id")) for k, r in enumerate(names, 1)})
    x = written(x, "fixity-marked")
    ends = x.groupBy("file", "_b").agg(*(F.max_by(r, F.when(F.col(r).isNotNull(), F.col("seq"))).alias(r) for r in names))
    across = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("file", "_b", *(F.last(r, ignorenulls=True).over(across).alias(f"_{r}") for r in names))
    within = Window.partitionBy("file", "_b").orderBy("seq", "record_id", "hash")
    y = x.join(before, ["file", "_b"]).withColumns({r: F.coalesce(F.last(r, ignorenulls=True).over(within), F.col(f"_{r}"), F.lit("")) for r in names})
    # Repeats of an id are told apart by their order; they stand in one group, as large as the id is often.
    return y.withColumn("n", F.row_number().over(Window.partitionBy("file", "record_id").orderBy("seq", "hash"))).select("file", "seq", "record_id", "n", "hash", "n_bytes", *names)


def audit_files(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Replicas as read_warc reads them: file, n_records, n_bytes (of the first), root_a, root_b, n_nodes_compared, n_corrupt and corrupt_ids, one row a file of either.

    The trees are over ranges of offsets that begin at chosen records (ranged_leaves): roots are compared, then only the ranges within
    those that differ, then their records by id. A record that one replica has lost, or has twice, is one damaged record,
    wherever it stood, and a file that one replica lacks has a null root there. Rows without a file or a position are in no tree; a null id is the
    empty one. Empty replicas give an empty result.
    """
    size = max(x.filter(F.col("file").isNotNull()).agg(F.max("seq")).first()[0] or 0 for x in (first, second))
    levels = 1
    while fanout ** (levels + 1) <= size:
        levels += 1
    names = [f"r{k}" for k in range(1, levels + 1)]
    a0, b0 = (written(ranged_leaves(x, levels, fanout), "fixity-ranges") for x in (first, second))

    def trees(leaf: DataFrame) -> list[DataFrame]:
        """Level 1 to the roots: (file, the ranges at this level and above, hash, at). A node's hash is over its children's in order."""
        out, below = [], leaf.select("file", *names, F.col("seq").alias("at"), F.sha2(F.concat_ws(":", "record_id", "hash"), 256).alias("hash"))
        for k in range(levels + 1):
            kids = F.array_sort(F.collect_list(F.struct("at", "hash")))
            below = written(below.groupBy("file", *names[k:]).agg(F.sha2(F.concat_ws(",", F.transform(kids, lambda c: c["hash"])), 256).alias("hash"), F.min("at").alias("at")), "fixity-nodes")
            out.append(below)
        return out

    a, b = trees(a0), trees(b0)
    compared, differs = [], None
    for k in range(levels, -1, -1):
        key = ["file", *names[k:]]
        x, y = a[k], b[k]
        if differs is not None:
            x, y = (t.join(differs, key[:1] + key[2:], "left_semi") for t in (x, y))
        kids = written(x.select(*key, F.col("hash").alias("a")).join(y.select(*key, F.col("hash").alias("b")), key, "full"), "fixity-branches")
        if differs is None:
            roots = kids
        compared.append(kids.select("file"))
        differs = kids.filter(~F.col("a").eqNullSafe(F.col("b"))).select(*key)
    # A range that only one replica has is part of another in the other replica, which differs too: records are compared over all ranges that differ.
    sides = [t.join(differs, ["file", *names], "left_semi").select("file", "record_id", "n", F.col("seq").alias(f"seq_{s}"), F.col("hash").alias(s)) for t, s in ((a0, "a"), (b0, "b"))]
    found = written(sides[0].join(sides[1], ["file", "record_id", "n"], "full"), "fixity-damage")
    compared.append(found.select("file"))
    every = compared[0]
    for c in compared[1:]:
        every = every.unionByName(c)
    bad = (
        found.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("file")
        .agg(F.count(F.lit(1)).alias("n_corrupt"), F.array_sort(F.collect_list(F.struct(F.coalesce("seq_a", "seq_b").alias("at"), "record_id"))).alias("ids"))
        .select("file", "n_corrupt", F.concat_ws(",", F.transform("ids", lambda i: i["record_id"])).alias("corrupt_ids"))
    )
    counts = a0.groupBy("file").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_bytes").alias("n_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        roots.select("file", F.col("a").alias("root_a"), F.col("b").alias("root_b")).join(every.groupBy("file").agg(F.count(F.lit(1)).alias("n_nodes_compared")), "file")
        .join(counts, "file", "left").join(bad, "file", "left")
        .select("file", zero("n_records"), zero("n_bytes"), "root_a", "root_b", "n_nodes_compared", zero("n_corrupt"), F.coalesce("corrupt_ids", F.lit("")).alias("corrupt_ids"))
    )


def audit(pairs: DataFrame, levels: int = 1, fanout: int = FANOUT) -> DataFrame:
    """audit_replicas of pairs (file, seq, record_id, record_a, record_b), where both replicas of a record stand in one row."""
    one = lambda s: pairs.select("file", "seq", "record_id", F.col(f"record_{s}").alias("record"))
    return audit_replicas(one("a"), one("b"), levels, fanout)

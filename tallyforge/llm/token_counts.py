"""Token counts from flat token files without an index.

A flat file is one long run of token ids in shared storage, each document closed
by an end-of-document id. It is cut into blocks of fixed size that know nothing of
documents, and every task reads the byte range of its blocks. Each block is searched
for the closing id at once; a prefix scan over the blocks' totals, in two steps,
then numbers the documents and joins the tail of one block to the head of the next.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

BLOCK_TOKENS = 1 << 18
#: Blocks whose totals are put together before the scan over a file.
SCAN_BLOCKS = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
#: The vocabulary's own way to cut a text before merging: a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once a worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def file_system(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def checked_end(codec, end: int) -> None:
    """A closing id that the vocabulary uses for text would cut documents in two."""
    if end < codec.n_vocab and end in codec._mergeable_ranks.values():
        raise ValueError(f"id {end} is a token of the vocabulary and cannot close documents")


def flat_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Tokenizes documents into flat files in the folder, one a task, of uint16 ids (uint32 where the vocabulary needs them).

    Returns (file, path, width, n_tokens, doc_id, ordinal): which document is the file's n-th, and once a
    file (doc_id and ordinal null) its path, the bytes of an id and its length. A task that is run again writes
    another file: only the paths in the result count. Null texts count as empty: they have
    the closing id only. A closing id that is a token raises an error.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        file, ordinal, n_tokens = TaskContext.get().partitionId(), 0, 0
        codec = encoder(tokenizer)
        checked_end(codec, end)
        dtype = np.dtype("<u2" if max(codec.n_vocab, end + 1) <= 1 << 16 else "<u4")
        where, path = file_system(f"{folder}/{file:05d}-{uuid.uuid4().hex}.bin")
        with where.open_output_stream(path) as out:
            for x in batches:
                yield pd.DataFrame({"file": file, "path": None, "width": None, "n_tokens": None, "doc_id": x["doc_id"], "ordinal": np.arange(ordinal, ordinal + len(x))})
                ordinal += len(x)
                for t in x["text"]:
                    ids = np.array([*codec.encode_ordinary(t if isinstance(t, str) else ""), end], dtype)
                    out.write(ids.tobytes())
                    n_tokens += len(ids)
        yield pd.DataFrame({"file": [file], "path": [path], "width": [dtype.itemsize], "n_tokens": [n_tokens], "doc_id": [None], "ordinal": [None]})

    where, path = file_system(folder)
    where.create_dir(path, recursive=True)
    return docs.select("doc_id", "text").mapInPandas(encoded, "file int, path string, width int, n_tokens long, doc_id long, ordinal long")


def file_blocks(files: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, path, width, block, at, n): the files (file, path, width, n_tokens) cut into blocks, spread over the tasks."""
    n = F.ceil(F.col("n_tokens") / block_tokens)
    x = files.filter("n_tokens > 0").select("file", "path", "width", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    at = F.col("block") * block_tokens
    cut = x.select("file", "path", "width", "block", at.alias("at"), F.least(F.lit(block_tokens).cast("long"), F.col("n_tokens") - at).alias("n"))
    return cut.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file", "block")


def _searched(ids: np.ndarray, end: int) -> tuple[int, int, int, list[int]]:
    at = np.flatnonzero(ids == end)
    return len(at), int(at[0]) if len(at) else len(ids), int(len(ids) - at[-1] - 1) if len(at) else len(ids), (np.diff(at) - 1).tolist()


_SCANNED = "file int, block long, n_ends long, head long, tail long, inner array<long>"


def scanned_files(blocks: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, block, n_ends, head, tail, inner): one read of its bytes and one vectorised search a block.

    head: tokens before the first closing id (all, if none); tail: tokens after the last;
    inner: lengths of the documents that lie within the block from end to end.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for file, path, width, block, at, n in zip(*(x[c].tolist() for c in ("file", "path", "width", "block", "at", "n")), strict=True):
                where, inside = file_system(path)
                with where.open_input_file(inside) as f:
                    raw = f.read_at(n * width, at * width)
                rows.append((file, block, *_searched(np.frombuffer(raw, f"<u{width}"), end)))
            yield pd.DataFrame(rows, columns=["file", "block", "n_ends", "head", "tail", "inner"])

    return blocks.mapInPandas(scan, _SCANNED)


def scanned(blocks: DataFrame, end: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """scanned_files for blocks whose bytes are in a column: (file, block, data)."""

    @F.pandas_udf("n_ends long, head long, tail long, inner array<long>")
    def scan(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_searched(np.frombuffer(b or b"", dtype), end) for b in data], columns=["n_ends", "head", "tail", "inner"])

    return blocks.select("file", "block", scan("data").alias("s")).select("file", "block", "s.*")


def _carried(s: DataFrame, within: list[str], order: str) -> DataFrame:
    """Adds first (closing ids in the rows before), carried (tokens after the last of them) and closed (whether there is any)."""
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # Rows without a closing id add their whole length to a document that began before: a running
    # total of them, less its value at the last row that has one, is what they add.
    plain = F.coalesce(F.sum(F.when(F.col("n_ends") == 0, F.col("tail")).otherwise(F.lit(0))).over(before), F.lit(0))
    s = s.withColumns({"first": F.coalesce(F.sum("n_ends").over(before), F.lit(0)), "_plain": plain})
    last = F.last(F.when(F.col("n_ends") > 0, F.struct("tail", "_plain")), ignorenulls=True).over(before)
    s = s.withColumn("_last", last)
    return s.withColumns({"carried": F.coalesce(F.col("_last.tail"), F.lit(0)) + F.col("_plain") - F.coalesce(F.col("_last._plain"), F.lit(0)), "closed": F.col("_last").isNotNull()}).drop("_plain", "_last")


def counted(found: DataFrame, group: int = SCAN_BLOCKS) -> DataFrame:
    """(file, ordinal, n_tokens) from scanned blocks.

    The prefix scan runs over the blocks' totals alone, within groups of blocks and then
    over the groups; the lengths inside a block join it again afterwards.
    """
    totals = found.select("file", "block", F.floor(F.col("block") / group).alias("_g"), "n_ends", "head", "tail")
    inner = _carried(totals, ["file", "_g"], "block")
    after = F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail"))
    groups = inner.groupBy("file", "_g").agg(F.sum("n_ends").alias("n_ends"), F.max_by(after, "block").alias("tail"))
    outer = _carried(groups, ["file"], "_g").select("file", "_g", F.col("first").alias("_first"), F.col("carried").alias("_carried"))
    placed = inner.join(outer, ["file", "_g"]).filter("n_ends > 0").select(
        "file", "block", (F.col("first") + F.col("_first")).alias("first"),
        (F.col("head") + F.col("carried") + F.when(F.col("closed"), F.lit(0)).otherwise(F.col("_carried"))).alias("n_head"),
    )
    return (
        found.select("file", "block", "inner").join(placed, ["file", "block"])
        .select("file", "first", F.posexplode(F.concat(F.array("n_head"), F.col("inner"))).alias("k", "n_tokens"))
        .select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")
    )


def token_counts(blocks: DataFrame, end: int = END_OF_DOCUMENT, dtype: str = "<u2", group: int = SCAN_BLOCKS) -> DataFrame:
    """(file, ordinal, n_tokens) for each document of flat files given as (file, block, data), closing ids not counted.

    Blocks are numbered from 0 in the file's order. Tokens after a file's last
    closing id belong to no document. Blocks without data have no tokens; an
    empty table gives an empty result; further columns are ignored.
    """
    return counted(scanned(blocks, end, dtype), group)


def file_token_counts(files: DataFrame, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS, group: int = SCAN_BLOCKS) -> DataFrame:
    """token_counts for files (file, path, width, n_tokens) in shared storage, read by ranges. Empty files have no documents."""
    return counted(written(scanned_files(file_blocks(files, block_tokens), end), "token-blocks"), group)


def files_below(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """Flat files of a folder as file_token_counts takes them; only their names and sizes are read."""
    listed = spark.read.format("binaryFile").load(folder).select("path", "length")
    return listed.select(F.dense_rank().over(Window.orderBy("path")).cast("int").alias("file"), "path", F.lit(width).alias("width"), F.floor(F.col("length") / width).alias("n_tokens"))


def document_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(doc_id, file, ordinal, n_tokens): documents written to flat files, then counted from the files alone."""
    spark = docs.sparkSession
    flat = written(flat_files(docs, f"{shared_dir(spark)}/flat-tokens-{uuid.uuid4().hex}", tokenizer, end), "flat-token-files")
    counts = file_token_counts(flat.filter("path is not null").select("file", "path", "width", "n_tokens"), end)
    return flat.filter("ordinal is not null").select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")

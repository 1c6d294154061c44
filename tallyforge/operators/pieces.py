"""Which pieces of texts may be the ends of words of a long list: hashes in Arrow batches, and a sketch of all ends.

An end is a word's last bytes, as many as the greatest power of two that it is long; two strings of valid UTF-8 contain one
another by letters as they do by bytes. The hash of a piece is made from those of its halves, so all pieces of a
batch's texts are hashed together, as arrays. The sketch, a Bloom filter with the bits of one end in one word, grows with
the list up to a fixed size; a full one lets more pieces through and loses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sketch has 2^22 words of 64 bits at most (32 MB), some bits of one word an end, and is made in 2^6 parts.
MOST_WORD_BITS, PART_BITS, END_BITS = 22, 6, 4


def _hashes(data: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes) for n = 1, 2, 4 ... most: of the n bytes that begin at each place of data."""
    h, n = (data + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    h ^= h >> np.uint64(32)
    while True:
        yield n, h
        if 2 * n > most or len(h) <= n:
            return
        left, h = h, h[:-n] * np.uint64(0xD6E8FEB86659FD93)
        h += left[n:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        n *= 2


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, as numbers, and where each begins, with the end."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    kept = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return kept.astype(np.uint64), at - at[0]


def _masks(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    for i in range(END_BITS):
        out |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return out


def end_hash(words: Column | str) -> Column:
    """The hash of each word's end; null for a word without a letter."""

    @F.arrow_udf("long")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, at = _bytes(texts)
            size, out = np.diff(at), np.zeros(len(texts), np.uint64)
            for n, h in _hashes(data, int(size.max(initial=0))):
                mine = (size >= n) & (size < 2 * n)
                out[mine] = h[at[1:][mine] - n]
            yield pa.array(out.view(np.int64), mask=size == 0)

    return hashed(words)


def _sketched(ends: DataFrame, word_bits: int) -> bytes:
    """The sketch of ends (a column end), made in tasks, a range of its words each."""
    part_bits = min(PART_BITS, word_bits)

    def made(group: pa.Table) -> pa.Table:
        h = group["end"].to_numpy().view(np.uint64)
        words = np.zeros(1 << (word_bits - part_bits), np.uint64)
        np.bitwise_or.at(words, ((h >> np.uint64(64 - word_bits)) & np.uint64(len(words) - 1)).astype(np.int64), _masks(h))
        return pa.table({"part": pa.array([int(h[0] >> np.uint64(64 - part_bits))], pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})

    got = ends.groupBy(F.shiftrightunsigned("end", 64 - part_bits)).applyInArrow(made, "part long, words binary").collect()
    out = bytearray(8 << word_bits)
    for r in got:
        out[r["part"] * len(r["words"]) : (r["part"] + 1) * len(r["words"])] = r["words"]
    return bytes(out)


def _search(shared: Broadcast, word_bits: int, sizes: list[int]):
    @F.arrow_udf("array<long>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sketch = np.frombuffer(shared.value, np.uint64)
        for texts in batches:
            data, at = _bytes(texts)
            rows, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n, h in _hashes(data, sizes[-1]):
                if n not in sizes:
                    continue
                held, mask = sketch[(h >> np.uint64(64 - word_bits)).astype(np.int64)], _masks(h)
                place = np.flatnonzero((held & mask) == mask)
                row = np.searchsorted(at, place, "right") - 1
                inside = place + n <= at[row + 1]
                rows.append(row[inside])
                ends.append(h[place[inside]].view(np.int64))
            pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(ends)]), axis=1)
            first = np.searchsorted(pairs[0], np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(first), pa.array(pairs[1]))

    return found


def ends_within(words: DataFrame) -> Callable[[Column], Column]:
    """For a table of words that have a letter: a function from texts to the distinct hashes of their pieces that may be an end of one of the words.

    Only the number of words by length of their ends, and the sketch, come to the driver.
    """
    words = words.select(F.col(words.columns[0]).alias("word"))
    size = F.pow(F.lit(2), F.floor(F.log2(F.octet_length("word").cast("double")))).cast("int")
    counts = {r["size"]: r["n"] for r in words.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return lambda text: F.array().cast("array<long>")
    word_bits = min(MOST_WORD_BITS, max(1, (sum(counts.values()) - 1).bit_length()))
    shared = words.sparkSession.sparkContext.broadcast(_sketched(words.select(end_hash("word").alias("end")), word_bits))
    return _search(shared, word_bits, sorted(counts))

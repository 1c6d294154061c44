"""Benchmark decontamination by Wu-Manber search.

Windows of benchmark words become byte patterns of the form " w1 w2 ... wk ".
A shift table over hashed blocks says how far the search may jump from a
position; where the shift is 0, the block's bucket names the patterns whose
first m bytes end there, and a direct comparison decides. Many positions of a
text buffer advance together, as numpy arrays.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 10
#: Patterns at least this long are searched apart from the short ones, which allow small jumps only.
LONG = 24
#: Bytes of benchmark text compiled into one searcher; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 4 << 20

_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words in UTF-8: every byte of a character beyond ASCII belongs to a word, so bytes decide as characters do."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def item_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most block_bytes of words; a longer item comes in several parts, which share window - 1 words, so that no window is lost."""
    block: list[tuple[str, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null").toLocalIterator():
        words = words_of(r["text"])
        at = 0
        while at < len(words):
            end, n = at, 0
            while end < len(words) and (n < block_bytes - size or end - at < window):
                n += len(words[end]) + 1
                end += 1
            # The last windows of an item stay whole.
            block.append((r["item"], b" ".join(words[at:end]).decode("utf-8", "surrogatepass")))
            size += n
            if size >= block_bytes:
                yield block
                block, size = [], 0
            at = len(words) if end == len(words) else end - window + 1
    if block:
        yield block


def windows_of(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """The item's windows as patterns with a space at either end."""
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))}


class WuManber:
    """Finds all occurrences of the patterns in a byte buffer."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = 8 if self.m >= 16 else min(3, self.m)
        self.bits = 20 if len(patterns) < 200_000 else 23
        most = self.m - self.block + 1
        self.shift = np.full(1 << self.bits, min(most, 255), np.uint8)
        heads = np.frombuffer(b"".join(p[: self.m] + b"\0" * 8 for p in patterns), np.uint8)
        at = np.arange(len(patterns), dtype=np.int64) * (self.m + 8)
        v = self._words(heads)
        for j in range(self.block, self.m + 1):  # the block that ends at byte j
            code = self._code(v[at + j - self.block])
            np.minimum.at(self.shift, code, np.uint8(min(self.m - j, 255)))
        ends = self._code(v[at + self.m - self.block])
        self.order = np.argsort(ends, kind="stable")
        self.codes, self.first = np.unique(ends[self.order], return_index=True)
        self.first = np.append(self.first, len(patterns))
        # The first bytes (8 at most) of each pattern, compared before the whole.
        self.lead = min(8, self.m)
        self.mask = np.uint64((1 << (8 * self.lead)) - 1)
        self.prefix = (v[at] & self.mask)[self.order]

    @staticmethod
    def _words(buffer: np.ndarray) -> np.ndarray:
        """The 8 bytes from each position on, as numbers."""
        return np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))

    def _code(self, v: np.ndarray) -> np.ndarray:
        keep = np.uint64((1 << (8 * self.block)) - 1) if self.block < 8 else np.uint64(0xFFFFFFFFFFFFFFFF)
        return ((v & keep) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, buffer: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence."""
        n = len(buffer)
        if n < self.m:
            return []
        v = self._words(np.frombuffer(buffer + b"\0" * 8, np.uint8))
        lanes = int(min(8192, max(1, n // 512)))
        edges = np.linspace(self.m, n + 1, lanes + 1).astype(np.int64)  # of the ends of windows
        pos, end = edges[:-1].copy(), edges[1:]
        hits, codes = [], []
        while len(pos):
            live = pos < end
            if not live.all():
                pos, end = pos[live], end[live]
                if not len(pos):
                    break
            code = self._code(v[pos - self.block])
            jump = self.shift[code]
            zero = jump == 0
            if zero.any():
                hits.append(pos[zero])
                codes.append(code[zero])
            pos = pos + np.maximum(jump, 1)
        if not hits:
            return []
        at, code = np.concatenate(hits) - self.m, np.concatenate(codes)
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[k] == code
        at, k = at[known], k[known]
        size = self.first[k + 1] - self.first[k]
        which = np.repeat(np.arange(len(at)), size)
        member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + self.first[k][which]
        same = (v[at[which]] & self.mask) == self.prefix[member]
        out = []
        for start, p in zip(at[which[same]].tolist(), self.order[member[same]].tolist(), strict=True):
            pattern = self.patterns[p]
            if buffer.startswith(pattern, start):
                out.append((start, p))
        return out


class Searcher:
    """The windows of some items, in a searcher for long patterns and one for short ones."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.items: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), window):
                self.items.setdefault(w, set()).add(item)
        parts = [[p for p in self.items if len(p) >= LONG], [p for p in self.items if len(p) < LONG]]
        self.parts = [WuManber(sorted(p)) for p in parts if p]

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, the hit ranges of words (from, to) and the items found."""
        docs = [words_of(t) for t in texts]
        i = 0
        while i < len(docs):
            size, starts, parts = 0, [], []
            first = i
            while i < len(docs) and (i == first or size < CHUNK_BYTES):
                norm = b" " + b" ".join(docs[i]) + b" \0"
                starts.append(size)
                parts.append(norm)
                size += len(norm)
                i += 1
            buffer = b"".join(parts)
            at = np.array(starts)
            found: dict[int, list[tuple[int, bytes]]] = {}
            for searcher in self.parts:
                for start, p in searcher.search(buffer):
                    d = int(np.searchsorted(at, start, side="right")) - 1
                    found.setdefault(d, []).append((start - starts[d], searcher.patterns[p]))
            for d in range(i - first):
                n = len(docs[first + d])
                ranges, items = [], set()
                if d in found:
                    spaces = np.flatnonzero(np.frombuffer(parts[d], np.uint8) == 32)
                    for start, pattern in found[d]:
                        w = int(np.searchsorted(spaces, start))
                        ranges.append((w, w + pattern.count(b" ") - 1))
                        items |= self.items[pattern]
                yield n, merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _digest(ranges: list[tuple[int, int]], items: set[str]) -> tuple[int, int, str]:
    return sum(b - a for a, b in ranges), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs and n_words, n_hit, n_items, items_sha256 and contaminated.

    Columns of docs with these names are replaced. A null or empty text has no
    words and is clean; items without words match nothing; items with equal
    windows are all reported; rows with a null item_id are passed over; an empty table
    gives an empty result.

    The benchmark passes through the driver one block at a time, and each block is one
    broadcast of bounded size. A benchmark of one block is searched in one
    pass; with more, the documents are written once and searched once a block,
    the block's broadcast is dropped before the next, and what each block found
    is merged by document: only documents with hits take part in that.
    """
    sc = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "_found", "_row")]
    blocks = item_blocks(benchmark, window, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        shared = sc.broadcast(Searcher(first, window))

        @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string")
        def searched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                found = shared.value.search([t if isinstance(t, str) else None for t in texts])
                yield pd.DataFrame([(n, *_digest(r, x)) for n, r, x in found], columns=["n_words", "n_hit", "n_items", "items_sha256"])

        return docs.select(*kept, searched("text").alias("_found")).select(*kept, "_found.*", (F.col("_found.n_hit") > 0).alias("contaminated"))

    base = written(docs.select(*kept, F.monotonically_increasing_id().alias("_row")), "searched-documents")
    parts = None
    for block in itertools.chain([first, second], blocks):
        shared = sc.broadcast(Searcher(block, window))

        def hits(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for x in batches:
                found = shared.value.search([t if isinstance(t, str) else None for t in x["text"]])
                rows = [(row, [a for a, _ in r], [b for _, b in r], sorted(items)) for row, (_, r, items) in zip(x["_row"], found, strict=True) if r]
                yield pd.DataFrame(rows, columns=["_row", "a", "b", "items"])

        part = written(base.select("_row", "text").mapInPandas(hits, "_row long, a array<long>, b array<long>, items array<string>"), "searched-block")
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)

    @F.pandas_udf("n_hit long, n_items long, items_sha256 string")
    def together(a: pd.Series, b: pd.Series, items: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_digest(merged(list(zip(p.tolist(), q.tolist(), strict=True))), set(i)) for p, q, i in zip(a, b, items, strict=True)], columns=["n_hit", "n_items", "items_sha256"])

    @F.pandas_udf("long")
    def n_words(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t if isinstance(t, str) else None)) for t in texts], dtype="int64")

    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = parts.groupBy("_row").agg(flat("a"), flat("b"), flat("items")).select("_row", together("a", "b", "items").alias("_found"))
    out = base.join(found, "_row", "left").withColumn("n_words", n_words("text"))
    n = lambda c: F.coalesce(F.col(f"_found.{c}"), F.lit(0)).alias(c)
    return out.select(*kept, "n_words", n("n_hit"), n("n_items"), F.coalesce("_found.items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"), (n("n_hit") > 0).alias("contaminated"))

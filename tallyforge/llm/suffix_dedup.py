"""Removal of bytes that an earlier document holds too, in strings of at least LENGTH bytes.

A sample of suffixes stands for all: in every window of LENGTH bytes the
K bytes with the least hash are the window's name, so equal windows have
equal names at equal places wherever they stand. Runs of windows with one name
(spans) are dealt out by name, and spans that are equal as a whole are settled at
once. Names that come with different surroundings are left: their spans'
bytes go to shards by the name and half of what lies beside it, and each shard
is put in suffix order by external induced sorting, whose common prefixes tell
which strings recur and in which document they stand first.

Spans travel packed, some thousands to a row. Shards, buckets and parts are
numbered by the size of the input, so none outgrows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .induced_sort import suffix_order

LENGTH = 50
K = 24
#: Bytes of text that go to one bucket of names, one part of documents, one shard of suffixes.
BUCKET_BYTES, PART_BYTES, SHARD_BYTES = 8 << 20, 8 << 20, 2 << 20
CHUNK_BYTES = 3 << 20

_MUL = 0xD6E8FEB86659FD93
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Two further pairs of multiplier and byte table: 64 bits each of a span's whole content.
_WHOLE = [(m, np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)) for m, seed in ((0xC2B2AE3D27D4EB4F, 31), (0xFF51AFD7ED558CCD, 47))]
#: Surroundings of one name within a chunk beyond which its spans are left open at once: only one of them travels by the name.
IN_CHUNK = 8
#: A key that so many open segments share is hot, and at most so many keys are hot: HOT_KEYS bounds what is broadcast.
HOT_SEGMENTS, HOT_KEYS, HOT_IN_BATCH = 20_000, 50_000, 16
#: Positions that whole spans are hashed for at a time, and how far a span reaches beyond its start: 2 * LENGTH - K bytes and no more.
_BLOCK, _REACH = 1 << 16, 2 * LENGTH


def _power_tables(m: int) -> tuple[np.ndarray, np.ndarray]:
    """m**i and m**-i modulo 2**64 for the positions of a block."""
    both = []
    for base in (m, pow(m, -1, 1 << 64)):
        x = np.full(_BLOCK + _REACH, base, np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


_POWERS = {m: _power_tables(m) for m, _ in _WHOLE}


def content_hashes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of buffer[a:b] for many a, b, in order of a: differences of a block's prefix sums, shifted to a common start."""
    out = [np.empty(len(a), np.uint64) for _ in _WHOLE]
    sums = np.zeros(_BLOCK + _REACH + 1, np.uint64)
    for start in range(0, len(buffer), _BLOCK):
        own = slice(*np.searchsorted(a, (start, start + _BLOCK)).tolist())
        part = buffer[start : start + _BLOCK + _REACH]
        x, y = a[own] - start, b[own] - start
        for of, (m, values) in zip(out, _WHOLE, strict=True):
            up, down = _POWERS[m]
            np.cumsum(values[part] * up[: len(part)], out=sums[1 : len(part) + 1])
            of[own] = mixed((sums[y] - sums[x]) * down[x] + (y - x).astype(np.uint64))
    return out


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all runs of size values, by doubling."""
    out, done, part, width = None, 0, values, 1
    while size >> (width.bit_length() - 1):
        if size & width:
            if out is None:
                out = part
            else:
                m = len(part) - done
                out = out[:m] * np.uint64(pow(_MUL, width, 1 << 64)) + part[done : done + m]
            done += width
        if size >= 2 * width:
            part = part[:-width] * np.uint64(pow(_MUL, width, 1 << 64)) + part[width:]
        width *= 2
    return out[: max(0, len(values) - size + 1)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width hashes, where its least one stands; the rightmost of equal ones."""
    value, place, size = h, np.arange(len(h), dtype=np.int32), 1

    def merged(by: int, length: int) -> None:
        nonlocal value, place
        a, b = value[:length], value[by : by + length]
        right = b <= a
        value, place = np.where(right, b, a), np.where(right, place[by : by + length], place[:length])

    while 2 * size <= width:
        merged(size, len(value) - size)
        size *= 2
    if size < width:
        merged(width - size, len(h) - width + 1)
    return place


_KINDS = {"doc": np.int32, "name": np.uint32, "of_bucket": np.uint32, "whole": np.uint64, "more": np.uint64, "lo": np.int64, "n": np.uint8, "p": np.uint8}


def spans_of(buffer: np.ndarray, starts: list[int], ends: list[int], length: int = LENGTH, k: int = K) -> dict[str, np.ndarray]:
    """Spans of the pieces of text that lie in the buffer: doc (the piece's number), name and of_bucket (two halves of the name's hash), whole and more (128 bits over all their bytes), lo (first window), n (windows), p (place of the name after lo)."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in _KINDS}
    if len(buffer) >= length:
        names = mixed(rolling(_BYTES[buffer], k))
        begins, stops = [], []
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            if b - a < length:
                continue
            place = least_places(names[a : b - k + 1], length - k + 1)
            lo = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            n = np.diff(np.append(lo, len(place)))
            p = place[lo]
            name = names[a + p]
            begins.append(a + lo)
            stops.append(a + lo + n - 1 + length)
            out["doc"].append(np.full(len(lo), i, np.int32))
            out["name"].append(name.astype(np.uint32))
            out["of_bucket"].append((name >> np.uint64(32)).astype(np.uint32))
            out["lo"].append(lo.astype(np.int64))
            out["n"].append(n.astype(np.uint8))
            out["p"].append((p - lo).astype(np.uint8))
        if begins:
            whole, more = content_hashes(buffer, np.concatenate(begins), np.concatenate(stops))
            out["whole"].append(whole)
            out["more"].append(more)
    return {c: np.concatenate(x) if x else np.zeros(0, _KINDS[c]) for c, x in out.items()}


def packed(columns: dict[str, np.ndarray]) -> bytes:
    """Columns as one value: 64-bit numbers go as the planes of their bytes, which leaves their zeros together."""
    parts = []
    for name, x in columns.items():
        if x.dtype == np.int64:
            planes = x.view(np.uint8).reshape(-1, 8).T.copy()
            raw = planes.tobytes()
        else:
            raw = x.tobytes()
        parts.append(f"{name}:{x.dtype.str}:{len(x)};".encode() + raw)
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        part = data[at + 4 : at + 4 + size]
        at += 4 + size
        cut = part.index(b";")
        name, kind, n = part[:cut].decode().split(":")
        raw = np.frombuffer(part, np.uint8, offset=cut + 1)
        out[name] = raw.reshape(8, int(n)).T.copy().view(np.int64).ravel() if kind == "<i8" else raw.copy().view(kind)
    return out


def stacked(rows: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([r[c] for r in rows]) for c in rows[0]} if rows else {}


def _first_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (the first one leads), and True where a new key begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    if len(new):
        new[0] = True
    return order, new


def _with_documents(s: dict[str, np.ndarray], ids: np.ndarray, keys: np.ndarray, parts: np.ndarray) -> dict[str, np.ndarray]:
    """Spans with the list of their documents, each of which is named once."""
    docs, place = np.unique(s.pop("doc"), return_inverse=True)
    return {**s, "place": place.astype(np.uint16 if len(docs) < 65536 else np.uint32), "of_id": ids[docs], "of_key": keys[docs], "of_part": parts[docs]}


def _of_documents(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans each with its document's id, key and part."""
    place = s.pop("place")
    return {**{c: v for c, v in s.items() if not c.startswith("of_")}, "doc_id": s["of_id"][place], "key": s["of_key"][place], "part": s["of_part"][place]}


#: What becomes of a span: undecided, covered as a whole by an earlier document, left to the suffix order, or only told to its name's bucket.
UNDECIDED, COVERED, OPEN, TOLD = 0, 1, 2, 3


def _pieces(raw: list[bytes], chunk_bytes: int) -> Iterator[tuple[int, int, bytes]]:
    """(document's number, first window, bytes): long texts in pieces of chunk_bytes windows, which share LENGTH - 1 bytes."""
    for i, b in enumerate(raw):
        for at in range(0, max(1, len(b) - LENGTH + 1), chunk_bytes):
            yield i, at, b[at : at + chunk_bytes + LENGTH - 1]


def _judged(s: dict[str, np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (name, whole, document); then along it: where names and wholes begin, the number of the name, and the least document with the same whole."""
    order, _ = _first_of([s["name"], s["whole"], doc])
    at = np.arange(len(order))
    new_name, new_whole = np.ones(len(order), bool), np.ones(len(order), bool)
    name, whole, more = s["name"][order], s["whole"][order], s["more"][order]
    new_name[1:] = name[1:] != name[:-1]
    new_whole[1:] = new_name[1:] | (whole[1:] != whole[:-1]) | (more[1:] != more[:-1])
    lead = doc[order][np.maximum.accumulate(np.where(new_whole, at, 0))] if len(order) else doc[order]
    return order, new_name, new_whole, np.cumsum(new_name) - 1, lead


def _sampled(docs: DataFrame, buckets: int, chunk_bytes: int, in_chunk: int) -> DataFrame:
    """(bucket, data): packed spans of the documents (doc_id, key, part, text).

    Within a chunk, spans that an earlier document of the chunk has are settled,
    and names that come with more than in_chunk surroundings are left open:
    both travel by their document, which spreads them evenly, so a name's bucket
    gets at most in_chunk wholes a chunk, however frequent the name is.
    """

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in x["text"]]
            ids, keys, parts = (x[c].to_numpy(np.int64) for c in ("doc_id", "key", "part"))
            chunk: list[tuple[int, int, bytes]] = []
            size = 0
            for piece in (*_pieces(raw, chunk_bytes), None):
                if piece is None or chunk and size + len(piece[2]) > chunk_bytes:
                    rows = _chunk_rows(chunk, ids, keys, parts, buckets, in_chunk)
                    yield pd.DataFrame(rows, columns=["bucket", "data"])
                    chunk, size = [], 0
                if piece is not None:
                    chunk.append(piece)
                    size += len(piece[2])

    return docs.mapInPandas(sample, "bucket long, data binary")


def _chunk_rows(chunk: list[tuple[int, int, bytes]], ids: np.ndarray, keys: np.ndarray, parts: np.ndarray, buckets: int, in_chunk: int) -> list[tuple[int, bytes]]:
    sizes = np.array([len(b) for _, _, b in chunk], np.int64)
    ends = np.cumsum(sizes)
    s = spans_of(np.frombuffer(b"".join(b for _, _, b in chunk), np.uint8), (ends - sizes).tolist(), ends.tolist())
    s["lo"] = s["lo"] + np.array([at for _, at, _ in chunk], np.int64)[s["doc"]]
    s["doc"] = np.array([i for i, _, _ in chunk], np.int32)[s["doc"]]
    own = ids[s["doc"]]
    order, new_name, new_whole, name, lead = _judged(s, own)
    state = np.zeros(len(order), np.uint8)
    covered = lead < own[order]
    many = (np.bincount(name, new_whole) > in_chunk)[name] if len(order) else covered
    state[order] = np.where(covered, COVERED, np.where(many, OPEN, UNDECIDED))
    told = order[new_name & many] if len(order) else order
    s["done"] = state
    bucket = np.where(state == UNDECIDED, s["of_bucket"].astype(np.uint64), keys.view(np.uint64)[s["doc"]] >> np.uint64(8)) % np.uint64(buckets)
    if len(told):
        bucket = np.concatenate((bucket, s["of_bucket"][told].astype(np.uint64) % np.uint64(buckets)))
        s = {c: np.concatenate((v, v[told])) for c, v in s.items()}
        s["done"][len(order) :] = TOLD
    s.pop("of_bucket")
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return [(int(bucket[g[0]]), packed(_with_documents({c: v[g] for c, v in s.items()}, ids, keys, parts))) for g in groups]


def _settled(x: pd.DataFrame) -> pd.DataFrame:
    """One bucket's spans: those that an earlier document has as a whole are settled; those whose name comes with other surroundings are left open."""
    s = stacked([_of_documents(unpacked(d)) for d in x["data"]])
    ready = (s["done"] == COVERED) | (s["done"] == OPEN)
    passed = {c: v[ready] for c, v in s.items()}
    s = {c: v[~ready] for c, v in s.items()}
    order, new_name, new_whole, name, lead = _judged(s, s["doc_id"])
    s = {c: v[order] for c, v in s.items()}
    if len(order):
        covered = lead < s["doc_id"]
        starts = np.flatnonzero(new_name)
        wholes, told = np.bincount(name, new_whole), np.bincount(name, s["done"] == TOLD) > 0
        low, high = np.minimum.reduceat(s["doc_id"], starts), np.maximum.reduceat(s["doc_id"], starts)
        left = ~covered & (told | (wholes > 1) & (low < high))[name]
        mine = s["done"] == UNDECIDED
        s["done"] = np.where(covered, COVERED, OPEN).astype(np.uint8)
        s = {c: v[mine & (covered | left)] for c, v in s.items()}
    s = stacked([passed, s])
    order = np.argsort(s["part"], kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(s["part"][order])) + 1) if len(order) else []
    keep = ("doc_id", "key", "lo", "n", "p", "done")
    return pd.DataFrame([(int(s["part"][g[0]]), packed({c: s[c][g] for c in keep})) for g in groups], columns=["part", "data"])


def _runs(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs [start, end) of the bytes that windows lo .. lo+n-1 cover."""
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(lo, kind="stable")
    a, b = lo[order], (lo + n.astype(np.int64) - 1 + LENGTH)[order]
    b = np.maximum.accumulate(b)
    new = np.concatenate(([True], a[1:] > b[:-1]))
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return a[new], b[ends]


def _digest(raw: bytes, lo: np.ndarray, n: np.ndarray) -> tuple[int, int, int, str]:
    a, b = _runs(lo, n)
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        kept.append(raw[at:x])
        at = y
    kept.append(raw[at:])
    return len(raw), int((b - a).sum()), len(a), hashlib.sha256(b"".join(kept)).hexdigest()


_RESULT = "doc_id long, key long, part long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_OPEN = f"{_RESULT}, text binary, settled binary, open binary"


def _by_document(s: dict[str, np.ndarray]) -> dict[tuple[int, int], slice]:
    """Sorts s by (doc_id, key) and says where each document's rows lie."""
    if not s or not len(s["key"]):
        return {}
    order, new = _first_of([s["doc_id"], s["key"]])
    for c in s:
        s[c] = s[c][order]
    starts = np.flatnonzero(new)
    return {(int(s["doc_id"][a]), int(s["key"][a])): slice(int(a), int(b)) for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True)}


def _applied(docs: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """One part's documents with their spans: finished ones get their digest, the others carry their text on."""
    s = stacked([unpacked(d) for d in spans["data"]])
    place = _by_document(s)
    rows = []
    for doc_id, key, part, text in zip(docs["doc_id"], docs["key"], docs["part"], docs["text"], strict=True):
        raw = (text or "").encode("utf-8", "surrogatepass")
        at = place.get((doc_id, key))
        none = np.zeros(0, np.int64)
        if at is None:
            rows.append((doc_id, key, part, *_digest(raw, none, none), None, None, None))
            continue
        done = s["done"][at] == COVERED
        lo, n, p = s["lo"][at], s["n"][at], s["p"][at]
        if done.all():
            rows.append((doc_id, key, part, *_digest(raw, lo, n), None, None, None))
            continue
        a, b = _runs(lo[done], n[done])
        settled = packed({"lo": a, "n": (b - a - LENGTH + 1).astype(np.int64)})
        rows.append((doc_id, key, part, len(raw), None, None, None, raw, settled, packed({"lo": lo[~done], "n": n[~done], "p": p[~done]})))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _OPEN.split(", ")])


def _cuts(raw: bytes, data: bytes) -> Iterator[tuple[int, int, int]]:
    """(a, b, key) of a document's open spans: windows a .. b-1 all hold the name and half of its surroundings to the right or to the left, which the key hashes."""
    half = (LENGTH - K) // 2
    s = unpacked(data)
    for lo, n, p in zip(s["lo"].tolist(), s["n"].tolist(), s["p"].tolist(), strict=True):
        at, hi = lo + p, lo + n  # of the name; past the last window
        cut_at = min(max(lo, at - half), hi)  # from here on, windows reach half beyond the name
        if lo < cut_at:
            yield lo, cut_at, xxhash.xxh64_intdigest(raw[at - half : at + K], 1)
        if cut_at < hi:
            yield cut_at, hi, xxhash.xxh64_intdigest(raw[at : at + K + half], 1)


def _hot_keys(opened: DataFrame, segments: float, least: int, in_batch: int) -> np.ndarray:
    """Keys that very many open segments share, HOT_KEYS at most: as a key needs segments / HOT_KEYS of them, no more can be hot."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keys = np.array([k for raw, data in zip(x["text"], x["open"], strict=True) for _, _, k in _cuts(raw, data)], np.uint64)
            k, n = np.unique(keys, return_counts=True)
            often = n >= in_batch
            yield pd.DataFrame({"k": k[often].view(np.int64), "n": n[often]})

    counted = opened.select("text", "open").mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return np.array([r["k"] for r in counted.filter(F.col("n") >= max(least, segments / HOT_KEYS)).select("k").collect()], np.int64).view(np.uint64)


def _segments(opened: DataFrame, shards: int, hot: frozenset[int]) -> DataFrame:
    """(shard, data): the bytes of open spans, in two segments each by whether the name has half of its surroundings to its right or to its left.

    Segments of hot keys come apart into single windows, dealt out by all their
    bytes; of a batch's equal windows only those of the least document travel
    on, the others are hit already.
    """
    columns = ("doc_id", "key", "lo", "n", "hit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows: dict[int, list[tuple[int, int, int, int, int, bytes]]] = {}
            single: dict[bytes, list[tuple[int, int, int]]] = {}
            for doc_id, key, raw, data in zip(x["doc_id"], x["key"], x["text"], x["open"], strict=True):
                for a, b, k in _cuts(raw, data):
                    if k in hot:
                        for w in range(a, b):
                            single.setdefault(raw[w : w + LENGTH], []).append((doc_id, key, w))
                    else:
                        rows.setdefault(k % shards, []).append((doc_id, key, a, b - a, 0, raw[a : b - 1 + LENGTH]))
            for window, places in single.items():
                shard, least = xxhash.xxh64_intdigest(window, 2) % shards, min(places)[0]
                for doc_id, key, w in places:
                    hit = doc_id > least
                    rows.setdefault((key >> 8) % shards if hit else shard, []).append((doc_id, key, w, 1, int(hit), b"" if hit else window))
            out = []
            for shard, own in rows.items():
                table = {c: np.array([r[j] for r in own], np.int64) for j, c in enumerate(columns)}
                out.append((shard, packed({**table, "bytes": np.frombuffer(b"".join(r[5] for r in own), np.uint8)})))
            yield pd.DataFrame(out, columns=["shard", "data"])

    return opened.select("doc_id", "key", "text", "open").mapInPandas(cut, "shard long, data binary")


def recurring(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Windows of the segments whose LENGTH bytes also start in a document with a smaller id, as (doc_id, key, lo, n).

    The segments, each closed by a separator, are one text; in its suffix order
    windows with equal bytes stand together, with common prefixes of LENGTH.
    Segments that are hit already bring no bytes and are passed on.
    """
    passed = {c: s[c][s["hit"] == 1] for c in ("doc_id", "key", "lo", "n")}
    s = {c: v if c == "bytes" else v[s["hit"] == 0] for c, v in s.items()}
    size = s["n"] - 1 + LENGTH
    starts = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int16)
    inside = np.ones(len(text), bool)
    inside[starts + size] = False
    text[inside] = s["bytes"].astype(np.int16) + 1
    owner = np.repeat(np.arange(len(size)), size + 1)
    hit = np.zeros(len(text), bool)

    def close(at: np.ndarray, lcp: np.ndarray) -> None:
        """A batch that ends where a group of equal windows ends."""
        real = np.arange(len(at))[(at - starts[owner[at]]) < s["n"][owner[at]]]
        if not len(real):
            return
        group = np.cumsum(lcp < LENGTH)[real]
        ids = s["doc_id"][owner[at[real]]]
        new = np.concatenate(([True], group[1:] != group[:-1]))
        low = np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
        hit[at[real[low < ids]]] = True

    carry_at, carry_lcp = np.zeros(0, np.int64), np.zeros(0, np.int32)
    for at, lcp in suffix_order(text, LENGTH):
        carry_at, carry_lcp = np.concatenate((carry_at, at)), np.concatenate((carry_lcp, lcp))
        breaks = np.flatnonzero(carry_lcp < LENGTH)
        if len(breaks) and breaks[-1] > 0:
            b = int(breaks[-1])
            close(carry_at[:b], carry_lcp[:b])
            carry_at, carry_lcp = carry_at[b:], carry_lcp[b:]
    close(carry_at, carry_lcp)
    found = np.flatnonzero(hit)
    if not len(found):
        return passed
    own, lo = owner[found], found - starts[owner[found]]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (found[1:] != found[:-1] + 1)))
    begins = np.flatnonzero(new)
    here = {
        "doc_id": s["doc_id"][own[begins]], "key": s["key"][own[begins]],
        "lo": s["lo"][own[begins]] + lo[begins], "n": np.diff(np.append(begins, len(found))).astype(np.int64),
    }
    return stacked([passed, here])


def suffix_dedup(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, in_chunk: int = IN_CHUNK, hot_segments: int = HOT_SEGMENTS, hot_in_batch: int = HOT_IN_BATCH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    A byte goes if a string of LENGTH bytes over it also starts in a document with
    a smaller doc_id. Null and empty texts, and those shorter than LENGTH, lose
    nothing. Rows that repeat an id do not remove each other's bytes, and are
    each judged on their own text; rows with a null id lose nothing and remove
    nothing. An empty table gives an empty result. The limits decide how rows
    travel, never what is removed.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets, parts = (int(max(16, np.ceil(total / b))) for b in (BUCKET_BYTES, PART_BYTES))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", key.alias("key"), F.pmod(F.xxhash64("doc_id", key), F.lit(parts)).alias("part"), "text")
    known = keyed.filter("doc_id is not null")
    spans = written(_sampled(known, buckets, chunk_bytes, in_chunk).groupBy("bucket").applyInPandas(_settled, "part long, data binary"), "suffix-spans")
    first = written(known.groupBy("part").cogroup(spans.groupBy("part")).applyInPandas(_applied, _OPEN), "suffix-parts")
    opened = first.filter("text is not null")
    # Open spans are packed to 10 bytes each, and come to two segments of some 30 to 60 bytes.
    spans_packed = opened.agg(F.sum(F.octet_length("open").cast("long"))).first()[0] or 0
    shards = int(max(16, np.ceil(spans_packed * 6.5 / SHARD_BYTES)))
    hot = frozenset(_hot_keys(opened, spans_packed / 5, hot_segments, hot_in_batch).tolist())

    def sorted_shard(x: pd.DataFrame) -> pd.DataFrame:
        found = recurring(stacked([unpacked(d) for d in x["data"]]))
        order, new = _first_of([found["doc_id"], found["key"]])
        own = np.split(order, np.flatnonzero(new)[1:]) if len(order) else []
        rows = [(int(found["doc_id"][r[0]]), int(found["key"][r[0]]), packed({c: found[c][r] for c in ("lo", "n")})) for r in own]
        return pd.DataFrame(rows, columns=["doc_id", "key", "data"])

    induced = _segments(opened, shards, hot).groupBy("shard").applyInPandas(sorted_shard, "doc_id long, key long, data binary")
    induced = induced.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)))

    def finished(own: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        extra: dict[tuple[int, int], list[dict[str, np.ndarray]]] = {}
        for doc_id, k, data in zip(more["doc_id"], more["key"], more["data"], strict=True):
            extra.setdefault((doc_id, k), []).append(unpacked(data))
        rows = []
        for doc_id, k, part, raw, settled in zip(own["doc_id"], own["key"], own["part"], own["text"], own["settled"], strict=True):
            s = stacked([unpacked(settled), *extra.get((doc_id, k), [])])
            rows.append((doc_id, k, part, *_digest(raw, s["lo"], s["n"])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")])

    last = opened.select("doc_id", "key", "part", "text", "settled").groupBy("part").cogroup(induced.groupBy("part")).applyInPandas(finished, _RESULT)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    nameless = keyed.filter("doc_id is null").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    return first.filter("text is null").select(*columns).unionByName(last.select(*columns)).unionByName(nameless.select(*columns))

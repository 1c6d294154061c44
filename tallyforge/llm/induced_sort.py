"""External induced sorting of one shard's suffixes, with common-prefix values.

Suffixes are S-type or L-type by whether they are smaller or larger than their
right neighbour; S* suffixes are those S-type ones with an L-type to the left.
Only the S* suffixes are sorted by their characters. They are put in the
queues of their first character, and from there all others follow: taking
suffixes in order, each hands its left neighbour on to the queue of that
neighbour's first character, first for the L-type from the least character
up, then for the S-type from the greatest down. A queue carries tuples of
position and common prefix with the tuple before, where a common prefix
is one more than the least between the two sources. Queues keep a bounded
number of tuples in memory and the rest in files.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue keeps in memory before it writes them out, and that one step takes.
IN_MEMORY = 1 << 16
STEP = 1 << 18
#: Characters and the separator; UTF-8 has no bytes above 0xF4, so bytes moved up by one stay below.
SYMBOLS = 256
_TUPLE = np.dtype([("at", "<i8"), ("lcp", "<i4")])


class Queue:
    """First in, first out; long queues lie in a file."""

    def __init__(self, folder: str, name: str, in_memory: int = IN_MEMORY):
        self.path, self.in_memory = os.path.join(folder, name), in_memory
        self.held: list[np.ndarray] = []
        self.n_held, self.n, self.on_disk = 0, 0, 0

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        rows = np.empty(len(at), _TUPLE)
        rows["at"], rows["lcp"] = at, lcp
        self.held.append(rows)
        self.n_held += len(rows)
        self.n += len(rows)
        if self.n_held > self.in_memory:
            with open(self.path, "ab") as f:
                for x in self.held:
                    x.tofile(f)
            self.on_disk += self.n_held
            self.held, self.n_held = [], 0

    def read(self, start: int, count: int) -> np.ndarray:
        parts = []
        if start < self.on_disk:
            parts.append(np.fromfile(self.path, _TUPLE, min(count, self.on_disk - start), offset=start * _TUPLE.itemsize))
            start, count = self.on_disk, count - len(parts[0])
        at = start - self.on_disk
        for x in self.held:
            if count <= 0:
                break
            if at < len(x):
                parts.append(x[at : at + count])
                count -= len(parts[-1])
            at = max(0, at - len(x))
        return np.concatenate(parts) if parts else np.empty(0, _TUPLE)

    def steps(self, size: int = STEP) -> Iterator[np.ndarray]:
        """All tuples in order, those pushed meanwhile included."""
        at = 0
        while at < self.n:
            rows = self.read(at, min(size, self.n - at))
            at += len(rows)
            yield rows


def types(text: np.ndarray) -> np.ndarray:
    """True for S-type. Equal neighbours take the type of the first that differs; the last position is S-type."""
    n = len(text)
    after = np.append(text[1:], -1)
    known = np.where(text[:n] < after, 1, np.where(text[:n] > after, 0, 2)).astype(np.int8)
    known[-1] = 1
    place = np.where(known != 2, np.arange(n), n)
    return known[np.minimum.accumulate(place[::-1])[::-1]] == 1


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of text[a:] and text[b:], up to depth and not over a separator."""
    out, live = np.zeros(len(a), np.int32), np.arange(len(a))
    n = len(text)
    for k in range(depth):
        if not len(live):
            break
        i, j = np.minimum(a[live] + k, n - 1), np.minimum(b[live] + k, n - 1)
        same = (text[i] == text[j]) & (text[i] != 0) & (a[live] + k < n) & (b[live] + k < n)
        live = live[same]
        out[live] += 1
    return out


def _first_zero(chunk: np.ndarray, width: int) -> np.ndarray:
    """Where the first zero stands among the leading width bytes of each number; width where there is none."""
    out = np.full(len(chunk), width, np.int32)
    filled = chunk | np.uint64((1 << (64 - 8 * width)) - 1)
    has = np.flatnonzero((filled - np.uint64(0x0101010101010101)) & ~filled & np.uint64(0x8080808080808080))
    if len(has):
        out[has] = (chunk[has].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width] == 0).argmax(axis=1)
    return out


def _seeds(text: np.ndarray, star: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order of their first depth characters, and the common prefixes with the one before.

    Some characters at a time: each round sorts those that are still equal to a
    neighbour by (group, next characters), and settles the common prefixes of
    those that come apart, reach a separator or reach the depth.
    """
    padded = np.concatenate([text.astype(np.uint8), np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    order, lcp = star.copy(), np.zeros(len(star), np.int32)
    at, group, done = np.arange(len(star)), np.zeros(len(star), np.uint64), 0
    while done < depth and len(at):
        # The group and as many characters as fit beside it in one number.
        width = min((64 - int(group[-1]).bit_length()) // 8, depth - done, 8)
        own = order[at]
        key = words[own + done].astype(np.uint64) >> np.uint64(64 - 8 * width)
        if width < 8:
            key |= group << np.uint64(8 * width)
        by_key = np.argsort(key)
        key, order[at] = key[by_key], own[by_key]
        chunk = key << np.uint64(64 - 8 * width)
        zero = _first_zero(chunk, width)
        same, apart = np.zeros(len(key), bool), np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        apart[1:] = ~same[1:] & (group[1:] == group[:-1])
        differ = chunk[apart] ^ chunk[np.flatnonzero(apart) - 1]
        equal = sum((differ >> np.uint64(64 - 8 * k) == 0).astype(np.int32) for k in range(1, width + 1))
        lcp[at[apart]] = done + np.minimum(equal, zero[apart])
        lcp[at[same]] = done + zero[same]
        done += width
        going_on = same.copy()
        going_on[:-1] |= same[1:]
        going_on &= zero == width
        at, group = at[going_on], (np.cumsum(~same[going_on]) - 1).astype(np.uint64)
    return order, lcp


class _Induction:
    """Hands left neighbours of ordered suffixes on to their queues and works out common prefixes by range minima."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: list[Queue], depth: int):
        self.text, self.wanted, self.queues, self.depth = text, wanted, queues, depth
        # Least common prefix among the sources taken since a queue was last given a tuple.
        self.least = np.zeros(len(queues), np.int32)

    def take(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """at: suffixes in order; lcp: their common prefixes with the source taken before each."""
        if not len(at):
            return
        has = at > 0
        left = np.where(has, at - 1, 0)
        ok = np.flatnonzero(has & self.wanted[left])
        chars = self.text[left[ok]]
        order = np.argsort(chars, kind="stable")
        ok, chars = ok[order], chars[order]
        edges = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1]))) if len(ok) else np.zeros(0, int)
        bounds = np.append(edges, len(ok))
        whole = np.minimum.reduce(lcp)
        before = self.least.copy()
        self.least = np.minimum(self.least, whole)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows, c = ok[a:b], int(chars[a])
            starts = np.concatenate(([0], rows[:-1] + 1))
            # reduceat over [start, row]: each segment ends where the next one begins.
            low = np.minimum.reduceat(lcp[: rows[-1] + 1], starts).astype(np.int32)
            low[0] = min(low[0], before[c])
            queue = self.queues[c]
            value = np.minimum(low + 1, self.depth) if c else np.zeros(len(rows), np.int32)
            if queue.n == 0:
                value[0] = 0
            queue.push(left[rows], value)
            self.least[c] = np.minimum.reduce(lcp[rows[-1] + 1 :]) if rows[-1] + 1 < len(lcp) else self.depth


def scratch_dir() -> str | None:
    """The scratch folder that Spark gives its Python workers, where its own external sorts spill as well; the system's where there is none (outside of tasks)."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)


def suffix_order(text: np.ndarray, depth: int, step: int = STEP, in_memory: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (positions, common prefixes with the suffix before), in suffix order.

    text: characters from 1 to 255, and 0 for separators, which sort before them
    and end every common prefix. The order counts the first depth characters;
    suffixes equal so far come in any order. Common prefixes stop at depth. The
    last character must be a separator.
    """
    n = len(text)
    if not n:
        return
    if text[-1] != 0:
        raise ValueError("the text must end with a separator")
    if text.max() >= SYMBOLS:
        raise ValueError(f"characters must be below {SYMBOLS}")
    text = text.astype(np.int16)
    s_type = types(text)
    star = np.flatnonzero(s_type & np.concatenate(([False], ~s_type[:-1])))
    seeds, seed_lcp = _seeds(text, star, depth)
    first = np.searchsorted(text[seeds], np.arange(SYMBOLS + 1))
    with tempfile.TemporaryDirectory(prefix="induced-", dir=scratch_dir()) as folder:
        l_queues = [Queue(folder, f"l{c}", in_memory) for c in range(SYMBOLS)]
        induce = _Induction(text, ~s_type, l_queues, depth)
        for c in range(SYMBOLS):
            for rows in l_queues[c].steps(step):
                lcp = rows["lcp"].copy()
                induce.take(rows["at"], lcp)
            a, b = int(first[c]), int(first[c + 1])
            for i in range(a, b, step):
                lcp = seed_lcp[i : min(b, i + step)].copy()
                if i == a:
                    lcp[0] = 1 if c and l_queues[c].n else 0
                    if c and l_queues[c].n:
                        last = l_queues[c].read(l_queues[c].n - 1, 1)["at"]
                        lcp[0] = common(text, last, seeds[i : i + 1], depth)[0]
                induce.take(seeds[i : min(b, i + step)], lcp)
        # From the greatest down: a queue's common prefix is with the tuple before, which is the next larger suffix.
        s_queues = [Queue(folder, f"s{c}", in_memory) for c in range(SYMBOLS)]
        induce = _Induction(text, s_type, s_queues, depth)
        s_queues[0].push(np.array([n - 1]), np.array([0], np.int32))  # the last separator has no right neighbour to hand it on
        for c in range(SYMBOLS - 1, -1, -1):
            for rows in s_queues[c].steps(step):
                induce.take(rows["at"], rows["lcp"].copy())
            queue = l_queues[c]
            joint = 0
            if queue.n and s_queues[c].n and c:
                joint = int(common(text, queue.read(queue.n - 1, 1)["at"], s_queues[c].read(s_queues[c].n - 1, 1)["at"], depth)[0])
            end = queue.n
            while end > 0:
                start = max(0, end - step)
                rows = queue.read(start, end - start)[::-1]
                # Backwards, a suffix's common prefix with the one taken before it is that one's own.
                after = queue.read(end, 1)["lcp"] if end < queue.n else np.array([joint], np.int32)
                induce.take(rows["at"], np.concatenate((after, rows["lcp"][:-1])).astype(np.int32))
                end = start
        for c in range(SYMBOLS):
            lead = 0
            for rows in l_queues[c].steps(step):
                yield rows["at"], rows["lcp"]
            queue = s_queues[c]
            if queue.n and l_queues[c].n and c:
                lead = int(common(text, l_queues[c].read(l_queues[c].n - 1, 1)["at"], queue.read(queue.n - 1, 1)["at"], depth)[0])
            end = queue.n
            while end > 0:
                start = max(0, end - step)
                rows = queue.read(start, end - start)
                # Forwards, it is the common prefix of the next tuple in the queue.
                own = np.concatenate((rows["lcp"][1:], queue.read(end, 1)["lcp"] if end < queue.n else np.array([lead], np.int32)))
                yield rows["at"][::-1], own[::-1]
                end = start

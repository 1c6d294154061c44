"""Spelling variants, exact top-k and the conversation trie against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import pivot_index, prefix_trie, spelling

LETTERS = "abcdeé"


def _variants(words: dict[str, int]) -> dict[str, tuple]:
    def apart(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        near = [v for v in words if apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best is not None and words[best] >= 5 * n else None, len(near))
    return out


def _words(rng, k: int) -> list[str]:
    return ["".join(rng.choice(list(LETTERS), int(rng.integers(6, 10)))) for _ in range(k)]


def test_halves_find_all_words_one_edit_apart(spark):
    """Few letters, so that halves are shared by many words, doubled letters are common, and tiles are many."""
    rng = np.random.default_rng(1)
    words = dict.fromkeys(_words(rng, 900), 0)
    for w in list(words)[:300]:
        i = int(rng.integers(0, len(w)))
        for v in (w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + "z" + w[i + 1 :]):
            if len(v) >= 6:
                words[v] = 0
    words = {w: int(rng.integers(5, 200)) for w in words} | {"begins" + w: 7 for w in list(words)[:150]}
    wanted = _variants(words)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    for held, scanned, shard in ((20_000, 40_000, 20_000), (150, 200, 400)):
        got = {r["word"]: r for r in spelling.near_words(frame, len(words), shard, held, scanned).collect()}
        assert {w: r["n_near"] for w, r in got.items()} == {w: n for w, (_, n) in wanted.items() if n}
        for w, (form, n) in wanted.items():
            if form is not None:
                assert got[w]["best"] == form


def test_spelling_variants_of_documents(spark, docs, empty):
    rng = np.random.default_rng(2)
    vocabulary = _words(rng, 60)
    texts = [" ".join(rng.choice(vocabulary, 40)) + " Colour COLOUR colour colours; " * 9 for _ in range(40)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[0], 1, "x"), (None, texts[0], 1, "x"), (7, None, 1, "x"), (8, "", 1, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int, word string")
    words: Counter[str] = Counter()
    for i, t, *_ in rows:
        for run in (t or "").replace(";", "").lower().split():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = Counter({w: n for w, n in words.items() if n >= 5 and len(w) >= 6})
    wanted = _variants(words)
    got = {r["word"]: r for r in spelling.spelling_variants(frame).collect()}
    assert {w: r["n"] for w, r in got.items()} == dict(words)
    for w, (form, n_near) in wanted.items():
        end = w
        while wanted[end][0]:
            end = wanted[end][0]
        assert (got[w]["form"], got[w]["n_near"], got[w]["root"], got[w]["form_n"]) == (form, n_near, end, words[form] if form else None)
    assert spelling.spelling_variants(docs).filter("word = 'quick'").count() == 0  # five letters
    assert spelling.spelling_variants(empty).count() == 0


def test_only_ascii_letters_are_lowered():
    assert spelling.counted_words(1, "ÉCOLES École") == Counter({"Écoles": 1})  # the other has five letters
    assert spelling.counted_words(None, None) == Counter()


def test_chains_of_forms_end(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [(f"x{i}", "w3") for i in range(50)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w9"}


def _top(vectors: list[tuple], k: int) -> list[tuple]:
    fine = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in vectors if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, a in fine:
        if q % 10 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "copies", "lengths", "large"])
def test_top_k_is_exact(spark, monkeypatch, kind):
    """Clusters with many annuli, a third of all vectors equal, lengths that differ much, and components whose products need more than a double."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.05, (600, 8)) + rng.normal(0, 1, (12, 8))[rng.integers(0, 12, 600)]
    if kind == "copies":
        x[::3] = x[0]
    if kind == "lengths":
        x *= rng.lognormal(0, 2, (600, 1))
    if kind == "large":
        x *= 1e5
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    monkeypatch.setattr(pivot_index, "ANNULUS_ROWS", 10)
    monkeypatch.setattr(pivot_index, "TILE_ROWS", 50)
    monkeypatch.setattr(pivot_index, "FIT_ROWS", 200)
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in pivot_index.top_k(frame, F.col("vec_id") % 10 == 0, 7).collect())
    assert got == _top(vectors, 7)


def test_annuli_are_left_out_by_the_triangle_bound():
    """Tight clusters far apart: the best annuli of a query hold the answer, and the bounds of most others exclude them."""
    rng = np.random.default_rng(4)
    x = np.floor(1024 * (rng.normal(0, 0.02, (4000, 8)) + rng.normal(0, 1, (20, 8))[rng.integers(0, 20, 4000)]))
    squared = (x * x).sum(axis=1)
    index = pivot_index.Index(x, squared.max(), 80 * pivot_index.ANNULUS_ROWS)
    annulus, far = index.annuli(x)
    held = pd.DataFrame({"annulus": annulus, "far": far}).groupby("annulus")["far"].agg(["min", "max", "size"]).reset_index().set_axis(["annulus", "least", "greatest", "n"], axis=1)
    bounds = pivot_index.Bounds(index, held)
    order, best = bounds.order(x[:50])
    s = pivot_index.scores(x, x[:50])
    tenth = np.sort(s, axis=0)[-11]
    for q in range(50):
        top = {bounds.annulus[i] for i in order[q][best[q] >= tenth[q]]}
        assert set(annulus[s[:, q] >= tenth[q]]) <= top
    assert (best >= tenth[:, None]).mean() < 0.5


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [None, 1.0]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (50, []), (None, [1.0, 1.0]), (1, [1.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (60, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, rank string")
    got = sorted(tuple(r) for r in pivot_index.top_k(frame, F.col("vec_id") % 10 == 0).collect())
    assert got == _top(rows, 10)
    assert {r[0] for r in got} == {0, 50, 60}
    assert pivot_index.top_k(frame.limit(0), F.lit(True)).count() == 0
    assert pivot_index.top_k(frame.filter("vec_id = 0"), F.lit(True)).count() == 0


def _trie(rows: list[tuple]) -> list[tuple]:
    own: dict[int, list] = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = turns.get(c - int(np.fmod(c, 5)), [])[:h] + turns[c][h:]
    members: dict[tuple, list[int]] = defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += p not in children
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(full[c]) == len(p)))).encode()).hexdigest()
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items()], key=key)


def _nodes(frame) -> list[tuple]:
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).collect()), key=lambda r: tuple((x is not None, x) for x in r))


SHAPE = "conv_id long, turn long, role string, text string, depth int, node string, n string"


def test_trie_of_odd_conversations(spark):
    """Few texts, so that prefixes are shared; nulls, ties, repeated rows, negative ids, absent families and turnless conversations."""
    rng = np.random.default_rng(5)
    rows = []
    for c in [*range(-12, 60), 1001, 1002, 10**15 + 3]:
        for t in range(int(rng.integers(1, 14))):
            rows.append((c, None if rng.random() < 0.05 else int(rng.integers(0, t + 1)) if rng.random() < 0.1 else t, rng.choice(["user", "assistant"]) if rng.random() < 0.9 else None, rng.choice(["a", "é", "", "😀"]) if rng.random() < 0.9 else None))
    rows += rows[:5] + [(None, 1, "user", "nobody"), (None, None, None, None)]
    frame = spark.createDataFrame([(*map(lambda x: x.item() if hasattr(x, "item") else x, r), 3, "x", "y") for r in rows], SHAPE)
    assert _nodes(frame) == _trie(rows)
    assert _nodes(frame.limit(0)) == []
    assert _nodes(frame.filter("conv_id is null")) == []


def test_trie_of_copies_and_of_a_long_conversation(spark, monkeypatch):
    """A third of all conversations equal, and one whose turns lie in many ranges and blocks; both twice, so that long chains save."""
    monkeypatch.setattr(prefix_trie, "IDS_A_BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "TURNS_A_BLOCK", 32)
    rows = [(5 * c, t, "user", f"text {t}") for c in range(100) for t in range(3)]
    rows += [(1000 + 5 * c, t, "user", f"long {t}") for c in range(2) for t in range(400)]
    rows += [(2000 + c, t, "user", f"own {c} {t}") for c in range(50) for t in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert _nodes(frame) == _trie(rows)

"""Names alike and one-to-one matching against all pairs."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import master

LETTERS = list("ABCDE")


def _family(rng, k: int, least: int = 5, most: int = 40) -> list[str]:
    """Random keys of few letters, and others a few letters away."""
    out = set()
    while len(out) < k:
        w = "".join(rng.choice(LETTERS, int(rng.integers(least, most))))
        for _ in range(5):
            out.add(w)
            for _ in range(int(rng.integers(1, 3))):
                i = int(rng.integers(0, len(w) + 1))
                w = w[:i] + str(rng.choice(LETTERS)) + w[i:] if rng.random() < 0.5 or len(w) < 6 else w[:i] + w[i + 1 :]
    return sorted(out)[:k]


@pytest.mark.parametrize("ratio", [0.92, 0.85])
def test_no_pair_alike_is_lost(spark, ratio):
    rng = np.random.default_rng(1)
    keys = _family(rng, 400) + [f"PRIVATEHOLDINGSOFNORTH{i}COMPANY" for i in range(100, 130)]
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {frozenset((r["ka"], r["kb"])) for r in master.near_keys(frame, ratio).collect()}
    wanted = {frozenset((a, b)) for i, a in enumerate(keys) for b in keys[:i] if abs(len(a) - len(b)) <= (1 - ratio) * (len(a) + len(b)) + 1e-9 and a != b and master.similar_keys(min(a, b), max(a, b), False, ratio)}
    assert wanted and wanted <= got
    assert len(got) == master.near_keys(frame, ratio).count()  # each pair once


def test_a_common_beginning_makes_no_candidates(spark):
    """1,500 names that begin and end alike: 1,124,250 pairs, of which one in eight has a rare gram in common, and hardly any goes on to the ratio."""
    rng = np.random.default_rng(2)
    keys = sorted({f"PRIVATEHOLDINGS{''.join(rng.choice(list('ABCDEFGHIJKLMNOPQRST'), 12))}COMPANY" for _ in range(1500)})
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    assert master.met_keys(frame).count() < 150_000 and master.near_keys(frame).count() < 1_000
    # Names whose numbers differ in a digit or two are alike in truth: no more candidates than pairs.
    numbers = spark.createDataFrame([(f"PRIVATEHOLDINGSOFNORTH{i}COMPANY",) for i in range(100, 400)], "k string")
    assert master.near_keys(numbers).count() <= 300 * 299 // 2


def test_ratios_that_grams_cannot_find_are_refused(spark):
    with pytest.raises(ValueError):
        master.near_keys(spark.createDataFrame([("ABCDEF",)], "k string"), 0.5)


def _greedy(edges: list[tuple]) -> set[tuple]:
    used, out = set(), set()
    for _, l, r in sorted({(-s, l, r) for l, r, s in edges}):
        if ("l", l) not in used and ("r", r) not in used:
            used |= {("l", l), ("r", r)}
            out.add((l, r))
    return out


def test_greedy_pairs_are_those_of_one_walk(spark):
    rng = np.random.default_rng(3)
    edges = [(f"a{int(a)}", f"b{int(b)}", float(s)) for a, b, s in zip(rng.integers(0, 300, 3000), rng.integers(0, 300, 3000), rng.integers(0, 20, 3000) / 20, strict=True)]
    edges += [(f"c{i // 2}", f"d{(i + 1) // 2}", i / 100) for i in range(12)]  # a chain, each edge better than the one before
    edges += [("hot", f"e{i}", 0.5) for i in range(500)]
    frame = spark.createDataFrame([*edges, (None, "b1", 9.0), ("a1", None, 9.0)], "l string, r string, s double")
    got = [tuple(x) for x in master.greedy_pairs(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == _greedy(edges)
    assert master.greedy_pairs(frame.limit(0)).count() == 0


def test_one_to_one_with_a_large_component(spark):
    """Two lists of numbered names, all of one component, and lists of random ones."""
    rng = np.random.default_rng(4)
    numbered = [f"NORTH RIVER TRADING HOUSE {i}" for i in range(100, 180)]
    others = _family(rng, 120, 14, 24)
    left, right = numbered[::2] + others[::2] + [None, "--"], numbered[1::2] + others[1::2] + [numbered[0], None, "--"]
    frame = lambda names: spark.createDataFrame([(n, 1) for n in names], "name string, s int")
    got = [tuple(x) for x in master.fuzzy_one_to_one(frame(left), frame(right)).collect()]
    key = lambda n: "".join(c for c in n.upper() if c.isalnum())
    edges = [(p, q, 1.0 if p == q else SequenceMatcher(None, p, q).ratio()) for p in left if p for q in right if q and key(p) and key(q) and (p == q or master.similar_keys(min(key(p), key(q)), max(key(p), key(q)), False))]
    assert len(got) > 40 and set(got) == _greedy(edges) and len(got) == len(set(got))


def _walked(left, right):
    """One walk over all pairs in order."""
    from tallyforge.functions.text import CORPORATE_FORMS

    def keys(name):
        up, token = name.upper(), name.upper()
        for pattern, put in CORPORATE_FORMS.items():
            token = re.sub(pattern, put, token)
        return {re.sub("[^A-Z0-9]", "", x) for x in (up, token)}

    alike = lambda a, b: any(master.similar_keys(min(p, q), max(p, q), False) for p in keys(a) for q in keys(b))
    edges = sorted((-SequenceMatcher(None, a, b).ratio(), a, b) for a in left for b in right if alike(a, b))
    out, gone = [], set()
    for _, a, b in edges:
        if (0, a) not in gone and (1, b) not in gone:
            out.append((a, b))
            gone |= {(0, a), (1, b)}
    return sorted(out)


def test_nearly_equal_names_first_give_one_walk_over_all_pairs(spark):
    rng = random.Random(11)
    left = sorted({" ".join(("HARBOUR", "".join(rng.choices("AB4", k=rng.randint(4, 9))), rng.choice(("COPPER", "MEADOW")), "TRADING")) for _ in range(120)})
    right = set(rng.sample(left, 15))
    for name in rng.sample(left, 80):
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice(("", "A", "4", name[at] * 2)) + name[at + 1 :]
        right.add(name)
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = [tuple(x) for x in master.fuzzy_one_to_one(frame(left), frame(sorted(right))).collect()]
    assert sorted(got) == _walked(left, sorted(right)) and len(got) > 60


def test_names_meet_without_a_broadcast_and_only_across_sides(spark):
    names = [(f"RIVER {i:06d} COPPER TRADING", 1) for i in range(200)]
    frame = spark.createDataFrame(names, "k string, side int")
    met = master.met_keys(frame)
    # What is exploded is many times as large as Spark takes it for: by a broadcast all of it would pass the driver.
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 0 and master.met_keys(frame.select("k")).count() > 200

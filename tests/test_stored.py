"""Stored tables that are edited, numbers without one task, and rows placed between others."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import placing, reconcile
from tallyforge.sources import stored, tables

SHAPE = "id string, ts long, status string, total int"


def _rows(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_upsert_update_and_delete(spark, tmp_path):
    t = stored.StoredTable(spark, str(tmp_path / "t"), ["id"], SHAPE, buckets=16)
    assert _rows(t.read()) == [] and t.version().number == 0
    put = lambda rows, shape=SHAPE: spark.createDataFrame(rows, shape)
    t.upsert(put([(f"k{i}", i, "new", None) for i in range(200)] + [(None, 0, "null key", 1)]))
    first = t.version()
    t.upsert(put([("k3", 50, "done", 7), ("k3", 51, "later", 8), ("x", 1, "added", 2), (None, 9, "again", 3)]), order="ts")
    model = {f"k{i}": (f"k{i}", i, "new", None) for i in range(200)} | {"k3": ("k3", 51, "later", 8), "x": ("x", 1, "added", 2), None: (None, 9, "again", 3)}
    assert _rows(t.read()) == sorted(model.values(), key=str)
    # Only buckets with touched keys have new folders.
    second = t.version()
    changed = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert 0 < len(changed) <= 3
    # Columns that are not given keep what they had.
    t.upsert(put([("k5", "partly")], "id string, status string"))
    model["k5"] = ("k5", 5, "partly", None)
    t.delete(put([("k7",), ("nobody",), (None,)], "id string"))
    del model["k7"], model[None]
    assert _rows(t.read()) == sorted(model.values(), key=str)
    assert len(_rows(t.read(first.number))) == 201 and t.version().number == 4
    t.delete(t.read().select("id"))
    assert _rows(t.read()) == []


def test_update_latest_entry_only(spark, tmp_path):
    t = stored.StoredTable(spark, str(tmp_path / "h"), ["id"], SHAPE, buckets=4)
    rows = [(f"k{i % 20}", i, "seen", i) for i in range(60)]
    t.append(spark.createDataFrame(rows, SHAPE))
    t.append(spark.createDataFrame([("k1", 100, "late", None)], SHAPE))
    t.update_latest(spark.createDataFrame([("k1", "done", None), ("k2", None, 5), ("none", "x", 1)], "id string, status string, total int"), ["ts"])
    wanted = [r if r[:2] != ("k2", 42) else ("k2", 42, "seen", 5) for r in rows] + [("k1", 100, "done", None)]
    assert _rows(t.read()) == sorted(wanted, key=str)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    t = stored.StoredTable(spark, str(tmp_path / "t"), ["id"], SHAPE)
    row = lambda k: spark.createDataFrame([(k, 1, "s", 1)], SHAPE)
    seen = t.upsert(row("a"))
    t.upsert(row("b"), base=seen)
    with pytest.raises(stored.Conflict):
        t.upsert(row("c"), base=seen)
    assert {r[0] for r in _rows(t.read())} == {"a", "b"}
    t.upsert(row("c"))
    assert {r[0] for r in _rows(t.read())} == {"a", "b", "c"}


def test_numbers_over_many_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"a{i % 7}", int(v)) for i, v in enumerate(rng.permutation(3000))]
    frame = spark.createDataFrame(rows, "k string, v int").repartition(6)
    got = {(r["k"], r["v"]): r["n"] for r in stored.numbered(frame, [F.col("v").desc()], "n", ["k"]).collect()}
    by: dict = {}
    for k, v in sorted(rows, key=lambda r: -r[1]):
        by[k] = by.get(k, 0) + 1
        assert got[(k, v)] == by[k]
    assert [r["n"] for r in stored.numbered(frame, [F.col("v")]).orderBy("v").collect()] == list(range(1, 3001))
    assert stored.numbered(frame.limit(0), [F.col("v")]).count() == 0


def test_edits_by_row_number(spark):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(1, 301)], "row_no int, name string")
    edits = [("update", i, 7 * i, f"u{i}") for i in range(1, 20)] + [("delete", 100 + i, 5 * i, None) for i in range(1, 15)] + [("append", 200 + i, None, f"n{i}") for i in range(5)]
    got = [(r["row_no"], r["name"]) for r in tables.edited(rows, spark.createDataFrame(edits, "action string, edit_no int, row_no int, name string")).orderBy("row_no").collect()]
    names = {i: f"r{i}" for i in range(1, 301)} | {7 * i: f"u{i}" for i in range(1, 20)}
    for i in range(1, 15):
        del names[5 * i]
    assert got == list(enumerate([names[i] for i in sorted(names)] + [f"n{i}" for i in range(5)], 1))


def _list_insert(order: list, plan: list[tuple]) -> list:
    """plan: (row, block, seq, upper, lower): the same by list inserts."""
    out, first = list(order), order[0] if order else None
    groups: dict = {}
    for row, block, seq, upper, lower in plan:
        at = ("above", lower) if lower in order else ("below", upper) if upper in order else ("above", first)
        if at[0] == "below":
            i = order.index(at[1])
            at = ("above", order[i + 1]) if i + 1 < len(order) else ("end", None)
        groups.setdefault(at, []).append((block, seq, row))
    for (how, anchor), rows in groups.items():
        i = len(out) if how == "end" or anchor is None else out.index(anchor)
        out[i:i] = [("new", r) for *_, r in sorted(rows)]
    return out


def test_placed_rows_take_labels_between_their_neighbours(spark, monkeypatch):
    ledger = spark.createDataFrame([("A", i) for i in range(40)] + [("B", i) for i in range(3)] + [(None, 0)], "account_number string, row_pos long")
    plan = [("A", 1, 0, 0, None, 5), ("A", 2, 0, 1, None, 5), ("A", 3, 1, 0, None, 5), ("A", 4, 2, 0, 39, None), ("A", 5, 3, 0, None, None), ("B", 1, 0, 0, 0, 1), ("B", 2, 1, 0, 1, None), (None, 1, 0, 0, None, 0), ("C", 1, 0, 0, None, None)]
    frame = spark.createDataFrame(plan, "account_number string, row_pos long, block int, seq int, upper_row long, lower_row long")
    for gap in (1 << 40, 2):
        monkeypatch.setattr(placing, "GAP", gap)
        labels = placing.labelled(ledger, [F.col("row_pos")])
        added, moved = placing.inserted(labels, frame)
        new = {(r[0], r[1]): r[2] for r in moved.collect()}
        assert bool(new) == (gap == 2)
        old = {(r[0], r[1]): r[2] for r in labels.select("account_number", "row_pos", "label").collect()} | new
        for account in ("A", "B", None, "C"):
            rows = [(v, p) for (a, p), v in old.items() if a == account] + [(r[2], ("new", r[1])) for r in added.collect() if r[0] == account]
            assert len({v for v, _ in rows}) == len(rows)
            wanted = _list_insert([p for a, p in sorted(((r[0], r[1]) for r in ledger.collect()), key=str) if a == account] if account != "A" else list(range(40)), [p[1:] for p in plan if p[0] == account])
            assert [p for _, p in sorted(rows, key=lambda x: x[0])] == wanted


def test_a_chain_enters_the_stored_ledger(spark, tmp_path):
    """The plan of chain placement applied: its rows are appended with labels, and the ledger read back in order has balances that follow each other; then once more at the same place."""
    whole = [("A", i, float(100 * (20 - i)), 100.0, 0.0) for i in range(20)]
    shape = "account_number string, row_pos long, balance double, credits double, debits double"
    missing = {7, 8, 9, 13}
    existing = spark.createDataFrame([r for r in whole if r[1] not in missing], shape)
    new = spark.createDataFrame([r for r in whole if r[1] in missing], shape)
    t = stored.StoredTable(spark, str(tmp_path / "ledger"), ["account_number", "row_pos"], f"{shape}, label {placing.LABEL}", buckets=4)
    t.append(placing.labelled(existing, [F.col("row_pos")]))
    for part in ("row_pos < 10", "row_pos >= 10"):
        plan = reconcile.placed(new.filter(part), t.read())
        added, moved = placing.inserted(t.read().select("account_number", "row_pos", "label"), plan)
        before = t.version()
        t.append(new.join(added, ["account_number", "row_pos"]))
        assert moved.count() == 0 and all(t.version().folders[b][: len(f)] == f for b, f in before.folders.items())
    assert [r["row_pos"] for r in t.read().orderBy("label").collect()] == list(range(20))

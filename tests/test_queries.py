"""Every ledger query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tallyforge.plans import further, ledger, more, stores, streams, tabular  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    shown = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in shown.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ledger.QUERIES))
def test_query(spark, duck, name):
    got = ledger.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ledger.ORACLES:
        wanted = duck.execute(ledger.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        columns = sorted(got.columns)
        norm = lambda x: [tuple(s.removesuffix(".0") for s in r) for r in rows(x, columns)]
        assert norm(got) == norm(wanted)


def test_three_way_conserves_rows(spark):
    from tallyforge.plans.ledger import _ledgers

    auto, _ = _ledgers(spark, SF)
    got = ledger.greedy_three_way(spark, SF)
    assert got.count() == auto.count()
    assert got.filter("main_pos is not null").count() == got.filter("main_pos is not null").select("account_number", "main_pos").distinct().count()

"""Registered queries of the library give their oracles' rows on the smallest driver tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from waymark.plans import bindings, q_datasets, q_diff, q_stages
from waymark.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_bindings():
    """Tables that many queries build on are computed once for all tests; the queries themselves stay as they are."""
    kept, modules, undo = {}, (bindings, q_diff, q_stages, q_datasets), []

    def once(f):
        def g(spark, sf_dir, *rest):
            if rest:
                return f(spark, sf_dir, *rest)
            if f not in kept:
                kept[f] = f(spark, sf_dir).cache()
            return kept[f]

        return g

    for home, names in ((bindings, ["checkpoints", "findings", "observations", "completion"]), (q_diff, ["deltas", "runs", "changes"])):
        for name in names:
            f = getattr(home, name)
            g = once(f)
            for m in modules:
                if getattr(m, name, None) is f:
                    undo.append((m, name, f))
                    setattr(m, name, g)
    yield
    for m, name, f in undo:
        setattr(m, name, f)
    for df in kept.values():
        df.unpersist()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(f"{float(v):.7g}") if isinstance(v, (float,)) or type(v).__name__ == "Decimal" else v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == sorted_rows([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0

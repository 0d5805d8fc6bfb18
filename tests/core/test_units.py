"""Points-to by units: the same rows as by rounds, whatever units share, hold or lack."""

import random

import pytest

import __spark_entry__
from meetflow.plans import analyses, rounds


def plain(rel):
    """A worklist; null names get, but give nothing."""
    pts = set(rel["address"])
    while True:
        held = {(q, x) for q, x in pts if q is not None}
        new = {(p, x) for p, q in rel["copy"] for r, x in held if r == q}
        new |= {(p, x) for p, q in rel["load"] for r, t in held if r == q for u, x in held if u == t}
        new |= {(t, x) for p, q in rel["store"] for r, t in held if r == p for u, x in held if u == q}
        if new <= pts:
            return pts
        pts |= new


@pytest.mark.parametrize("shared, most_rows", [(0, 1000), (3, 22)])
def test_units_as_by_rounds(spark, shared, most_rows):
    """Eight units, some with null names, two that point to null; without shared names and with, all within bounds and some beyond."""
    rng = random.Random(20 + shared)
    rel = {k: set() for k in ("address", "copy", "load", "store")}
    for unit in range(8):
        names = [*range(100 * unit, 100 * unit + 9), *([None] if unit % 2 else [])]
        for k, n in (("address", 5), ("copy", 6), ("load", 5), ("store", 5)):
            others = names[:9] if k == "address" and unit < 6 else names
            rel[k] |= {(unit if unit else None, rng.choice(names), rng.choice(others)) for _ in range(n + unit % 3)}
    rel["address"] |= {(6, None, None), (7, None, None)}
    for _ in range(shared):
        rel["copy"].add((rng.randrange(1, 5), 100 * rng.randrange(1, 5) + 1, 100 * rng.randrange(1, 5) + 2))
    d = {k: spark.createDataFrame(sorted(v, key=str), f"file int, p long, {'x' if k == 'address' else 'q'} long") for k, v in rel.items()}
    got = [tuple(r) for r in analyses.points_to(**d, near=["file"], most_rows=most_rows).collect()]
    want = plain({k: {r[1:] for r in v} for k, v in rel.items()})
    assert sorted(got, key=str) == sorted(want, key=str)


def test_names_of_text_and_no_rows(spark):
    f = lambda r, s: spark.createDataFrame(r, s)
    none = f([], "file int, p string, q string")
    d = {"address": f([(1, "p", "a"), (1, "q", "b"), (2, "z", "y")], "file int, p string, x string"), "copy": none, "load": f([(1, "r", "p")], "file int, p string, q string"), "store": f([(1, "p", "q")], "file int, p string, q string")}
    got = analyses.points_to(**d, near=["file"])
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("p", "a"), ("q", "b"), ("r", "b"), ("z", "y")]
    assert not analyses.points_to(none.withColumnRenamed("q", "x"), none, none, none, near=["file"]).count()


def test_query_in_few_tables(spark, sf, monkeypatch):
    """Users share no names: the query's tables don't follow the longest chain of any user."""
    put, seen = rounds.Tables.put, []
    monkeypatch.setattr(rounds.Tables, "put", lambda self, df, *a: seen.append(df.columns) or put(self, df, *a))
    assert __spark_entry__.queries()["points_to_memory"](spark, sf).count()
    assert len(seen) <= 6

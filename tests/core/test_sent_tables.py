"""What joins do with tables of rounds: few rows are sent whole, many never are, however small their files."""

import pytest

from meetflow.plans import rounds


def plan(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_in_small_files(spark):
    """Sorted ids take a byte or so a row; as many as driver memory has no room for look like few by the size of their files."""
    rows = 2 * rounds.FEW
    with rounds.Tables(spark) as t:
        many = t.keep(spark.range(rows, numPartitions=1).selectExpr("cast(id / 50 as int) as fn", "cast(id % 50 as int) as node"))
        few = t.keep(spark.range(100).selectExpr("cast(id as int) as fn", "0 as node"))
        also = t.keep(many.selectExpr("fn", "node", "node + 1 as next"))
        joined = many.select("fn", "node").join(also, ["fn", "node"])
        assert "Broadcast" not in plan(joined) and joined.count() == rows
        assert "Broadcast" not in plan(many.join(also, ["fn", "node"], "left_anti"))
        sent = also.join(few, ["fn", "node"])
        assert "BroadcastHashJoin" in plan(sent) and sent.count() == 100


@pytest.mark.parametrize("with_known", [False, True])
def test_few_new_rows_among_many(spark, monkeypatch, with_known):
    """Closures are the same where known rows are only read: cycles, nulls, rows found again."""
    monkeypatch.setattr(rounds, "FEW", 5)
    monkeypatch.setattr(rounds, "MANY", 6)
    edges = spark.createDataFrame([(f, i, (i + 1) % 23) for f in (1, 2, None) for i in range(23)] + [(1, 3, 17), (1, 9, 2)], "fn int, node int, nxt int")
    seed = spark.createDataFrame([(1, 0), (1, 11), (2, 5), (None, 22), (2, 5)], "fn int, node int")

    def step(delta, known=None):
        same = delta["fn"].eqNullSafe(edges["fn"]) & (delta["node"] == edges["node"])
        return delta.join(edges, same).select(delta["fn"], edges["nxt"].alias("node"))

    got = rounds.close_rows(seed, step, with_known=with_known).collect()
    assert sorted(map(str, got)) == sorted(f"Row(fn={f}, node={i})" for f in (1, 2, None) for i in range(23))


def test_lock_step_sees_new_rows(spark):
    """Where steps distribute over union, a round joins what the last one added, not all that is known; the result is the same."""
    from meetflow.plans.framework import close_together

    hop = spark.createDataFrame([(i, i + 1) for i in range(15)] + [(15, 3), (4, 9)], "node int, nxt int")
    seeds = {"on": spark.createDataFrame([(0,)], "node int"), "back": spark.createDataFrame([(2,)], "node int")}
    seen = []

    def on(t):
        seen.append(t["on"].count())
        return t["on"].join(hop, "node").select(hop["nxt"].alias("node"))

    steps = {"on": on, "back": lambda t: t["back"].withColumnRenamed("node", "nxt").join(hop, "nxt").select("node")}
    for distributive in (True, False):
        got = close_together(seeds, steps, distributive=distributive)
        assert {k: sorted(r["node"] for r in f.collect()) for k, f in got.items()} == {"on": list(range(16)), "back": [0, 1, 2]}
        if distributive:
            assert max(seen) <= 2 and sum(seen) == 16  # every row once

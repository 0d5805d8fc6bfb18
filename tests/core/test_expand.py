"""Pairs of callers with functions and of pointers with targets: right whatever pointers share, and made without a shuffle."""

import random

import pytest

from meetflow import queries
from meetflow.plans import link, views


def pairs(calls, taken):
    return {(a, f) for a, f, _ in calls if f is not None} | {(a, f) for a, g, p in calls if g is None and p is not None for q, f in taken if q == p}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_call_graph(spark, seed):
    """Functions under several pointers, direct calls to them, repeated rows and nulls."""
    rng = random.Random(seed)
    calls = [(rng.choice([None, *range(12)]), rng.choice([None, None, *range(6)]), rng.choice([None, *range(5)])) for _ in range(80)]
    taken = [(rng.choice([None, *range(5)]), rng.choice([None, *range(8)])) for _ in range(14)] * 2
    got = link.call_graph(spark.createDataFrame(calls, "caller bigint, callee bigint, pointer bigint"), spark.createDataFrame(taken, "pointer bigint, callee bigint")).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == pairs(calls, taken)


def test_call_graph_shuffles_no_pairs(spark):
    """200 callers and 300 functions of one pointer: 60,000 pairs, none of which is written to a shuffle."""
    before = shuffled(spark)
    calls = spark.range(200).selectExpr("id as caller", "cast(null as bigint) as callee", "1L as pointer")
    assert link.call_graph(calls, spark.range(300).selectExpr("1L as pointer", "id as callee")).write.format("noop").mode("overwrite").save() is None
    assert 0 < shuffled(spark) - before < 20_000


def test_deref_shared(spark):
    """The same rows as from pairs, for sets of none, one and many targets."""
    insn = spark.range(40).selectExpr("id as c", "id % 7 as p", "named_struct('xkind', 13, 'op1', id % 7, 'op2', cast(null as bigint), 'args', cast(array() as array<bigint>)) as expr1")
    shares = spark.range(40).selectExpr("id as c", "id % 7 as p", "id % 4 as set")
    members = spark.createDataFrame([(0, 5), (1, 6), (1, 7), (2, 8), (2, 9), (2, 5)], "set bigint, target bigint")
    got = views.deref_shared(insn, shares, members, ["c"], "p", "expr1")
    want = views.deref(insn, shares.join(members, "set").drop("set"), ["c"], "p", "expr1")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 60


def test_view_deref_shuffles_no_pairs(spark, tmp_path):
    """200 customers and 300 suppliers of one nation: 60,000 rows, none of which is written to a shuffle."""
    spark.range(200).selectExpr("id as c_custkey", "3 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(300).selectExpr("id as s_suppkey", "3 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    before = shuffled(spark)
    queries.view_deref(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 20_000


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    return sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(None, False, False, none, None)))

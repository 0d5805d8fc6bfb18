"""Scalars: packed ids, kinds, expressions, facts, ranges."""

import itertools

import pytest
from pyspark.sql import functions as F

from meetflow.functions import scalars as S
from meetflow.functions.kinds import FULL_RANGE, ChangeCode, EntityKind, ExprKind, InsnKind, ValueKind
from meetflow.operators import ranges


def one(spark, *cols):
    return list(spark.range(1).select(*cols).collect()[0])


def test_ids_round_trip(spark):
    kinds = [EntityKind.VAR_GLBL, EntityKind.VAR_LOCL_OTHER, EntityKind.LABEL, EntityKind.BB, EntityKind.SRC_FILE, EntityKind.FUNC]
    rows = [(int(k), s, q) for k in kinds for s in (0, 4, 31) for q in (0, 1, 1048575)]
    d = spark.createDataFrame(rows, "k int, s int, q long")
    e = S.pack_id(F.col("k"), F.col("s"), F.col("q"))
    got = d.select("k", "s", "q", S.kind(e), S.sub_kind(e), S.seq_id(e), S.is_proper(e), S.has_proper_prefix(e), S.is_true_id(e)).collect()
    for k, s, q, gk, gs, gq, proper, prefix, true in got:
        has_sub = not (19 <= k <= 23 or k == 14)
        assert (gk, gs, gq) == (k, s if has_sub else 0, q)
        assert prefix == (not has_sub or s != 0) and proper == (prefix and q != 0) and true


def test_id_bits(spark):
    e = F.lit((3 << 30) | (1 << 25) | (4 << 20) | 9).cast("long")
    assert one(spark, S.top_bits(e), S.is_true_id(e), S.true_id(e), S.sub_kind(S.var_group(e)), S.is_var_group(S.var_group(e))) == [3, False, (1 << 25) | (4 << 20) | 9, 4, True]
    assert one(spark, S.id_text(e, "d"), S.id_text(e, "o"), S.id_text(e, "x"), S.id_text(e, "s")) == ["(eid:3-1-4-9)", "(eid:0o3-1-4-11)", "(eid:0x3-1-4-9)", "(eid:3-VAR_GLBL-INT32-9)"]
    x = F.lit(5).cast("long")
    assert one(spark, S.is_bit_set(x, 2), S.is_bit_set(x, 1), S.set_bit(x, 1), S.clear_bit(x, 0)) == [True, False, 7, 4]
    assert one(spark, S.immediate20(F.lit(1048575), F.lit(4)), S.immediate20(F.lit(1048576), F.lit(4)), S.immediate20(F.lit(1), F.lit(15))) == [1048575, None, None]
    assert one(spark, *[S.fits_immediate(F.lit(v), F.lit(k)) for v, k in ((-524288, 4), (524288, 4), (524288, 8), (-1, 8))]) == [True, False, True, False]


@pytest.mark.parametrize("prefix,bits,ok", [(1, 17, True), (1, 31, True), (2, 31, False), (5, 16, False), (5, 32, False)])
def test_pool_ids(spark, prefix, bits, ok):
    if ok:
        assert one(spark, S.pool_id(F.lit(prefix), F.lit(bits))) == [prefix << 16 | bits]
    else:
        with pytest.raises(Exception, match="invalid pool"):
            one(spark, S.pool_id(F.lit(prefix), F.lit(bits)))


def test_names_and_literals(spark):
    assert one(spark, *[S.simple_name(F.lit(x)) for x in ("v:main:x", "x", "f:")]) == ["x", "x", "0name"]
    n = F.lit(None)
    assert one(spark, S.literal_text(F.lit(3), n, n.cast("string")), S.literal_text(F.lit(3), F.lit(9), n.cast("string")), S.literal_text(F.lit(3), n, F.lit("s"))) == ["3", "9 3", "s"]


def test_kind_predicates(spark):
    d = spark.range(32).select(F.col("id").cast("int").alias("k"))
    k = F.col("k")
    got = {r["k"]: r for r in d.select("k", S.is_integer(k).alias("int"), S.is_floating(k).alias("float"), S.is_pointer(k).alias("ptr"), S.is_array(k).alias("arr"), S.is_record(k).alias("rec"), S.size_in_bytes(k).alias("size"), S.type_class(k).alias("cls")).collect()}
    assert [x for x in got if got[x]["int"]] == list(range(1, 13)) and [x for x in got if got[x]["float"]] == [13, 14, 15]
    assert got[ValueKind.PTR_TO_FUNC]["cls"] == "function" and got[ValueKind.PTR_TO_INT]["cls"] == "pointer" and got[ValueKind.UNION]["cls"] == "record"
    assert got[ValueKind.INT64]["size"] == got[ValueKind.PTR_TO_VOID]["size"] == 8 and got[ValueKind.FLOAT80]["size"] == got[ValueKind.STRUCT]["size"] == 0


def test_expressions(spark):
    x = F.col("x")
    d = spark.range(32).select(F.col("id").cast("int").alias("x"))
    got = {r["x"]: r for r in d.select("x", S.is_single_operand(x).alias("one"), S.is_relational(x).alias("rel"), S.is_commutative(x).alias("com"), S.symbol(x).alias("s"),
                                       S.has_deref(x, F.lit(21), F.lit(4)).alias("d"), S.has_addrof(x, F.lit(12)).alias("a")).collect()}
    assert [k for k in got if got[k]["one"]] == [1, *range(23, 31)] and [k for k in got if got[k]["rel"]] == [13, 14, 15, 16] and [k for k in got if got[k]["com"]] == [2, 4, 7, 8, 9]
    assert [k for k in got if got[k]["d"]] == [17, 18, 19, 20, 21, 26] and [k for k in got if got[k]["a"]] == [1, 18, 20, 27]
    assert got[8]["s"] == "|" and got[9]["s"] == "^" and got[1]["s"] == ""
    ev = lambda k, a, b: S.evaluate(F.lit(int(k)), F.lit(a).cast("long"), F.lit(b).cast("long"))
    assert one(spark, ev(ExprKind.DIV, -7, 2), ev(ExprKind.MOD, -7, 3), ev(ExprKind.DIV, 1, 0), ev(ExprKind.SHRA, -8, 1), ev(ExprKind.SHR, -8, 60), ev(ExprKind.GE, 2, 2)) == [-3, -1, None, -4, 15, 1]
    un = lambda k, a: S.evaluate_unary(F.lit(int(k)), F.lit(a).cast("long"))
    assert one(spark, un(ExprKind.BIT_NOT, 5), un(ExprKind.NEGATE, 5), un(ExprKind.NOT, 0), un(ExprKind.VAL, 3)) == [-6, -5, 1, 3]


def test_replace_pointee(spark):
    e = lambda k: F.struct(F.lit(int(k)).alias("xkind"), F.lit(1).cast("long").alias("op1"), F.lit(2).cast("long").alias("op2"), F.array().cast("array<bigint>").alias("args"))
    got = one(spark, *[S.replace_pointee(e(k), F.lit(9).cast("long")) for k in (ExprKind.DEREF, ExprKind.ARR_INDX, ExprKind.ADD)])
    assert [(r["xkind"], r["op1"]) for r in got] == [(1, 9), (17, 9), (2, 1)]


def test_instructions(spark):
    i = F.col("i")
    d = spark.range(17).select(F.col("id").cast("int").alias("i"))
    got = d.select("i", S.is_assign(i).alias("a"), S.has_call(i).alias("c"), S.is_local_jump(i).alias("j"), S.skipped(i).alias("s")).collect()
    assert [r["i"] for r in got if r["a"]] == list(range(6, 12)) and [r["i"] for r in got if r["c"]] == [10, 12]
    assert [r["i"] for r in got if r["j"]] == [13, 14] and [r["i"] for r in got if r["s"]] == [13, 15]
    assert one(spark, S.checked_kind(F.lit(7)), S.checked_kind(F.lit(99))) == [7, 1]
    for bad in (InsnKind.SELECT, InsnKind.ASGN_PHI):
        with pytest.raises(Exception, match="cannot be loaded"):
            one(spark, S.checked_kind(F.lit(int(bad))))
    t, f = F.lit(True), F.lit(False)
    assert one(spark, S.assign_kind(t, t, f), S.assign_kind(t, f, f), S.assign_kind(f, t, f), S.assign_kind(t, f, t)) == [7, 8, 9, 10]


def test_facts(spark):
    f = F.lit(0).cast("long")
    values = {"version": 5, "point": 4, "entity": 4294967295, "analysis": 4095, "reserved": 3}
    for k, v in values.items():
        f = S.fact_with(f, k, F.lit(v))
    assert one(spark, *[S.fact_get(f, k) for k in values]) == list(values.values())
    assert one(spark, S.fact_get(S.fact_key(f), "version"), S.fact_get(S.fact_key(f), "entity"), S.fact_get(S.fact_next(f, F.lit(True)), "version"), S.fact_get(S.fact_next(f, F.lit(False)), "version")) == [0, 4294967295, 6, 5]
    with pytest.raises(Exception, match="version overflow"):
        one(spark, S.fact_next(S.fact_with(f, "version", F.lit(32767)), F.lit(True)))
    assert one(spark, S.change_text(F.lit(int(ChangeCode.TrueOutChanged))), S.change_text(F.lit(77)), S.has_nop(F.lit(8)), S.has_nop(F.lit(2))) == ["TrueOutChanged", "UnknownFactChange", True, False]


@pytest.mark.parametrize("kind", [ValueKind.INT8, ValueKind.INT32, ValueKind.INT64, ValueKind.UINT8, ValueKind.UINT64])
def test_encode_decode(spark, kind):
    lo, hi = FULL_RANGE[kind]
    values = sorted({lo, hi, 0, 1, max(lo, -1), hi // 2})
    d = spark.createDataFrame([(str(v),) for v in values], "s string").select("s", F.col("s").cast("decimal(20,0)").alias("v"))
    k = F.lit(int(kind))
    got = d.select("s", S.encode(F.col("v"), k).alias("e"), S.decode(S.encode(F.col("v"), k), k).alias("d")).collect()
    assert all(int(r["d"]) == int(r["s"]) and int(r["e"]) == int(r["s"]) % 2**64 for r in got)
    over = spark.createDataFrame([(str(hi + 1),)], "s string").select(S.wrap(F.col("s").cast("decimal(38,0)"), k)).collect()[0][0]
    assert int(over) == lo


# fixed values: expected meets, joins and widenings of the range lattice; None is an empty range
MEET_JOIN = [
    ((-5, 10), (0, 20), (-5, 20), (0, 10)), ((20, 30), (50, 60), (20, 60), None), ((-1, 1), (-1, 1), (-1, 1), (-1, 1)),
    (None, (1, 2), (1, 2), None), (None, None, None, None),
]


@pytest.mark.parametrize("a,b,meet,join", MEET_JOIN)
def test_range_meet_join(spark, a, b, meet, join):
    cols = [F.lit(x).cast("long") for r in (a, b) for x in (r or (None, None))]
    pair = lambda r: tuple(r) if r[0] is not None else None
    got = one(spark, *ranges.meet(*cols), *ranges.join(*cols))
    assert pair(got[:2]) == meet and pair(got[2:]) == join


@pytest.mark.parametrize("a,b,want", [((10, 100), (0, 200), (0, 2**32 - 1)), ((10, 100), (20, 80), (10, 100)), ((1, 5), (1, 5), (1, 5)), ((1, 5), (3, 9), (1, 9)), (None, (1, 2), (1, 2))])
def test_range_widen(spark, a, b, want):
    cols = [F.lit(x).cast("long") for r in (a, b) for x in (r or (None, None))]
    assert tuple(one(spark, *ranges.widen(*cols, F.lit(0).cast("long"), F.lit(2**32 - 1)))) == want


def test_range_laws(spark):
    some = [None, (0, 0), (0, 5), (3, 9), (7, 8), (-4, 12)]
    rows = [(*(a or (None, None)), *(b or (None, None)), *(c or (None, None))) for a, b, c in itertools.product(some, some, some)]
    d = spark.createDataFrame(rows, "al long, ah long, bl long, bh long, cl long, ch long")
    a, b, c = [(F.col(f"{x}l"), F.col(f"{x}h")) for x in "abc"]
    same = lambda p, q: ranges.equal(*p, *q)
    m = ranges.meet
    bad = d.where(~(same(m(*a, *a), a) & same(m(*a, *b), m(*b, *a)) & same(m(*m(*a, *b), *c), m(*a, *m(*b, *c))) & ranges.weaker(*m(*a, *b), *a)
                    & (ranges.weaker(*a, *b) == same(m(*a, *b), a))))
    assert bad.count() == 0
    assert one(spark, ranges.is_bottom(*[F.lit(x) for x in (0, 255, 0, 255)]), ranges.is_top(F.lit(3), F.lit(2)), ranges.is_top(F.lit(2), F.lit(2))) == [True, True, False]

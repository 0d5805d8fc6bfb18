"""Wire format, loading, text sinks, command line, streaming."""

import pytest
from pyspark.sql import functions as F

from meetflow.functions.kinds import EntityKind as E
from meetflow.functions.kinds import ExprKind as X
from meetflow.functions.kinds import InsnKind as I
from meetflow.functions.kinds import ValueKind as V
from meetflow.sources import cli, text, wire
from meetflow.streaming.incremental import analyse_stream, current, windowed_counts


def val(op):
    return {"xkind": int(X.VAL), "op1": op}


UNIT = {
    "name": "t.c", "abs_path": "/src/t.c", "origin": "test",
    "names": [{"key": "f:main", "value": 10}, {"key": "v:main:x", "value": 11}, {"key": "g:g", "value": 12}, {"key": "s:pair", "value": 20}, {"key": "pair:a", "value": 21}],
    "types": [{"key": 30, "value": {"vkind": int(V.INT32), "type_id": 30, "len": 32, "align": 4, "fop_ids": [], "fop_type_eids": []}},
              {"key": 31, "value": {"vkind": int(V.PTR_TO_INT), "type_id": 31, "sub_type_eid": 30, "fop_ids": [], "fop_type_eids": []}},
              {"key": 32, "value": {"vkind": int(V.ARR_FIXED), "type_id": 32, "sub_type_eid": 31, "len": 10, "fop_ids": [], "fop_type_eids": []}},
              {"key": 20, "value": {"vkind": int(V.STRUCT), "type_id": 20, "type_name": "pair", "fop_ids": [21], "fop_type_eids": [32]}},
              {"key": 33, "value": {"vkind": int(V.PTR_TO_FUNC), "type_id": 33, "sub_type_eid": 30, "variadic": True, "fop_ids": [0], "fop_type_eids": [31]}}],
    "entities": [{"key": k, "value": {"eid": k, "ekind": int(e), "vkind": int(V.INT32), **more}} for k, e, more in [
        (10, E.FUNC, {}), (11, E.VAR_LOCL, {"parent_eid": 10, "data_type_eid": 30, "line": 2}), (12, E.VAR_GLBL, {"data_type_eid": 31}),
        (13, E.LIT_NUM, {"low_val": 2**64 - 1}), (14, E.LIT_STR, {"str_val": "hé"}), (15, E.LABEL, {"str_val": "end"}), (16, E.VAR_LOCL_STATIC, {"parent_eid": 10, "str_val": "v:main:s"})]],
    "functions": [{"fid": 10, "fname": "f:main", "is_variadic": False, "type_eid": 33, "insns": [
        {"ikind": int(I.ASGN_SIMPLE), "expr1": val(11), "expr2": val(13), "line": 3, "col": 5},
        {"ikind": int(I.ASGN_RHS_OP), "expr1": val(11), "expr2": {"xkind": int(X.ADD), "op1": 11, "op2": 12}},
        {"ikind": int(I.CALL), "expr1": {"xkind": int(X.CALL), "op1": 10, "args": [11, 14]}},
        {"ikind": int(I.LABEL), "expr1": val(15)}, {"ikind": int(I.RETURN), "expr1": val(11)}]}],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("units")
    (top / "a.pb").write_bytes(wire.encode(UNIT, wire.UNIT))
    (top / "b.pb").write_bytes(wire.encode(dict(UNIT, name="u.c"), wire.UNIT))
    return str(top)


def test_decode_inverts_encode():
    raw = wire.encode(UNIT, wire.UNIT)
    back = wire.decode(raw, wire.UNIT)
    assert back["name"] == "t.c" and back["entities"][3]["value"]["low_val"] == 2**64 - 1 and back["functions"][0]["insns"][2]["expr1"]["args"] == [11, 14]
    assert wire.encode(back, wire.UNIT) == raw
    assert wire.decode(raw + b"\xfa\x06\x02hi", wire.UNIT) == back  # a field nobody knows
    with pytest.raises((ValueError, IndexError)):
        wire.decode(raw[:-3], wire.UNIT)
    odd = dict(UNIT, types=[{"key": 1, "value": {"type_id": 1, "fop_ids": [1, 2], "fop_type_eids": [3]}}])
    with pytest.raises(ValueError, match="2 fields and 1 field types"):
        wire.rows_of(wire.decode(wire.encode(odd, wire.UNIT), wire.UNIT), 1)


def test_read(spark, folder):
    t = wire.read_units(spark, folder)
    assert sorted(r["name"] for r in t["tu"].collect()) == ["t.c", "u.c"]
    e = {r["eid"]: r for r in t["entity"].dropDuplicates(["eid"]).collect()}
    assert int(e[13]["low_val"]) == 2**64 - 1 and e[14]["str_val"] == "hé" and e[11]["parent_eid"] == 10 and e[10]["line"] is None
    i = t["insn"].dropDuplicates(["seq"]).orderBy("seq").collect()
    assert [r["ikind"] for r in i] == [7, 8, 12, 15, 16] and i[1]["expr2"]["op2"] == 12 and i[2]["expr1"]["args"] == [11, 14] and i[3]["expr2"] is None


def test_write_inverts_read(spark, folder, tmp_path):
    t = wire.read_units(spark, folder)
    out = wire.write_units(t).collect()
    assert len(out) == 2
    for n, r in enumerate(out):
        (tmp_path / f"{n}.pb").write_bytes(r["content"])
    again = wire.read_units(spark, str(tmp_path))
    for name in ("entity", "data_type", "func", "insn", "name_id"):
        strip = lambda d: sorted(str(r) for r in d.drop("tu_id").collect())
        assert strip(again[name]) == strip(t[name]), name


def test_text(spark, folder):
    t = {k: d.where(F.col("tu_id") == t0) for t0 in [wire.read_units(spark, folder)["tu"].where("name = 't.c'").collect()[0]["tu_id"]] for k, d in wire.read_units(spark, folder).items()}
    named = text.names(t["entity"], t["name_id"], t["data_type"])
    types = text.type_text(t["data_type"])
    lines = lambda d: sorted(r["text"] for r in d.collect())
    assert {r["type_id"]: r["text"] for r in types.collect()} == {30: "int32", 31: "int32*", 32: "int32*[10]", 20: "struct pair", 33: "int32*"}
    assert lines(text.globals_text(t["entity"], named, types)) == ["int32* g"]
    assert lines(text.static_locals(t["entity"], named)) == ["s"]
    assert lines(text.records_text(t["data_type"], named, types)) == ["pair { int32*[10] a }"]
    assert lines(text.functions_text(t["func"], t["data_type"], types)) == ["int32 main(int32*)"]
    body = text.insn_text(t["insn"], text.operand_text(t["entity"], named)).orderBy("seq").collect()
    assert [r["text"] for r in body] == ["x = 18446744073709551615", "x = x + g", "main(x, hé)", "end:", "return x"]
    parts = [r["part"] for r in text.dump(t).orderBy("part", "key", "seq").collect()]
    assert parts == sorted(parts) and len(set(parts)) == 8


def test_dot(spark):
    e = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 2, 0)], "g int, src int, dst int, label int")
    n = spark.createDataFrame([(1, 0, 'if "x"')], "g int, node int, text string")
    got = text.dot(e, ["g"], n).collect()[0]["dot"]
    assert got == 'digraph {\n  n0 [label="if \'x\'"];\n  n0 -> n1 [color="green", label="T"];\n  n0 -> n2 [color="red", label="F"];\n  n1 -> n2;\n}'


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main(["load", folder, "--dump-txt"], spark) == 0
    assert "x = x + g" in capsys.readouterr().out
    assert cli.main(["--log-json", "analyze", folder], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 6
    (tmp_path / "odd.txt").write_bytes(b"x")
    assert cli.main(["load", str(tmp_path)], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "fn string, version int, seq int, ikind int"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    count = lambda d: d.groupBy("fn").agg(F.count(F.lit(1)).alias("n"))

    def go():
        q = analyse_stream(spark.readStream.schema(schema).parquet(str(src)), ["fn"], "version", count, out, str(tmp_path / "cp"))
        q.awaitTermination(120)
        return {r["fn"]: (r["version"], r["n"]) for r in current(spark.read.parquet(out), ["fn"], "version", spark.read.parquet(out + "-versions")).collect()}

    write([("f", 1, i, 7) for i in range(3)] + [("g", 1, 0, 7)])
    assert go() == {"f": (1, 3), "g": (1, 1)}
    write([("f", 2, i, 7) for i in range(5)])
    assert go() == {"f": (2, 5), "g": (1, 1)}


def test_windowed_counts_is_a_streaming_plan(spark, sf):
    e = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(sf)
    w = windowed_counts(e, "ts", ["event_type"])
    assert w.isStreaming and w.columns == ["window_start", "event_type", "n"]

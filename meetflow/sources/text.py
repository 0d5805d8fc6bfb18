"""Text of program tables: names, types, expressions, instructions, dumps and dot graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import EdgeLabel, EntityKind, ExprKind, InsnKind, ValueKind
from ..functions.scalars import is_array, is_pointer, is_record, is_variable, literal_text, lookup, simple_name, symbol
from ..plans.rounds import Tables

X, I = ExprKind, InsnKind


def names(entity: DataFrame, name_id: DataFrame, data_type: DataFrame) -> DataFrame:
    """(tu_id, eid, name): from the name table, else the entity's string, else the type's name, else ``label_<id>`` for labels."""
    n = name_id.select("tu_id", "eid", F.col("name").alias("_n"))
    t = data_type.select("tu_id", F.col("type_id").alias("eid"), F.col("type_name").alias("_t"))
    e = entity.select("tu_id", "eid", "ekind", "str_val").join(n, ["tu_id", "eid"], "full").join(t, ["tu_id", "eid"], "full")
    label = F.when(F.col("ekind") == int(EntityKind.LABEL), F.concat(F.lit("label_"), F.col("eid").cast("string")))
    return e.select("tu_id", "eid", F.coalesce("_n", "str_val", "_t", label).alias("name"))


def operand_text(entity: DataFrame, named: DataFrame) -> DataFrame:
    """(tu_id, eid, text): literals by value, others by simple name."""
    e = entity.join(named, ["tu_id", "eid"], "left")
    lit = F.col("ekind").between(int(EntityKind.LIT_NUM), int(EntityKind.LIT_STR))
    return e.select("tu_id", "eid", F.when(lit, literal_text(F.col("low_val"), F.col("high_val"), F.col("str_val"))).otherwise(simple_name(F.col("name"))).alias("text"))


def expr_text(x: Column, a: Column, b: Column, args: Column) -> Column:
    a, b = F.coalesce(a, F.lit("?")), F.coalesce(b, F.lit("?"))
    return (F.when(x == int(X.VAL), a)
            .when(x == int(X.CALL), F.concat(a, F.lit("("), F.array_join(F.coalesce(args, F.array().cast("array<string>")), ", "), F.lit(")")))
            .when(x == int(X.ARR_INDX), F.concat(a, F.lit("["), b, F.lit("]"))).when(x == int(X.ARR_INDX_ADDROF), F.concat(F.lit("&"), a, F.lit("["), b, F.lit("]")))
            .when(x == int(X.MEMBER_ACCESS), F.concat(a, F.lit("."), b)).when(x == int(X.MEMBER_ADDROF), F.concat(F.lit("&"), a, F.lit("."), b))
            .when(x == int(X.CAST), F.concat(F.lit("(cast)"), a))
            .when(x.isin(int(X.SIZEOF), int(X.ALIGNOF), int(X.ALLOC)), F.concat(symbol(x), F.lit("("), a, F.lit(")")))
            .when(x.between(int(X.BIT_NOT), int(X.ADDROF)), F.concat(symbol(x), a))
            .otherwise(F.concat_ws(" ", a, symbol(x), b)))


def insn_text(insn: DataFrame, operands: DataFrame) -> DataFrame:
    """Adds ``text``: one line an instruction."""
    out = insn
    for side in ("expr1", "expr2"):
        for op in ("op1", "op2"):
            o = operands.select("tu_id", F.col("eid").alias(f"_{side}_{op}"), F.col("text").alias(f"_{side}_{op}_t"))
            out = out.withColumn(f"_{side}_{op}", F.col(side)[op]).join(o, ["tu_id", f"_{side}_{op}"], "left")
        a = insn.select("tu_id", "fid", "seq", F.posexplode(F.col(side)["args"]).alias("_p", "eid")).join(operands, ["tu_id", "eid"], "left")
        a = a.groupBy("tu_id", "fid", "seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", F.coalesce("text", F.lit("?")).alias("t")))), lambda r: r["t"]).alias(f"_{side}_args"))
        out = out.join(a, ["tu_id", "fid", "seq"], "left")
    t1, t2 = (expr_text(F.col(s)["xkind"], F.col(f"_{s}_op1_t"), F.col(f"_{s}_op2_t"), F.col(f"_{s}_args")) for s in ("expr1", "expr2"))
    k = F.col("ikind")
    text = (F.when(k.between(int(I.ASGN_SELF), int(I.ASGN_PHI)), F.concat_ws(" = ", t1, F.when(F.col("expr2").isNotNull(), t2)))
            .when(k == int(I.CALL), t1).when(k == int(I.GOTO), F.concat(F.lit("goto "), t1)).when(k == int(I.LABEL), F.concat(t1, F.lit(":")))
            .when(k == int(I.COND), F.concat(F.lit("if "), t1)).when(k == int(I.RETURN), F.concat_ws(" ", F.lit("return"), F.when(F.col("expr1").isNotNull(), t1)))
            .otherwise(lookup({m: m.name.lower() for m in I}, k, F.lit("nop"))))
    return out.withColumn("text", text).select(*insn.columns, "text")


def type_text(data_type: DataFrame, depth: int = 64) -> DataFrame:
    """(tu_id, type_id, text): types written out.

    A type's text is the kind its chain of pointers and arrays ends in, and one
    suffix for each link.  Chains are followed by doubling (after k rounds 2^k
    links), up to ``depth`` links; longer ones, and those that lead back to
    themselves, end in ``...``.
    """
    v, t = F.col("vkind"), Tables(data_type.sparkSession)
    kind = lookup({m: m.name.lower() for m in ValueKind}, v, F.lit("other"))
    nested = is_pointer(v) | is_array(v)
    own = F.when(is_record(v), F.concat_ws(" ", kind, F.col("type_name"))).otherwise(kind)
    link = F.when(is_pointer(v), F.lit("*")).when(is_array(v), F.concat(F.lit("["), F.coalesce(F.col("len").cast("string"), F.lit("")), F.lit("]")))
    # (to): the type a chain has reached; null once it ended
    rows = data_type.select("tu_id", "type_id", F.when(nested, F.coalesce("sub_type_eid", F.lit(0))).alias("to"),
                            F.when(nested, link).otherwise(F.lit("")).alias("tail"), F.when(~nested, own).alias("end"))
    rounds = max(1, (depth - 1).bit_length())
    for _ in range(rounds + 1):
        rows = t.keep(rows)
        nxt = rows.select("tu_id", F.col("type_id").alias("to"), F.col("to").alias("_to"), F.col("tail").alias("_tail"), F.col("end").alias("_end"), F.lit(True).alias("_known"))
        j = rows.join(nxt, ["tu_id", "to"], "left")
        open_ = F.col("to").isNotNull()
        unknown = open_ & F.col("_known").isNull()  # type 0, or a type that isn't there: a 32-bit integer
        rows = j.select("tu_id", "type_id", F.when(open_ & ~unknown, F.col("_to")).alias("to"),
                        F.when(open_ & ~unknown, F.concat("_tail", "tail")).otherwise(F.col("tail")).alias("tail"),
                        F.when(unknown, F.lit("int32")).when(open_, F.col("_end")).otherwise(F.col("end")).alias("end"))
    return rows.select("tu_id", "type_id", F.concat(F.coalesce("end", F.lit("...")), F.when(F.col("to").isNull(), F.col("tail")).otherwise(F.lit(""))).alias("text"))


def globals_text(entity: DataFrame, named: DataFrame, types: DataFrame) -> DataFrame:
    t = types.select("tu_id", F.col("type_id").alias("data_type_eid"), F.col("text").alias("type"))
    g = entity.where(F.col("ekind") == int(EntityKind.VAR_GLBL)).join(named, ["tu_id", "eid"], "left").join(t, ["tu_id", "data_type_eid"], "left")
    return g.select("tu_id", "eid", F.concat_ws(" ", F.coalesce("type", F.lit("int32")), simple_name(F.col("name"))).alias("text"))


def static_locals(entity: DataFrame, named: DataFrame) -> DataFrame:
    s = entity.where(F.col("ekind") == int(EntityKind.VAR_LOCL_STATIC))
    return s.join(named, ["tu_id", "eid"], "left").select("tu_id", F.col("parent_eid").alias("fid"), "eid", simple_name(F.col("name")).alias("text"))


def records_text(data_type: DataFrame, named: DataFrame, types: DataFrame) -> DataFrame:
    """Structures and unions with their fields in order."""
    r = data_type.where(is_record(F.col("vkind")))
    f = r.select("tu_id", "type_id", F.posexplode(F.arrays_zip("fop_ids", "fop_type_eids")).alias("pos", "f"))
    f = f.select("tu_id", "type_id", "pos", F.col("f.fop_ids").alias("eid"), F.col("f.fop_type_eids").alias("_t"))
    f = f.join(named, ["tu_id", "eid"], "left").join(types.select("tu_id", F.col("type_id").alias("_t"), F.col("text").alias("type")), ["tu_id", "_t"], "left")
    field = F.concat_ws(" ", F.coalesce("type", F.lit("int32")), F.coalesce(simple_name(F.col("name")), F.lit("-")))
    f = f.groupBy("tu_id", "type_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", field.alias("t")))), lambda x: x["t"]), "; ").alias("_f"))
    return r.join(f, ["tu_id", "type_id"], "left").select("tu_id", "type_id", F.concat(F.coalesce("type_name", F.lit("-")), F.lit(" { "), F.coalesce("_f", F.lit("")), F.lit(" }")).alias("text"))


def functions_text(func: DataFrame, data_type: DataFrame, types: DataFrame) -> DataFrame:
    """A signature line for each function."""
    sig = data_type.select("tu_id", F.col("type_id").alias("type_eid"), "sub_type_eid", "fop_type_eids", "variadic")
    t = types.select("tu_id", F.col("type_id").alias("_t"), "text")
    f = func.join(sig, ["tu_id", "type_eid"], "left")
    p = f.select("tu_id", "fid", F.posexplode("fop_type_eids").alias("pos", "_t")).join(t, ["tu_id", "_t"], "left")
    p = p.groupBy("tu_id", "fid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("int32")).alias("t")))), lambda x: x["t"]), ", ").alias("_p"))
    ret = t.select("tu_id", F.col("_t").alias("sub_type_eid"), F.col("text").alias("_r"))
    f = f.join(p, ["tu_id", "fid"], "left").join(ret, ["tu_id", "sub_type_eid"], "left")
    dots = F.when(F.coalesce("is_variadic", "variadic", F.lit(False)), F.lit("..."))
    return f.select("tu_id", "fid", F.concat(F.coalesce("_r", F.lit("int32")), F.lit(" "), simple_name(F.col("fname")), F.lit("("), F.concat_ws(", ", "_p", dots), F.lit(")")).alias("text"))


def dump(tables: dict[str, DataFrame]) -> DataFrame:
    """(tu_id, part, key, seq, text): every table of the units as lines, to be ordered by these columns."""
    e, d = tables["entity"], tables["data_type"]
    named = names(e, tables["name_id"], d)
    types = type_text(d)
    ops = operand_text(e, named)
    var = e.where(is_variable(F.col("ekind")))
    lit = e.where(F.col("ekind").between(int(EntityKind.LIT_NUM), int(EntityKind.LIT_STR)))
    line = lambda df, part, key, text, seq=F.lit(0): df.select("tu_id", F.lit(part).alias("part"), F.col(key).alias("key"), seq.alias("seq"), text.alias("text"))
    parts = [
        line(tables["tu"].withColumn("_k", F.lit(0).cast("bigint")), "0 unit", "_k", F.concat_ws(" ", "name", "abs_path", "origin")),
        line(tables["name_id"], "1 id", "eid", F.col("name")), line(types, "2 type", "type_id", F.col("text")), line(lit.join(ops, ["tu_id", "eid"]), "3 literal", "eid", F.col("text")),
        line(e.where(F.col("ekind") == int(EntityKind.LABEL)).join(named, ["tu_id", "eid"]), "4 label", "eid", F.col("name")), line(var.join(named, ["tu_id", "eid"]), "5 variable", "eid", F.col("name")),
        line(functions_text(tables["func"], d, types), "6 function", "fid", F.col("text")), line(insn_text(tables["insn"], ops), "7 body", "fid", F.col("text"), F.col("seq")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dot(edges: DataFrame, keys: list[str], node_text: DataFrame | None = None) -> DataFrame:
    """(keys, dot): a graph as graphviz text; true edges are green, false ones red.  ``node_text``: (keys, node, text)."""
    color = lookup({EdgeLabel.TRUE: ' [color="green", label="T"]', EdgeLabel.FALSE: ' [color="red", label="F"]'}, F.col("label"), F.lit(""))
    lines = edges.select(*keys, F.lit(1).alias("_o"), F.col("src").cast("long").alias("_a"), F.col("dst").cast("long").alias("_b"),
                         F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string"), color, F.lit(";")).alias("_l"))
    if node_text is not None:
        lines = lines.unionByName(node_text.select(*keys, F.lit(0).alias("_o"), F.col("node").cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"),
                                                   F.concat(F.lit("  n"), F.col("node").cast("string"), F.lit(' [label="'), F.replace("text", F.lit('"'), F.lit("'")), F.lit('"];')).alias("_l")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_a", "_b", "_l"))), lambda x: x["_l"]), "\n")
    return lines.groupBy(*keys).agg(F.concat(F.lit("digraph {\n"), body, F.lit("\n}")).alias("dot"))

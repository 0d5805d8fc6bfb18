"""Types, literals, variables and labels of loaded units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import EntityKind, Qualifier, ValueKind
from ..functions.scalars import fits_immediate, is_array, is_literal, is_pointer, is_record, is_function_type, is_variable, kind_prefix32, literal_text, lookup, type_class

E = EntityKind


def qualifier_names(q: Column) -> Column:
    """The qualifiers set in a bit mask, in order."""
    return F.filter(F.array(*[F.when(q.bitwiseAND(int(x)) != 0, F.lit(x.name)) for x in Qualifier if x]), lambda x: x.isNotNull())


def entity_types(entity: DataFrame, data_type: DataFrame) -> DataFrame:
    """(tu_id, eid, vkind, class, len, align, sub_type_eid, qtype, qualifiers): type id 0 is a 32-bit integer, a missing type the entity's own kind."""
    t = data_type.select("tu_id", F.col("type_id").alias("data_type_eid"), F.col("vkind").alias("_vk"), "len", "align", "sub_type_eid")
    j = entity.join(t, ["tu_id", "data_type_eid"], "left")
    vk = F.when(F.coalesce("data_type_eid", F.lit(0)) == 0, F.coalesce(F.col("vkind"), F.lit(int(ValueKind.INT32)))).otherwise(F.coalesce("_vk", "vkind"))
    q = F.coalesce("qtype", F.lit(0))
    return j.select("tu_id", "eid", vk.alias("vkind"), type_class(vk).alias("class"), "len", "align", "sub_type_eid", q.alias("qtype"), qualifier_names(q).alias("qualifiers"))


def targets(data_type: DataFrame) -> DataFrame:
    """(tu_id, type_id, target): pointee of pointers, element of arrays, result of functions."""
    v = F.col("vkind")
    return data_type.where(is_pointer(v) | is_array(v) | is_function_type(v)).select("tu_id", "type_id", F.coalesce("sub_type_eid", F.lit(0)).alias("target"))


def members(data_type: DataFrame) -> DataFrame:
    """(tu_id, type_id, pos, member, member_type): fields of records and parameters of functions; lists of unequal length raise."""
    v = F.col("vkind")
    d = data_type.where(is_record(v) | is_function_type(v))
    same = F.size("fop_ids") == F.size("fop_type_eids")
    zipped = F.when(same, F.arrays_zip("fop_ids", "fop_type_eids")).otherwise(
        F.raise_error(F.format_string("type %d: member lists differ in length", F.col("type_id"))).cast("array<struct<fop_ids: bigint, fop_type_eids: bigint>>"))
    d = d.select("tu_id", "type_id", F.posexplode(zipped).alias("pos", "_m"))
    return d.select("tu_id", "type_id", "pos", F.col("_m.fop_ids").alias("member"), F.col("_m.fop_type_eids").alias("member_type"))


def literals(entity: DataFrame) -> DataFrame:
    """(tu_id, eid, vkind, low_val, high_val, str_val, text, immediate)."""
    lit = entity.where(is_literal(F.col("ekind")))
    imm = (F.col("ekind") != int(E.LIT_STR)) & (F.coalesce("high_val", F.lit(0)) == 0) & F.coalesce(fits_immediate(F.col("low_val"), F.col("vkind")), F.lit(False))
    return lit.select("tu_id", "eid", "vkind", "low_val", "high_val", "str_val", literal_text(F.col("low_val"), F.col("high_val"), F.col("str_val")).alias("text"), imm.alias("immediate"))


def variables(entity: DataFrame, data_type: DataFrame) -> DataFrame:
    return entity.where(is_variable(F.col("ekind"))).select("tu_id", "eid", "ekind", "parent_eid").join(entity_types(entity, data_type), ["tu_id", "eid"])


def global_variables(entity: DataFrame) -> DataFrame:
    return entity.where(F.col("ekind") == int(E.VAR_GLBL)).select("tu_id", "eid")


def labels(entity: DataFrame) -> DataFrame:
    name = F.coalesce("str_val", F.concat(F.lit("label_"), F.col("eid").cast("string")))
    return entity.where(F.col("ekind") == int(E.LABEL)).select("tu_id", "eid", name.alias("name"))


def assign_internal_ids(entity: DataFrame, data_type: DataFrame) -> DataFrame:
    """(tu_id, eid, id): packed ids for all entities, then for types that are no entities, numbered within kind and sub-kind."""
    e = entity.select("tu_id", "eid", "ekind", "vkind", F.lit(0).alias("_o"))
    t = data_type.select("tu_id", F.col("type_id").alias("eid"), F.lit(int(E.DATA_TYPE)).alias("ekind"), "vkind", F.lit(1).alias("_o"))
    rows = e.unionByName(t.join(e, ["tu_id", "eid"], "left_anti")).withColumn("_p", kind_prefix32(F.col("ekind"), F.coalesce("vkind", F.lit(0))))
    n = F.row_number().over(Window.partitionBy("tu_id", "_p").orderBy("_o", "eid"))
    return rows.select("tu_id", "eid", F.col("_p").bitwiseOR(n.cast("long")).alias("id"))


def internal_ids(used: DataFrame, known: DataFrame) -> DataFrame:
    """The wire ids in use with their internal ids (tu_id, eid, id); 0 and 1 stand for themselves, an unknown id raises."""
    j = used.select("tu_id", "eid").distinct().join(known.select("tu_id", "eid", "id"), ["tu_id", "eid"], "left")
    missing = F.raise_error(F.format_string("unknown entity %d", F.col("eid"))).cast("bigint")
    return j.select("tu_id", "eid", F.when(F.col("eid").isin(0, 1), F.col("eid")).when(F.col("id").isNull(), missing).otherwise(F.col("id")).alias("id"))


def kind_name(k: Column) -> Column:
    return lookup({e: e.name for e in EntityKind}, k, k.cast("string"))

"""Schemas of the program tables (Spark DDL)."""

_EXPR = "struct<xkind: int, op1: bigint, op2: bigint, args: array<bigint>>"

SCHEMAS = {
    "tu": "tu_id bigint, name string, abs_path string, origin string",
    "name_id": "tu_id bigint, name string, eid bigint",
    "entity": "tu_id bigint, eid bigint, ekind int, vkind int, anonymous boolean, member_access boolean, qtype int, parent_eid bigint, "
    "data_type_eid bigint, low_val decimal(20,0), high_val decimal(20,0), str_val string, line int, col int",
    "data_type": "tu_id bigint, type_id bigint, vkind int, attributes string, len int, align int, sub_type_eid bigint, type_name string, "
    "anonymous boolean, func_prototype boolean, variadic boolean, fop_ids array<bigint>, fop_type_eids array<bigint>, line int, col int",
    "func": "tu_id bigint, fid bigint, fname string, is_variadic boolean, type_eid bigint, calling_convention string",
    "insn": f"tu_id bigint, fid bigint, seq int, ikind int, expr1 {_EXPR}, expr2 {_EXPR}, line int, col int",
    "edge": "tu_id bigint, fid bigint, src int, dst int, label tinyint",
    "fact_set": "analysis string, tu_id bigint, fid bigint, node int, point string, elem bigint",
    "fact_range": "analysis string, tu_id bigint, fid bigint, node int, point string, var bigint, lo bigint, hi bigint",
}

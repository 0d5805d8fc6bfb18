"""Columns over packed ids, kinds, expressions and instructions.

All take and return Columns that stay inside whole-stage code generation.
Entity ids are 32-bit values held as BIGINT: two spare bits, five bits of kind,
five of sub-kind (for kinds that have one) and the sequence number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import FULL_RANGE, SIZES, SYMBOLS, ChangeCode, EntityKind, ExprKind, InsnKind, ValueKind

E, I, X, V = EntityKind, InsnKind, ExprKind, ValueKind


def lookup(table: Mapping, key: Column, default: Column) -> Column:
    """A constant table as a map literal."""
    pairs = [F.lit(x) for k, v in table.items() for x in (int(k), v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key.cast("int")), default)


# entity ids

ID_BITS, KIND_SHIFT, SUB_SHIFT = 30, 25, 20


def true_id(e: Column) -> Column:
    return e.bitwiseAND(0x3FFFFFFF)


def top_bits(e: Column) -> Column:
    return F.shiftright(e, ID_BITS).bitwiseAND(3)


def is_true_id(e: Column) -> Column:
    return e == true_id(e)


def kind(e: Column) -> Column:
    return F.shiftright(true_id(e), KIND_SHIFT).cast("int")


def kind_has_sub(k: Column) -> Column:
    return ~(k.between(int(E.BB), int(E.SRC_FILE)) | (k == int(E.LABEL)))


def sub_kind_bits(k: Column) -> Column:
    return F.when(kind_has_sub(k), 5).otherwise(0)


def seq_bits(k: Column) -> Column:
    return F.lit(KIND_SHIFT) - sub_kind_bits(k)


def sub_kind(e: Column) -> Column:
    return F.when(kind_has_sub(kind(e)), F.shiftright(e, SUB_SHIFT).bitwiseAND(31)).otherwise(0).cast("int")


def seq_id(e: Column) -> Column:
    return F.when(kind_has_sub(kind(e)), e.bitwiseAND((1 << SUB_SHIFT) - 1)).otherwise(e.bitwiseAND((1 << KIND_SHIFT) - 1))


def has_proper_prefix(e: Column) -> Column:
    return (kind(e) != 0) & (~kind_has_sub(kind(e)) | (sub_kind(e) != 0))


def is_proper(e: Column) -> Column:
    return has_proper_prefix(e) & (seq_id(e) != 0)


def kind_prefix16(k: Column, sub: Column) -> Column:
    return F.when(kind_has_sub(k), F.shiftleft(k.cast("long"), 5).bitwiseOR(sub.cast("long"))).otherwise(k.cast("long"))


def kind_prefix32(k: Column, sub: Column) -> Column:
    """Kind and sub-kind at their places in an id."""
    place = F.shiftleft(k.cast("long"), KIND_SHIFT)
    return F.when(kind_has_sub(k), place.bitwiseOR(F.shiftleft(sub.cast("long"), SUB_SHIFT))).otherwise(place)


def pack_id(k: Column, sub: Column, seq: Column) -> Column:
    return kind_prefix32(k, sub).bitwiseOR(seq.cast("long"))


def fits_seq(k: Column, seq: Column) -> Column:
    """Whether a sequence number keeps to its bits in ``pack_id``; one that doesn't runs into the sub-kind and can't be unpacked."""
    return (seq >= 0) & (seq < F.when(kind_has_sub(k), 1 << SUB_SHIFT).otherwise(1 << KIND_SHIFT))


def var_group(e: Column) -> Column:
    """The id that stands for all variables of a type."""
    return kind_prefix32(F.lit(int(E.VAR_LOCL_OTHER)), sub_kind(e))


def is_var_group(e: Column) -> Column:
    return (kind(e) == int(E.VAR_LOCL_OTHER)) & has_proper_prefix(e) & (seq_id(e) == 0)


def immediate20(value: Column, vkind: Column) -> Column:
    """The value if it is an integer of 20 unsigned bits, else null."""
    return F.when(is_integer(vkind) & value.between(0, (1 << 20) - 1), value)


def fits_immediate(value: Column, vkind: Column) -> Column:
    """Whether a literal fits 20 bits for its signedness."""
    return F.when(is_signed(vkind), value.between(-(1 << 19), (1 << 19) - 1)).otherwise(is_integer(vkind) & value.between(0, (1 << 20) - 1))


def id_text(e: Column, base: str = "x") -> Column:
    """Top bits, kind, sub-kind and sequence, joined by hyphens; base d, o, x, or s for names of kinds."""
    parts = [top_bits(e), kind(e), sub_kind(e), seq_id(e)]
    if base == "s":
        names = [F.lit(None)] + [lookup({m: m.name for m in t}, p, p.cast("string")) for t, p in ((E, parts[1]), (V, parts[2]))]
        shown = [parts[0].cast("string"), names[1], names[2], parts[3].cast("string")]
    else:
        shown = [F.lower(F.conv(p.cast("string"), 10, {"d": 10, "o": 8, "x": 16}[base])) for p in parts]
    return F.concat(F.lit("(eid:" + {"d": "", "s": "", "o": "0o", "x": "0x"}[base]), F.concat_ws("-", *shown), F.lit(")"))


def is_bit_set(x: Column, bit: int) -> Column:
    return F.getbit(x, F.lit(bit)) == 1


def _bit(bit: int) -> int:
    return 1 << bit if bit < 63 else -(1 << 63)


def set_bit(x: Column, bit: int) -> Column:
    return x.bitwiseOR(_bit(bit))


def clear_bit(x: Column, bit: int) -> Column:
    return x.bitwiseAND(~_bit(bit))


def with_top_bits(e: Column, value: Column) -> Column:
    """The id with its two spare bits set."""
    return true_id(e).bitwiseOR(F.shiftleft(value.cast("long").bitwiseAND(3), ID_BITS))


def is_data_type(k: Column) -> Column:
    return k == int(E.DATA_TYPE)


def is_variable(k: Column) -> Column:
    return k.between(int(E.VAR_GLBL), int(E.VAR_LOCL_OTHER))


def is_literal(k: Column) -> Column:
    return k.between(int(E.LIT_NUM), int(E.LIT_STR))


def is_function(k: Column) -> Column:
    return k == int(E.FUNC)


def is_label(k: Column) -> Column:
    return k == int(E.LABEL)


def simple_name(name: Column) -> Column:
    """What follows the last colon; ``0name`` if that is empty."""
    last = F.element_at(F.split(name, ":"), -1)
    return F.when(last == "", F.lit("0name")).otherwise(last)


# pools of ids

def pool_id(prefix: Column, bits: Column) -> Column:
    """Prefix in the upper 16 bits, number of sequence bits (17 to 31) below; raises on others and on prefixes that lose bits."""
    ok = bits.between(17, 31) & (prefix.cast("long") < F.expr("1L") * F.pow(F.lit(2.0), F.lit(32) - bits).cast("long"))
    return F.when(ok, F.shiftleft(prefix.cast("long"), 16).bitwiseOR(bits.cast("long"))).otherwise(
        F.raise_error(F.format_string("invalid pool: prefix %s, %s bits", prefix.cast("string"), bits.cast("string"))).cast("long"))


# value kinds

def is_floating(v: Column) -> Column:
    return v.between(int(V.FLOAT16), int(V.FLOAT64))


def is_void(v: Column) -> Column:
    return v == int(V.VOID)


def is_integer(v: Column) -> Column:
    return v.between(int(V.CHAR), int(V.BOOL))


def is_signed(v: Column) -> Column:
    return v.between(int(V.INT8), int(V.INT64))


def is_pointer(v: Column) -> Column:
    return v.between(int(V.PTR_TO_VOID), int(V.PTR_TO_FUNC))


def is_array(v: Column) -> Column:
    return v.between(int(V.ARR_FIXED), int(V.ARR_PARTIAL))


def is_basic(v: Column) -> Column:
    return v.between(int(V.CHAR), int(V.FLOAT80))


def is_record(v: Column) -> Column:
    return v.between(int(V.UNION), int(V.CLASS))


def is_union(v: Column) -> Column:
    return v == int(V.UNION)


def is_function_type(v: Column) -> Column:
    return v == int(V.PTR_TO_FUNC)


def is_array_or_pointer(v: Column) -> Column:
    return is_array(v) | is_pointer(v)


def size_in_bytes(v: Column) -> Column:
    return F.when(is_pointer(v), 8).otherwise(lookup(SIZES, v, F.lit(0)))


align_in_bytes = size_in_bytes


def type_class(v: Column) -> Column:
    """Which loader a type takes; functions are tested before pointers."""
    return (F.when(is_function_type(v), "function").when(is_pointer(v), "pointer").when(is_array(v), "array")
            .when(is_record(v), "record").when(is_basic(v) | is_void(v), "basic").otherwise("other"))


def literal_text(low: Column, high: Column, text: Column) -> Column:
    """The string, else both words of a wide number, else the low word."""
    wide = F.concat_ws(" ", high.cast("string"), low.cast("string"))
    return F.coalesce(text, F.when(F.coalesce(high, F.lit(0)) != 0, wide), low.cast("string"))


# expressions: struct<xkind, op1, op2, args>

def is_call_expr(x: Column) -> Column:
    return x == int(X.CALL)


def is_single_operand(x: Column) -> Column:
    return (x == int(X.VAL)) | x.between(int(X.BIT_NOT), int(X.ALLOC))


def is_two_operand(x: Column) -> Column:
    return ~is_single_operand(x) & ~is_call_expr(x)


def is_relational(x: Column) -> Column:
    return x.between(int(X.EQ), int(X.GE))


def is_commutative(x: Column) -> Column:
    return x.isin(int(X.ADD), int(X.MUL), int(X.AND), int(X.OR), int(X.XOR))


def has_array_index(x: Column) -> Column:
    return x.isin(int(X.ARR_INDX), int(X.ARR_INDX_ADDROF))


def has_deref(x: Column, op1_vkind: Column, op2_vkind: Column) -> Column:
    """A dereference, written or implied by indexing, members or calls through a pointer.

    The pointer of an index or member expression is its base, the first operand.
    """
    through = x.between(int(X.ARR_INDX), int(X.MEMBER_ADDROF)) | is_call_expr(x)
    return (x == int(X.DEREF)) | (through & is_pointer(op1_vkind))


def has_addrof(x: Column, op1_ekind: Column) -> Column:
    """An address, written or implied: a function used as a value."""
    return x.isin(int(X.ADDROF), int(X.ARR_INDX_ADDROF), int(X.MEMBER_ADDROF)) | ((x == int(X.VAL)) & is_function(op1_ekind))


def has_pointee(expr: Column) -> Column:
    """Whether a known target takes the place of a pointer in the expression."""
    return expr["xkind"].eqNullSafe(int(X.DEREF)) | F.coalesce(expr["xkind"].between(int(X.ARR_INDX), int(X.CALL)), F.lit(False))


def replace_pointee(expr: Column, pointee: Column) -> Column:
    """The expression with a known target in the place of its pointer; ``*p`` becomes the target itself."""
    xkind = F.when(expr["xkind"] == int(X.DEREF), F.lit(int(X.VAL))).otherwise(expr["xkind"])
    return expr.withField("op1", F.when(has_pointee(expr), pointee).otherwise(expr["op1"])).withField("xkind", xkind)


def symbol(x: Column) -> Column:
    return lookup(SYMBOLS, x, F.lit(""))


def _wrap64(v: Column) -> Column:
    """A decimal modulo 2^64, as 64-bit registers hold it."""
    half = F.lit(str(2**63)).cast("decimal(38,0)")
    return (F.pmod(v.cast("decimal(38,0)") + half, F.lit(str(2**64)).cast("decimal(38,0)")) - half).cast("long")


def negated(a: Column) -> Column:
    """-a; the smallest number is its own negative."""
    return F.coalesce(F.try_subtract(F.lit(0).cast("long"), a), a)


def evaluate(x: Column, a: Column, b: Column) -> Column:
    """Value of a two-operand expression over BIGINT; sums and products wrap, division truncates, and division by zero is null."""
    zero, minus = b == 0, b == -1
    da, db = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
    table = [
        (X.ADD, F.coalesce(F.try_add(a, b), _wrap64(da + db))), (X.SUB, F.coalesce(F.try_subtract(a, b), _wrap64(da - db))),
        (X.MUL, F.coalesce(F.try_multiply(a, b), _wrap64(da * db))),
        (X.DIV, F.when(minus, negated(a)).when(~zero, F.call_function("div", a, F.when(~zero & ~minus, b)))),
        (X.MOD, F.when(minus, F.lit(0).cast("long")).when(~zero, a % F.when(~zero & ~minus, b))), (X.AND, a.bitwiseAND(b)), (X.OR, a.bitwiseOR(b)), (X.XOR, a.bitwiseXOR(b)),
        (X.SHL, F.call_function("shiftleft", a, b.cast("int"))), (X.SHR, F.call_function("shiftrightunsigned", a, b.cast("int"))),
        (X.SHRA, F.call_function("shiftright", a, b.cast("int"))), (X.EQ, (a == b).cast("long")), (X.NE, (a != b).cast("long")),
        (X.LT, (a < b).cast("long")), (X.GE, (a >= b).cast("long")),
    ]
    out = F.when(x == int(table[0][0]), table[0][1])
    for k, v in table[1:]:
        out = out.when(x == int(k), v)
    return out


def evaluate_unary(x: Column, a: Column) -> Column:
    return (F.when(x == int(X.VAL), a).when(x == int(X.BIT_NOT), F.bitwise_not(a)).when(x == int(X.NEGATE), negated(a))
            .when(x == int(X.NOT), (a == 0).cast("long")))


def wrap(value: Column, vkind: Column) -> Column:
    """A value modulo the width of its integer kind, as C stores it; DECIMAL(20,0) holds every kind."""
    lo, width = full_low(vkind), full_high(vkind) - full_low(vkind) + 1
    v = value.cast("decimal(38,0)")
    return F.when(is_integer(vkind), F.pmod(v - lo, width) + lo).otherwise(v).cast("decimal(20,0)")


def _full(vkind: Column, at: int) -> Column:
    out = None
    for k, r in FULL_RANGE.items():
        value = F.lit(str(r[at])).cast("decimal(38,0)")
        out = F.when(vkind == int(k), value) if out is None else out.when(vkind == int(k), value)
    return out


def full_low(vkind: Column) -> Column:
    return _full(vkind, 0)


def full_high(vkind: Column) -> Column:
    return _full(vkind, 1)


def encode(value: Column, vkind: Column) -> Column:
    """A value's 64 bits, as an unsigned number; two's complement for negative ones."""
    v = value.cast("decimal(38,0)")
    return F.when(v < 0, v + F.lit(str(2**64)).cast("decimal(38,0)")).otherwise(v).cast("decimal(20,0)")


def decode(bits: Column, vkind: Column) -> Column:
    """The value behind 64 bits, cut to the kind's width."""
    return wrap(bits.cast("decimal(38,0)"), vkind)


# instructions

def is_assign(i: Column) -> Column:
    return i.between(int(I.ASGN_SELF), int(I.ASGN_PHI))


def is_goto(i: Column) -> Column:
    return i == int(I.GOTO)


def is_call(i: Column) -> Column:
    return i == int(I.CALL)


def has_call(i: Column) -> Column:
    return i.isin(int(I.CALL), int(I.ASGN_CALL))


def is_cond(i: Column) -> Column:
    return i == int(I.COND)


def is_phi(i: Column) -> Column:
    return i == int(I.ASGN_PHI)


def is_label_insn(i: Column) -> Column:
    return i == int(I.LABEL)


def is_return(i: Column) -> Column:
    return i == int(I.RETURN)


def is_local_jump(i: Column) -> Column:
    return i.isin(int(I.GOTO), int(I.COND))


def skipped(i: Column) -> Column:
    """Labels and gotos take no part in an analysis."""
    return i.isin(int(I.LABEL), int(I.GOTO))


def checked_kind(i: Column) -> Column:
    """The kind as loaded: select and phi are refused, unknown kinds do nothing."""
    refused = F.raise_error(F.format_string("instruction kind %s cannot be loaded", i.cast("string"))).cast("int")
    return F.when(i.isin(int(I.SELECT), int(I.ASGN_PHI)), refused).when(i.between(0, int(I.RETURN)), i).otherwise(int(I.NOP))


def assign_kind(lhs_simple: Column, rhs_simple: Column, rhs_is_call: Column) -> Column:
    return (F.when(rhs_is_call, int(I.ASGN_CALL)).when(lhs_simple & rhs_simple, int(I.ASGN_SIMPLE))
            .when(lhs_simple, int(I.ASGN_RHS_OP)).otherwise(int(I.ASGN_LHS_OP)))


def lhs(i: Column, expr1: Column) -> Column:
    return F.when(is_assign(i), expr1)


def call_expression(expr1: Column, expr2: Column) -> Column:
    """The half of an instruction that is a call; null if none is."""
    return F.when(is_call_expr(expr2["xkind"]), expr2).when(is_call_expr(expr1["xkind"]), expr1)


def branch_labels(i: Column, expr1: Column, expr2: Column) -> Column:
    """struct<true, false>: both labels of a condition; a goto's and a label's own label twice; null for others."""
    both = lambda a, b: F.struct(a.alias("true"), b.alias("false"))
    return F.when(is_cond(i), both(expr2["op1"], expr2["op2"])).when(is_goto(i) | is_label_insn(i), both(expr1["op1"], expr1["op1"]))


def rhs(i: Column, expr1: Column, expr2: Column) -> Column:
    """The right side of an assignment; calls, returns and conditions have their only expression there."""
    return F.when(is_assign(i), F.coalesce(expr2, expr1)).when(is_call(i) | is_return(i) | is_cond(i), expr1)


def operands(expr1: Column, expr2: Column) -> Column:
    """All operands of an instruction without nulls: left, right and arguments."""
    some = F.array(expr1["op1"], expr1["op2"], expr2["op1"], expr2["op2"])
    args = F.concat(F.coalesce(expr1["args"], F.array().cast("array<bigint>")), F.coalesce(expr2["args"], F.array().cast("array<bigint>")))
    return F.filter(F.concat(some, args), lambda x: x.isNotNull())


# facts; fixed values: the fields of a fact id

FACT_BITS = {"version": (0, 15), "point": (15, 3), "entity": (18, 32), "analysis": (50, 12), "reserved": (62, 2)}


def instance_id(analysis: Column, function: Column) -> Column:
    """A running analysis: 12 bits of analysis above 32 bits of function; raises on an analysis that needs more."""
    ok = analysis.between(0, (1 << 12) - 1)
    packed = F.shiftleft(analysis.cast("long"), 32).bitwiseOR(function.cast("long").bitwiseAND((1 << 32) - 1))
    return F.when(ok, packed).otherwise(F.raise_error(F.format_string("analysis id %s needs over 12 bits", analysis.cast("string"))).cast("long"))


def instance_analysis(instance: Column) -> Column:
    return F.shiftrightunsigned(instance, 32).bitwiseAND((1 << 12) - 1)


def instance_function(instance: Column) -> Column:
    return instance.bitwiseAND((1 << 32) - 1)


def fact_get(fact: Column, field: str) -> Column:
    shift, bits = FACT_BITS[field]
    return F.shiftrightunsigned(fact, shift).bitwiseAND((1 << bits) - 1)


def fact_with(fact: Column, field: str, value: Column) -> Column:
    """The fact id with one field replaced; a value too wide loses its upper bits."""
    shift, bits = FACT_BITS[field]
    mask = ((1 << bits) - 1) << shift
    keep = ~mask if mask < 1 << 63 else ~mask + (1 << 64)
    keep = keep - (1 << 64) if keep >= 1 << 63 else keep
    return fact.bitwiseAND(F.lit(keep).cast("long")).bitwiseOR(F.shiftleft(value.cast("long").bitwiseAND((1 << bits) - 1), shift))


def fact_key(fact: Column) -> Column:
    return fact_with(fact, "version", F.lit(0))


def fact_next(fact: Column, changed: Column) -> Column:
    """One version further where something changed; raises when 15 bits are used up."""
    v = fact_get(fact, "version")
    up = F.when(v == (1 << 15) - 1, F.raise_error(F.lit("version overflow")).cast("long")).otherwise(fact_with(fact, "version", v + 1))
    return F.when(changed, up).otherwise(fact)


def change_text(code: Column) -> Column:
    return lookup({c: c.name for c in ChangeCode}, code, F.lit("UnknownFactChange"))


def has_nop(code: Column) -> Column:
    return code.between(int(ChangeCode.NopNoChange), int(ChangeCode.NopInOutChanged))

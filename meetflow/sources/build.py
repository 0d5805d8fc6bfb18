"""Units built by hand: for fixtures, examples and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import EntityKind, ExprKind, InsnKind, ValueKind
from ..functions.scalars import assign_kind
from .schema import SCHEMAS
from .wire import unit_bytes

I, X = InsnKind, ExprKind


def expr(kind: ExprKind, op1: int | None = None, op2: int | None = None, args: list[int] | None = None) -> dict:
    return {"xkind": int(kind), "op1": op1, "op2": op2, "args": args or []}


def value(eid: int, other: int | None = None) -> dict:
    return expr(X.VAL, eid, other)


def simple(e: dict) -> bool:
    return e["xkind"] == X.VAL


class Rows:
    """Instructions from columns: struct<ikind, expr1, expr2>, for programs that are rows of tables."""

    EXPR = "struct<xkind:int,op1:bigint,op2:bigint,args:array<bigint>>"

    @staticmethod
    def expr(kind: Column | int, op1: Column | None = None, op2: Column | None = None, *args: Column) -> Column:
        none = F.lit(None)
        x = kind if isinstance(kind, Column) else F.lit(int(kind))
        return F.struct(x.alias("xkind"), (none if op1 is None else op1).alias("op1"), (none if op2 is None else op2).alias("op2"), F.array(*args).alias("args")).cast(Rows.EXPR)

    @staticmethod
    def value(op1: Column, op2: Column | None = None) -> Column:
        return Rows.expr(X.VAL, op1, op2)

    @staticmethod
    def insn(kind: Column | int, expr1: Column | None = None, expr2: Column | None = None) -> Column:
        none = F.lit(None).cast(Rows.EXPR)
        k = kind if isinstance(kind, Column) else F.lit(int(kind))
        return F.struct(k.alias("ikind"), (none if expr1 is None else expr1).alias("expr1"), (none if expr2 is None else expr2).alias("expr2"))

    @staticmethod
    def use(a: Column, b: Column | None = None, c: Column | None = None, kill: bool = False) -> Column:
        return Rows.insn(I.USE_KILL if kill else I.USE, Rows.value(a, b), None if c is None else Rows.value(c))

    @staticmethod
    def assign(left: Column, right: Column) -> Column:
        """The kind follows from the sides; an error if both are compound."""
        plain = lambda e: e["xkind"] == int(X.VAL)
        kind = assign_kind(plain(left), plain(right), right["xkind"] == int(X.CALL))
        both = F.raise_error(F.lit("both sides are compound")).cast("int")
        return Rows.insn(F.when(~plain(left) & ~plain(right), both).otherwise(kind), left, right)

    @staticmethod
    def self_assign(a: Column) -> Column:
        return Rows.insn(I.ASGN_SELF, Rows.value(a))

    @staticmethod
    def call(callee: Column, *args: Column) -> Column:
        return Rows.insn(I.CALL, Rows.expr(X.CALL, callee, None, *args))

    @staticmethod
    def cond(a: Column, true: Column, false: Column) -> Column:
        return Rows.insn(I.COND, Rows.value(a), Rows.value(true, false))

    @staticmethod
    def one(kind: InsnKind, a: Column | None = None) -> Column:
        """Nops and barriers; gotos, labels and returns with their operand."""
        return Rows.insn(kind, None if a is None else Rows.value(a))


class Unit:
    """Collects rows; ids are handed out in order of use, names to ids must be unique."""

    def __init__(self, name: str, tu_id: int = 1, path: str | None = None) -> None:
        self.rows: dict[str, list[dict]] = {k: [] for k in ("tu", "name_id", "entity", "data_type", "func", "insn")}
        self.tu_id, self.next, self.ids = tu_id, 2, {}
        self.rows["tu"].append({"tu_id": tu_id, "name": name, "abs_path": path, "origin": "built"})

    def entity(self, kind: EntityKind, vkind: ValueKind = ValueKind.INT32, name: str | None = None, **more) -> int:
        if name in self.ids:
            raise ValueError(f"{name} is there already")
        eid, self.next = self.next, self.next + 1
        row = dict.fromkeys(("anonymous", "member_access", "qtype", "parent_eid", "data_type_eid", "low_val", "high_val", "str_val", "line", "col"))
        self.rows["entity"].append(row | {"tu_id": self.tu_id, "eid": eid, "ekind": int(kind), "vkind": int(vkind)} | more)
        if name is not None:
            self.ids[name] = eid
            self.rows["name_id"].append({"tu_id": self.tu_id, "name": name, "eid": eid})
        return eid

    def var(self, name: str, function: int | None = None, vkind: ValueKind = ValueKind.INT32) -> int:
        kind = EntityKind.VAR_GLBL if function is None else EntityKind.VAR_LOCL
        return self.entity(kind, vkind, name, parent_eid=function)

    def const(self, number: int, vkind: ValueKind = ValueKind.INT32) -> int:
        return self.entity(EntityKind.LIT_NUM, vkind, None, low_val=number % 2**64)

    def label(self, name: str) -> int:
        return self.entity(EntityKind.LABEL, ValueKind.VOID, None, str_val=name)

    def function(self, name: str, variadic: bool = False) -> int:
        fid = self.entity(EntityKind.FUNC, ValueKind.PTR_TO_FUNC, name)
        self.rows["func"].append({"tu_id": self.tu_id, "fid": fid, "fname": name, "is_variadic": variadic, "type_eid": 0, "calling_convention": None})
        return fid

    def insn(self, fid: int, kind: InsnKind, expr1: dict | None = None, expr2: dict | None = None, line: int | None = None) -> int:
        seq = sum(r["fid"] == fid for r in self.rows["insn"])
        self.rows["insn"].append({"tu_id": self.tu_id, "fid": fid, "seq": seq, "ikind": int(kind), "expr1": expr1, "expr2": expr2, "line": line, "col": None})
        return seq

    def nop(self, fid: int) -> int:
        return self.insn(fid, I.NOP)

    def barrier(self, fid: int) -> int:
        return self.insn(fid, I.BARRIER)

    def use(self, fid: int, *eids: int, kill: bool = False) -> int:
        """A use of up to three entities."""
        a, b, c = [*eids, None, None, None][:3]
        return self.insn(fid, I.USE_KILL if kill else I.USE, value(a, b) if a else None, value(c) if c else None)

    def assign(self, fid: int, left: dict, right: dict) -> int:
        """The kind follows from the sides; at most one may be compound."""
        if not simple(left) and not simple(right):
            raise ValueError("both sides are compound")
        kind = I.ASGN_CALL if right["xkind"] == X.CALL else I.ASGN_LHS_OP if not simple(left) else I.ASGN_SIMPLE if simple(right) else I.ASGN_RHS_OP
        return self.insn(fid, kind, left, right)

    def self_assign(self, fid: int, eid: int) -> int:
        return self.insn(fid, I.ASGN_SELF, value(eid))

    def call(self, fid: int, callee: int, *args: int) -> int:
        return self.insn(fid, I.CALL, expr(X.CALL, callee, None, list(args)))

    def goto(self, fid: int, label: int) -> int:
        return self.insn(fid, I.GOTO, value(label))

    def place(self, fid: int, label: int) -> int:
        return self.insn(fid, I.LABEL, value(label))

    def cond(self, fid: int, eid: int, true: int, false: int) -> int:
        return self.insn(fid, I.COND, value(eid), value(true, false))

    def ret(self, fid: int, eid: int | None = None) -> int:
        return self.insn(fid, I.RETURN, value(eid) if eid else None)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        from decimal import Decimal

        def row(name: str, r: dict) -> tuple:
            out = []
            for field in SCHEMAS[name].split(", ") if name != "insn" else ["tu_id", "fid", "seq", "ikind", "expr1", "expr2", "line", "col"]:
                v = r[field.split(" ")[0]]
                out.append(Decimal(v) if v is not None and "decimal" in field else tuple(v[k] for k in ("xkind", "op1", "op2", "args")) if isinstance(v, dict) else v)
            return tuple(out)

        return {k: spark.createDataFrame([row(k, r) for r in rows], SCHEMAS[k]) for k, rows in self.rows.items()}

    def wire(self) -> bytes:
        return unit_bytes(self.rows)


def example_sum() -> Unit:
    """x = y + 10."""
    u = Unit("sum.c")
    f = u.function("f:main")
    u.assign(f, value(u.var("v:main:x", f)), expr(X.ADD, u.var("v:main:y", f), u.const(10)))
    return u


def example_branch() -> Unit:
    """if (c) x = 1; else x = 2; return x."""
    u = Unit("branch.c")
    f = u.function("f:main")
    c, x = u.var("v:main:c", f), u.var("v:main:x", f)
    yes, no, end = u.label("yes"), u.label("no"), u.label("end")
    u.cond(f, c, yes, no)
    u.place(f, yes)
    u.assign(f, value(x), value(u.const(1)))
    u.goto(f, end)
    u.place(f, no)
    u.assign(f, value(x), value(u.const(2)))
    u.place(f, end)
    u.ret(f, x)
    return u

"""Fixed values of the program representation: numbers and names of its kinds."""

from __future__ import annotations

from enum import IntEnum

# The wire format's enumerations.

EntityKind = IntEnum("EntityKind", {
    "NIL": 0, "VAR_GLBL": 1, "VAR_LOCL": 2, "VAR_LOCL_ARG": 3, "VAR_LOCL_STATIC": 4, "VAR_LOCL_TMP": 5, "VAR_LOCL_SSA": 6,
    "VAR_LOCL_OTHER": 7, "LIT_NUM": 8, "LIT_NUM_IMM": 9, "LIT_STR": 10, "DATA_TYPE": 11, "FUNC": 12, "RECORD_FIELD": 13,
    "LABEL": 14, "OTHER": 15, "INSN0": 16, "INSN1": 17, "INSN2": 18, "BB": 19, "CFG": 20, "SCOPE": 21, "TU": 22, "SRC_FILE": 23,
})

InsnKind = IntEnum("InsnKind", {
    "NIL": 0, "NOP": 1, "BARRIER": 2, "SELECT": 3, "USE_KILL": 4, "USE": 5, "ASGN_SELF": 6, "ASGN_SIMPLE": 7, "ASGN_RHS_OP": 8,
    "ASGN_LHS_OP": 9, "ASGN_CALL": 10, "ASGN_PHI": 11, "CALL": 12, "GOTO": 13, "COND": 14, "LABEL": 15, "RETURN": 16,
})

ExprKind = IntEnum("ExprKind", {
    "NIL": 0, "VAL": 1, "ADD": 2, "SUB": 3, "MUL": 4, "DIV": 5, "MOD": 6, "AND": 7, "OR": 8, "XOR": 9, "SHL": 10, "SHR": 11, "SHRA": 12,
    "EQ": 13, "NE": 14, "LT": 15, "GE": 16, "ARR_INDX": 17, "ARR_INDX_ADDROF": 18, "MEMBER_ACCESS": 19, "MEMBER_ADDROF": 20,
    "CALL": 21, "CAST": 22, "BIT_NOT": 23, "NEGATE": 24, "NOT": 25, "DEREF": 26, "ADDROF": 27, "SIZEOF": 28, "ALIGNOF": 29,
    "ALLOC": 30, "OTHER": 31,
})

ValueKind = IntEnum("ValueKind", {
    "VOID": 0, "CHAR": 1, "INT8": 2, "INT16": 3, "INT32": 4, "INT64": 5, "UINT8": 6, "UINT16": 7, "UINT32": 8, "UINT64": 9,
    "N_BITS": 10, "N_UBITS": 11, "BOOL": 12, "FLOAT16": 13, "FLOAT32": 14, "FLOAT64": 15, "FLOAT80": 16, "PTR_TO_VOID": 17,
    "PTR_TO_PTR": 18, "PTR_TO_ARR": 19, "PTR_TO_CHAR": 20, "PTR_TO_INT": 21, "PTR_TO_FLOAT": 22, "PTR_TO_RECORD": 23,
    "PTR_TO_FUNC": 24, "ARR_FIXED": 25, "ARR_VARIABLE": 26, "ARR_PARTIAL": 27, "UNION": 28, "STRUCT": 29, "CLASS": 30, "OTHER": 31,
})

Qualifier = IntEnum("Qualifier", {
    "NIL": 0, "CONST": 1, "CONST_DEST": 2, "LOCL_STATIC": 4, "GLBL_STATIC": 8, "VOLATILE": 16, "WEAK": 32, "THREAD_LOCAL": 64,
    "NO_INIT": 128, "EXTERNAL": 256, "NO_DEF": 512, "RESTRICT": 1024, "INLINE": 2048, "ATOMIC": 4096, "REGISTER": 8192,
    "RECORD_MEMBER": 16384, "OTHER": 32768,
})

EdgeLabel = IntEnum("EdgeLabel", {"SIMPLE": 0, "TRUE": 1, "FALSE": 2, "BACK": 3})

FactPoint = IntEnum("FactPoint", {"NONE": 0, "IN": 1, "OUT": 2, "INOUT": 3, "TRUEOUT": 4, "FALSEOUT": 5})

ChangeCode = IntEnum("ChangeCode", {
    "NoChange": 0, "Changed": 1, "InChanged": 2, "OutChanged": 3, "InOutChanged": 4, "TrueOutChanged": 5, "FalseOutChanged": 6,
    "NopNoChange": 7, "NopInChanged": 8, "NopOutChanged": 9, "NopInOutChanged": 10, "NoChangeInfo": 11, "NotImplemented": 12,
})

ViewKind = IntEnum("ViewKind", {"NONE": 0, "BARRIER": 1, "DEAD_ASSIGN": 2, "DEREF": 3, "DEREF_LHS": 4, "DEREF_RHS": 5,
                                "RHS_LITERAL": 6, "INDEX_LITERAL": 7, "CONDITION": 8})

# Symbols, sizes and ranges of the language.

#: Operator symbols by expression kind; bitwise or has its own sign.
SYMBOLS = {
    ExprKind.ADD: "+", ExprKind.SUB: "-", ExprKind.MUL: "*", ExprKind.DIV: "/", ExprKind.MOD: "%", ExprKind.AND: "&", ExprKind.OR: "|",
    ExprKind.XOR: "^", ExprKind.SHL: "<<", ExprKind.SHR: ">>", ExprKind.SHRA: ">>>", ExprKind.EQ: "==", ExprKind.NE: "!=",
    ExprKind.LT: "<", ExprKind.GE: ">=", ExprKind.ARR_INDX: "[]", ExprKind.MEMBER_ACCESS: "->", ExprKind.MEMBER_ADDROF: "&",
    ExprKind.CALL: "()", ExprKind.CAST: "(", ExprKind.BIT_NOT: "~", ExprKind.NEGATE: "-", ExprKind.NOT: "!", ExprKind.DEREF: "*",
    ExprKind.ADDROF: "&", ExprKind.SIZEOF: "sizeof", ExprKind.ALIGNOF: "alignof", ExprKind.ALLOC: "alloc", ExprKind.OTHER: "xother",
}

#: Bytes of a value; pointers have 8, all other kinds 0.  Alignments are the same.
SIZES = {
    ValueKind.CHAR: 1, ValueKind.INT8: 1, ValueKind.INT16: 2, ValueKind.INT32: 4, ValueKind.INT64: 8, ValueKind.UINT8: 1,
    ValueKind.UINT16: 2, ValueKind.UINT32: 4, ValueKind.UINT64: 8, ValueKind.BOOL: 1, ValueKind.FLOAT32: 4, ValueKind.FLOAT64: 8,
}

#: Smallest and largest value of each integer kind.
FULL_RANGE = {
    ValueKind.CHAR: (-(2**7), 2**7 - 1), ValueKind.INT8: (-(2**7), 2**7 - 1), ValueKind.INT16: (-(2**15), 2**15 - 1),
    ValueKind.INT32: (-(2**31), 2**31 - 1), ValueKind.INT64: (-(2**63), 2**63 - 1), ValueKind.UINT8: (0, 2**8 - 1),
    ValueKind.UINT16: (0, 2**16 - 1), ValueKind.UINT32: (0, 2**32 - 1), ValueKind.UINT64: (0, 2**64 - 1), ValueKind.BOOL: (0, 1),
}

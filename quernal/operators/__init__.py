"""Operator types: their codes, symbols and arity."""

from __future__ import annotations

from typing import NamedTuple


class OpType(NamedTuple):
    code: int
    name: str
    symbol: str
    arity: int


# Operator codes, names, symbols, numbers of operands.
OPTYPES = tuple(
    OpType(*x)
    for x in (
        (1, "IMPLICIT_CAST", "#implicit cast", 1), (2, "CAST", "#cast", 1),
        (3, "ADD", "+", 2), (4, "SUB", "-", 2), (5, "MUL", "*", 2), (6, "DIV", "/", 2), (7, "MOD", "%", 2), (8, "LSH", "<<", 2), (9, "RSH", ">>", 2),
        (10, "EQ", "=", 2), (11, "NE", "<>", 2), (12, "LT", "<", 2), (13, "LE", "<=", 2), (14, "GT", ">", 2), (15, "GE", ">=", 2),
        (16, "NOT", "NOT", 1), (17, "OR", "OR", 2), (18, "AND", "AND", 2),
        (19, "BITNOT", "~", 1), (20, "BITOR", "|", 2), (21, "BITAND", "&", 2), (22, "BITXOR", "^", 2), (23, "NEG", "-", 1),
    )
)
INVALID = OpType(0, "INVALID", "#invalid", 0)

BY_CODE = {x.code: x for x in OPTYPES}
BY_NAME = {x.name: x for x in OPTYPES}


def symbol(code: int) -> str:
    """The symbol of an operator type; that of the invalid one for any other code."""
    return BY_CODE.get(code, INVALID).symbol


def parse_symbol(text: str, arity: int | None = None) -> int:
    """The code for a symbol, 0 if there is none. "-" is both SUB and NEG: arity decides, SUB without it."""
    return next((x.code for x in OPTYPES if x.symbol == text and arity in (None, x.arity)), INVALID.code)


def is_unary(code: int) -> bool:
    return BY_CODE.get(code, INVALID).arity == 1


def is_binary(code: int) -> bool:
    return BY_CODE.get(code, INVALID).arity == 2

"""The registry of built-in functions: each builds a Spark Column from its arguments' Columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column

from quernal import operators as ops
from quernal.errors import EngineError
from quernal.types import BOOL, INVALID_OID, TypeSpec


class Function(NamedTuple):
    oid: int
    name: str
    returns: TypeSpec
    args: tuple[TypeSpec, ...]
    operators: tuple[str, ...]
    build: Callable[..., Column]
    takes_typparam: bool

    def __call__(self, *columns: Column, typparam: int = 0) -> Column:
        if len(columns) != len(self.args):
            raise EngineError(f"{self.name} takes {len(self.args)} arguments, not {len(columns)}")
        return self.build(*columns, typparam=typparam) if self.takes_typparam else self.build(*columns)


FUNCTIONS: dict[int, Function] = {}
BY_NAME: dict[str, Function] = {}
#: (operator code, type of operand 0, type of operand 1 or 0) -> function id
OPERATORS: dict[tuple[int, int, int], int] = {}


def builtin(returns: TypeSpec, name: str, oid: int, args: tuple[TypeSpec, ...], operators: tuple[str, ...] = (), typparam: bool = False):
    """Registers the decorated Column builder."""

    def register(build: Callable[..., Column]) -> Callable[..., Column]:
        if oid in FUNCTIONS or name in BY_NAME:
            raise EngineError(f"function {name} ({oid}) is registered twice")
        FUNCTIONS[oid] = BY_NAME[name] = Function(oid, name, returns, args, operators, build, typparam)
        for op in operators:
            key = (ops.BY_NAME[op].code, args[0].oid, args[1].oid if len(args) > 1 else INVALID_OID)
            if key in OPERATORS:
                raise EngineError(f"operator {op} of {name} is registered twice")
            OPERATORS[key] = oid
        return build

    return register


def find(oid: int) -> Function | None:
    return FUNCTIONS.get(oid)


def find_by_name(name: str) -> Function | None:
    """By name, without regard to ASCII case."""
    return BY_NAME.get(name) or next((f for n, f in BY_NAME.items() if n.lower() == name.lower()), None)


def resolve(op: int | str, arg0: TypeSpec, arg1: TypeSpec | None = None) -> Function:
    """The function of an operator for operands of exactly these types; nothing is coerced."""
    kind = ops.BY_NAME[op] if isinstance(op, str) else ops.BY_CODE.get(op, ops.INVALID)
    if kind.arity != (1 if arg1 is None else 2):
        raise EngineError(f"operator {kind.name} takes {kind.arity} operands")
    oid = OPERATORS.get((kind.code, arg0.oid, arg1.oid if arg1 else INVALID_OID))
    if oid is None:
        raise EngineError(f"no operator {kind.symbol} for {arg0.name}" + (f" and {arg1.name}" if arg1 else ""))
    return FUNCTIONS[oid]


def is_predicate(f: Function) -> bool:
    return len(f.args) == 2 and f.returns is BOOL

"""Typed expressions: Python operators resolved by exact operand types to built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

import quernal.functions  # noqa: F401  registers them
from quernal import registry
from quernal.errors import EngineError
from quernal.types import BOOL, CHAR, VARCHAR, TypeSpec


class Expr:
    """A Column with its SQL type. Mixed types are errors, not coercions; only cast() converts."""

    def __init__(self, column: Column, kind: TypeSpec, typparam: int = 0):
        self.column, self.type, self.typparam = column, kind, typparam

    def _apply(self, op: str, other: Expr | None = None) -> Expr:
        f = registry.resolve(op, self.type, other.type if other is not None else None)
        return Expr(f(*(x.column for x in (self, other) if x is not None)), f.returns)

    def cast(self, to: TypeSpec, typparam: int = 0) -> Expr:
        """Between CHAR and VARCHAR, the only types with a CAST operator."""
        f = next((registry.FUNCTIONS[o] for (op, a, _), o in registry.OPERATORS.items() if op == 2 and a == self.type.oid), None)
        if f is None or f.returns is not to:
            raise EngineError(f"no cast from {self.type.name} to {to.name}")
        return Expr(f(self.column, typparam=typparam), to, typparam)

    def __add__(self, o: Expr) -> Expr:
        return self._apply("ADD", o)

    def __sub__(self, o: Expr) -> Expr:
        return self._apply("SUB", o)

    def __mul__(self, o: Expr) -> Expr:
        return self._apply("MUL", o)

    def __truediv__(self, o: Expr) -> Expr:
        return self._apply("DIV", o)

    def __mod__(self, o: Expr) -> Expr:
        return self._apply("MOD", o)

    def __lshift__(self, o: Expr) -> Expr:
        return self._apply("LSH", o)

    def __rshift__(self, o: Expr) -> Expr:
        return self._apply("RSH", o)

    def __eq__(self, o: Expr) -> Expr:  # type: ignore[override]
        return self._apply("EQ", o)

    def __ne__(self, o: Expr) -> Expr:  # type: ignore[override]
        return self._apply("NE", o)

    def __lt__(self, o: Expr) -> Expr:
        return self._apply("LT", o)

    def __le__(self, o: Expr) -> Expr:
        return self._apply("LE", o)

    def __gt__(self, o: Expr) -> Expr:
        return self._apply("GT", o)

    def __ge__(self, o: Expr) -> Expr:
        return self._apply("GE", o)

    def __neg__(self) -> Expr:
        return self._apply("NEG")

    def __invert__(self) -> Expr:
        return self._apply("NOT" if self.type is BOOL else "BITNOT")

    def __or__(self, o: Expr) -> Expr:
        return self._apply("OR" if self.type is BOOL else "BITOR", o)

    def __and__(self, o: Expr) -> Expr:
        return self._apply("AND" if self.type is BOOL else "BITAND", o)

    def __xor__(self, o: Expr) -> Expr:
        return self._apply("BITXOR", o)

    __hash__ = None  # type: ignore[assignment]


def literal(value, kind: TypeSpec, typparam: int = 0) -> Expr:
    """A constant of a type, range-checked."""
    if value is not None and (kind.is_int or kind.name == "OID") and not kind.limits[0] <= value <= kind.limits[1]:
        raise EngineError(f"{value} is out of range for {kind.name}")
    text = str(value) if kind.name == "UINT8" and value is not None else value
    return Expr(F.lit(text).cast(kind.spark), kind, typparam)


def call(name: str, *args: Expr, typparam: int = 0) -> Expr:
    """A built-in function by name; argument types must be its own."""
    f = registry.find_by_name(name)
    if f is None:
        raise EngineError(f"function {name} not found")
    if [a.type for a in args] != list(f.args):
        raise EngineError(f"{f.name} takes ({', '.join(t.name for t in f.args)})")
    out = f(*(a.column for a in args), typparam=typparam)
    return Expr(out, f.returns, typparam if f.returns in (CHAR, VARCHAR) else 0)

"""FLOAT and DOUBLE by the rules of IEEE 754: division by zero gives infinities or NaN, and NaN equals nothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernal.functions.common import COMPARISONS, SPACE, fail
from quernal.registry import builtin
from quernal.types import BOOL, DOUBLE, FLOAT, STRING, TypeSpec

# The object id of each type's first function.
FIRST_OID = {"FLOAT": 800, "DOUBLE": 830}

_NUMBER = rf"^{SPACE}[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity)){SPACE}$"
_NAN = rf"^{SPACE}[+-]?(?i:nan)(?:\([A-Za-z0-9_]*\))?{SPACE}$"


@F.pandas_udf(T.StringType())
def _six_digits(x: pd.Series) -> pd.Series:
    """C's %g, which Java's formatter does not know: six significant digits, no trailing zeros."""
    return x.map(lambda v: "%g" % v, na_action=None)


def _out(a: Column) -> Column:
    # A NaN would reach pandas like a NULL.
    return F.when(a.isNull(), F.lit(None)).when(F.isnan(a), F.lit("nan")).otherwise(_six_digits(F.coalesce(a.cast("double"), F.lit(0.0))))


def _in(t: TypeSpec, s: Column) -> Column:
    kind = t.spark.simpleString()
    bad = fail('cannot parse "', s, f'" as a {t.name}').cast(kind)
    return F.when(s.isNull(), F.lit(None)).when(s.rlike(_NAN), F.lit(float("nan")).cast(kind)).when(s.rlike(_NUMBER), F.trim(F.translate(s, "\t\n\x0b\f\r", "     ")).try_cast(kind)).otherwise(bad).cast(kind)


def _quotient(t: TypeSpec, a: Column, b: Column) -> Column:
    kind = t.spark.simpleString()
    minus = (a < 0) != (b.cast("string") == F.lit("-0.0"))
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(minus, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, by_zero).otherwise(a.cast("double") / b.cast("double")).cast(kind)


def register(t: TypeSpec) -> None:
    kind, first = t.spark.simpleString(), FIRST_OID[t.name]
    table = [
        (t, "in", (STRING,), (), lambda s: _in(t, s)), (STRING, "out", (t,), (), _out),
        (t, "add", (t, t), ("ADD",), lambda a, b: (a + b).cast(kind)), (t, "sub", (t, t), ("SUB",), lambda a, b: (a - b).cast(kind)), (t, "mul", (t, t), ("MUL",), lambda a, b: (a * b).cast(kind)),
        (t, "div", (t, t), ("DIV",), lambda a, b: _quotient(t, a, b)), (t, "neg", (t,), ("NEG",), lambda a: F.negative(a)),
    ]
    for i, (returns, name, args, operators, build) in enumerate(table):
        builtin(returns, f"{t.name}_{name}", first + i, args, operators)(build)
    for i, (name, (op, compare)) in enumerate(COMPARISONS.items()):
        builtin(BOOL, f"{t.name}_{name}", first + 7 + i, (t, t), (op,))(_compared(name, compare))


def _compared(name: str, compare):
    """Spark takes NaN as equal to itself and above all else. What that makes true is taken back by a second conjunct,
    so that the plain comparison still reaches the scan; the tests for NULL leave NULL to it."""

    def build(a: Column, b: Column) -> Column:
        wrong, other = (b, a) if name in ("lt", "le") else (a, b)
        nan = F.isnan(wrong) & other.isNotNull()
        return compare(a, b) | nan if name == "ne" else compare(a, b) & ~nan

    return build


for _t in (FLOAT, DOUBLE):
    register(_t)

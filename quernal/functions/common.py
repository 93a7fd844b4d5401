"""What several function families share. All formulas give the same result under ANSI and non-ANSI Spark."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernal.registry import builtin
from quernal.types import BOOL, TypeSpec

SPACE = r"[ \t\n\x0B\f\r]*"


def fail(*parts: Column | str) -> Column:
    return F.raise_error(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def lower(x: Column) -> Column:
    """ASCII letters only, as comparisons without case need it."""
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def trimmed(x: Column) -> Column:
    """Without trailing blanks; other white space stays."""
    return F.rtrim(x, F.lit(" "))


COMPARISONS = {"eq": ("EQ", lambda a, b: a == b), "ne": ("NE", lambda a, b: a != b), "lt": ("LT", lambda a, b: a < b), "le": ("LE", lambda a, b: a <= b), "gt": ("GT", lambda a, b: a > b), "ge": ("GE", lambda a, b: a >= b)}


def comparisons(t: TypeSpec, first_oid: int, key=lambda x: x, suffix: str = "", operators: bool = True) -> None:
    """Registers the six comparisons of a type with consecutive object ids."""
    for i, (name, (op, compare)) in enumerate(COMPARISONS.items()):
        build = lambda a, b, compare=compare: compare(key(a), key(b))
        builtin(BOOL, f"{t.name}_{name}{suffix}", first_oid + i, (t, t), (op,) if operators else ())(build)

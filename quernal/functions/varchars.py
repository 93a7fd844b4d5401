"""VARCHAR(n): n bytes at most; trailing blanks count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernal.functions.chars import MAX_BYTES, cut, fitted
from quernal.functions.common import comparisons, fail, lower
from quernal.functions.integers import wrapped
from quernal.registry import builtin
from quernal.types import BOOL, CHAR, INT2, STRING, VARCHAR

builtin(VARCHAR, "VARCHAR_in", 860, (STRING,), typparam=True)(lambda s, typparam: fitted(s, typparam, False))
builtin(STRING, "VARCHAR_out", 861, (VARCHAR,))(lambda a: a)
builtin(INT2, "VARCHAR_length", 863, (VARCHAR,))(lambda a: wrapped(INT2, F.octet_length(a).cast("bigint")))


@builtin(VARCHAR, "VARCHAR_concat", 864, (VARCHAR, VARCHAR))
def varchar_concat(a: Column, b: Column) -> Column:
    size = F.octet_length(a) + F.octet_length(b)
    return F.when(size > MAX_BYTES, fail("joined strings of ", size.cast("string"), " bytes are longer than a record holds").cast("string")).otherwise(F.concat(a, b))


comparisons(VARCHAR, 865)


@builtin(CHAR, "VARCHAR_to_CHAR", 871, (VARCHAR,), ("CAST",), typparam=True)
def varchar_to_char(a: Column, typparam: int) -> Column:
    short = cut(a, typparam)
    return F.concat(short, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(typparam) - F.octet_length(short))))


builtin(BOOL, "VARCHAR___STRING_eq", 872, (VARCHAR, STRING), ("EQ",))(lambda a, b: a == b)
comparisons(VARCHAR, 873, lower, "_ci", operators=False)
builtin(BOOL, "VARCHAR___STRING_eq_ci", 879, (VARCHAR, STRING))(lambda a, b: lower(a) == lower(b))

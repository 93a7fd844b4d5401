"""CHAR(n): n bytes, padded with blanks; trailing blanks do not count in comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernal.errors import EngineError
from quernal.functions.common import comparisons, fail, lower, trimmed
from quernal.registry import builtin
from quernal.types import CHAR, INT2, STRING, UINT8, VARCHAR

#: The longest string that a record can hold.
MAX_BYTES = 32767


def fitted(s: Column, n: int, pad: bool) -> Column:
    """s within n bytes: only blanks beyond are dropped, anything else is an error. pad: to n bytes."""
    short = trimmed(s)
    blanks = lambda x: F.concat(x, F.repeat(F.lit(" "), F.lit(n) - F.octet_length(x)))
    bad = fail("a string of ", F.octet_length(short).cast("string"), f" bytes, {n} fit")
    return F.when(F.octet_length(s) <= n, blanks(s) if pad else s).when(F.octet_length(short) <= n, blanks(short)).when(s.isNotNull(), bad.cast("string"))


def cut(s: Column, n: int) -> Column:
    """The first n bytes; all of them if n is 0."""
    return F.when(F.octet_length(s) > n, F.substring(s.cast("binary"), 1, n).cast("string")).otherwise(s) if n else s


builtin(CHAR, "CHAR_in", 890, (STRING,), typparam=True)(lambda s, typparam: fitted(s, typparam, True))
builtin(STRING, "CHAR_out", 891, (CHAR,))(lambda a: a)


def char_length(n: int | None) -> int:
    """The length of a CHAR column from its type parameter, at plan time."""
    if n is None:
        raise EngineError("NULL type parameter")
    if not 0 <= n <= MAX_BYTES:
        raise EngineError(f"CHAR does not support maximum length of {n}")
    return n


@builtin(INT2, "CHAR_typlen", 892, (UINT8,))
def char_typlen(n: Column) -> Column:
    null, long = fail("NULL type parameter").cast("smallint"), fail("CHAR does not support maximum length of ", n.cast("string")).cast("smallint")
    return F.when(n.isNull(), null).when(n > MAX_BYTES, long).otherwise(n.cast("smallint"))


builtin(VARCHAR, "CHAR_to_VARCHAR", 893, (CHAR,), ("IMPLICIT_CAST", "CAST"), typparam=True)(lambda a, typparam: cut(trimmed(a), typparam))
comparisons(CHAR, 894, trimmed)
comparisons(CHAR, 900, lambda x: lower(trimmed(x)), "_ci", operators=False)

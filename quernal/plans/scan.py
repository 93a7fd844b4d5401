"""Scans with record ids, and the filtered search: an AND of equalities by named functions, with early stops."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import quernal.functions  # noqa: F401
from quernal import registry
from quernal.errors import EngineError
from quernal.types import CHAR

RID = "rid"


class RecordId(NamedTuple):
    """A row's address; ids order by page, then slot. Slots count from 1, so 0 is no valid slot."""

    pid: int
    sid: int

    @property
    def is_valid(self) -> bool:
        return self.pid >= 0 and self.sid > 0

    def __str__(self) -> str:
        return f"({self.pid}, {self.sid})"

    def column(self) -> Column:
        return F.struct(F.lit(self.pid).cast("bigint").alias("pid"), F.lit(self.sid).cast("bigint").alias("sid"))


def with_rid(df: DataFrame) -> DataFrame:
    """df with its rows' addresses: the partition as page, the place in it as slot. No shuffle and no job."""
    n = F.monotonically_increasing_id()
    return df.withColumn(RID, F.struct(F.shiftright(n, 33).alias("pid"), (n.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("sid")))


def scan_from(df: DataFrame, rid: RecordId) -> DataFrame:
    """Rows at or after an address, in order."""
    return df.where(F.col(RID) >= rid.column()).orderBy(RID)


def fetch(df: DataFrame, rid: RecordId) -> DataFrame:
    return df.where(F.col(RID) == rid.column())


class Predicate(NamedTuple):
    """column = value by the equality function of this name."""

    column: str
    function: str
    value: Column


def matches(predicates: list[Predicate]) -> Column:
    """All equalities; a NULL is no match."""

    def one(p: Predicate) -> Column:
        f = registry.find_by_name(p.function)
        if f is None or not registry.is_predicate(f):
            raise EngineError(f"{p.function} is no comparison of two values")
        return f(F.col(p.column), p.value)

    return reduce(lambda a, b: a & b, map(one, predicates), F.lit(True))


def search(df: DataFrame, predicates: list[Predicate], unique: bool = False, n: int = 0, order: str | None = None) -> DataFrame:
    """Rows that match: the first if unique, the first n, or all if n is 0.

    The first is so by `order`, by default by address if the rows have one; else it is any.
    """
    out = df.where(matches(predicates))
    order = order or (RID if RID in df.columns else None)
    limit = 1 if unique else n
    if not limit:
        return out
    return (out.orderBy(order) if order else out).limit(limit)


def ordered(df: DataFrame, *keys: str, descending: bool = False) -> DataFrame:
    """df by its columns' types: trailing blanks of CHAR do not count, NaN is above all numbers and equals itself, -0 equals 0, NULLs come first."""

    def key(name: str) -> Column:
        field = df.schema[name]
        is_char = field.metadata.get("typid") == CHAR.oid
        x = F.rtrim(name) if is_char else F.col(name)
        return x.desc_nulls_last() if descending else x.asc_nulls_first()

    return df.orderBy(*map(key, keys))


def update(df: DataFrame, predicates: list[Predicate], changes: dict[str, Column]) -> DataFrame:
    """df with the matching rows' columns changed."""
    hit = F.coalesce(matches(predicates), F.lit(False))
    return df.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns))


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)

"""Row schemas: ordered typed fields with type parameters, nullability and optional names."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernal.errors import EngineError
from quernal.functions.chars import MAX_BYTES, char_length, fitted
from quernal.functions.common import fail
from quernal.types import BY_OID, CHAR, VARCHAR, TypeSpec

MAX_FIELDS = 32767
#: What field() answers for a name that does not exist.
NO_FIELD = 0x7FFF


class Field(NamedTuple):
    type: TypeSpec
    typparam: int
    nullable: bool
    name: str

    @property
    def length(self) -> int:
        return char_length(self.typparam) if self.type is CHAR else self.type.length


class Schema(NamedTuple):
    fields: tuple[Field, ...]

    @classmethod
    def create(cls, typids: list[int], typparams: list[int] | None = None, nullable: list[bool] | None = None, names: list[str] | None = None) -> Schema:
        n = len(typids)
        if n > MAX_FIELDS:
            raise EngineError("too many fields in a schema")
        for what, given in (("type parameters", typparams), ("isnullable values", nullable), ("field names", names)):
            if given and len(given) != n:
                raise EngineError(f"different number of {what} than the number of type IDs")
        for oid in typids:
            if oid not in BY_OID:
                raise EngineError(f"type {oid} not found")
        out = cls(tuple(Field(BY_OID[t], (typparams or [0] * n)[i], (nullable or [True] * n)[i], (names or [""] * n)[i]) for i, t in enumerate(typids)))
        for f in out.fields:
            f.length  # noqa: B018  a CHAR may be too long
        return out

    def __len__(self) -> int:
        return len(self.fields)

    def field(self, name: str) -> int:
        """The position of the first field of exactly this name, or NO_FIELD."""
        return next((i for i, f in enumerate(self.fields) if f.name == name), NO_FIELD)

    def column_names(self) -> list[str]:
        return [f.name or f"col_{i}" for i, f in enumerate(self.fields)]

    def to_struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, f.type.spark, f.nullable, {"typid": f.type.oid, "typparam": f.typparam}) for n, f in zip(self.column_names(), self.fields, strict=True)])

    @classmethod
    def of(cls, struct: T.StructType) -> Schema:
        """From a StructType that to_struct() made."""
        return cls(tuple(Field(BY_OID[f.metadata["typid"]], f.metadata["typparam"], f.nullable, f.name) for f in struct.fields))

    def encode(self, df: DataFrame) -> DataFrame:
        """df's columns, by position, as a table of this schema: NULLs and lengths are checked when the rows are made."""
        if len(df.columns) != len(self):
            raise EngineError(f"{len(df.columns)} values for {len(self)} fields")
        plain = df.toDF(*(f"c{i}" for i in range(len(self))))
        out = []
        for i, (f, name) in enumerate(zip(self.fields, self.column_names(), strict=True)):
            x = F.col(f"c{i}").cast(f.type.spark)
            if f.type in (CHAR, VARCHAR) and f.typparam:
                x = fitted(x, f.typparam, f.type is CHAR)
            elif f.type.spark == T.StringType():
                x = F.when(F.octet_length(x) > MAX_BYTES, fail("a string is longer than a record holds").cast("string")).otherwise(x)
            if not f.nullable:
                x = F.coalesce(x, fail("NULL in field ", F.lit(str(i)), ", which allows none").cast(f.type.spark))
            out.append(x.alias(name, metadata={"typid": f.type.oid, "typparam": f.typparam}))
        return plain.select(*out)

    def rows(self, spark: SparkSession, values: Iterable[tuple]) -> DataFrame:
        """A table of these literal rows."""
        loose = T.StructType([T.StructField(f"c{i}", f.type.spark, True) for i, f in enumerate(self.fields)])
        return self.encode(spark.createDataFrame(list(values), loose))


def project(df: DataFrame, field: int) -> DataFrame:
    """The field at a position, with its NULLs."""
    if not 0 <= field < len(df.columns):
        raise EngineError(f"field {field} is out of bound [0, {len(df.columns)})")
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(F.col(f"c{field}").alias(df.columns[field]))


def is_null(df: DataFrame, field: int) -> Column:
    return df[df.columns[field]].isNull()

"""The fifteen SQL types and the Spark types that store them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

INVALID_OID = 0
NAME_LEN = 62


class TypeSpec(NamedTuple):
    oid: int
    name: str
    length: int  #: bytes; -1 if variable, 0 if the type parameter gives it
    align: int
    by_ref: bool
    spark: T.DataType

    @property
    def is_varlen(self) -> bool:
        return self.length < 0

    @property
    def bits(self) -> int:
        return 8 * self.length

    @property
    def is_int(self) -> bool:
        return self.name.startswith(("INT", "UINT"))

    @property
    def is_signed(self) -> bool:
        return self.name.startswith("INT")

    @property
    def limits(self) -> tuple[int, int]:
        """The least and greatest value of an integer type (or OID)."""
        return (-(1 << self.bits - 1), (1 << self.bits - 1) - 1) if self.is_signed else (0, (1 << self.bits) - 1)


# Object ids, names, lengths and alignments of the types. Spark has no unsigned types, so these get the next wider one.
OID = TypeSpec(100, "OID", 4, 4, False, T.LongType())
BOOL = TypeSpec(101, "BOOL", 1, 1, False, T.BooleanType())
INT1 = TypeSpec(102, "INT1", 1, 1, False, T.ByteType())
INT2 = TypeSpec(103, "INT2", 2, 2, False, T.ShortType())
INT4 = TypeSpec(104, "INT4", 4, 4, False, T.IntegerType())
INT8 = TypeSpec(105, "INT8", 8, 8, False, T.LongType())
UINT1 = TypeSpec(106, "UINT1", 1, 1, False, T.ShortType())
UINT2 = TypeSpec(107, "UINT2", 2, 2, False, T.IntegerType())
UINT4 = TypeSpec(108, "UINT4", 4, 4, False, T.LongType())
UINT8 = TypeSpec(109, "UINT8", 8, 8, False, T.DecimalType(20, 0))
CHAR = TypeSpec(110, "CHAR", 0, 1, True, T.StringType())
VARCHAR = TypeSpec(111, "VARCHAR", -1, 1, True, T.StringType())
STRING = TypeSpec(112, "__STRING", -1, 1, True, T.StringType())
FLOAT = TypeSpec(113, "FLOAT", 4, 4, False, T.FloatType())
DOUBLE = TypeSpec(114, "DOUBLE", 8, 8, False, T.DoubleType())

TYPES = (OID, BOOL, INT1, INT2, INT4, INT8, UINT1, UINT2, UINT4, UINT8, CHAR, VARCHAR, STRING, FLOAT, DOUBLE)
SIGNED, UNSIGNED = (INT1, INT2, INT4, INT8), (UINT1, UINT2, UINT4, UINT8)
BY_OID = {t.oid: t for t in TYPES}
BY_NAME = {t.name: t for t in TYPES}

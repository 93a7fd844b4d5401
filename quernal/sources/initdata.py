"""The init.dat text format: a line "table id (type parameter)*", then its rows as lines "data value*".

Tokens are separated by single spaces; strings stand in double quotes, with \\\\ and \\" as the only escapes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal, InvalidOperation
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from quernal.errors import EngineError
from quernal.plans.schema import Schema
from quernal.types import BOOL, CHAR, STRING, VARCHAR, TypeSpec

#: The longest token.
TOKEN_BYTES = 4096


class Line(NamedTuple):
    kind: str  #: "table" or "data"
    table: int
    schema: Schema
    values: tuple


def tokens(line: str) -> Iterator[str]:
    """The tokens of a line; an error for a bad quote, escape or length."""
    i, n = 0, len(line)
    while i < n:
        if line[i] == '"':
            out, i = [], i + 1
            while i < n and line[i] != '"':
                if line[i] == "\\":
                    if i + 1 >= n or line[i + 1] not in '\\"':
                        raise EngineError("bad escape in a quoted string")
                    i += 1
                out.append(line[i])
                i += 1
            if i >= n:
                raise EngineError("quoted string without an end")
            if i + 1 < n and line[i + 1] != " ":
                raise EngineError("a quoted string must end at a space")
            token, i = "".join(out), i + 2
        else:
            end = line.find(" ", i + 1)
            end = n if end < 0 else end
            token, i = line[i:end], end + 1
        if len(token.encode()) > TOKEN_BYTES:
            raise EngineError("a token is longer than a line may hold")
        yield token


def value_of(text: str, t: TypeSpec, typparam: int):
    """A token as a value of a type, by the rules of its input function."""
    bad = EngineError(f'cannot parse "{text}" as a {t.name}')
    if t is BOOL:
        low = text.lower()
        if low not in ("true", "t", "yes", "y", "1", "false", "f", "no", "n", "0"):
            raise bad
        return low in ("true", "t", "yes", "y", "1")
    if t.is_int or t.name == "OID":
        digits = text.strip(" \t\n\x0b\f\r")
        if not digits.lstrip("+-" if t.is_signed else "+").isdecimal() or not digits.isascii():
            raise bad
        n = int(digits)
        if not t.limits[0] <= n <= t.limits[1]:
            raise bad
        return Decimal(n) if t.name == "UINT8" else n
    if t in (CHAR, VARCHAR):
        raw = text.encode()
        while len(raw) > typparam and raw.endswith(b" "):
            raw = raw[:-1]
        if len(raw) > typparam:
            raise EngineError(f"a string of {len(raw)} bytes, {typparam} fit")
        return raw.decode() + " " * (typparam - len(raw) if t is CHAR else 0)
    if t is STRING:
        raise EngineError("__STRING has no input function")
    try:
        return float(Decimal(text.strip())) if text.strip().lower().lstrip("+-") not in ("inf", "infinity", "nan") else float(text)
    except InvalidOperation:
        raise bad from None


def read_lines(lines: Iterable[str]) -> Iterator[Line]:
    """All lines of a file; line numbers in errors count from 1."""
    table, schema = 0, None
    lines = [x.rstrip("\n") for x in lines]
    while lines and lines[-1] == "":
        lines.pop()
    for no, line in enumerate(lines, 1):
        try:
            if not line:
                raise EngineError("empty line")
            kind, *rest = tokens(line)
            if kind == "table":
                if not rest or len(rest) % 2 == 0 or not all(x.isdecimal() for x in rest):
                    raise EngineError("bad table line")
                table, schema = int(rest[0]), Schema.create([int(x) for x in rest[1::2]], [int(x) for x in rest[2::2]], [False] * (len(rest) // 2))
                yield Line("table", table, schema, ())
            elif kind == "data":
                if schema is None:
                    raise EngineError("data before any table")
                if len(rest) != len(schema):
                    raise EngineError(f"{len(rest)} values for {len(schema)} fields")
                yield Line("data", table, schema, tuple(value_of(x, f.type, f.typparam) for x, f in zip(rest, schema.fields, strict=True)))
            else:
                raise EngineError(f"unknown keyword {kind}")
        except EngineError as e:
            raise EngineError(f"line {no}: {e}") from e


def load(spark: SparkSession, path: str) -> dict[int, DataFrame]:
    """One DataFrame per table of a file, by table id. The file is read by Spark, so any of its file systems will do."""
    text = [r.value for r in spark.read.text(path, wholetext=True).collect()]  # the catalog's start, a few hundred lines
    found: dict[int, tuple[Schema, list[tuple]]] = {}
    for x in read_lines("".join(text).split("\n")):
        found.setdefault(x.table, (x.schema, []))
        if x.kind == "data":
            found[x.table][1].append(x.values)
    return {t: schema.rows(spark, rows) for t, (schema, rows) in found.items()}


def _written(v, t: TypeSpec) -> str:
    if t is BOOL:
        return "t" if v else "f"
    if t in (CHAR, VARCHAR, STRING):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return str(v)


def dump(tables: Iterable[tuple[int, Schema, Iterable[tuple]]]) -> str:
    """The text for tables given as (id, schema, rows)."""
    out = []
    for oid, schema, rows in tables:
        out.append(" ".join(["table", str(oid), *(f"{f.type.oid} {f.typparam}" for f in schema.fields)]))
        out += [" ".join(["data", *(_written(v, f.type) for v, f in zip(r, schema.fields, strict=True))]) for r in rows]
    return "\n".join(out) + "\n"

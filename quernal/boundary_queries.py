"""Queries on values where types end: overflow, signs, NaN and infinities; catalog rows and an init file that are written down here.

No table of the driver holds such values, so operands are literal rows, and the SQL computes on the same in 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal import registry
from quernal.plans import scan
from quernal.plans.catalog import Catalog
from quernal.plans.schema import Schema
from quernal.sources import initdata
from quernal.types import BY_NAME, TypeSpec

Query = Callable[[SparkSession, str], DataFrame]

INTEGERS = [BY_NAME[f"{sign}INT{size}"] for sign in ("", "U") for size in (1, 2, 4, 8)]


def boundary_values(t: TypeSpec) -> list[int]:
    low, high = t.limits
    middle = [-1, 0, 1, 2, 3] if t.is_signed else [1, 2, 3, high // 2, high // 2 + 1]
    return [low, low + 1, *middle, high - 1, high] if t.is_signed else [low, *middle, high - 1, high]


def _pairs(t: TypeSpec) -> list[tuple[int, int, int]]:
    values = boundary_values(t)
    return [(k, a, b) for k, (a, b) in enumerate((a, b) for a in values for b in values)]


def _wide(t: TypeSpec):
    return "decimal(20,0)" if t.name == "UINT8" else "bigint"


def integer_query(t: TypeSpec) -> Query:
    """Every arithmetic, bit and comparison operator on all pairs of boundary values; MIN / -1, which 4 and 8 bytes refuse, is left out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cell = Decimal if t.name == "UINT8" else int
        rows = spark.createDataFrame([(k, cell(a), cell(b)) for k, a, b in _pairs(t)], f"k int, a {_wide(t)}, b {_wide(t)}")
        a, b = F.col("a").cast(t.spark), F.col("b").cast(t.spark)
        call = lambda name, *args: registry.BY_NAME[f"{t.name}_{name}"](*args)
        other = F.when(~((F.col("b") == 0) | ((F.col("b") == -1) & (F.col("a") == F.lit(str(t.limits[0])).cast(_wide(t))))), b)
        nonzero = F.when(F.col("b") != 0, b)
        out = {n: call(n, a, b) for n in ("add", "sub", "mul", "and", "or", "xor")} | {n: call(n, a) for n in ("not",) + (("neg",) if f"{t.name}_neg" in registry.BY_NAME else ())}
        out |= {"div": call("div", a, other), "mod": call("mod", a, nonzero)}
        less = {n: call(n, a, b) for n in ("lt", "ge", "eq")}
        return rows.select("k", *(c.cast(_wide(t)).alias(f"r_{n}") for n, c in out.items()), *(c.alias(f"r_{n}") for n, c in less.items()))

    return run


def integer_sql(t: TypeSpec) -> str:
    m, low = 1 << t.bits, t.limits[0]
    cast = "DECIMAL(20,0)" if t.name == "UINT8" else "BIGINT"
    big = "UHUGEINT" if t.name == "UINT8" else "HUGEINT"
    rows = ", ".join(f"({k}, '{a}'::{big}, '{b}'::{big})" for k, a, b in _pairs(t))
    # Unsigned 128 bits have no room below 0, so differences and signs are taken from 2^64.
    up = lambda x: f"CAST((({x}) % '{m}'::{big}) AS {cast})"
    wrap = (lambda x: f"CAST((((({x}) - ({low})) % {m} + {m}) % {m} + ({low})) AS {cast})") if t.is_signed else up
    minus = "a - b" if t.is_signed else f"a + '{m}'::{big} - b"
    said = {"add": wrap("a + b"), "sub": wrap(minus), "mul": wrap("a * b"), "not": wrap("-1 - a" if t.is_signed else f"'{m - 1}'::{big} - a")}
    if f"{t.name}_neg" in registry.BY_NAME:
        said["neg"] = wrap("0 - a" if t.is_signed else f"'{m}'::{big} - a")
    bit = {"and": "a & b", "or": "a | b", "xor": "xor(a, b)"}
    said |= {n: f"CAST({x} AS {cast})" for n, x in bit.items()}
    # Division and remainder go towards zero.
    said["div"] = f"CAST(CASE WHEN b = 0{f' OR (b = -1 AND a = {low})' if t.is_signed else ''} THEN NULL ELSE a // b END AS {cast})"
    said["mod"] = f"CAST(CASE WHEN b = 0 THEN NULL{' WHEN b = -1 THEN 0' if t.is_signed else ''} ELSE a % b END AS {cast})"
    said |= {"lt": "a < b", "ge": "a >= b", "eq": "a = b"}
    return f"SELECT k, {', '.join(f'{x} AS r_{n}' for n, x in said.items())} FROM (VALUES {rows}) AS v(k, a, b)"


#: NaN, infinities, both zeros, a number and NULL.
SPECIAL = ["nan", "inf", "-inf", "0", "-0", "1.5", "-2", None]
COMPARISONS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def _special_pairs() -> list[tuple[int, str | None, str | None]]:
    return [(k, a, b) for k, (a, b) in enumerate((a, b) for a in SPECIAL for b in SPECIAL)]


def float_query(t: TypeSpec) -> Query:
    """Comparisons, sums, products and quotients of special values."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(k, *(None if x is None else float(x) for x in ab)) for k, *ab in _special_pairs()], "k int, a double, b double")
        a, b = F.col("a").cast(t.spark), F.col("b").cast(t.spark)
        call = lambda name: registry.BY_NAME[f"{t.name}_{name}"](a, b)
        # Whether a result is a number, NaN or infinite, and its value; all zeros are one.
        kind = lambda x: F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(x.isNotNull(), (x + F.lit(0.0)).cast("decimal(9,3)").cast("string"))
        return rows.select("k", *(call(n).alias(f"r_{n}") for n in COMPARISONS), *(kind(call(n).cast("double")).alias(f"r_{n}") for n in ("add", "sub", "mul", "div")))

    return run


def float_sql() -> str:
    cell = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"CAST('{x}' AS DOUBLE)"
    rows = ", ".join(f"({k}, {cell(a)}, {cell(b)})" for k, a, b in _special_pairs())
    # SQL's NaN equals itself and is above all; here it is unequal to everything.
    compare = {n: f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN isnan(a) OR isnan(b) THEN {str(n == 'ne').lower()} ELSE a {s} b END" for n, s in COMPARISONS.items()}
    negative = "(a < 0) <> (CAST(b AS VARCHAR) LIKE '-%')"
    quotient = f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN isnan(a) OR isnan(b) THEN 'nan'::DOUBLE WHEN b = 0 THEN CASE WHEN a = 0 THEN 'nan'::DOUBLE WHEN {negative} THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END ELSE a / b END"
    kind = lambda x: f"CASE WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END WHEN ({x}) IS NOT NULL THEN CAST(CAST(({x}) + 0 AS DECIMAL(9,3)) AS VARCHAR) END"
    value = {n: kind(f"({x})") for n, x in (("add", "a + b"), ("sub", "a - b"), ("mul", "a * b"), ("div", quotient))}
    return f"SELECT k, {', '.join(f'{x} AS r_{n}' for n, x in (compare | value).items())} FROM (VALUES {rows}) AS v(k, a, b)"


# An init file's lines, and what they say.
INIT_LINES = [
    "table 1 100 0 101 0 101 0 103 0 108 0 111 62",
    'data 1 t t 6 0 "Table"',
    'data 20000 f t 2 9 "has \\"quote\\" and \\\\"',
]
INIT_ROWS = [(1, True, True, 6, 0, "Table"), (20000, False, True, 2, 9, 'has "quote" and \\')]
# Rows of each system table, and some functions' ids, numbers of arguments and operators' codes.
COUNTS = {"Table": 8, "Type": 15, "Column": 48, "Function": 240, "FunctionArgs": 429, "Operator": 197, "Index": 15, "IndexColumn": 20}
KNOWN = {
    "BOOL_not": (772, 1), "OID_eq": (742, 2), "INT4_add": (562, 2), "INT8_lsh": (608, 2), "UINT4_add": (682, 2), "UINT8_mul": (714, 2),
    "UINT8_lsh": (728, 2), "DOUBLE_div": (835, 2), "CHAR_eq": (894, 2), "CHAR_eq_ci": (900, 2), "VARCHAR_concat": (864, 2), "VARCHAR_eq": (865, 2),
    "VARCHAR_eq_ci": (873, 2),
}
TABLE_COLUMNS = [("tabid", 0), ("tabissys", 1), ("tabisvarlen", 2), ("tabncols", 3), ("tabfid", 4), ("tabname", 5)]


def init_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the init reader makes of its lines, as a table of the schema that the file gives."""
    lines = list(initdata.read_lines(INIT_LINES))
    schema: Schema = lines[-1].schema
    rows = schema.rows(spark, [tuple(x.values) for x in lines if x.kind == "data"])
    names = ("tabid", "tabissys", "tabisvarlen", "tabncols", "tabfid", "tabname")
    return rows.toDF(*names).select(*(F.col(n).cast("bigint").alias(n) if n in ("tabid", "tabncols", "tabfid") else F.col(n) for n in names))


def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, out = Catalog(spark), None
    for name in COUNTS:
        one = c.df(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def known_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions found by name in the catalog, with their arguments counted."""
    c = Catalog(spark)
    ids = [c.find_function_by_name(n.upper()) for n in KNOWN]
    functions = scan.search(c.df("Function"), []).where(F.col("funcid").isin(ids))
    counted = functions.join(c.df("FunctionArgs"), "funcid").groupBy("funcname", "funcid").count()
    return counted.select("funcname", F.col("funcid").cast("bigint").alias("funcid"), F.col("count").alias("n_args"))


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the table of tables, through its descriptor, in order."""
    desc = Catalog(spark).find_table_desc(1)
    return scan.ordered(spark.createDataFrame([(c["colname"], c["colid"]) for c in desc.columns], "name string, place bigint"), "place")


def typed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by rank of a CHAR key that differs in trailing blanks only for some."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    schema = Schema.create([BY_NAME["INT4"].oid, BY_NAME["CHAR"].oid], [0, 30], [True, True], ["k", "name"])
    encoded = schema.encode(rows.select(F.col("n_nationkey").cast("int"), F.concat("n_name", F.repeat(F.lit(" "), F.col("n_nationkey").cast("int") % 3))))
    return scan.ordered(encoded, "name", "k").limit(10).select(F.col("k").cast("bigint").alias("k"), F.rtrim("name").alias("name"))


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


CASES: dict[str, tuple[Query, str]] = {f"{t.name.lower()}_boundaries": (integer_query(t), integer_sql(t)) for t in INTEGERS}
CASES |= {f"{n.lower()}_special_values": (float_query(BY_NAME[n]), float_sql()) for n in ("FLOAT", "DOUBLE")}
CASES |= {
    "init_file": (init_file, _values(INIT_ROWS, "tabid, tabissys, tabisvarlen, tabncols, tabfid, tabname")),
    "catalog_counts": (catalog_counts, _values(list(COUNTS.items()), "name, n_rows")),
    "known_functions": (known_functions, _values([(n, *x) for n, x in KNOWN.items()], "funcname, funcid, n_args")),
    "table_columns": (table_columns, _values(TABLE_COLUMNS, "name, place")),
    "typed_sort": (typed_sort, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation ORDER BY n_name, n_nationkey LIMIT 10"),
}

QUERIES = {k: q for k, (q, _) in CASES.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in CASES.items()}

"""Queries over the driver's tables: one per built-in function, and those of scans, searches and the catalog, each with its SQL.

Function queries compute typed operands from part or customer in the same way on both sides, with NULLs in every fifth
row, and return the row's key and the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import quernal.functions  # noqa: F401
from quernal import registry
from quernal.plans import scan
from quernal.plans.catalog import FIRST_INDEX_OID, Catalog, bootstrap_rows, by_name, columns_of
from quernal.plans.expressions import Expr, literal
from quernal.plans.schema import project
from quernal.registry import Function
from quernal.types import BOOL, BY_NAME, CHAR, DOUBLE, FLOAT, STRING, TypeSpec

Query = Callable[[SparkSession, str], DataFrame]

CHAR_LEN, VARCHAR_LEN = 12, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- operands: Spark SQL text that DuckDB reads alike


def _operands(f: Function) -> tuple[str, str, list[str]]:
    """(table, key, operand per argument) as SQL of both engines, before the cast to the type."""
    if f.name.startswith(("FLOAT", "DOUBLE")):
        a = "c_acctbal" if f.args[0] is not STRING else "concat(CAST(c_custkey AS STRING), '.25')"
        return "customer", "c_custkey", [a, "c_custkey % 9 - 4"]
    kind = f.name.split("_")[0]
    if f.args[0] is STRING:
        text = {"BOOL": "CASE WHEN p_size > 25 THEN 'yes' ELSE 'F' END", "CHAR": "concat(p_brand, '   ')", "VARCHAR": "p_name"}
        number = "p_size - 25" if BY_NAME[kind].is_int and BY_NAME[kind].is_signed else "p_size"
        return "part", "p_partkey", [text.get(kind, f"concat(' ', CAST({number} AS STRING))")]
    if f.name == "CHAR_typlen":
        return "part", "p_partkey", ["p_size"]
    if kind == "BOOL":
        return "part", "p_partkey", ["p_size > 25", "p_partkey % 3 = 0"]
    if kind == "OID":
        return "part", "p_partkey", ["p_partkey", "p_size"]
    if kind == "CHAR":
        a = "upper(p_brand)" if f.name.endswith("_ci") else "rpad(p_brand, 12, ' ')"
        return "part", "p_partkey", [a, "'Brand#13'" if not f.name.endswith("_ci") else "rpad(p_brand, 12, ' ')"]
    if kind == "VARCHAR":
        return "part", "p_partkey", ["upper(p_name)" if f.name.endswith("_ci") else "p_name", "p_name" if f.name.endswith("_ci") else "p_type"]
    signed = f.args[0].is_signed
    if f.name.endswith(("_lsh", "_rsh")):
        return "part", "p_partkey", ["p_size - 25" if signed else "p_size", "p_partkey % 5"]
    if signed:
        return "part", "p_partkey", ["p_size - 25", "p_partkey % 7 - 3"] if kind == "INT1" else ["p_partkey % 1000 - 500", "p_size - 25"]
    return "part", "p_partkey", ["p_size", "p_partkey % 5"]


def _sql_of(f: Function) -> tuple[list[str], str, str]:
    key = _operands(f)[1]
    table_name, _, given = _operands(f)
    given = given[: len(f.args)]
    if f.name.endswith(("_div", "_mod")) and f.args[0].is_int:
        given[1] = f"NULLIF({given[1]}, 0)"
    nulls = [] if f.name == "CHAR_typlen" else [5, 3]
    return [f"CASE WHEN {key} % {nulls[i]} = 0 THEN NULL ELSE {x} END" if nulls else x for i, x in enumerate(given)], table_name, key


def _typparam(f: Function) -> int:
    return {"CHAR_in": CHAR_LEN, "VARCHAR_in": VARCHAR_LEN, "VARCHAR_to_CHAR": 8, "CHAR_to_VARCHAR": 6}.get(f.name, 0)


def _plain(t: TypeSpec, x: Column) -> Column:
    """Results in types that both engines have."""
    return x.cast("decimal(20,0)") if t.name == "UINT8" else x.cast("bigint") if t.is_int or t.name == "OID" else x.cast("double") if t is FLOAT else x


def function_query(f: Function) -> Query:
    operands, table_name, key = _sql_of(f)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, table_name)
        args = [F.expr(x).cast(t.spark) for x, t in zip(operands, f.args, strict=True)]
        return rows.select(key, _plain(f.returns, f(*args, typparam=_typparam(f))).alias("result"))

    return run


# -- oracle side

_NATIVE = {"FLOAT": "FLOAT", "DOUBLE": "DOUBLE", "BOOL": "BOOLEAN"}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIGN = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def _wrap_sql(t: TypeSpec, x: str) -> str:
    m, h = 1 << t.bits, 1 << t.bits - 1 if t.is_signed else 0
    return f"((({x} + {h}) % {m} + {m}) % {m} - {h})" if h else f"(({x} % {m} + {m}) % {m})"


def _result_sql(f: Function, a: str, b: str) -> str:
    t, name = f.args[0], f.name.split("_", 1)[1]
    if f.name.endswith("_in"):
        return {"BOOL": f"CAST({a} AS BOOLEAN)", "FLOAT": f"CAST(CAST({a} AS FLOAT) AS DOUBLE)", "DOUBLE": f"CAST({a} AS DOUBLE)", "CHAR": f"rpad(rtrim({a}, ' '), {CHAR_LEN}, ' ')", "VARCHAR": a}.get(f.returns.name, f"CAST(trim({a}) AS HUGEINT)")
    if f.name.endswith("_out"):
        return f"printf('%g', CAST({a} AS DOUBLE))" if t in (FLOAT, DOUBLE) else f"CAST({a} AS VARCHAR)" if t is not BOOL else f"CASE WHEN {a} THEN 'true' WHEN NOT {a} THEN 'false' END"
    ci = name.endswith("_ci")
    op = name.removesuffix("_ci").removeprefix("__STRING_")
    if op in _SIGN:
        fix = (lambda x: f"rtrim({x}, ' ')") if t is CHAR else (lambda x: x)
        low = _LOWER.format if ci else (lambda x: x)
        return f"{low(fix(a))} {_SIGN[op]} {low(fix(b))}"
    special = {
        "CHAR_typlen": a, "CHAR_to_VARCHAR": f"substr(rtrim({a}, ' '), 1, 6)", "VARCHAR_to_CHAR": f"rpad(substr({a}, 1, 8), 8, ' ')", "VARCHAR_length": f"strlen({a})", "VARCHAR_concat": f"({a} || {b})",
        "BOOL_not": f"NOT {a}", "BOOL_or": f"({a} OR {b})", "BOOL_and": f"({a} AND {b})",
    }
    if f.name in special:
        return special[f.name]
    if t in (FLOAT, DOUBLE):
        n = _NATIVE[t.name]
        x, y = f"CAST({a} AS {n})", f"CAST({b} AS {n})"
        by_zero = f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN CAST('nan' AS DOUBLE) WHEN {x} < 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END"
        return {"add": f"CAST({x} + {y} AS DOUBLE)", "sub": f"CAST({x} - {y} AS DOUBLE)", "mul": f"CAST({x} * {y} AS DOUBLE)", "div": f"CASE WHEN {y} = 0 THEN {by_zero} ELSE CAST({x} / {y} AS DOUBLE) END", "neg": f"CAST(-{x} AS DOUBLE)"}[op]
    x, y = f"CAST({a} AS HUGEINT)", f"CAST({b} AS HUGEINT)"
    p = f"(CASE {b} WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 16 END)"
    bits = {"and": f"CAST({a} AS BIGINT) & CAST({b} AS BIGINT)", "or": f"CAST({a} AS BIGINT) | CAST({b} AS BIGINT)", "xor": f"xor(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"}
    arithmetic = {"add": f"{x} + {y}", "sub": f"{x} - {y}", "mul": f"{x} * {y}", "neg": f"(-{x})", "not": f"(-1 - {x})", "lsh": f"{x} * {p}"}
    if op in arithmetic:
        return _wrap_sql(t, f"({arithmetic[op]})")
    if op in bits:
        return bits[op]
    return {"div": f"{x} // {y}", "mod": f"{x} % {y}", "rsh": f"({x} - (({x} % {p}) + {p}) % {p}) // {p}"}[op]


def function_sql(f: Function) -> str:
    operands, table_name, key = _sql_of(f)
    text = [x.replace("AS STRING", "AS VARCHAR") for x in operands]
    native = lambda x, t: f"CAST({x} AS {_NATIVE[t.name]})" if t.name in _NATIVE and f.args[0] is not STRING else x
    text = [native(x, t) for x, t in zip(text, f.args, strict=True)]
    result = _result_sql(f, "a", "b")
    cast = "DECIMAL(20,0)" if f.returns.name == "UINT8" else "BIGINT" if f.returns.is_int or f.returns.name == "OID" else None
    inner = ", ".join(f"{x} AS {n}" for x, n in zip(text, "ab", strict=False))
    return f"SELECT {key}, {f'CAST({result} AS {cast})' if cast else result} AS result FROM (SELECT {key}, {inner} FROM {table_name})"


# -- scans, searches, catalog


def values_sql(table_name: str) -> str:
    """A system table as a VALUES list."""
    rows = bootstrap_rows()[table_name]
    cell = lambda v: "'" + v + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    names = [c for c, _ in columns_of(table_name)]
    return f"(VALUES {', '.join('(' + ', '.join(cell(r[c]) for c in names) + ')' for r in rows)}) AS t_{table_name.lower()}({', '.join(names)})"


def _ids(df: DataFrame, *columns: str) -> DataFrame:
    """System-table columns in types that both engines have."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if not isinstance(df.schema[c].dataType, (type(STRING.spark), type(BOOL.spark))) else F.col(c) for c in columns))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed scan of lineitem: quantity < 24 selects, price * discount is projected, both through resolved operators."""
    rows = table(spark, sf_dir, "lineitem")
    col = lambda c: Expr(F.col(c), DOUBLE)
    keep = (col("l_quantity") < literal(24.0, DOUBLE)).column & (col("l_discount") >= literal(0.05, DOUBLE)).column
    return rows.where(keep).select("l_orderkey", "l_linenumber", (col("l_extendedprice") * col("l_discount")).column.alias("revenue"))


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark)


def _eq(column: str, value, kind: TypeSpec) -> scan.Predicate:
    return scan.Predicate(column, f"{kind.name}_eq", literal(value, kind).column)


INT4, INT8 = BY_NAME["INT4"], BY_NAME["INT8"]

SCANS: dict[str, tuple[Query, str]] = {
    "typed_scan": (flagship, "SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS revenue FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05"),
    "scan_all": (lambda s, d: table(s, d, "part"), "SELECT * FROM part"),
    "scan_from_rid": (lambda s, d: scan.scan_from(scan.with_rid(_nation(s, d)), scan.RecordId(0, 11)).select("n_nationkey", F.col("rid.sid").alias("sid")), "SELECT n_nationkey, CAST(n_nationkey + 1 AS BIGINT) AS sid FROM nation WHERE n_nationkey >= 10"),
    "fetch_rid": (lambda s, d: scan.fetch(scan.with_rid(_nation(s, d)), scan.RecordId(0, 3)).drop("rid"), "SELECT * FROM nation WHERE n_nationkey = 2"),
    "search_eq1": (lambda s, d: scan.search(table(s, d, "part"), [_eq("p_size", 7, INT4)]), "SELECT * FROM part WHERE p_size = 7"),
    "search_eq2": (lambda s, d: scan.search(table(s, d, "lineitem"), [_eq("l_linenumber", 1, INT4), scan.Predicate("l_returnflag", "VARCHAR_eq", F.lit("R"))]).select("l_orderkey", "l_linenumber", "l_returnflag"), "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'"),
    "search_eq3": (lambda s, d: scan.search(table(s, d, "lineitem"), [_eq("l_linenumber", 1, INT4), scan.Predicate("l_returnflag", "VARCHAR_eq", F.lit("A")), scan.Predicate("l_linestatus", "CHAR_eq", F.lit("F  "))]).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A' AND l_linestatus = 'F'"),
    "search_first": (lambda s, d: scan.search(table(s, d, "part"), [_eq("p_size", 7, INT4)], unique=True, order="p_partkey"), "SELECT * FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 1"),
    "search_limit_n": (lambda s, d: scan.search(table(s, d, "part"), [_eq("p_size", 7, INT4)], n=5, order="p_partkey"), "SELECT * FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 5"),
    "search_name_ci": (lambda s, d: _nation(s, d).where(by_name("n_name", "NATION_3")), "SELECT * FROM nation WHERE lower(n_name) = 'nation_3'"),
    "search_by_oid": (lambda s, d: scan.search(table(s, d, "customer"), [scan.Predicate("c_custkey", "OID_eq", F.lit(42))], unique=True, order="c_custkey"), "SELECT * FROM customer WHERE c_custkey = 42"),
    "project_field": (lambda s, d: project(table(s, d, "customer"), 1), "SELECT c_name FROM customer"),
    "is_null": (lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).isNull().alias("missing")), "SELECT p_partkey, p_partkey % 5 = 0 AS missing FROM part"),
    "sort_by_id": (lambda s, d: table(s, d, "part").orderBy("p_partkey").select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part ORDER BY p_partkey"),
    "update_row": (lambda s, d: scan.update(_nation(s, d), [_eq("n_nationkey", 3, INT4)], {"n_name": F.lit("changed")}), "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "append_rows": (lambda s, d: scan.append(_nation(s, d), _nation(s, d).where("n_nationkey < 3")), "SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey < 3"),
    "rid_order": (lambda s, d: scan.with_rid(_nation(s, d)).where((F.col("rid") > scan.RecordId(0, 5).column()) & (F.col("rid") <= scan.RecordId(0, 9).column())).select("n_nationkey"), "SELECT n_nationkey FROM nation WHERE n_nationkey + 1 > 5 AND n_nationkey + 1 <= 9"),
    "tabledesc_join": (lambda s, d: _ids(_catalog(s).table_desc_df(), "tabid", "tabname", "colid", "colname", "coltypid"), f"SELECT tabid, tabname, colid, colname, coltypid FROM {values_sql('Table')} JOIN {values_sql('Column')} ON tabid = coltabid"),
    "indexdesc_join": (lambda s, d: _ids(_catalog(s).index_desc_df(), "idxid", "idxname", "idxunique", "idxcolid", "idxcoltabcolid", "idxcoleqfuncid", "idxcolltfuncid"), f"SELECT idxid, idxname, idxunique, idxcolid, idxcoltabcolid, idxcoleqfuncid, idxcolltfuncid FROM {values_sql('Index')} JOIN {values_sql('IndexColumn')} ON idxid = idxcolidxid"),
    "function_args_join": (lambda s, d: _ids(_catalog(s).df("Function").join(_catalog(s).df("FunctionArgs"), "funcid").where("funcnargs = 2"), "funcid", "funcname", "funcargid", "funcargtypid"), f"SELECT f.funcid, funcname, funcargid, funcargtypid FROM (SELECT * FROM {values_sql('Function')}) f JOIN (SELECT * FROM {values_sql('FunctionArgs')}) a ON f.funcid = a.funcid WHERE funcnargs = 2"),
    "semi_typids": (lambda s, d: _ids(_catalog(s).df("Type").join(_catalog(s).df("Column"), F.col("typid") == F.col("coltypid"), "left_semi"), "typid", "typname"), f"SELECT typid, typname FROM {values_sql('Type')} WHERE typid IN (SELECT coltypid FROM {values_sql('Column')})"),
    "hash_update_fid": (lambda s, d: _ids(_catalog(s).df("Table").drop("tabfid").join(F.broadcast(s.range(1, 9).select(F.col("id").alias("tabid"), (F.col("id") + 100).alias("tabfid"))), "tabid"), "tabid", "tabname", "tabfid"), f"SELECT tabid, tabname, tabid + 100 AS tabfid FROM {values_sql('Table')}"),
    "group_columns": (lambda s, d: _catalog(s).df("Column").groupBy(F.col("coltabid").cast("bigint").alias("coltabid")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("colid", "colname"))), lambda x: x["colname"]), ",").alias("names")), f"SELECT coltabid, string_agg(colname, ',' ORDER BY colid) AS names FROM {values_sql('Column')} GROUP BY coltabid"),
    "count_columns": (lambda s, d: _ids(_catalog(s).df("Table").join(_catalog(s).df("Column").groupBy("coltabid").count(), F.col("tabid") == F.col("coltabid")).where("tabncols = count"), "tabid", "count"), f"SELECT coltabid AS tabid, count(*) AS count FROM {values_sql('Column')} GROUP BY coltabid"),
    "dup_oid_report": (lambda s, d: _catalog(s).df("Operator").groupBy(F.col("opfuncid").alias("oid")).count().where("count > 1").unionByName(_catalog(s).duplicate_oids_df()), f"SELECT opfuncid AS oid, count(*) AS count FROM {values_sql('Operator')} GROUP BY opfuncid HAVING count(*) > 1"),
    "explode_args": (lambda s, d: _ids(s.createDataFrame([(f.oid, [a.oid for a in f.args]) for f in registry.FUNCTIONS.values()], "funcid bigint, args array<bigint>").select("funcid", F.posexplode("args").alias("funcargid", "funcargtypid")), "funcid", "funcargid", "funcargtypid"), f"SELECT funcid, CAST(funcargid AS BIGINT) AS funcargid, funcargtypid FROM {values_sql('FunctionArgs')}"),
    "assign_index_ids": (lambda s, d: _assigned(s), f"SELECT idxid, idxname FROM {values_sql('Index')}"),
    "find_operator": (lambda s, d: _ids(_catalog(s).df("Operator").where("optype = 3 and oparg0typid = oparg1typid"), "opfuncid", "oparg0typid"), f"SELECT opfuncid, oparg0typid FROM {values_sql('Operator')} WHERE optype = 3 AND oparg0typid = oparg1typid"),
}


def _assigned(spark: SparkSession) -> DataFrame:
    """Index ids by rank of the sort key; the two pinned indexes rank before all others."""
    names = _catalog(spark).df("Index").select("idxname")
    place = F.when(F.col("idxname") == "Index_idxid", 0).when(F.col("idxname") == "IndexColumn_idxcolidxid_idxcolid", 1).otherwise(2)
    return names.withColumn("idxid", (F.row_number().over(Window.orderBy(place, "idxname")) + FIRST_INDEX_OID - 1).cast("bigint"))


QUERIES: dict[str, Query] = {f.name.lower(): function_query(f) for f in registry.FUNCTIONS.values()} | {k: q for k, (q, _) in SCANS.items()}
ORACLE_SQL: dict[str, str] = {f.name.lower(): function_sql(f) for f in registry.FUNCTIONS.values()} | {k: sql for k, (_, sql) in SCANS.items()}

"""The system catalog: eight self-describing tables, lookups, and the definition of user tables and indexes.

Lookups at plan time use driver-side rows (the catalog is small by nature); df() gives any system table as a DataFrame for queries.
"""

from __future__ import annotations

import threading
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import quernal.functions  # noqa: F401
from quernal import operators as ops
from quernal import registry
from quernal.errors import EngineError, EngineFatalError
from quernal.functions.common import lower
from quernal.plans.schema import MAX_FIELDS, Schema
from quernal.types import BOOL, BY_NAME, CHAR, INVALID_OID, NAME_LEN, TYPES, VARCHAR

FIRST_INDEX_OID, FIRST_USER_OID, LAST_OID = 1500, 20000, 0xFFFFFFFF
MAGIC = 0xFE135724427531EF

# The system tables' ids, columns and indexes (key columns, unique).
SYSTEM_TABLES = {
    "Table": (1, "tabid OID, tabissys BOOL, tabisvarlen BOOL, tabncols INT2, tabfid UINT4, tabname VARCHAR", (("tabid",), True), (("tabname",), True)),
    "Type": (2, "typid OID, typlen INT2, typisvarlen BOOL, typbyref BOOL, typalign UINT1, typname VARCHAR, typinfunc OID, typoutfunc OID, typlenfunc OID", (("typid",), True), (("typname",), True)),
    "Column": (3, "coltabid OID, colid INT2, colisarray BOOL, colisnullable BOOL, coltypid OID, coltypparam UINT8, colname VARCHAR", (("coltabid", "colid"), True)),
    "Function": (4, "funcid OID, funcnargs INT2, funcrettypid OID, funcname VARCHAR", (("funcid",), True), (("funcname",), True)),
    "FunctionArgs": (5, "funcid OID, funcargid INT2, funcargtypid OID", (("funcid", "funcargid"), True)),
    "Operator": (6, "optype UINT1, opfuncid OID, oparg0typid OID, oparg1typid OID", (("opfuncid",), True), (("optype", "oparg0typid", "oparg1typid"), True)),
    "Index": (7, "idxid OID, idxtabid OID, idxtyp UINT1, idxunique BOOL, idxncols INT2, idxfid UINT4, idxname VARCHAR", (("idxid",), True), (("idxname",), True), (("idxtabid",), False), (("idxtyp",), False)),
    "IndexColumn": (8, "idxcolidxid OID, idxcolid INT2, idxcoltabcolid INT2, idxcoltypid OID, idxcolisnullable BOOL, idxcoltypparam UINT8, idxcoleqfuncid OID, idxcolltfuncid OID", (("idxcolidxid", "idxcolid"), True)),
}
#: Tables whose rows have an id of their own, and its column.
OWN_IDS = (("Table", "tabid"), ("Type", "typid"), ("Function", "funcid"), ("Index", "idxid"))
#: These two are looked up before any other index, so they come first.
PINNED = (("Index", ("idxid",)), ("IndexColumn", ("idxcolidxid", "idxcolid")))


def columns_of(table: str) -> list[tuple[str, str]]:
    """(name, type) of a system table's columns."""
    return [tuple(x.split()) for x in SYSTEM_TABLES[table][1].split(", ")]


def schema_of(table: str) -> Schema:
    cols = columns_of(table)
    return Schema.create([BY_NAME[t].oid for _, t in cols], [NAME_LEN if t == "VARCHAR" else 0 for _, t in cols], [False] * len(cols), [n for n, _ in cols])


#: What a column of a new table has unless told.
DEFAULTS = {"coltypparam": lambda i: 0, "colname": lambda i: f"col_{i}", "colisnullable": lambda i: True, "colisarray": lambda i: False}


# Index types.
class IndexType(NamedTuple):
    code: int
    name: str
    volatile: bool
    needs_equal: bool
    needs_less: bool


INDEX_TYPES = {1: IndexType(1, "volatile tree", True, True, True), 2: IndexType(2, "b-tree", False, True, True)}


def index_type(code: int) -> IndexType:
    if code not in INDEX_TYPES:
        raise EngineFatalError(f"unknown index type: {code}")
    return INDEX_TYPES[code]


class TableDesc(NamedTuple):
    table: dict
    columns: list[dict]
    schema: Schema


class IndexDesc(NamedTuple):
    index: dict
    columns: list[dict]
    key_schema: Schema


def index_keys() -> list[tuple[str, tuple[str, ...], bool]]:
    """(table, key columns, unique) of the system indexes in the order of their ids."""
    every = [(t, keys, unique) for t, x in SYSTEM_TABLES.items() for keys, unique in x[2:]]
    place = lambda x: (PINNED.index(x[:2]), "") if x[:2] in PINNED else (len(PINNED), "_".join((x[0], *x[1])))
    return sorted(every, key=place)


def bootstrap_rows() -> dict[str, list[dict]]:
    """The rows of all system tables of a new database."""
    out: dict[str, list[dict]] = {t: [] for t in SYSTEM_TABLES}

    def add(table: str, *values) -> None:
        out[table].append(dict(zip((n for n, _ in columns_of(table)), values, strict=True)))

    named = lambda n: registry.BY_NAME[n].oid if n in registry.BY_NAME else INVALID_OID
    for t in TYPES:
        add("Type", t.oid, t.length, t.is_varlen, t.by_ref, t.align, t.name, named(f"{t.name}_in"), named(f"{t.name}_out"), named("CHAR_typlen") if t is CHAR else INVALID_OID)
    for name, (oid, *_) in SYSTEM_TABLES.items():
        cols = columns_of(name)
        add("Table", oid, True, any(BY_NAME[t].is_varlen for _, t in cols), len(cols), oid, name)
        for i, (col, t) in enumerate(cols):
            add("Column", oid, i, False, False, BY_NAME[t].oid, NAME_LEN if t == "VARCHAR" else 0, col)
    for f in sorted(registry.FUNCTIONS.values()):
        add("Function", f.oid, len(f.args), f.returns.oid, f.name)
        for i, a in enumerate(f.args):
            add("FunctionArgs", f.oid, i, a.oid)
    for (op, a, b), oid in sorted(registry.OPERATORS.items()):
        add("Operator", op, oid, a, b)
    for i, (table, keys, unique) in enumerate(index_keys()):
        oid, cols = SYSTEM_TABLES[table][0], columns_of(table)
        add("Index", FIRST_INDEX_OID + i, oid, 0, unique, len(keys), 0, "_".join((table, *keys)))
        for k, key in enumerate(keys):
            at = [n for n, _ in cols].index(key)
            t = BY_NAME[cols[at][1]]
            # Names are compared without regard to case.
            pair = [named(f"VARCHAR_{x}_ci") if t is VARCHAR else registry.OPERATORS[ops.BY_NAME[x.upper()].code, t.oid, t.oid] for x in ("eq", "lt")]
            add("IndexColumn", FIRST_INDEX_OID + i, k, at, t.oid, False, NAME_LEN if t is VARCHAR else 0, *pair)
    return out


def next_free_oid(rows: dict[str, list[dict]]) -> int:
    """The first id for user objects that is above all ids of tables, types, functions and indexes."""
    used = (r[c] for t, c in OWN_IDS for r in rows[t])
    return max(FIRST_USER_OID, 1 + max(used, default=0))


class Catalog:
    def __init__(self, spark: SparkSession, rows: dict[str, list[dict]] | None = None, next_oid: int = FIRST_USER_OID):
        self.spark, self.rows = spark, rows or bootstrap_rows()
        self._next, self._lock = next_oid, threading.Lock()
        self._frames: dict[str, tuple[int, DataFrame]] = {}

    @property
    def meta(self) -> dict[str, int]:
        """What a database keeps beside its rows."""
        return {"magic": MAGIC, "next_oid": self._next}

    # -- system tables as DataFrames

    def df(self, table: str) -> DataFrame:
        if table not in self.rows:
            raise EngineError(f"no system table {table}")
        n = len(self.rows[table])
        if table not in self._frames or self._frames[table][0] != n:
            struct = schema_of(table).to_struct()
            cell = {f.name: (lambda v: Decimal(v)) if isinstance(f.dataType, T.DecimalType) else (lambda v: v) for f in struct}
            self._frames[table] = n, self.spark.createDataFrame([tuple(to(r[c]) for c, to in cell.items()) for r in self.rows[table]], struct)
        return self._frames[table][1]

    def register_views(self) -> None:
        """Temporary views sys_table, sys_type, ... for SQL."""
        for t in self.rows:
            self.df(t).createOrReplaceTempView(f"sys_{t.lower()}")

    # -- lookups

    def _first(self, table: str, **want) -> dict | None:
        return next((r for r in self.rows[table] if all(r[k] == v for k, v in want.items())), None)

    def _named(self, table: str, column: str, name: str) -> dict | None:
        low = _ascii_lower(name)
        return next((r for r in self.rows[table] if _ascii_lower(r[column]) == low), None)

    def find_table(self, oid: int) -> dict | None:
        return self._first("Table", tabid=oid)

    def find_table_by_name(self, name: str) -> int:
        return (self._named("Table", "tabname", name) or {"tabid": INVALID_OID})["tabid"]

    def find_type(self, oid: int) -> dict | None:
        return self._first("Type", typid=oid)

    def find_function(self, oid: int) -> dict | None:
        return self._first("Function", funcid=oid)

    def find_function_by_name(self, name: str) -> int:
        return (self._named("Function", "funcname", name) or {"funcid": INVALID_OID})["funcid"]

    def find_function_args(self, oid: int, arg: int) -> dict | None:
        return self._first("FunctionArgs", funcid=oid, funcargid=arg)

    def find_operator(self, op: int, arg0: int, arg1: int = INVALID_OID) -> int:
        if not (ops.is_unary(op) or ops.is_binary(op)):
            raise EngineError(f"unknown operator type {op}")
        if arg0 == INVALID_OID or (ops.is_binary(op) and arg1 == INVALID_OID):
            raise EngineError(f"missing operand of operator {ops.symbol(op)}")
        if ops.is_unary(op) and arg1 != INVALID_OID:
            raise EngineError(f"operator {ops.symbol(op)} takes one operand")
        return (self._first("Operator", optype=op, oparg0typid=arg0, oparg1typid=arg1) or {"opfuncid": INVALID_OID})["opfuncid"]

    def find_index(self, oid: int) -> dict | None:
        return self._first("Index", idxid=oid)

    def find_index_by_name(self, name: str) -> int:
        return (self._named("Index", "idxname", name) or {"idxid": INVALID_OID})["idxid"]

    def find_all_indexes_of_table(self, oid: int) -> list[int]:
        return [r["idxid"] for r in self.rows["Index"] if r["idxtabid"] == oid]

    def find_columns(self, oid: int) -> list[dict]:
        return sorted((r for r in self.rows["Column"] if r["coltabid"] == oid), key=lambda r: r["colid"])

    def find_table_desc(self, oid: int) -> TableDesc | None:
        table = self.find_table(oid)
        if table is None:
            return None
        cols = self.find_columns(oid)
        if len(cols) != table["tabncols"]:
            raise EngineFatalError(f"table {oid} has {len(cols)} columns, not {table['tabncols']}")
        return TableDesc(table, cols, Schema.create([c["coltypid"] for c in cols], [int(c["coltypparam"]) for c in cols], [c["colisnullable"] for c in cols], [c["colname"] for c in cols]))

    def find_index_desc(self, oid: int) -> IndexDesc | None:
        index = self.find_index(oid)
        if index is None:
            return None
        cols = sorted((r for r in self.rows["IndexColumn"] if r["idxcolidxid"] == oid), key=lambda r: r["idxcolid"])
        if len(cols) != index["idxncols"]:
            raise EngineFatalError(f"index {oid} has {len(cols)} key columns, not {index['idxncols']}")
        return IndexDesc(index, cols, Schema.create([c["idxcoltypid"] for c in cols], [int(c["idxcoltypparam"]) for c in cols], [c["idxcolisnullable"] for c in cols]))

    # -- definitions

    def allocate_oid(self) -> int:
        """The next user id, 0 once there are none."""
        with self._lock:
            if self._next > LAST_OID:
                return INVALID_OID
            self._next += 1
            return self._next - 1

    @property
    def next_oid(self) -> int:
        return self._next

    def insert(self, table: str, rows: list[dict]) -> None:
        """Appends rows, each value within its column's type."""
        for r in rows:
            for f in schema_of(table).fields:
                if (fault := _fault(f, r[f.name])) is not None:
                    raise EngineError(f"{table}.{f.name}: {fault}")
        self.rows[table] += rows

    def _new_oid(self) -> int:
        if (oid := self.allocate_oid()) == INVALID_OID:
            raise EngineError("all object ids are in use")
        return oid

    def add_table(self, name: str, typids: list[int], typparams: list[int] | None = None, names: list[str] | None = None, nullable: list[bool] | None = None, is_array: list[bool] | None = None, fid: int = 1) -> int:
        """Defines a table; what a column is not told it takes from DEFAULTS. The id of the new table."""
        n = len(typids)
        told = {"coltypparam": typparams, "colname": names, "colisnullable": nullable, "colisarray": is_array}
        uneven = [f"{len(x)} of {c}" for c, x in told.items() if x and len(x) != n]
        unknown = [t for t in typids if self.find_type(t) is None]
        _check(f"table {name}", {
            f"has {n} columns, 1 to {MAX_FIELDS} are possible": not 0 < n <= MAX_FIELDS,
            f"has {n} columns but {', '.join(uneven)}": bool(uneven),
            f"has columns of unknown types {unknown}": bool(unknown),
            "has no file": not fid,
            "exists already": self.find_table_by_name(name) != INVALID_OID,
        })
        oid = self._new_oid()
        columns = [
            {"coltabid": oid, "colid": i, "coltypid": t} | {c: told[c][i] if told[c] else default(i) for c, default in DEFAULTS.items()}
            for i, t in enumerate(typids)
        ]
        self.insert("Table", [{"tabid": oid, "tabissys": False, "tabisvarlen": True, "tabncols": n, "tabfid": fid, "tabname": name}])
        self.insert("Column", columns)
        return oid

    def add_index(self, name: str, table: int, kind: int, unique: bool, columns: list[int], fid: int = 0, less: list[int] | None = None, equal: list[int] | None = None) -> int:
        """Defines an index over a table's columns, by default with their types' own comparisons. The id of the new index."""
        desc = self.find_table_desc(table)
        _check("an index", {f"needs a table, and {table} is none": desc is None, f"cannot be of type {kind}": kind not in INDEX_TYPES})
        typ, fields = INDEX_TYPES[kind], desc.schema.fields
        outside = [c for c in columns if not 0 <= c < len(fields)]
        _check(f"a {typ.name} index of table {table}", {
            f"has {len(columns)} keys, {MAX_FIELDS} are possible": len(columns) > MAX_FIELDS,
            f"has keys {outside}, columns are 0 to {len(fields) - 1}": bool(outside),
            "lies in memory, and is given a file": typ.volatile and fid != 0,
            "is given no file": not typ.volatile and not fid,
        })
        name = name or "_".join([desc.table["tabname"], *(fields[c].name for c in columns)])
        _check(f"index {name}", {"exists already": self.find_index_by_name(name) != INVALID_OID})
        at = lambda given, i: given[i] if given and i < len(given) else INVALID_OID
        keys = []
        for i, f in enumerate(fields[c] for c in columns):
            eq, lt = (self._comparison(at(given, i), op, f.type, typ) for given, op in ((equal, "EQ"), (less, "LT")))
            key = {"idxcolid": i, "idxcoltabcolid": columns[i], "idxcoltypid": f.type.oid, "idxcolisnullable": f.nullable}
            keys.append(key | {"idxcoltypparam": f.typparam, "idxcoleqfuncid": eq, "idxcolltfuncid": lt})
        oid = self._new_oid()
        self.insert("Index", [{"idxid": oid, "idxtabid": table, "idxtyp": kind, "idxunique": unique, "idxncols": len(columns), "idxfid": fid, "idxname": name}])
        self.insert("IndexColumn", [{"idxcolidxid": oid} | k for k in keys])
        return oid

    def set_file(self, table: int, fid: int) -> None:
        """Gives a table another file."""
        self.find_table(table)["tabfid"] = fid
        self._frames.pop("Table", None)

    def _comparison(self, oid: int, op: str, t, kind: IndexType) -> int:
        """The id of an index's comparison for a key type: the given one, or the type's operator; checked."""
        sign = ops.BY_NAME[op].symbol
        if oid == INVALID_OID and (kind.needs_equal if op == "EQ" else kind.needs_less):
            oid = self.find_operator(ops.BY_NAME[op].code, t.oid, t.oid)
            if oid == INVALID_OID:
                raise EngineError(f"a {kind.name} index needs {sign} of type {t.oid}, which has none")
        f = self.find_function(oid)
        args = [self.find_function_args(oid, k) for k in (0, 1)]
        if f is None or f["funcnargs"] != 2 or f["funcrettypid"] != BOOL.oid or any(a is None or a["funcargtypid"] != t.oid for a in args):
            raise EngineError(f"{f['funcname'] if f else oid} does not compare two of type {t.oid}, as {sign} must")
        return oid

    def finish_init(self, files: dict[int, int]) -> None:
        """Sets the system tables' file ids; each must have one."""
        for r in self.rows["Table"]:
            if r["tabissys"]:
                if r["tabid"] not in files:
                    raise EngineFatalError(f"table {r['tabid']} has no file")
                r["tabfid"] = files[r["tabid"]]
        self._frames.pop("Table", None)

    # -- the same as queries over DataFrames

    def table_desc_df(self) -> DataFrame:
        """Tables with their columns, in order."""
        return self.df("Table").join(self.df("Column"), F.col("tabid") == F.col("coltabid")).orderBy("tabid", "colid")

    def index_desc_df(self) -> DataFrame:
        return self.df("Index").join(self.df("IndexColumn"), F.col("idxid") == F.col("idxcolidxid")).orderBy("idxid", "idxcolid")

    def duplicate_oids_df(self) -> DataFrame:
        """Ids that occur more than once among tables, types, functions and indexes."""
        ids = [self.df(t).select(F.col(c).alias("oid")) for t, c in OWN_IDS]
        out = ids[0]
        for x in ids[1:]:
            out = out.union(x)
        return out.groupBy("oid").count().where("count > 1")


def _check(what: str, faults: dict[str, bool]) -> None:
    """Raise what is wrong, all of it."""
    if said := [fault for fault, is_so in faults.items() if is_so]:
        raise EngineError(f"{what} {'; '.join(said)}")


def _fault(f, v) -> str | None:
    """What keeps a value from a column of a system table."""
    if v is None:
        return "a value is needed"
    if f.type is VARCHAR and len(v.encode()) > f.typparam:
        return f"{len(v.encode())} bytes, {f.typparam} fit"
    if (f.type.is_int or f.type.name == "OID") and not f.type.limits[0] <= v <= f.type.limits[1]:
        return f"{v} is no {f.type.name}"
    return None


def by_name(column: str, name: str) -> Column:
    """A filter on a name without regard to ASCII case."""
    return lower(F.col(column)) == F.lit(_ascii_lower(name))


def _ascii_lower(x: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in x)

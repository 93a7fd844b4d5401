"""Operators, typed expressions, schemas, scans, catalog, sources."""

import errno
import logging
import os
import stat
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quernal import operators as ops
from quernal import registry
from quernal.engine import Database, dump_rows, load_rows
from quernal.errors import EngineError, EngineFatalError
from quernal.plans import scan
from quernal.plans.catalog import Catalog, bootstrap_rows, by_name, index_keys, index_type
from quernal.plans.expressions import Expr, call, literal
from quernal.plans.scan import Predicate, ordered
from quernal.plans.schema import NO_FIELD, Schema, is_null, project
from quernal.sources import files, initdata, pages
from quernal.streaming import with_results
from quernal.types import BOOL, BY_NAME, CHAR, DOUBLE, INT4, UINT1, VARCHAR


def test_optypes():
    assert ops.symbol(8) == "<<" and ops.symbol(99) == "#invalid"
    assert ops.parse_symbol("-") == 4 and ops.parse_symbol("-", 1) == 23 and ops.parse_symbol("?") == 0
    assert ops.parse_symbol("OR") == 17 and ops.parse_symbol("AND") == 18
    assert ops.is_unary(16) and ops.is_binary(17) and not ops.is_unary(99) and not ops.is_binary(0)


def test_expressions(spark):
    df = spark.createDataFrame([(2147483647, 2, 1.5, "ab  ")], "a int, b int, d double, s string")
    a, b, d = Expr(F.col("a"), INT4), Expr(F.col("b"), INT4), Expr(F.col("d"), DOUBLE)
    one = literal(1, UINT1)
    exprs = [a + b, a - b, a * b, a / b, a % b, -b, ~b, a & b, a | b, a ^ b, a << one, a >> one, d * d, ~(a == b) & (a > b)]
    row = df.select(*(e.column.alias(f"x{i}") for i, e in enumerate(exprs))).first()
    assert list(row) == [-2147483647, 2147483645, -2, 1073741823, 1, -2, -3, 2, 2147483647, 2147483645, -2, 1073741823, 2.25, True]
    s = Expr(F.col("s"), CHAR, 4)
    assert df.select(s.cast(VARCHAR).column.alias("v"), call("char_EQ", s, literal("ab", CHAR)).column.alias("e")).first() == ("ab", True)
    for bad in (lambda: a + d, lambda: literal(256, UINT1), lambda: call("nothing"), lambda: call("INT4_add", a, d), lambda: a.cast(DOUBLE)):
        with pytest.raises(EngineError):
            bad()


def test_schema(spark):
    s = Schema.create([INT4.oid, CHAR.oid, VARCHAR.oid], [0, 3, 5], [False, True, True], ["a", "B", "c"])
    assert s.field("c") == 2 and s.field("A") == NO_FIELD
    df = s.rows(spark, [(1, "x", "yz"), (2, None, None), (3, "x     ", "12345   ")])
    assert [tuple(r) for r in df.collect()] == [(1, "x  ", "yz"), (2, None, None), (3, "x  ", "12345")]
    assert Schema.of(s.to_struct()) == s
    assert [r[0] for r in project(df, 1).collect()] == ["x  ", None, "x  "]
    assert df.where(is_null(df, 2)).count() == 1
    for bad in ([(None, "x", "y")], [(1, "abcd", "y")], [(1, "a", "123456")]):
        with pytest.raises(PySparkException):
            s.rows(spark, bad).collect()
    for bad in (lambda: Schema.create([9]), lambda: Schema.create([INT4.oid], [1, 2]), lambda: Schema.create([CHAR.oid], [40000]), lambda: project(df, 7), lambda: s.encode(df.select("a"))):
        with pytest.raises(EngineError):
            bad()


def test_scan(spark):
    df = scan.with_rid(spark.createDataFrame([(i, i % 3, "N%d" % i) for i in range(20)], "k int, g int, n string").coalesce(1))
    assert [r.k for r in scan.scan_from(df, scan.RecordId(0, 18)).collect()] == [17, 18, 19]
    assert [r.k for r in scan.fetch(df, scan.RecordId(0, 1)).collect()] == [0]
    g = scan.Predicate("g", "INT4_eq", F.lit(1))
    assert scan.search(df, [g]).count() == 7
    assert [r.k for r in scan.search(df, [g], unique=True, order="k").collect()] == [1]
    assert [r.k for r in scan.search(df, [g], n=3, order="k").collect()] == [1, 4, 7]
    assert [r.k for r in scan.search(df, [g, scan.Predicate("n", "VARCHAR_eq_ci", F.lit("n4"))]).collect()] == [4]
    assert scan.search(df, [scan.Predicate("g", "INT4_eq", F.lit(None).cast("int"))]).count() == 0
    changed = scan.update(df, [g], {"n": F.lit("z")})
    assert changed.where("n = 'z'").count() == 7 and changed.count() == 20
    assert scan.append(df, df.limit(2)).count() == 22
    assert scan.RecordId(0, 2) < scan.RecordId(1, 1) and not scan.RecordId(0, 0).is_valid and str(scan.RecordId(3, 4)) == "(3, 4)"
    with pytest.raises(EngineError):
        scan.search(df, [scan.Predicate("g", "INT4_add", F.lit(1))])


def test_bootstrap_counts(spark):
    rows = bootstrap_rows()
    assert {t: len(r) for t, r in rows.items()} == {"Table": 8, "Type": 15, "Column": 48, "Function": 240, "FunctionArgs": 429, "Operator": 197, "Index": 15, "IndexColumn": 20}
    assert [r["idxid"] for r in rows["Index"]] == list(range(1500, 1515))
    assert [r["idxname"] for r in rows["Index"]][:2] == ["Index_idxid", "IndexColumn_idxcolidxid_idxcolid"] and len(index_keys()) == 15
    names = next(r for r in rows["IndexColumn"] if r["idxcoltypid"] == VARCHAR.oid)
    assert (names["idxcoleqfuncid"], names["idxcolltfuncid"]) == (873, 875)
    c = Catalog(spark)
    for t in rows:
        assert c.df(t).count() == len(rows[t])
    assert c.duplicate_oids_df().count() == 0 and c.table_desc_df().count() == 48 and c.index_desc_df().count() == 20
    known = {r["typid"] for r in rows["Type"]}
    assert {r["funcargtypid"] for r in rows["FunctionArgs"]} <= known and {r["coltypid"] for r in rows["Column"]} <= known
    c.register_views()
    assert spark.sql("select count(*) from sys_function where funcnargs = 2").first()[0] == sum(len(f.args) == 2 for f in registry.FUNCTIONS.values())


def test_lookups(spark):
    c = Catalog(spark)
    assert c.find_table_by_name("TABLE") == 1 and c.find_table_by_name("nope") == 0 and c.find_table(3)["tabname"] == "Column"
    assert c.find_function_by_name("int4_add") == 562 and c.find_function(562)["funcnargs"] == 2 and c.find_function_args(562, 1)["funcargtypid"] == INT4.oid
    assert c.find_operator(3, INT4.oid, INT4.oid) == 562 and c.find_operator(16, BOOL.oid) == 772 and c.find_operator(3, INT4.oid, DOUBLE.oid) == 0
    assert c.find_index_by_name("type_TYPNAME") in c.find_all_indexes_of_table(2) and len(c.find_all_indexes_of_table(7)) == 4
    assert c.find_table_desc(1).schema.column_names()[0] == "tabid" and c.find_table_desc(999) is None
    assert len(c.find_index_desc(1501).columns) == 2 and c.find_index_desc(1) is None
    assert c.df("Table").where(by_name("tabname", "indexCOLUMN")).count() == 1
    assert index_type(2).name == "b-tree" and not index_type(2).volatile
    for bad in (lambda: c.find_operator(99, 1), lambda: c.find_operator(3, INT4.oid), lambda: c.find_operator(16, BOOL.oid, BOOL.oid)):
        with pytest.raises(EngineError):
            bad()
    with pytest.raises(EngineFatalError):
        index_type(7)


def test_definitions(spark):
    c = Catalog(spark)
    t = c.add_table("people", [INT4.oid, VARCHAR.oid], [0, 20])
    assert t == 20000 and [r["colname"] for r in c.find_columns(t)] == ["col_0", "col_1"] and all(r["colisnullable"] for r in c.find_columns(t))
    i = c.add_index("", t, 2, True, [1], fid=9)
    assert c.find_index(i)["idxname"] == "people_col_1" and c.find_index_desc(i).columns[0]["idxcoleqfuncid"] == 865
    j = c.add_index("mine", t, 1, False, [1], equal=[873], less=[875])
    assert c.find_index_desc(j).columns[0]["idxcolltfuncid"] == 875 and c.next_oid == 20003
    for bad in (
        lambda: c.add_table("PEOPLE", [INT4.oid]), lambda: c.add_table("x", []), lambda: c.add_table("x", [1]), lambda: c.add_table("x", [INT4.oid], fid=0), lambda: c.add_table("x", [INT4.oid], names=["a", "b"]), lambda: c.add_table("x" * 63, [INT4.oid]),
        lambda: c.add_index("a", 5000, 2, True, [0], 1), lambda: c.add_index("a", t, 9, True, [0], 1), lambda: c.add_index("a", t, 1, True, [0], 1), lambda: c.add_index("a", t, 2, True, [0]), lambda: c.add_index("a", t, 2, True, [5], 1), lambda: c.add_index("a", t, 2, True, [0], 1, equal=[562]), lambda: c.add_index("mine", t, 1, False, [0]),
    ):
        with pytest.raises(EngineError):
            bad()
    with pytest.raises(EngineFatalError):
        c.finish_init({1: 1})
    full = Catalog(spark, next_oid=2**32)
    assert full.allocate_oid() == 0


def test_database(spark, tmp_path):
    db = Database(spark).open()
    with pytest.raises(EngineError):
        db.open()
    db.create_table("points", [("x", "INT4"), ("name", "CHAR")], [0, 4], [False, True])
    assert db.scan("points").count() == 0 and db.scan("type").count() == 15
    db.create_index("points", ["x"])
    db.insert("points", spark.createDataFrame([(1, "a"), (2, None)], "x int, name string"))
    assert sorted(tuple(r) for r in db.scan("POINTS").collect()) == [(1, "a   "), (2, None)]
    with pytest.raises(PySparkException):
        db.insert("points", spark.createDataFrame([(None, "a")], "x int, name string"))
    db.update("points", [Predicate("x", "INT4_eq", F.lit(2))], {"name": F.lit("zz")})
    assert sorted(tuple(r) for r in db.scan("points").collect()) == [(1, "a   "), (2, "zz  ")]
    with pytest.raises(PySparkException):
        db.update("points", [Predicate("x", "INT4_eq", F.lit(2))], {"name": F.lit("far too long")})
    assert db.scan("points").count() == 2
    path = tmp_path / "init.dat"
    path.write_text(dump_rows(bootstrap_rows()))
    again = load_rows(spark, str(path))
    assert again == bootstrap_rows()
    assert Database(spark).open(str(path)).catalog.find_function_by_name("INT4_add") == 562
    db.close()
    for bad in (lambda: db.scan("points"), lambda: Database(spark).open(create=False), lambda: Database(spark, str(tmp_path / "none")).open(create=False)):
        with pytest.raises(EngineError):
            bad()


def test_databases_apart(spark):
    """Two databases of one session use the same ids, and keep their rows apart."""
    one, two = Database(spark).open(), Database(spark).open()
    assert one.create_table("a", [("x", "INT4")]) == two.create_table("b", [("name", "VARCHAR")], [9]) == 20000
    one.insert("a", spark.createDataFrame([(1,), (2,)], "x int"))
    assert two.scan("b").columns == ["name"] and two.scan("b").count() == 0
    two.insert("b", spark.createDataFrame([("n",)], "name string"))
    assert [r.x for r in ordered(one.scan("a"), "x").collect()] == [1, 2] and [r.name for r in two.scan("b").collect()] == ["n"]
    one.close()
    assert [r.name for r in two.scan("b").collect()] == ["n"]
    two.close()


def test_database_opened_again(spark, tmp_path):
    """Catalog, rows, next id and file ids outlive the session's objects."""
    where = str(tmp_path / "db")
    db = Database(spark, where).open()
    first = db.create_table("kept", [("x", "INT4"), ("s", "CHAR")], [0, 3])
    index = db.create_index("kept", ["x"], unique=True)
    db.insert("kept", spark.createDataFrame([(1, "a"), (2, "b")], "x int, s string"))
    db.update("kept", [Predicate("x", "INT4_eq", F.lit(1))], {"x": F.lit(7)})
    before = db.catalog.next_oid
    db.close()
    db = Database(spark, where).open(create=False)
    assert db.catalog.next_oid == before and db.catalog.find_index(index)["idxunique"] and db.catalog.find_table(first)["tabfid"] == 2
    assert sorted(tuple(r) for r in db.scan("kept").collect()) == [(2, "b  "), (7, "a  ")]
    assert db.create_table("more", [("y", "BOOL")]) == before and db.catalog.duplicate_oids_df().count() == 0
    db.close()
    assert Database(spark, where).open().catalog.find_table_by_name("MORE") == before
    with pytest.raises(EngineError):
        Database(spark, where).open(str(tmp_path / "init.dat"))


def test_next_oid_after_init_file(spark, tmp_path):
    rows = bootstrap_rows()
    rows["Table"].append({"tabid": 20005, "tabissys": False, "tabisvarlen": True, "tabncols": 1, "tabfid": 9, "tabname": "mine"})
    rows["Column"].append({"coltabid": 20005, "colid": 0, "colisarray": False, "colisnullable": True, "coltypid": INT4.oid, "coltypparam": 0, "colname": "x"})
    path = tmp_path / "init.dat"
    path.write_text(dump_rows(rows))
    db = Database(spark).open(str(path))
    assert db.create_table("next", [("x", "INT4")]) == 20006 and db.scan("mine").count() == 0
    db.close()


def test_typed_order(spark):
    schema = Schema.create([BY_NAME[t].oid for t in ("CHAR", "DOUBLE", "UINT8")], [4, 0, 0], [True] * 3, ["c", "d", "u"])
    rows = [("b", float("nan"), 2**64 - 1), ("a ", -0.0, 0), ("a", 1.5, 2**63), (None, None, 5), ("a!", float("inf"), 7)]
    df = schema.rows(spark, [(c, d, None if u is None else Decimal(u)) for c, d, u in rows])
    assert [r.u for r in ordered(df, "u").collect()] == [0, 5, 7, 2**63, 2**64 - 1]
    assert [r.u for r in ordered(df, "d").collect()] == [5, 0, 2**63, 7, 2**64 - 1]
    assert [r.u for r in ordered(df, "c", "u").collect()] == [5, 0, 2**63, 7, 2**64 - 1]
    assert [r.u for r in ordered(df, "c", "u", descending=True).collect()] == [2**64 - 1, 7, 2**63, 0, 5]


def test_initdata(spark, tmp_path):
    text = 'table 1 100 0 101 0 101 0 103 0 108 0 111 62\ndata 1 t t 6 0 "Table"\ndata 20000 f t 2 9 "has \\"quote\\" and \\\\"\n'
    got = list(initdata.read_lines(text.split("\n")))
    assert [x.kind for x in got] == ["table", "data", "data"] and got[2].values == (20000, False, True, 2, 9, 'has "quote" and \\')
    assert initdata.dump([(1, got[0].schema, [x.values for x in got[1:]])]) == text
    path = tmp_path / "init.dat"
    path.write_text(text)
    assert initdata.load(spark, str(path))[1].count() == 2
    head = "table 1 104 0\n"
    for bad in (head + "\ndata 1", "rows 1", head + "data 1 2", head + "data", "table 1 111 9\ndata \"a", 'table 1 111 9\ndata "a\\n"', 'table 1 111 9\ndata "a"b', "data 1", head + "data x", "table 1 104"):
        with pytest.raises(EngineError):
            list(initdata.read_lines(bad.split("\n")))


MAGIC = 0xFAEBDC0918274655


def page(n):
    return (n % 2**64).to_bytes(8, "little") + bytes(pages.PAGE - 8)


def test_page_files(spark, tmp_path, caplog):
    path = str(tmp_path / "f")
    assert pages.PageFile.open(path) is None and pages.last_errno() == errno.ENOENT
    assert pages.PageFile.open(str(tmp_path)) is None and pages.last_errno() == errno.EISDIR
    f = pages.PageFile.open(path, create=True)
    assert f.is_open and f.size() == 0 and stat.S_IMODE(os.stat(path).st_mode) == 0o600
    with pytest.raises(EngineFatalError):
        f.write(page(1), 0)
    f.allocate(4 * pages.PAGE)
    assert f.read(4 * pages.PAGE, 0) == bytes(4 * pages.PAGE)
    for n in (0, 2, 3, 1):
        f.write(page(MAGIC + n), n * pages.PAGE)
    f.flush()
    for n in (1, 3):
        f.write(page(MAGIC - n), n * pages.PAGE)
    want = [MAGIC, MAGIC - 1, MAGIC + 2, MAGIC - 3]
    assert [f.read(pages.PAGE, n * pages.PAGE) for n in (3, 0)] == [page(want[3]), page(want[0])]
    for offset in (-pages.PAGE, 4 * pages.PAGE, 4 * pages.PAGE - 512):
        with pytest.raises(EngineFatalError):
            f.read(pages.PAGE, offset)
    got = pages.read_pages(spark, path).select("pid", pages.leading_uint64().alias("magic")).orderBy("pid").collect()
    assert [(r.pid, r.magic) for r in got] == [(i, Decimal(w)) for i, w in enumerate(want)]
    os.close(f.fd)
    with caplog.at_level(logging.WARNING):
        f.close()
        f.close()
    assert caplog.text.count("cannot close") == 1 and not f.is_open
    assert f.reopen() and f.size() == 4 * pages.PAGE
    f.delete()
    assert f.read(8, 0) == want[0].to_bytes(8, "little") and not files.file_exists(path)
    f.close()
    assert not f.reopen() and pages.last_errno() == errno.ENOENT
    with caplog.at_level(logging.WARNING):
        f.delete()
    assert "cannot delete" in caplog.text
    g = pages.PageFile.open(path, create=True, direct=True, mode=0o640)
    g.allocate(pages.PAGE)
    with pytest.raises(EngineFatalError):
        g.read(4095, 0)
    del g
    assert pages.PageFile.open(path, truncate=True).size() == 0


def test_files(tmp_path):
    d = str(tmp_path / "a" / "b")
    files.make_dirs(d)
    files.make_dirs(d)
    assert files.dir_exists(d) and files.dir_empty(d) and not files.regular_file_exists(d)
    files.remove_dir(d)
    assert not files.file_exists(d)
    t = files.temp_file()
    assert files.regular_file_exists(t)
    os.unlink(t)
    files.remove_dir(files.temp_dir())


def test_functions_on_streams(spark, tmp_path):
    """An extension: built-in functions are Columns, so they work on streams."""
    spark.range(5).selectExpr("cast(id as int) a").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int").parquet(str(tmp_path / "in"))
    out = with_results(stream.select("a", (Expr(F.col("a"), INT4) + literal(1, INT4)).column.alias("b")), c=("INT4_add", "a", "b"))
    with pytest.raises(EngineError):
        with_results(stream, c=("INT4_add", "a"))
    q = out.writeStream.format("memory").queryName("plus").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.b for r in spark.table("plus").collect()) == [1, 2, 3, 4, 5] and sorted(r.c for r in spark.table("plus").collect()) == [1, 3, 5, 7, 9]

"""Every function family against Python's own arithmetic, on boundary values and NULLs."""

import math
import operator
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import quernal.functions  # noqa: F401
from quernal import registry
from quernal.functions.chars import char_length
from quernal.errors import EngineError
from quernal.types import BOOL, BY_NAME, CHAR, DOUBLE, FLOAT, INT4, OID, SIGNED, STRING, UNSIGNED, VARCHAR


def frame(spark, rows, *types):
    return spark.createDataFrame(rows, ", ".join(f"c{i} {t.spark.simpleString()}" for i, t in enumerate(types)))


def call(spark, name, rows, typparam=0):
    f = registry.BY_NAME[name]
    df = frame(spark, rows, *f.args)
    return [r[-1] for r in df.select("*", f(*(F.col(f"c{i}") for i in range(len(f.args))), typparam=typparam).alias("out")).collect()]


def narrow(t, v):
    low, high = t.limits
    return (v - low) % (high - low + 1) + low


def boundary(t):
    low, high = t.limits
    return sorted({low, low + 1, 0, 1, 7, high // 2, high // 2 + 1, high - 1, high} | ({-1} if t.is_signed else set()))


def cells(t, values):
    return [Decimal(v) if t.name == "UINT8" else v for v in values]


def truncated(a, b):
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


@pytest.mark.parametrize("t", [*SIGNED, *UNSIGNED], ids=lambda t: t.name)
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_integers(spark, t, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        values = boundary(t)
        pairs = [(a, b) for a in values for b in values]
        rows = [tuple(cells(t, p)) for p in pairs]
        binary = {"add": operator.add, "sub": operator.sub, "mul": operator.mul, "and": operator.and_, "or": operator.or_, "xor": operator.xor}
        for name, op in binary.items():
            assert call(spark, f"{t.name}_{name}", rows) == [narrow(t, op(a, b)) for a, b in pairs], name
        for name in ("eq", "ne", "lt", "le", "gt", "ge"):
            assert call(spark, f"{t.name}_{name}", rows) == [getattr(operator, name)(a, b) for a, b in pairs], name
        whole = [(a, b) for a, b in pairs if b and not (t.is_signed and b == -1 and a == t.limits[0])]
        rows = [tuple(cells(t, p)) for p in whole]
        assert call(spark, f"{t.name}_div", rows) == [truncated(a, b) for a, b in whole]
        assert call(spark, f"{t.name}_mod", rows) == [a - b * truncated(a, b) for a, b in whole]
        one = [tuple(cells(t, [a])) for a in values]
        assert call(spark, f"{t.name}_neg", one) == [narrow(t, -a) for a in values]
        assert call(spark, f"{t.name}_not", one) == [narrow(t, ~a) for a in values]
        shifts = [(a, n) for a in values for n in (0, 1, 3, min(t.bits, 31) - 1)]
        rows = [(cells(t, [a])[0], n) for a, n in shifts]
        assert call(spark, f"{t.name}_lsh", rows) == [narrow(t, a << n) for a, n in shifts]
        assert call(spark, f"{t.name}_rsh", rows) == [a >> n for a, n in shifts]
        assert call(spark, f"{t.name}_out", one) == [str(a) for a in values]
        assert call(spark, f"{t.name}_in", [(f" {a} ",) for a in values] + [(None,)]) == [*values, None]
        for name in ("add", "div", "mod", "mul", "eq", "lsh"):
            second = 1 if name == "lsh" else cells(t, [1])[0]
            assert call(spark, f"{t.name}_{name}", [(None, second), (cells(t, [1])[0], None)]) == [None, None], name
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_integer_errors(spark):
    for name, rows, said in (
        ("INT4_div", [(1, 0)], "division by zero"), ("UINT8_mod", [(Decimal(1), Decimal(0))], "division by zero"), ("INT4_div", [(-(2**31), -1)], "overflow"), ("INT8_div", [(-(2**63), -1)], "overflow"),
        ("INT1_in", [("300",)], "cannot parse"), ("UINT2_in", [("-1",)], "cannot parse"), ("INT4_in", [("7.9",)], "cannot parse"), ("INT8_in", [("abc",)], "cannot parse"), ("OID_in", [("4294967296",)], "cannot parse"), ("BOOL_in", [(" true",)], "cannot parse"), ("DOUBLE_in", [("1.5d",)], "cannot parse"),
        ("CHAR_in", [("abcdef",)], "5 fit"), ("VARCHAR_in", [("abcdef",)], "5 fit"), ("VARCHAR_concat", [("x" * 32767, "y")], "longer than a record"),
    ):
        with pytest.raises(PySparkException, match=said):
            call(spark, name, rows, 5)
    assert call(spark, "INT1_div", [(-128, -1)]) == [-128]
    assert call(spark, "INT8_mod", [(-(2**63), -1)]) == [0]


def test_bools_and_oids(spark):
    three = [True, False, None]
    pairs = [(a, b) for a in three for b in three]
    assert call(spark, "BOOL_and", pairs) == [False if False in p else None if None in p else True for p in pairs]
    assert call(spark, "BOOL_or", pairs) == [True if True in p else None if None in p else False for p in pairs]
    assert call(spark, "BOOL_not", [(a,) for a in three]) == [False, True, None]
    assert call(spark, "BOOL_lt", [(False, True), (True, True), (None, True)]) == [True, False, None]
    assert call(spark, "BOOL_in", [(x,) for x in ("yes", "T", "1", "n", "FALSE", None)]) == [True, True, True, False, False, None]
    assert call(spark, "BOOL_out", [(a,) for a in three]) == ["true", "false", None]
    ids = [0, 1, 19999, 20000, 4294967294, 4294967295]
    pairs = [(a, b) for a in ids for b in ids]
    for name in ("eq", "ne", "lt", "le", "gt", "ge"):
        assert call(spark, f"OID_{name}", pairs) == [getattr(operator, name)(a, b) for a, b in pairs]
    assert call(spark, "OID_in", [("4294967295",), ("+7",)]) == [4294967295, 7]


@pytest.mark.parametrize("t", [FLOAT, DOUBLE], ids=lambda t: t.name)
def test_floats(spark, t):
    values = [-math.inf, -1.5, -0.0, 0.0, 0.25, 100.0, 1e20, math.inf, math.nan]
    pairs = [(a, b) for a in values for b in values]

    def divided(a, b):
        if b == 0:
            return math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
        return a / b

    same = lambda x, y: (x != x and y != y) or (x == y and math.copysign(1, x) == math.copysign(1, y)) or (t is FLOAT and math.isclose(x, y, rel_tol=1e-6))
    for name, op in (("add", operator.add), ("sub", operator.sub), ("mul", operator.mul), ("div", divided)):
        got = call(spark, f"{t.name}_{name}", pairs)
        for p, x in zip(pairs, got, strict=True):
            want = op(*p)
            if t is FLOAT and abs(want) > 3.5e38 and want == want:
                want = math.copysign(math.inf, want)
            assert same(x, want), (name, p, x, want)
    for name in ("eq", "ne", "lt", "le", "gt", "ge"):
        assert call(spark, f"{t.name}_{name}", pairs) == [getattr(operator, name)(a, b) for a, b in pairs], name
    assert call(spark, f"{t.name}_eq", [(None, math.nan), (math.nan, None)]) == [None, None]
    assert call(spark, f"{t.name}_out", [(x,) for x in (1e20, 100.0, 3.14159265, 1e-5, 0.1, math.inf, -math.inf, math.nan, None)]) == ["1e+20", "100", "3.14159", "1e-05", "0.1", "inf", "-inf", "nan", None]
    got = call(spark, f"{t.name}_in", [(x,) for x in (" 1.5", "-inf", "1e3", ".5", "nan", None)])
    assert got[:4] == [1.5, -math.inf, 1000.0, 0.5] and math.isnan(got[4]) and got[5] is None


def test_strings(spark):
    assert call(spark, "CHAR_in", [(x,) for x in ("", "ab", "ab   ", "AB", "abcde", "ab        ", "ab\t", "é", None)], 5) == ["     ", "ab   ", "ab   ", "AB   ", "abcde", "ab   ", "ab\t  ", "é   ", None]
    assert call(spark, "VARCHAR_in", [(x,) for x in ("", "ab", "ab   ", "ab        ", None)], 5) == ["", "ab", "ab   ", "ab   ", None]
    assert call(spark, "CHAR_eq", [("ab", "ab   "), ("ab\t", "ab"), ("AB", "ab"), (None, "a")]) == [True, False, False, None]
    assert call(spark, "CHAR_lt", [("a ", "b"), ("b", "a"), ("Z", "a")]) == [True, False, True]
    assert call(spark, "CHAR_eq_ci", [("AB  ", "ab"), ("É", "é")]) == [True, False]
    assert call(spark, "VARCHAR_eq", [("ab", "ab   "), ("ab", "ab")]) == [False, True]
    assert call(spark, "VARCHAR_lt_ci", [("a", "B"), ("B", "a"), ("Z_", "za")]) == [True, False, True]
    assert call(spark, "VARCHAR___STRING_eq_ci", [("Table", "tAbLe")]) == [True]
    assert call(spark, "VARCHAR_length", [("é",), ("",), (None,)]) == [2, 0, None]
    assert call(spark, "VARCHAR_concat", [("a", "b"), (None, "b")]) == ["ab", None]
    assert call(spark, "CHAR_to_VARCHAR", [("abc  ",), ("a    ",)], 2) == ["ab", "a"]
    assert call(spark, "CHAR_to_VARCHAR", [("abc  ",)], 0) == ["abc"]
    assert call(spark, "VARCHAR_to_CHAR", [("abc",), ("a",)], 2) == ["ab", "a "]
    assert call(spark, "VARCHAR_to_CHAR", [("abc",)], 0) == ["abc"]
    assert call(spark, "CHAR_typlen", [(Decimal(7),)]) == [7]
    for bad in (None, 32768):
        with pytest.raises(EngineError):
            char_length(bad)


def test_registry():
    assert len(registry.FUNCTIONS) == 240 and len(registry.OPERATORS) == 197
    assert sum(len(f.args) for f in registry.FUNCTIONS.values()) == 429
    assert all(500 <= oid <= 905 for oid in registry.FUNCTIONS)
    assert registry.find_by_name("int4_ADD").oid == 562 and registry.find(1) is None
    assert registry.resolve("SUB", INT4, INT4).name == "INT4_sub" and registry.resolve("NEG", INT4).name == "INT4_neg"
    for bad in (("ADD", INT4, DOUBLE), ("ADD", OID, OID), ("ADD", INT4, None), ("NOT", INT4, None), ("EQ", CHAR, VARCHAR)):
        with pytest.raises(EngineError):
            registry.resolve(*bad)
    assert registry.resolve("EQ", VARCHAR, STRING).returns is BOOL and BY_NAME["INT8"].bits == 64

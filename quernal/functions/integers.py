"""The eight integer types: twenty functions each, wrapping like fixed-width machine integers.

Results are computed in a wider type and brought back to the type's range, never by switching ANSI mode off. UINT8 is a
decimal(20,0), whose bits are handled through its two's-complement long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernal.functions.common import SPACE, comparisons, fail
from quernal.registry import builtin
from quernal.types import SIGNED, STRING, UINT1, UNSIGNED, TypeSpec

WIDE = "decimal(38,0)"
TWO_64, TWO_63, TWO_32 = 1 << 64, 1 << 63, 1 << 32

# The object id of each type's first function; the others follow in the order below.
FIRST_OID = {"INT1": 500, "INT2": 530, "INT4": 560, "INT8": 590, "UINT1": 620, "UINT2": 650, "UINT4": 680, "UINT8": 710}


def big(n: int) -> Column:
    return F.lit(str(n)).cast(WIDE)


def modulo(x: Column, n: int) -> Column:
    return F.pmod(x, big(n))


def to_bits(a: Column) -> Column:
    """The two's-complement long of a UINT8."""
    a = a.cast(WIDE)
    return F.when(a >= big(TWO_63), a - big(TWO_64)).otherwise(a).cast("bigint")


def from_bits(x: Column) -> Column:
    """The UINT8 of a two's-complement long."""
    wide = x.cast(WIDE)
    return F.when(x >= F.lit(0), wide).otherwise(wide + big(TWO_64)).cast("decimal(20,0)")


def wrapped(t: TypeSpec, x: Column) -> Column:
    """x (a long, or a decimal(38,0) for the 8-byte types) modulo 2^bits in t's range."""
    if t.length == 8:
        p = modulo(x.cast(WIDE), TWO_64)
        if t.is_signed:
            return F.when(p >= big(TWO_63), p - big(TWO_64)).otherwise(p).cast("bigint")
        return p.cast("decimal(20,0)")
    mask, half = (1 << t.bits) - 1, 1 << t.bits - 1
    low = x.bitwiseAND(F.lit(mask).cast("bigint"))
    return (low.bitwiseXOR(F.lit(half).cast("bigint")) - F.lit(half).cast("bigint") if t.is_signed else low).cast(t.spark)


def _wide(t: TypeSpec, a: Column) -> Column:
    return a.cast(WIDE if t.length == 8 else "bigint")


def _sum(t: TypeSpec, a: Column, b: Column, minus: bool = False) -> Column:
    exact = wrapped(t, _wide(t, a) - _wide(t, b) if minus else _wide(t, a) + _wide(t, b))
    # Decimals only for the rows that do overflow.
    return F.coalesce((F.try_subtract if minus else F.try_add)(a, b), exact) if t.name == "INT8" else exact


def _product(t: TypeSpec, a: Column, b: Column) -> Column:
    if t.name == "UINT4":  # beyond a long
        return modulo(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), TWO_32).cast("bigint")
    if t.name == "INT8":
        return F.coalesce(F.try_multiply(a, b), wrapped(t, a.cast("decimal(19,0)") * b.cast("decimal(19,0)")))
    if t.name == "UINT8":  # beyond decimal(38,0): by 32-bit limbs
        x, y, low = to_bits(a), to_bits(b), F.lit(TWO_32 - 1).cast("bigint")
        dec = lambda v: v.cast("decimal(18,0)")
        xh, yh, xl, yl = dec(F.shiftrightunsigned(x, 32)), dec(F.shiftrightunsigned(y, 32)), dec(x.bitwiseAND(low)), dec(y.bitwiseAND(low))
        middle = modulo(((xh * yl).cast(WIDE) + (xl * yh).cast(WIDE)).cast(WIDE), TWO_32).cast("decimal(18,0)")
        return modulo(((middle * F.lit(str(TWO_32)).cast("decimal(18,0)")).cast(WIDE) + (xl * yl).cast(WIDE)).cast(WIDE), TWO_64).cast("decimal(20,0)")
    return wrapped(t, a.cast("bigint") * b.cast("bigint"))


def _guarded(t: TypeSpec, a: Column, b: Column, value: Column) -> Column:
    """NULL on NULL, an error on division by zero."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, fail("division by zero").cast(t.spark)).otherwise(value).cast(t.spark)


def _quotient(t: TypeSpec, a: Column, b: Column) -> Column:
    if t.name == "UINT8":
        return _guarded(t, a, b, ((a - a % b) / b).cast("decimal(20,0)"))
    x, y = a.cast("bigint"), b.cast("bigint")
    whole = F.call_function("div", x, y)
    if not t.is_signed:
        value = whole.cast(t.spark)
    elif t.length < 4:
        value = wrapped(t, whole)
    else:  # the least value by -1 has no quotient
        value = F.when((x == F.lit(t.limits[0])) & (y == -1), fail("integer overflow").cast(t.spark)).otherwise(whole.cast(t.spark))
    return _guarded(t, a, b, value)


def _remainder(t: TypeSpec, a: Column, b: Column) -> Column:
    # The remainder by -1 is 0, also of the least value.
    value = F.when(b == -1, F.lit(0).cast(t.spark)).otherwise((a % b).cast(t.spark)) if t.is_signed else (a % b).cast(t.spark)
    return _guarded(t, a, b, value)


def _bitwise(t: TypeSpec, name: str):
    def build(a: Column, b: Column) -> Column:
        if t.name == "UINT8":
            return from_bits(getattr(to_bits(a), name)(to_bits(b)))
        return getattr(a.cast("bigint"), name)(b.cast("bigint")).cast(t.spark)

    return build


def _not(t: TypeSpec, a: Column) -> Column:
    return (big(TWO_64 - 1) - a.cast(WIDE)).cast("decimal(20,0)") if t.name == "UINT8" else wrapped(t, F.bitwise_not(_wide(t, a))) if t.length < 8 else F.bitwise_not(a)


def _shifted(t: TypeSpec, left: bool):
    """Counts are taken modulo 32, modulo 64 for the 8-byte types."""

    def build(a: Column, n: Column) -> Column:
        n = n.cast("int").bitwiseAND(F.lit(63 if t.length == 8 else 31))
        x = to_bits(a) if t.name == "UINT8" else a.cast("bigint")
        if left:
            out = F.call_function("shiftleft", x, n)
            return from_bits(out) if t.name == "UINT8" else out if t.length == 8 else wrapped(t, out)
        out = F.call_function("shiftright" if t.is_signed or t.length < 8 else "shiftrightunsigned", x, n)
        return from_bits(out) if t.name == "UINT8" else out.cast(t.spark)

    return build


def _in(t: TypeSpec, s: Column) -> Column:
    low, high = t.limits
    sign = "[+-]?" if t.is_signed else r"\+?"
    number = s.try_cast(WIDE)
    good = s.rlike(f"^{SPACE}{sign}[0-9]+{SPACE}$") & number.between(big(low), big(high))
    return F.when(s.isNull(), F.lit(None)).when(F.coalesce(good, F.lit(False)), number.cast(t.spark)).otherwise(fail('cannot parse "', s, f'" as a {t.name}').cast(t.spark))


def register(t: TypeSpec) -> None:
    wide = lambda a: _wide(t, a)
    table = [
        (t, "in", (STRING,), (), lambda s: _in(t, s)), (STRING, "out", (t,), (), lambda a: a.cast("string")),
        (t, "add", (t, t), ("ADD",), lambda a, b: _sum(t, a, b)), (t, "sub", (t, t), ("SUB",), lambda a, b: _sum(t, a, b, minus=True)), (t, "mul", (t, t), ("MUL",), lambda a, b: _product(t, a, b)),
        (t, "div", (t, t), ("DIV",), lambda a, b: _quotient(t, a, b)), (t, "mod", (t, t), ("MOD",), lambda a, b: _remainder(t, a, b)), (t, "neg", (t,), ("NEG",), lambda a: wrapped(t, F.negative(wide(a)))),
    ]
    first = FIRST_OID[t.name]
    for i, (returns, name, args, operators, build) in enumerate(table):
        builtin(returns, f"{t.name}_{name}", first + i, args, operators)(build)
    comparisons(t, first + 8)
    builtin(t, f"{t.name}_not", first + 14, (t,), ("BITNOT",))(lambda a: _not(t, a))
    for i, (name, op, method) in enumerate((("and", "BITAND", "bitwiseAND"), ("or", "BITOR", "bitwiseOR"), ("xor", "BITXOR", "bitwiseXOR"))):
        builtin(t, f"{t.name}_{name}", first + 15 + i, (t, t), (op,))(_bitwise(t, method))
    builtin(t, f"{t.name}_lsh", first + 18, (t, UINT1), ("LSH",))(_shifted(t, True))
    builtin(t, f"{t.name}_rsh", first + 19, (t, UINT1), ("RSH",))(_shifted(t, False))


for _t in (*SIGNED, *UNSIGNED):
    register(_t)

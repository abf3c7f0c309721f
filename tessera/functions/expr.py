"""The expression language's operators on columns, with its own rules instead of SQL's.

Integers have 64 bits and wrap; a double on either side makes the result one; NaN compares equal to every number;
truth has two values; what the language refuses raises a Spark error with the language's error name. Operands are
columns of type bigint, double, string or boolean, whose types the caller names where they matter. All of
it is column expressions; the fast path of wrapping arithmetic is the plain operation, and decimals
are only evaluated where that overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_63, _TWO_64 = str(2**63), str(2**64)
_LOWEST = -(2**63)


def _dec(v: str) -> Column:
    return F.lit(v).cast("decimal(20,0)")


def _wrapped(exact: Column) -> Column:
    """A decimal(38,0) brought into 64 signed bits."""
    low = F.pmod(exact, _dec(_TWO_64))
    return F.when(low >= _dec(_TWO_63), low - _dec(_TWO_64)).otherwise(low).cast("long")


def _long(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def refuse(code: str, what: str) -> Column:
    return F.raise_error(F.lit(f"[{code}] {what}"))


def add(a: Column, b: Column) -> Column:
    """Sum of two bigints, wrapping."""
    return F.coalesce(F.try_add(a, b), _wrapped(_long(a) + _long(b)))


def subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b), _wrapped(_long(a) - _long(b)))


def multiply(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b), _wrapped(_long(a) * _long(b)))


def negate(a: Column) -> Column:
    """The lowest number is its own negative."""
    return F.when(a == _LOWEST, a).otherwise(-a)


def divide(a: Column, b: Column) -> Column:
    """Quotient of two bigints, towards zero; a zero divisor is refused."""
    safe = F.when((a == _LOWEST) & (b == -1), a).otherwise(F.call_function("div", a, F.when(b == -1, F.lit(1).cast("long")).otherwise(b)) * F.when(b == -1, F.lit(-1).cast("long")).otherwise(F.lit(1).cast("long")))
    return F.when(b == 0, refuse("StateViolation", "division by zero").cast("long")).otherwise(safe)


def divide_float(a: Column, b: Column) -> Column:
    """Quotient where a side is a double; a zero divisor is refused here too."""
    return F.when(b == 0, refuse("StateViolation", "division by zero").cast("double")).otherwise(a.cast("double") / b.cast("double"))


def remainder(a: Column, b: Column) -> Column:
    """Remainder of two bigints, with the sign of the first; doubles have none."""
    return F.when(b == 0, refuse("StateViolation", "division by zero").cast("long")).when(b == -1, F.lit(0).cast("long")).otherwise(a % b)


def shift_left(a: Column, n: Column) -> Column:
    """Bits that leave are lost; amounts beyond 0 to 63 are refused."""
    return F.when((n < 0) | (n > 63), refuse("StateViolation", "shift out of range").cast("long")).otherwise(F.call_function("shiftleft", a, n.cast("int")))


def shift_right(a: Column, n: Column) -> Column:
    """The sign is kept."""
    return F.when((n < 0) | (n > 63), refuse("StateViolation", "shift out of range").cast("long")).otherwise(F.call_function("shiftright", a, n.cast("int")))


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def truthy(v: Column, kind: str) -> Column:
    """Whether a bool, int, float or string counts as true; null, 0, 0.0 and the empty string do not, NaN does."""
    if kind == "bool":
        yes = v
    elif kind == "string":
        yes = F.octet_length(v) > 0
    else:
        yes = (v != 0) | F.isnan(v.cast("double"))
    return F.coalesce(yes, F.lit(False))


def both(a: Column, b: Column) -> Column:
    """a && b of two truths; b is only looked at where a holds."""
    return F.when(a, b).otherwise(F.lit(False))


def either(a: Column, b: Column) -> Column:
    return F.when(a, F.lit(True)).otherwise(b)


def negated(a: Column) -> Column:
    return ~a


def choose(test: Column, then: Column, other: Column) -> Column:
    """test ? then : other of a truth; only the branch taken is looked at."""
    return F.when(test, then).otherwise(other)


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two numbers or two strings (by bytes); NaN is equal to every number, null is nothing here."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def compared_numbers(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    return F.when(F.isnan(x) | F.isnan(y), 0).otherwise(compared(x, y))


def equal(a: Column, b: Column, numbers: bool = False) -> Column:
    """Of one type, or of two numbers; null equals null only."""
    if not numbers:
        return a.eqNullSafe(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(compared_numbers(a, b) == 0)


def text_of(v: Column, kind: str) -> Column:
    """What + puts into a string: floats with six digits, null as 'null', true and false."""
    if kind == "float":
        text = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise(F.format_string("%.6f", v))
    else:
        text = v.cast("string")
    return F.coalesce(text, F.lit("null"))


def concatenated(a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """a + b with a string on either side."""
    return F.concat(text_of(a, kinds[0]), text_of(b, kinds[1]))

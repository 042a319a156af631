"""Element-wise arithmetic with IEEE results, whatever spark.sql.ansi.enabled is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def div(a: Column, b: Column) -> Column:
    """a / b of doubles: infinities and NaN for a zero divisor, with the zero's sign."""
    a, b = a.cast("double"), b.cast("double")
    negative = (F.signum(a) < 0) != F.startswith(b.cast("string"), F.lit("-"))
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(negative, F.lit(-INF)).otherwise(F.lit(INF))
    return F.when((b != 0) | F.isnan(b), a / F.when(b != 0, b)).otherwise(zero)


def int_div(a: Column, b: Column) -> Column:
    """Quotient toward zero; an error for a zero divisor."""
    q = F.floor(F.abs(a).cast("decimal(20,0)") / F.abs(b).cast("decimal(20,0)"))
    return F.when(b == 0, F.raise_error(F.lit("integer division by zero"))).otherwise(F.when((a < 0) != (b < 0), -q).otherwise(q)).cast("bigint")


def mod(a: Column, b: Column) -> Column:
    return a % b


def _log(f):
    return lambda a: F.when(a > 0, f(F.when(a > 0, a))).when(a == 0, F.lit(-INF)).otherwise(F.lit(NAN))


log, log2, log10 = _log(F.log), _log(F.log2), _log(F.log10)


def log1p(a: Column) -> Column:
    return F.when(a > -1, F.log1p(F.when(a > -1, a))).when(a == -1, F.lit(-INF)).otherwise(F.lit(NAN))


def fmin(a: Column, b: Column) -> Column:
    """Smaller of two, a NaN loses."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def fmax(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def clip(a: Column, lo, hi) -> Column:
    return F.least(F.greatest(a, F.lit(lo)), F.lit(hi))


def safe_div(a: Column, b: Column, when_zero: Column) -> Column:
    return F.when(b == 0, when_zero).otherwise(div(a, b))


def sign(a: Column) -> Column:
    return F.when(a > 0, 1).when(F.isnan(a.cast("double")), 0).when(a < 0, -1).otherwise(0)


def int_pow(a: Column, n: int) -> Column:
    """Integer power by squaring, wrapped to 32 bits."""
    from .dtypes import DType, wrap

    if n < 0:
        raise ValueError("negative exponent of an integer")
    out, base = F.lit(1).cast("bigint"), a.cast("bigint")
    while n:
        if n & 1:
            out = wrap(out.cast("bigint") * base, DType.INT32).cast("bigint")
        base, n = wrap(base * base, DType.INT32).cast("bigint"), n >> 1
    return out.cast("int")


def _ordered(op):
    return lambda a, b: op(a, b) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


eq, lt, le, gt, ge = (_ordered(op) for op in (lambda a, b: a == b, lambda a, b: a < b, lambda a, b: a <= b, lambda a, b: a > b, lambda a, b: a >= b))


def ne(a: Column, b: Column) -> Column:
    return ~eq(a, b)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; 0 if either is NaN."""
    return F.when(lt(a, b), -1).when(gt(a, b), 1).otherwise(0)


def is_inf(a: Column) -> Column:
    return F.abs(a) == INF


def is_finite(a: Column) -> Column:
    return ~F.isnan(a) & (F.abs(a) != INF)


def truth(a: Column) -> Column:
    """Nonzero, NaN included."""
    return a != 0


def piecewise(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first true mask."""
    return reduce(lambda acc, case: F.when(case[0], case[1]).otherwise(acc), reversed(cases), otherwise)


def silu(a: Column) -> Column:
    return a / (1 + F.exp(-a))


def polyval(coefficients: list[float], x: Column) -> Column:
    """Horner, highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(float(c)), coefficients[1:], F.lit(float(coefficients[0])))


#: Fixed values of Acklam's rational approximation of the normal quantile.
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
ACKLAM_LOW = 0.02425


def norm_inv(p: Column) -> Column:
    """Normal quantile; 0 outside (0, 1)."""
    tail = lambda q: F.sqrt(-2 * F.log(F.when((q > 0) & (q < 1), q)))
    side = lambda q: polyval(ACKLAM_C, tail(q)) / polyval(ACKLAM_D, tail(q))
    r = p - 0.5
    middle = polyval(ACKLAM_A, r * r) * r / polyval(ACKLAM_B, r * r)
    return F.when((p <= 0) | (p >= 1), 0.0).when(p < ACKLAM_LOW, side(p)).when(p > 1 - ACKLAM_LOW, -side(1 - p)).otherwise(middle)


def bit_length(a: Column) -> Column:
    return F.when(a == 0, 0).otherwise(F.length(F.bin(a)))


def julian_day(d: Column) -> Column:
    return F.unix_date(d) + 2440588


#: Julian day of 21 April 753 BC (Gregorian).
ROME = 1446509


def days_since_rome(d: Column) -> Column:
    return julian_day(d) - ROME

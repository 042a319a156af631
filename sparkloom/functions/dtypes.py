"""Element types: lossless promotion, storage, wrapping and conversion.

Spark's own coercion is never relied on: the promoted type is computed here, on
the driver, and the expressions carry explicit casts.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class _Shape:
    digits: int  # bits that are held exactly: magnitude bits of integers, significand bits of floats
    signed: bool
    real: bool
    storage: str
    bits: int


class DType(Enum):
    BINARY = _Shape(1, False, False, "boolean", 1)
    INT3 = _Shape(2, True, False, "tinyint", 4)
    INT8 = _Shape(7, True, False, "tinyint", 8)
    UINT8 = _Shape(8, False, False, "smallint", 8)
    INT32 = _Shape(31, True, False, "int", 32)
    INT64 = _Shape(63, True, False, "bigint", 64)
    F16 = _Shape(11, True, True, "float", 16)
    BF16 = _Shape(8, True, True, "float", 16)
    F32 = _Shape(24, True, True, "float", 32)
    F64 = _Shape(53, True, True, "double", 64)
    UINT256 = _Shape(256, False, False, "binary", 256)

    @property
    def storage(self) -> str:
        return self.value.storage


_EXPONENTS = {DType.F16: 5, DType.BF16: 8, DType.F32: 8, DType.F64: 11}


def lossless(a: DType, b: DType) -> bool:
    """Every value of a is a value of b."""
    x, y = a.value, b.value
    if a is b:
        return True
    if x.real:
        return y.real and x.digits <= y.digits and _EXPONENTS[a] <= _EXPONENTS[b]
    if y.real or y.signed or not x.signed:
        return x.digits <= y.digits
    return False


def promote(a: DType, b: DType) -> DType:
    """The type of an element-wise operation on two arrays; ValueError if there is none."""
    if a is b is DType.BINARY:
        return DType.UINT8  # sums of bits
    if lossless(a, b):
        return b
    if lossless(b, a):
        return a
    real = a.value.real or b.value.real
    for c in (DType.F32, DType.F64) if real else (DType.INT32, DType.INT64, DType.F32, DType.F64, DType.UINT256):
        if lossless(a, c) and lossless(b, c):
            return c
    raise ValueError(f"no type holds both {a.name} and {b.name}")


def infer_scalar(value) -> DType:
    """Type of a Python constant: -1, 0 and 1 are ternary."""
    if isinstance(value, float):
        return DType.F64
    if value in (-1, 0, 1):
        return DType.INT3
    return DType.INT32 if -(1 << 31) <= value < 1 << 31 else DType.INT64


def holds(t: DType, value) -> bool:
    """value is exactly a value of t."""
    import struct

    s = t.value
    if s.real:
        if t in (DType.F16, DType.BF16) or t is DType.F64 and isinstance(value, float):
            return True  # half arrays stay half
        if t is DType.F32:
            try:
                return struct.unpack("f", struct.pack("f", value))[0] == value or value != value
            except OverflowError:
                return False
        return int(value) == float(value)
    if value != int(value):
        return False
    return (-(1 << s.digits) if s.signed else 0) <= value < 1 << s.digits


def promote_scalar(a: DType, value) -> DType:
    if holds(a, value):
        return a
    if isinstance(value, float):
        return promote(a, DType.F32 if holds(DType.F32, value) else DType.F64)
    return promote(a, DType.INT32 if holds(DType.INT32, value) else DType.INT64)


def unary_real(t: DType, within_24_bits: bool = False) -> DType:
    """Result type of exp and the like; within_24_bits: all lanes are known to be
    within +-2**24, which lets wide integers become F32."""
    if t is DType.UINT256:
        raise ValueError("no real function of UINT256")
    if t.value.real:
        return t
    return DType.F32 if t.value.digits <= 8 or within_24_bits else DType.F64


def sum_type(t: DType) -> DType:
    if t is DType.UINT256 or t is DType.F64:
        return t
    if t.value.real:
        return DType.F32
    return DType.INT32 if t.value.digits <= 8 else DType.INT64


def mean_type(t: DType) -> DType:
    return DType.F32 if t in (DType.F16, DType.BF16, DType.F32) else DType.F64


def negated_type(t: DType) -> DType:
    return DType.INT32 if t in (DType.BINARY, DType.UINT8) else t


def matmul_type(t: DType) -> DType:
    if t in (DType.F16, DType.BF16):
        return DType.F32
    if not t.value.real and t.value.digits <= 8:
        return DType.INT32
    return DType.INT64 if t is DType.INT32 else t


def wrap(c: Column, t: DType) -> Column:
    """c, computed in a wider integer type, reduced modulo t's width; not subject to ANSI errors."""
    if t is DType.BINARY:
        return c.bitwiseAND(F.lit(1)) != 0
    if t is DType.UINT8:
        return c.bitwiseAND(F.lit(255)).cast(t.storage)
    half, mask = {DType.INT3: (4, 7), DType.INT8: (128, 255)}.get(t, (1 << 31, (1 << 32) - 1))
    if t is DType.INT64:
        return wrap_decimal(c, 64).cast(t.storage)
    return ((c.cast("bigint") + F.lit(half)).bitwiseAND(F.lit(mask)) - F.lit(half)).cast(t.storage)


def wrap_decimal(c: Column, bits: int) -> Column:
    """Two's-complement wrap of a decimal(38, 0)."""
    size = F.lit(str(1 << bits)).cast("decimal(38,0)")
    half = F.lit(str(1 << bits - 1)).cast("decimal(38,0)")
    return F.pmod(c.cast("decimal(38,0)") + half, size) - half


def round_half(c: Column, t: DType) -> Column:
    """Nearest value of a half type, ties to even, in float arithmetic: subnormals,
    overflow to infinity and NaN included."""
    digits, least, most = (11, -14, 65504.0) if t is DType.F16 else (8, -126, 3.3895313892515355e38)
    x = c.cast("double")
    a = F.abs(x)
    e = F.floor(F.log2(a))
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
    step = F.pow(F.lit(2.0), F.greatest(e, F.lit(least)) - (digits - 1))
    y = F.rint(x / step) * step
    inf = F.lit(float("inf"))
    y = F.when(F.abs(y) > most, F.when(x > 0, inf).otherwise(-inf)).otherwise(y)
    return F.when((a == 0) | F.isnan(x) | (a == inf), x).otherwise(y).cast("float")


def convert(c: Column, source: DType, target: DType) -> Column:
    """Explicit conversion, which may lose: truncation to integers, then wrapping."""
    if target is DType.BINARY:
        return c if source is DType.BINARY else c > 0
    if source is DType.BINARY:
        c = c.cast("int")
    if target in (DType.F16, DType.BF16):
        return round_half(c, target)
    if target.value.real:
        return c.cast(target.storage)
    if source.value.real:
        c = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    return wrap(c.cast("bigint"), target) if target is not DType.INT64 else c.cast("bigint")

"""Fixed-width integers of 128 to 512 bits as big-endian BINARY.

Order, equality, joins and groups on them are Spark's own: unsigned byte order.
Arithmetic wraps modulo 2**bits; division by zero gives zero; signed operations read
two's complement.  Bit operations, comparisons, sums of groups and conversions are
expressions over limbs.  Sums, products and shifts run in Arrow batches, all rows of a
batch at once in numpy; quotients, powers and roots there too, on Python's integers.
The expressions hold no lambdas, since Spark doesn't find Python functions over them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS = (128, 192, 256, 384, 512)


def parse_hex(c: Column, bits: int = 256) -> Column:
    """From a hex string with or without 0x; of too many digits the leading ones stay."""
    digits = bits // 4
    return F.unhex(F.lpad(F.substring(F.regexp_replace(c, "^0[xX]", ""), 1, digits), digits, "0"))


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def from_bytes(c: Column, bits: int = 256, little: bool = False) -> Column:
    """From a byte string of bits / 8 bytes or fewer, the highest byte first or last."""
    return F.unhex(F.lpad(_turned(c) if little else F.hex(c), bits // 4, "0"))


def to_bytes(c: Column, little: bool = False) -> Column:
    return F.unhex(_turned(c)) if little else c


def _turned(c: Column) -> Column:
    """Hex digits of the bytes in the other order."""
    return F.regexp_replace(F.reverse(F.hex(c)), "(.)(.)", "$2$1")


def from_long(c: Column, bits: int = 256, signed: bool = False) -> Column:
    """From a long; with signed, negative ones keep their sign."""
    fill = F.when(c < 0, "F").otherwise("0") if signed else F.lit("0")
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), bits // 4, fill))


def _words(a: Column, bits: int, width: int = 4) -> list[Column]:
    """Limbs of width bytes, the highest first: longs, of eight bytes decimals."""
    kind = "bigint" if width < 8 else "decimal(20,0)"
    return [F.conv(F.hex(F.substring(a, width * k + 1, width)), 16, 10).cast(kind) for k in range(bits // 8 // width)]


def _carried(sums: Column, start: int, shift: int = 32) -> Column:
    """BINARY of limb sums, the lowest first, with their carries."""
    mask, digits = (1 << shift) - 1, shift // 4

    def carry(acc, s):
        t = acc["carry"] + s
        return F.struct(F.shiftright(t, shift).alias("carry"), F.concat(F.lpad(F.hex(t.bitwiseAND(F.lit(mask).cast("bigint"))), digits, "0"), acc["digits"]).alias("digits"))

    none = F.struct(F.lit(start).cast("bigint").alias("carry"), F.lit("").alias("digits"))
    return F.unhex(F.aggregate(sums, none, carry)["digits"])


def _limbwise(f):
    """Bit operation of two values, limb by limb."""

    def run(a: Column, b: Column, bits: int) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(f(x, y)), 8, "0") for x, y in zip(_words(a, bits), _words(b, bits))]))

    return run


NATIVE = {"and": _limbwise(lambda x, y: x.bitwiseAND(y)), "or": _limbwise(lambda x, y: x.bitwiseOR(y)), "xor": _limbwise(lambda x, y: x.bitwiseXOR(y))}


def _ripple(sums, shift: int):
    """Limbs of sums per row, the lowest last, after their carries."""
    import numpy as np

    mask, carry = np.uint64((1 << shift) - 1), np.zeros(len(sums), np.uint64)
    for k in range(sums.shape[1] - 1, -1, -1):
        t = sums[:, k] + carry
        sums[:, k], carry = t & mask, t >> np.uint64(shift)
    return sums


def _bytes_of(limbs, kind: str):
    import numpy as np

    return np.ascontiguousarray(limbs.astype(kind)).view(np.uint8).reshape(len(limbs), -1)


def _plus(a, b):
    import numpy as np

    return _bytes_of(_ripple(a.view(">u4").astype(np.uint64) + b.view(">u4").astype(np.uint64), 32), ">u4")


def _minus(a, b):
    import numpy as np

    sums = a.view(">u4").astype(np.uint64) + (np.uint64(0xFFFFFFFF) - b.view(">u4").astype(np.uint64))
    sums[:, -1] += np.uint64(1)
    return _bytes_of(_ripple(sums, 32), ">u4")


def _times(a, b):
    import numpy as np

    x, y = a.view(">u2").astype(np.uint64), b.view(">u2").astype(np.uint64)
    n = x.shape[1]
    out = np.zeros_like(x)
    for k in range(n):  # the limb of weight k of x, times all of y that stays within the width
        out[:, : n - k] += x[:, n - 1 - k, None] * y[:, k:]
    return _bytes_of(_ripple(out, 16), ">u2")


def _amounts(b, bits: int):
    """Wide shift amounts, bits at most."""
    import numpy as np

    low = b[:, -4:].copy().view(">u4")[:, 0].astype(np.int64)
    return np.where(b[:, :-4].any(1), bits, np.minimum(low, bits))


def _moved(a, by, fill):
    """Bits moved towards the end by so many places per row (negative: towards the front), with fill."""
    import numpy as np

    bits = np.unpackbits(a, axis=1)
    n = bits.shape[1]
    at = np.arange(n)[None, :] - by[:, None]
    return np.packbits(np.where((at >= 0) & (at < n), np.take_along_axis(bits, np.clip(at, 0, n - 1), 1), fill[:, None]), axis=1)


def _with_bit(a, b):
    import numpy as np

    n, by = a.shape[1] * 8, _amounts(b, a.shape[1] * 8)
    bits = np.unpackbits(a, axis=1)
    rows = np.flatnonzero(by < n)
    bits[rows, n - 1 - by[rows]] = 1
    return np.packbits(bits, axis=1)


#: Operations on all rows at once: arrays of bytes, a row per value.
BATCHED = {
    "add": _plus, "sub": _minus, "mul": _times, "set_bit": _with_bit,
    "shl": lambda a, b: _moved(a, -_amounts(b, a.shape[1] * 8), a[:, 0] * 0), "shr": lambda a, b: _moved(a, _amounts(b, a.shape[1] * 8), a[:, 0] * 0),
    "sar": lambda a, b: _moved(a, _amounts(b, a.shape[1] * 8), a[:, 0] >> 7),
}


def invert(a: Column, bits: int = 256) -> Column:
    """All bits the other way."""
    return F.unhex(F.translate(F.hex(a), "0123456789ABCDEF", "FEDCBA9876543210"))


def get_bit(a: Column, k: Column, bits: int = 256) -> Column:
    """Whether bit k, from the lowest, is set; false beyond the width."""
    byte = F.conv(F.hex(F.substring(a, F.lit(bits // 8) - F.floor(k / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (k >= 0) & (k < bits) & (F.call_function("shiftright", byte, (k % 8).cast("int")) % 2 == 1)


def negative(a: Column) -> Column:
    return F.hex(F.substring(a, 1, 1)) >= "80"


def less_than(a: Column, b: Column, signed: bool = False) -> Column:
    """a < b, unsigned as bytes order them, or in two's complement."""
    return F.when(negative(a) != negative(b), negative(a)).otherwise(a < b) if signed else a < b


def to_double(a: Column, bits: int = 256) -> Column:
    """The double nearest to the value but for the rounding of a sum of limbs, the highest first."""
    out = F.lit(0.0)
    for w in _words(a, bits, 8):
        out = out * float(1 << 64) + w.cast("double")
    return out


def from_double(x: Column, bits: int = 256) -> Column:
    """The whole part, modulo 2**bits; zero for NaN and infinities, two's complement for
    negative values."""

    @F.pandas_udf("binary")
    def run(x):
        import math

        import pandas as pd

        mask = (1 << bits) - 1
        whole = lambda v: int(v) & mask if math.isfinite(v) else 0
        return pd.Series([whole(v).to_bytes(bits // 8, "big") for v in x])

    return F.when(x.isNotNull(), run(F.coalesce(x, F.lit(0.0))))


def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> bits - 1 else x


def _trunc(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return -q if (a < 0) != (b < 0) else q


def root(a: int, n: int) -> int:
    """Exact floor of the n-th root."""
    if n <= 0:
        return 0
    lo, hi = 0, 1 << (a.bit_length() // n + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**n <= a else (lo, mid - 1)
    return lo


OPS = {
    "add": lambda a, b, n: a + b,
    "sub": lambda a, b, n: a - b,
    "mul": lambda a, b, n: a * b,
    "div": lambda a, b, n: a // b if b else 0,
    "mod": lambda a, b, n: a % b if b else 0,
    "sdiv": lambda a, b, n: _trunc(_signed(a, n), _signed(b, n)) if b else 0,
    "smod": lambda a, b, n: _signed(a, n) - _signed(b, n) * _trunc(_signed(a, n), _signed(b, n)) if b else 0,
    "pow": lambda a, b, n: pow(a, b, 1 << n),
    "root": lambda a, b, n: root(a, b),
    "and": lambda a, b, n: a & b,
    "or": lambda a, b, n: a | b,
    "xor": lambda a, b, n: a ^ b,
    "shl": lambda a, b, n: a << min(b, n),
    "shr": lambda a, b, n: a >> min(b, n),
    "sar": lambda a, b, n: _signed(a, n) >> min(b, n),
    "set_bit": lambda a, b, n: a | 1 << b if b < n else a,
}


def apply(op: str, a: Column, b: Column, bits: int = 256) -> Column:
    """op of OPS, element by element, null if either is null."""
    if op in NATIVE:
        return NATIVE[op](a, b, bits)
    f, all_rows, width, mask = OPS[op], BATCHED.get(op), bits // 8, (1 << bits) - 1

    @F.pandas_udf("binary")
    def run(x, y):
        import numpy as np
        import pandas as pd

        if all_rows:
            some = (x.notna() & y.notna()).to_numpy()
            sides = [np.frombuffer(b"".join(v[some]), np.uint8).reshape(-1, width) for v in (x, y)]
            raw, out = all_rows(*sides).tobytes(), np.full(len(x), None, object)
            out[some] = [raw[k : k + width] for k in range(0, len(raw), width)]
            return pd.Series(out)
        whole = lambda v: int.from_bytes(v, "big")
        return pd.Series([None if p is None or q is None else (f(whole(p), whole(q), bits) & mask).to_bytes(width, "big") for p, q in zip(x, y)], dtype=object)

    run.__name__ = op
    return run(a, b)


def bit_count(a: Column, bits: int = 256) -> Column:
    """Set bits."""
    return sum((F.bit_count(w) for w in _words(a, bits)), F.lit(0))


def bit_length(a: Column, bits: int = 256) -> Column:
    """Bits up to the highest one that is set."""
    digits = F.regexp_replace(F.hex(a), "^0+", "")
    return F.when(digits == "", 0).otherwise(4 * F.length(digits) - 4 + F.length(F.bin(F.conv(F.left(digits, F.lit(1)), 16, 10).cast("bigint"))))


def total(a: Column, bits: int = 256) -> Column:
    """The sum of a group, modulo 2**bits: native sums of 16-bit limbs, combined
    before the shuffle (exact for 2**47 rows), and their carries once per group."""
    n = bits // 16
    limb = lambda k: F.conv(F.hex(F.substring(a, 2 * k + 1, 2)), 16, 10).cast("bigint")
    return _carried(F.array(*[F.coalesce(F.sum(limb(k)), F.lit(0).cast("bigint")) for k in reversed(range(n))]), 0, 16)

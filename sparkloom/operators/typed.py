"""Typed arrays: a table of coordinates, a value expression over it, an element type and a shape.

Every operation takes its result type from the promotion rules of functions.dtypes,
casts both sides to it explicitly, and raises where no type holds both.  Operands over
one table are combined as expressions of one projection; those over different tables
meet in an equi-join on their shared axes.  Types and shapes are known on the driver, so
errors are raised when the plan is made; only real functions of 32- and 64-bit integers
and any()/all()/equal() look at the data.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dtypes, ieee, wideint
from ..functions.dtypes import DType
from . import arrays

_names = count()
_REAL = {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "log": ieee.log, "log2": ieee.log2, "log10": ieee.log10, "log1p": ieee.log1p, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg2rad": F.radians, "rad2deg": F.degrees,
    "silu": ieee.silu,
}
#: Accumulators of sum_as and its like: bits and sign of integers, 0 bits for real ones.
ACCUMULATORS = {"f32": (0, True), "f64": (0, True), "i32": (32, True), "i64": (64, True), "u32": (32, False), "u64": (64, False), "u256": (256, False)}


def _raise_if_zero(b: Column, value: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("integer division by zero"))).otherwise(value)


def cast(c: Column, source: DType, target: DType) -> Column:
    """c in the storage of a type that holds all its values."""
    if source is target:
        return c
    if target is DType.UINT256:
        return wideint.from_long(c.cast("int") if source is DType.BINARY else c)
    return (c.cast("int") if source is DType.BINARY else c).cast(target.storage)


def literal(value, t: DType) -> Column:
    if t is DType.UINT256:
        return F.lit(bytearray(int(value).to_bytes(32, "big")))
    if t is DType.BINARY:
        return F.lit(bool(value))
    out = F.lit(float(value) if t.value.real else int(value)).cast(t.storage)
    return dtypes.round_half(out, t) if t in (DType.F16, DType.BF16) else out


def combine(op: str, a: Column, b: Column, t: DType) -> Column:
    """a op b of two values of one type: integers wrap and divide toward zero, halves are rounded, the rest is IEEE."""
    if t is DType.UINT256:
        return wideint.apply(op, a, b)
    if t.value.real:
        x, y = (a, b) if t in (DType.F32, DType.F64) else (a.cast("double"), b.cast("double"))
        out = {"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: ieee.div(x, y), "mod": lambda: F.try_mod(x, y), "pow": lambda: F.pow(x, y)}[op]()
        if op == "mod":
            out = F.when(x.isNotNull() & y.isNotNull(), F.coalesce(out, F.lit(float("nan"))))
        return dtypes.round_half(out, t) if t in (DType.F16, DType.BF16) else out.cast(t.storage)
    wide = "decimal(38,0)" if t is DType.INT64 else "bigint"
    x, y = a.cast("int").cast(wide) if t is DType.BINARY else a.cast(wide), b.cast("int").cast(wide) if t is DType.BINARY else b.cast(wide)
    if op == "div":
        q = F.when(y == -1, -x).otherwise(F.call_function("div", x, F.when((y != 0) & (y != -1), y)).cast(wide))  # div of the least value by -1 wraps
        return dtypes.wrap(_raise_if_zero(y, q), t)
    if op == "mod":
        return dtypes.wrap(_raise_if_zero(y, x % F.when(y != 0, y)), t)
    return dtypes.wrap({"add": x + y, "sub": x - y, "mul": x * y}[op], t)


class NDArray:
    def __init__(self, df: DataFrame, axes: list[str], shape: list[int], value: Column, dtype: DType):
        if len(axes) != len(shape):
            raise ValueError("as many axes as sizes")
        arrays.check_shape(list(shape))
        self.df, self.axes, self.shape, self.value, self.dtype = df, list(axes), list(shape), value, dtype

    # construction
    @classmethod
    def of(cls, spark: SparkSession, values: list, shape: list[int] | None = None, dtype: DType | None = None) -> NDArray:
        """From a list; integers that are all -1, 0 or 1 are ternary."""
        shape = [len(values)] if shape is None else shape
        if arrays.check_shape(shape) != len(values):
            raise ValueError("the shape has another number of elements")
        if dtype is None:
            kinds = {dtypes.infer_scalar(v) for v in values}
            order = (DType.INT3, DType.INT32, DType.INT64, DType.F64)
            dtype = max(kinds, key=order.index) if kinds else DType.INT3
        bad = None if dtype.value.real or dtype is DType.UINT256 else next((v for v in values if not dtypes.holds(dtype, v)), None)
        if bad is not None:
            raise ValueError(f"{dtype.name} doesn't hold {bad!r}")
        if dtype is DType.UINT256:
            rows, kind = [(k, bytearray(int(v).to_bytes(32, "big"))) for k, v in enumerate(values)], "binary"
        elif dtype is DType.BINARY:
            rows, kind = [(k, bool(v)) for k, v in enumerate(values)], "boolean"
        else:
            rows, kind = [(k, float(v) if dtype.value.real else int(v)) for k, v in enumerate(values)], dtype.storage
        df = spark.createDataFrame(rows, f"flat long, v {kind}")
        value = dtypes.round_half(F.col("v"), dtype) if dtype in (DType.F16, DType.BF16) else F.col("v")
        return cls._from_flat(df, shape, value, dtype)

    @classmethod
    def full(cls, spark: SparkSession, shape: list[int], value, dtype: DType | None = None) -> NDArray:
        dtype = dtype or dtypes.infer_scalar(value)
        return cls._from_flat(spark.range(arrays.check_shape(shape)).withColumnRenamed("id", "flat"), shape, literal(value, dtype), dtype)

    @classmethod
    def _from_flat(cls, df: DataFrame, shape: list[int], value: Column, dtype: DType) -> NDArray:
        steps = arrays.strides(shape)
        cols = [F.floor(F.col("flat") / F.lit(s)).cast("bigint") % n if n else F.lit(0).cast("bigint") for s, n in zip(steps, shape)]
        axes = [f"i{d}" for d in range(len(shape))]
        return cls(df.select(*[c.alias(a) for c, a in zip(cols, axes)], value.alias("v")), axes, shape, F.col("v"), dtype)

    def like(self, value) -> NDArray:
        return self._with(literal(value, self.dtype), self.dtype)

    # meta
    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def packed_bytes(self) -> int:
        return -(-self.size * self.dtype.value.bits // 64) * 8 if self.dtype in (DType.BINARY, DType.INT3) else self.size * self.dtype.value.bits // 8

    def frame(self) -> DataFrame:
        """The coordinates and v."""
        return self.df.select(*[F.col(a) for a in self.axes], self.value.alias("v"))

    def _with(self, value: Column, dtype: DType) -> NDArray:
        return NDArray(self.df, self.axes, self.shape, value, dtype)

    def _settled(self) -> NDArray:
        """The same array with its value as a column of its table."""
        return NDArray(self.frame(), self.axes, self.shape, F.col("v"), self.dtype)

    # pairs
    def _beside(self, other: NDArray, broadcast: bool) -> tuple[NDArray, Column, Column]:
        """An array with the shape of the result, and both values over its table."""
        if other.df is self.df and other.axes == self.axes and other.shape == self.shape:
            return self, self.value, other.value
        shape = self.shape
        if self.shape != other.shape:
            if not broadcast:
                raise ValueError(f"shapes {self.shape} and {other.shape} differ")
            shape = broadcast_shape(self.shape, other.shape)
        n = next(_names)
        axes = [f"i{d}" for d in range(len(shape))]
        sides, shared = [], []
        for tag, x in (("x", self), ("y", other)):
            lead = len(shape) - len(x.shape)
            own = [d for d in range(len(shape)) if d >= lead and not (x.shape[d - lead] == 1 and shape[d] != 1)]
            sides.append((x.df.select(*[F.col(x.axes[d - lead]).alias(f"i{d}") for d in own], x.value.alias(f"{tag}{n}")), own))
            shared.append(set(own))
        keys = [f"i{d}" for d in sorted(shared[0] & shared[1])]
        (a, _), (b, _) = sides
        if keys:
            df = a.join(b, keys)
        elif self.size == 1:
            df = b.crossJoin(F.broadcast(a))  # one row
        elif other.size == 1:
            df = a.crossJoin(F.broadcast(b))  # one row
        else:  # an outer product: one side is repeated along the other's axes, which they then share
            for d in sorted(shared[1]):
                a = _repeat(a, f"i{d}", shape[d])
            df = a.join(b, [f"i{d}" for d in sorted(shared[1])])
        for d in range(len(shape)):
            if d not in shared[0] | shared[1]:
                df = _repeat(df, f"i{d}", shape[d])
        joined = NDArray(df, axes, shape, F.col(f"x{n}"), self.dtype)
        return joined, F.col(f"x{n}"), F.col(f"y{n}")

    def _binary(self, op: str, other, broadcast: bool = False, keep_binary: bool = False) -> NDArray:
        if isinstance(other, NDArray):
            t = self.dtype if keep_binary and self.dtype is other.dtype is DType.BINARY else dtypes.promote(self.dtype, other.dtype)
            base, a, b = self._beside(other, broadcast)
            a, b = cast(a, self.dtype, t), cast(b, other.dtype, t)
        else:
            t = dtypes.promote_scalar(self.dtype, other)
            base, a, b = self, cast(self.value, self.dtype, t), literal(other, t)
        return base._with(self._apply(op, a, b, t), t)

    @staticmethod
    def _apply(op: str, a: Column, b: Column, t: DType) -> Column:
        if op in ("minimum", "maximum"):
            if t.value.real:
                return (ieee.fmin if op == "minimum" else ieee.fmax)(a, b)
            return (F.least if op == "minimum" else F.greatest)(a, b)
        return combine(op, a, b, t)

    def add(self, other, broadcast=False):
        return self._binary("add", other, broadcast)

    def sub(self, other, broadcast=False):
        return self._binary("sub", other, broadcast)

    def mul(self, other, broadcast=False):
        return self._binary("mul", other, broadcast)

    def div(self, other, broadcast=False):
        return self._binary("div", other, broadcast)

    def mod(self, other, broadcast=False):
        return self._binary("mod", other, broadcast)

    def minimum(self, other, broadcast=False):
        return self._binary("minimum", other, broadcast, keep_binary=True)

    def maximum(self, other, broadcast=False):
        return self._binary("maximum", other, broadcast, keep_binary=True)

    def clip(self, low, high):
        return self.maximum(low).minimum(high)

    __add__, __sub__, __mul__, __truediv__, __mod__, __radd__, __rmul__ = add, sub, mul, div, mod, add, mul

    def __rsub__(self, value):
        return (-self).add(value)

    def __rtruediv__(self, value):
        t = dtypes.promote_scalar(self.dtype, value)
        return self._with(combine("div", literal(value, t), cast(self.value, self.dtype, t), t), t)

    def pow(self, n) -> NDArray:
        """Power: integers by squaring, wrapped, and no negative exponents; real types by pow."""
        if self.dtype.value.real:
            return self._binary("pow", n)
        if n != int(n) or n < 0:
            raise ValueError("integers have whole powers from 0")
        t, out, base, n = self.dtype, None, self.value, int(n)
        if t is DType.UINT256:
            return self._with(wideint.apply("pow", base, literal(n, t)), t)
        while n:
            if n & 1:
                out = base if out is None else combine("mul", out, base, t)
            base, n = combine("mul", base, base, t), n >> 1
        return self._with(literal(1, t) if out is None else out, t)

    # one operand
    def __neg__(self) -> NDArray:
        t = dtypes.negated_type(self.dtype)
        if t is DType.UINT256:
            return self._with(wideint.apply("sub", literal(0, t), self.value), t)
        return self._with(-self.value if t.value.real else combine("sub", literal(0, t), cast(self.value, self.dtype, t), t), t)

    def abs(self) -> NDArray:
        t = self.dtype
        if t in (DType.BINARY, DType.UINT8, DType.UINT256):
            return self
        return self._with(F.abs(self.value) if t.value.real else dtypes.wrap(F.abs(self.value.cast("decimal(38,0)" if t is DType.INT64 else "bigint")), t), t)

    def sign(self) -> NDArray:
        t = self.dtype
        if t is DType.UINT256:
            return self._with(F.when(self.value == literal(0, t), literal(0, t)).otherwise(literal(1, t)), t)
        return self if t is DType.BINARY else self._with(ieee.sign(self.value).cast(t.storage), t)

    def square(self) -> NDArray:
        t = self.dtype
        return self if t is DType.BINARY else self._with(combine("mul", self.value, self.value, t), t)

    def real(self, name: str) -> NDArray:
        """sqrt and its like, by name.  For 32- and 64-bit integers F32 if every lane is within 2**24, which is looked up."""
        within = False
        if self.dtype in (DType.INT32, DType.INT64):
            most = self.df.agg(F.max(F.abs(self.value.cast("decimal(20,0)")))).first()[0]
            within = most is None or most <= 1 << 24
        t = dtypes.unary_real(self.dtype, within)
        x = cast(self.value, self.dtype, t) if dtypes.lossless(self.dtype, t) else self.value.cast(t.storage)
        out = _REAL[name](x.cast("double"))
        return self._with(dtypes.round_half(out, t) if t in (DType.F16, DType.BF16) else out.cast(t.storage), t)

    def rounded(self, how: str) -> NDArray:
        """floor, ceil or round; integers stay."""
        if not self.dtype.value.real:
            return self
        x = self.value.cast("double")
        whole = {"floor": F.floor(x), "ceil": F.ceil(x), "round": F.round(x)}[how].cast("double")
        return self._with(F.when(ieee.is_finite(x) & (F.abs(x) < float(1 << 52)), whole).otherwise(x).cast(self.dtype.storage), self.dtype)

    def real_pair(self, name: str, other: NDArray) -> NDArray:
        """atan2 or hypot: in the promoted type of two real arrays, else in F64."""
        t = dtypes.promote(self.dtype, other.dtype) if self.dtype.value.real and other.dtype.value.real else DType.F64
        base, a, b = self._beside(other, False)
        x, y = (v.cast("int").cast("double") if d is DType.BINARY else v.cast("double") for v, d in ((a, self.dtype), (b, other.dtype)))
        out = {"atan2": F.atan2, "hypot": F.hypot}[name](x, y)
        return base._with(dtypes.round_half(out, t) if t in (DType.F16, DType.BF16) else out.cast(t.storage), t)

    def convert(self, t: DType) -> NDArray:
        """Explicit conversion, which may lose."""
        if t is self.dtype:
            return self
        if t is DType.UINT256:
            real = self.dtype.value.real
            v = wideint.from_double(self.value.cast("double")) if real else wideint.from_long(self.value.cast("int") if self.dtype is DType.BINARY else self.value, signed=True)
            return self._with(v, t)
        if self.dtype is DType.UINT256:
            if t.value.real:
                return self._with(dtypes.convert(wideint.to_double(self.value), DType.F64, t), t)
            low = F.conv(F.hex(F.substring(self.value, 25, 8)), 16, -10).cast("bigint")
            return self._with(self.value != literal(0, DType.UINT256) if t is DType.BINARY else dtypes.wrap(low, t) if t is not DType.INT64 else low, t)
        return self._with(dtypes.convert(self.value, self.dtype, t), t)

    # comparisons and masks
    def _compare(self, other, op) -> NDArray:
        """op of both in their common type, false if either is NaN."""
        real = False
        if isinstance(other, NDArray):
            t = DType.BINARY if self.dtype is other.dtype is DType.BINARY else dtypes.promote(self.dtype, other.dtype)
            base, a, b = self._beside(other, False)
            a, b, real = cast(a, self.dtype, t), cast(b, other.dtype, t), t.value.real
        else:
            if self.dtype in (DType.INT64, DType.UINT256):
                raise ValueError(f"{self.dtype.name} can't be compared with a scalar without loss")
            base, a, b, real = self, (self.value.cast("int") if self.dtype is DType.BINARY else self.value).cast("double"), F.lit(float(other)), True
        return base._with(op(a, b) & ~F.isnan(a) & ~F.isnan(b) if real else op(a, b), DType.BINARY)

    def eq(self, other):
        return self._compare(other, lambda a, b: a == b)

    def ne(self, other):
        return self.eq(other).logical_not()

    def lt(self, other):
        return self._compare(other, lambda a, b: a < b)

    def le(self, other):
        return self._compare(other, lambda a, b: a <= b)

    def gt(self, other):
        return self._compare(other, lambda a, b: a > b)

    def ge(self, other):
        return self._compare(other, lambda a, b: a >= b)

    def compare(self, other) -> NDArray:
        """-1, 0 or 1 as INT3; 0 if either is NaN."""
        if isinstance(other, NDArray) and other.df is not self.df:
            base, a, b = self._beside(other, False)
            return base._with(a, self.dtype).compare(base._with(b, other.dtype))
        less, more = self.lt(other), self.gt(other)
        return self._with(F.when(less.value, -1).when(more.value, 1).otherwise(0).cast("tinyint"), DType.INT3)

    def truth(self) -> NDArray:
        """Nonzero; NaN is true."""
        t = self.dtype
        return self if t is DType.BINARY else self._with(self.value != literal(0, t), DType.BINARY)

    def logical_not(self) -> NDArray:
        return self._with(~self.truth().value, DType.BINARY)

    def _logical(self, other, f) -> NDArray:
        mine = self.truth()
        if isinstance(other, bool):
            return self._with(f(mine.value, F.lit(other)), DType.BINARY)
        base, a, b = mine._beside(other.truth(), False)
        return base._with(f(a, b), DType.BINARY)

    def logical_and(self, other):
        return self._logical(other, lambda a, b: a & b)

    def logical_or(self, other):
        return self._logical(other, lambda a, b: a | b)

    def logical_xor(self, other):
        return self._logical(other, lambda a, b: a != b)

    def any(self) -> bool:
        return bool(self.df.agg(F.bool_or(self.truth().value)).first()[0])

    def all(self) -> bool:
        return self.df.agg(F.bool_and(self.truth().value)).first()[0] is not False

    def predicate(self, name: str) -> NDArray:
        """isnan, isinf or isfinite; of integers false, false and true."""
        if not self.dtype.value.real:
            return self._with(F.lit(name == "isfinite"), DType.BINARY)
        return self._with({"isnan": F.isnan, "isinf": ieee.is_inf, "isfinite": ieee.is_finite}[name](self.value.cast("double")), DType.BINARY)

    def equal(self, other: NDArray) -> bool:
        """Type, shape and every element alike as bits: -0 isn't 0, a NaN is a NaN (payloads aren't told apart)."""
        if self.dtype is not other.dtype or self.shape != other.shape:
            return False
        base, a, b = self._beside(other, False)
        same = a.eqNullSafe(b)
        if self.dtype.value.real:
            minus = lambda v: v.cast("string").startswith("-")
            same = same & (minus(a) == minus(b))  # Spark's = takes NaN for NaN and -0 for 0
        got = base.df.agg(F.count("*"), F.count_if(same)).first()
        return got[0] == got[1] == self.size

    # reductions
    def _reduce(self, agg: Column, dtype: DType, axis: int | None) -> NDArray:
        if axis is None:
            return NDArray(self.df.agg(agg.alias("v")), [], [], F.col("v"), dtype)
        keep = [a for k, a in enumerate(self.axes) if k != axis]
        shape = [n for k, n in enumerate(self.shape) if k != axis]
        out = self.df.groupBy(*keep).agg(agg.alias("v")) if keep else self.df.agg(agg.alias("v"))
        return NDArray(out, keep, shape, F.col("v"), dtype)

    def _check(self, axis: int | None) -> None:
        if not self.size:
            raise ValueError("nothing to reduce")
        if axis is not None and not 0 <= axis < len(self.shape):
            raise ValueError("no such axis")

    def _sum_of(self, t: DType) -> Column:
        if t is DType.UINT256:
            return wideint.total(cast(self.value, self.dtype, t))
        if t.value.real:
            return F.sum(self.value.cast("double")).cast(t.storage)
        x = self.value.cast("int") if self.dtype is DType.BINARY else self.value
        return dtypes.wrap(F.sum(x.cast("decimal(20,0)" if t is DType.INT64 else "bigint")), t)

    def sum(self, axis: int | None = None) -> NDArray:
        self._check(axis)
        t = dtypes.sum_type(self.dtype)
        return self._reduce(self._sum_of(t), t, axis)

    def prod(self, axis: int | None = None) -> NDArray:
        self._check(axis)
        t = dtypes.sum_type(self.dtype)
        if t.value.real:
            return self._reduce(F.product(self.value.cast("double")).cast(t.storage), t, axis)
        return self._whole_product(t, axis, 64 if t is not DType.UINT256 else 256)

    def _whole_product(self, t: DType | None, axis: int | None, bits: int) -> NDArray:
        """Products modulo 2**bits: one per group and batch of rows first, so that few rows are shuffled."""
        keep = [] if axis is None else [a for k, a in enumerate(self.axes) if k != axis]
        value = self.value.cast("int") if self.dtype is DType.BINARY else self.value
        value = cast(value, self.dtype, DType.UINT256) if bits == 256 and self.dtype in (DType.BINARY, DType.UINT8) else wideint.from_long(value, signed=True) if self.dtype is not DType.UINT256 else value
        rows = self.df.select(*keep, value.alias("v"))
        whole, mask = (lambda v: int.from_bytes(v, "big")), (1 << 256) - 1

        def batches(parts):
            import pandas as pd

            for pdf in parts:
                groups = pdf.groupby(keep, sort=False)["v"] if keep else [((), pdf["v"])]
                out = [(*(k if isinstance(k, tuple) else (k,)), reduce(lambda a, b: a * whole(b) & mask, g, 1).to_bytes(32, "big")) for k, g in groups]
                yield pd.DataFrame(out, columns=[*keep, "v"])

        partial = rows.mapInPandas(batches, rows.schema)

        def times(v):
            return reduce(lambda a, b: a * whole(b) & mask, v, 1).to_bytes(32, "big")

        times = F.pandas_udf(times, "binary", F.PandasUDFType.GROUPED_AGG)  # over one row per batch
        out = partial.groupBy(*keep).agg(times("v").alias("w"))
        if t is not DType.UINT256 and t is not None:
            low = F.conv(F.hex(F.substring("w", 25, 8)), 16, -10).cast("bigint")
            value = dtypes.wrap(low, t) if t is not DType.INT64 else low
        else:
            value = F.col("w")
        shape = [] if axis is None else [n for k, n in enumerate(self.shape) if k != axis]
        return NDArray(out.select(*keep, value.alias("v")), keep, shape, F.col("v"), t or DType.UINT256)

    def mean(self, axis: int | None = None) -> NDArray:
        self._check(axis)
        t = dtypes.mean_type(self.dtype)
        x = wideint.to_double(self.value) if self.dtype is DType.UINT256 else (self.value.cast("int") if self.dtype is DType.BINARY else self.value).cast("double")
        return self._reduce(F.avg(x).cast(t.storage), t, axis)

    def _extreme(self, f, axis: int | None) -> NDArray:
        self._check(axis)
        v = self.value
        if self.dtype.value.real:
            return self._reduce(F.coalesce(f(arrays.nan_free(v)), F.lit(float("nan"))).cast(self.dtype.storage), self.dtype, axis)
        return self._reduce(f(v), self.dtype, axis)

    def min(self, axis: int | None = None) -> NDArray:
        return self._extreme(F.min, axis)

    def max(self, axis: int | None = None) -> NDArray:
        return self._extreme(F.max, axis)

    def _arg(self, f, axis: int | None) -> NDArray:
        self._check(axis)
        at = arrays.flat_index(self.axes, self.shape) if axis is None else F.col(self.axes[axis]).cast("bigint")
        v = self.value.cast("int") if self.dtype is DType.BINARY else self.value
        if not self.dtype.value.real:
            least = F.min(F.struct(v.alias("v"), at.alias("i")))["i"]
            most = -F.max(F.struct(v.alias("v"), (-at).alias("i")))["i"]
            return self._reduce(least if f is arrays.arg_min else most, DType.INT64, axis)
        return self._reduce(F.coalesce(f(v, at), F.lit(0).cast("bigint")), DType.INT64, axis)

    def argmin(self, axis: int | None = None) -> NDArray:
        """Index of the first smallest element; NaN never wins."""
        return self._arg(arrays.arg_min, axis)

    def argmax(self, axis: int | None = None) -> NDArray:
        return self._arg(arrays.arg_max, axis)

    def count_nonzero(self) -> NDArray:
        return self._reduce(F.count_if(self.truth().value), DType.INT64, None)

    # reductions into an accumulator of the caller's choice, as a row with v
    def _lanes(self, acc: str) -> Column:
        """Lanes as whole numbers, real ones cut toward zero."""
        if self.dtype is DType.BINARY:
            return self.value.cast("int").cast("decimal(20,0)")
        if not self.dtype.value.real:
            return self.value.cast("decimal(20,0)")
        x = self.value.cast("double")
        return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("decimal(20,0)")

    def _settle(self, total: Column, acc: str) -> Column:
        bits, signed = ACCUMULATORS[acc]
        if bits == 32 and signed:
            return dtypes.wrap_decimal(total, 32).cast("int")
        if bits == 64 and signed:
            return dtypes.wrap_decimal(total, 64).cast("bigint")
        return F.pmod(total.cast("decimal(38,0)"), F.lit(str(1 << bits)).cast("decimal(38,0)")).cast("decimal(20,0)")

    def sum_as(self, acc: str) -> DataFrame:
        self._check(None)
        bits, _ = ACCUMULATORS[acc]
        if not bits:
            x = wideint.to_double(self.value) if self.dtype is DType.UINT256 else (self.value.cast("int") if self.dtype is DType.BINARY else self.value).cast("double")
            return self.df.agg(F.sum(x).cast("float" if acc == "f32" else "double").alias("v"))
        if bits == 256 or self.dtype is DType.UINT256:
            return self.df.agg(wideint.total(self.convert(DType.UINT256).value).alias("w")).select(_cut(F.col("w"), acc).alias("v"))
        return self.df.agg(F.sum(self._lanes(acc)).alias("w")).select(self._settle(F.col("w"), acc).alias("v"))

    def prod_as(self, acc: str) -> DataFrame:
        self._check(None)
        if not ACCUMULATORS[acc][0]:
            x = wideint.to_double(self.value) if self.dtype is DType.UINT256 else (self.value.cast("int") if self.dtype is DType.BINARY else self.value).cast("double")
            return self.df.agg(F.product(x).cast("float" if acc == "f32" else "double").alias("v"))
        whole = self.convert(DType.UINT256) if self.dtype.value.real else self
        return whole._whole_product(None, None, 256).df.select(_cut(F.col("v"), acc).alias("v"))

    def mean_as(self, acc: str) -> DataFrame:
        """sum_as over the number of elements; in whole accumulators cut toward zero."""
        total = self.sum_as(acc)
        if not ACCUMULATORS[acc][0]:
            return total.select((F.col("v") / self.size).cast("float" if acc == "f32" else "double").alias("v"))
        if acc == "u256":
            return total.select(wideint.apply("div", F.col("v"), literal(self.size, DType.UINT256)).alias("v"))
        q = F.floor(F.abs(F.col("v")).cast("decimal(20,0)") / F.lit(self.size))
        return total.select(F.when(F.col("v") < 0, -q).otherwise(q).cast(total.schema["v"].dataType).alias("v"))

    def dot(self, other: NDArray, acc: DType = DType.F64) -> NDArray:
        """Inner product of two arrays of one length: whole numbers exactly (modulo the accumulator), real ones in double."""
        if len(self.shape) != 1 or self.shape != other.shape:
            raise ValueError(f"lengths {self.shape} and {other.shape} differ")
        base, a, b = self._beside(other, False)
        if self.dtype.value.real or other.dtype.value.real or acc.value.real:
            v = lambda x, d: wideint.to_double(x) if d is DType.UINT256 else (x.cast("int") if d is DType.BINARY else x).cast("double")
            return base._reduce(F.coalesce(F.sum(v(a, self.dtype) * v(b, other.dtype)), F.lit(0.0)).cast(acc.storage), acc, None)
        if DType.UINT256 in (acc, self.dtype, other.dtype):
            both = base._with(wideint.apply("mul", cast(a, self.dtype, DType.UINT256), cast(b, other.dtype, DType.UINT256)), DType.UINT256)
            return both._reduce(wideint.total(both.value), DType.UINT256, None)
        v = lambda x, d: (x.cast("int") if d is DType.BINARY else x).cast("decimal(19,0)")
        product = (v(a, self.dtype) * v(b, other.dtype)).cast("decimal(38,0)")
        bits = acc.value.bits
        rest = F.pmod(product, F.lit(str(1 << bits)).cast("decimal(38,0)")).cast("decimal(20,0)")
        return base._reduce(dtypes.wrap_decimal(F.coalesce(F.sum(rest), F.lit(0).cast("decimal(30,0)")), bits).cast(acc.storage), acc, None)

    # activations
    def _along(self, axis: int) -> tuple[str, list[str]]:
        """An axis, which may count from the end, and the others."""
        if not -len(self.shape) <= axis < len(self.shape):
            raise ValueError("no such axis")
        name = self.axes[axis]
        return name, [a for a in self.axes if a != name]

    def _as_real(self) -> tuple[DType, Column]:
        t = dtypes.unary_real(self.dtype)
        return t, (self.value.cast("int") if self.dtype is DType.BINARY else self.value).cast("double")

    def _summed(self, df: DataFrame, keep: list[str], **aggs: Column) -> DataFrame:
        """df with aggregates over its groups beside each row: combined before they are shuffled, so a long group is no single task."""
        per = df.groupBy(*keep).agg(*[c.alias(n) for n, c in aggs.items()])
        return df.join(per, keep) if keep else df.crossJoin(F.broadcast(per))  # without other axes it is one row

    def softmax(self, axis: int = -1) -> NDArray:
        """exp(x - max) over its sum along an axis; a sum of zero gives zeros, a scalar gives 1."""
        t, x = self._as_real()
        if not self.shape:
            return self._with(literal(1, t), t)
        _, keep = self._along(axis)
        df = self._summed(self.df.select(*[F.col(a) for a in self.axes], x.alias("v")), keep, most=F.max("v"))
        df = self._summed(df.withColumn("v", F.exp(F.col("v") - F.col("most"))).drop("most"), keep, total=F.sum("v"))
        v = F.when(F.col("total") == 0, 0.0).otherwise(F.col("v") / F.when(F.col("total") != 0, F.col("total")))
        return NDArray(df, self.axes, self.shape, dtypes.round_half(v, t) if t in (DType.F16, DType.BF16) else v.cast(t.storage), t)

    def rmsnorm(self, weight: NDArray, axis: int = -1, eps: float = 1e-6) -> NDArray:
        """x w / sqrt(mean of x squared along an axis + eps); the weight has the axis's length or the array's shape."""
        t, x = self._as_real()
        name, keep = self._along(axis)
        at = self.axes.index(name)
        if weight.shape != self.shape and weight.shape != [self.shape[at]]:
            raise ValueError(f"a weight of {weight.shape} for {self.shape}")
        df = self._summed(self.df.select(*[F.col(a) for a in self.axes], x.alias("v")), keep, square=F.avg(F.col("v") * F.col("v")))
        on = self.axes if weight.shape == self.shape and len(weight.shape) > 1 else [name]
        w = weight.df.select(*[F.col(a).alias(b) for a, b in zip(weight.axes, on)], weight.value.cast("double").alias("w"))
        v = F.col("v") * F.col("w") / F.sqrt(F.col("square") + F.lit(eps))
        return NDArray(df.join(w, on), self.axes, self.shape, dtypes.round_half(v, t) if t in (DType.F16, DType.BF16) else v.cast(t.storage), t)

    def silu_mul(self, other: NDArray) -> NDArray:
        return self.real("silu").mul(other)

    # views
    def _view(self, df: DataFrame, axes: list[str], shape: list[int]) -> NDArray:
        return NDArray(df, axes, shape, F.col("v"), self.dtype)

    def slice_index(self, axis: int, k: int) -> NDArray:
        self._index(axis, k)
        rest = [d for d in range(len(self.shape)) if d != axis]
        return self._view(self.frame().where(F.col(self.axes[axis]) == k).drop(self.axes[axis]), [self.axes[d] for d in rest], [self.shape[d] for d in rest])

    def _index(self, axis: int, k: int) -> None:
        if not 0 <= axis < len(self.shape) or not 0 <= k < self.shape[axis]:
            raise IndexError(f"index {k} on axis {axis} of {self.shape}")

    def slice_range(self, axis: int, start: int, end: int) -> NDArray:
        if not 0 <= axis < len(self.shape) or not 0 <= start <= end <= self.shape[axis]:
            raise IndexError(f"range {start}:{end} on axis {axis} of {self.shape}")
        shape = [end - start if d == axis else n for d, n in enumerate(self.shape)]
        return self._view(arrays.take_range(self.frame(), self.axes[axis], start, end), self.axes, shape)

    def permute(self, order: list[int]) -> NDArray:
        df = arrays.permute(self.frame(), self.axes, order)
        return self._view(df, self.axes, [self.shape[k] for k in order])

    def transpose(self) -> NDArray:
        return self.permute(list(range(len(self.shape)))[::-1])

    def reshape(self, shape: list[int]) -> NDArray:
        return self._view(arrays.reshape(self.frame(), self.axes, self.shape, shape), [f"i{d}" for d in range(len(shape))], shape)

    def broadcast_to(self, shape: list[int]) -> NDArray:
        """Stretched along missing leading axes and axes of one."""
        if broadcast_shape(self.shape, shape) != list(shape):
            raise ValueError(f"{self.shape} can't be stretched to {shape}")
        lead = len(shape) - len(self.shape)
        own = [d for d in range(len(shape)) if d >= lead and not (self.shape[d - lead] == 1 and shape[d] != 1)]
        df = self.df.select(*[F.col(self.axes[d - lead]).alias(f"i{d}") for d in own], self.value.alias("v"))
        for d in range(len(shape)):
            if d not in own:
                df = _repeat(df, f"i{d}", shape[d])
        return self._view(df, [f"i{d}" for d in range(len(shape))], list(shape))

    # linear algebra
    def matmul(self, other: NDArray) -> NDArray:
        """Ranks 1 to 3, equal types; a matrix is stretched over the other's batch, a batch of one is dropped; an empty K gives zeros."""
        if self.dtype is not other.dtype:
            raise ValueError(f"types {self.dtype.name} and {other.dtype.name} differ")
        if not (1 <= len(self.shape) <= 3 and 1 <= len(other.shape) <= 3):
            raise ValueError("ranks 1 to 3")
        a = self.reshape([1, *self.shape]) if len(self.shape) == 1 else self._settled()
        b = other.reshape([*other.shape, 1]) if len(other.shape) == 1 else other._settled()
        m, k, k2, n = *a.shape[-2:], *b.shape[-2:]
        if k != k2:
            raise ValueError(f"inner sizes {k} and {k2} differ")
        batches = [x.shape[0] if len(x.shape) == 3 else 1 for x in (a, b)]
        if batches[0] != batches[1] and 1 not in batches:
            raise ValueError(f"batches {batches} differ")
        p, t = max(batches) if 0 not in batches else 0, dtypes.matmul_type(self.dtype)
        shape = ([p] if p != 1 else []) + ([m] if len(self.shape) > 1 else []) + ([n] if len(other.shape) > 1 else [])
        names = (["p"] if p != 1 else []) + (["i"] if len(self.shape) > 1 else []) + (["j"] if len(other.shape) > 1 else [])
        spark = self.df.sparkSession
        if not prod(shape) or not k:
            zero = NDArray.full(spark, shape, 0, t)
            return zero
        sides = []
        for x, axes, size in ((a, ("i", "k"), batches[0]), (b, ("k", "j"), batches[1])):
            cols = [F.col(x.axes[-2]).alias(axes[0]), F.col(x.axes[-1]).alias(axes[1]), x.value.alias("x" if "i" in axes else "y")]
            sides.append(x.df.select(*([F.col(x.axes[0]).alias("p")] if size > 1 else []), *cols))
        on = (["p"] if min(batches) > 1 else []) + ["k"]
        x, y = F.col("x"), F.col("y")
        d = self.dtype
        if d is DType.UINT256:
            total = wideint.total(wideint.apply("mul", x, y))
        elif t.value.real:
            total = F.sum(x.cast("double") * y.cast("double")).cast(t.storage)
        elif d is DType.INT64:
            limb = F.lit(str(1 << 64)).cast("decimal(38,0)")
            total = dtypes.wrap(F.sum(F.pmod((x.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)"), limb).cast("decimal(20,0)")), t)
        else:
            w = (lambda v: v.cast("int")) if d is DType.BINARY else (lambda v: v)
            total = dtypes.wrap(F.sum((w(x).cast("bigint") * w(y).cast("bigint")).cast("decimal(20,0)" if t is DType.INT64 else "bigint")), t)
        df = sides[0].join(sides[1], on)
        out = df.groupBy(*names).agg(total.alias("v")) if names else df.agg(total.alias("v"))
        return NDArray(out, names, shape, F.col("v"), t)


def _repeat(df: DataFrame, axis: str, n: int) -> DataFrame:
    """A new axis of n equal copies."""
    if not n:
        return df.where("false").withColumn(axis, F.lit(0).cast("bigint"))
    return arrays.expand(df, axis, n).withColumn(axis, F.col(axis).cast("bigint"))


def broadcast_shape(a: list[int], b: list[int]) -> list[int]:
    """The common shape of two, aligned at their last axes."""
    out = []
    for k in range(1, max(len(a), len(b)) + 1):
        x, y = a[-k] if k <= len(a) else 1, b[-k] if k <= len(b) else 1
        if x != y and 1 not in (x, y):
            raise ValueError(f"shapes {a} and {b} can't be aligned")
        out.insert(0, y if x == 1 else x)
    return out


def _cut(w: Column, acc: str) -> Column:
    """A 256-bit value in an accumulator's type."""
    bits, signed = ACCUMULATORS[acc]
    if bits == 256:
        return w
    low = F.conv(F.hex(F.substring(w, 33 - bits // 8, bits // 8)), 16, 10).cast("decimal(20,0)")
    return dtypes.wrap_decimal(low, bits).cast("int" if bits == 32 else "bigint") if signed else low


def where(cond: NDArray, x, y) -> NDArray:
    return piecewise([(cond, x)], y)


def _arm_type(arms: list) -> DType:
    """Arrays are promoted, then scalars: real ones to F64, whole ones as they are inferred."""
    of = [a.dtype for a in arms if isinstance(a, NDArray)]
    scalars = [a for a in arms if not isinstance(a, NDArray)]
    kinds = of + [DType.F64 if isinstance(s, float) else dtypes.infer_scalar(s) for s in scalars]
    return reduce(lambda a, b: a if a is b else dtypes.promote(a, b), kinds)


def piecewise(cases: list[tuple[NDArray, object]], otherwise) -> NDArray:
    """The value of the first true mask; values are arrays or scalars, all over one table or of one shape."""
    arms = [v for _, v in cases] + [otherwise]
    t = _arm_type(arms)
    members = [m.truth() for m, _ in cases] + [a for a in arms if isinstance(a, NDArray)]
    base = members[0]
    if any(x.shape != base.shape for x in members):
        raise ValueError(f"shapes {[x.shape for x in members]} differ")
    if all(x.df is base.df and x.axes == base.axes for x in members):
        parts = [x.value for x in members]
    else:
        axes, df = [f"i{d}" for d in range(len(base.shape))], None
        for k, x in enumerate(members):
            one = x.df.select(*[F.col(a).alias(b) for a, b in zip(x.axes, axes)], x.value.alias(f"p{k}"))
            df = one if df is None else df.join(one, axes) if axes else df.crossJoin(F.broadcast(one))  # rank 0: one row each
        base, parts = NDArray(df, axes, base.shape, F.col("p0"), base.dtype), [F.col(f"p{k}") for k in range(len(members))]
    masks, rest = parts[: len(cases)], iter(parts[len(cases) :])
    values = [cast(next(rest), a.dtype, t) if isinstance(a, NDArray) else literal(a, t) for a in arms]
    return base._with(ieee.piecewise(list(zip(masks, values[:-1])), values[-1]), t)

"""Operators on arrays in coordinate layout: (i0, i1, ..., v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strides(shape: list[int]) -> list[int]:
    out, step = [], 1
    for n in reversed(shape):
        out.insert(0, step)
        step *= n
    return out


def check_shape(shape: list[int]) -> int:
    size = 1
    for n in shape:
        if n < 0:
            raise ValueError("negative axis")
        size *= n
    if size >= 1 << 63:
        raise ValueError("too many elements")
    return size


def flat_index(axes: list[str], shape: list[int]) -> Column:
    return sum((F.col(a).cast("bigint") * s for a, s in zip(axes, strides(shape))), F.lit(0).cast("bigint"))


def take_index(df: DataFrame, axis: str, k: int) -> DataFrame:
    return df.where(F.col(axis) == k).drop(axis)


def take_range(df: DataFrame, axis: str, start: int, end: int) -> DataFrame:
    return df.where((F.col(axis) >= start) & (F.col(axis) < end)).withColumn(axis, F.col(axis) - start)


def permute(df: DataFrame, axes: list[str], order: list[int]) -> DataFrame:
    if sorted(order) != list(range(len(axes))):
        raise ValueError("not a permutation")
    return df.select(*[F.col(axes[k]).alias(axes[d]) for d, k in enumerate(order)], "v")


def reshape(df: DataFrame, axes: list[str], shape: list[int], new: list[int]) -> DataFrame:
    if check_shape(shape) != check_shape(new):
        raise ValueError("other number of elements")
    flat = flat_index(axes, shape)
    cols = [(F.floor(flat / s) % n).cast("bigint").alias(f"i{d}") for d, (s, n) in enumerate(zip(strides(new), new))]
    return df.select(*cols, "v")


def is_contiguous(shape: list[int], steps: list[int]) -> bool:
    """Elements of a view lie densely in row-major order (axes of one may have any step)."""
    return all(n == 1 or s == t for n, s, t in zip(shape, steps, strides(shape)))


def element_offset(index: list[int], shape: list[int], steps: list[int], start: int = 0) -> int:
    """Place of an element of a view in its buffer."""
    if len(index) != len(shape) or any(not 0 <= k < n for k, n in zip(index, shape)):
        raise IndexError(f"{index} in {shape}")
    return start + sum(k * s for k, s in zip(index, steps))


def expand(df: DataFrame, axis: str, n: int) -> DataFrame:
    """A new axis of n equal copies, without a join."""
    return df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def reduce_axis(df: DataFrame, keep: list[str], **aggs: Column) -> DataFrame:
    """Aggregates over all axes but keep: partial sums before the shuffle."""
    return df.groupBy(*keep).agg(*[c.alias(name) for name, c in aggs.items()])


def nan_free(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def arg_min(v: Column, i: Column) -> Column:
    """First index of the smallest value; NaN never wins."""
    return F.min(F.when(~F.isnan(v), F.struct(v.alias("v"), i.alias("i"))))["i"]


def arg_max(v: Column, i: Column) -> Column:
    return -F.max(F.when(~F.isnan(v), F.struct(v.alias("v"), (-i).alias("i"))))["i"]


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, v) @ (k, j, v): an equi-join on k and a partially aggregated sum."""
    x, y = a.select("i", "k", F.col("v").alias("x")), b.select("k", "j", F.col("v").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def batched_matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("p", "i", "k", F.col("v").alias("x")), b.select("p", "k", "j", F.col("v").alias("y"))
    return x.join(y, ["p", "k"]).groupBy("p", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def same_length(x: Column, y: Column, value: Column) -> Column:
    """value, or an error where two cells differ in length."""
    return F.when(F.size(x) == F.size(y), value).when(x.isNotNull() & y.isNotNull(), F.raise_error(F.lit("lengths differ")))


def dot(x: Column, y: Column) -> Column:
    """Dot product of two array cells in double precision."""
    return same_length(x, y, F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v))


def whole_dot(x: Column, y: Column) -> Column:
    """Exact dot product of two cells of whole numbers, as a decimal(38, 0)."""
    wide = "decimal(38,0)"
    products = F.zip_with(x, y, lambda p, q: (p.cast("decimal(19,0)") * q.cast("decimal(19,0)")).cast(wide))
    return same_length(x, y, F.aggregate(products, F.lit(0).cast(wide), lambda s, v: (s + v).cast(wide)))


def l2sq(x: Column, y: Column) -> Column:
    d = F.zip_with(x, y, lambda p, q: p.cast("double") - q.cast("double"))
    return same_length(x, y, F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v))


def pack_bits(x: Column) -> Column:
    """Truth values of a cell's elements (positive or not) as longs of 64 bits each, the first element lowest."""
    word = lambda w: F.aggregate(
        F.transform(F.slice(x, w * 64 + 1, 64), lambda v, k: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda s, v: s.bitwiseOR(v),
    )
    return F.when(F.size(x) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / F.lit(64)).cast("int")), word))


def _counted(x: Column, y: Column, f) -> Column:
    return same_length(x, y, F.aggregate(F.zip_with(pack_bits(x), pack_bits(y), lambda p, q: F.bit_count(f(p, q))), F.lit(0), lambda s, v: s + v))


def hamming(x: Column, y: Column) -> Column:
    """Elements of two cells that differ as truth values, at any length."""
    return _counted(x, y, lambda p, q: p.bitwiseXOR(q))


def bin_dot(x: Column, y: Column) -> Column:
    """Elements that are true in both cells."""
    return _counted(x, y, lambda p, q: p.bitwiseAND(q))


def gemv(w: Column, x: Column) -> Column:
    """One row of a matrix-vector product: no shuffle if x is a constant."""
    return dot(w, x)


def gemv_scaled(w: Column, x: Column, scales: Column, group: int) -> Column:
    """Sum over groups of scale times the group's dot product; the last group may be
    shorter, and there must be a scale for each."""
    part = F.zip_with(w, x, lambda p, q: p.cast("double") * q.cast("double"))
    total = F.aggregate(
        F.transform(scales, lambda s, g: s * F.aggregate(F.slice(part, g * group + 1, group), F.lit(0.0), lambda t, v: t + v)), F.lit(0.0), lambda t, v: t + v
    )
    fits = F.size(scales) == F.ceil(F.size(w) / F.lit(group))
    return same_length(w, x, F.when(fits, total).otherwise(F.raise_error(F.lit("a scale per group is needed"))))


def softmax(df: DataFrame, keep: list[str]) -> DataFrame:
    """v by exp(v - max) / sum over the axes that are not kept; a zero sum gives 0."""
    w = Window.partitionBy(*keep)
    e = df.withColumn("e", F.exp(F.col("v") - F.max("v").over(w))).withColumn("s", F.sum("e").over(w))
    return e.withColumn("v", F.when(F.col("s") == 0, 0.0).otherwise(F.col("e") / F.when(F.col("s") != 0, F.col("s")))).drop("e", "s")


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def softmax_cell(x: Column) -> Column:
    """Softmax of an array cell: no shuffle."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda t, v: t + v)
    powers = let(F.array_max(x).cast("double"), lambda m: F.transform(x, lambda v: F.exp(v.cast("double") - m)))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda v: F.when(s == 0, 0.0).otherwise(v / F.when(s != 0, s)))))


def rmsnorm_cell(x: Column, weight: Column, eps: float) -> Column:
    ms = F.aggregate(x, F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")) / F.size(x)
    return let(F.sqrt(ms + F.lit(eps)), lambda r: F.zip_with(x, weight, lambda v, w: v.cast("double") * w.cast("double") / r))

"""Typed arrays against numpy and plain Python: values, result types and errors."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.dtypes import DType, promote
from sparkloom.operators.typed import NDArray, broadcast_shape, piecewise, where

NAN, INF = float("nan"), float("inf")
SAMPLES = {
    DType.BINARY: [0, 1, 1, 0], DType.INT3: [-4, 3, -1, 2], DType.INT8: [-128, 127, 5, -7], DType.UINT8: [0, 255, 7, 130], DType.INT32: [-(1 << 31), (1 << 31) - 1, 9, -100_000],
    DType.INT64: [-(1 << 63), (1 << 63) - 1, 3, -(1 << 40)], DType.F16: [0.5, -2.0, 65504.0, 0.333251953125], DType.BF16: [0.5, -2.0, 3.0e38, 0.333984375], DType.F32: [0.5, -2.0, NAN, 1e30],
    DType.F64: [0.1, -2.5, INF, 1e300], DType.UINT256: [0, 1, (1 << 256) - 1, 1 << 130],
}
BITS = {DType.INT3: 3, DType.INT8: 8, DType.INT32: 32, DType.INT64: 64}


def values(x):
    """Elements in row-major order; wide ones as integers."""
    df = x.frame()
    out = [r[-1] for r in (df.orderBy(*x.axes) if x.axes else df).collect()]
    return [int.from_bytes(v, "big") if isinstance(v, (bytes, bytearray)) else v for v in out]


def wrap(v, t):
    if t is DType.UINT8:
        return v % 256
    if t is DType.UINT256:
        return v % (1 << 256)
    n = BITS[t]
    return (v + (1 << n - 1)) % (1 << n) - (1 << n - 1)


def trunc(a, b):
    q = abs(a) // abs(b)
    return -q if (a < 0) != (b < 0) else q


def near(a, b):
    return all(x == y or (x != x and y != y) or math.isclose(x, y, rel_tol=1e-2) for x, y in zip(a, b)) and len(a) == len(b)


def test_every_pair_of_types(spark):
    """Whole types wrap in the promoted type, real ones are IEEE; pairs without a type raise."""
    for a, b in product(DType, DType):
        x, y = NDArray.of(spark, SAMPLES[a], dtype=a), NDArray.of(spark, [1, 1, 1, 1] if not b.value.real else [1.0, 0.5, 2.0, -1.0], dtype=b)
        try:
            t = promote(a, b)
        except ValueError:
            for f in (x.add, x.lt, x.minimum):
                with pytest.raises(ValueError):
                    f(y)
            continue
        assert x.add(y).dtype is x.div(y).dtype is t and x.eq(y).dtype is DType.BINARY
        if (a, b) in ((DType.INT32, DType.INT8), (DType.BINARY, DType.BINARY), (DType.INT3, DType.UINT8), (DType.UINT8, DType.UINT8), (DType.UINT8, DType.UINT256), (DType.INT64, DType.INT32)):
            own, ones = SAMPLES[a], [1] * 4
            assert values(x.add(y)) == [wrap(p + q, t) for p, q in zip(own, ones)], (a, b)
            assert values(x.sub(y)) == [wrap(p - q, t) for p, q in zip(own, ones)], (a, b)


@pytest.mark.parametrize("t", [DType.INT3, DType.INT8, DType.UINT8, DType.INT32, DType.INT64, DType.UINT256])
def test_whole_arithmetic_wraps(spark, t):
    a, b = SAMPLES[t], SAMPLES[t][::-1]
    b = [v or 1 for v in b]
    x = NDArray.of(spark, a, dtype=t)
    y = NDArray(x.df.withColumn("w", F.array(*[F.lit(bytearray(v.to_bytes(32, "big")) if t is DType.UINT256 else v) for v in b])[F.col("i0").cast("int")].cast(t.storage)), x.axes, x.shape, F.col("w"), t)
    x = NDArray(y.df, x.axes, x.shape, F.col("v"), t)
    for op, f in (("add", lambda p, q: p + q), ("sub", lambda p, q: p - q), ("mul", lambda p, q: p * q), ("div", trunc), ("mod", lambda p, q: p - q * trunc(p, q))):
        assert values(getattr(x, op)(y)) == [wrap(f(p, q), t) for p, q in zip(a, b)], op
    assert values(x.square()) == [wrap(p * p, t) for p in a] and values(x.pow(3)) == [wrap(p**3, t) for p in a] and values(x.pow(0)) == [1] * 4
    assert values(x.minimum(y)) == [min(p, q) for p, q in zip(a, b)] and values(x.maximum(y)) == [max(p, q) for p, q in zip(a, b)]
    assert values(x.lt(y)) == [p < q for p, q in zip(a, b)] and values(x.compare(y)) == [(p > q) - (p < q) for p, q in zip(a, b)]
    if t is not DType.UINT256:
        assert values(x.abs()) == [wrap(abs(p), t) for p in a]
        assert values(-x) == [wrap(-p, t) if t is not DType.UINT8 else -p for p in a] and (-x).dtype is (DType.INT32 if t is DType.UINT8 else t)
        with pytest.raises(Exception, match="division by zero"):
            values(x.div(0))
    else:
        assert values(x.div(NDArray.of(spark, [0] * 4, dtype=t))) == [0] * 4
    with pytest.raises(ValueError):
        x.pow(-1)


def test_real_arithmetic(spark):
    for t, np_t in ((DType.F32, np.float32), (DType.F64, np.float64), (DType.F16, np.float16)):
        a, b = [0.5, -2.0, 3.25, 0.0, NAN], [0.1, 0.0, -7.5, 0.0, 1.0]
        x, y = NDArray.of(spark, a, dtype=t), NDArray.of(spark, b, dtype=t)
        p, q = np.array(a, np_t), np.array(b, np_t)
        with np.errstate(all="ignore"):
            for op, want in (("add", p + q), ("sub", p - q), ("mul", p * q), ("div", p / q), ("minimum", np.fmin(p, q)), ("maximum", np.fmax(p, q)), ("mod", np.fmod(p, q))):
                got = getattr(x, op)(y)
                assert got.dtype is t and near(values(got), [float(v) for v in want]), (t, op)
        assert x.real("exp").dtype is t and near(values(x.real("exp")), [float(v) for v in np.exp(p)])
        assert values(x.predicate("isnan")) == [False] * 4 + [True] and values(x.eq(x)) == [True] * 4 + [False]
    assert NDArray.of(spark, [1.0], dtype=DType.F16).add(NDArray.of(spark, [1.0], dtype=DType.BF16)).dtype is DType.F32


def test_scalars_and_real_functions(spark):
    x = NDArray.of(spark, [1, 2, 100], dtype=DType.INT8)
    assert x.add(27).dtype is DType.INT8 and values(x.add(28)) == [29, 30, -128] and x.add(500).dtype is DType.INT32 and (x * 0.5).dtype is DType.F32
    assert values(300 - NDArray.of(spark, [1, 2], dtype=DType.UINT8)) == [299, 298] and NDArray.of(spark, [0.1], dtype=DType.F16).add(0.1).dtype is DType.F16
    assert x.real("sqrt").dtype is DType.F32 and NDArray.of(spark, [4, 9]).real("sqrt").dtype is DType.F32 and NDArray.of(spark, [4, 1 << 25]).real("sqrt").dtype is DType.F64
    assert values(NDArray.of(spark, [4, 1 << 26]).real("sqrt")) == [2.0, 8192.0]
    with pytest.raises(ValueError):
        NDArray.of(spark, [1], dtype=DType.UINT256).real("sqrt")
    for t in (DType.INT64, DType.UINT256):
        with pytest.raises(ValueError):
            NDArray.of(spark, [1], dtype=t).gt(0.5)
    assert NDArray.of(spark, [0, 1, -1]).dtype is DType.INT3 and NDArray.of(spark, [0, 2]).dtype is DType.INT32 and NDArray.of(spark, [1 << 40]).dtype is DType.INT64
    assert values(NDArray.of(spark, [2.5, -2.5, NAN, 1e300]).rounded("round"))[:2] == [3.0, -3.0] and values(x.rounded("floor")) == [1, 2, 100]
    assert values(x.real_pair("hypot", NDArray.of(spark, [0, 0, 0], dtype=DType.INT8))) == [1.0, 2.0, 100.0]
    with pytest.raises(ValueError):
        NDArray.of(spark, [300], dtype=DType.INT8)


def test_shapes(spark):
    x = NDArray.of(spark, list(range(2, 8)), [2, 3])
    with pytest.raises(ValueError):
        x.add(NDArray.of(spark, [2, 3, 4]))
    with pytest.raises(ValueError):
        NDArray.of(spark, [2, 3], [3])
    a = np.arange(2, 8).reshape(2, 3)
    assert values(x.add(NDArray.of(spark, [2, 3, 4]), broadcast=True)) == (a + np.array([2, 3, 4])).ravel().tolist()
    col, row = NDArray.of(spark, [2, 3], [2, 1]), NDArray.of(spark, [5, 6, 7], [1, 3])
    assert values(col.mul(row, broadcast=True)) == np.outer([2, 3], [5, 6, 7]).ravel().tolist()
    assert values(x.mul(NDArray.of(spark, [7], []), broadcast=True)) == (a * 7).ravel().tolist() and values(x.transpose()) == a.T.ravel().tolist()
    assert values(x.slice_range(1, 1, 3)) == a[:, 1:].ravel().tolist() and values(x.slice_index(0, 1)) == a[1].tolist() and values(x.reshape([3, 2])) == a.ravel().tolist()
    assert values(row.broadcast_to([2, 2, 3])) == np.broadcast_to([[5, 6, 7]], (2, 2, 3)).ravel().tolist() and row.broadcast_to([0, 3]).frame().count() == 0
    assert broadcast_shape([3, 1], [2, 1, 4]) == [2, 3, 4]
    for f in (lambda: x.slice_index(2, 0), lambda: x.slice_index(0, 2), lambda: x.slice_range(0, 1, 3)):
        with pytest.raises(IndexError):
            f()
    assert x.equal(NDArray.of(spark, list(range(2, 8)), [2, 3])) and not x.equal(x.reshape([6])) and not x.equal(x.convert(DType.INT64))
    z = NDArray.of(spark, [0.0, NAN])
    assert z.equal(NDArray.of(spark, [0.0, NAN])) and not z.equal(NDArray.of(spark, [-0.0, NAN])) and not z.equal(NDArray.of(spark, [0.0, 1.0]))
    assert (NDArray.full(spark, [100], 1).packed_bytes, NDArray.of(spark, [1.0] * 3, dtype=DType.F32).packed_bytes) == (56, 12)


def test_reductions(spark):
    a = np.array([[3, -7, 100], [100, 5, -7]])
    x = NDArray.of(spark, a.ravel().tolist(), [2, 3], DType.INT8)
    for op in ("sum", "prod", "min", "max", "mean", "argmin", "argmax"):
        for axis in (None, 0, 1):
            got = getattr(x, op)(axis)
            want = getattr(np, op)(a, axis=axis)
            assert near(values(got), np.ravel(want).tolist()), (op, axis)
    assert (x.sum().dtype, x.mean().dtype, x.max().dtype, x.argmax().dtype) == (DType.INT32, DType.F64, DType.INT8, DType.INT64)
    big = NDArray.of(spark, [(1 << 63) - 1, 2, 3], dtype=DType.INT64)
    assert values(big.sum()) == [wrap((1 << 63) + 4, DType.INT64)] and values(big.prod()) == [wrap(((1 << 63) - 1) * 6, DType.INT64)]
    wide = NDArray.of(spark, [(1 << 256) - 1, 5], dtype=DType.UINT256)
    assert values(wide.sum()) == [4] and values(wide.prod()) == [(1 << 256) - 5] and values(wide.max()) == [(1 << 256) - 1]
    r = NDArray.of(spark, [NAN, 2.0, -1.0, 2.0])
    assert values(r.min()) == [-1.0] and values(r.max()) == [2.0] and values(r.argmax()) == [1] and values(r.count_nonzero()) == [4]
    assert values(NDArray.of(spark, [NAN, NAN]).max())[0] != values(NDArray.of(spark, [NAN, NAN]).max())[0]
    none = NDArray.full(spark, [0, 3], 2)
    for op in ("sum", "prod", "min", "max", "mean", "argmin", "argmax"):
        with pytest.raises(ValueError):
            getattr(none, op)()
    with pytest.raises(ValueError):
        x.sum(2)
    assert not none.any() and none.all() and r.any() and not NDArray.of(spark, [1, 0]).all()


def test_accumulators(spark):
    x = NDArray.of(spark, [200, 100, -50], dtype=DType.INT32)
    one = lambda df: (lambda v: int.from_bytes(v, "big") if isinstance(v, (bytes, bytearray)) else v)(df.first()["v"])
    for acc, n in (("i32", 32), ("i64", 64)):
        assert (one(x.sum_as(acc)), one(x.prod_as(acc)), one(x.mean_as(acc))) == (250, -1_000_000, 83)
    for acc, n in (("u32", 32), ("u64", 64), ("u256", 256)):
        assert (one(x.sum_as(acc)), one(x.prod_as(acc)), one(x.mean_as(acc))) == (250, -1_000_000 % (1 << n), 83), acc
    assert (one(x.sum_as("f64")), one(x.prod_as("f32")), round(one(x.mean_as("f64")), 6)) == (250.0, -1_000_000.0, 83.333333)
    y = NDArray.of(spark, [1.9, -2.9, 4.0])
    assert (one(y.sum_as("i32")), one(y.prod_as("i64")), one(y.sum_as("u256"))) == (3, -8, 3)
    over = NDArray.of(spark, [(1 << 31) - 1, 5], dtype=DType.INT32)
    assert one(over.sum_as("i32")) == wrap((1 << 31) + 4, DType.INT32) and one(over.sum_as("u32")) == (1 << 31) + 4
    with pytest.raises(ValueError):
        NDArray.full(spark, [0], 1).sum_as("i32")


def test_dot(spark):
    x, y = NDArray.of(spark, [(1 << 62) + 1, 3], dtype=DType.INT64), NDArray.of(spark, [4, (1 << 61) + 7], dtype=DType.INT64)
    exact = ((1 << 62) + 1) * 4 + 3 * ((1 << 61) + 7)
    assert values(x.dot(y, DType.INT64)) == [wrap(exact, DType.INT64)] and values(x.dot(y, DType.INT32)) == [wrap(exact, DType.INT32)]
    assert values(x.dot(y, DType.UINT256)) == [exact] and math.isclose(values(x.dot(y))[0], exact)
    assert values(NDArray.of(spark, [0.5, 2.0]).dot(NDArray.of(spark, [4, 6]))) == [14.0]
    with pytest.raises(ValueError):
        x.dot(NDArray.of(spark, [2]))


def test_masks_and_selection(spark):
    x, y = NDArray.of(spark, [NAN, 0.0, 2.0, -1.0]), NDArray.of(spark, [1, 0, 0, 1])
    assert values(x.logical_and(y)) == [True, False, False, True] and values(x.logical_or(y)) == [True, False, True, True] and values(x.logical_xor(y)) == [False, False, True, False]
    assert values(x.logical_xor(True)) == [False, True, False, False] and values(x.logical_not()) == [False, True, False, False]
    assert values(x.gt(-2)) == [False, True, True, True] and values(x.ne(x)) == [True, False, False, False]
    w = where(x.gt(0.5), NDArray.of(spark, [5, 6, 7, 8], dtype=DType.INT8), -1)
    assert w.dtype is DType.INT8 and values(w) == [-1, -1, 7, -1]
    assert where(x.gt(0), 1, 0).dtype is DType.INT3 and where(x.gt(0), 1, 7).dtype is DType.INT32 and where(x.gt(0), 1.0, 0).dtype is DType.F64
    p = piecewise([(x.lt(0), x), (y.truth(), 9.0)], x.mul(10))
    assert near(values(p), [9.0, 0.0, 20.0, -1.0])
    with pytest.raises(ValueError):
        where(x.gt(0), NDArray.of(spark, [2, 3]), 0)


def test_conversion(spark):
    x = NDArray.of(spark, [300.7, -1.5, 0.0])
    assert values(x.convert(DType.UINT8)) == [44, 255, 0] and values(x.convert(DType.BINARY)) == [True, False, False] and values(x.truth()) == [True, True, False]
    assert values(x.convert(DType.UINT256)) == [300, (1 << 256) - 1, 0] and values(x.convert(DType.UINT256).convert(DType.INT8)) == [44, -1, 0]
    assert values(NDArray.of(spark, [-1, 5]).convert(DType.UINT256)) == [(1 << 256) - 1, 5] and values(x.convert(DType.UINT256).convert(DType.F64))[0] == 300.0


@pytest.mark.parametrize("t", [DType.BINARY, DType.INT3, DType.INT8, DType.UINT8, DType.INT32, DType.INT64, DType.F16, DType.F32, DType.F64, DType.UINT256])
def test_matmul(spark, t):
    rng = np.random.default_rng(3)
    low, high = {DType.BINARY: (0, 2), DType.INT3: (-4, 4), DType.UINT8: (0, 256), DType.UINT256: (0, 1000)}.get(t, (-100, 100))
    a, b = rng.integers(low, high, (2, 3)), rng.integers(low, high, (3, 4))
    num = lambda m: [float(v) if t.value.real else int(v) for v in m.ravel()]
    got = NDArray.of(spark, num(a), [2, 3], t).matmul(NDArray.of(spark, num(b), [3, 4], t))
    want = {DType.BINARY: DType.INT32, DType.INT3: DType.INT32, DType.INT8: DType.INT32, DType.UINT8: DType.INT32, DType.INT32: DType.INT64, DType.F16: DType.F32}.get(t, t)
    assert got.dtype is want and got.shape == [2, 4] and values(got) == (a @ b).ravel().tolist()


def test_matmul_ranks_and_errors(spark):
    a, b = np.arange(12).reshape(2, 2, 3) + 2, np.arange(6).reshape(3, 2) + 2
    of = lambda m: NDArray.of(spark, m.ravel().tolist(), list(m.shape), DType.INT32)
    got = of(a).matmul(of(b))
    assert got.shape == [2, 2, 2] and values(got) == (a @ b).ravel().tolist()
    one = of(a[:1]).matmul(of(b))
    assert one.shape == [2, 2] and values(one) == (a[0] @ b).ravel().tolist()
    assert values(of(b[:, 0]).matmul(of(b))) == (b[:, 0] @ b).tolist() and of(b[:, 0]).matmul(of(b[:, 1])).shape == [] and values(of(b).matmul(of(b[0]))) == (b @ b[0]).tolist()
    zero = NDArray.full(spark, [2, 0], 2).matmul(NDArray.full(spark, [0, 3], 2))
    assert zero.shape == [2, 3] and values(zero) == [0] * 6 and NDArray.full(spark, [0, 2], 2).matmul(NDArray.full(spark, [2, 3], 2)).frame().count() == 0
    for x, y in ((of(b), of(b)), (of(b), of(b.T).convert(DType.INT64)), (of(a), of(np.concatenate([a, a[:1]])).permute([0, 2, 1]))):
        with pytest.raises(ValueError):
            x.matmul(y)
    big = NDArray.of(spark, [1 << 62, 1 << 62], [1, 2], DType.INT64).matmul(NDArray.of(spark, [3, 1], [2, 1], DType.INT64))
    assert values(big) == [0]


def test_activations(spark):
    a = np.array([[1.0, 2.0, -3.0], [0.5, 700.0, 710.0]])
    x = NDArray.of(spark, a.ravel().tolist(), [2, 3])
    for axis in (0, 1, -1, -2):
        e = np.exp(a - a.max(axis, keepdims=True))
        assert near(values(x.softmax(axis)), (e / e.sum(axis, keepdims=True)).ravel().tolist())
    assert math.isclose(sum(values(NDArray.of(spark, [1.0, 5.0, 2.0]).softmax())), 1) and values(NDArray.of(spark, [7.0], []).softmax()) == [1.0]
    assert NDArray.of(spark, [2, 3]).softmax().dtype is DType.F64 and NDArray.of(spark, [2, 3], dtype=DType.INT8).softmax().dtype is DType.F32
    w = np.array([1.0, 2.0, 0.5])
    want = a * w / np.sqrt((a * a).mean(1, keepdims=True) + 1e-3)
    assert near(values(x.rmsnorm(NDArray.of(spark, w.tolist()), eps=1e-3)), want.ravel().tolist())
    assert near(values(x.rmsnorm(NDArray.of(spark, a.ravel().tolist(), [2, 3]), 0, 1e-3)), (a * a / np.sqrt((a * a).mean(0) + 1e-3)).ravel().tolist())
    assert near(values(x.silu_mul(x)), (a * a / (1 + np.exp(-a))).ravel().tolist())
    with pytest.raises(ValueError):
        x.rmsnorm(NDArray.of(spark, [2.0, 3.0]))
    with pytest.raises(ValueError):
        x.softmax(2)

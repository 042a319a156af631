import math
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from sparkloom.functions import dtypes
from sparkloom.functions.dtypes import DType, promote

#: The promotion table, in the order of DType; - is an error.
TABLE = """
UINT8 INT3 INT8 UINT8 INT32 INT64 F16 BF16 F32 F64 UINT256
INT3 INT3 INT8 INT32 INT32 INT64 F16 BF16 F32 F64 -
INT8 INT8 INT8 INT32 INT32 INT64 F16 BF16 F32 F64 -
UINT8 INT32 INT32 UINT8 INT32 INT64 F16 BF16 F32 F64 UINT256
INT32 INT32 INT32 INT32 INT32 INT64 F64 F64 F64 F64 -
INT64 INT64 INT64 INT64 INT64 INT64 - - - - -
F16 F16 F16 F16 F64 - F16 F32 F32 F64 -
BF16 BF16 BF16 BF16 F64 - F32 BF16 F32 F64 -
F32 F32 F32 F32 F64 - F32 F32 F32 F64 -
F64 F64 F64 F64 F64 - F64 F64 F64 F64 -
UINT256 - - UINT256 - - - - - - UINT256
"""


def test_promotion_table():
    rows = [line.split() for line in TABLE.strip().split("\n")]
    for (i, a), (j, b) in product(enumerate(DType), enumerate(DType)):
        if rows[i][j] == "-":
            with pytest.raises(ValueError):
                promote(a, b)
        else:
            assert promote(a, b) is DType[rows[i][j]], (a, b)


def test_scalars():
    assert dtypes.promote_scalar(DType.INT8, 5) is DType.INT8 and dtypes.promote_scalar(DType.INT8, 500) is DType.INT32
    assert dtypes.promote_scalar(DType.INT32, 0.5) is DType.F64 and dtypes.promote_scalar(DType.F16, 0.1) is DType.F16
    assert dtypes.infer_scalar(1) is DType.INT3 and dtypes.infer_scalar(2) is DType.INT32 and dtypes.infer_scalar(1 << 40) is DType.INT64
    assert dtypes.unary_real(DType.INT32) is DType.F64 and dtypes.unary_real(DType.INT32, True) is DType.F32
    assert dtypes.sum_type(DType.UINT8) is DType.INT32 and dtypes.mean_type(DType.INT64) is DType.F64 and dtypes.matmul_type(DType.INT3) is DType.INT32
    with pytest.raises(ValueError):
        dtypes.unary_real(DType.UINT256)


@pytest.mark.parametrize("kind,low,size", [(DType.INT3, -4, 8), (DType.INT8, -128, 256), (DType.UINT8, 0, 256), (DType.INT32, -(1 << 31), 1 << 32)])
def test_wrap(spark, kind, low, size):
    xs = [0, 1, -1, low, low - 1, low + size - 1, low + size, 12345678901, -98765432109]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x long").select(dtypes.wrap(F.col("x"), kind)).collect()]
    assert got == [(x - low) % size + low for x in xs]


def test_wrap_64(spark):
    got = spark.range(1).select(dtypes.wrap(F.lit((1 << 63) - 1).cast("decimal(38,0)") + 1, DType.INT64)).first()[0]
    assert got == -(1 << 63)


def test_halves(spark):
    import numpy as np

    xs = [0.0, -0.0, 1.0, 1 / 3, 65504.0, 65519.0, 65520.0, 1e9, -1e9, 6e-8, 2.9e-8, 3e-8, 6.1e-5, 5.96e-8, float("inf"), float("nan"), 2049.0, 2051.0, *np.random.default_rng(0).normal(size=200).tolist()]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = np.array([r[0] for r in df.select(dtypes.round_half(F.col("x"), DType.F16)).collect()])
    with np.errstate(over="ignore"):
        want = np.array(xs).astype(np.float16).astype(float)
    assert np.array_equal(got, want, equal_nan=True)
    bf = [r[0] for r in df.select(dtypes.round_half(F.col("x"), DType.BF16)).collect()]
    for x, y in zip(np.array(xs, np.float64), bf):
        if math.isfinite(x) and x:
            m, e = math.frexp(abs(x))
            assert abs(y) == round(m * 256) * 2.0 ** (e - 8)


@settings(max_examples=20, deadline=None)
@given(st.floats(-1e6, 1e6))
def test_exact_scalars_are_held(x):
    import struct

    assert dtypes.holds(DType.F32, x) == (struct.unpack("f", struct.pack("f", x))[0] == x)


def test_int3_pairs(spark):
    from sparkloom.functions import ieee

    pairs = [(a, b) for a in range(-4, 4) for b in range(-4, 4) if b]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", dtypes.wrap(ieee.int_div(F.col("a"), F.col("b")), DType.INT3).alias("q")).collect()
    for a, b, q in got:
        t = int(a / b)
        assert q == (t + 4) % 8 - 4

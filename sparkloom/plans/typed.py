"""Typed arrays on the reference tables: result types, wrapping, reductions, products and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wideint
from ..functions.dtypes import DType
from ..operators.typed import ACCUMULATORS, NDArray, literal, piecewise, where
from .elementwise import FRAME, frame, inline_macros
from .registry import query, table

c = F.col
#: A column of each element type, in SQL that Spark and DuckDB share.
LANES = {
    DType.BINARY: "a % 2 = 1", DType.INT3: "b", DType.INT8: "c", DType.UINT8: "i % 256", DType.INT32: "(i % 20000) * 200003 - 2000000000", DType.INT64: "(i % 20000) * 800000000000003 - 8000000000000000000",
    DType.F16: "u", DType.BF16: "z", DType.F32: "y", DType.F64: "y / 3",
}
#: The same for Spark: of the 64-bit lane, whose product leaves its type from remainder 11530 on although every value fits, an
#: equal form of which no step does.
OWN_LANES = LANES | {DType.INT64: "(i % 20000 - 10000) * 800000000000003 + 30000"}
SIGNED = {DType.INT3: 3, DType.INT8: 8, DType.INT32: 32, DType.INT64: 64}
SIGN = {"add": "+", "sub": "-", "mul": "*", "div": "//"}


def lane(t: DType, df, n: int) -> NDArray:
    if t is DType.UINT256:
        return NDArray(df, ["i"], [n], wideint.from_long(c("i") * 1000003), t)
    return NDArray(df, ["i"], [n], F.expr(f"cast({OWN_LANES[t]} as {t.storage})"), t)


def lanes(spark, sf_dir, *types: DType) -> list[NDArray]:
    df = frame(spark, sf_dir)
    n = df.count()
    return [lane(t, df, n) for t in types]


def whole(t: DType) -> str:
    return f"(CASE WHEN {LANES[t]} THEN 1 ELSE 0 END)::HUGEINT" if t is DType.BINARY else "(i * 1000003)::HUGEINT" if t is DType.UINT256 else f"({LANES[t]})::HUGEINT"


def wrapped(t: DType, e: str) -> str:
    """A HUGEINT reduced to a type, as text."""
    if t is DType.UINT256:
        return f"lpad(lower(to_hex(({e})::HUGEINT)), 64, '0')"
    if t in SIGNED:
        size, half = 1 << SIGNED[t], 1 << SIGNED[t] - 1
        return f"((((({e}) % {size}::HUGEINT) + {size}::HUGEINT + {half}::HUGEINT) % {size}::HUGEINT) - {half}::HUGEINT)::VARCHAR"
    return f"((({e}) % 256 + 256) % 256)::VARCHAR"


def real(t: DType, source: DType) -> str:
    e = f"(CASE WHEN {LANES[source]} THEN 1 ELSE 0 END)" if source is DType.BINARY else f"({LANES[source]})"
    return f"{e}::FLOAT" if t is DType.F32 else f"{e}::DOUBLE"


def shown(x: NDArray):
    """Text of whole elements, doubles of real ones."""
    if x.dtype.value.real:
        return F.round(x.value.cast("double"), 6)
    return wideint.to_hex(x.value) if x.dtype is DType.UINT256 else x.value.cast("string")


def _lanewise(name: str, make, sql: str, t: DType) -> None:
    """A query of i, v and t, the element type that the promotion rules give."""

    @query(name, inline_macros(f"SELECT i, {sql} AS v, '{t.name}' AS t FROM {FRAME}"))
    def run(spark, sf_dir):
        out = make(spark, sf_dir)
        return out.df.select("i", shown(out).alias("v"), F.lit(out.dtype.name).alias("t"))


#: Pairs with the type that holds both.
PAIRS = [
    (DType.BINARY, DType.BINARY, DType.UINT8), (DType.BINARY, DType.INT3, DType.INT3), (DType.INT3, DType.INT3, DType.INT3), (DType.INT3, DType.INT8, DType.INT8), (DType.INT3, DType.UINT8, DType.INT32),
    (DType.INT8, DType.INT8, DType.INT8), (DType.INT8, DType.UINT8, DType.INT32), (DType.UINT8, DType.UINT8, DType.UINT8), (DType.UINT8, DType.INT32, DType.INT32), (DType.INT32, DType.INT32, DType.INT32),
    (DType.INT32, DType.INT64, DType.INT64), (DType.INT64, DType.INT64, DType.INT64), (DType.INT8, DType.F32, DType.F32), (DType.INT32, DType.F32, DType.F64), (DType.F32, DType.F32, DType.F32),
    (DType.F32, DType.F64, DType.F64), (DType.F16, DType.BF16, DType.F32), (DType.INT3, DType.F16, DType.F16), (DType.BF16, DType.BF16, DType.BF16), (DType.F16, DType.F16, DType.F16),
    (DType.UINT8, DType.UINT256, DType.UINT256), (DType.UINT256, DType.UINT256, DType.UINT256),
]
for a, b, t in PAIRS:
    for op, s in list(SIGN.items())[:3]:
        if t.value.real:
            e = f"{real(t, a)} {s} {real(t, b)}"
            e = f"f16({e})" if t is DType.F16 else f"bf16({e})" if t is DType.BF16 else e
            sql = f"round(({e})::DOUBLE, 6)"
        elif op == "sub" and t is DType.UINT256:
            continue
        else:
            sql = wrapped(t, f"{whole(a)} {s} {whole(b)}")
        _lanewise(f"nd_{op}_{a.name.lower()}_{b.name.lower()}", lambda spark, sf_dir, a=a, b=b, op=op: (lambda x, y: getattr(x, op)(y))(*lanes(spark, sf_dir, a, b)), sql, t)
for t in SIGNED:
    _lanewise(f"nd_div_{t.name.lower()}", lambda spark, sf_dir, t=t: lanes(spark, sf_dir, t)[0].div(-3), wrapped(t, f"{whole(t)} // -3"), t)
    _lanewise(f"nd_neg_{t.name.lower()}", lambda spark, sf_dir, t=t: -lanes(spark, sf_dir, t)[0], wrapped(t, f"-{whole(t)}"), t)
    _lanewise(f"nd_abs_{t.name.lower()}", lambda spark, sf_dir, t=t: lanes(spark, sf_dir, t)[0].abs(), wrapped(t, f"abs({whole(t)})"), t)
    _lanewise(f"nd_pow_{t.name.lower()}", lambda spark, sf_dir, t=t: lanes(spark, sf_dir, t)[0].pow(2), wrapped(t, f"{whole(t)} * {whole(t)}"), t)
_lanewise("nd_neg_uint8", lambda spark, sf_dir: -lanes(spark, sf_dir, DType.UINT8)[0], "(-(i % 256))::VARCHAR", DType.INT32)
_lanewise("nd_scalar_left", lambda spark, sf_dir: 300 - lanes(spark, sf_dir, DType.UINT8)[0], "(300 - (i % 256))::VARCHAR", DType.INT32)
_lanewise("nd_scalar_fits", lambda spark, sf_dir: lanes(spark, sf_dir, DType.INT8)[0] + 5, wrapped(DType.INT8, "c::HUGEINT + 5"), DType.INT8)
_lanewise("nd_scalar_grows", lambda spark, sf_dir: lanes(spark, sf_dir, DType.INT8)[0] + 500, "(c + 500)::VARCHAR", DType.INT32)
_lanewise("nd_scalar_real", lambda spark, sf_dir: lanes(spark, sf_dir, DType.INT32)[0] * 0.5, f"round((({LANES[DType.INT32]}) * 0.5)::DOUBLE, 6)", DType.F64)
_lanewise("nd_minimum", lambda spark, sf_dir: (lambda x, y: x.minimum(y))(*lanes(spark, sf_dir, DType.INT8, DType.UINT8)), "least(c, i % 256)::VARCHAR", DType.INT32)
_lanewise("nd_sqrt_small", lambda spark, sf_dir: lanes(spark, sf_dir, DType.UINT8)[0].real("sqrt"), "round(sqrt((i % 256)::DOUBLE)::FLOAT::DOUBLE, 6)", DType.F32)
_lanewise("nd_sqrt_wide", lambda spark, sf_dir: lanes(spark, sf_dir, DType.INT32)[0].abs().real("sqrt"), f"round(sqrt(abs({LANES[DType.INT32]})::DOUBLE), 6)", DType.F64)
_lanewise("nd_hypot", lambda spark, sf_dir: (lambda x, y: x.real_pair("hypot", y))(*lanes(spark, sf_dir, DType.INT8, DType.INT3)), "round(sqrt((c * c + b * b)::DOUBLE), 6)", DType.F64)
_lanewise("nd_compare", lambda spark, sf_dir: (lambda x, y: x.compare(y))(*lanes(spark, sf_dir, DType.INT8, DType.UINT8)), "sign(c - (i % 256))::INT::VARCHAR", DType.INT3)
_lanewise("nd_less", lambda spark, sf_dir: (lambda x, y: x.lt(y))(*lanes(spark, sf_dir, DType.INT32, DType.INT64)), f"(({LANES[DType.INT32]}) < ({LANES[DType.INT64]}))::VARCHAR", DType.BINARY)
_lanewise("nd_where", lambda spark, sf_dir: (lambda x, y: where(x.gt(0), y, -1))(*lanes(spark, sf_dir, DType.INT8, DType.UINT8)), "(CASE WHEN c > 0 THEN i % 256 ELSE -1 END)::VARCHAR", DType.INT32)
_lanewise("nd_piecewise", lambda spark, sf_dir: (lambda x, y: piecewise([(x.lt(0), x), (y.gt(0.0), y)], 2))(*lanes(spark, sf_dir, DType.INT8, DType.F32)), "round((CASE WHEN c < 0 THEN c WHEN y > 0 THEN y ELSE 2 END)::DOUBLE, 6)", DType.F64)
_lanewise("nd_convert_u256", lambda spark, sf_dir: lanes(spark, sf_dir, DType.INT8)[0].convert(DType.UINT256),
          "CASE WHEN c < 0 THEN repeat('f', 48) || lower(to_hex(18446744073709551616::HUGEINT + c)) ELSE lpad(lower(to_hex(c)), 64, '0') END", DType.UINT256)


#: The type that holds two, by row and column in the order of the first line; - is an error.
PROMOTION = """
BINARY INT3 INT8 UINT8 INT32 INT64 F16 BF16 F32 F64 UINT256
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
NAMES, *CELLS = [line.split() for line in PROMOTION.strip().split("\n")]


@query("nd_promotion", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{t}')" for a, row in zip(NAMES, CELLS) for b, t in zip(NAMES, row)) + ") t(a, b, t)")
def _(spark, sf_dir):
    """What adding two arrays gives, for all pairs of types."""
    df = spark.range(1)
    one = {t.name: NDArray(df, ["id"], [1], literal(1, t), t) for t in DType}

    def of(a, b):
        try:
            return one[a].add(one[b]).dtype.name
        except ValueError:
            return "-"

    return spark.createDataFrame([(a, b, of(a, b)) for a in one for b in one], "a string, b string, t string")


# reductions
for t in (DType.INT3, DType.INT8, DType.UINT8, DType.INT32, DType.INT64):
    sum_t = DType.INT32 if t.value.digits <= 8 else DType.INT64

    @query(f"nd_sum_{t.name.lower()}", f"SELECT {wrapped(sum_t, f'sum({whole(t)})::HUGEINT')} AS v, '{sum_t.name}' AS t, min({LANES[t]})::BIGINT AS least, max({LANES[t]})::BIGINT AS most FROM {FRAME}")
    def _(spark, sf_dir, t=t):
        x, = lanes(spark, sf_dir, t)
        s = x.sum()
        low, high = x.min(), x.max()
        return s.df.select(c("v").cast("string").alias("v"), F.lit(s.dtype.name).alias("t")).crossJoin(low.df.select(c("v").cast("bigint").alias("least"))).crossJoin(high.df.select(c("v").cast("bigint").alias("most")))  # a row each


@query("nd_prod_wraps", f"SELECT k, CASE WHEN n >= 32 THEN 0 ELSE ((1::BIGINT << n) + 2147483648) % 4294967296 - 2147483648 END::BIGINT AS v FROM (SELECT i % 50 AS k, count(*)::INT AS n FROM {FRAME} GROUP BY ALL)")
def _(spark, sf_dir):
    """Twos of a column's groups, multiplied along the other axis, modulo 2**32."""
    df = frame(spark, sf_dir).select((c("i") % 50).alias("k"), F.floor(c("i") / 50).alias("j"), F.lit(2).cast("tinyint").alias("v"))
    x = NDArray(df, ["k", "j"], [50, 1 << 40], c("v"), DType.INT8)
    return x.prod(1).df.select("k", c("v").cast("bigint").alias("v"))


for acc, (bits, signed) in ACCUMULATORS.items():
    total = f"sum({whole(DType.INT32)})::HUGEINT"
    if not bits:
        sql = f"round(({total})::DOUBLE / 1000000, 3)" if acc == "f64" else f"round(({total})::DOUBLE / 1000000000, 0)"
    elif bits == 256:
        sql = f"right(CASE WHEN {total} < 0 THEN lpad(lower(to_hex(18446744073709551616::HUGEINT + {total})), 16, '0') ELSE lpad(lower(to_hex({total})), 16, '0') END, 16)"
    else:
        size = 1 << bits
        sql = f"(((({total}) % {size}::HUGEINT) + {size}::HUGEINT{f' + {size >> 1}::HUGEINT' if signed else ''}) % {size}::HUGEINT{f' - {size >> 1}::HUGEINT' if signed else ''})::VARCHAR"

    @query(f"nd_sum_as_{acc}", f"SELECT {sql} AS v FROM {FRAME}")
    def _(spark, sf_dir, acc=acc, bits=bits):
        out = lanes(spark, sf_dir, DType.INT32)[0].sum_as(acc)
        v = c("v").cast("string") if bits and bits < 256 else F.right(wideint.to_hex(c("v")), F.lit(16)) if bits else F.round(c("v").cast("double") / (1e6 if acc == "f64" else 1e9), 3 if acc == "f64" else 0)
        return out.select(v.alias("v"))


@query("nd_mean_prod_as", f"SELECT round(avg(b)::DOUBLE, 6) AS mean, trunc(avg(c))::INT AS whole, CASE WHEN count(*) FILTER (a = 3) >= 64 THEN 0 ELSE 1::HUGEINT << count(*) FILTER (a = 3)::INT END::VARCHAR AS twos FROM {FRAME}")
def _(spark, sf_dir):
    """Means and products into accumulators of the caller's choice: a two for every part of size 3, modulo 2**64."""
    x, y = lanes(spark, sf_dir, DType.INT3, DType.INT8)
    twos = NDArray(x.df, x.axes, x.shape, F.when(c("a") == 3, 2).otherwise(1).cast("tinyint"), DType.INT8)
    parts = x.mean_as("f64").select(F.round("v", 6).alias("mean")), y.mean_as("i32").select(c("v").alias("whole")), twos.prod_as("u64").select(c("v").cast("string").alias("twos"))
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # a row each


# products
for t in (DType.BINARY, DType.INT3, DType.INT8, DType.UINT8, DType.INT32, DType.INT64, DType.F16, DType.BF16, DType.F32, DType.F64, DType.UINT256):
    out_t = {DType.INT32: DType.INT64, DType.F16: DType.F32, DType.BF16: DType.F32}.get(t, t if t.value.real or t.value.digits > 31 else DType.INT32)
    cell = {DType.BINARY: "(i * 3 + k) % 2", DType.INT3: "(i + k) % 7 - 3", DType.INT8: "(i * 5 + k) % 255 - 127", DType.UINT8: "(i * 7 + k) % 256"}.get(t, "(i * 3 + k * 5) % 11 - 4" if t is not DType.UINT256 else "(i * 3 + k * 5) % 11")
    scale = 1 << 60 if t is DType.INT64 else 1
    value = f"(({cell}) * {scale})::HUGEINT"
    total = f"sum(x * {'y' if scale == 1 else f'(y // {scale})'})::HUGEINT"
    shape = f"round(({total})::DOUBLE, 6)" if t.value.real else wrapped(out_t, total)

    @query(f"nd_matmul_{t.name.lower()}", f"""WITH a AS (SELECT i, k, {value} AS x FROM range(20) p(i), range(17) q(k)), b AS (SELECT k, j, {value.replace('i *', 'j *').replace('(i ', '(j ')} AS y FROM range(17) q(k), range(9) r(j))
        SELECT i, j, {shape} AS v, '{out_t.name}' AS t FROM a JOIN b USING (k) GROUP BY i, j""")
    def _(spark, sf_dir, t=t, cell=cell, scale=scale):
        def side(n, m, axes, e, by):
            df = spark.range(n * m).select(F.floor(c("id") / m).alias(axes[0]), (c("id") % m).alias(axes[1]))
            v = F.expr(f"({e}) * {by}L")
            v = wideint.from_long(v) if t is DType.UINT256 else v == 1 if t is DType.BINARY else v.cast(t.storage)
            return NDArray(df.select(*axes, v.alias("v")), list(axes), [n, m], c("v"), t)

        a, b = side(20, 17, ("i", "k"), cell, scale), side(17, 9, ("k", "j"), cell.replace("i *", "j *").replace("(i ", "(j "), 1)
        out = a.matmul(b)
        return out.df.select("i", "j", shown(out).alias("v"), F.lit(out.dtype.name).alias("t"))


@query("nd_broadcast", "SELECT i, j, k, (i * 10 + j + 2 + (k + 5) * 100)::BIGINT AS v FROM range(4) a(i), range(3) b(j), range(5) d(k)")
def _(spark, sf_dir):
    """[4, 1, 5] and [3, 1] along all their axes."""
    x = NDArray(spark.range(20).select(F.floor(c("id") / 5).alias("x0"), F.lit(0).cast("bigint").alias("x1"), (c("id") % 5).alias("x2")), ["x0", "x1", "x2"], [4, 1, 5], c("x0") * 10 + (c("x2") + 5) * 100, DType.INT64)
    y = NDArray(spark.range(3).select(c("id").alias("y0"), F.lit(0).cast("bigint").alias("y1")), ["y0", "y1"], [3, 1], c("y0") + 2, DType.INT64)
    out = x.add(y, broadcast=True)
    return out.df.select(*[c(a).alias(b) for a, b in zip(out.axes, "ijk")], out.value.alias("v"))


@query("nd_views", "SELECT j - 1 AS i, i AS j, (i * 7 + j)::BIGINT AS v FROM range(6) a(i), range(7) b(j) WHERE j >= 1 AND j < 5")
def _(spark, sf_dir):
    """A range of columns, transposed."""
    x = NDArray(spark.range(42).select(F.floor(c("id") / 7).alias("r"), (c("id") % 7).alias("s"), c("id").alias("v")), ["r", "s"], [6, 7], c("v"), DType.INT64)
    out = x.slice_range(1, 1, 5).transpose()
    return out.df.select(c(out.axes[0]).alias("i"), c(out.axes[1]).alias("j"), "v")


COO = "(SELECT vec_id AS i, unnest(range(0, len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def vectors(spark, sf_dir) -> NDArray:
    t = table(spark, sf_dir, "embeddings")
    return NDArray(t.select(c("vec_id").alias("i"), F.posexplode("embedding").alias("k", "v")), ["i", "k"], [t.count(), 64], c("v").cast("double"), DType.F64)


for axis, by in ((0, "k"), (-1, "i")):

    @query(f"nd_softmax_{by}", f"SELECT i, k, round(e / sum(e) OVER (PARTITION BY {by}), 8) AS v FROM (SELECT i, k, exp(v - max(v) OVER (PARTITION BY {by})) AS e FROM {COO})")
    def _(spark, sf_dir, axis=axis):
        out = vectors(spark, sf_dir).softmax(axis)
        return out.df.select("i", "k", F.round(out.value, 8).alias("v"))


@query("nd_rmsnorm", f"SELECT i, k, round(v * (1 + k % 3) / sqrt(avg(v * v) OVER (PARTITION BY i) + 1e-6), 6) AS v FROM {COO}")
def _(spark, sf_dir):
    weight = NDArray(spark.range(64), ["id"], [64], 1.0 + c("id") % 3, DType.F64)
    out = vectors(spark, sf_dir).rmsnorm(weight)
    return out.df.select("i", "k", F.round(out.value, 6).alias("v"))


#: What must be an error, and isn't found out by Spark.
ERRORS = ("int64 and real", "real and uint256", "other shapes", "empty reduction", "inner sizes", "types of a product", "lengths of a dot", "int64 and a scalar", "negative power", "real function of uint256", "no axis")


@query("nd_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{e}', true)" for e in ERRORS) + ") t(what, raised)")
def _(spark, sf_dir):
    of = lambda t, n=2: NDArray.full(spark, [n], 1, t)
    tries = [
        lambda: of(DType.INT64).add(of(DType.F64)), lambda: of(DType.F32).add(of(DType.UINT256)), lambda: of(DType.INT8).add(of(DType.INT8, 3)), lambda: of(DType.INT8, 0).sum(),
        lambda: NDArray.full(spark, [2, 3], 2).matmul(NDArray.full(spark, [2, 3], 2)), lambda: of(DType.INT8).matmul(of(DType.INT32)), lambda: of(DType.INT8).dot(of(DType.INT8, 3)),
        lambda: of(DType.INT64).gt(0), lambda: of(DType.INT8).pow(-1), lambda: of(DType.UINT256).real("exp"), lambda: of(DType.INT8).sum(1),
    ]
    rows = []
    for what, f in zip(ERRORS, tries):
        try:
            f()
            rows.append((what, False))
        except ValueError:
            rows.append((what, True))
    return spark.createDataFrame(rows, "what string, raised boolean")

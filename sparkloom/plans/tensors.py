"""Indexing, views, broadcasts, reductions, scores, matrix products and activations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ieee, wideint
from ..functions.dtypes import DType
from ..operators import arrays
from ..operators.typed import NDArray
from .elementwise import FRAME, frame
from .registry import query, table

c = F.col
r6 = lambda x: F.round(x, 6)
COO = "(SELECT vec_id AS i, unnest(range(0, len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)"
GRID = "(SELECT p_size AS i, (p_partkey % 25)::INT AS k, sum(p_partkey % 11)::BIGINT AS v FROM part GROUP BY ALL)"


def coo(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(c("vec_id").alias("i"), F.posexplode("embedding").alias("k", "v")).withColumn("v", c("v").cast("double"))


def grid(spark, sf_dir):
    """A small integer matrix by size and key class."""
    return table(spark, sf_dir, "part").groupBy(c("p_size").alias("i"), (c("p_partkey") % 25).cast("int").alias("k")).agg(F.sum(c("p_partkey") % 11).alias("v"))


LINES = "(SELECT l_returnflag AS f, l_linestatus AS s, l_quantity AS a, l_discount AS b, l_extendedprice AS va, l_tax AS vb FROM lineitem)"


@query("flagship", f"""SELECT f, s, count(*)::BIGINT AS n, round(sum(v), 2) AS total, round(max(v), 4) AS most, count(*) FILTER (v = -1)::BIGINT AS n_else FROM (
    SELECT f, s, CASE WHEN vb = 0 THEN CASE WHEN b * b = 0 THEN 0 ELSE va / (b * b) END WHEN b <> 0 THEN CASE WHEN (b*b)*(b*b) = 0 THEN 0 ELSE (a * a * vb + b * b * va) / ((b*b)*(b*b)) END
    ELSE -1 END::DOUBLE AS v FROM {LINES}) GROUP BY f, s""")
def _(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("f"), c("l_linestatus").alias("s"), c("l_quantity").alias("a"), c("l_discount").alias("b"), c("l_extendedprice").alias("va"), c("l_tax").alias("vb"))
    b2 = c("b") * c("b")
    v = ieee.piecewise(
        [(c("vb") == 0, ieee.safe_div(c("va"), b2, F.lit(0.0))), (c("b") != 0, ieee.safe_div(c("a") * c("a") * c("vb") + b2 * c("va"), b2 * b2, F.lit(0.0)))], F.lit(-1.0)
    )
    return t.select("f", "s", v.alias("v")).groupBy("f", "s").agg(
        F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.round(F.max("v"), 4).alias("most"), F.count_if(c("v") == -1).alias("n_else")
    )


# indexing and views
@query("idx_get", f"SELECT v FROM {COO} WHERE i = 7 AND k = 3")
def _(spark, sf_dir):
    return coo(spark, sf_dir).where("i = 7 and k = 3").select("v")


@query("idx_set", f"SELECT i, CASE WHEN i = 5 THEN 99 ELSE a END::INT AS a FROM {FRAME}")
def _(spark, sf_dir):
    return frame(spark, sf_dir).select("i", F.when(c("i") == 5, 99).otherwise(c("a")).alias("a"))


@query("idx_flat", f"SELECT i * 64 + k AS flat, v FROM {COO}")
def _(spark, sf_dir):
    return coo(spark, sf_dir).select(arrays.flat_index(["i", "k"], [1, 64]).alias("flat"), "v")


@query("view_slice_index", f"SELECT i, v FROM {COO} WHERE k = 10")
def _(spark, sf_dir):
    return arrays.take_index(coo(spark, sf_dir), "k", 10)


@query("view_slice_range", f"SELECT i, k - 8 AS k, v FROM {COO} WHERE k >= 8 AND k < 24")
def _(spark, sf_dir):
    return arrays.take_range(coo(spark, sf_dir), "k", 8, 24)


@query("view_row", f"SELECT k, v FROM {COO} WHERE i = 3")
def _(spark, sf_dir):
    return arrays.take_index(coo(spark, sf_dir), "i", 3)


@query("view_col", f"SELECT i, v FROM {COO} WHERE k = 63")
def _(spark, sf_dir):
    return arrays.take_index(coo(spark, sf_dir), "k", 63)


@query("view_transpose", f"SELECT k AS i, i AS k, v FROM {COO}")
def _(spark, sf_dir):
    return arrays.permute(coo(spark, sf_dir), ["i", "k"], [1, 0])


@query("view_swapaxes", f"SELECT k AS i, i AS k, v FROM {COO}")
def _(spark, sf_dir):
    return arrays.permute(coo(spark, sf_dir), ["i", "k"], [1, 0])


@query("view_permute", f"SELECT k % 4 AS i, i AS k, k // 4 AS m, v FROM {COO}")
def _(spark, sf_dir):
    t = coo(spark, sf_dir).select("i", F.floor(c("k") / 4).cast("int").alias("k"), (c("k") % 4).alias("m"), "v")
    return arrays.permute(t, ["i", "k", "m"], [2, 0, 1])


@query("view_reshape", f"SELECT (i * 64 + k) // 64 AS i0, ((i * 64 + k) // 16) % 4 AS i1, (i * 64 + k) % 16 AS i2, v FROM {COO}")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    return arrays.reshape(coo(spark, sf_dir), ["i", "k"], [n, 64], [n, 4, 16])


@query("view_broadcast", f"SELECT i, k, a FROM {FRAME}, range(4) r(k)")
def _(spark, sf_dir):
    return arrays.expand(frame(spark, sf_dir).select("i", "a"), "k", 4).withColumn("k", c("k").cast("bigint"))


@query("view_copy", f"SELECT i, y FROM {FRAME}")
def _(spark, sf_dir):
    return frame(spark, sf_dir).select("i", "y")


@query("view_equal", f"SELECT bool_and(y = y + 0.0) AS same, bool_and(y = z) AS other, false AS typed, false AS shaped, bool_and(y <> 0) AS signed FROM {FRAME}")
def _(spark, sf_dir):
    a = frame(spark, sf_dir)
    n = a.count()
    of = lambda value, dtype=DType.F64, shape=None: NDArray(a, ["i"], shape or [n], value, dtype)
    y = of(c("y"))
    turned = of(F.when(c("y") == 0, -0.0).otherwise(c("y")))  # not the same where there is a zero
    got = (y.equal(of(c("y") + 0.0)), y.equal(of(c("z"))), y.equal(of(c("y").cast("float"), DType.F32)), y.equal(of(c("y"), shape=[n + 1])), y.equal(turned))
    return spark.createDataFrame([got], "same boolean, other boolean, typed boolean, shaped boolean, signed boolean")


MEANS = f"(SELECT k, avg(v) AS m FROM {COO} GROUP BY k)"
for op, f in (("add", lambda a, b: a + b), ("sub", lambda a, b: a - b), ("mul", lambda a, b: a * b), ("div", lambda a, b: ieee.div(a, b))):
    sign = {"add": "+", "sub": "-", "mul": "*", "div": "/"}[op]

    @query(f"bc_{op}", f"SELECT i, k, round(v {sign} (m + 2), 6) AS v FROM {COO} JOIN {MEANS} USING (k)")
    def _(spark, sf_dir, f=f):
        t = coo(spark, sf_dir)
        return t.join(t.groupBy("k").agg(F.avg("v").alias("m")), "k").select("i", "k", r6(f(c("v"), c("m") + 2)).alias("v"))


# reductions
for name, f, s in (("sum", F.sum, "sum({})::BIGINT"), ("min", F.min, "min({})"), ("max", F.max, "max({})"), ("prod", lambda x: F.product(x.cast("double")), "product({})::DOUBLE"), ("mean", F.avg, "avg({})")):
    of, ofs = (lambda: F.when(c("a") % 25 == 0, 2).otherwise(1), "CASE WHEN a % 25 = 0 THEN 2 ELSE 1 END") if name == "prod" else (lambda: c("a"), "a")

    @query(f"red_{name}", f"SELECT {s.format(ofs)} AS v FROM {FRAME}")
    def _(spark, sf_dir, f=f, of=of):
        return frame(spark, sf_dir).agg(f(of()).alias("v"))

    @query(f"red_{name}_axis", f"SELECT b, {s.format(ofs)} AS v FROM {FRAME} GROUP BY b")
    def _(spark, sf_dir, f=f, of=of):
        return arrays.reduce_axis(frame(spark, sf_dir), ["b"], v=f(of()))


@query("red_as", f"SELECT sum(a)::DOUBLE AS f64, ((sum(a * 40000000::BIGINT) + 2147483648) % 4294967296 - 2147483648)::BIGINT AS i32, (sum(a * 40000000::BIGINT) % 4294967296)::BIGINT AS u32, sum(a)::VARCHAR AS u256 FROM {FRAME}")
def _(spark, sf_dir):
    s = F.sum(c("a") * F.lit(40000000).cast("bigint"))
    return frame(spark, sf_dir).agg(
        F.sum(c("a").cast("double")).alias("f64"), ((s + 2147483648) % 4294967296 - 2147483648).alias("i32"), (s % 4294967296).alias("u32"), F.sum(c("a").cast("decimal(38,0)")).cast("string").alias("u256")
    )


NANY = "CASE WHEN i % 5 = 0 THEN NULL ELSE y END"
nan = lambda: F.when(c("i") % 5 == 0, F.lit(float("nan"))).otherwise(c("y"))
for name, f, s in (("argmin", arrays.arg_min, "first(i ORDER BY y, i)"), ("argmax", arrays.arg_max, "first(i ORDER BY y DESC, i)")):

    @query(f"red_{name}", f"SELECT {s} AS i FROM {FRAME} WHERE i % 5 <> 0")
    def _(spark, sf_dir, f=f):
        return frame(spark, sf_dir).agg(f(nan(), c("i")).alias("i"))

    @query(f"red_{name}_axis", f"SELECT b, {s} AS i FROM {FRAME} WHERE i % 5 <> 0 GROUP BY b")
    def _(spark, sf_dir, f=f):
        return frame(spark, sf_dir).groupBy("b").agg(f(nan(), c("i")).alias("i"))


@query("st_argmax", f"SELECT first(i ORDER BY y DESC, i) AS i FROM {FRAME}")
def _(spark, sf_dir):
    return frame(spark, sf_dir).agg(arrays.arg_max(c("y"), c("i")).alias("i"))


@query("mask_any", f"SELECT bool_or(b > 2) AS any, bool_or(a > 1000) AS none FROM {FRAME}")
def _(spark, sf_dir):
    any_of = lambda m: F.coalesce(F.bool_or(m), F.lit(False))
    return frame(spark, sf_dir).agg(any_of(c("b") > 2).alias("any"), any_of(c("a") > 1000).alias("none"))


@query("mask_all", f"SELECT bool_and(a > 0) AS \"all\", bool_and(b > 0) AS none FROM {FRAME}")
def _(spark, sf_dir):
    all_of = lambda m: F.coalesce(F.bool_and(m), F.lit(True))
    return frame(spark, sf_dir).agg(all_of(c("a") > 0).alias("all"), all_of(c("b") > 0).alias("none"))


@query("mask_countnz", f"SELECT count(*) FILTER (b <> 0)::BIGINT AS n FROM {FRAME}")
def _(spark, sf_dir):
    return frame(spark, sf_dir).agg(F.count_if(ieee.truth(c("b"))).alias("n"))


# scores
PAIR = "(SELECT e.vec_id, e.embedding::DOUBLE[] AS x, q.embedding::DOUBLE[] AS y FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def pairs(spark, sf_dir):
    """Every vector beside vector 0, which travels as one broadcast row."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", c("embedding").alias("x")).join(F.broadcast(e.where("vec_id = 0").select(c("embedding").alias("y")).limit(1)))


SCORES = {
    "sc_dot": (arrays.dot, "list_dot_product(x, y)"),
    "sc_l2sq": (arrays.l2sq, "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"),
    "sc_l2sq_self": (lambda x, y: arrays.dot(x, x), "list_dot_product(x, x)"),
    "sc_l2norm": (lambda x, y: F.sqrt(arrays.l2sq(x, y)), "sqrt(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"),
    "sc_l2norm_self": (lambda x, y: F.sqrt(arrays.dot(x, x)), "sqrt(list_dot_product(x, x))"),
    "sc_cosine": (lambda x, y: arrays.dot(x, y) / (F.sqrt(arrays.dot(x, x)) * F.sqrt(arrays.dot(y, y))), "list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)))"),
}
for name, (f, s) in SCORES.items():

    @query(name, f"SELECT vec_id, round({s}, 6) AS v FROM {PAIR}")
    def _(spark, sf_dir, f=f):
        return pairs(spark, sf_dir).select("vec_id", r6(f(c("x"), c("y"))).alias("v"))


#: The same beside itself, so that vectors are longer than a word of bits.
LONGER = "(SELECT vec_id, list_concat(x, y) AS x, list_concat(y, x) AS y FROM " + PAIR + ")"


def longer(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.concat("x", "y").alias("x"), F.concat("y", "x").alias("y"))


for name, f, s in (("sc_hamming", arrays.hamming, "(p[1] > 0) <> (p[2] > 0)"), ("sc_bin_dot", arrays.bin_dot, "p[1] > 0 AND p[2] > 0")):

    @query(f"{name}_long", f"SELECT vec_id, len(list_filter(list_zip(x, y), lambda p: {s}))::INT AS v FROM {LONGER}")
    def _(spark, sf_dir, f=f):
        return longer(spark, sf_dir).select("vec_id", f(c("x"), c("y")).cast("int").alias("v"))


@query("sc_hamming", f"SELECT vec_id, len(list_filter(list_zip(x, y), lambda p: (p[1] > 0) <> (p[2] > 0)))::INT AS v FROM {PAIR}")
def _(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", arrays.hamming(c("x"), c("y")).cast("int").alias("v"))


@query("sc_bin_dot", f"SELECT vec_id, len(list_filter(list_zip(x, y), lambda p: p[1] > 0 AND p[2] > 0))::INT AS v FROM {PAIR}")
def _(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", arrays.bin_dot(c("x"), c("y")).cast("int").alias("v"))


@query("sc_dot_int8", f"SELECT vec_id, list_sum(list_transform(list_zip(x, y), lambda p: trunc(p[1] * 100)::BIGINT * trunc(p[2] * 100)::BIGINT))::BIGINT AS v FROM {PAIR}")
def _(spark, sf_dir):
    q = lambda x: F.transform(x, lambda v: (v.cast("double") * 100).cast("int"))
    return pairs(spark, sf_dir).select("vec_id", arrays.whole_dot(q(c("x")), q(c("y"))).cast("bigint").alias("v"))


@query("sc_dot_int64", f"SELECT vec_id, list_sum(list_transform(list_zip(x, y), lambda p: trunc(p[1] * 100)::HUGEINT * 10000000000000 * trunc(p[2] * 100)::HUGEINT * 1000000000))::VARCHAR AS v FROM {PAIR}")
def _(spark, sf_dir):
    q = lambda x, k: F.transform(x, lambda v: (v.cast("double") * 100).cast("bigint") * k)
    return pairs(spark, sf_dir).select("vec_id", arrays.whole_dot(q(c("x"), 10000000000000), q(c("y"), 1000000000)).cast("string").alias("v"))


# linear algebra
@query("la_matmul", f"SELECT a.i, b.i AS j, sum(a.v * b.v)::BIGINT AS v FROM {GRID} a JOIN {GRID} b USING (k) GROUP BY a.i, b.i")
def _(spark, sf_dir):
    a = grid(spark, sf_dir)
    return arrays.matmul(a, a.select("k", c("i").alias("j"), "v"))


CENTROIDS = "(SELECT label AS j, k, avg(v) AS v FROM (SELECT label, unnest(range(0, len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)"


@query("la_matmul_f64", f"SELECT a.i, b.j, round(sum(a.v * b.v), 6) AS v FROM {COO} a JOIN {CENTROIDS} b USING (k) GROUP BY a.i, b.j")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(c("label").alias("j"), F.posexplode("embedding").alias("k", "v"))
    centroids = e.groupBy("j", "k").agg(F.avg(c("v").cast("double")).alias("v"))
    return arrays.matmul(coo(spark, sf_dir), centroids).withColumn("v", r6("v"))


WIDE = f"(SELECT i, k, v * 1000000000000007 AS v FROM {GRID})"


@query("la_matmul_u256", f"SELECT a.i, b.i AS j, lpad(lower(hex(sum(a.v::HUGEINT * b.v))), 64, '0') AS v FROM {WIDE} a JOIN {WIDE} b USING (k) GROUP BY a.i, b.i")
def _(spark, sf_dir):
    a = grid(spark, sf_dir).withColumn("v", wideint.from_long(c("v") * 1000000000000007))
    x, y = a.select("i", "k", c("v").alias("x")), a.select("k", c("i").alias("j"), c("v").alias("y"))
    products = x.join(y, "k").select("i", "j", wideint.apply("mul", c("x"), c("y")).alias("w"))
    return products.groupBy("i", "j").agg(wideint.to_hex(wideint.total(c("w"))).alias("v"))


for name, f, s in (("int3", lambda v: (v + 4).bitwiseAND(F.lit(7).cast("bigint")) - 4, "((v + 4) & 7) - 4"), ("bin", lambda v: (v % 2), "v % 2"), ("i8", lambda v: v % 128, "v % 128"), ("i64", lambda v: v * 1000, "v * 1000")):

    @query(f"la_matmul_{name}", f"WITH g AS (SELECT i, k, ({s})::BIGINT AS v FROM {GRID}) SELECT a.i, b.i AS j, sum(a.v * b.v)::BIGINT AS v FROM g a JOIN g b USING (k) GROUP BY a.i, b.i")
    def _(spark, sf_dir, f=f):
        a = grid(spark, sf_dir).withColumn("v", f(c("v")))
        return arrays.matmul(a, a.select("k", c("i").alias("j"), "v"))


@query("la_batched", f"SELECT a.i % 3 AS p, a.i, b.i AS j, sum(a.v * b.v)::BIGINT AS v FROM {GRID} a JOIN {GRID} b ON a.k = b.k AND a.i % 3 = b.i % 3 GROUP BY a.i, b.i")
def _(spark, sf_dir):
    a = grid(spark, sf_dir).withColumn("p", c("i") % 3)
    return arrays.batched_matmul(a, a.select("p", "k", c("i").alias("j"), "v"))


@query("la_vecmat", f"SELECT k AS j, sum(v * (i % 3))::BIGINT AS v FROM {GRID} GROUP BY k")
def _(spark, sf_dir):
    a = grid(spark, sf_dir)
    x = a.select(F.lit(0).alias("i"), c("i").alias("k"), (c("i") % 3).alias("v")).distinct()
    return arrays.matmul(x, a.select(c("i").alias("k"), c("k").alias("j"), "v")).select("j", "v")


@query("la_inner", f"SELECT sum(a * b)::BIGINT AS v FROM {FRAME}")
def _(spark, sf_dir):
    return frame(spark, sf_dir).agg(F.sum((c("a") * c("b")).cast("bigint")).alias("v"))


X64 = "list_transform(range(0, 64), lambda k: ((k % 5) - 2)::DOUBLE)"
x64 = lambda: F.array(*[F.lit(float(k % 5 - 2)) for k in range(64)])


@query("la_gemv", f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {X64}), 6) AS v FROM embeddings")
def _(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(arrays.gemv(c("embedding"), x64())).alias("v"))


@query("la_gemv_scaled", "SELECT vec_id, round(" + " + ".join(f"{s} * list_dot_product(embedding[{16 * g + 1}:{16 * g + 16}]::DOUBLE[], {X64}[{16 * g + 1}:{16 * g + 16}])" for g, s in enumerate((0.5, 2.0, 1.0, -1.0))) + ", 6) AS v FROM embeddings")
def _(spark, sf_dir):
    scales = F.array(*[F.lit(s) for s in (0.5, 2.0, 1.0, -1.0)])
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(arrays.gemv_scaled(c("embedding"), x64(), scales, 16)).alias("v"))


@query("la_zero_k", "SELECT a.range AS i, b.range AS j, 0::INT AS v FROM range(50) a, range(3) b")
def _(spark, sf_dir):
    """The product over an empty axis."""
    zero = NDArray.full(spark, [50, 0], 2, DType.INT8).matmul(NDArray.full(spark, [0, 3], 2, DType.INT8))
    return zero.df.select(c(zero.axes[0]).alias("i"), c(zero.axes[1]).alias("j"), zero.value.alias("v"))


GROUPS = [(0, 24), (24, 48), (48, 64)]


@query("la_gemv_scaled_uneven", "SELECT vec_id, round(" + " + ".join(f"{s} * list_dot_product(embedding[{a + 1}:{b}]::DOUBLE[], {X64}[{a + 1}:{b}])" for (a, b), s in zip(GROUPS, (0.5, 2.0, -1.0))) + ", 6) AS v FROM embeddings")
def _(spark, sf_dir):
    scales = F.array(*[F.lit(s) for s in (0.5, 2.0, -1.0)])
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(arrays.gemv_scaled(c("embedding"), x64(), scales, 24)).alias("v"))


@query("mm_matmul", f"SELECT a.i, b.i AS j, sum(a.v * b.v)::DOUBLE AS v FROM {GRID} a JOIN {GRID} b USING (k) GROUP BY a.i, b.i")
def _(spark, sf_dir):
    a = grid(spark, sf_dir).withColumn("v", c("v").cast("double"))
    return arrays.matmul(a, a.select("k", c("i").alias("j"), "v"))


# activations over an axis
@query("act_softmax", f"SELECT i, k, round(e / sum(e) OVER (PARTITION BY i), 6) AS v FROM (SELECT i, k, exp(v - max(v) OVER (PARTITION BY i)) AS e FROM {COO})")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("i"), F.posexplode(arrays.softmax_cell(c("embedding"))).alias("k", "v"))
    return e.withColumn("v", r6("v"))


@query("act_softmax_axis", f"SELECT i, k, round(e / sum(e) OVER (PARTITION BY k), 8) AS v FROM (SELECT i, k, exp(v - max(v) OVER (PARTITION BY k)) AS e FROM {COO})")
def _(spark, sf_dir):
    return arrays.softmax(coo(spark, sf_dir), ["k"]).withColumn("v", F.round("v", 8))


@query("act_rmsnorm", f"SELECT i, k, round(v * (1 + k % 3) / sqrt(avg(v * v) OVER (PARTITION BY i) + 1e-6), 6) AS v FROM {COO}")
def _(spark, sf_dir):
    w = F.array(*[F.lit(1.0 + k % 3) for k in range(64)])
    return table(spark, sf_dir, "embeddings").select(c("vec_id").alias("i"), F.posexplode(arrays.rmsnorm_cell(c("embedding"), w, 1e-6)).alias("k", "v")).withColumn("v", r6("v"))


@query("ext_filter", f"SELECT i, y FROM {FRAME} WHERE y > 0 AND b <> 0")
def _(spark, sf_dir):
    return frame(spark, sf_dir).where((c("y") > 0) & (c("b") != 0)).select("i", "y")




for name, dtype, factor in (("f32", "float", 0.5), ("half", "float", 0.25), ("u8", "smallint", 1), ("i32", "int", 100)):
    whole = isinstance(factor, int)

    @query(f"la_matmul_{name}", f"SELECT a.i, b.i AS j, sum(a.v * {factor} * b.v * {factor})::{'BIGINT' if whole else 'DOUBLE'} AS v FROM {GRID} a JOIN {GRID} b USING (k) GROUP BY a.i, b.i")
    def _(spark, sf_dir, dtype=dtype, factor=factor, whole=whole):
        wide = "bigint" if whole else "double"  # the accumulator's type
        a = grid(spark, sf_dir).withColumn("v", (c("v") * factor).cast(dtype).cast(wide))
        return arrays.matmul(a, a.select("k", c("i").alias("j"), "v"))


@query("mm_strassen", f"SELECT a.i, b.i AS j, sum(a.v * b.v)::DOUBLE AS v FROM {GRID} a JOIN {GRID} b USING (k) GROUP BY a.i, b.i")
def _(spark, sf_dir):
    """The product itself: a faster multiplication scheme is Catalyst's business, not the caller's."""
    a = grid(spark, sf_dir).withColumn("v", c("v").cast("double"))
    return arrays.matmul(a, a.select("k", c("i").alias("j"), "v"))


@query("la_squeeze", f"SELECT a.i, b.i AS j, sum(a.v * b.v)::BIGINT AS v FROM {GRID} a JOIN {GRID} b USING (k) GROUP BY a.i, b.i")
def _(spark, sf_dir):
    """A batch of one matrix: the result has no batch axis."""
    one = grid(spark, sf_dir).withColumn("p", F.lit(0))
    return arrays.batched_matmul(one, one.select("p", "k", c("i").alias("j"), "v")).drop("p")

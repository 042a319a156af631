"""Element-wise operators, masks, selection, conversion and construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.dtypes import DType, convert, promote, round_half, wrap
from ..operators import arrays
from ..sources import files
from .registry import query, table

#: The columns that element-wise queries use, in SQL that Spark and DuckDB share. y, z and u are exact in binary.
COLUMNS = {
    "i": "p_partkey",
    "a": "p_size",
    "b": "cast(p_partkey % 7 as int) - 3",
    "c": "cast(p_partkey % 251 as int) - 125",
    "y": "(cast(p_partkey % 401 as double) - 200) / 64",
    "z": "(cast(p_partkey % 17 as double) - 8) / 16",
    "u": "(cast(p_partkey % 401 as double) + 1) / 64",
}
FRAME = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM part)"
NAN = "CASE WHEN i % 5 = 0 THEN 'NaN'::DOUBLE ELSE y END"


def frame(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} as {n}" for n, e in COLUMNS.items()])


def _col(name: str, spark_column, sql: str):
    """A query of i and v."""

    @query(name, f"SELECT i, {sql} AS v FROM {FRAME}")
    def run(spark, sf_dir):
        return frame(spark, sf_dir).select("i", spark_column().alias("v"))


c = F.col
nan = lambda: F.when(c("i") % 5 == 0, F.lit(float("nan"))).otherwise(c("y"))
big = lambda n: c(n).cast("bigint")
r8 = lambda x: F.round(x, 8)
W8 = lambda e: f"((({e}) + 128) & 255) - 128"
W3 = lambda e: f"((({e}) + 4) & 7) - 4"
BIG = lambda e: f"({e})::BIGINT"

# arithmetic: 8-bit integers wrap, integers divide toward zero, doubles are IEEE
for op, f, s in (("add", lambda a, b: a + b, "+"), ("sub", lambda a, b: a - b, "-"), ("mul", lambda a, b: a * b, "*")):
    _col(f"ew_{op}", lambda f=f: wrap(f(big("a") * 3, big("c")), DType.INT8).cast("int"), f"({W8(f'{BIG("a * 3")} {s} {BIG("c")}')})::INT")
    _col(f"ew_{op}_f64", lambda f=f: f(c("y"), c("z")), f"y {s} z")
    _col(f"int3_{op}", lambda f=f: wrap(f(big("b"), big("c") % 4), DType.INT3).cast("int"), f"({W3(f'{BIG("b")} {s} ({BIG("c")} % 4)')})::INT")
    _col(f"half_{op}", lambda f=f: round_half(f(round_half(c("y"), DType.BF16).cast("double"), round_half(c("z"), DType.BF16).cast("double")), DType.BF16).cast("double"),
         f"bf16(bf16(y) {s} bf16(z))")
    _col(f"ew_{op}_u8", lambda f=f: wrap(f(big("a") * 4, F.lit(200).cast("bigint")), DType.UINT8).cast("int"), f"((({BIG('a * 4')}) {s} 200) & 255)::INT")
IEEE_DIV = "CASE WHEN z <> 0 THEN y / z WHEN y = 0 THEN 'NaN'::DOUBLE WHEN y > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END"
_col("ew_div", lambda: r8(ieee.div(c("y"), c("z"))), f"round({IEEE_DIV}, 8)")
_col("ew_div_int", lambda: ieee.int_div(c("c"), c("a")), "trunc(c::DOUBLE / a)::BIGINT")
_col("int3_div", lambda: wrap(ieee.int_div(c("b"), F.lit(-2)), DType.INT3).cast("int"), f"({W3("trunc(b / -2.0)::BIGINT")})::INT")
_col("half_div", lambda: round_half(ieee.div(c("y"), c("u")), DType.F16).cast("double"), "f16(y / u)")
_col("ew_into", lambda: c("a").cast("double") + c("y"), "a::DOUBLE + y")
_col("ew_scalar", lambda: F.concat_ws("|", wrap(big("c") + 5, DType.INT8).cast("string"), (100 - big("c")).cast("string"), (c("y") * 0.5).cast("decimal(20,8)").cast("string")),
     f"concat_ws('|', ({W8('c + 5')})::VARCHAR, (100 - c)::VARCHAR, (y * 0.5)::DECIMAL(20, 8)::VARCHAR)")
_col("ew_mod", lambda: ieee.mod(c("c"), c("a")), "c % a")
_col("ew_mod_f64", lambda: r8(c("y") % c("u")), "round(y % u, 8)")
_col("ew_pow", lambda: ieee.int_pow(c("b"), 5), "power(b, 5)::INT")
_col("ew_pow_f64", lambda: r8(F.pow(c("u"), c("z"))), "round(power(u, z), 8)")
_col("ew_min", lambda: ieee.fmin(nan(), c("z")), f"CASE WHEN isnan({NAN}) THEN z ELSE least({NAN}, z) END")
_col("ew_max", lambda: ieee.fmax(nan(), c("z")), f"CASE WHEN isnan({NAN}) THEN z ELSE greatest({NAN}, z) END")
_col("ew_clip", lambda: ieee.clip(c("y"), -1.0, 1.5), "least(greatest(y, -1.0::DOUBLE), 1.5::DOUBLE)")
_col("ew_safediv", lambda: r8(ieee.safe_div(c("y"), c("z"), F.lit(-7.0))), "round(CASE WHEN z = 0 THEN -7.0 ELSE y / z END, 8)")
_col("bin_arith", lambda: (c("a") % 2 == 1) != (c("c") % 2 != 0), "(a % 2 = 1) <> (c % 2 <> 0)")
_col("bin_mul", lambda: (c("a") % 2 == 1) & (c("c") % 2 != 0), "(a % 2 = 1) AND (c % 2 <> 0)")

# unary
SIMPLE = {
    "sqrt": ("u", F.sqrt, "sqrt({})"), "cbrt": ("y", F.cbrt, "cbrt({})"), "exp": ("y", F.exp, "exp({})"), "expm1": ("z", F.expm1, "exp({}) - 1"),
    "sin": ("y", F.sin, "sin({})"), "cos": ("y", F.cos, "cos({})"), "tan": ("z", F.tan, "tan({})"), "asin": ("z", F.asin, "asin({})"), "acos": ("z", F.acos, "acos({})"),
    "atan": ("y", F.atan, "atan({})"), "sinh": ("y", F.sinh, "sinh({})"), "cosh": ("y", F.cosh, "cosh({})"), "tanh": ("y", F.tanh, "tanh({})"), "asinh": ("y", F.asinh, "asinh({})"),
    "acosh": ("u", lambda x: F.acosh(x + 1), "acosh({} + 1)"), "atanh": ("z", F.atanh, "atanh({})"), "deg2rad": ("y", F.radians, "radians({})"), "rad2deg": ("z", F.degrees, "degrees({})"),
    "silu": ("y", ieee.silu, "{0} / (1 + exp(-{0}))"),
}
for name, (col, f, s) in SIMPLE.items():
    _col("act_silu" if name == "silu" else f"un_{name}", lambda f=f, col=col: r8(f(c(col))), f"round({s.format(col)}, 8)")
for name, f in (("log", ieee.log), ("log2", ieee.log2), ("log10", ieee.log10)):
    sql = {"log": "ln", "log2": "log2", "log10": "log10"}[name]
    _col(f"un_{name}", lambda f=f: r8(f(c("y"))), f"round(CASE WHEN y > 0 THEN {sql}(CASE WHEN y > 0 THEN y END) WHEN y = 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END, 8)")
_col("un_log1p", lambda: r8(ieee.log1p(c("y"))), "round(CASE WHEN y > -1 THEN ln(1 + CASE WHEN y > -1 THEN y END) WHEN y = -1 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END, 8)")
_col("un_neg", lambda: (-big("c")).cast("int"), "(-c)::INT")
_col("un_abs", lambda: wrap(F.abs(big("c")), DType.INT8).cast("int"), f"({W8('abs(c)')})::INT")
_col("un_sign", lambda: ieee.sign(c("y")).cast("int"), "sign(y)::INT")
_col("un_square", lambda: wrap(big("c") * big("c"), DType.INT8).cast("int"), f"({W8('c * c')})::INT")
_col("un_floor", lambda: F.floor(c("y")).cast("double"), "floor(y)")
_col("un_ceil", lambda: F.ceil(c("y")).cast("double"), "ceil(y)")
_col("un_round", lambda: F.round(c("y")), "round(y)")
_col("un_atan2", lambda: r8(F.atan2(c("y"), c("u"))), "round(atan2(y, u), 8)")
_col("un_hypot", lambda: r8(F.hypot(c("y"), c("u"))), "round(sqrt(y * y + u * u), 8)")
_col("act_silumul", lambda: r8(ieee.silu(c("y")) * c("z")), "round(y / (1 + exp(-y)) * z, 8)")
_col("st_norminv", lambda: F.round(ieee.norm_inv((c("z") + 0.5)), 6),
     "round(CASE WHEN z + 0.5 <= 0 OR z + 0.5 >= 1 THEN 0 ELSE norminv(z + 0.5) END, 6)")
_col("st_polyval", lambda: ieee.polyval([2, -1, 0.5], c("y")), "(2.0::DOUBLE * y - 1) * y + 0.5")
_col("st_popcount", lambda: F.bit_count("a").cast("int"), "bit_count(a)::INT")
_col("st_bitlen", lambda: ieee.bit_length(c("a") - 1).cast("int"), "CASE WHEN a = 1 THEN 0 ELSE length(bin(a - 1)) END::INT")
_col("st_square", lambda: c("y") * c("y"), "y * y")
_col("st_sqrt", lambda: r8(F.sqrt(c("u"))), "round(sqrt(u), 8)")
_col("st_sub", lambda: c("y") - c("z"), "y - z")
_col("mm_add", lambda: c("y") + c("z"), "y + z")
_col("mm_sub", lambda: c("y") - c("z"), "y - z")
_col("mm_scale", lambda: c("y") * 1.5, "y * 1.5::DOUBLE")
_col("mm_hadamard", lambda: c("y") * c("z"), "y * z")
_col("mm_div", lambda: r8(ieee.div(c("y"), c("u"))), "round(y / u, 8)")

# comparisons and predicates
for name, f, s in (("eq", ieee.eq, "="), ("lt", ieee.lt, "<"), ("le", ieee.le, "<="), ("gt", ieee.gt, ">"), ("ge", ieee.ge, ">=")):
    _col(f"cmp_{name}", lambda f=f: f(nan(), c("z")), f"({NAN}) {s} z AND NOT isnan({NAN})")
_col("cmp_ne", lambda: ieee.ne(nan(), c("z")), f"NOT (({NAN}) = z AND NOT isnan({NAN}))")
_col("cmp_scalar", lambda: ieee.gt(nan(), F.lit(0.25)) & ieee.lt(F.lit(-4), c("b")), f"({NAN}) > 0.25 AND NOT isnan({NAN}) AND -4 < b")
_col("cmp_3way", lambda: ieee.compare(nan(), c("z")), f"CASE WHEN isnan({NAN}) THEN 0 WHEN ({NAN}) < z THEN -1 WHEN ({NAN}) > z THEN 1 ELSE 0 END")
_col("pred_isnan", lambda: F.isnan(nan()), f"isnan({NAN})")
_col("pred_isinf", lambda: ieee.is_inf(ieee.div(c("y"), c("z"))), f"isinf({IEEE_DIV})")
_col("pred_isfinite", lambda: ieee.is_finite(ieee.div(c("y"), c("z"))), f"isfinite({IEEE_DIV})")

# masks and selection
_col("mask_not", lambda: ~(c("y") > 0), "NOT (y > 0)")
for name, f, s in (("and", lambda a, b: a & b, "AND"), ("or", lambda a, b: a | b, "OR"), ("xor", lambda a, b: a != b, "<>")):
    _col(f"mask_{name}", lambda f=f: f(ieee.truth(c("y")), ieee.truth(c("z"))), f"(y <> 0) {s} (z <> 0)")
_col("mask_logical_xor", lambda: ieee.truth(nan()) != ieee.truth(c("b")), f"(({NAN}) <> 0) <> (b <> 0)")
_col("mask_logical", lambda: (ieee.truth(nan()) & F.lit(True)) | ieee.truth(c("b")), f"({NAN}) <> 0 OR b <> 0")
_col("sel_where", lambda: F.when(ieee.truth(c("b")), c("y")).otherwise(F.lit(-1.0)), "CASE WHEN b <> 0 THEN y ELSE -1 END::DOUBLE")
_col("sel_choose", lambda: F.when(c("z") > 0, c("y")).otherwise(c("u")), "CASE WHEN z > 0 THEN y ELSE u END")
_col("sel_piecewise", lambda: ieee.piecewise([(c("y") < -1, c("z")), (c("y") < 1, c("u")), (c("z") > 0, c("y"))], F.lit(9.0)),
     "CASE WHEN y < -1 THEN z WHEN y < 1 THEN u WHEN z > 0 THEN y ELSE 9 END::DOUBLE")

# conversion
_col("conv_cast", lambda: F.concat_ws("|", *[convert(c("y") * 100, DType.F64, t).cast("int").cast("string") for t in (DType.INT8, DType.UINT8, DType.INT3, DType.INT32, DType.BINARY)]),
     f"concat_ws('|', ({W8('trunc(y * 100)::BIGINT')})::VARCHAR, (trunc(y * 100)::BIGINT & 255)::VARCHAR, ({W3('trunc(y * 100)::BIGINT')})::VARCHAR, trunc(y * 100)::BIGINT::VARCHAR, (y * 100 > 0)::INT::VARCHAR)")
_col("conv_f16", lambda: round_half(c("y") * 1001.0 / 7, DType.F16).cast("double"), "f16(y * 1001.0 / 7)")
_col("conv_bf16", lambda: round_half(c("y") * 1001.0 / 7, DType.BF16).cast("double"), "bf16(y * 1001.0 / 7)")
_col("conv_binary", lambda: ieee.truth(nan()), f"({NAN}) <> 0")


def inline_macros(sql: str) -> str:
    """The rounding macros written out, since an oracle is a single statement."""
    import re

    for name, digits, least in (("bf16", 8, -126), ("f16", 11, -14)):
        while (m := re.search(rf"(?<![a-z]){name}\(", sql)) is not None:
            depth, at = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[at], 0)
                at += 1
            x = f"({sql[m.end() : at - 1]})"
            if re.search(r"(?<![a-z0-9_])b?f16\(", x):
                x = f"({inline_macros(x[1:-1])})"
            step = f"power(2.0::DOUBLE, greatest(floor(log2(abs({x}))), {least}) - {digits - 1})"
            sql = sql[: m.start()] + f"(CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE round_even({x} / {step}, 0) * {step} END)" + sql[at:]
    return sql


def _norm_inv_sql(p: str) -> str:
    horner = lambda cs, x: "(" * len(cs) + f" * {x} + ".join(f"({v!r}::DOUBLE))" for v in cs)
    q = lambda t: f"sqrt(-2 * ln(CASE WHEN ({t}) > 0 AND ({t}) < 1 THEN {t} END))"
    side = lambda t: f"{horner(ieee.ACKLAM_C, q(t))} / {horner(ieee.ACKLAM_D, q(t))}"
    r = f"({p} - 0.5)"
    return (
        f"CASE WHEN {p} < {ieee.ACKLAM_LOW} THEN {side(p)} WHEN {p} > {1 - ieee.ACKLAM_LOW} THEN -({side(f'1 - ({p})')}) "
        f"ELSE {horner(ieee.ACKLAM_A, f'({r} * {r})')} * {r} / {horner(ieee.ACKLAM_B, f'({r} * {r})')} END"
    )


def _finish() -> None:
    from .registry import SQL

    for name, sql in list(SQL.items()):
        if "f16(" in sql:
            SQL[name] = inline_macros(sql)
        if "norminv(" in sql:
            SQL[name] = sql.replace("norminv(z + 0.5)", f"({_norm_inv_sql('(z + 0.5)')})")


_finish()


# construction
@query("src_vector", "SELECT * FROM (VALUES (0, 1.5::DOUBLE), (1, -2.0::DOUBLE), (2, 4.25::DOUBLE)) t(i, v)")
def _(spark, sf_dir):
    return files.vector(spark, [1.5, -2.0, 4.25], "double")


@query("src_scalar", "SELECT 7::BIGINT AS v")
def _(spark, sf_dir):
    return spark.range(1).select(F.lit(7).cast("bigint").alias("v"))


@query("src_empty", "SELECT 0::BIGINT AS i, 0::DOUBLE AS v WHERE false")
def _(spark, sf_dir):
    return spark.createDataFrame([], "i bigint, v double")


for name, value, dtype in (("zeros", 0, "int"), ("ones", 1, "int"), ("full", 2.5, "double")):

    @query(f"src_{name}", f"SELECT range AS i, {value}::{dtype.upper()} AS v FROM range(64)")
    def _(spark, sf_dir, value=value, dtype=dtype):
        return files.constant(spark, 64, value, dtype)


@query("src_like", f"SELECT i, 3.0::DOUBLE AS v FROM {FRAME}")
def _(spark, sf_dir):
    f = frame(spark, sf_dir)
    return f.select("i", F.lit(3).cast(f.schema["y"].dataType).alias("v"))


@query("src_wrap", "SELECT * FROM (VALUES (0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 255)) t(i0, i1, v)")
def _(spark, sf_dir):
    raw = spark.range(1).select(F.unhex(F.lit("010203000405FF00")).alias("b"))  # two rows of four bytes, the last one padding
    return files.wrap_bytes(raw, "b", 3, 4)


@query("src_mmap", "SELECT count(*)::BIGINT AS n, sum(p_size)::BIGINT AS s FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.sum("p_size").alias("s"))


@query("src_file", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name")


@query("src_readline_files", "SELECT c_name AS value FROM customer")
def _(spark, sf_dir):
    path = files.shared_path(spark, "readline")
    table(spark, sf_dir, "customer").select("c_name").write.text(path)
    return files.read_lines(spark, path)


@query("src_readline", "SELECT doc_id, (unnest(range(1, len(p) + 1)) - 1)::INT AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def _(spark, sf_dir):
    return files.lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("sink_write", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf_dir):
    return files.write_and_read(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "customer")


@query("sink_text", "SELECT c_name AS value FROM customer")
def _(spark, sf_dir):
    return files.write_and_read(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), "lines", "text")


@query("codec_bytes", """SELECT doc_id, n, CASE WHEN n < 128 THEN printf('%02X', n) WHEN n < 32256 THEN printf('%04X', n + 32768) WHEN n < 65536 THEN 'FE' || printf('%04X', n)
       ELSE 'FF' || printf('%06X', n) END AS header, true AS same FROM (SELECT doc_id, octet_length(encode(text))::INT AS n FROM documents)""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    n = F.octet_length("b")
    coded = files.encode_bytes(F.col("b"))
    return d.select("doc_id", n.alias("n"), F.hex(files.length_header(n)).alias("header"), (files.decode_bytes(coded) == F.col("b")).alias("same"))


@query("meta_promotion", "SELECT * FROM (VALUES " + ", ".join(
    f"('{a.name}', '{b.name}', '{t}')" for a, b, t in (
        (DType.BINARY, DType.BINARY, "UINT8"), (DType.INT3, DType.UINT8, "INT32"), (DType.INT32, DType.F32, "F64"), (DType.F16, DType.BF16, "F32"), (DType.INT64, DType.F64, "error"),
        (DType.F32, DType.UINT256, "error"), (DType.UINT8, DType.UINT256, "UINT256"), (DType.INT8, DType.BF16, "BF16"))) + ") t(a, b, t)")
def _(spark, sf_dir):
    def of(a, b):
        try:
            return promote(a, b).name
        except ValueError:
            return "error"

    pairs = [("BINARY", "BINARY"), ("INT3", "UINT8"), ("INT32", "F32"), ("F16", "BF16"), ("INT64", "F64"), ("F32", "UINT256"), ("UINT8", "UINT256"), ("INT8", "BF16")]
    return spark.createDataFrame([(a, b, of(DType[a], DType[b])) for a, b in pairs], "a string, b string, t string")


@query("meta_size", "SELECT count(*)::BIGINT AS n, count(*) = 0 AS empty, (count(*) * 8)::BIGINT AS bytes FROM part")
def _(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "part").agg(n.alias("n"), (n == 0).alias("empty"), (n * DType.F64.value.bits / 8).cast("bigint").alias("bytes"))


@query("meta_strides", "SELECT * FROM (VALUES (0, 12), (1, 4), (2, 1)) t(axis, stride)")
def _(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(arrays.strides([2, 3, 4]))), "axis int, stride int")


@query("meta_contiguous", "SELECT * FROM (VALUES ('whole', true, 23), ('transposed', false, 15), ('row', true, 3)) t(view, dense, last)")
def _(spark, sf_dir):
    """Whether views of a [2, 3, 4] array are dense, and the place of their last element."""
    views = {"whole": ([2, 3, 4], [12, 4, 1], 0), "transposed": ([4, 3], [1, 4], 4), "row": ([1, 4], [99, 1], 0)}
    rows = [(k, arrays.is_contiguous(n, s), arrays.element_offset([x - 1 for x in n], n, s, o)) for k, (n, s, o) in views.items()]
    return spark.createDataFrame(rows, "view string, dense boolean, last int")

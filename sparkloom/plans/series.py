"""Statistics, series, calendar, wide integers, and extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ieee, wideint
from ..operators import stats
from ..sources import files
from ..streaming import running
from .elementwise import FRAME, frame
from .registry import query, table

c = F.col
NANY = "CASE WHEN i % 5 = 0 THEN NULL ELSE y END"
nan = lambda: F.when(c("i") % 5 == 0, F.lit(float("nan"))).otherwise(c("y"))


def _agg(name, f, sql):
    @query(name, f"SELECT {sql} AS v FROM {FRAME}")
    def run(spark, sf_dir):
        return frame(spark, sf_dir).agg(f().alias("v"))


r6 = lambda x: F.round(x, 6)
_agg("st_corr", lambda: r6(stats.corr(nan(), c("a").cast("double"))), f"round(corr(a, {NANY}) FILTER (i % 5 <> 0), 6)")
_agg("st_mse", lambda: r6(stats.mse(c("y"), c("z"))), "round(avg((y - z) * (y - z)), 6)")
_agg("st_mape", lambda: r6(stats.mape(c("u"), c("z"))), "round(avg(abs(u - z) / abs(u)) * 100, 6)")
_agg("st_fitmatch", lambda: r6(stats.fit_match(nan(), c("z"))), f"round(1 - sum(CASE WHEN abs(y) + abs(z) > 0 THEN abs(y - z) / (abs(y) + abs(z)) ELSE 0 END) FILTER (i % 5 <> 0) / count(*) FILTER (i % 5 <> 0), 6)")
_agg("st_mean", lambda: r6(F.avg("y")), "round(avg(y), 6)")
_agg("st_nanmedian_grouped", lambda: stats.nan_median(nan()), f"median({NANY})")


@query("st_nanmedian", f"SELECT median({NANY}) AS v FROM {FRAME}")
def _(spark, sf_dir):
    return stats.median(frame(spark, sf_dir).select(nan().alias("v")), "v")


_agg("st_var", lambda: r6(F.var_pop("y")), "round(var_pop(y), 6)")
_agg("st_var_about", lambda: r6(stats.var_about(c("y"), 0.25)), "round(avg((y - 0.25) * (y - 0.25)), 6)")
_agg("st_std_about", lambda: r6(F.sqrt(stats.var_about(c("y"), 0.25))), "round(sqrt(avg((y - 0.25) * (y - 0.25))), 6)")
_agg("st_mape_zero", lambda: stats.mape(c("y"), c("z")) > 1e308, "count(*) FILTER (y = 0 AND z <> 0) > 0")
_agg("st_std", lambda: r6(F.stddev_pop("y")), "round(stddev_pop(y), 6)")
_agg("st_min", lambda: F.coalesce(F.min(F.when(~F.isnan(nan()), c("y"))), F.lit(float("inf"))), f"min({NANY})")
_agg("st_max", lambda: F.coalesce(F.max(F.when(~F.isnan(nan()), c("y"))), F.lit(float("-inf"))), f"max({NANY})")


@query("st_polyfit", "SELECT round(regr_slope(u * u, u), 5) AS slope, round(regr_intercept(u * u, u), 5) AS intercept FROM " + FRAME)
def _(spark, sf_dir):
    slope, intercept = stats.polyfit(frame(spark, sf_dir).withColumn("w", c("u") * c("u")), "u", "w", 1)
    return spark.range(1).select(F.round(F.lit(slope), 5).alias("slope"), F.round(F.lit(intercept), 5).alias("intercept"))


NOISY = f"(SELECT *, 3 * y * y - 2 * y + 0.5 + (i % 13 - 6) / 8.0::DOUBLE AS w FROM {FRAME})"
#: Normal equations of a parabola by Cramer's rule, about the means of y and its square.
PARABOLA = f"""WITH m AS (SELECT avg(y) AS a, avg(y * y) AS b, avg(w) AS d FROM {NOISY}),
    s AS (SELECT covar_pop(y, y) AS p, covar_pop(y, y * y) AS q, covar_pop(y * y, y * y) AS r, covar_pop(y, w) AS u, covar_pop(y * y, w) AS v FROM {NOISY}),
    k AS (SELECT (u * r - v * q) / (p * r - q * q) AS one, (p * v - q * u) / (p * r - q * q) AS two FROM s)
    SELECT unnest([0, 1, 2])::INT AS power, unnest([round(d - one * a - two * b, 5), round(one, 5), round(two, 5)])::DOUBLE AS v FROM k, m"""


@query("st_polyfit2", PARABOLA)
def _(spark, sf_dir):
    fit = stats.polyfit(frame(spark, sf_dir).withColumn("w", 3 * c("y") * c("y") - 2 * c("y") + 0.5 + (c("i") % 13 - 6) / 8.0), "y", "w", 2)
    return spark.createDataFrame([(k, round(v, 5) + 0.0) for k, v in enumerate(fit[::-1])], "power int, v double")


#: The same for two regressors and noise; a third that is twice the first has no part of its own.
PLANE = f"""WITH f AS (SELECT y, z, 4 + 2 * y - 1.5 * z + (i % 13 - 6) / 8.0::DOUBLE AS w FROM {FRAME}),
    s AS (SELECT avg(y) AS a, avg(z) AS b, avg(w) AS d, covar_pop(y, y) AS p, covar_pop(y, z) AS q, covar_pop(z, z) AS r, covar_pop(y, w) AS u, covar_pop(z, w) AS v FROM f),
    k AS (SELECT *, (u * r - v * q) / (p * r - q * q) AS one, (p * v - q * u) / (p * r - q * q) AS two FROM s)
    SELECT unnest([0, 1, 2, 3])::INT AS k, unnest([round(d - one * a - two * b, 5), round(one, 5), round(two, 5), 0])::DOUBLE AS v FROM k"""


@query("st_linfit", PLANE)
def _(spark, sf_dir):
    t = frame(spark, sf_dir).withColumn("w", 4 + 2 * c("y") - 1.5 * c("z") + (c("i") % 13 - 6) / 8.0).withColumn("twice", c("y") * 2)
    return spark.createDataFrame([(k, round(v, 5) + 0.0) for k, v in enumerate(stats.linfit(t, ["y", "z", "twice"], "w"))], "k int, v double")


SINE = f"""WITH f AS (SELECT y, 2.5 * sin(y + 0.7) + (i % 13 - 6) / 64.0::DOUBLE AS w FROM {FRAME}),
    g AS (SELECT sum(sin(y) * sin(y)) AS p, sum(sin(y) * cos(y)) AS q, sum(cos(y) * cos(y)) AS r, sum(w * sin(y)) AS u, sum(w * cos(y)) AS v FROM f),
    h AS (SELECT atan2(p * v - q * u, u * r - v * q) AS phase FROM g)
    SELECT round(any_value(phase), 5) AS phase, round(avg(w / sin(y + phase)) FILTER (abs(sin(y + phase)) > 0.00001), 4) AS amplitude FROM f, h"""


@query("st_sinefit", SINE)
def _(spark, sf_dir):
    t = frame(spark, sf_dir).withColumn("w", 2.5 * F.sin(c("y") + 0.7) + (c("i") % 13 - 6) / 64.0)
    phase = t.agg(stats.sine_phase(c("y"), c("w")).alias("p")).first()[0]
    return t.agg(F.round(F.lit(phase), 5).alias("phase"), F.round(stats.amplitude(c("y"), c("w"), F.lit(phase)), 4).alias("amplitude"))


@query("st_slidingcorr", "WITH d AS (SELECT event_id AS i, value AS x FROM events) SELECT lag, round(corr(a.x, b.x), 6) AS corr FROM range(16) r(lag), d a JOIN d b ON b.i = a.i + lag GROUP BY lag")
def _(spark, sf_dir):
    return stats.lag_correlation(table(spark, sf_dir, "events"), "event_id", "value", 16).withColumn("corr", r6("corr")).withColumn("lag", c("lag").cast("bigint"))


@query("st_interp", """WITH k AS (SELECT unnest([0.5, 1.0, 2.5, 4.0])::DOUBLE AS xp, unnest([1.0, 3.0, 2.0, 5.0])::DOUBLE AS fp),
    s AS (SELECT xp AS x0, fp AS f0, lead(xp) OVER w AS x1, lead(fp) OVER w AS f1, row_number() OVER w AS n FROM k WINDOW w AS (ORDER BY xp))
    SELECT i, round(f0 + (f1 - f0) / (x1 - x0) * (u - x0), 6) AS y FROM (SELECT i, u FROM """ + FRAME + """) JOIN s ON x1 IS NOT NULL
    AND (u > x0 OR n = 1) AND (u <= x1 OR n = 3)""")
def _(spark, sf_dir):
    knots = spark.createDataFrame([(0.5, 1.0), (1.0, 3.0), (2.5, 2.0), (4.0, 5.0)], "xp double, fp double")
    x = frame(spark, sf_dir).select("i", c("u").alias("x"))
    return x.join(stats.interpolate(x.select("x").distinct(), knots), "x").select("i", r6("y").alias("y"))


@query("st_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey")


@query("st_sorttogether", "SELECT o_totalprice, o_custkey FROM orders ORDER BY o_totalprice, o_orderkey")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy("o_totalprice", "o_orderkey").select("o_totalprice", "o_custkey")


#: Peaks of series (k, p, v): for each value above the cutoff that starts an excursion,
#: the first highest value before the next one below it.  NEXT is the place of that one.
PEAKS = """(WITH s AS ({series}), n AS (SELECT k, p, v, min(CASE WHEN v < {cut} THEN p END) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop,
    max(CASE WHEN v < {cut} THEN p END) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM s)
    SELECT k, first(p ORDER BY v DESC, p) AS i FROM n WHERE v > {cut} AND stop IS NOT NULL GROUP BY k, start, stop)"""
EVENTS = "SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, {v} AS v FROM events"
LEVELS = "SELECT e.k, p, {v} AS v FROM (" + EVENTS.format(v="value") + ") e JOIN (SELECT user_id AS k, avg(value) AS mean, {level} AS lvl FROM events GROUP BY user_id) m USING (k)"


@query("st_maxindexes", "SELECT k AS user_id, i FROM " + PEAKS.format(series=EVENTS.format(v="value"), cut="20.0"))
def _(spark, sf_dir):
    return stats.peaks_per_key(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 20.0)


@query("st_maxindexes_scaled", "SELECT k AS user_id, i FROM " + PEAKS.format(series=EVENTS.format(v="value * -0.5 + 30"), cut="15.0"))
def _(spark, sf_dir):
    return stats.peaks_per_key(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 15.0, scale=-0.5, offset=30.0)


def _turns(level: str) -> str:
    """Half-periods (k, length): neighbouring extrema of different kinds; values are scaled so that the cutoff is zero."""
    up, down = (PEAKS.format(series=LEVELS.format(v=v, level=level), cut="0.0") for v in ("value_", "-value_"))
    up, down = up.replace("-value_", "lvl - (v - mean)").replace("value_", "v - mean - lvl"), down.replace("-value_", "lvl - (v - mean)")
    return f"(SELECT k, i - was AS length FROM (SELECT k, i, kind, lag(i) OVER w AS was, lag(kind) OVER w AS old FROM (SELECT k, i, 1 AS kind FROM {up} UNION ALL SELECT k, i, 0 FROM {down}) WINDOW w AS (PARTITION BY k ORDER BY i)) WHERE old <> kind)"


@query("st_periods", f"SELECT user_id, coalesce(n, 0)::BIGINT AS n_periods FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT k AS user_id, count(*) AS n FROM {_turns('stddev_pop(value)')} GROUP BY k) USING (user_id)")
def _(spark, sf_dir):
    return stats.periods_per_key(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 1.0).select("user_id", "n_periods")


@query("st_frequency", f"SELECT user_id, coalesce(round(1.0 / m, 9), 'NaN'::DOUBLE) AS frequency FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT k AS user_id, median(length) AS m FROM {_turns('var_pop(value)')} GROUP BY k) USING (user_id)")
def _(spark, sf_dir):
    return stats.periods_per_key(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 1.0).select("user_id", F.round("frequency", 9).alias("frequency"))


@query("st_mse_f32", f"SELECT round(avg((y::FLOAT - z::FLOAT)::DOUBLE * (y::FLOAT - z::FLOAT)::DOUBLE), 6) AS v FROM {FRAME}")
def _(spark, sf_dir):
    d = (c("y").cast("float") - c("z").cast("float")).cast("double")
    return frame(spark, sf_dir).agg(r6(F.avg(d * d)).alias("v"))


# calendar
def _day(name, f, sql):
    @query(name, f"SELECT o_orderkey, {sql} AS v FROM orders")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "orders").select("o_orderkey", f().alias("v"))


_day("tm_jdn", lambda: ieee.julian_day(F.to_date("o_orderdate")), "(o_orderdate::DATE - DATE '1970-01-01' + 2440588)::INT")
_day("tm_auc", lambda: ieee.days_since_rome(F.to_date("o_orderdate")), f"(o_orderdate::DATE - DATE '1970-01-01' + 2440588 - {ieee.ROME})::INT")


@query("tm_daymicros", "SELECT event_id, (epoch_us(ts) % 86400000000)::BIGINT AS v FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.unix_micros(c("ts").cast("timestamp")) % 86400000000).alias("v"))


@query("tm_millis", "SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS v FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(c("ts").cast("timestamp")).alias("v"))


# wide integers of every width.  The oracle works in HUGEINT: an operand is a * 2**shift + low, whose hex digits are those of a, zeros, and those of low.
TOP = {128: 40, 192: 104, 256: 168, 384: 296, 512: 424}  # shifts that leave 88 bits above
SA, SB = "(p_partkey::HUGEINT * 1000003 + 17)", "(p_size::HUGEINT * 7919 + 5)"
LOW_A, LOW_B = (lambda: c("p_partkey") * 1000003 + 17), (lambda: c("p_size").cast("bigint") * 7919 + 5)


def _long(v, bits=256):
    return wideint.from_long(v, bits, signed=True)


def _hex_sql(v: str, bits: int = 256) -> str:
    """Two's complement of a value that fits in a HUGEINT, a negative one above -2**63."""
    n = bits // 4
    return f"CASE WHEN ({v}) < 0 THEN repeat('f', {n - 16}) || lpad(lower(to_hex((18446744073709551616::HUGEINT + ({v}))::HUGEINT)), 16, '0') ELSE lpad(lower(to_hex(({v})::HUGEINT)), {n}, '0') END"


def _wide(name, op, sql, a=None, b=None, bits=256):
    """sql: the value, or, with a leading hex:, its digits."""
    digits = sql[4:] if sql.startswith("hex:") else _hex_sql(sql, bits)

    @query(f"u_{name}", f"SELECT p_partkey AS i, {digits} AS v FROM part")
    def run(spark, sf_dir):
        x, y = (a or (lambda: _long(LOW_A(), bits)))(), (b or (lambda: _long(LOW_B(), bits)))()
        return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), wideint.to_hex(wideint.apply(op, x, y, bits)).alias("v"))


def _shifted(v, shift, bits):
    """v * 2**shift, made of its hex digits."""
    return wideint.parse_hex(F.concat(F.hex(v), F.lit("0" * (shift // 4))), bits)


def _digits(v: str, shift: int, low: str, bits: int) -> str:
    """Hex digits of v * 2**shift + low, low below 2**shift."""
    return f"hex:lpad(lower(to_hex({v})) || lpad(lower(to_hex({low})), {shift // 4}, '0'), {bits // 4}, '0')"


# operands may be negative or zero: half of the dividends are negative, a seventh of the divisors zero, a fifth negative
SIGNED_A, ZERO_B = "(CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END * " + SA + ")", "(CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN -1 ELSE 1 END * " + SB + ")"
signed_a = lambda: F.when(c("p_partkey") % 2 == 0, -LOW_A()).otherwise(LOW_A())
zero_b = lambda: F.when(c("p_partkey") % 7 == 0, 0).when(c("p_partkey") % 5 == 0, -LOW_B()).otherwise(LOW_B())
plain_b = lambda: F.when(c("p_partkey") % 7 == 0, 0).otherwise(LOW_B())
PLAIN_B = f"(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE {SB} END)"
small = lambda bits=256: _long(c("p_size") % 3 + 1, bits)
for bits, shift in TOP.items():
    tag = "" if bits == 256 else f"{bits}_"
    high = lambda bits=bits, shift=shift: wideint.apply("or", _shifted(LOW_A(), shift, bits), _long(LOW_B(), bits), bits)
    HIGH = lambda v, low, bits=bits, shift=shift: _digits(v, shift, low, bits)
    at = lambda n, bits=bits: lambda: _long(F.lit(n).cast("bigint"), bits)
    _wide(tag + "add", "add", HIGH(f"{SA} + {SA}", f"{SB} + {SB}"), a=high, b=high, bits=bits)
    _wide(tag + "sub", "sub", f"{SIGNED_A} - {SB}", a=lambda bits=bits: _long(signed_a(), bits), bits=bits)
    _wide(tag + "mul", "mul", HIGH(f"{SA} * {SB}", f"{SB} * {SB}"), a=high, bits=bits)
    _wide(tag + "mul_signed", "mul", f"{SIGNED_A} * p_size", a=lambda bits=bits: _long(signed_a(), bits), b=lambda bits=bits: _long(c("p_size"), bits), bits=bits)
    _wide(tag + "div", "div", f"hex:CASE WHEN {PLAIN_B} = 0 THEN repeat('0', {bits // 4}) ELSE lpad(lower(to_hex({SA} // {SB})), {bits // 4}, '0') END", a=lambda bits=bits, shift=shift: _shifted(LOW_A(), shift, bits),
          b=lambda bits=bits, shift=shift: _shifted(plain_b(), shift, bits), bits=bits)
    _wide(tag + "mod", "mod", f"hex:CASE WHEN {PLAIN_B} = 0 THEN repeat('0', {bits // 4}) ELSE lpad(lower(to_hex({SA} % {SB})) || repeat('0', {shift // 4}), {bits // 4}, '0') END",
          a=lambda bits=bits, shift=shift: _shifted(LOW_A(), shift, bits), b=lambda bits=bits, shift=shift: _shifted(plain_b(), shift, bits), bits=bits)
    _wide(tag + "sdiv", "sdiv", f"CASE WHEN {ZERO_B} = 0 THEN 0 ELSE {SIGNED_A} // nullif({ZERO_B}, 0) END", a=lambda bits=bits: _long(signed_a(), bits), b=lambda bits=bits: _long(zero_b(), bits), bits=bits)
    _wide(tag + "smod", "smod", f"CASE WHEN {ZERO_B} = 0 THEN 0 ELSE {SIGNED_A} % nullif({ZERO_B}, 0) END", a=lambda bits=bits: _long(signed_a(), bits), b=lambda bits=bits: _long(zero_b(), bits), bits=bits)
    _wide(tag + "shl", "shl", f"hex:lpad(lower(to_hex({SA})) || repeat('0', {shift // 4}), {bits // 4}, '0')", b=at(shift), bits=bits)
    _wide(tag + "shr", "shr", SA, a=high, b=at(shift), bits=bits)
    _wide(tag + "sar", "sar", f"CASE WHEN p_partkey % 2 = 0 THEN -(({SA} + 4095) // 4096) ELSE {SA} // 4096 END", a=lambda bits=bits: _long(signed_a(), bits), b=at(12), bits=bits)
    _wide(tag + "setbit", "set_bit", _digits("1::HUGEINT", shift + 60, SA, bits), b=at(shift + 60), bits=bits)
_wide("pow", "pow", f"CASE p_size % 3 + 1 WHEN 1 THEN {SA} WHEN 2 THEN {SA} * {SA} ELSE {SA} * {SA} * {SA} END", b=small)
_wide("pow_wide", "pow", "hex:lpad(CASE p_size % 3 + 1 WHEN 1 THEN '1' || repeat('0', 15) WHEN 2 THEN '1' || repeat('0', 30) ELSE '1' || repeat('0', 45) END, 64, '0')", a=lambda: _shifted(F.lit(1), 60, 256), b=small)
_wide("root", "root", "p_partkey", a=lambda: wideint.apply("mul", _long(c("p_partkey")), _long(c("p_partkey"))), b=lambda: _long(F.lit(2).cast("bigint")))
_wide("and", "and", f"{SA} & {SB}")
_wide("or", "or", f"{SA} | {SB}")
_wide("xor", "xor", f"xor({SA}, {SB})")


@query("u_not", f"SELECT p_partkey AS i, {_hex_sql(f'-{SA} - 1')} AS v FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), wideint.to_hex(wideint.invert(_long(LOW_A()))).alias("v"))


@query("u_getbit", f"SELECT p_partkey AS i, (({SA} >> (p_partkey % 40)::INT) & 1) = 1 AS v, p_partkey % 2 = 0 AS sign FROM part")
def _(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select(c("p_partkey").alias("i"), wideint.get_bit(_long(LOW_A()), (c("p_partkey") % 40).cast("int")).alias("v"), wideint.get_bit(_long(signed_a()), F.lit(255)).alias("sign"))


@query("u_bytes", f"SELECT p_partkey AS i, {_hex_sql(SA)} AS big, {_hex_sql(SA)} AS back FROM part")
def _(spark, sf_dir):
    """Byte strings in either order, and digits beyond the width, of which the leading ones stay."""
    a = _long(LOW_A())
    little = wideint.from_bytes(wideint.to_bytes(a, little=True), little=True)
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), wideint.to_hex(little).alias("big"), wideint.to_hex(wideint.parse_hex(F.concat(F.lit("0x"), wideint.to_hex(a), F.lit("123")))).alias("back"))


@query("u_signed_less", f"SELECT p_partkey AS i, {SIGNED_A} < {ZERO_B} AS v, CASE WHEN ({SIGNED_A} < 0) = ({ZERO_B} < 0) THEN {SIGNED_A} < {ZERO_B} ELSE {SIGNED_A} > 0 OR {ZERO_B} < 0 END AS plain FROM part")
def _(spark, sf_dir):
    a, b = _long(signed_a()), _long(zero_b())
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), wideint.less_than(a, b, signed=True).alias("v"), wideint.less_than(a, b).alias("plain"))


@query("u_parse", "SELECT p_partkey AS i, lpad(lower(hex(p_partkey)), 64, '0') AS v FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), wideint.to_hex(wideint.parse_hex(F.concat(F.lit("0x"), F.hex("p_partkey")))).alias("v"))


@query("u_neg", "SELECT p_partkey AS i, CASE WHEN p_partkey = 0 THEN repeat('0', 64) ELSE repeat('f', 48) || lower(to_hex((18446744073709551616::HUGEINT - p_partkey)::HUGEINT)) END AS v FROM part")
def _(spark, sf_dir):
    zero = wideint.from_long(F.lit(0).cast("bigint"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), wideint.to_hex(wideint.apply("sub", zero, wideint.from_long(c("p_partkey")))).alias("v"))


@query("u_compare", "SELECT p_partkey AS i, p_partkey < p_size AS lt, p_partkey <= p_size AS le FROM part")
def _(spark, sf_dir):
    a, b = wideint.from_long(c("p_partkey")), wideint.from_long(c("p_size").cast("bigint"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), (a < b).alias("lt"), (a <= b).alias("le"))


@query("u_countbits", "SELECT p_partkey AS i, bit_count(p_partkey)::INT AS v FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), wideint.bit_count(wideint.from_long(c("p_partkey"))).cast("int").alias("v"))


@query("u_constrain", "SELECT p_partkey AS i, least(p_partkey, 255)::INT AS v FROM part")
def _(spark, sf_dir):
    a = wideint.from_long(c("p_partkey"))
    low = F.conv(F.hex(F.substring(a, 25, 8)), 16, 10).cast("bigint")
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), F.when(a > wideint.from_long(F.lit(255).cast("bigint")), 255).otherwise(low).cast("int").alias("v"))


@query("u_double", f"SELECT p_partkey AS i, {SA}::DOUBLE * power(2.0::DOUBLE, 168) AS v, floor({SA}::DOUBLE * 1.5)::HUGEINT::VARCHAR AS half_more FROM part")
def _(spark, sf_dir):
    """To a double beyond 64 bits, and a product with one: the floor, back as a whole number."""
    product = wideint.from_double(F.floor(wideint.to_double(_long(LOW_A())) * 1.5).cast("double"))
    low = F.conv(F.hex(F.substring(product, 25, 8)), 16, 10)
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), wideint.to_double(_shifted(LOW_A(), 168, 256)).alias("v"), low.alias("half_more"))


@query("u_from_double", f"SELECT p_partkey AS i, lpad(lower(to_hex({SA})) || repeat('0', 40), 64, '0') AS v, {_hex_sql('-p_partkey - 1')} AS negative FROM part")
def _(spark, sf_dir):
    x = LOW_A().cast("double") * float(1 << 160)
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("i"), wideint.to_hex(wideint.from_double(x)).alias("v"), wideint.to_hex(wideint.from_double(-c("p_partkey") - 1.75)).alias("negative"))


@query("u_sum", "SELECT p_size AS k, lpad(lower(hex(sum(p_partkey)::BIGINT)), 64, '0') AS v FROM part GROUP BY p_size")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(c("p_size").alias("k"), wideint.from_long(c("p_partkey")).alias("w")).groupBy("k").agg(wideint.total(c("w")).alias("v")).withColumn("v", wideint.to_hex(c("v")))


# extensions
WINDOWED = "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY ALL"


@query("ext_windowed", WINDOWED)
def _(spark, sf_dir):
    return running.windowed(table(spark, sf_dir, "events"))


@query("ext_stream_windowed", WINDOWED)
def _(spark, sf_dir):
    # a file stream takes a folder; the glob names the one file of the table
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return running.run_once(running.windowed(stream, watermark="400 days"), files.shared_path(spark, "stream"))


@query("ext_rollup", "SELECT l_returnflag AS f, l_linestatus AS s, count(*)::BIGINT AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup(c("l_returnflag").alias("f"), c("l_linestatus").alias("s")).agg(F.count("*").alias("n"))

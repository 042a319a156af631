"""Statistics and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..sources import files


def complete(x: Column, y: Column) -> Column:
    return ~F.isnan(x) & ~F.isnan(y)


def corr(x: Column, y: Column) -> Column:
    """Pearson with pairwise deletion of NaN, 0 where a variance is 0.  Central moments
    are merged from partial aggregates, so large means don't cancel the digits."""
    ok = complete(x, y)
    own = lambda v: F.when(ok, v.cast("double"))
    spread = F.sqrt(F.var_pop(own(x))) * F.sqrt(F.var_pop(own(y)))
    return F.when(spread > 0, F.covar_pop(own(x), own(y)) / F.when(spread > 0, spread)).otherwise(0.0)


def var_about(v: Column, mean: float) -> Column:
    """Population variance about a given mean."""
    return F.avg((v - F.lit(float(mean))) * (v - F.lit(float(mean))))


def polyfit(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Least squares, highest power first: one pass of power sums, a small solve."""
    import numpy as np

    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    sums = [F.sum(F.pow(xs, F.lit(float(k)))) for k in range(2 * degree + 1)] + [F.sum(F.pow(xs, F.lit(float(k))) * ys) for k in range(degree + 1)]
    got = df.where(complete(xs, ys)).agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
    a = np.array([[got[i + j] for j in range(degree + 1)] for i in range(degree + 1)], float)
    return np.linalg.solve(a, np.array(got[2 * degree + 1 :], float))[::-1].tolist()


def linfit(df: DataFrame, xs: list[str], y: str) -> list[float]:
    """Multivariate least squares, the intercept first; a pivot below 1e-6 leaves its coefficient 0."""
    import numpy as np

    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
    ok = ~F.isnan(cols[-1])
    for c in cols[1:-1]:
        ok = ok & ~F.isnan(c)
    n = len(cols)
    got = df.where(ok).agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    g = np.zeros((n, n))
    at = 0
    for i in range(n):
        for j in range(i, n):
            g[i, j] = g[j, i] = got[at] or 0.0
            at += 1
    a, b, live = g[:-1, :-1].copy(), g[:-1, -1].copy(), []
    for i in range(n - 1):
        rest = a[i, i] - (a[i, live] @ np.linalg.solve(a[np.ix_(live, live)], a[live, i]) if live else 0)
        if abs(rest) >= 1e-6:
            live.append(i)
    out = np.zeros(n - 1)
    if live:
        out[live] = np.linalg.solve(a[np.ix_(live, live)], b[live])
    return out.tolist()


def sine_phase(x: Column, y: Column) -> Column:
    """Phase of the sine that fits y best, one pass."""
    sc, ss, cc, cs = F.sum(y * F.cos(x)), F.sum(y * F.sin(x)), F.sum(F.cos(x) * F.cos(x)), F.sum(F.sin(x) * F.cos(x))
    sn = F.sum(F.sin(x) * F.sin(x))
    # y = p sin x + q cos x; phase = atan2(q, p)
    det = sn * cc - cs * cs
    return F.atan2((sc * sn - ss * cs) / det, (ss * cc - sc * cs) / det)


def amplitude(x: Column, y: Column, phase: Column) -> Column:
    s = F.sin(x + phase)
    return F.avg(F.when(F.abs(s) > 1e-5, y / s))


def mse(a: Column, b: Column) -> Column:
    return F.avg((a - b) * (a - b))


def mape(a: Column, b: Column) -> Column:
    return F.avg(ieee.div(F.abs(a - b), F.abs(a))) * 100


def fit_match(a: Column, b: Column) -> Column:
    """1 less the mean relative difference; zero denominators count and add nothing."""
    ok, d = complete(a, b), F.abs(a) + F.abs(b)
    return 1 - F.sum(F.when(ok & (d > 0), F.abs(a - b) / F.when(d > 0, d)).when(ok, 0.0)) / F.count_if(ok)


def nan_median(v: Column) -> Column:
    """Median of the finite values of a group; it keeps the group's distinct values in one task (see median())."""
    return F.coalesce(F.percentile(F.when(ieee.is_finite(v), v), F.lit(0.5)), F.lit(float("nan")))


def median(df: DataFrame, v: str) -> DataFrame:
    """(v) in one row: the exact median of the finite values of a whole table, NaN if
    there is none.  Distinct values are counted and sorted by ranges, each range is
    counted (a row per range), and only the ranges that hold the middle are read."""
    x = F.col(v).cast("double")
    counted = df.where(ieee.is_finite(x)).groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    held = files.write_and_read(counted.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "median")
    sizes = held.groupBy("part").agg(F.sum("n").alias("size"))
    order = Window.orderBy("part")  # a row per range
    spans = sizes.select("part", (F.sum("size").over(order) - F.col("size")).alias("before"), F.col("size"), F.sum("size").over(Window.partitionBy()).alias("all"))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)  # ranks of the middle, from 0
    spans = spans.where((F.col("before") <= high) & (F.col("before") + F.col("size") > low))
    inner = held.join(F.broadcast(spans), "part")
    reach = inner.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("x")))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    return reach.agg(F.coalesce((at(low) + at(high)) / 2, F.lit(float("nan"))).alias(v))


def lag_correlation(df: DataFrame, i: str, x: str, lags: int) -> DataFrame:
    """corr(x[:n - lag], x[lag:]) for each lag below lags: a row emits its lags, an equi-join pairs them."""
    one = df.select(F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag"), (F.col(i)).alias("i"), F.col(x).alias("x")).withColumn("j", F.col("i") + F.col("lag"))
    two = df.select(F.col(i).alias("j"), F.col(x).alias("y"))
    return one.join(two, "j").groupBy("lag").agg(corr(F.col("x"), F.col("y")).alias("corr"))


def interpolate(probes: DataFrame, knots: DataFrame) -> DataFrame:
    """Piecewise linear with extrapolation; probes (x), knots (xp, fp) in a bounded number.

    The knots become one array (a row), searched by filter per probe: no window over the probes."""
    table = knots.agg(F.array_sort(F.collect_list(F.struct("xp", "fp"))).alias("t"))
    joined = probes.crossJoin(F.broadcast(table))  # one row
    n = F.size("t")
    k = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter("t", lambda p: p["xp"] < F.col("x")))))
    a, b = F.element_at("t", k), F.element_at("t", k + 1)
    return joined.select("x", (a["fp"] + (b["fp"] - a["fp"]) / (b["xp"] - a["xp"]) * (F.col("x") - a["xp"])).alias("y"))


def _above(frame: DataFrame, key: str, pos: str, v: str, cutoff: Column) -> DataFrame:
    """(key, at): the first highest point of each stretch above cutoff that values
    below cutoff end.  Values below cutoff cut the series into stretches, numbered by a
    running count; the last number belongs to what nothing ends."""
    w = Window.partitionBy(key).orderBy(pos)
    x = F.when(~F.isnan(v), F.col(v))
    cut = frame.withColumn("stretch", F.count_if(F.coalesce(x < cutoff, F.lit(False))).over(w))
    cut = cut.withColumn("last", F.max("stretch").over(Window.partitionBy(key)))
    high = cut.where((x > cutoff) & (F.col("stretch") < F.col("last")))
    top = F.max(F.struct(F.col(v).alias("v"), (-F.col(pos)).alias("before"))).alias("top")
    return high.groupBy(key, "stretch").agg(top).select(key, (-F.col("top.before")).alias("at"))


def _placed(df: DataFrame, key: str, seq: str, v: str) -> DataFrame:
    """(key, pos, v): values with their positions from 0 in the series of their key."""
    pos = (F.row_number().over(Window.partitionBy(key).orderBy(seq)) - 1).cast("long")
    return df.select(key, pos.alias("pos"), F.col(v).cast("double").alias("v"))


def peaks_per_key(df: DataFrame, key: str, seq: str, v: str, cutoff: float, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """(key, i): the highest point of each stretch of scale v + offset above cutoff that is left again."""
    rows = df.withColumn(v, F.col(v) * F.lit(float(scale)) + F.lit(float(offset)))
    return _above(_placed(rows, key, seq, v), key, "pos", "v", F.lit(float(cutoff))).select(key, F.col("at").alias("i"))


def _half_periods(frame: DataFrame, key: str, cutoff: Column) -> DataFrame:
    """(key, middle, length) between neighbouring extrema of frame (key, pos, d, and
    what cutoff needs): maxima are peaks of d above cutoff, minima those of -d above
    -cutoff; of the extrema in order, every two neighbours of different kinds."""
    high = _above(frame, key, "pos", "d", cutoff).withColumn("kind", F.lit(1))
    low = _above(frame.withColumn("d", -F.col("d")), key, "pos", "d", -cutoff).withColumn("kind", F.lit(0))
    w = Window.partitionBy(key).orderBy("at")
    both = high.union(low).select(key, "at", F.lag("at").over(w).alias("was"), (F.lag("kind").over(w) != F.col("kind")).alias("turn"))
    return both.where("turn").select(key, ((F.col("at") + F.col("was")) / 2).alias("middle"), (F.col("at") - F.col("was")).alias("length"))


def periods_per_key(df: DataFrame, key: str, seq: str, v: str, rate: float) -> DataFrame:
    """(key, n_periods, frequency) of each series: half-periods beyond a standard
    deviation, and rate over the median of those beyond the variance (NaN if none)."""
    all_of = Window.partitionBy(key)
    frame = _placed(df, key, seq, v).withColumns({"mean": F.avg("v").over(all_of), "var": F.var_pop("v").over(all_of)}).withColumn("d", F.col("v") - F.col("mean"))
    n = _half_periods(frame, key, F.sqrt("var")).groupBy(key).agg(F.count("*").alias("n"))
    mid = _half_periods(frame, key, F.col("var")).groupBy(key).agg(F.median("length").alias("mid"))
    keys = df.select(key).distinct()
    out = keys.join(n, key, "left").join(mid, key, "left")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n_periods"), F.coalesce(F.lit(float(rate)) / F.col("mid"), F.lit(float("nan"))).alias("frequency"))


def peaks(values, cutoff: float) -> list[int]:
    """peaks_per_key() of a series in memory: indexes of its peaks."""
    import numpy as np

    v = np.asarray(values, float)
    ends = np.flatnonzero(v < cutoff)
    out = []
    for part in np.split(np.arange(len(v)), ends)[:-1] if len(ends) else []:
        part = part[v[part] > cutoff]
        if len(part):
            out.append(int(part[np.argmax(v[part])]))
    return out


def half_periods(xs, ys, cutoff: float, mean: float) -> list[tuple[float, float]]:
    """(middle, length) between neighbouring extrema of a series in memory."""
    import numpy as np

    d = np.asarray(ys, float) - mean
    extrema = sorted([(k, True) for k in peaks(d, cutoff)] + [(k, False) for k in peaks(-d, -cutoff)])
    return [((xs[a] + xs[b]) / 2, xs[b] - xs[a]) for (a, high), (b, too) in zip(extrema, extrema[1:]) if high != too]

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import ieee, wideint
from sparkloom.operators import arrays, ordered, stats
from sparkloom.sources import files

INF, NAN = float("inf"), float("nan")


def same(a, b):
    return a == b or (a != a and b != b)


def test_ieee_division_and_logs(spark):
    xs = [0.0, -0.0, 1.0, -2.5, INF, -INF, NAN]
    df = spark.createDataFrame([(a, b) for a in xs for b in xs], "a double, b double")
    import numpy as np

    for r in df.select("a", "b", ieee.div(F.col("a"), F.col("b")).alias("q"), ieee.log(F.col("a")).alias("l"), ieee.fmax(F.col("a"), F.col("b")).alias("m"), ieee.eq(F.col("a"), F.col("b")).alias("e")).collect():
        with np.errstate(all="ignore"):
            assert same(r["q"], float(np.float64(r["a"]) / np.float64(r["b"]))), r
            assert same(r["l"], float(np.log(np.float64(r["a"])))), r
            assert same(r["m"], float(np.fmax(r["a"], r["b"]))), r
        assert r["e"] == (r["a"] == r["b"])


def test_same_results_with_and_without_ansi(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-3.0, 2.0)], "a double, b double")
    got = []
    for mode in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", mode)
        got.append([str(r) for r in df.select(ieee.div(F.col("a"), F.col("b")), ieee.log10(F.col("a")), ieee.safe_div(F.col("a"), F.col("b"), F.lit(7.0))).collect()])
    spark.conf.set("spark.sql.ansi.enabled", "true")
    assert got[0] == got[1]


def test_axis_sums(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0), (1, 2, 6.0)], "i0 int, i1 int, v double")
    assert sorted(map(tuple, arrays.reduce_axis(df, ["i1"], v=F.sum("v")).collect())) == [(0, 5.0), (1, 7.0), (2, 9.0)]
    assert sorted(map(tuple, arrays.reduce_axis(df, ["i0"], v=F.sum("v")).collect())) == [(0, 6.0), (1, 15.0)]
    assert sorted(map(tuple, arrays.reshape(df, ["i0", "i1"], [2, 3], [3, 2]).collect()))[2] == (1, 0, 3.0)
    with pytest.raises(ValueError):
        arrays.reshape(df, ["i0", "i1"], [2, 3], [4, 2])
    with pytest.raises(ValueError):
        arrays.permute(df, ["i0", "i1"], [0, 0])


def test_select_formula(spark):
    df = spark.createDataFrame([(2.0, 2.0, 3.0, 4.0), (1.0, 2.0, 8.0, 0.0), (1.0, 0.0, 8.0, 1.0)], "a double, b double, va double, vb double")
    c = F.col
    b2 = c("b") * c("b")
    v = ieee.piecewise([(c("vb") == 0, ieee.safe_div(c("va"), b2, F.lit(0.0))), (c("b") != 0, ieee.safe_div(c("a") * c("a") * c("vb") + b2 * c("va"), b2 * b2, F.lit(0.0)))], F.lit(-1.0))
    assert [r[0] for r in df.select(v).collect()] == [1.75, 2.0, -1.0]


def test_batched_matmul(spark):
    a = [(p, i, k, float(10 * p + 3 * i + k + 1)) for p in range(2) for i in range(2) for k in range(3)]
    b = [(p, k, j, float(7 * p + 2 * k + j + 1)) for p in range(2) for k in range(3) for j in range(2)]
    got = arrays.batched_matmul(spark.createDataFrame(a, "p int, i int, k int, v double"), spark.createDataFrame(b, "p int, k int, j int, v double")).collect()
    va, vb = {r[:3]: r[3] for r in a}, {r[:3]: r[3] for r in b}
    assert {tuple(r[:3]): r[3] for r in got} == {(p, i, j): sum(va[p, i, k] * vb[p, k, j] for k in range(3)) for p in range(2) for i in range(2) for j in range(2)}


def test_scaled_gemv(spark):
    w = [[(k + i) % 7 - 3 for k in range(128)] for i in range(3)]
    x, scales = [k % 5 - 2 for k in range(128)], [[0.5, 2.0], [1.0, -1.0], [0.25, 4.0]]
    df = spark.createDataFrame([(i, w[i], x, scales[i]) for i in range(3)], "i int, w array<int>, x array<int>, s array<double>")
    got = {r[0]: r[1] for r in df.select("i", arrays.gemv_scaled(F.col("w"), F.col("x"), F.col("s"), 64)).collect()}
    for i in range(3):
        assert got[i] == sum(scales[i][g] * sum(w[i][k] * x[k] for k in range(64 * g, 64 * g + 64)) for g in range(2))


def test_softmax_and_rmsnorm(spark):
    r = spark.createDataFrame([([3.0, 4.0],)], "x array<double>").select(arrays.rmsnorm_cell(F.col("x"), F.array(F.lit(1.0), F.lit(1.0)), 0.0).alias("r"), arrays.softmax_cell(F.col("x")).alias("s")).first()
    assert all(math.isclose(a, b / math.sqrt(12.5)) for a, b in zip(r["r"], (3, 4))) and math.isclose(sum(r["s"]), 1)


def test_ceiling_lookups(spark):
    rng = random.Random(1)
    keys = rng.sample(range(-100_000, 100_000), 1500)
    probes = [rng.randint(-101_000, 101_000) for _ in range(1000)] + keys[:20]
    k, p = spark.createDataFrame([(x,) for x in keys], "k long"), spark.createDataFrame([(x,) for x in probes], "x long")
    got = {r["x"]: r["found"] for r in ordered.ceiling(p, k, "x", "k", 8).collect()}
    assert got == {x: min((y for y in keys if y >= x), default=None) for x in probes}


def test_keyed_rows(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7)], "seq int, k string, v int")
    assert sorted((r["k"], r["v"], r["existed"]) for r in ordered.insert_if_absent(rows, "k", "seq").collect()) == [("a", 5, True), ("b", 7, False)]
    assert sorted((r["k"], r["v"]) for r in ordered.upsert(rows, "k", "seq").collect()) == [("a", 6), ("b", 7)]
    q = spark.createDataFrame([(0, "a", 5), (1, "b", 3), (2, "c", 1), (3, "d", 2)], "seq int, v string, p int")
    assert [r["v"] for r in ordered.top_k(q, [F.col("p"), F.col("seq")], 3).collect()] == ["c", "d", "b"]
    regions = spark.createDataFrame([(0, 4096), (8192, 1024), (16384, 2048)], "offset long, size long")
    assert ordered.best_fit(regions, 1000).first()["size"] == 1024 and ordered.best_fit(regions, 9999).count() == 0
    names = spark.createDataFrame([("abcdef",), ("abx",), ("zz",)], "n string")
    prefixes = spark.createDataFrame([("ab",), ("abcd",), ("q",)], "k string")
    assert {r["n"]: r["prefix"] for r in ordered.longest_prefix(names, prefixes, "n", "k", 8).collect()} == {"abcdef": "abcd", "abx": "ab"}


def test_statistics(spark):
    import numpy as np

    x = [1.0, 2.0, NAN, 4.0, 5.0]
    y = [2.0, 1.0, 3.0, NAN, 7.0]
    df = spark.createDataFrame(list(zip(range(5), x, y)), "i int, x double, y double")
    r = df.agg(stats.corr(F.col("x"), F.col("y")).alias("c"), stats.nan_median(F.col("y")).alias("m"), stats.corr(F.col("x"), F.lit(1.0)).alias("z")).first()
    assert math.isclose(r["c"], np.corrcoef([1, 2, 5], [2, 1, 7])[0, 1]) and r["m"] == 2.5 and r["z"] == 0.0
    d = spark.createDataFrame([(float(k), 2.0 * k * k - k + 3) for k in range(10)], "x double, y double")
    assert np.allclose(stats.polyfit(d, "x", "y", 2), [2, -1, 3])
    assert stats.linfit(d.withColumn("o", F.lit(1.0)).withColumn("w", 2 * F.col("x") + 5), ["x", "o"], "w") == pytest.approx([5, 2, 0])
    p = spark.createDataFrame([(0.5,), (0.001,), (0.999,), (0.0,), (1.0,), (-1.0,)], "p double").select(ieee.norm_inv(F.col("p"))).collect()
    assert [round(r[0], 4) for r in p] == [0.0, -3.0902, 3.0902, 0.0, 0.0, 0.0]
    assert stats.peaks([0, 3, 5, 4, 0, 6, 0, 9], 2) == [2, 5]


def test_wide_integers(spark):
    rng = random.Random(2)
    n = 256
    pairs = [(rng.getrandbits(n), rng.getrandbits(rng.choice([8, 60, 256]))) for _ in range(30)] + [(5, 0), ((1 << n) - 7, 3), (1 << n - 1, (1 << n) - 1), (0, 0), (1 << n - 1, 255), ((1 << n) - 9, (1 << n) - 2)]
    df = spark.createDataFrame([(bytearray(a.to_bytes(32, "big")), bytearray(b.to_bytes(32, "big"))) for a, b in pairs], "a binary, b binary")
    signed = lambda x: x - (1 << n) if x >> n - 1 else x
    cut = lambda x, y: (abs(x) // abs(y)) * (-1 if (x < 0) != (y < 0) else 1)
    plain = {
        "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a // b if b else 0, "mod": lambda a, b: a % b if b else 0,
        "sdiv": lambda a, b: cut(signed(a), signed(b)) if b else 0, "smod": lambda a, b: signed(a) - signed(b) * cut(signed(a), signed(b)) if b else 0, "and": lambda a, b: a & b,
        "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b, "shl": lambda a, b: a << b if b < n else 0, "shr": lambda a, b: a >> b if b < n else 0,
        "sar": lambda a, b: signed(a) >> min(b, n), "set_bit": lambda a, b: a | 1 << b if b < n else a,
    }
    for op, f in plain.items():
        got = [int.from_bytes(r[0], "big") for r in df.select(wideint.apply(op, F.col("a"), F.col("b"))).collect()]
        assert got == [f(a, b) % (1 << n) for a, b in pairs], op
    assert [r[0] for r in df.select(F.col("a") < F.col("b")).collect()] == [a < b for a, b in pairs]
    assert [r[0] for r in df.select(wideint.bit_count(F.col("a"))).collect()] == [a.bit_count() for a, _ in pairs]
    assert wideint.root(10**40, 2) == 10**20 and wideint.root(10**40 - 1, 2) == 10**20 - 1


def test_wide_integers_of_other_widths_and_conversions(spark):
    rng = random.Random(5)
    for n in wideint.WIDTHS:
        pairs = [(rng.getrandbits(n), rng.getrandbits(rng.choice([5, 40, n]))) for _ in range(12)] + [((1 << n) - 1, 1), (0, 0), (1 << n - 1, n - 1)]
        df = spark.createDataFrame([(a.to_bytes(n // 8, "big"), b.to_bytes(n // 8, "big")) for a, b in pairs], "a binary, b binary")
        a, b = F.col("a"), F.col("b")
        for op, f in (("add", lambda x, y: x + y), ("mul", lambda x, y: x * y), ("shl", lambda x, y: x << y if y < n else 0), ("div", lambda x, y: x // y if y else 0)):
            assert [int.from_bytes(r[0], "big") for r in df.select(wideint.apply(op, a, b, n)).collect()] == [f(x, y) % (1 << n) for x, y in pairs], (n, op)
        sign = lambda x: x - (1 << n) if x >> n - 1 else x
        got = df.select(wideint.invert(a, n), wideint.less_than(a, b, True), wideint.to_double(a, n), wideint.bit_count(a, n), wideint.bit_length(a, n), wideint.get_bit(a, F.lit(9), n), wideint.from_bytes(wideint.to_bytes(a, True), n, True))
        for (x, y), r in zip(pairs, got.collect()):
            assert int.from_bytes(r[0], "big") == x ^ (1 << n) - 1 and r[1] == (sign(x) < sign(y)) and math.isclose(r[2], float(x), rel_tol=1e-15) and bytes(r[6]) == x.to_bytes(n // 8, "big")
            assert (r[3], r[4], r[5]) == (x.bit_count(), x.bit_length(), bool(x >> 9 & 1))
        chained = df.select(wideint.apply("mul", wideint.apply("add", a, b, n), wideint.apply("xor", a, b, n), n)).collect()
        assert [int.from_bytes(r[0], "big") for r in chained] == [(x + y) * (x ^ y) % (1 << n) for x, y in pairs]
    doubles = [0.0, 1.9, -1.9, 1e60, -3e40, 2.0**255, 1e300, NAN, INF]
    got = spark.createDataFrame([(x,) for x in doubles] + [(None,)], "x double").select(wideint.from_double(F.col("x"))).collect()
    assert [int.from_bytes(r[0], "big") for r in got[:-1]] == [int(x) % (1 << 256) if math.isfinite(x) else 0 for x in doubles] and got[-1][0] is None


def test_nearest_in_a_radix_tree(spark):
    rng = random.Random(8)
    word = lambda: bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(0, 7)))
    keys, probes = {word() for _ in range(40)}, {word() for _ in range(200)} | {b""}
    k, p = (spark.createDataFrame([(bytearray(x),) for x in v], f"{c} binary") for v, c in ((keys, "k"), (probes, "p")))

    def plain(probe):
        if not probe:
            return b"", "invalid key"
        full = [x for x in keys if x]
        paths = {x[:n] for x in full for n in range(len(x) + 1)} | {b""}
        best = max((probe[:n] for n in range(len(probe) + 1) if probe[:n] in paths), key=len)
        node = best in full or best == b"" or len({x[len(best)] for x in full if x.startswith(best) and len(x) > len(best)}) > 1
        return best, "exact" if node and best == probe else "empty entry" if node else "to split"

    got = {bytes(r["p"]): (bytes(r["prefix"]), r["outcome"]) for r in ordered.nearest(p, k, "p", "k").collect()}
    assert {x: got[x] for x in probes if x} == {x: plain(x) for x in probes if x} and got[b""][1] == "invalid key"
    assert [r["outcome"] for r in ordered.nearest(p.where("p = X'61'").union(spark.createDataFrame([(bytearray(b"a"),)], "p binary")), k.limit(0), "p", "k").collect()] == ["empty entry"]


def test_positions_and_ceilings_of_repeated_rows(spark):
    rows = [(k % 3, k) for k in range(50)] + [(1, k) for k in range(500)]
    got = ordered.positions(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], "pos").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["pos"])] == sorted(rows) and sorted(r["pos"] for r in got) == list(range(1, len(rows) + 1))
    keys, probes = [5] * 300 + [9, 40], [5] * 200 + [6, 9, 10, 41, -3]
    k, p = spark.createDataFrame([(x,) for x in keys], "k int"), spark.createDataFrame([(x,) for x in probes], "x int")
    found = ordered.ceiling(p, k, "x", "k")
    assert sorted((r["x"], r["found"]) for r in found.collect() if r["found"]) == [(-3, 5), (5, 5), (6, 9), (9, 9), (10, 40)] and found.count() == 6
    assert {r["found"] for r in ordered.ceiling(p, k.limit(0), "x", "k").collect()} == {None} and ordered.ceiling(p.limit(0), k, "x", "k").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cross" not in plan


def test_best_fit_extends_the_file(spark):
    regions = spark.createDataFrame([(0, 4096), (8192, 1024)], "offset long, size long")
    assert tuple(ordered.best_fit(regions, 2000, 9999).first()) == (0, 4096) and tuple(ordered.best_fit(regions, 5000, 9999).first()) == (10000, 5000)


def test_median_by_ranges(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 1000):
        xs = [round(rng.gauss(0, 3), rng.choice([0, 3])) for _ in range(n)] + [NAN, INF]
        got = stats.median(spark.createDataFrame([(x,) for x in xs], "x double").repartition(3), "x").first()[0]
        import statistics

        assert got == statistics.median(xs[:-2])
    assert math.isnan(stats.median(spark.createDataFrame([(NAN,), (None,)], "x double"), "x").first()[0])


def test_peaks_by_windows(spark):
    """Against a walk along the series."""
    rng = random.Random(12)
    series = {k: [rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0, 3.0, NAN]) for _ in range(rng.randint(1, 60))] for k in range(20)}
    df = spark.createDataFrame([(k, i, v) for k, xs in series.items() for i, v in enumerate(xs)], "k long, i long, v double")
    want = set()
    for k, xs in series.items():
        high = None
        for i, v in enumerate(xs):
            if v > 1 and (high is None or v > xs[high]):
                high = i
            if v < 1 and high is not None:
                want.add((k, high))
                high = None
    assert {(r["k"], r["i"]) for r in stats.peaks_per_key(df, "k", "i", "v", 1.0).collect()} == want
    assert {(r["k"], r["i"]) for r in stats.peaks_per_key(df, "k", "i", "v", 5.0, scale=2.0, offset=3.0).collect()} == want
    assert {(k, i) for k, xs in series.items() for i in stats.peaks(xs, 1.0)} == want


def test_scores_check_lengths_and_hold_long_vectors(spark):
    df = spark.createDataFrame([([1.0] * 65, [1.0] * 64 + [-1.0]), ([1.0] * 130, [1.0] * 130)], "x array<double>, y array<double>")
    x, y = F.col("x"), F.col("y")
    assert [tuple(r) for r in df.select(arrays.hamming(x, y), arrays.bin_dot(x, y)).collect()] == [(1, 64), (0, 130)]
    whole = spark.createDataFrame([([(1 << 62) + 1, 3], [3, 5])], "x array<bigint>, y array<bigint>").select(arrays.whole_dot(x, y)).first()[0]
    assert int(whole) == ((1 << 62) + 1) * 3 + 15
    uneven = spark.createDataFrame([([1.0, 2.0], [1.0])], "x array<double>, y array<double>")
    for f in (arrays.dot, arrays.l2sq, arrays.hamming, arrays.whole_dot):
        with pytest.raises(Exception, match="lengths differ"):
            uneven.select(f(x, y)).collect()


def test_stream_state_is_bounded_by_the_watermark(spark, tmp_path):
    from sparkloom.streaming import running

    rows = [(f"2024-01-0{1 + d} {h:02d}:30:00", e, float(h)) for d in range(3) for h in range(0, 24, 5) for e in ("a", "b")]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for k in range(3):
        df.where(F.dayofmonth("ts") == k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = running.run_once(running.windowed(stream, watermark="2 days"), str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, running.windowed(df).select(*got.columns).collect()))


def test_byte_strings(spark):
    sizes = [0, 1, 127, 128, 32255, 32256, 65535, 65536, 100_000]
    df = spark.createDataFrame([(bytearray(b"x" * n),) for n in sizes], "b binary")
    for n, r in zip(sizes, df.select(files.length_header(F.octet_length("b")).alias("h"), (files.decode_bytes(files.encode_bytes(F.col("b"))) == F.col("b")).alias("same")).collect()):
        h = bytes(r["h"])
        assert r["same"] and len(h) == (1 if n < 128 else 2 if n < 32256 else 3 if n < 65536 else 4)


def plain_dump(b, columns):
    if b is None or not b:
        return "(null)" if b is None else "(empty)"
    width = len(b) if columns == -1 or columns >= len(b) else columns
    lines = []
    for at in range(0, len(b), width):
        part = b[at : at + width]
        text = "".join(chr(x) if 32 <= x <= 126 else "." for x in part)
        lines.append("".join(" " * (k > 0 and k % 8 == 0) + f"{x:02x} " for k, x in enumerate(part)) + f" |{text}|")
    return lines[0] if len(lines) == 1 else "".join(f"{k * width:04x}  {line}\n" for k, line in enumerate(lines))


def test_hex_dump(spark):
    values = [b"ab\x00" * 6, b"", None, b"x", bytes(range(256)), b"12345678", b"123456789", b"a\nb|c\xff" * 5]
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in enumerate(values)], "k int, b binary")
    for columns in (16, 8, 5, 64, -1):
        assert [r[1] for r in df.select("k", files.hex_dump(F.col("b"), columns)).orderBy("k").collect()] == [plain_dump(v, columns) for v in values], columns
    short = spark.createDataFrame([(bytearray(b"ab"),)], "b binary")
    with pytest.raises(Exception, match="fewer bytes"):
        files.wrap_bytes(short, "b", 3, 4).collect()


def test_periods_of_a_sine(spark):
    import numpy as np

    y = np.sin(np.arange(200) * 2 * np.pi / 20)
    lengths = [p for _, p in stats.half_periods(range(200), y, float(y.std()), float(y.mean()))]
    assert lengths[0] == 5 and set(lengths[1:]) == {10}  # the cutoff of the minima is negative, so the start counts as one
    df = spark.createDataFrame([(k, i, float(v)) for k in (1, 2) for i, v in enumerate(y)] + [(3, 0, 1.0)], "key long, seq long, v double")
    got = {r["key"]: r for r in stats.periods_per_key(df, "key", "seq", "v", 5.0).collect()}
    assert got[1]["frequency"] == got[2]["frequency"] == 0.5 and got[1]["n_periods"] == len(lengths)
    assert got[3]["n_periods"] == 0 and (got[3]["frequency"] is None or math.isnan(got[3]["frequency"]))  # pandas NaN may come back as null
    tops = {(r["key"], r["i"]) for r in stats.peaks_per_key(df, "key", "seq", "v", 0.5).collect()}
    assert tops == {(k, i) for k in (1, 2) for i in range(5, 200, 20)}


def test_wide_sums_carry_and_wrap(spark):
    wide = [(1 << 256) - 1, (1 << 255) + 5, (1 << 128) - 1, 1, 0xFFFF]
    rows = [(1, x.to_bytes(32, "big")) for x in wide] + [(2, None), (3, None), (3, (7).to_bytes(32, "big"))]
    df = spark.createDataFrame(rows, "k int, w binary").groupBy("k").agg(wideint.total(F.col("w")).alias("s"))
    got = {r["k"]: int.from_bytes(r["s"], "big") for r in df.collect()}
    assert got == {1: sum(wide) % (1 << 256), 2: 0, 3: 7}

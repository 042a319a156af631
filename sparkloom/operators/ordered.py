"""Keyed and ordered storage: upserts, lookups, ceiling joins, top-k, best fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources import files


def insert_if_absent(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key by seq, with existed: whether later ones came in vain.
    One aggregate, combined before the shuffle."""
    others = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*others), F.col(seq)).alias("r")
    return rows.groupBy(key).agg(first, (F.count("*") > 1).alias("existed")).select(key, *[F.col(f"r.{c}") for c in others], "existed")


def upsert(rows: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """The last row of each key by seq: an aggregate with map-side combining."""
    keys = [key] if isinstance(key, str) else key
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.col(seq)).alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"r.{c}") for c in others])


def ceiling(probes: DataFrame, keys: DataFrame, probe: str, key: str, ranges: int | None = None) -> DataFrame:
    """Each distinct probe with found: the smallest key >= probe, or null.

    Keys and probes are reduced to distinct values, combined before the shuffle, so a
    hot value is one row.  The values are cut into ranges (as many as the session's
    shuffle has partitions, unless ranges says otherwise), sorted downward, and streamed
    once in Arrow batches that carry the last key.  Each range also leaves its smallest
    key, from which the tiny table of the next key after every range is made; probes
    above all keys of their range take it by an equi-join on the range."""
    kind = keys.schema[key].dataType
    both = keys.select(F.col(key).alias("x"), F.lit(True).alias("is_key"), F.lit(False).alias("is_probe"))
    both = both.unionByName(probes.select(F.col(probe).cast(kind).alias("x"), F.lit(False).alias("is_key"), F.lit(True).alias("is_probe")))
    each = both.where(F.col("x").isNotNull()).groupBy("x").agg(F.max("is_key").alias("is_key"), F.max("is_probe").alias("is_probe"))
    cut = each.repartitionByRange(ranges, "x") if ranges else each.repartitionByRange("x")
    rows = StructType([StructField("x", kind), StructField("own", kind), StructField("part", IntegerType())])
    swept = files.write_and_read(cut.sortWithinPartitions(F.desc("x")).mapInArrow(_carry_keys, rows), "swept")
    least = swept.where("x is null").select("part", F.col("own").alias("least"))
    down = Window.orderBy(F.desc("part"))  # one row per range
    later = least.select(F.col("part").alias("p"), "least")
    span = swept.select("part").distinct().join(later, F.col("part") == F.col("p"), "left")
    after = span.select(F.col("part").alias("p"), F.last("least", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("next"))
    found = swept.where("x is not null").join(F.broadcast(after), F.col("part") == F.col("p"), "left")
    return found.select(F.col("x").alias(probe), F.coalesce("own", "next").alias("found"))


def _carry_keys(batches):
    """Probes of a range, largest first, with the last key met; and a row without x for the range's smallest key."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part, kept, kind = TaskContext.get().partitionId(), None, None
    for b in batches:
        x, is_key, is_probe = b.columns
        kind = x.type
        keys = pc.if_else(is_key, x, pa.scalar(None, kind))
        own = pc.fill_null_forward(pa.concat_arrays([pa.array([kept], kind), keys])).slice(1)
        kept = own[len(own) - 1].as_py() if len(own) else kept
        out = pa.RecordBatch.from_arrays([x, own, pa.array([part] * len(x), pa.int32())], names=["x", "own", "part"])
        yield out.filter(is_probe)
    if kept is not None:
        yield pa.RecordBatch.from_arrays([pa.array([None], kind), pa.array([kept], kind), pa.array([part], pa.int32())], names=["x", "own", "part"])


def validate(rows: DataFrame, key: str) -> DataFrame:
    """(n, no_key, again): rows, rows without a key, and rows that repeat a key, counted
    from one row per key; a tree has none of the latter two."""
    per_key = rows.groupBy(key).agg(F.count("*").alias("c"))
    n = F.coalesce(F.sum("c"), F.lit(0))
    none = F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("c"))), F.lit(0))
    return per_key.agg(n.alias("n"), none.alias("no_key"), (n - none - F.count(key)).alias("again"))


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its position by order, from 1: sorted by ranges of all the columns, so
    that equal leading ones are split; each row's number within its range comes from the
    sort, the rows before its range from a count per range."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    held = files.write_and_read(rows.select("*", F.shiftright("row", 33).cast("int").alias("part")), "order")
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))  # a row per range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(F.broadcast(before), "part").withColumn(name, F.col("before") + own).drop("part", "row", "before")


def top_k(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def top_k_per_key(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_fit(regions: DataFrame, request: int, end: int | None = None) -> DataFrame:
    """The smallest free region of request or more, lowest offset first.  With end,
    that of the file, a request that fits nowhere gets a new region there, at a multiple of eight."""
    found = regions.where(F.col("size") >= request).orderBy("size", "offset").limit(1)
    if end is None:
        return found
    new = regions.sparkSession.range(1).select(*[F.lit({"offset": -(-end // 8) * 8, "size": request}[c]).cast(regions.schema[c].dataType).alias(c) for c in regions.columns])
    both = found.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
    return both.orderBy("new").limit(1).drop("new")


def longest_prefix(probes: DataFrame, keys: DataFrame, probe: str, key: str, most: int) -> DataFrame:
    """Per probe the longest key that is a prefix of it: an equi-join on the prefixes."""
    p = probes.select(probe, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(probe), F.lit(most))), lambda n: F.substring(F.col(probe), F.lit(1), n))).alias(key))
    return p.join(keys.select(key).distinct(), key).groupBy(probe).agg(F.max_by(key, F.length(key)).alias("prefix"))


OUTCOMES = ("invalid key", "exact", "empty entry", "to split")


def nearest(probes: DataFrame, keys: DataFrame, probe: str, key: str) -> DataFrame:
    """(probe, prefix, outcome) of each distinct probe in the radix tree of byte-string
    keys: the longest path of the tree that the probe follows, and one of OUTCOMES.  A
    node of the tree is a key, or a prefix at which keys part, or the root; a probe that
    ends at a node is exact, one that goes on after a node meets an empty entry, one that
    leaves or ends within an edge would split it.  Every key emits its prefixes, so the
    work is in proportion to the keys' squared length; the joins are on equality."""
    bytes_of = lambda c: F.col(c).cast("binary")
    starts = lambda c, low: F.transform(F.sequence(F.lit(low), F.octet_length(c)), lambda n: F.substring(c, F.lit(1), n))
    own = keys.select(bytes_of(key).alias("k")).where(F.octet_length("k") > 0).distinct()
    paths = own.select("k", F.explode(starts(F.col("k"), 0)).alias("path"))
    turn = F.hex(F.substring(F.col("k"), F.octet_length("path") + 1, F.lit(1)))
    nodes = paths.groupBy("path").agg(F.bool_or(F.col("k") == F.col("path")).alias("is_key"), (F.min(turn) != F.max(turn)).alias("parts"))
    asked = probes.select(bytes_of(probe).alias("p")).distinct()
    met = asked.where(F.octet_length("p") > 0).select("p", F.explode(starts(F.col("p"), 0)).alias("path")).join(nodes, "path")
    best = met.groupBy("p").agg(F.max_by(F.struct("path", (F.col("is_key") | F.col("parts") | (F.octet_length("path") == 0)).alias("node")), F.octet_length("path")).alias("b"))
    all_of = asked.join(best, "p", "left").select("p", F.col("b.path").alias("prefix"), F.coalesce("b.node", F.lit(True)).alias("node"))  # no key at all: the root
    same = F.col("prefix").eqNullSafe(F.col("p"))
    outcome = F.when(F.octet_length("p") == 0, OUTCOMES[0]).when(same & F.col("node"), OUTCOMES[1]).when(F.col("node"), OUTCOMES[2]).otherwise(OUTCOMES[3])
    return all_of.select(F.col("p").alias(probe), F.coalesce("prefix", F.lit(b"")).alias("prefix"), outcome.alias("outcome"))

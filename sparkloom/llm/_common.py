"""Scratch tables, folds and connected components shared by the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; in local mode, where it
    may be unset, a temporary folder that this session then keeps using."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="sparkloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"


_open_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch_scope(keep: str = ""):
    """Tables made within are deleted at the end, but for those of that name: for a
    caller who has written what depends on them."""
    made: list[DataFrame] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.pop()
        for df in made:
            if f"/sparkloom-{keep}-" in df._sparkloom_path:
                if _open_scopes:
                    _open_scopes[-1].append(df)
            else:
                release(df)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a
    lost executor costs no more than the read of the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    if _open_scopes:
        _open_scopes[-1].append(out)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table made by materialize()."""
    path = getattr(df, "_sparkloom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def collect_garbage(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files and a broadcast's blocks when the driver collects the
    plan that made them, which a driver whose heap isn't full leaves for later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id, n: int = 5):
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


#: So many edges, 32 MB of ids, are joined by one task: the rounds' plans cost the driver more than that.
LOCAL_EDGES = 2_000_000


def _forest(batches):
    """(node, root) of all the edges: roots of both ends hook to the smaller one, then all paths are halved."""
    import numpy as np
    import pyarrow as pa

    ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*([c.to_numpy() for c in b.columns] for b in batches))]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        still = root[a] != root[b]
        a, b = a[still], b[still]
    inner = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[root[inner]])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, root) with the smallest
    node of each component; the root itself gets no row.

    Up to LOCAL_EDGES edges are joined by one task.  Of more than that: alternating large-star and small-star rounds.  Each round takes minima with
    map-side combining and then one equi-join whose other side is unique on the
    key, so a hub is split by AQE's skew join.  Each round's edges are written
    to the shared folder; nothing but two numbers reaches the driver.
    """
    cur = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges"
    )

    if cur.count() <= LOCAL_EDGES:
        return cur.coalesce(1).mapInArrow(_forest, "node long, root long")

    def signature(df):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 20))).first()

    sig = signature(cur)
    while sig[0]:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct()
        )
        new = materialize(small, "small")
        release(large)
        new_sig = signature(new)
        release(cur)
        cur = new
        if new_sig == sig:
            break
        sig = new_sig
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))

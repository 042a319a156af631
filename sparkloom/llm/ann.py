"""Approximate nearest neighbours with a hash-prefix forest.

The index rows are dealt into blocks of about block_rows rows; each block holds a
forest: per tree a sorted array of BITS-bit hash strings.  A query descends each
tree to its longest matching prefix by binary search and then ascends all trees
together, one prefix bit at a time, taking every row below the prefix, until it
has candidates of enough distinct vectors; these are measured exactly in double
precision.  Hyperplanes lie midway between random pairs of a bounded sample of
the rows (SAMPLE), so they follow the data; all rows are indexed.

A stated query set meets all blocks: index rows and queries are both dealt in
bounded groups (block, chunk of queries), so no task grows with the tables, and
each group returns k rows per query.  Equal vectors are one entry of a block with
its ids in order, so a vector that a third of the rows share takes no more than
one candidate; rows are dealt by id and vector, so one id's rows are split too.  The share of a block that a query measures, SHARE, is a fixed
parameter: embeddings with hardly any structure (nearest at 1.1, median at 1.4)
need that much for a recall of 0.9.

Cases: vectors that are null, empty, zero, of another length than the most common
one or that hold null or non-finite components take no part, on either side; ties
go to the smaller vec_id; fewer candidates than k give fewer rows; rows that
repeat a vec_id are candidates each, except for the query's own id, and as a query
the smallest of their vectors counts; a null vec_id takes no part; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, table

K = 10
TREES = 48
BITS = 58  # with the tree's number, 64
SHARE = 0.4
SAMPLE = 4096
BLOCK_ROWS = 4096
CHUNK = 2048


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part, in double precision."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def planes(sample, trees: int, bits: int, seed: int = 11):
    """Normals and offsets of trees * bits hyperplanes."""
    import numpy as np

    rng = np.random.default_rng(seed)
    a, b = sample[rng.integers(0, len(sample), trees * bits)], sample[rng.integers(0, len(sample), trees * bits)]
    normal = np.where((a == b).all(1)[:, None], rng.normal(size=a.shape), a - b)
    return normal, (normal * (a + b) / 2).sum(1)


class Forest:
    """The trees of one block."""

    def __init__(self, ids, vectors, forest_planes, trees: int, bits: int):
        import numpy as np

        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(1)]
        self.vectors, self.first = vectors[new], np.r_[np.flatnonzero(new), len(ids)]
        self.ids, self.planes, self.trees, self.bits = ids, forest_planes, trees, bits
        labels = self.labels(self.vectors)
        self.order = np.argsort(labels, axis=1, kind="stable").reshape(-1)
        self.sorted = np.sort(labels, axis=1).reshape(-1)  # tree by tree: the tree's number is on top of its hash strings

    def labels(self, vectors):
        """trees x rows hash strings, the tree's number and then the first bit on top."""
        import numpy as np

        normal, offset = self.planes
        on = (vectors @ normal.T > offset).reshape(len(vectors), self.trees, self.bits)
        on = np.concatenate([np.zeros((len(vectors), self.trees, 64 - self.bits), bool), on], axis=2)
        codes = np.packbits(on, axis=2).view(">u8")[:, :, 0].T.astype(np.uint64)
        return codes | (np.arange(self.trees, dtype=np.uint64) << np.uint64(self.bits))[:, None]

    def candidates(self, label, want: int):
        """Rows met when all trees ascend together until there are want of them."""
        import numpy as np

        met = np.zeros(len(self.vectors), bool)
        at = np.searchsorted(self.sorted, label)  # a longest match in each tree is a neighbour of the query's place there
        near = self.sorted[np.clip(np.stack([at - 1, at]), 0, len(self.sorted) - 1)] ^ label
        depth = self.bits - int(near.min()).bit_length()
        held = np.zeros((2, self.trees), np.int64)
        for drop in range(self.bits - depth, self.bits + 1):
            low = (label >> np.uint64(drop)) << np.uint64(drop)
            now = np.stack([np.searchsorted(self.sorted, low), np.searchsorted(self.sorted, low | np.uint64((1 << drop) - 1), "right")])
            for t in np.flatnonzero((now != held).any(0)):
                met[self.order[now[0, t] : now[1, t]]] = True
            held = now
            if np.count_nonzero(met) >= want:
                break
        return np.flatnonzero(met)

    def search(self, qid, q, label, k: int, want: int):
        """The k nearest of this block's candidates: (distance, id), own id left out."""
        import numpy as np

        at = self.candidates(label, want)
        away = np.sqrt(((self.vectors[at] - q) ** 2).sum(1))
        found, bound = [], np.inf
        for i in np.argsort(away, kind="stable"):
            if away[i] > bound:
                break
            own = self.ids[self.first[at[i]] : self.first[at[i] + 1]]
            found += [(float(away[i]), int(x)) for x in own[own != qid][:k]]  # equal vectors: no id beyond the k smallest can count
            if len(found) >= k and bound == np.inf:
                bound = away[i]
        return sorted(found)[:k]


def _search_group(forest_planes, trees: int, bits: int, k: int, share: float):
    def run(key, index, queries):
        import numpy as np
        import pandas as pd

        out = []
        if len(index) and len(queries):
            vectors = np.stack(index["v"].to_numpy())
            forest = Forest(index["id"].to_numpy(), vectors, forest_planes.value, trees, bits)
            asked = np.stack(queries["v"].to_numpy())
            labels = forest.labels(asked)
            want = max(4 * k, int(np.ceil(share * len(forest.vectors))))
            for j, qid in enumerate(queries["id"]):
                out += [(qid, x, d) for d, x in forest.search(qid, asked[j], labels[:, j], k, want)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, bits: int = BITS, share: float = SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (id, v) against index (id, v)."""
    import numpy as np

    spark = index.sparkSession
    out_schema = "query_id long, vec_id long, score double"
    widths = index.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, rows = widths[0]
    index, queries = index.where(F.size("v") == width), queries.where(F.size("v") == width)
    sample = np.array([r[0] for r in index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()])
    shared = spark.sparkContext.broadcast(planes(sample, trees, bits))
    blocks, chunks = -(-rows // block_rows), -(-max(1, queries.count()) // CHUNK)
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = index.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), number(chunks).alias("chunk"))
    asked = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), number(blocks).alias("block"))
    found = (
        dealt.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk"))
        .applyInPandas(_search_group(shared, trees, bits, k, share), out_schema)
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return nearest(rows, rows.where("id % 100 = 0").groupBy("id").agg(F.min("v").alias("v")))

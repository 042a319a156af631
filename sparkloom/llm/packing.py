"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A document's ids and one closing id 0 are cut into full windows and a tail.
Pieces are dealt by a hash of (doc_id, start), sorted by decreasing length within
each partition (Spark spills the sort) and streamed through a best-fit packer: a
segment tree over remaining capacities 1..window finds the tightest open
sequence in log2(window) steps.  The texts are never shuffled; a piece is its
ids (little-endian, four bytes each) and four numbers.  sequences() puts the
pieces of a window together and pads it.  Each partition leaves one loosely filled sequence or so behind.

Cases: a null or empty text is the closing id alone; a text of any length is
cut, its pieces may be dealt to different partitions; repeated rows are packed
each; null ids are packed like any other; an empty table gives no piece; further
columns of docs are ignored; the string of the vocabulary's added token within a
text is that token, as in the tokenizers library.  Ids are those of that library for
byte_bpe_50k.json, add_special_tokens=False; they are made with the same vocabulary's
rank file and added token in tiktoken, which is some ten times as fast, or with
tokenizers where tiktoken gives up on a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

WINDOW = 1024
END = 0
BATCH = 512  # documents whose pieces are held at once
VOCABULARY = "byte_bpe_50k"


class BestFit:
    """Open sequences by remaining capacity, in a segment tree of counts."""

    def __init__(self, window: int):
        self.window = window
        self.size = 1 << window.bit_length()  # leaves 0..window and more
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def _add(self, capacity: int, by: int) -> None:
        i = self.size + capacity
        while i:
            self.tree[i] += by
            i >>= 1

    def _tightest(self, length: int) -> int:
        """The smallest capacity >= length that is open, or 0."""
        i = self.size + length
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return 0
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size

    def place(self, length: int) -> tuple[int, int]:
        """Sequence number and offset for a piece."""
        capacity = self._tightest(length)
        if capacity:
            sequence = self.open[capacity].pop()
            self._add(capacity, -1)
        else:
            capacity, sequence = self.window, self.made
            self.made += 1
        if left := capacity - length:
            self.open[left].append(sequence)
            self._add(left, 1)
        return sequence, self.window - capacity


def _encoder(vocabulary: str):
    import base64
    import json

    import numpy as np
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{vocabulary}.json")) as f:
        whole, mark = f.read(), '"added_tokens":'  # only this list is parsed: the vocabulary beside it is large
    start = whole.index("[", whole.index(mark))
    added = {x["content"]: x["id"] for x in json.JSONDecoder().raw_decode(whole, start)[0]}
    del whole
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    slow = []

    def encode(text: str):
        try:
            return np.array(fast.encode(text, allowed_special="all"), "<u4")
        except BaseException as e:  # the Rust side reports a regex that gave up as a panic
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def _piece_batches(window: int, vocabulary: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode = _encoder(vocabulary)
        closing = np.array([END], "<u4")
        for b in (x.slice(at, BATCH) for x in batches for at in range(0, x.num_rows, BATCH)):
            rows, start, length, raw, total = [], [], [], [], []
            for k, t in enumerate(b.column(1)):
                ids = np.concatenate([encode(t.as_py() or ""), closing])
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    rows.append(k)
                    start.append(at)
                    length.append(len(piece))
                    raw.append(piece.tobytes())
                    total.append(len(ids))
            columns = [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(raw, pa.binary()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return run


def _pack_batches(window: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        fit, first = BestFit(window), TaskContext.get().partitionId() << 40
        for b in batches:
            placed = np.array([fit.place(n) for n in b.column(2).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(placed[:, 0] + first), pa.array(placed[:, 1])], names=[*b.schema.names, "sequence_id", "offset"])

    return run


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): the pieces with their ids, and ids_crc32 of these."""
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _piece_batches(window, vocabulary), "doc_id long, start long, length long, ids binary, doc_tokens long"
    )
    return cut.withColumn("ids_crc32", F.crc32("ids"))


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per piece, with its ids, its sequence and its offset there."""
    cut = pieces(docs, window, vocabulary)
    dealt = cut.repartition("doc_id", "start").sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(_pack_batches(window), "doc_id long, start long, length long, ids binary, doc_tokens long, ids_crc32 long, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, length, ids) of every sequence: the ids of its pieces in order
    of their offsets, padded with END to what fill() says, as an array."""
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    padded = held.select("sequence_id", "length", _padded(F.col("length"), window).alias("padded"), F.aggregate("held", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
    return padded.mapInArrow(_sequence_batches, "sequence_id long, length long, ids array<int>")


def _sequence_batches(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        ids = []
        for raw, n in zip(b.column(3), b.column(2).to_pylist()):
            own = np.frombuffer(raw.as_py(), "<u4").astype(np.int32)
            ids.append(np.concatenate([own, np.full(n - len(own), END, np.int32)]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "length", "ids"])


def _padded(ids, window: int):
    return F.when(F.bit_count(ids) == 1, ids).otherwise(F.lit(window).cast("long"))


def fill(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per sequence: its ids, and its length with padding: a sequence that ends
    at a power of two stays as it is, any other is padded to the window."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("ids"))
    return used.withColumn("padded", _padded(F.col("ids"), window))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

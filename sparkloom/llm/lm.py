"""Language-model scores by deleted interpolation.

A word bigram model: p(w | v) = l2 f(w | v) + l1 f(w) + l0 / (V + 1), with
maximum-likelihood estimates f from all training documents and weights l by bucket
of the context's frequency c(v) (powers of two).  The weights are learned by
expectation maximisation on held-out counts: for them, a fiftieth of the documents
(crc32 of the id mod 50 = 0, all of them training documents) is deleted from the
counts, and its tokens are the held-out events.  Events are gathered over the whole
corpus in a grid of (bucket, log f(w | v), log f(w)) of fixed size, quarter octaves,
which is all that reaches the driver.

Counts at scale.  The texts are read once: executors number the tokens of a block
of documents and write the block to a table in the shared folder, so that a lost
executor, or another cut of the input, can't change what a block holds.  Each block
sends, per bucket of the 64-bit hash range, its distinct unigrams and bigrams once
(sorted hashes, delta-coded, with counts): a frequent word or pair costs one entry
a block, however often it occurs.  Reducers add the entries up and answer each
block with the corpus counts of its keys, in its order, without the keys.  The
answers are a table in the shared folder too, and the blocks' token numbers
meet them grouped by block, where every document is scored.  Both the number of
buckets and that of blocks follow the size of the texts, and so does the number of
partitions that blocks are dealt to.  A block has a random 128-bit name, given once,
before it is written, so blocks of equal contents stay apart.  Two n-grams are one if
their 64-bit hashes agree.

Cases: a null or empty text is the end token alone; long texts are one block; rows
with a null id are scored and used for training; repeated rows count each; without
training documents N = V = 0, base_score is 0 and score is log10 of the uniform
1 / (V + 1); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, materialize, table

BLOCK_TOKENS = 1_500_000
BLOCKS_A_TASK = 2
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 64
HELD_OUT, TEST_OF = 1, 5
DEV, DEV_OF = 0, 50
GRID = 4
LEVELS = 40
END, START = b"</s>\n", b"<s>\n"  # no word holds a line feed


def _squeeze(a) -> bytes:
    """Bytes of an integer array, its byte planes compressed."""
    import numpy as np
    import zstandard

    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(b: bytes, kind: str, n: int):
    import numpy as np
    import zstandard

    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=max(1, n * width)), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(kind)


def _squeeze_sorted(keys) -> bytes:
    import numpy as np

    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _expand_sorted(b: bytes, n: int):
    import numpy as np

    return np.cumsum(_expand(b, "<u8", n), dtype=np.uint64)


def pair_keys(first, second):
    """64-bit keys of pairs of 64-bit keys."""
    import numpy as np

    with np.errstate(over="ignore"):
        k = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ np.uint64(0xD6E8FEB86659FD93))
        k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


class Block:
    """Documents whose tokens are numbered together; token numbers are positions
    in the sorted array of the block's unigram keys."""

    def __init__(self, docs: list, numbers: list, vocabulary: dict, seen: list, dev: bool):
        import uuid

        import numpy as np
        import xxhash

        self.docs, self.dev, self.bytes = docs, dev, seen[1]  # docs: (doc_id, fold, tokens)
        self.lengths = np.array([d[2] for d in docs], np.int64)
        keys = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in vocabulary), np.uint64, len(vocabulary))
        order = np.argsort(keys)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        self.unigrams, self.tokens = keys[order], place[np.concatenate(numbers)]
        self.block = uuid.uuid4().hex


def _blocks(batches, block_tokens: int):
    """Blocks of (doc_id, fold5, fold50, text) rows; dev documents get blocks of their own."""
    from itertools import count

    import numpy as np

    class Numbers(dict):
        def __init__(self):
            self.next = count()

        def __missing__(self, w):
            self[w] = n = next(self.next)
            return n

    new = lambda: ([], [], Numbers(), [0, 0])  # tokens and bytes so far
    kept = {False: new(), True: new()}
    for b in batches:
        for doc_id, five, fifty, text in zip(*(b.column(k) for k in range(4))):
            dev = fifty.as_py() == DEV
            docs, numbers, vocabulary, seen = kept[dev]
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
            words = raw.split()
            words.append(END)
            numbers.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
            docs.append((doc_id.as_py(), five.as_py(), len(words)))
            seen[0] += len(words)
            seen[1] += len(raw)
            if seen[0] >= block_tokens:
                yield Block(docs, numbers, vocabulary, seen, dev)
                kept[dev] = new()
    for dev, (docs, numbers, vocabulary, seen) in kept.items():
        if docs:
            yield Block(docs, numbers, vocabulary, seen, dev)


def _bigram_keys(tokens, lengths, unigrams):
    import numpy as np
    import xxhash

    own = unigrams[tokens]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    starts = np.cumsum(lengths) - lengths
    before[starts] = np.uint64(xxhash.xxh64_intdigest(START, 1))
    return pair_keys(before, own), starts


def _key_batches(shift: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for block in (b.slice(k, 1).to_pylist()[0] for b in batches for k in range(b.num_rows)):
            lengths, unigrams, tokens = _stored(block)
            train = np.repeat(np.array([x != HELD_OUT for x in block["folds"]]), lengths)
            bigrams, place = np.unique(_bigram_keys(tokens, lengths, unigrams)[0], return_inverse=True)
            rows = []
            for order, keys, at in ((1, unigrams, tokens), (2, bigrams, place)):
                counts = np.bincount(at, weights=train, minlength=len(keys)).astype("<u4")
                bucket = (keys >> np.uint64(shift)).astype(np.int64)
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                for a, b in zip(edges, [*edges[1:], len(keys)]):
                    rows.append((order, int(bucket[a]), block["block"], block["dev"], int(b - a), _squeeze_sorted(keys[a:b]), _squeeze(counts[a:b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()))],
                names=["order", "bucket", "block", "dev", "n", "keys", "counts"],
            )

    return run


def _add_up(key, part):
    """The corpus counts of the keys of one bucket, for each block in its order."""
    import numpy as np
    import pandas as pd

    keys = [_expand_sorted(k, n) for k, n in zip(part["keys"], part["n"])]
    counts = [_expand(c, "<u4", n).astype(np.int64) for c, n in zip(part["counts"], part["n"])]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(known)).astype("<i8")
    deleted = np.bincount(place, weights=np.concatenate([c * d for c, d in zip(counts, part["dev"])]), minlength=len(known)).astype("<i8")
    out, at = [], 0
    for block, dev, n in zip(part["block"], part["dev"], part["n"]):
        mine = place[at : at + n]
        at += n
        out.append((key[0], key[1], block, dev, n, _squeeze(total[mine]), _squeeze(deleted[mine]) if dev else None, 0, 0, 0))
    if key[0] == 1:
        out.append((1, key[1], None, False, 0, None, None, int((total > 0).sum()), int(total.sum()), int(deleted.sum())))
    return pd.DataFrame(out, columns=["order", "bucket", "block", "dev", "n", "total", "deleted", "v", "tokens", "dev_tokens"])


def _token_batches(block_tokens: int):
    def run(batches):
        import pyarrow as pa

        for b in _blocks(batches, block_tokens):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b.block]), pa.array([b.dev]), pa.array([b.bytes]), pa.array([[d[0] for d in b.docs]], pa.list_(pa.int64())), pa.array([[d[1] for d in b.docs]], pa.list_(pa.int32())),
                    pa.array([b.lengths.tolist()], pa.list_(pa.int64())), pa.array([len(b.unigrams)], pa.int32()), pa.array([_squeeze_sorted(b.unigrams)], pa.binary()),
                    pa.array([_squeeze(b.tokens.astype("<u4"))], pa.binary()),
                ],
                names=["block", "dev", "bytes", "doc_ids", "folds", "lengths", "n", "unigrams", "tokens"],
            )

    return run


TOKENS = "block string, dev boolean, bytes long, doc_ids array<long>, folds array<int>, lengths array<long>, n int, unigrams binary, tokens binary"


def _stored(row):
    """(lengths, unigram keys, token numbers) of a row of TOKENS."""
    import numpy as np

    lengths = np.array(row["lengths"], np.int64)
    return lengths, _expand_sorted(row["unigrams"], row["n"]), _expand(row["tokens"], "<u4", int(lengths.sum()))


def _events(row, answers, deleted: bool):
    """(starts, c(w), c(v), c(vw)) per token of a block; with deleted, less the dev documents' counts."""
    import numpy as np

    lengths, unigrams, tokens = _stored(row)
    answers = answers.sort_values(["order", "bucket"])
    values = {}
    for order, part in answers.groupby("order"):
        got = np.concatenate([_expand(t, "<i8", n) for t, n in zip(part["total"], part["n"])])
        if deleted:
            got = got - np.concatenate([_expand(t, "<i8", n) for t, n in zip(part["deleted"], part["n"])])
        values[order] = got
    keys, starts = _bigram_keys(tokens, lengths, unigrams)
    bigrams, place = np.unique(keys, return_inverse=True)
    if len(values.get(1, ())) != len(unigrams) or len(values.get(2, ())) != len(bigrams):
        raise RuntimeError("a block's answers don't fit its keys")
    own = values[1][tokens]
    context = np.empty_like(own)
    context[1:] = own[:-1]
    ends = np.cumsum(lengths) - 1
    context[starts] = own[ends[0]]  # every document has one end, and one start
    return starts, own, context, values[2][place]


def _level(context):
    """Bucket of a context frequency: 0 if unseen, else 1 + floor(log2)."""
    import numpy as np

    return np.minimum(LEVELS - 1, np.frexp(context.astype(np.float64))[1])


def _estimates(own, context, pair, tokens):
    import numpy as np

    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), own / max(tokens, 1)


def _grid_events(kept_tokens: int):
    def run(key, blocks, answers):
        import numpy as np
        import pandas as pd

        out = []
        for _, row in blocks.iterrows():
            _, own, context, pair = _events(row, answers, True)
            f2, f1 = _estimates(own, context, pair, kept_tokens)
            cell = lambda f: np.where(f > 0, np.rint(-GRID * np.log2(np.maximum(f, 1e-300))), -1).astype(np.int64)
            code, n = np.unique((_level(context).astype(np.int64) << 40) + (cell(f2) + 1 << 20) + cell(f1) + 1, return_counts=True)
            out += [(int(c >> 40), int((c >> 20 & 0xFFFFF) - 1), int((c & 0xFFFFF) - 1), int(x)) for c, x in zip(code, n)]
        return pd.DataFrame(out, columns=["level", "b2", "b1", "n"])

    return run


def mixture(events, types: int, rounds: int = 200):
    """LEVELS x 3 weights of bigram, unigram and uniform estimates by expectation
    maximisation; events: (level, b2, b1, n) cells.  Each weight starts with one
    event in its favour, so none becomes zero; a level without events has the
    weights of the next lower one that has some."""
    import numpy as np

    weights = np.tile([0.4, 0.4, 0.2], (LEVELS, 1))
    weights[0] = [0, 0.8, 0.2]
    e = np.array(events, np.float64).reshape(-1, 4)
    seen = False
    for level in range(LEVELS):
        mine = e[e[:, 0] == level]
        if not len(mine):
            if seen and level > 1:
                weights[level] = weights[level - 1]
            continue
        f = np.stack([np.where(mine[:, k] < 0, 0.0, 2.0 ** (-mine[:, k] / GRID)) for k in (1, 2)] + [np.full(len(mine), 1 / (types + 1))], 1)
        w = weights[level].copy()
        live = np.array([level > 0, True, True], float)
        for _ in range(rounds):
            share = f * w
            share /= share.sum(1, keepdims=True)
            new = (share * mine[:, 3:]).sum(0) + live
            new /= new.sum()
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        weights[level], seen = w, seen or level > 0
    return weights


def _score_blocks(weights, types: int, total: int):
    def run(key, blocks, answers):
        import numpy as np
        import pandas as pd

        out = []
        for _, row in blocks.iterrows():
            starts, own, context, pair = _events(row, answers, False)
            f2, f1 = _estimates(own, context, pair, total)
            w = weights[_level(context)]
            p = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (types + 1)) if total else np.full(len(own), -np.log10(types + 1))
            base = np.log10((own + 0.5) / (total + 0.5 * (types + 1)))
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(row["doc_ids"], "Int64"), "held_out": np.array([x == HELD_OUT for x in row["folds"]]), "n_tokens": np.array(row["lengths"], np.int64),
                        "n_known": np.add.reduceat((own > 0).astype(np.int64), starts), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(p, starts),
                    }
                )
            )
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})

    return run


def score(docs: DataFrame, block_tokens: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    What is sent has a row per block, order and bucket: the size of the texts squared,
    over that of a block times that of a bucket.  A block's tokens (BLOCK_TOKENS unless
    given) and the entries of bucket_bytes of text must fit in a task; the defaults do in
    executors of three gigabytes.  Larger executors should be given larger ones: with
    100 million tokens and 256 MB, 100 TB send some 10**11 rows of 75 entries."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id"), TEST_OF).cast("int").alias("five"), fold(F.col("doc_id"), DEV_OF).cast("int").alias("fifty"),
        F.col("text").cast("string").alias("text"),
    )
    blocks = materialize(rows.mapInArrow(_token_batches(block_tokens or BLOCK_TOKENS), TOKENS), "blocks")
    size, n_blocks = blocks.agg(F.sum("bytes"), F.count("*")).first()
    size, parts = size or 0, -(-n_blocks // BLOCKS_A_TASK) or 1
    bits = max(LEAST_BUCKETS, -(-size // bucket_bytes) - 1).bit_length()
    sent = blocks.mapInArrow(_key_batches(64 - bits), "order int, bucket int, block string, dev boolean, n int, keys binary, counts binary")
    answers = sent.groupBy("order", "bucket").applyInPandas(
        _add_up, "order int, bucket int, block string, dev boolean, n int, total binary, deleted binary, v long, tokens long, dev_tokens long"
    )
    answers = materialize(answers, "counts")
    types, total, dev = (int(x or 0) for x in answers.where("block is null").agg(F.sum("v"), F.sum("tokens"), F.sum("dev_tokens")).first())
    found = answers.where("block is not null")
    dealt = lambda df: df.repartition(parts, "block").groupBy("block")
    cogrouped = lambda b, a: dealt(b.drop("dev", "bytes")).cogroup(dealt(a))
    dev_answers = found.where("dev").select("block", "order", "bucket", "n", "total", "deleted")
    cells = cogrouped(blocks.where("dev"), dev_answers).applyInPandas(_grid_events(total - dev), "level long, b2 long, b1 long, n long")
    events = cells.groupBy("level", "b2", "b1").agg(F.sum("n").alias("n")).collect()  # at most LEVELS x (some 30 GRID)^2 cells
    weights = mixture([tuple(r) for r in events], types)
    scored = cogrouped(blocks, found.select("block", "order", "bucket", "n", "total")).applyInPandas(
        _score_blocks(weights, types, total), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the classes' log-count ratio, a linear
hinge-loss model is fitted to them by dual coordinate descent, and a sigmoid over
margins of held-back folds turns margins into probabilities.

N-grams are lower-cased words, and runs of one to three word shapes (letters,
capitals, digits and punctuation, repeats squeezed; a word equal to the one
before it has a shape of its own).  Both are hashed into 2**BITS weights, so the
broadcast model has a fixed size.  The model is fitted on at most FIT_ROWS
labelled documents, those with the smallest hash of their id, a row of each, and of
them on as many as have FIT_FEATURES features together, in that order: these are the
documented bounds, of what reaches the driver too; scoring covers whole texts of all
rows.

Cases: a null or empty text has the constant feature only and is scored by it; a
very long text costs time in proportion to its words and memory to its distinct
words; repeated rows are scored each; a null id is scored and counts as not held
out, its label is never used; a document labelled twice counts once, with the
smaller label; of several rows with one labelled id that with the smallest hash of
its text is learnt from; labels other than 0 and 1, and null ones, are ignored; without
labels of both classes every score is the share of label 1 (0.5 without labels);
an empty table gives an empty result; further columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, table

BITS = 20
FIT_ROWS = 6000
FIT_FEATURES = 10_000_000
ALPHA = 0.5
C = 1.0
BLEND = 0.9
EPOCHS = 8
CUT = 0.3

_LOWER, _UPPER = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHAPE = bytes.maketrans(_LOWER + _UPPER + b"0123456789" + bytes(range(0x80, 0x100)), b"a" * 26 + b"A" * 26 + b"0" * 10 + b"a" * 0x80)


def features(text: str | None):
    """Sorted distinct feature numbers of a whole text; 0 is the constant."""
    import re
    import zlib

    import numpy as np

    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    shapes = re.sub(rb"([^ ])\1+", rb"\1", raw.translate(_SHAPE)).split()
    runs = [b"^", *shapes[:1], *(b"=" if a == b else s for a, b, s in zip(words, words[1:], shapes[1:])), b"$"]
    grams = {*runs, *map(b" ".join, {*zip(runs, runs[1:])}), *map(b" ".join, {*zip(runs, runs[1:], runs[2:])})}
    crc, top = zlib.crc32, (1 << BITS) - 1
    found = {crc(w) % top + 1 for w in set(words)}
    found.update(crc(b"\0" + g) % top + 1 for g in grams)
    found.add(0)
    out = np.fromiter(found, np.int32, len(found))
    out.sort()
    return out


def _hinge(rows, y, ratio, seed: int, epochs: int = EPOCHS):
    """Dual coordinate descent for the linear hinge loss over ratio-scaled indicators:
    minimises |w|^2 / 2 + sum of c_i max(0, 1 - y_i w x_i), where both classes weigh
    the same, c_i = C / (2 x share of the class).  Dual variables stay in [0, c_i]."""
    import numpy as np

    w, a, rng = np.zeros(1 << BITS), np.zeros(len(rows)), np.random.default_rng(seed)
    scaled = [ratio[r] for r in rows]
    most = C / (2 * np.where(y > 0, (y > 0).mean(), (y < 0).mean()))
    norm = np.array([s @ s for s in scaled])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, s = rows[i], scaled[i]
            new = min(most[i], max(0.0, a[i] - (y[i] * (w[r] @ s) - 1) / norm[i]))
            if new != a[i]:
                w[r] += (new - a[i]) * y[i] * s
                a[i] = new
    return w


def _nbsvm(rows, y, seed: int):
    """Weights over plain indicators."""
    import numpy as np

    pos, neg = np.full(1 << BITS, ALPHA), np.full(1 << BITS, ALPHA)
    for r, label in zip(rows, y):
        (pos if label > 0 else neg)[r] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    ratio[0] = 1.0
    w = _hinge(rows, y, ratio, seed)
    w[1:] = BLEND * w[1:] + (1 - BLEND) * np.abs(w[1:]).mean()  # interpolation with the mean weight, as is usual for NB-SVM
    return w * ratio


def fit(rows, labels, seed: int = 7):
    """(weights, slope, offset) from feature arrays and labels 0/1."""
    import numpy as np

    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if len(set(y)) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0, float(np.log((np.sum(y > 0) + 1) / (np.sum(y < 0) + 1))) if len(y) else 0.0
    part = np.random.default_rng(seed).integers(0, 3, len(y))
    margins = np.zeros(len(y))
    for k in range(3):
        train, test = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(y[train])) == 2:
            w = _nbsvm([rows[i] for i in train], y[train], seed)
            margins[test] = [w[rows[i]].sum() for i in test]
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))  # Platt's smoothed targets
    x = np.stack([margins, np.ones(len(y))], 1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return _nbsvm(rows, y, seed).astype(np.float32), float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """A model from the labelled rows outside the held-out fold, fit_rows at most."""
    usable = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # fit_rows rows of two numbers at most: its broadcast has a fixed bound
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    held = texts.select("doc_id", "quality", F.xxhash64("text").alias("mark"), "text").mapInArrow(_featured, "doc_id long, quality int, mark long, features binary")
    one = held.groupBy("doc_id").agg(F.min(F.struct("mark", "quality", "features")).alias("r"))  # a row per document, combined before the shuffle
    rows, labels, room = [], [], FIT_FEATURES
    for r in one.select("doc_id", "r.quality", "r.features").orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        own = _unpacked(r["features"])
        room -= len(own)
        if room < 0:
            break
        rows.append(own)
        labels.append(r["quality"])
    return fit(rows, labels)


def _unpacked(packed: bytes):
    import zlib

    import numpy as np

    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.int32), dtype=np.int32)


def _featured(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    for b in batches:
        packed = [zlib.compress(np.diff(features(t.as_py()), prepend=np.int32(0)).tobytes(), 1) for t in b.column(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packed, pa.binary())], names=["doc_id", "quality", "mark", "features"])


def probability(model, text: str | None) -> float:
    import math

    w, slope, offset = model
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, slope * float(w[features(text)].sum()) + offset))))


def _score_batches(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([probability(model, t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score_batches(shared), "doc_id long, score double")


def _keep_batches(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for b in batches:
            keep = [probability(model, t.as_py()) >= CUT for t in b.column(b.schema.get_field_index("text"))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of CUT or more, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    return docs.mapInArrow(_keep_batches(shared), docs.schema)


def op2_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))

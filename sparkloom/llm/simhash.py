"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints (64 bits, 3-word shingles, XXH64 seed 42) link at Hamming distance
3 or less.  A pair at distance d <= 3 meets at a point that is 1 or less from
one side and 2 or less from the other, so every fingerprint emits its ball of
radius 1, and those of odd parity also emit points at distance 2: two
fingerprints at distance 3 differ in parity, so one of them is odd, and of their
three differing bits two lie in the same half of the word, so only pairs of
flips within a half are needed (992 rather than 2016).  At a meeting point with a
radius-1 member everybody is within 3 of that member, so verification is by
geometry and the group becomes a star: edges are linear in its size.  A point
can gather no more than 65 + 992 distinct fingerprints.
Before that, fingerprints that can't have a partner are set aside: cut into
seven parts, two words at distance 3 or less agree in four of them at least; a
fingerprint alone in all its 35 part combinations emits nothing more.

drop_near_duplicates has its own rule, five-word shingles with a Jaccard
similarity of SIMILAR or more, and its own fingerprints: PRINTS of 64 bits, of the
distinct five-word shingles, whose balls meet in the same way, also only where four
parts agree.  (Of 32 bits, texts with no more than a passage in common meet too, all
with all.)  Meeting points are settled by hubs, each pair checked on the shingle sets
before it links.  Two sets at 0.8 differ in a seventh of the bits, so balls of radius 3
don't reach all of them: what they leave open is compared by prefix filtering, exact
for all pairs, over every set that can have a partner, after hubs of the shingles that
it looks at have settled groups of near copies.  A set of n shingles shares 0.8 n with
a partner, so, in the order of hashes, the l smallest that they share are among the
first 0.2 n + l of either; a set with fewer than that many of its first shingles in
other sets' first ones has no partner, and emits nothing more.

Cases: a null or empty text, or one without words, has fingerprint zero and
links like any other; fewer than three words make one shingle of all of them;
equal texts and repeated rows share a fingerprint, each row is returned; rows
with a null id take part and are returned, null ids never become component ids
unless the whole component has none (drop_near_duplicates then keeps one of its
rows); an empty table gives an empty result; further columns of docs are ignored.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import collect_garbage, components, materialize, release, table

SHINGLE = 3
SEED = 42
CHUNK = 1 << 16
NEAR_SHINGLE = 5
BROADCAST_ROWS = 200_000
BATCH = 512  # rows whose shingles are held at once
SIMILAR = (4, 5)  # least Jaccard similarity, as a fraction
PRINTS = 2
SLACK = 20  # l is one and a twentieth of the set
SIZE_STEP = 1.02  # sizes of sets within this factor share a bin
STARS = 2
HALVES = (range(0, 32), range(32, 64))
PARTS = tuple(range(64 * k // 7, 64 * (k + 1) // 7) for k in range(7))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


NEAR = [0] + [_signed(1 << i) for i in range(64)]
FAR = [_signed(1 << i | 1 << j) for half in HALVES for i, j in combinations(half, 2)]
AGREE = [_signed(sum(1 << i for part in four for i in part)) for four in combinations(PARTS, 4)]


def simhash(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both bytes methods know ASCII only, as asked for
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - SHINGLE + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        h = [digest(line[a : b - 1], SEED) for a, b in zip(starts[at:to], starts[min(at + SHINGLE, len(words)) :])]
        votes += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        fp = np.fromiter((simhash(t.as_py()) for t in b.column(2)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "mark", "fp"])


def _mark(doc_id, text):
    """A hash that tells the rows of one id apart by text, and those without an id from id 0."""
    return F.xxhash64(doc_id.isNull(), text.cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp): the fingerprint as a signed long."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    return docs.select(doc_id, _mark(doc_id, text), text.cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, mark long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fps(fp) that connect exactly
    what the links at distance 3 or less connect."""
    masks = F.array(*[F.lit(m) for m in AGREE])
    keyed = fps.select("fp", F.posexplode(masks).alias("part", "mask")).select("fp", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = keyed.groupBy("part", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("part", "key")
    close = materialize(keyed.join(shared, ["part", "key"]).select("fp").distinct(), "close")
    near = close.select("fp", F.explode(F.array(*[F.lit(m) for m in NEAR])).alias("flip"), F.lit(True).alias("near"))
    far = close.where(F.bit_count("fp") % 2 == 1).select("fp", F.explode(F.array(*[F.lit(m) for m in FAR])).alias("flip"), F.lit(False).alias("near"))
    met = near.union(far).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "near")
    star = met.withColumn("hub", F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("point")))
    return star.where("hub is not null and hub <> fp").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, fp) of every row, and (fp, root, first) per fingerprint:
    its component and its first row, by id and, for equal ids, by mark."""
    prints = materialize(fingerprints(docs), "prints")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")).alias("first")
    classes = prints.groupBy("fp").agg(first)
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return prints, materialize(rooted, "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    prints, rooted = _classes(docs)
    least = rooted.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id"))
    of_class = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(text: str | None, words: int):
    """Hashes of the distinct shingles of so many words, sorted; one of all words where there are fewer."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, starts = b" ".join(w), [0, *accumulate(len(x) + 1 for x in w)]
    ends = starts[words:] if len(w) >= words else starts[-1:]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, ends)), np.uint64)) if w else np.zeros(0, np.uint64)


def _prints(own) -> list[int]:
    """The 64-bit fingerprints of a set of hashes, signed: a bit is 1 if set in over half of them."""
    import numpy as np

    votes = np.zeros((PRINTS, 64), np.int64)
    for at in range(0, len(own), CHUNK):
        h = own[at : at + CHUNK]
        for k in range(PRINTS):
            votes[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.packbits(2 * votes.ravel() > len(own), bitorder="little").view("<i8").tolist()


def _least_shared(n: int) -> int:
    """l of a set of n."""
    return 1 + n // SLACK


def _first(n: int) -> int:
    """How many of n shingles, in the order of hashes, hold the l smallest that are shared with a partner."""
    return n - -(-n * SIMILAR[0] // SIMILAR[1]) + _least_shared(n) if n else 0


def _print_batches(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash

    for b in (x.slice(at, BATCH) for x in batches for at in range(0, x.num_rows, BATCH)):
        sets, prints, firsts, sizes, least = [], [], [], [], []
        for t in b.column(2):
            own = _shingles(t.as_py(), NEAR_SHINGLE)
            n = len(own)
            sets.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            prints.append(_prints(own))
            firsts.append(own[: _first(n)].view(np.int64))
            sizes.append(n)
            least.append(_least_shared(-(-n * SIMILAR[0] // SIMILAR[1])))  # that of the smallest partner
        columns = [pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(least, pa.int64())]
        columns += [pa.array(x, pa.list_(pa.int64())) for x in (prints, firsts)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "mark", "fp", "size", "least", "prints", "tokens"])


def _set_batches(batches):
    import numpy as np
    import pyarrow as pa

    for b in (x.slice(at, BATCH) for x in batches for at in range(0, x.num_rows, BATCH)):
        sets = [_shingles(t.as_py(), NEAR_SHINGLE).view(np.int64) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "words"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of SIMILAR or more."""
    a, b = sets.select(F.col("fp").alias("u"), F.col("words").alias("a")), sets.select(F.col("fp").alias("v"), F.col("words").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(both * SIMILAR[1] >= SIMILAR[0] * (F.size("a") + F.size("b") - both)).select("u", "v")


def _hub_pairs(rest: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Each bucket's hub of round k with its other members, and the buckets without it.
    The first hub is the member that meets most others over all its buckets, which of a
    group of near copies is close to what they are copies of; the next one is any.
    Members with a rank in the bucket pair where it leaves room for the overlap needed."""
    hub = rest.groupBy("key").agg(F.max(F.struct("weight" if k == 0 else F.xxhash64("fp"), *[c for c in rest.columns if c not in ("key", "weight")])).alias("hub"))
    met = rest.join(hub, "key")
    fit = (F.col("root") != F.col("hub.root")) & _sizes_fit(F.col("size"), F.col("hub.size"))
    if "rank" in rest.columns:
        fit &= _room(F.col("size"), F.col("rank"), F.col("hub.size"), F.col("hub.rank"))
    pairs = met.where(fit).select(F.least("fp", "hub.fp").alias("u"), F.greatest("fp", "hub.fp").alias("v")).distinct()
    return pairs, met.where("fp <> hub.fp").select(rest.columns)


def _sizes_fit(a: Column, b: Column) -> Column:
    """Set sizes that allow a Jaccard similarity of SIMILAR."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def _needed(n: Column, m: Column) -> Column:
    """The overlap that sets of n and m need for SIMILAR."""
    return F.ceil((SIMILAR[0] * (n + m)).cast("double") / sum(SIMILAR))


def _room(n: Column, rank: Column, m: Column, its: Column) -> Column:
    """Whether so much follows a shingle of these ranks, itself included, in sets of n and m."""
    return F.least(n - rank, m - its) >= _needed(n, m)


def _ordered(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of rest (fp, size, root) with closed, the number of their shingles that are held
    within one component, rare, the others (df, token) by ascending frequency, and least, the
    size of the smallest partner."""
    tokens = sets.join(rest, "fp").select("fp", "size", "root", F.explode("words").alias("token"))
    open_ = tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("token", "df")
    own = tokens.join(open_, "token").groupBy("fp", "size", "root").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("rare"))
    own = own.withColumn("closed", F.col("size") - F.size("rare")).withColumn("least", F.greatest(F.lit(1), F.ceil(F.col("size") * SIMILAR[0] / SIMILAR[1])))
    return materialize(own, "rare")


def _emitted(m: Column) -> Column:
    """The open ones of the first shingles that members of _ordered look at for a partner of size m."""
    return F.slice("rare", 1, F.greatest(F.lit(0), F.col("size") - _needed(F.col("size"), m) + 1 - F.col("closed")).cast("int"))


def _token_members(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (key, fp, size, root, rank) of the shingles that prefix filtering looks at: those
    of a similar pair in different components meet at the first that they share."""
    own = _ordered(rest, sets).select("fp", "size", "root", "closed", F.posexplode(_emitted(F.col("least"))).alias("at", "x"))
    return own.select(F.col("x.token").alias("key"), "fp", "size", "root", (F.col("closed") + F.col("at")).alias("rank"))


def _prefix_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of members of rest (fp, size, root) in different components that can
    have a Jaccard similarity t of SIMILAR: prefix filtering.

    Shingles are ordered: those held within one component first, the others by ascending
    frequency.  Sets of n and m shingles need an overlap a of t / (1 + t) (n + m), so the
    first shingle in this order that they share is among the first n - a + 1 and m - a + 1
    of them, and no more than a - 1 follow it in either.  Members say for which sizes of a
    smaller partner, in bins, they send a shingle, so that those that lie too far from all
    others of their size send none: a large group of them makes no pairs."""
    bin_of = lambda n: F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")
    own = _ordered(rest, sets)
    rank = (F.col("closed") + F.col("at")).alias("rank")
    small = own.select("fp", "size", "root", "closed", F.posexplode(_emitted(F.col("size"))).alias("at", "x"))
    small = small.select(F.col("x.token").alias("token"), bin_of(F.col("size")).alias("bin"), F.col("fp").alias("v"), F.col("size").alias("other"), F.col("root").alias("its"), rank.alias("its_rank"))
    bins = own.select("*", F.explode(F.sequence(bin_of(F.col("least")), bin_of(F.col("size")))).alias("bin"))
    low = F.greatest(F.col("least"), F.floor(F.pow(F.lit(SIZE_STEP), F.col("bin").cast("double"))))
    large = bins.select("fp", "size", "root", "closed", "bin", F.posexplode(_emitted(low)).alias("at", "x")).select("fp", "size", "root", "bin", F.col("x.token").alias("token"), rank)
    smaller = (F.col("other") < F.col("size")) | ((F.col("other") == F.col("size")) & (F.col("v") < F.col("fp")))
    enough = _room(F.col("size"), F.col("rank"), F.col("other"), F.col("its_rank"))
    near = (large.token == small.token) & (large.bin == small.bin) & smaller & (F.col("root") != F.col("its")) & enough
    return large.join(small, near).select(F.least("fp", "v").alias("u"), F.greatest("fp", "v").alias("v")).distinct()


def _open(rest: DataFrame) -> DataFrame:
    """The members of rest (key, root and others) in buckets of several components."""
    several = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return rest.join(several, "key")


def _link(pairs: DataFrame, sets: DataFrame, edges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """edges with the similar ones of the pairs, and (node, root) of the components that they make."""
    new = materialize(_similar(materialize(pairs, "pairs"), sets), "similar")
    edges = new if edges is None else edges.union(new)
    return edges, materialize(components(edges), "roots")


def _stars(members: DataFrame, sets: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """edges and roots after STARS rounds, each of which compares the hub of every bucket of
    members (key, fp, size, root) with the others and takes it out."""
    of_key = members.groupBy("key").agg(F.count("*").alias("n"))
    weights = members.join(of_key, "key").groupBy("fp").agg(F.sum("n").alias("weight"))
    rest = materialize(members.join(weights, "fp"), "weighted")
    for k in range(STARS):
        pairs, rest = _hub_pairs(rest, k)
        edges, roots = _link(pairs, sets, edges)
        if k < STARS - 1:
            rest = materialize(_open(_rooted(rest, roots)), "rest")
    return edges, roots


def _near_roots(members: DataFrame, sets: DataFrame, close: DataFrame | None = None) -> DataFrame:
    """(node, root) of the components that the similar pairs of close (fp, size), or without it
    of the members (key, fp, size), make.  Hubs of the members' buckets, then those of the
    shingles that prefix filtering looks at, settle groups of near copies without their pairs;
    sets of which one of these shingles is then still held in several components are compared
    by prefix filtering, which no pair escapes."""
    close = members.select("fp", "size").distinct() if close is None else close
    members = materialize(members.withColumn("root", F.col("fp")), "members")
    collect_garbage(members.sparkSession)
    edges, roots = _stars(members, sets)
    tokens = materialize(_open(_token_members(_rooted(close, roots), sets)), "tokens")
    collect_garbage(tokens.sparkSession)
    edges, roots = _stars(tokens, sets, edges)
    left = materialize(_open(_rooted(tokens, roots)).select("fp", "size", "root").distinct(), "left")
    return _link(_prefix_pairs(left, sets), sets, edges)[1]


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    """df (fp and others) with the root of each."""
    return df.drop("root").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _close(classes: DataFrame) -> DataFrame:
    """fp of the sets (fp, least, tokens) with least or more of their first shingles in another's first ones."""
    tokens = classes.select("fp", "least", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("token")
    return tokens.join(shared, "token").groupBy("fp", "least").agg(F.count("*").alias("n")).where("n >= least").select("fp")


def _meetings(close: DataFrame) -> DataFrame:
    """Members (key, fp, size) of the points at which the balls around the prints of close (fp,
    size, prints) meet with a near side; of points with the same members one is kept.

    Balls are those of distinct prints, 1057 at most at a point, so all of a point's come
    together in one shuffle.  Spark judges the size of what is exploded by the table that
    it is made of: neither these points nor the keys of parts may be broadcast."""
    who = F.xxhash64("k", "print").alias("who")
    sets = close.select("fp", "size", F.posexplode("prints").alias("k", "print"))
    prints = materialize(sets.groupBy("k", "print").agg(F.count("*").alias("many")), "prints")
    keyed = prints.select("*", F.posexplode(F.array(*[F.lit(m) for m in AGREE])).alias("part", "mask"))
    keyed = keyed.select("k", "print", "many", "part", F.col("print").bitwiseAND(F.col("mask")).alias("agree"))
    shared = keyed.groupBy("k", "part", "agree").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi").select("k", "part", "agree")
    alike = keyed.hint("merge").join(shared, ["k", "part", "agree"]).select("k", "print", "many").union(prints.where("many > 1")).distinct()
    alike = materialize(alike, "alike")
    near = alike.select("*", F.explode(F.array(*[F.lit(m) for m in NEAR])).alias("flip"), F.lit(True).alias("near"))
    far = alike.where(F.bit_count("print") % 2 == 1).select("*", F.explode(F.array(*[F.lit(m) for m in FAR])).alias("flip"), F.lit(False).alias("near"))
    met = near.union(far).select(F.xxhash64("k", F.col("print").bitwiseXOR(F.col("flip"))).alias("key"), who, "many", "near")
    at = Window.partitionBy("key")
    met = met.select("key", "who", F.sum("many").over(at).alias("n"), F.bit_xor("who").over(at).alias("all"), F.max("near").over(at).alias("near"))
    met = materialize(met.where("n > 1 and near").select("key", "who", "n", "all"), "met")
    points = met.groupBy("n", "all").agg(F.min("key").alias("key")).select("key")
    return met.select("key", "who").join(points, "key").join(sets.select("fp", "size", who), "who").select("key", "fp", "size")


def _near_classes(docs: DataFrame) -> DataFrame:
    """(fp, root, first) per distinct shingle set, as in _classes."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    keyed = docs.select(doc_id.alias("doc_id"), _mark(doc_id, text).alias("mark"), text.cast("string").alias("text"))
    prints = keyed.mapInArrow(_print_batches, "doc_id long, mark long, fp long, size long, least long, prints array<long>, tokens array<long>")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")).alias("first")
    classes = materialize(prints.groupBy("fp").agg(first, *[F.first(c).alias(c) for c in ("size", "least", "prints", "tokens")]), "sets-of")
    close = materialize(classes.join(_close(classes), "fp").select("fp", "size", "prints", "first"), "close")
    firsts = materialize(classes.select("fp", "first"), "firsts")
    release(classes)  # most of it is the first shingles
    collect_garbage(docs.sparkSession)
    wanted = close.select("fp", F.coalesce("first.doc_id", F.lit(0)).alias("id"), "first.mark")
    wanted = materialize(wanted, "wanted")
    if wanted.count() <= BROADCAST_ROWS:  # of three longs; then only these texts are shuffled, and beyond it all are
        wanted = F.broadcast(wanted)
    texts = keyed.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "mark", "text").join(wanted, ["id", "mark"]).dropDuplicates(["fp"])
    sets = materialize(texts.select("fp", "text").mapInArrow(_set_batches, "fp long, words array<long>"), "sets")
    roots = _near_roots(_meetings(close), sets, close.select("fp", "size"))
    return materialize(firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group that Jaccard similarities of SIMILAR or more
    of five-word shingles connect: one with the smallest id, or of a group
    without any id one of its rows; where an id repeats with several texts, the
    texts are told apart.  The join and the removal of repeated rows share one
    shuffle of docs."""
    own = "_" * max(map(len, docs.columns))  # in front of a name it makes one that docs doesn't have
    one = _near_classes(docs).groupBy("root").agg(F.min("first").alias("first"))
    keep = one.select(F.coalesce("first.doc_id", F.lit(0)).alias(own + "id"), F.col("first.mark").alias(own + "mark"))
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.withColumn(own + "id", F.coalesce(doc_id, F.lit(0))).withColumn(own + "mark", _mark(doc_id, F.col("text")))
    kept = keyed.join(keep, [own + "id", own + "mark"], "left_semi").dropDuplicates([own + "id", own + "mark"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

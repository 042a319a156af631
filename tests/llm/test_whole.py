"""The operators do the whole job: what an earlier form of each left out."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from sparkloom.llm import _common, classifier, licenses, lm, packing, pieces, pii, simhash, warc
from sparkloom.llm._common import components

from .cases import none, odd


# near-duplicate stage
def jaccard(a, b):
    s = [{" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_copies_go_as_by_brute_force(spark):
    rng, texts = random.Random(7), []
    for _ in range(12):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 130, 250]))]
        for _ in range(8):
            v = list(w)
            for at in rng.sample(range(len(v)), rng.choice([1, 2, 3, len(v) // 40, len(v) // 25])):
                v[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    group = list(range(len(texts)))
    far = 0
    for a, b in combinations(range(len(texts)), 2):
        if jaccard(texts[a], texts[b]) >= 0.8:
            far += (simhash.simhash(texts[a]) ^ simhash.simhash(texts[b])).bit_count() > 3
            group = [group[a] if g == group[b] else g for g in group]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert far and sorted(r["doc_id"] for r in kept.collect()) == sorted({min(i for i, g in enumerate(group) if g == x) for x in group})


def test_a_bucket_of_unlike_members_is_settled(spark):
    a = list(range(100))
    sets = {k: [*a[: 70 if k % 2 else 100], *range(1000 * (k % 4) + 1000, 1000 * (k % 4) + 1030)] for k in range(12)}
    members = spark.createDataFrame([(5, k, len(x)) for k, x in sets.items()], "key long, fp long, size long")
    roots = {r["node"]: r["root"] for r in simhash._near_roots(members, spark.createDataFrame(list(sets.items()), "fp long, words array<long>")).collect()}
    assert [roots.get(k, k) for k in range(12)] == [k % 4 for k in range(12)]


def test_alike_texts_below_the_threshold_make_no_pairs(spark):
    """Members that share 84 of 100 shingles, each with 16 of its own, have a similarity of 0.72."""
    sets = [(k, [*range(84), *range(1000 * (k + 1), 1000 * (k + 1) + 16)]) for k in range(300)]
    df = spark.createDataFrame(sets, "fp long, words array<long>")
    rest = df.selectExpr("fp", "cast(100 as long) as size", "fp as root")
    assert simhash._prefix_pairs(rest, df).count() == 0


def test_prefix_pairs_lose_no_similar_pair(spark):
    rng = random.Random(11)
    sets = []
    for g in range(10):
        base = rng.sample(range(100_000), rng.choice([7, 30, 90, 200]))
        for _ in range(14):
            own = list(base)
            for at in rng.sample(range(len(own)), rng.randint(0, len(own) // 6)):
                own[at] = rng.randrange(100_000, 200_000)
            sets.append(sorted(set(own[rng.randint(0, len(own) // 8) :])))
    df = spark.createDataFrame(list(enumerate(sets)), "fp long, words array<long>")
    rest = df.selectExpr("fp", "cast(size(words) as long) as size", "fp % 50 as root")
    found = {(r["u"], r["v"]) for r in simhash._prefix_pairs(rest, df).collect()}
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if a % 50 != b % 50 and 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})}
    assert want and want <= found and len(found) < 140 * 139 / 4
    kept = {(r["u"], r["v"]) for r in simhash._similar(spark.createDataFrame(sorted(found), "u long, v long"), df).collect()}
    assert kept == want


def test_near_copies_that_no_band_of_minhashes_shares_go(spark):
    """Pairs with a similarity of 0.8, 40 of 50 shingles, that 24 bands of 5 minhashes lose."""
    texts = []
    for s in (20485, 30334, 55847):
        w = [f"{s}w{i}" for i in range(49)]
        texts += [" ".join(w), " ".join([*w[:44], "x", *w[45:]])]
        assert math.isclose(jaccard(*texts[-2:]), 0.8)
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4]


def test_texts_with_a_passage_in_common_do_not_meet(spark):
    """300 sets that share 60 of 100 shingles, a similarity of 0.43, are no members of any bucket."""
    rng = random.Random(3)
    common = [rng.randrange(1 << 64) for _ in range(60)]
    sets = [np.array(common + [rng.randrange(1 << 64) for _ in range(40)], np.uint64) for _ in range(300)]
    rows = [(k, 100, simhash._prints(own)) for k, own in enumerate(sets)]
    assert simhash._meetings(spark.createDataFrame(rows, "fp long, size long, prints array<long>")).count() == 0


def test_hubs_of_shingles_settle_copies_without_their_pairs(spark):
    """200 sets with 92 shingles of a base of 100: 0.85 like it, less than 0.8 like most of each other."""
    rng = random.Random(9)
    base = list(range(100))
    sets = [(0, base)] + [(k, sorted(rng.sample(base, 92)) + list(range(1000 * k, 1000 * k + 8))) for k in range(1, 201)]
    df = spark.createDataFrame(sets, "fp long, words array<long>")
    members = simhash._open(simhash._token_members(df.selectExpr("fp", "cast(100 as long) as size", "fp as root"), df))
    edges, roots = simhash._stars(members, df)
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(k, 0) for k in range(1, 201)} and edges.count() < 1000


def test_balls_of_the_stage_meet_up_to_three_bits(spark):
    rng, rows = random.Random(5), []
    for k in range(60):
        base = [rng.randrange(1 << 32) for _ in range(simhash.PRINTS)]
        other = [x ^ sum(1 << i for i in rng.sample(range(32), 7)) for x in base]
        at = k % simhash.PRINTS
        other[at] = base[at] ^ sum(1 << i for i in rng.sample(range(32), k % 6))
        rows += [(2 * k, 50, base), (2 * k + 1, 50, other)]
    found = {}
    for r in simhash._meetings(spark.createDataFrame(rows, "fp long, size long, prints array<long>")).collect():
        found.setdefault(r["key"], set()).add(r["fp"])
    pairs = {tuple(sorted(x)) for x in found.values()}
    assert {(2 * k, 2 * k + 1) for k in range(60) if k % 6 <= 3} <= pairs and not any((2 * k, 2 * k + 1) in pairs for k in range(60) if k % 6 == 5)


def test_components_of_one_task_and_of_rounds(spark, monkeypatch):
    """The same roots as by hand either way, and of few edges, here a chain of 500, a few jobs."""
    rng = random.Random(4)
    chain = rng.sample(range(10**6), 500)
    edges = [*zip(chain, chain[1:]), *((-k, -k % 7 - 60) for k in range(1, 50)), (5, 5), (-(1 << 63), (1 << 63) - 1)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    want = {k: v for k, v in root.items() if k != v}
    df = spark.createDataFrame(edges, "u long, v long")
    spark.sparkContext.setJobGroup("components", "")
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setJobGroup("others", "")
    assert jobs <= 6 and components(df.limit(0)).count() == 0
    monkeypatch.setattr(_common, "LOCAL_EDGES", 0)
    assert {r["node"]: r["root"] for r in components(df).collect()} == want and components(df.limit(0)).count() == 0


def test_no_ball_is_broadcast(spark, monkeypatch):
    """A small table of prints makes many points and keys: they go to no driver."""
    plans, write = [], simhash.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "materialize", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    rng = random.Random(2)
    base = [rng.randrange(1 << 62) for _ in range(simhash.PRINTS)]
    close = spark.createDataFrame([(k, 50, [x ^ k for x in base]) for k in range(40)], "fp long, size long, prints array<long>")
    plans.append(plan(simhash._meetings(write(close, "close"))))
    depth, within, seen = lambda x: len(re.match(r"[\s:+*-]*", x)[0]), None, 0
    for line in "\n".join(plans).split("\n"):
        within = None if within is not None and depth(line) <= within else within
        within = depth(line) if "BroadcastExchange" in line and within is None else within
        made = re.search(r"explode\(\[", line)
        seen += bool(made)
        assert within is None or not made
    assert seen >= 3


def test_sets_set_aside_have_no_partner():
    """Two sets of that similarity share, among their first shingles, as many as either one is asked for."""
    rng = random.Random(3)
    least = lambda n: simhash._least_shared(-(-n * 4 // 5))
    for _ in range(4000):
        n = rng.choice([1, 2, 4, 5, 9, 20, 50, 130, 400])
        a = rng.sample(range(10**6), n)
        b = [*a[: n - rng.randint(0, n // 4)], *rng.sample(range(10**6, 2 * 10**6), rng.randint(0, n // 4))]
        a, b = ([(x * 7919 + 13) % 1000003 for x in y] for y in (a, b))
        if 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b}):
            first = [{*sorted({*y})[: simhash._first(len({*y}))]} for y in (a, b)]
            assert len(first[0] & first[1]) >= max(least(len({*a})), least(len({*b})))


# classifier
def test_the_solver_reaches_the_optimum():
    """Against projected gradient ascent on the dual, and by the gap between primal and dual."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = (rng.random((60, 40)) < 0.2).astype(float)
    x[:, 0] = 1
    y = np.where(x[:, 1:6].sum(1) + 0.4 * rng.normal(size=60) > 1, 1.0, -1.0)
    ratio = np.zeros(1 << classifier.BITS)
    ratio[:40] = rng.normal(size=40)
    ratio[0] = 1
    rows = [np.flatnonzero(r) for r in x]
    w = classifier._hinge(rows, y, ratio, 1, epochs=3000)[:40]
    z = x * ratio[:40]
    cap = classifier.C / (2 * np.where(y > 0, (y > 0).mean(), (y < 0).mean()))
    primal = lambda v: v @ v / 2 + (cap * np.maximum(0, 1 - y * (z @ v))).sum()
    q, a = (y[:, None] * z) @ (y[:, None] * z).T, np.zeros(60)
    for _ in range(200_000):
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, cap)
    dual = a.sum() - a @ q @ a / 2
    assert abs(primal(w) - dual) < 1e-4 * dual and np.allclose(w, z.T @ (a * y), atol=1e-3)


def test_scores_are_those_of_a_plain_model(spark):
    import numpy as np

    docs = [(k, f"good plain words {k % 7} follow here" if k % 2 else f"BAD $$$ {k % 5} %% zz zz") for k in range(40)] + [(41, None), (42, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = classifier.learn(df, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int"))
    w, slope, offset = model
    got = {r["doc_id"]: r["score"] for r in classifier.scores(df, model).collect()}
    for k, t in docs:
        f = set()
        words, shapes = (t or "").lower().split(), []
        for s in (t or "").split():
            shapes.append(re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", s)))))
        runs = ["^", *["=" if i and words[i] == words[i - 1] else s for i, s in enumerate(shapes)], "$"]
        top = (1 << classifier.BITS) - 1
        f |= {zlib.crc32(x.encode()) % top + 1 for x in words}
        f |= {zlib.crc32(b"\0" + " ".join(runs[i : i + n]).encode()) % top + 1 for n in (1, 2, 3) for i in range(len(runs) - n + 1)}
        margin = float(np.sum(w[sorted({0, *f})], dtype=np.float64))
        assert math.isclose(got[k], 1 / (1 + math.exp(-(slope * margin + offset))), rel_tol=1e-4), k
    assert all((got[k] >= 0.3) == bool(k % 2) for k in range(40))


def test_what_is_learnt_from_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda rows, labels: seen.append([len(r) for r in rows]))
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5][:60]
    docs = spark.createDataFrame([(ids[0], f"copy number {k}") for k in range(500)] + [(k, f"some words of {k}") for k in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    classifier.learn(docs, labels)
    classifier.learn(docs, labels, fit_rows=5)
    monkeypatch.setattr(classifier, "FIT_FEATURES", 100)
    classifier.learn(docs, labels)
    assert len(seen[0]) == 60 and len(seen[1]) == 5 and seen[2] and sum(seen[2]) <= 100 and seen[2] == seen[0][: len(seen[2])]


# language model
def test_rows_whose_texts_shift_at_their_seams(spark, monkeypatch):
    """Null and repeated ids in several partitions: their blocks hold equal bytes, but not equal tokens."""
    rows = [[(None, "ab x"), (None, "c y")], [(None, "ab xc"), (None, " y")], [(7, "ab x"), (7, "c y")], [(7, "ab xc"), (7, " y")], [(7, "ab x"), (7, "c y")], [(3, "ab c"), (8, "y y x")]]
    part = [spark.createDataFrame(r, "doc_id long, text string").coalesce(1) for r in rows]
    df = part[0]
    for p in part[1:]:
        df = df.union(p)
    monkeypatch.setattr(lm, "LEAST_BUCKETS", 4)
    words = [(d, [*t.split(), "\n"]) for r in rows for d, t in r]
    crc = lambda d: 1 << 20 if d is None else zlib.crc32(str(d).encode())
    train = Counter(w for d, ws in words if d is None or crc(d) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    want = sorted((str(d), len(ws), sum(train[w] > 0 for w in ws), round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 9)) for d, ws in words)
    got = lm.score(df).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 9)) for r in got) == want and {r["train_tokens"] for r in got} == {n}
    rounded = lambda x: sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 9)) for r in x)
    assert rounded(got) == rounded(lm.score(df.coalesce(1)).collect()) == rounded(lm.score(df.coalesce(2), block_tokens=2, bucket_bytes=1).collect())


# archives
def test_an_archive_that_is_cut_off_is_an_error(tmp_path):
    import io

    row = {"record_id": "r", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "D", "payload_bytes": 300, "payload": b"abc" * 100}
    one = warc.record(row)
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    member = pack.compress(one) + pack.flush()
    for gz, unit in ((False, one), (True, member)):
        read = lambda raw, **how: list(warc.records(io.BytesIO(raw), gz, how.get("wanted", {}), how.get("payload", True)))  # noqa: E731,B023
        assert len(read(unit * 3)) == len(read(unit * 3, payload=False)) == 3 and read(b"") == [] and read(unit * 2, wanted={"record_type": {"revisit"}}) == []
        for cut in (1, 3, 5, len(unit) // 3, len(unit) // 2, len(unit) - 10):
            for how in ({}, {"payload": False}, {"wanted": {"record_type": {"revisit"}}}):
                with pytest.raises((EOFError, zlib.error)):
                    read(unit * 2 + unit[:-cut], **how)


def test_a_long_payload_is_read_in_linear_time(tmp_path):
    import io
    import time

    row = {"record_id": "r", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "D", "payload_bytes": 1 << 27, "payload": b"x" * (1 << 27)}
    began = time.time()
    assert len(next(warc.records(io.BytesIO(warc.record(row)), False, {}, True))[-1]) == 1 << 27 and time.time() - began < 5


# personal data
def test_a_far_term_discloses_and_goes_everywhere(spark):
    filler = "plain words follow here " * 20
    docs = [(k if k % 2 else None, f"Zanzibar first. {filler}jo@x.org and kim@x.org {filler}then ZANZIBAR again and zanzibar") for k in range(4)]
    docs += [(9, f"Zanzibar {filler}"), *((10 + k, filler) for k in range(60))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["entity"], r["term"], r["action"]) for r in pii.disclosures(pii.find(df, ["doc_id"]).where(pii._any_found()), df).collect()}
    assert got == {(f"email:{e}@x.org", t, a) for e in ("jo", "kim") for t, a in (("zanzibar", "generalise"), ("first", "remove"), ("again", "remove"), ("then", "remove"))}
    texts = [r["text"] for r in pii.sanitize(df).collect()]
    assert sorted(texts) == sorted([f"[NAME] . {filler}[EMAIL] and [EMAIL] {filler} [ACRONYM]  and [WORD]"] * 4 + [t for _, t in docs[4:]])
    spans = [r["spans"] for r in pii.digests(df).where("n_email > 0").collect()]
    assert len(spans) == 4 and all(x.count("term:") == 6 for x in spans)


# packing
def test_sequences_hold_the_ids_of_every_document(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = odd(spark).distinct()
    packed = packing.pack(docs).cache()
    whole, lengths = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}, {r["sequence_id"]: r for r in packing.fill(packed).collect()}
    assert set(whole) == set(lengths) and all(len(r["ids"]) == lengths[k]["padded"] and r["length"] == lengths[k]["ids"] and not any(r["ids"][r["length"] :]) for k, r in whole.items())
    got = {}
    for r in packed.orderBy("start").collect():
        ids = whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        got.setdefault(r["doc_id"], []).extend(ids)
    assert got == {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect()}


# pieces
def test_encoding_gives_the_segmentations(spark):
    import numpy as np
    import public_tokenizers

    p = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    texts = ["the rain in spain", "a b", "漢 é\n the theory", "x", "", None, "the rain " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pieces.encode(rows).cache()
    for r in got.collect():
        text, paths = texts[r["doc_id"]] or "", [(x["score"], tuple(np.frombuffer(x["ids"], "<u4").tolist())) for x in r["paths"]]
        want = pieces.search(p.edges("▁" + text.replace(" ", "▁")), 4) if text else [(0.0, ())]
        assert np.allclose([s for s, _ in paths], [s for s, _ in want], rtol=1e-12) and len({x for _, x in paths}) == len(paths)
        piece = {i: s for i, s in p.score.values()}
        for s, ids in paths:
            unknown = len({b for b in p.byte.values()} & set(ids)) and "漢" in text
            assert p.decode(ids) == text and (unknown or np.isclose(sum(piece[i] for i in ids), s))
    for rank in (0, 1):
        back = {r["doc_id"]: r["text"] for r in pieces.decode(got, rank=rank).collect()}
        assert back == {k: (t or "") if rank == 0 or len(t or "") > 1 else back[k] for k, t in enumerate(texts)}


def test_the_query_digests_and_decodes_every_path(spark, tmp_path):
    import numpy as np
    import public_tokenizers

    p = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    texts = ["the rain in spain", "漢 é\n the theory", " two  spaces ", "x", "", None, "a\u2581b", "a\u2581漢"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pieces.op3_pieces(spark, str(tmp_path)).collect():
        text = texts[r["doc_id"]] or ""
        want = pieces.search(p.edges("▁" + text.replace(" ", "▁")), 4) if text else [(0.0, ())]
        got = sorted(r["paths"].split(","))
        assert got == sorted(f"{len(ids)}:{zlib.crc32(np.array(ids, '<u4').tobytes())}" for _, ids in want)
        assert np.allclose([float(s) for s in r["scores"].split(",")], [s for s, _ in want], rtol=1e-12)
        assert r["round_trip"] == all(p.decode(ids) == text for _, ids in want) == ("\u2581" not in text)


def test_long_words_cost_time_and_memory_in_proportion():
    import time
    import tracemalloc

    import public_tokenizers

    p = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    for unit in ("漢字仮名交じり文", "abcdefghijk", "a", "the"):
        took = []
        for n in (20_000, 200_000):
            word = (unit * n)[:n]
            began = time.process_time()
            ids, scores = pieces.Encoder(p).encode(word)
            took.append(time.process_time() - began)
            assert len(scores) <= 4
        assert took[1] < 40 * took[0] + 0.5
    tracemalloc.start()
    assert pieces.Encoder(p).paths("a" * 50_000)
    assert tracemalloc.get_traced_memory()[1] < 50_000 * 200
    tracemalloc.stop()


def test_what_is_kept_of_words_is_bounded(monkeypatch):
    kept = pieces._Kept(len, 10_000)
    for k in range(1000):
        assert kept[f"word {k}"] == len(f"word {k}")
    assert len(kept) < 25 and kept["x" * pieces.SHORT] == pieces.SHORT and "x" * pieces.SHORT not in kept


def test_the_collector_is_as_it_was():
    import gc

    import pyarrow as pa

    run = pieces._encode_batches(None, 4)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b"])], names=["doc_id", "text"])
    assert len(list(run([batch]))) == 1 and gc.isenabled()


# licences
def test_licences_within_a_paragraph_and_several_of_them(spark):
    mit = "Released under the MIT License."
    text = f"Ünder any machine. {mit} See the site, é. Licensed under CC BY 4.0. And again: {licenses.TEMPLATES['ISC']} {mit} end"
    got = {r["doc_id"]: r["matches"] for r in licenses.find_licenses(spark.createDataFrame([(1, text), (2, None), (3, "no notice")], "doc_id long, text string")).collect()}
    found = [(m["license"], text[m["start"] : m["end"]], m["dice"]) for m in got[1]]
    want = [("MIT", mit[:-1], 1.0), ("CC-BY-4.0", "Licensed under CC BY 4.0", 1.0), ("ISC", licenses.TEMPLATES["ISC"][:-1], 1.0), ("MIT", mit[:-1], 1.0)]
    assert [x for x in found if x[2] == 1.0] == want and got[2] == got[3] == []


def plain_notices(text, templates, threshold):
    """Every window of a template's length compared as a set, the best first, without overlaps."""
    places = [(m.start(), m.end(), m[0].lower()) for m in re.finditer("[A-Za-z0-9]+", text)]
    words, out = [w for _, _, w in places], []
    for name, t in templates.items():
        own = re.findall("[a-z0-9]+", t.lower())
        grams, width = set(zip(own, own[1:])), min(len(own) - 1, len(words) - 1)
        found = []
        for at in range(len(words) - width):
            window = set(zip(words[at : at + width], words[at + 1 : at + width + 1]))
            dice = 2 * len(window & grams) / (len(window) + len(grams))
            if dice >= threshold:
                found.append((-dice, at))
        taken = []
        for minus, at in sorted(found):
            if all(abs(at - x) > width for x in taken):
                taken.append(at)
                out.append((name, places[at][0], places[at + width][1], -minus))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def test_licence_windows_against_brute_force(spark):
    rng = random.Random(9)
    templates = {k: licenses.TEMPLATES[k] for k in ("MIT", "ISC", "CC-BY-4.0", "GPL-3.0", "MPL-2.0")}
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            w = templates[rng.choice(list(templates))].split() if rng.random() < 0.7 else [rng.choice("é licensed under the a of work".split()) for _ in range(rng.randint(1, 30))]
            for at in rng.sample(range(len(w)), min(len(w), rng.choice([0, 0, 1, 3]))):
                w[at] = rng.choice(["x", w[0], ""])
            parts.append(" ".join(w))
        texts.append(rng.choice([" ", "\n", ". é "]).join(parts))
    got = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()}
    assert sum(map(len, got.values())) > 30
    for k, t in enumerate(texts):
        assert got[k] == plain_notices(t, templates, licenses.THRESHOLD), t


def test_full_licence_texts(spark):
    full = licenses.full_texts()
    docs = [(k, f"before it {t} after it") for k, t in enumerate(full.values())]
    got = {r["doc_id"]: {m["license"]: m["dice"] for m in r["matches"]} for r in licenses.find_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(full) == 12 and all(got[k][name] == 1.0 for k, name in enumerate(full))


# the pipeline
def test_pipeline_of_odd_rows_and_of_none(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, 1)], "doc_id long, quality int")
    good = "A clear sentence about rivers and towns that any reader may follow with ease. "
    more = [(20 + k, good + f"Number {k} of the series, written to {k}@x.org on day {k} of the month.", None, None, None, k, 0.5, "x", None, 9, 8) for k in range(6)]
    more += [more[0], (None, good + "No id at all, yet a text like the others here.", *[None] * 9)]
    for name, docs in (("odd", odd(spark).union(spark.createDataFrame(more, odd(spark).schema))), ("none", none(spark))):
        path = str(tmp_path / name)
        docs.write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for step, stage in cp.STAGES[:-1]:
            now = stage(spark, now, path)
            assert now.columns == docs.columns, step
        kept = now.collect()
        assert len(kept) <= docs.count() and all("@x.org" not in (r["text"] or "") for r in kept)
        out = cp.run(spark, path)
        whole = out.where("doc_id is not null").groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
        assert out.select("sequence_id", "offset").distinct().count() == out.count() and all(r[1] % r[2] == 0 for r in whole)
        assert (out.count() == 0) == (not kept)

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import classifier, licenses, lm, packing, pieces, pii, rules, simhash
from sparkloom.llm._common import components

from .cases import LONG, none, odd

SF = "/root/testdata/sf0.01"


# SimHash
def plain_simhash(text):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB é\n\t x", max_size=60))
def test_simhash_is_the_plain_one(text):
    assert simhash.simhash(text) == plain_simhash(text)


def test_links_connect_what_brute_force_connects(spark):
    import random

    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 3, 4])):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    group = {x: x for x in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            ra, rb = find(a), find(b)
            group[ra] = rb
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    root = {r["node"]: r["root"] for r in got}
    mine = {}
    for x, s in zip(fps, signed):
        mine.setdefault(root.get(s, s), set()).add(x)
    theirs = {}
    for x in fps:
        theirs.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_near_duplicates_of_odd_rows(spark):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd(spark)).collect()]
    assert len(got) == 9
    by = {k: (f, c) for k, f, c in got}
    assert by[2] == by[3] == by[4] == ("0" * 16, 2) and by[None] == by[1] and by[1][1] == 1
    assert by[5][0] == f"{plain_simhash(LONG):016x}"
    kept = simhash.drop_near_duplicates(odd(spark))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 6, 7] and kept.columns == odd(spark).columns
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_a_group_keeps_one_row_without_ids_and_with_repeated_ids(spark):
    a, b, c = "alpha beta gamma delta " * 9, "one two three four five " * 9, "red green blue black white pink " * 9
    docs = spark.createDataFrame([(None, a, "x"), (None, a, "y"), (0, b, "z"), (7, b, "z"), (7, c, "u"), (7, c, "u"), (8, c, "v")], "doc_id long, text string, mark string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in simhash.drop_near_duplicates(docs).collect())
    assert got == [(False, 0, b), (False, 7, c), (True, 0, a)]
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


# rules
def plain_rules(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é#|\n \t", max_size=80))
def test_rule_measurements(text):
    assert rules.measure(text)[:5] == plain_rules(text)


def test_rules_of_long_texts_and_odd_rows(spark, monkeypatch):
    words = ("a b c d e f g h " * 20 + "x y z " * 9 + "once only here").encode().split()
    short = rules._repeated(words)
    monkeypatch.setattr(rules, "LONG", 0)
    assert rules._repeated(words) == short > 0
    book = rules.ledger(odd(spark))
    rows = {r["doc_id"]: r for r in book.collect()}
    assert book.count() == 9 and rows[2]["failed_bits"] == rows[3]["failed_bits"] == rules.BIT["few_words"] and rows[5]["n_words"] == 120_000
    kept = rules.keep_passing(odd(spark))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in book.where(rules.passes()).collect()} == {1, None} | ({7} if rows[7]["failed_bits"] == 0 else set())
    assert kept.columns == odd(spark).columns and rules.ledger(none(spark)).count() == 0


def test_ablations(spark):
    book = rules.with_bits(rules.ledger(odd(spark)).drop("failed_bits"))
    got = {r["rule"]: r for r in rules.ablations(book, "strict-1").collect()}
    bits = [r["failed_bits"] for r in book.collect()]
    for name, bit in rules.BIT.items():
        assert got[name]["n_failed"] == sum(bool(b & bit) for b in bits)
        assert got[name]["n_failed_alone"] == sum(b == bit for b in bits)
        assert got[name]["n_kept_without"] == sum(not b & ~bit for b in bits)


# classifier
def test_classifier_on_held_out_labels(spark):
    out = classifier.op2_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    m = out[out.held_out].merge(labels, on="doc_id")
    assert len(out) == 1000 and out.score.between(0, 1).all() and ((m.predicted == m.quality).mean()) > 0.95
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()


def test_classifier_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (6, 0), (7, 1), (None, 1), (4, 7), (3, None)], "doc_id long, quality int")
    model = classifier.learn(odd(spark), labels)
    assert classifier.scores(odd(spark), model).where("score between 0 and 1").count() == 9
    assert classifier.keep_good(odd(spark), labels).columns == odd(spark).columns
    only = classifier.learn(odd(spark), labels.where("quality = 1"))
    assert classifier.scores(odd(spark), only).select("score").distinct().count() == 1
    assert abs(classifier.scores(odd(spark), classifier.learn(odd(spark), labels.limit(0))).first()["score"] - 0.5) < 1e-12
    assert classifier.scores(none(spark), model).count() == 0


# packing
def test_best_fit_is_the_tightest():
    import random

    rng = random.Random(3)
    for window in (1, 2, 7, 64, 100):
        fit, open_ = packing.BestFit(window), {}
        for n in sorted((rng.randint(1, window) for _ in range(300)), reverse=True):
            sequence, offset = fit.place(n)
            free = [left for left in open_.values() if left >= n]
            before = open_.get(sequence, window)
            assert offset == window - before and (before == min(free) if free else sequence not in open_)
            open_[sequence] = before - n


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = ["a <|endoftext|>  b\r\n\n  c　 d " + "é" * 3000, "<|endoftext|>", "<|endoftext|> a", "a<|endoftext|>b", "a <|endoftext|><|endoftext|>  ", "<|endoftext|", "x\n<|endoftext|>\n y"]
    docs = odd(spark).union(spark.createDataFrame([(11 + k, x, *[None] * 9) for k, x in enumerate(special)], odd(spark).schema))
    got = packing.pack(docs).toPandas()
    for row in docs.distinct().where("doc_id is not null").collect():
        import numpy as np

        ids = np.array(t.encode(row["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == row["doc_id"]].drop_duplicates("start").sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all() and own.start.tolist() == list(range(0, len(ids), 1024))
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all() and got.groupby("sequence_id").length.sum().max() <= 1024
    assert (got.doc_id == 1).sum() == 2 and packing.pack(none(spark)).count() == 0
    fill = packing.fill(packing.pack(docs)).collect()
    assert all(r["padded"] == (r["ids"] if r["ids"].bit_count() == 1 else 1024) for r in fill)


# personal data
def plain_spans(t):
    def luhn(d):
        s = [int(x) for x in reversed(d)]
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(s)) % 10 == 0

    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    "a@b.c_d@e.f x@y.z.w,q@-.-", "1.2.3.4.5.6.7.8 001.2.3.255 1.2.3.256", "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111110", "+1 (212) 555-0100. +49 30 1234567890123 +1+2 3456789",
    "é@x.y 𝔘 mail: 𝔘.z@k.org", "@@@ a@ a@b +", "9" * 3000 + " " + "a" * 5000 + "@b", "x@y.zz" * 40, "mail@1.2.3.4 and " * 700,
]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TRICKY)] + [(99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digests(docs).collect()}
    for k, t in [*enumerate(TRICKY), (99, "")]:
        s = plain_spans(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(s).encode()).hexdigest(), t[:50]
        assert got[k]["spans"].startswith(",".join(s))
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(y.startswith(x) for y in s) for x in pii.KINDS]


def test_disclosing_terms(spark):
    docs = [(k, f"filler words everywhere {'common ' * 3}{'Zanzibar' if k % 10 == 0 else 'nothing'} met {'jo@x.org' if k % 10 == 0 else f'u{k}@x.org'} there") for k in range(200)]
    docs += [(1000 + k, "common filler words everywhere without any address " * 5) for k in range(50)]
    df = spark.createDataFrame([(k, t, len(t)) for k, t in docs], "doc_id long, text string, n_chars long")
    found = pii.find(df, ["doc_id"]).where(pii._any_found())
    got = {(r["entity"], r["term"]): (r["disclosure"], r["action"]) for r in pii.disclosures(found, df).collect()}
    words = Counter(w for _, t in docs for w in re.findall(r"[^\W\d_][^\W_]{3,}", t.lower()))
    n_c = 20
    for term in ("zanzibar", "there"):
        pmi = 1 + math.log2(min(1, 20 / words[term])) / math.log2(sum(words.values()) / n_c)
        assert ((("email:jo@x.org", term) in got) == (pmi >= pii.GENERALISE)), term
    assert got["email:jo@x.org", "zanzibar"] == (1.0, "remove")
    clean = {r["doc_id"]: r for r in pii.sanitize(df).collect()}
    assert "Zanzibar" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[1000]["text"] == docs[200][1] and len(clean) == 250 and "common" in clean[1]["text"]


def test_pii_of_odd_rows(spark):
    assert pii.digests(odd(spark)).count() == 9 and pii.digests(none(spark)).count() == 0
    out = pii.sanitize(odd(spark))
    assert out.columns == odd(spark).columns and sorted(map(str, out.collect())) == sorted(map(str, odd(spark).collect()))
    assert pii.sanitize(none(spark)).count() == 0
    more = spark.createDataFrame([(None, "write a@b.co"), (3, "a@b.co x"), (3, "a@b.co x")], "doc_id long, text string")
    assert sorted(r["text"] for r in pii.sanitize(more).collect()) == ["[EMAIL] x", "[EMAIL] x", "write [EMAIL]"]


# language model
def test_base_scores_and_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    texts = {r["doc_id"]: [*re.sub(b"[A-Z]", lambda m: m[0].lower(), r["text"].encode()).split(), b"\n"] for r in docs.collect()}
    crc = {d: zlib.crc32(str(d).encode()) for d in texts}
    train = Counter(w for d, ws in texts.items() if crc[d] % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    pairs = Counter((a, b) for d, ws in texts.items() if crc[d] % 5 != 1 for a, b in zip([b"^", *ws], ws))
    dev = Counter((a, b) for d, ws in texts.items() if crc[d] % 50 == 0 for a, b in zip([b"^", *ws], ws))
    dev1 = Counter(w for d, ws in texts.items() if crc[d] % 50 == 0 for w in ws)
    cells = Counter()
    for (a, b), k in dev.items():
        ctx = (train[b"\n"] - dev1[b"\n"]) if a == b"^" else train[a] - dev1[a]
        f2 = (pairs[a, b] - k) / ctx if ctx > 0 else 0
        f1 = (train[b] - dev1[b]) / (n - sum(dev1.values()))
        cell = lambda f: round(-lm.GRID * math.log2(f)) if f > 0 else -1
        cells[math.frexp(ctx)[1], cell(f2), cell(f1)] += k
    weights = lm.mixture([(*c, k) for c, k in cells.items()], v)
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    for d, ws in texts.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc[d] % 5 == 1, len(ws), sum(train[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        total = 0
        for a, b in zip([b"^", *ws], ws):
            ctx = train[b"\n"] if a == b"^" else train[a]
            w = weights[min(lm.LEVELS - 1, math.frexp(ctx)[1])]
            total += math.log10(w[0] * (pairs[a, b] / ctx if ctx else 0) + w[1] * train[b] / n + w[2] / (v + 1))
        assert math.isclose(r["score"], total, rel_tol=1e-4), d
    assert abs(weights.sum(1) - 1).max() < 1e-9


def test_lm_blocks_and_odd_rows(spark, monkeypatch):
    whole = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(odd(spark)).collect()}
    assert len(lm.score(odd(spark)).collect()) == 9 and whole[2, 1]["n_tokens"] == 1 and lm.score(none(spark)).count() == 0
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 3)
    for r in lm.score(odd(spark)).collect():
        assert math.isclose(r["score"], whole[r["doc_id"], r["n_tokens"]]["score"], rel_tol=1e-9)
    held = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 5 == 1)
    r = lm.score(spark.createDataFrame([(held, "no training text")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["base_score"], r["score"]) == (0, 0.0, 0.0)


# pieces
@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return pieces.Pieces(public_tokenizers.path(pieces.MODEL))


def all_paths(p, w):
    into = p.edges(w)

    def back(j):
        if j == 0:
            return [(0.0, ())]
        return [(s + e[1], ids + e[2]) for e in into[j] for s, ids in back(e[0])]

    return sorted(back(len(w)), key=lambda x: -x[0])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="▁theraing.é\n漢𝔘", min_size=1, max_size=9))
def test_astar_gives_the_best_paths(vocabulary, w):
    want = all_paths(vocabulary, w)
    got = pieces.search(vocabulary.edges(w), 5)
    assert [s for s, _ in got] == [s for s, _ in want[:5]] and len({ids for _, ids in got}) == len(got)
    ids, best, loss = vocabulary.best_and_loss(w)
    assert best == want[0][0] and sum(1 for s, x in want if x == ids and s == best) >= 1
    assert loss == (want[0][0] - want[1][0] if len(want) > 1 else float("inf"))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="the rain.é\n漢", max_size=14))
def test_encoding_of_whole_texts(vocabulary, text):
    import numpy as np

    encoder = pieces.Encoder(vocabulary, 4)
    ids, scores = encoder.encode(text)
    assert vocabulary.decode(np.frombuffer(ids, "<u4").tolist()) == text
    if text:
        whole = pieces.search(vocabulary.edges("▁" + text.replace(" ", "▁")), 4)  # the lattice that isn't cut into words
        assert np.allclose(scores, [s for s, _ in whole], rtol=1e-12)
        assert np.allclose(scores, [s for s, _ in encoder.nbest_ids(text)], rtol=1e-12)


def test_pieces_of_odd_rows(spark):
    got = pieces.encode(odd(spark)).collect()
    assert len(got) == 9 and all(r["round_trip"] and r["best_score"] >= r["second_score"] >= r["last_score"] for r in got)
    assert {r["n_pieces"] for r in got if r["doc_id"] in (2, 3)} == {0} and pieces.encode(none(spark)).count() == 0


# licences
def test_licences(spark):
    words = lambda t: re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = lambda t: set(zip(words(t), words(t)[1:]))
    texts = {1: "Intro line.\nReleased under the MIT license!\nmore", 2: licenses.TEMPLATES["MIT-full"].upper(), 3: "x\n\n" + licenses.TEMPLATES["ISC"].replace(" ", "\n") + "\n\ny", 4: "nothing here", 5: None,
             6: "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", 7: LONG + licenses.TEMPLATES["MIT"] + "\n" + licenses.TEMPLATES["MIT"]}
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for k, t in texts.items():
        t = t or ""
        segs = [t, *(t.split("\n\n") if "\n\n" in t else []), *(t.split("\n") if "\n" in t else [])]
        best, hits = (0, None), 0
        for s in segs:
            own = [(2 * len(grams(s) & grams(x)) / max(1, len(grams(s)) + len(grams(x))), name) for name, x in sorted(licenses.TEMPLATES.items())]
            top = max(own, key=lambda x: x[0])
            if top[0] >= licenses.THRESHOLD:
                hits += 1
                best = max(best, top, key=lambda x: x[0])
        assert (got[k]["n_hits"], got[k]["license"]) == (hits, best[1]), k
        assert got[k]["dice"] is None if not hits else math.isclose(got[k]["dice"], best[0])
    assert got[1]["license"] == "MIT" and got[2]["license"] == "MIT-full" and got[3]["license"] == "ISC" and got[7]["n_hits"] == 1
    assert licenses.scan_licenses(odd(spark)).count() == 9 and licenses.scan_licenses(none(spark)).count() == 0

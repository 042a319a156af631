import base64
import hashlib
import os
import zlib
from itertools import combinations

from sparkloom.llm import ann, packing, warc
from sparkloom.llm._common import scratch_path

SF = "/root/testdata/sf0.001"


def test_archives_round_trip(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, None), (8, "u8", ""), (1, "ü\r\nx", "<p>WARC/1.1\r\n\r\nWARC/1.1\r\n</p>"), (7, "u7", "é" * 3_000_000), (None, "n", "same"), (3, "again", "same"), (None, "alone", "once")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    path = scratch_path(spark, "test")
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        want = {r2[2] or "" for r2 in rows if f"urn:page:{'' if r2[0] is None else r2[0]}" == r["record_id"]}
        if r["record_type"] == "response":
            text = bytes(r["payload"]).decode()
            assert text in want and r["payload_bytes"] == len(text.encode())
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        else:
            assert r["payload"] is None and r["payload_bytes"] in {len(x.encode()) for x in want}
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds.count(("urn:page:3", "response", None)) == 2 and ("urn:page:5", "revisit", "urn:page:3") in kinds and ("urn:page:9", "revisit", "urn:page:8") in kinds
    assert ("urn:page:", "revisit", "urn:page:3") in kinds and ("urn:page:", "response", None) in kinds
    assert all(x.endswith(".warc.gz") for x in os.listdir(path) if not x.startswith(".")) and not [x for x in os.listdir(path) if x.endswith(".tmp")]


def test_pushdown_and_skipping(spark):
    path = scratch_path(spark, "test")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(pages.union(pages.selectExpr("page_id + 1000", "url", "html")), path)
    revisits = warc.read_archives(spark, path).where("record_type = 'revisit'")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert "= revisit" not in plan  # the source decides the predicate, Spark keeps none of it
    assert revisits.count() == pages.count()
    assert warc.read_archives(spark, path, payload=False).where("payload is not null").count() == 0
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"response"}, "target_uri": {"a", "b"}}


def test_plain_archives_and_min_bytes(spark, tmp_path):
    row = {"record_id": "r", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "D", "payload_bytes": 3, "payload": b"abc"}
    (tmp_path / "a.warc").write_bytes(warc.record(row) * 3)
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    (tmp_path / "b.warc.gz").write_bytes(pack.compress(warc.record(row)) + pack.flush())
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {bytes(r["payload"]) for r in got} == {b"abc"}
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    kinds = {r["record_id"]: r["record_type"] for r in warc.archive_records(df, min_bytes=3).collect()}
    assert kinds == {"urn:page:1": "response", "urn:page:2": "response", "urn:page:3": "response", "urn:page:4": "revisit"}
    empty = scratch_path(spark, "none")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 24))
    x = centres[rng.integers(0, 6, 900)] + 0.6 * rng.normal(size=(900, 24))
    x[100:400] = x[100]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [None] + [1.0] * 23), (2005, [float("inf")] * 24), (2006, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, label int")
    use = ann.usable(df)
    assert use.count() == 901
    got = ann.nearest(use, use.where("id % 50 = 0"), block_rows=256).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for _, i in sorted((d[i], i) for i in range(900) if i != q)][:10]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and g.score.is_monotonic_increasing and np.allclose(g.score, d[g.vec_id])
        if 100 <= q < 400:
            assert g.vec_id.tolist() == want
        hits, total = hits + len({*want} & {*g.vec_id}), total + 10
    assert hits / total >= 0.9
    few = ann.nearest(use.where("id < 4"), use.where("id = 0")).collect()
    assert len(few) == 3 and ann.nearest(use.where("false"), use.where("false")).count() == 0


def test_neighbours_recall_on_the_table(spark):
    import numpy as np

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding.to_numpy()).astype(float), e.vec_id.to_numpy()
    got = ann.op7_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len({*ids[np.argsort(d)[:10]]} & {*g.vec_id})
    assert hits / len(got) >= 0.9


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from sparkloom.llm import classifier, pii, rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = cp.STAGES[0][1](spark, docs, SF)
    good = {r["doc_id"] for r in classifier.scores(docs, classifier.learn(docs, labels)).where(f"score >= {classifier.CUT}").collect()}
    assert {r["doc_id"] for r in a.collect()} == good and a.columns == docs.columns
    b = cp.STAGES[1][1](spark, a, SF)
    assert {r["doc_id"] for r in b.collect()} == {r["doc_id"] for r in rules.ledger(a).where(rules.passes()).collect()} and b.columns == docs.columns
    c = cp.STAGES[2][1](spark, b, SF)
    words = {r["doc_id"]: r["text"].encode().lower().split() for r in b.collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    group = {k: k for k in sets}
    for x, y in combinations(sorted(sets), 2):  # five-word shingles with a Jaccard similarity of 0.8 or more, by brute force
        if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
            low, high = sorted((group[x], group[y]))
            group = {k: low if g == high else g for k, g in group.items()}
    assert {r["doc_id"] for r in c.collect()} == set(group.values()) and c.columns == docs.columns
    d = cp.STAGES[3][1](spark, c, SF)
    assert d.columns == docs.columns and d.count() == c.count()
    assert pii.digests(d).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    whole = cp.run(spark, SF)
    assert whole.agg({"length": "sum"}).first()[0] == packing.pack(d).agg({"length": "sum"}).first()[0]

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.metrics import METRICS
from vecloom.operators import ann, fusion, quantize, rerank, search, sparse, text
from vecloom.plans.registry import domain


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(20260620)
    return spark.createDataFrame([(i, [float(x) for x in rng.random(16) + 0.01 - 0.5], i % 3) for i in range(300)], "id long, vector array<double>, grp long").cache()


def query(df, i=7):
    return [float(x) for x in df.where(f"id = {i}").first()["vector"]]


@pytest.mark.parametrize("metric", [m for m in METRICS if m not in ("ip", "haversine", "hamming", "jaccard", "tanimoto", "dice")])
def test_self_search(vectors, metric):
    df = domain(vectors, metric)
    first = search.topk(df, query(df), 1, metric).first()
    assert first.id == 7 and abs(first.score) < 1e-7


def test_edges(vectors):
    q = query(vectors)
    assert search.topk(vectors, q, 0).count() == 0
    assert search.topk(vectors, q, 10_000).count() == 300
    assert {r.grp for r in search.topk(vectors, q, 20, where='"grp" = 1', fields=["grp"]).collect()} == {1}
    assert search.topk(vectors, q, 5, where="grp = 999").count() == 0
    with pytest.raises(KeyError):
        search.gather(vectors, [1, 5000])
    assert [r.id for r in search.gather(vectors, [5, 2, 9]).collect()] == [5, 2, 9]


def test_plan_is_native(vectors):
    plan = search.topk(vectors, query(vectors), 5, "l2")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_batches_in_blocks(vectors, monkeypatch):
    queries = vectors.where("id < 9").selectExpr("id as query_id", "vector as query")
    found = lambda: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in search.batch_topk(vectors, queries, 3).collect())
    one = found()
    monkeypatch.setattr(search, "QUERY_BYTES", 400)
    assert found() == one and len(one) == 27


@pytest.mark.parametrize("codec, floor", [("sq8", 0.95), ("pq8", 0.7), ("rabitq", 0.7), ("polarvec4", 0.7)])
def test_codec_recall(vectors, codec, floor):
    hit = 0
    for i in (3, 50):
        q = query(vectors, i)
        want = {r.id for r in search.topk(vectors, q, 10, "l2").collect()}
        got = quantize.sq8_two_pass(vectors, q, 10, "l2") if codec == "sq8" else quantize.two_pass(vectors, q, 10, "l2", codec)
        hit += len(want & {r.id for r in got.collect()})
    assert hit / 20 >= floor


def test_cells(vectors, spark, tmp_path):
    index = ann.Cells.build(vectors, str(tmp_path / "ivf"), "l2", 8)
    q = query(vectors)
    want = [r.id for r in search.topk(vectors, q, 10, "l2").collect()]
    assert [r.id for r in index.search(spark, q, 10, 8).collect()] == want
    assert len(set(want) & {r.id for r in index.search(spark, q, 10, 5).collect()}) >= 8
    allowed = vectors.where("grp = 2").select("id")
    assert all(r.id % 3 == 2 for r in index.search(spark, q, 10, 3, allowed).collect())
    assert index.search(spark, q, 10, 1, vectors.where("id < 3").select("id")).count() == 3
    again = ann.Cells.open(spark, index.path)
    assert [r.id for r in again.search(spark, q, 10, 8).collect()] == want
    again.remove(vectors.where(F.col("id") == want[0]).select("id"))
    again.insert(vectors.limit(1).select(F.lit(10**6).cast("long").alias("id"), F.array(*[F.lit(float(x)) for x in q]).alias("vector")))
    got = [r.id for r in ann.Cells.open(spark, index.path).search(spark, q, 10, 8).collect()]
    assert got[0] == 10**6 and want[0] not in got and sum(again.sizes) == vectors.count()
    assert index.search(spark, q, vectors.count() * 2, 1).count() == vectors.count()  # more cells are probed until there are enough rows


def test_pq_batch(vectors):
    pq = quantize.PQ.fit(vectors, 4)
    codes = pq.encode(vectors).cache()
    queries = [query(vectors, i) for i in (3, 50)]
    for metric in ("l2", "ip"):
        got = pq.batch_shortlist(codes, queries, 20, metric).collect()
        for n, q in enumerate(queries):
            want = [(r.id, round(r.score, 9)) for r in pq.shortlist(codes, q, 20, metric).collect()]
            assert sorted((r.id, round(r.score, 9)) for r in got if r.query == n) == sorted(want)


def test_batch_of_odd_vectors(spark):
    """Nulls, other lengths, NaN, ties and text ids: products give what pair expressions give."""
    rows = [("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [1.0, None]), ("g", [float("nan"), 1.0]), ("h", [3.0, -1.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [2.0]), (4, None)], "query_id int, query array<double>")
    for metric in ("ip", "l2", "cosine"):
        for k in (0, 2, 10):
            got = {(r.query_id, r.rank): (r.id, r.score) for r in search.batch_topk(df, queries, k, metric).collect()}
            want = {}
            for q in queries.where("query is not null").collect():
                for n, r in enumerate(search.topk(df, q.query, k, metric).collect()):
                    want[q.query_id, n + 1] = (r.id, r.score)
            assert got.keys() == want.keys() and all(got[x][0] == want[x][0] for x in want), (metric, k)
    assert search.batch_topk(df.limit(0), queries, 3).count() == 0


def test_approximate_scan(many):
    x = np.array([r.vector for r in many.orderBy("id").collect()])
    got = search.approx_topk(many, x[7].tolist(), 10, "l2", 0.01).collect()
    assert len({r.id for r in got} & set(nearest(x, 7))) >= 9 and all(abs(r.score / 0.01 - round(r.score / 0.01)) < 1e-6 for r in got)
    for bad in (("l2", 0.0), ("l2", -1.0), ("l2", float("nan")), ("hamming", 0.1)):
        with pytest.raises(ValueError):
            search.approx_topk(many, x[7].tolist(), 10, *bad)


def test_profile_and_unknown_ids(vectors):
    seen = search.profile(vectors, query(vectors), 5, "l2", "grp = 2")
    assert seen["rows"] == vectors.count() and seen["scored"] == vectors.where("grp = 2").count() and seen["results"] == 5 and "Scan" in seen["plan"]
    with pytest.raises(KeyError):
        search.query(vectors, filter_ids=vectors.limit(1).select(F.lit(-5).cast("long").alias("id")))


def test_half(vectors):
    got = quantize.half(vectors.select("id", "vector")).orderBy("id").first().vector
    assert np.allclose(got, np.asarray(vectors.orderBy("id").first().vector, np.float16), atol=0)
    near = [r.id for r in search.topk(quantize.half(vectors), query(vectors), 10, "l2").collect()]
    assert len(set(near) & {r.id for r in search.topk(vectors, query(vectors), 10, "l2").collect()}) >= 9


def test_stored_postings(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} {'rare' if i == 7 else 'common'}") for i in range(40)] + [(90, None), (91, "")], "id long, text string")
    index = text.TextIndex.build(docs.where("id < 30 or id > 80"), str(tmp_path / "text"))
    index.add(docs.where("id >= 30 and id < 80"))
    same = lambda a, b: [(r.id, round(r.score, 9)) for r in a.collect()] == [(r.id, round(r.score, 9)) for r in b.collect()]
    for seeding in ("all", "selective"):
        assert same(index.search("w1 rare w4 w4", 8, seeding=seeding), text.bm25(docs, "w1 rare w4 w4", 8, seeding=seeding))
    some = docs.where("id % 2 = 1")
    assert same(index.search("w1 common", 8, allowed=some.select("id")), text.bm25(some, "w1 common", 8))
    index.remove(docs.where("id = 7").select("id"))
    assert same(index.search("w1 rare", 8), text.bm25(docs.where("id <> 7"), "w1 rare", 8))
    assert index.search("nowhere").count() == 0 and index.search("", 3).count() == 0


def test_json_strings(spark):
    rows = [('{"a": "x y", "b": [1, "z", {"c": "w", "d": null}], "e": true}', "x y z w"), ('"just"', "just"), ("7", ""), ("no json", ""), (None, None)]
    df = spark.createDataFrame(rows, "j string, want string").select("want", text.json_text(F.col("j")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_sinks(spark, tmp_path):
    from vecloom.sources.sinks import Result, write_indexed

    df = spark.createDataFrame([(1, 0.5, "a"), (2, 0.25, "b")], "id long, score double, tag string")
    r = Result(df)
    assert r.to_list()[1] == {"id": 2, "score": 0.25, "tag": "b"} and r.to_dict()[1]["tag"] == "a"
    ids, scores, fields = r.to_tuple()
    assert ids.tolist() == [1, 2] and scores.tolist() == [0.5, 0.25] and fields == [{"tag": "a"}, {"tag": "b"}]
    assert len(r.to_pandas()) == r.to_arrow().num_rows == 2 and '"tag": "a"' in r.to_json() and len(Result(df.limit(0)).to_pandas()) == 0
    write_indexed(df, str(tmp_path / "laid"), ["id"], ["tag"])
    assert spark.read.parquet(str(tmp_path / "laid")).count() == 2


@pytest.fixture(scope="module")
def many(spark):
    """More rows than any codec's shortlist for ten (2000)."""
    x = np.random.default_rng(5).normal(size=(4000, 16))
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<double>").cache()


def nearest(x, i):
    return np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:10].tolist()


@pytest.mark.parametrize("replicas", [0, 1])
def test_default_probe_recall(many, spark, tmp_path, replicas):
    index = ann.Cells.build(many, str(tmp_path / "cells"), "l2", 16, replicas)
    x = np.array([r.vector for r in many.orderBy("id").collect()])
    cells = {}
    for r in ann.Cells.open(spark, index.path).rows(spark).select("id", "cell").collect():
        cells.setdefault(r.id, set()).add(r.cell)
    hits = []
    for i in range(0, len(x), 50):
        probed = set(index.probe(x[i]))
        hits.append([bool(cells[j] & probed) for j in nearest(x, i)])
    assert len(set(index.probe(x[0]))) < 16 and np.mean(hits) >= 0.9
    got = {r.id for r in index.search(spark, x[50].tolist(), 10).collect()}
    assert len(got & set(nearest(x, 50))) == sum(hits[1])


@pytest.mark.parametrize("codec", ["sq8", "pq8", "rabitq", "polarvec4"])
def test_codec_recall_beyond_shortlists(many, codec):
    x = np.array([r.vector for r in many.orderBy("id").collect()])
    hit = 0
    for i in (3, 50, 1700):
        got = quantize.sq8_two_pass(many, x[i].tolist(), 10, "l2") if codec == "sq8" else quantize.two_pass(many, x[i].tolist(), 10, "l2", codec)
        hit += len({r.id for r in got.collect()} & set(nearest(x, i)))
    assert hit / 30 >= 0.9


def test_modes():
    assert ann.parse_mode("hnsw-l2-sq8") == ann.Mode("HNSW", "l2", "sq8")
    assert ann.parse_mode("FLAT-IP-PQ16").codec == "pq16"
    for bad in ("FLAT", "FLAT-HELLINGER-SQ8", "HNSW-CANBERRA", "HNSW-BRAY-CURTIS", "TREE-IP", "IVF-IP-PQ"):
        with pytest.raises(ValueError):
            ann.parse_mode(bad)
    assert ann.build_options("IVF", {"nprobe": 3, "m": 16}) == {"nprobe": 3}
    with pytest.raises(ValueError):
        ann.build_options("IVF", {"speed": 1})


def test_text_and_hybrid(spark):
    docs = spark.createDataFrame([(10, "rust vector database"), (20, "python web framework"), (30, "hybrid vector search")], "id long, body string")
    got = text.bm25(docs, "vector database", 2, ["body"]).collect()
    assert got[0].id == 10 and got[0].score > 0
    axes = spark.createDataFrame([(10, [1.0, 0.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0, 0.0]), (30, [0.0, 0.0, 1.0, 0.0])], "id long, vector array<double>")
    legs = [(search.topk(axes, [0, 1, 0, 0], 6), 1.0, False), (text.bm25(docs, "vector", 6, ["body"]), 1.0, False)]
    assert {r.id for r in fusion.fuse(legs, 3).collect()} == {10, 20, 30}
    assert fusion.fuse(legs, 3, "weighted").count() == 3
    assert text.bm25(docs, "nowhere", 3, ["body"]).count() == 0
    assert text.bm25(docs.limit(0), "vector", 3, ["body"]).count() == 0


def test_sparse(spark):
    rows = [(10, 1, 1.0), (10, 5, 0.5), (20, 2, 2.0), (20, 5, 1.0), (30, 2, 0.5), (30, 7, 1.0), (30, 7, -1.0)]
    v = sparse.normalise(spark.createDataFrame(rows, "id long, idx int, val double"))
    assert v.where("id = 30").count() == 1
    assert [(r.id, r.score) for r in sparse.sparse_topk(v, {2: 1.0, 5: 2.0}, 3).collect()] == [(20, 4.0), (10, 1.0), (30, 0.5)]


def test_rerank_forms():
    items = [{"id": i, "score": 0.0, "field": {}} for i in (1, 2, 3)]
    n = lambda a: [i for i, _ in rerank.normalise(a, items, 3)]
    assert n(None) == [1, 2, 3] and n([3, 9, 3]) == [3, 1, 2] and n({2: 5.0, 1: 1.0}) == [2, 1, 3]
    assert n([0.1, 0.9, 0.5]) == [2, 3, 1] and n([(3, 1.0), (1, 2.0)]) == [1, 3, 2] and n(([1, 2, 3], [1.0, 3.0, 2.0])) == [2, 3, 1]
    assert n([{"id": 2, "score": 9}]) == [2, 1, 3]

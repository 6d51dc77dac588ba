import pytest

from pyspark.sql import functions as F

from vecloom.operators import search, text
from vecloom.sources.collection import Collection, ConflictError, Database, blob_range, embed_documents
from vecloom.streaming.upserts import stream_upserts, windowed_counts

SCHEMA = "id long, vector array<float>, tag string"


def rows(spark, ids, tag="a"):
    return spark.createDataFrame([(i, [float(i), 1.0], tag) for i in ids], SCHEMA)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_life_of_a_collection(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    c = db.create("things")
    assert c.add(rows(spark, range(6))) == 6
    with pytest.raises(ValueError):
        c.add(rows(spark, [3]))
    with pytest.raises(ValueError):
        c.add(spark.createDataFrame([(9, [1.0], "x")], SCHEMA))
    c.delete(rows(spark, [1, 2, 77]).select("id"))
    assert ids(c.deleted()) == [1, 2] and ids(c.live()) == [0, 3, 4, 5]
    assert ids(c.query("id < 3")) == [0, 1, 2]  # deleted rows still show in plain queries
    assert ids(c.search([1.0, 0.0], 10)) == [0, 3, 4, 5]
    c.upsert(spark.createDataFrame([(2, [9.0, 9.0]), (8, [8.0, 8.0])], "id long, vector array<float>"))
    assert ids(c.deleted()) == [1]
    got = {r.id: (r.tag, r.vector[0]) for r in c.records().collect()}
    assert got[2] == ("a", 9.0) and got[8] == (None, 8.0)
    c.restore(rows(spark, [1]).select("id"))
    assert c.deleted().count() == 0
    c.delete(rows(spark, [0]).select("id"))
    c.snapshot_to(f"file://{tmp_path}/db/copy")
    assert c.compact() == 1 and ids(c.records()) == [1, 2, 3, 4, 5, 8]
    assert ids(db.open("copy").deleted()) == [0]
    c.add_vectors("title", rows(spark, [1, 2]))
    with pytest.raises(ValueError):
        c.add_vectors("title", rows(spark, [2]))
    c.export_to(f"file://{tmp_path}/out")
    other = db.create("other")
    assert other.import_from(f"file://{tmp_path}/out") == 6
    assert db.list() == ["copy", "other", "things"]
    db.drop("copy")
    assert db.list() == ["other", "things"]
    with pytest.raises(ValueError):
        db.create("../x")


def test_versions(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}/c")
    with pytest.raises(ValueError):
        Collection.create(spark, f"file://{tmp_path}/c")
    m = c.manifest
    c.add(rows(spark, [1]))
    with pytest.raises(ConflictError):
        c._commit(m, next=7)  # a writer that started from an older version
    assert ids(c.records()) == [1] and c.manifest["version"] == 1
    c.upsert(rows(spark, [1, 2], "b"))
    assert c.manifest["version"] == 2  # one version, so that no reader sees half of it


def test_session_and_records(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}/c")
    with c.session() as s:
        s.add(rows(spark, [0, 1]))
        s.add_records([2, 3], [[5.0, 1.0], [6.0, 1.0]], [{"tag": "x"}, {"tag": "y"}])
        assert not c.manifest["records"]
    assert ids(c.records()) == [0, 1, 2, 3] and c.manifest["version"] == 1
    with pytest.raises(ZeroDivisionError):
        with c.session() as s:
            s.add(rows(spark, [9]))
            1 / 0
    assert not c.exists(9) and c.exists(3)
    assert c.add_records([[1.0, 2.0]], fields=[{"tag": "z"}]) == [4]
    assert c.add_records(documents=["ab"], embed=lambda ts: [[len(t), 0.0] for t in ts]) == [5]
    import pyarrow as pa

    assert c.add_arrow(pa.table({"id": [8], "vector": [[0.5, 0.5]], "tag": ["arrow"]})) == 1
    for bad in ({"vectors": [[1.0, 1.0]], "ids": [True]}, {"vectors": [[1.0, 1.0]], "ids": [-1]}, {"vectors": [[1.0, 1.0]], "ids": [1, 2]}, {"documents": ["x"]}):
        with pytest.raises(ValueError):
            c.add_records(**bad)
    assert c.stats()["rows"] == 7 and c.stats()["max_id"] == 8 and c.list_fields() == ["document", "tag"]
    assert [r.id for r in c.head(2).collect()] == [0, 1] and [r.id for r in c.read([3, 0]).collect()] == [3, 0]
    c.update(spark.createDataFrame([(1, "new")], "id long, tag string"))
    assert c.query("id = 1").first().tag == "new"
    with pytest.raises(KeyError):
        c.update(spark.createDataFrame([(77, "new")], "id long, tag string"))


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    c = Collection.create(spark, f"file://{tmp_path_factory.mktemp('full')}/c")
    data = [(i, [float(i % 7), float(i % 5), 1.0], f"word{i % 4} {'even' if i % 2 == 0 else 'odd'}", i % 3) for i in range(60)]
    c.add(spark.createDataFrame(data, "id long, vector array<float>, body string, grp long"))
    c.add_vectors("title", c.records().select("id", F.reverse("vector").alias("vector")))
    c.add_sparse(spark.createDataFrame([(i, j, float(i + j)) for i in range(20) for j in range(3)], "id long, idx int, val double"))
    c.delete(c.records().where("id % 10 = 0").select("id"))
    return c


def test_searches_leave_deleted_rows_out(full, spark):
    q, live = [1.0, 2.0, 1.0], full.live()
    same = lambda a, b: [(r.id, r.score) for r in a.collect()] == [(r.id, r.score) for r in b.collect()]
    assert same(full.search(q, 8, "l2"), search.topk(live, q, 8, "l2"))
    assert same(full.search(q, 8, "l2", field="title"), search.topk(live.drop("vector").join(full.vectors("title"), "id"), q, 8, "l2"))
    assert same(full.search_range(q, 9.0, "l2", 50, "grp = 1"), search.range_search(live, q, 9.0, "l2", 50, "grp = 1"))
    assert full.search_range(q, 1e9).count() == 54
    queries = spark.createDataFrame([(1, q), (2, [0.0, 0.0, 1.0])], "query_id int, query array<double>")
    got = full.batch_search(queries, 5, "ip", "grp <> 2").collect()
    assert len(got) == 10 and all(r.id % 10 and r.id % 3 != 2 for r in got)
    assert same(full.bm25_search("word1 even", 6), text.bm25(live, "word1 even", 6, ["body"]))
    assert all(r.id % 10 for r in full.sparse_search({0: 1.0, 2: 2.0}, 50).collect())
    got = full.hybrid_search(q, "word1", {1: 1.0}, 5, fields=["grp"], how="weighted")
    assert got.count() == 5 and got.columns == ["id", "score", "grp"]
    with pytest.raises(ValueError):
        full.hybrid_search(k=3)
    with pytest.raises(ValueError):
        full.hybrid_search(q, k=9, candidates=3)
    back = full.search(q, 4, "l2", fields=["grp"], reranker=lambda x: [(i["id"], i["field"]["grp"]) for i in x["items"]]).collect()
    assert [r.grp for r in back] == sorted((r.grp for r in back), reverse=True)
    assert full.search(q, 5, "l2", approx=True, eps=0.5).count() == 5


def test_stored_index(full, spark, tmp_path):
    full.snapshot_to(f"file://{tmp_path}/copy")
    c = Collection(spark, f"file://{tmp_path}/copy")
    q = [1.5, 2.25, 1.0]
    scan = [r.id for r in c.search(q, 5, "l2", use_index=False).collect()]
    c.build_index("IVF-L2", n_cells=4)
    used = c.search(q, 5, "l2", nprobe=4)
    assert [r.id for r in used.collect()] == scan and "index-" in used._jdf.queryExecution().toString()
    c.add(spark.createDataFrame([(500, q, "new", 1)], "id long, vector array<float>, body string, grp long"))
    stale = c.search(q, 1, "l2")
    assert stale.first().id == 500 and "index-" not in stale._jdf.queryExecution().toString()  # an index that lacks rows isn't used
    c.sync_index()
    fresh = c.search(q, 1, "l2", nprobe=4)
    assert fresh.first().id == 500 and "index-" in fresh._jdf.queryExecution().toString()
    c.build_index("SPANN-L2", "title", n_cells=4)
    assert len(c.manifest["indexes"]) == 2
    c.delete(c.records().where("id = 500").select("id"))
    assert c.search(q, 1, "l2", nprobe=4).first().id != 500
    before = c.vectors("title").count()
    assert c.compact() == 7 and c.vectors("title").count() == before - 6 and c.manifest["indexes"] == {}
    c.remove_index("title")
    c.add(spark.createDataFrame([(10, q, "again", 1)], "id long, vector array<float>, body string, grp long"))
    assert c.vectors("title").where("id = 10").count() == 0
    c.update_vectors("title", c.vectors("title").where("id = 1").select("id", F.array(*[F.lit(9.0).cast("float")] * 3).alias("vector")))
    assert c.vectors("title").where("id = 1").first().vector == [9.0] * 3
    c.drop_vectors("title")
    assert not c.manifest["vectors"]
    again = Collection.restore_from(spark, c.path, f"file://{tmp_path}/restored")
    assert ids(again.records()) == ids(c.records())


def test_blobs(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    c = db.create("b")
    c.put_blob("k", b"abcdef")
    c.put_blob("k", b"ghijkl")
    c.put_blob("l", b"")
    assert c.blob("k") == b"ghijkl" and c.blob("k", 2, 3) == b"ijk" and c.blob("l") == b""
    c.delete_blob("k")
    with pytest.raises(KeyError):
        c.blob("k")
    with pytest.raises(KeyError):
        c.delete_blob("k")
    db.snapshot_to(f"file://{tmp_path}/snap")
    assert Database.restore_from(spark, f"file://{tmp_path}/snap", f"file://{tmp_path}/db2").open("b").blob("l") == b""


def test_blob_and_embedding(spark):
    blobs = spark.createDataFrame([("k", bytearray(b"abcdef"))], "key string, value binary")
    assert bytes(blob_range(blobs, "k", 2, 3).first().value) == b"cde"
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert [r.vector for r in embed_documents(docs, lambda ts: [[float(len(t)), 1.0] for t in ts]).orderBy("id").collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_streams(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}/c")
    data = spark.createDataFrame([(1, [1.0, 0.0], "old", 1), (1, [2.0, 0.0], "new", 2), (2, [3.0, 0.0], "x", 1)], SCHEMA + ", ts long")
    data.write.parquet(str(tmp_path / "in"))
    stream_upserts(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), c, f"file://{tmp_path}/cp").awaitTermination(120)
    assert {r.id: r.tag for r in c.records().collect()} == {1: "new", 2: "x"}
    ev = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id*20,0) as ts, 'a' as event_type from range(6)")
    assert sorted(r.n for r in windowed_counts(ev).collect()) == [3, 3]

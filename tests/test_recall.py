import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecloom.operators import ann, quantize, search
from vecloom.plans import registry


@pytest.fixture(scope="module")
def table(spark):
    """400 vectors, the last hundred copies of the first, under text ids."""
    x = np.random.default_rng(9).normal(size=(300, 16))
    x = np.concatenate([x, x[:100]])
    return spark.createDataFrame([(f"n{i:03}", v) for i, v in enumerate(x.tolist())], "id string, vector array<double>").cache()


def asked(table):
    return table.where("id in ('n003', 'n050', 'n120')").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


@pytest.mark.parametrize("codec", ["sq8", "pq4", "rabitq", "polarvec4"])
def test_coarse_ranks(table, codec, monkeypatch):
    """Counted places are those in the sorted scores of single queries, ties by id."""
    monkeypatch.setattr(search, "TILE_ROWS", 64)
    monkeypatch.setattr(quantize, "TILE_QUERIES", 2)
    coarse, queries = quantize.Coarse.fit(table, codec), asked(table)
    for metric in ("l2", "ip"):
        pairs = search.batch_topk(table, queries, 5, metric).select("query_id", "id")
        got = {(r.query_id, r.id): r.before for r in quantize.coarse_ranks(table, queries, pairs, coarse, metric).collect()}
        assert len(got) == 15
        for q in queries.collect():
            scored = quantize.coarse_scores(table, coarse, q.query, metric, "id", "vector").orderBy(*search.ordered(metric)).collect()
            place = {r.id: n for n, r in enumerate(scored)}
            assert all(place[i] == n for (a, i), n in got.items() if a == q.query_id), (metric, q.query_id)


@pytest.mark.parametrize("replicas", [0, 1])
def test_reached_is_what_searches_find(table, spark, tmp_path, replicas):
    index = ann.Cells.build(table, str(tmp_path / "cells"), "l2", 8, replicas)
    queries = asked(table)
    exact = search.batch_topk(table, queries, 10, "l2").select("query_id", "id")
    got = {(r.query_id, r.id) for r in index.reached(spark, exact, queries, 10, 2).where("hit").collect()}
    want = {(q.query_id, r.id) for q in queries.collect() for r in index.search(spark, q.query, 10, 2).collect()} & {tuple(r) for r in exact.collect()}
    assert got == want and 0 < len(got)


@pytest.mark.parametrize("name", sorted(registry.FLOORS))
def test_plans_do_not_grow_with_queries(spark, name):
    """Ten queries are one scan of their own, not one each."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4


def test_batch_in_tiles(table, monkeypatch):
    """Near vectors far from the origin: the matrix product alone can't tell them apart."""
    far = table.select("id", F.transform("vector", lambda v: v * 1e-3 + 1e4).alias("vector"))
    monkeypatch.setattr(search, "TILE_ROWS", 64)
    monkeypatch.setattr(search, "TILE_QUERIES", 2)
    for metric in ("l2", "ip", "cosine"):
        for df in (table, far) if metric == "l2" else (table,):
            got = {(r.query_id, r["rank"]): r.id for r in search.batch_topk(df, asked(df), 7, metric).collect()}
            for q in asked(df).collect():
                assert [got[q.query_id, n + 1] for n in range(7)] == [r.id for r in search.topk(df, q.query, 7, metric).collect()], metric


def test_shortlists_grow_with_rows(spark):
    """A shortlist of 320 holds too few of the nearest ten among 30,000 rows; longer ones are cut by score."""
    x = np.random.default_rng(3).normal(size=(30_000, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<double>").repartition(8).cache()
    queries = df.where("id % 600 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    pairs = search.batch_topk(df, queries, 10, "l2").select("query_id", "id")
    before = [r.before for r in quantize.coarse_ranks(df, queries, pairs, quantize.Coarse.fit(df, "pq4"), "l2").collect()]
    assert len(before) == 500 and np.mean(np.array(before) < 320) < 0.9 <= np.mean(np.array(before) < quantize.width("pq4", 10, 30_000))


def test_long_shortlists(table, monkeypatch):
    monkeypatch.setattr(quantize, "NARROW", 10)
    for metric in ("l2", "ip"):
        q = asked(table).first().query
        got = [r.id for r in quantize.two_pass(table, q, 10, metric, "polarvec4").collect()]
        assert len(set(got) & {r.id for r in search.topk(table, q, 10, metric).collect()}) >= 9


def test_middles(spark):
    """The value at place n // 2, though values lie close, are alike, skewed, null or not finite."""
    rng = np.random.default_rng(1)
    n = 5000
    rows = np.stack([rng.normal(size=n) * 1e-9 + 1, np.repeat([-1.0, 3.0], n // 2), np.exp(rng.normal(size=n) * 200), np.where(rng.random(n) < 0.6, np.nan, 1.0), np.where(rng.random(n) < 0.5, -0.0, 0.0)], 1)
    data = [(i, v) for i, v in enumerate(rows.tolist())] + [(n, None), (n + 1, [None] * 5)]
    df = spark.createDataFrame(data, "id long, vector array<double>")
    lo, hi = quantize.bounds(df)
    want = np.sort(rows, 0)[n // 2]
    for few in (0, 3000):
        assert np.array_equal(quantize.middles(df, lo, hi, few=few, bins=16), want, equal_nan=True)


def test_binary_thresholds_of_many_rows(spark):
    """An approximate percentile is off from some ten thousand rows on."""
    x = np.random.default_rng(2).normal(size=(250_000, 2)).astype(np.float32)
    at = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1]}))
    df = at.select(F.array("a", "b").alias("vector"))
    assert quantize.binary_thresholds(df, 2) == np.sort(x, 0)[125_000].astype(float).tolist()

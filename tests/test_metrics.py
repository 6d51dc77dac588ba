import math

import pytest
from pyspark.sql import functions as F

from vecloom.functions import metrics as M

R2 = math.sqrt(math.log(2))
GOLDEN = [
    ("manhattan", [1, 2, 3], [3, 0, 4], 5.0), ("pearson", [1, 2, 3], [2, 4, 6], 0.0), ("hellinger", [1, 0], [0, 1], 1.0), ("wasserstein", [1, 0, 0], [0, 0, 1], 2.0),
    ("dice", [1, 1, 0], [1, 0, 1], 0.5), ("tanimoto", [1, 1, 0], [1, 0, 1], 2 / 3), ("jensen_shannon", [1, 0], [0, 1], R2), ("chebyshev", [1, 2, 3], [4, 0, 3], 3.0),
    ("canberra", [1, 0, 3], [2, 0, 1], 5 / 6), ("bray_curtis", [1, 2], [2, 4], 1 / 3), ("ip", [1, 2], [3, 4], 11.0), ("l2", [1, 2], [3, 4], 8.0), ("hamming", [1, 0, 1], [0, 0, 1], 1.0),
    # Edges: zero vectors, constants, no mass, invalid mass, wrong dimension.
    ("cosine", [0, 0], [1, 1], 1.0), ("cosine", [1, 0], [1, 0], 0.0), ("jaccard", [0, 0], [0, 0], 0.0), ("dice", [0, 0], [0, 0], 0.0), ("pearson", [1, 1], [1, 1], 0.0), ("pearson", [1, 1], [2, 2], 1.0),
    ("hellinger", [0, 0], [0, 0], 0.0), ("hellinger", [0, 0], [1, 0], 1.0), ("hellinger", [-1, 2], [1, 0], math.inf), ("wasserstein", [0, 0], [0, 0], 0.0), ("wasserstein", [0, 0], [1, 0], math.inf),
    ("jensen_shannon", [0, 0], [1, 0], R2), ("jensen_shannon", [0, 0], [0, 0], 0.0), ("bray_curtis", [0, 0], [0, 0], 0.0), ("bray_curtis", [1, -1], [-1, 1], math.inf), ("haversine", [1, 2, 3], [1, 2, 3], math.inf),
    ("haversine", [0, 91], [0, 0], math.inf), ("canberra", [0, 0], [0, 0], 0.0),
]


def test_goldens(spark):
    row = spark.range(1).select(*[M.distance(m, M.vector(a), M.vector(b)).alias(f"c{i}") for i, (m, a, b, _) in enumerate(GOLDEN)]).first()
    for (m, a, b, want), got in zip(GOLDEN, row):
        assert got == pytest.approx(want, abs=1e-9), (m, a, b)


def test_haversine(spark):
    d = spark.range(1).select(M.distance("geo", M.vector([121.4737, 31.2304]), M.vector([116.4074, 39.9042]))).first()[0]
    assert abs(d - 1_067_000) < 10_000


def test_packed_hamming_is_hamming(spark):
    df = spark.range(50).select(F.array(*[(F.rand(i) - 0.5) for i in range(70)]).alias("a"), F.array(*[(F.rand(100 + i) - 0.5) for i in range(70)]).alias("b"))
    bits = lambda c: F.transform(c, lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    both = df.select(M.packed_hamming(M.pack_bits(F.col("a"), 70, 0.0), M.pack_bits(F.col("b"), 70, 0.0)).alias("p"), M.distance("hamming", bits("a"), bits("b")).alias("h"))
    assert both.where("p <> h").count() == 0


def test_unknown_metric():
    with pytest.raises(ValueError):
        M.resolve("nearest")


def test_numpy_and_sql_function_agree_with_expressions(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    pairs = [(rng.random(6), rng.random(6)) for _ in range(5)] + [(np.zeros(6), np.zeros(6)), (np.zeros(6), rng.random(6)), (np.ones(6), np.ones(6)), (-rng.random(6), rng.random(6))]
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in pairs], "a array<double>, b array<double>")
    M.register(spark)
    df.createOrReplaceTempView("pairs_of_vectors")
    for metric in M.METRICS:
        if metric == "haversine":
            continue
        rows = df.select("a", "b", M.distance(metric, F.col("a"), F.col("b")).alias("d")).collect()
        for r in rows:
            want = M.compute_distance(r.a, r.b, metric)
            assert r.d == want or abs(r.d - want) < 1e-7, (metric, r)
        sql = spark.sql(f"select compute_distance(a, b, '{metric}') as d from pairs_of_vectors").collect()
        assert all(s.d == r.d or abs(s.d - r.d) < 1e-7 for s, r in zip(sql, rows))
    with pytest.raises(ValueError):
        M.compute_distance([1.0], [1.0, 2.0])


def test_packed_and_bytes(spark):
    df = spark.createDataFrame([([1, 0], [3, 4], [255, 1], [0, 3]), ([0, 0], [0, 0], [0, 0], [0, 0])], "a array<long>, b array<long>, x array<int>, y array<int>")
    got = df.select(M.packed_jaccard(F.col("a"), F.col("b")).alias("j"), M.packed_dice(F.col("a"), F.col("b")).alias("d"), M.hamming_bytes(F.col("x"), F.col("y")).alias("h")).collect()
    assert abs(got[0].j - 2 / 3) < 1e-12 and abs(got[0].d - 0.5) < 1e-12 and got[0].h == 9 and (got[1].j, got[1].d, got[1].h) == (0.0, 0.0, 0)

"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become integers (floor of scale * component), so scores are exact. Candidates are cut into blocks
by descending length (bands of length quantiles, each salted to bounded blocks), queries into blocks by
hash. The longest block gives each query a first threshold: its k-th best score there. A pair of blocks
is then visited only if some query of one can still reach its threshold against the longest vector of
the other, |q| * max|c|; the threshold table decides that before any vector is copied. Inside a pair both sides are
rotated by the SVD basis of all vectors, so that the first coordinates carry most of the length: the partial product over
them plus |q_rest| * |c_rest| bounds the score, and only pairs above the threshold get an exact one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Rows of a candidate block, rows of a query block, length bands.
BLOCK_ROWS, QUERY_ROWS, BANDS = 8192, 4096, 32


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """id, row (a number of its own), v array<bigint>, norm: of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(finite)
    return (
        rows.select(F.col(vec_id).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    )


def matrix(column, dim: int) -> np.ndarray:
    """int64 rows; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def svd_basis(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal directions, the strongest first, from the dim x dim second moments of all rows."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            m = matrix(pdf["v"], dim).astype(float)
            total += m.T @ m
        i, j = np.indices((dim, dim))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    cells = vectors.select("v").mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    gram = np.zeros((dim, dim))
    for r in cells.collect():  # dim * dim cells
        gram[r.i, r.j] = r.s
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def pair_topk(q_rows, q, q_least, c_ids, c_rows, c, basis, k, head):
    """Rows (query's row, candidate, score): every candidate of the block that may be among a query's k best."""
    dim = q.shape[1]
    norms = np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.argsort(-norms, kind="stable")
    c, c_ids, c_rows, norms = c[order], c_ids[order], c_rows[order], norms[order]
    qf, cf = q.astype(float), c.astype(float)
    qr, cr = qf @ basis, cf @ basis
    qn = np.sqrt((qf**2).sum(1))
    q_rest, c_rest = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((cr[:, head:] ** 2).sum(1))
    big = float(qn.max(initial=0) * norms.max(initial=0))
    slack = 1e-9 * (big + 1)  # for the rotation's rounding
    exact_floats = big < 2**52
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        least = q_least[i]
        # Lengths descend, so those that can reach the threshold come first.
        reach = len(c) if least < 0 or not np.isfinite(least) else int(np.searchsorted(-norms * qn[i], -(least - slack), "right"))
        at = np.arange(reach)
        if np.isfinite(least) and head < dim:
            at = np.flatnonzero(cr[:reach, :head] @ qr[i, :head] + q_rest[i] * c_rest[:reach] >= least - slack)
        scores = (cf[at] @ qf[i]).astype(np.int64) if exact_floats else (c[at] * q[i]).sum(1)
        keep = (scores >= least) & (c_rows[at] != q_rows[i])
        at, scores = at[keep], scores[keep]
        if len(at) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= kth
            at, scores = at[near], scores[near]
        top = best(c_ids[at], scores, k)
        out_q.append(np.full(len(top), q_rows[i]))
        out_c.append(c_ids[at][top])
        out_s.append(scores[top])
    if not out_q:
        return np.zeros((3, 0), np.int64)
    return np.stack([np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)])


def exact_topk(vectors: DataFrame, k: int = 5, query_every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query with all other rows.

    Queries are the rows whose id is divisible by query_every. Ties go to the smaller id. Vectors that are
    null or hold null or non-finite components, and rows without an id, take no part. Rows that share an id are
    rows of their own, as queries and as candidates: only the query's own row is left out. A shorter vector counts as filled up with zeros; scores are
    64-bit integers. Columns other than the id and the vector are not read.
    """
    spark = vectors.sparkSession
    rows = stored(integer_vectors(vectors, vec_id, vector, scale), "topk-rows")
    is_query = F.pmod(F.col("id"), F.lit(query_every)) == 0
    about = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 10000).alias("cuts")
    ).first()
    if not about.n or not about.q:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim = max(1, about.dim)
    basis = svd_basis(rows, dim)
    head = max(1, dim // 4)
    # Bands by descending length; a band of more rows than a block is salted.
    bands = min(BANDS, max(1, -(-about.n // BLOCK_ROWS)))
    cuts = [about.cuts[BANDS * i // bands - 1] for i in range(1, bands)][::-1]
    band = sum((F.when(F.col("norm") < c, 1).otherwise(0) for c in cuts), F.lit(0))
    per_band = rows.groupBy(band.alias("band")).count().collect()  # BANDS rows at most
    salts = {r.band: max(1, round(r["count"] / BLOCK_ROWS)) for r in per_band}
    salt_of = F.element_at(F.create_map(*[F.lit(x) for b in sorted(salts) for x in (b, salts[b])]), F.col("band"))
    blocks = stored(rows.withColumn("band", band).withColumn("salt", F.pmod(F.xxhash64("row"), salt_of.cast("bigint")).cast("int")), "topk-blocks")
    q_blocks = max(1, -(-about.q // QUERY_ROWS))
    asked = blocks.where(is_query).select(F.col("id").alias("qid"), F.col("row").alias("qrow"), F.col("v").alias("qv"), F.col("norm").alias("qnorm"), F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int").alias("qb"))

    def visit(pairs: DataFrame, queries: DataFrame, every: bool) -> DataFrame:
        """Rows of the given block pairs (qb, band, salt)."""
        left = queries.join(pairs, "qb")
        left = left.select(*(F.col(c).alias(f"a_{c}" if c in ("qb", "band", "salt") else c) for c in left.columns))
        right = blocks.join(pairs, ["band", "salt"])
        schema = "qrow bigint, vec_id bigint, score bigint"

        def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"qrow": [], "vec_id": [], "score": []}).astype("int64")
            least = np.full(len(a), -np.inf) if every else a["least"].to_numpy(float)
            got = pair_topk(a["qrow"].to_numpy(), matrix(a["qv"], dim), least, b["id"].to_numpy(), b["row"].to_numpy(), matrix(b["v"], dim), basis, k, head)
            return pd.DataFrame({"qrow": got[0], "vec_id": got[1], "score": got[2]})

        return left.groupBy("a_qb", "a_band", "a_salt").cogroup(right.groupBy("qb", "band", "salt")).applyInPandas(run, schema)

    query_parts = spark.range(q_blocks).select(F.col("id").cast("int").alias("qb"))
    first_band = min(salts)
    # The first block: the longest vectors. Its k-th best score of a query is what later blocks have to reach.
    seed = visit(query_parts.select("qb", F.lit(first_band).alias("band"), F.lit(0).alias("salt")), asked, True)
    least = seed.groupBy("qrow").agg(F.sort_array(F.collect_list("score"), False).alias("s")).where(F.size("s") >= k).select("qrow", F.element_at("s", k).cast("double").alias("least"))
    asked = stored(asked.join(least, "qrow", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "topk-asked")
    # Block pairs that can matter: |q| * max|c| >= least for some query.
    need = asked.groupBy("qb").agg(F.min(F.when(F.col("least") <= 0, 0.0).otherwise(F.col("least") / F.col("qnorm"))).alias("need"))
    longest = blocks.groupBy("band", "salt").agg(F.max("norm").alias("longest"))
    pairs = need.join(F.broadcast(longest) if sum(salts.values()) < 100_000 else longest, F.col("longest") * (1 + 1e-9) >= F.col("need")).select("qb", "band", "salt")
    found = visit(pairs, asked, False)
    w = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(asked.select("qrow", F.col("qid").alias("query_id")), "qrow").select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

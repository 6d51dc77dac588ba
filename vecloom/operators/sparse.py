"""Sparse vectors in long form (id, idx, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise(long: DataFrame, id_: str = "id") -> DataFrame:
    """Equal indices summed, zeros dropped; negative indices and non-finite values are errors."""
    checked = long.select(
        F.col(id_),
        F.when(F.col("idx") < 0, F.raise_error(F.lit("a sparse index is negative")).cast("int")).otherwise(F.col("idx").cast("int")).alias("idx"),
        F.when(F.isnan("val") | (F.abs("val") == float("inf")), F.raise_error(F.lit("a sparse value isn't finite")).cast("double")).otherwise(F.col("val").cast("double")).alias("val"),
    )
    return checked.groupBy(id_, "idx").agg(F.sum("val").alias("val")).where("val <> 0")


def sparse_topk(vectors: DataFrame, query: dict[int, float], k: int = 10, allowed: DataFrame | None = None, deleted: DataFrame | None = None, id_: str = "id") -> DataFrame:
    """id, score by inner product, largest first; a score of 0 is no match, negative ones are kept."""
    spark = vectors.sparkSession
    q = spark.createDataFrame([(int(i), float(v)) for i, v in query.items()], "idx int, q double")
    rows = vectors
    if allowed is not None:
        rows = rows.join(allowed.select(id_).distinct(), id_, "left_semi")
    if deleted is not None:
        rows = rows.join(deleted.select(id_).distinct(), id_, "left_anti")
    scored = rows.join(F.broadcast(q), "idx").groupBy(id_).agg(F.sum(F.col("q") * F.col("val")).alias("score"))
    return scored.where("score <> 0").orderBy(F.round("score", 9).desc(), id_).limit(k)

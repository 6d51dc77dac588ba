"""Hybrid fusion of scored legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised(leg: DataFrame, ascending: bool) -> DataFrame:
    """Scores from 0 to 1, the nearest at 1; a leg of one score is all 1. Non-finite scores count as 0."""
    ok = ~F.isnan("score") & (F.abs("score") < float("inf"))
    w = Window.partitionBy()
    lo, hi = F.min(F.when(ok, F.col("score"))).over(w), F.max(F.when(ok, F.col("score"))).over(w)
    part = (F.col("score") - lo) / (hi - lo)
    value = F.when(~ok, 0.0).when(hi - lo <= 1.1920929e-07, 1.0).otherwise(F.least(F.greatest(1.0 - part if ascending else part, F.lit(0.0)), F.lit(1.0)))
    return leg.withColumn("score", value)  # a leg has as many rows as candidates, so one task holds it


def fuse(legs: list[tuple[DataFrame, float, bool]], k: int, how: str = "rrf", rrf_k: float = 60.0, id_: str = "id") -> DataFrame:
    """id, score. legs: (id and score, weight, whether smaller is nearer). Any way but "weighted" is rank fusion."""
    parts = []
    for leg, weight, ascending in legs:
        if how == "weighted":
            parts.append(normalised(leg, ascending).select(id_, (F.col("score") * max(weight, 0.0)).alias("part")))
        else:
            s = F.round("score", 9)
            w = Window.orderBy(s.asc() if ascending else s.desc(), id_)
            parts.append(leg.select(id_, (F.lit(float(weight)) / (max(rrf_k, 1.0) + F.row_number().over(w))).alias("part")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(id_).agg(F.sum("part").alias("score")).orderBy(F.round("score", 9).desc(), id_).limit(k)

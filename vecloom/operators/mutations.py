"""Changes to record tables as latest-wins DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, id_: str, seq: str) -> DataFrame:
    """The newest row of each id."""
    best = df.groupBy(id_).agg(F.max_by(F.struct(*[c for c in df.columns if c != id_]), seq).alias("_r"))
    return best.select(id_, "_r.*").select(df.columns)


def upsert(base: DataFrame, change: DataFrame, id_: str = "id") -> DataFrame:
    """Rows of change replace those of base; columns that change doesn't have keep their values. Ids are unique in change."""
    b, c = base.alias("b"), change.alias("c")
    hit = F.col(f"c.{id_}").isNotNull()
    columns = [F.coalesce(F.col(f"c.{id_}"), F.col(f"b.{id_}")).alias(id_)]
    columns += [(F.when(hit, F.col(f"c.{x}")).otherwise(F.col(f"b.{x}")) if x in change.columns else F.col(f"b.{x}")).alias(x) for x in base.columns if x != id_]
    return b.join(c, F.col(f"b.{id_}") == F.col(f"c.{id_}"), "full_outer").select(columns)


def update(base: DataFrame, change: DataFrame, id_: str = "id") -> DataFrame:
    missing = change.join(base.select(id_), id_, "left_anti").count()
    if missing:
        raise KeyError(f"{missing} ids to update don't exist")
    return upsert(base, change, id_)


def delete(deleted: DataFrame, ids: DataFrame, base: DataFrame, id_: str = "id") -> DataFrame:
    """Soft delete: the set of deleted ids grows by those that exist."""
    return deleted.select(id_).union(ids.select(id_).join(base.select(id_), id_, "left_semi")).distinct()


def restore(deleted: DataFrame, ids: DataFrame, id_: str = "id") -> DataFrame:
    return deleted.join(ids.select(id_), id_, "left_anti")


def compact(base: DataFrame, deleted: DataFrame, id_: str = "id") -> DataFrame:
    return base.join(deleted.select(id_), id_, "left_anti")

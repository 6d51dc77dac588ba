"""Partitioned indexes: cells are partition directories, probing is partition pruning. Index mode strings."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ALIASES, resolve
from .quantize import _sample, kmeans, two_pass
from .search import ordered, topk

FAMILIES = ("FLAT", "HNSW", "IVF", "SPANN", "DISKANN")
BINARY = {"hamming", "jaccard", "tanimoto", "dice"}
#: Metrics of the exact scan alone: their geometry fits no cell routing by squared distance or quantiser.
DOMAIN = {"haversine", "correlation", "hellinger", "wasserstein", "jensen_shannon", "canberra", "bray_curtis"}
OPTIONS = {"IVF": {"n_cells", "nprobe"}, "SPANN": {"n_cells", "nprobe", "replicas"}, "HNSW": {"m", "ef_construction", "ef_search"}, "DISKANN": {"r", "l", "alpha"}, "FLAT": set()}


#: Share of an index's cells that is probed if the caller doesn't say: recall of ten is at least 0.9 then (README).
PROBED = 0.75


@dataclass(frozen=True)
class Mode:
    family: str
    metric: str
    codec: str | None


def parse_mode(text: str) -> Mode:
    """FAMILY-METRIC[-CODEC], in any case; a family alone, unknown parts and unfit combinations are errors."""
    parts = text.upper().split("-")
    if len(parts) < 2 or parts[0] not in FAMILIES:
        raise ValueError(f"unknown index mode {text!r}")
    family, codec = parts[0], None
    rest = parts[1:]
    if len(rest) > 1 and re.fullmatch(r"SQ8|BINARY|NONE|PQ\d*|RABITQ|POLARVEC[1-8]?", rest[-1]):
        codec, rest = rest[-1].lower(), rest[:-1]
    name = "_".join(rest).lower()
    if name not in ALIASES:
        raise ValueError(f"unknown metric in index mode {text!r}")
    metric = resolve(name)
    codec = None if codec == "none" else codec
    if codec and codec.startswith(("pq", "rabitq", "polarvec")) and family not in ("FLAT",):
        raise ValueError(f"{codec} belongs to FLAT")
    if metric in DOMAIN and (family != "FLAT" or codec):
        raise ValueError(f"{metric} needs an exact scan")
    return Mode(family, metric, codec)


def build_options(family: str, options: dict) -> dict:
    """Options of a family; those of other families are ignored, unknown ones are errors."""
    known = set().union(*OPTIONS.values())
    if bad := set(options) - known:
        raise ValueError(f"unknown index options {sorted(bad)}")
    return {k: v for k, v in options.items() if k in OPTIONS[family]}


@dataclass
class Cells:
    """An index: centroids, and rows in a table partitioned by cell. replicas > 1 puts a row into further near cells.

    Centroids, metric and rows a cell lie beside the table in index.json, so that an index is opened by its path.
    """

    path: str
    centroids: np.ndarray
    metric: str
    id_: str
    vec: str
    replicas: int
    sizes: list[int]

    @classmethod
    def build(cls, df: DataFrame, path: str, metric: str = "l2", n_cells: int = 16, replicas: int = 0, id_: str = "id", vec: str = "vector") -> Cells:
        """Centroids are fitted on a bounded sample, every row is indexed."""
        spark = df.sparkSession
        c = kmeans(_sample(df, id_, vec), n_cells) if not df.isEmpty() else np.zeros((1, 0))
        index = cls(path, c, resolve(metric), id_, vec, replicas, [])
        index._assigned(df).write.partitionBy("cell").parquet(f"{path}/rows")
        index._count(spark)
        return index

    @classmethod
    def open(cls, spark, path: str) -> Cells:
        about = json.loads(spark.read.text(f"{path}/index.json", wholetext=True).first()[0])
        return cls(path, np.array(about.pop("centroids")), **about)

    def _count(self, spark) -> None:
        rows = {r.cell: r["count"] for r in self.rows(spark).groupBy("cell").count().collect()}  # a row a cell
        self.sizes = [rows.get(i, 0) for i in range(len(self.centroids))]
        about = {"centroids": self.centroids.tolist(), "metric": self.metric, "id_": self.id_, "vec": self.vec, "replicas": self.replicas, "sizes": self.sizes}
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/index.json")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()

    def _assigned(self, df: DataFrame) -> DataFrame:
        c, replicas = self.centroids, self.replicas

        @F.pandas_udf("array<int>")
        def cells(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), float)
            d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
            order = np.argsort(d, axis=1, kind="stable")[:, : replicas + 1]
            out = []
            for row, o in zip(d, order):
                first = row[o[0]]
                out.append(np.array([j for n, j in enumerate(o) if n == 0 or row[j] <= first + 0.35 * abs(first)], np.int32))
            return pd.Series(out)

        return df.select(self.id_, self.vec, F.explode(cells(F.col(self.vec))).alias("cell"))

    def rows(self, spark) -> DataFrame:
        """All rows with their cell, less the removed ones."""
        out = spark.read.parquet(f"{self.path}/rows")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/removed")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            out = out.join(spark.read.parquet(f"{self.path}/removed").distinct(), self.id_, "left_anti")
        return out

    def insert(self, df: DataFrame) -> None:
        """Appends rows of new ids to their cells."""
        self._assigned(df).write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        self._count(df.sparkSession)

    def remove(self, ids: DataFrame) -> None:
        """Leaves ids out from now on; an id that was removed comes back by building the index anew."""
        ids.select(self.id_).distinct().write.mode("append").parquet(f"{self.path}/removed")
        self._count(ids.sparkSession)

    def probe(self, query, nprobe: int | None = None, least: int = 1) -> list[int]:
        """The nprobe nearest cells, and as many more as it takes until they hold `least` rows."""
        if nprobe is None:
            nprobe = math.ceil(PROBED * len(self.centroids))
        q = np.asarray(query, float)
        d = ((self.centroids - q) ** 2).sum(1) if self.metric != "ip" else -(self.centroids @ q)
        order = np.argsort(d, kind="stable").tolist()
        held = np.cumsum([self.sizes[i] for i in order])
        return order[: max(nprobe, 1 + int(np.searchsorted(held, least)))]

    def search(self, spark, query, k: int = 10, nprobe: int | None = None, allowed: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
        """The k nearest rows of the probed cells, of which there are enough for k rows; with a filter all cells are read."""
        rows = self.rows(spark)
        if allowed is None and deleted is None:
            rows = rows.where(F.col("cell").isin(self.probe(query, nprobe, k * (self.replicas + 1))))
        for ids, how in ((allowed, "left_semi"), (deleted, "left_anti")):
            if ids is not None:
                rows = rows.join(ids.select(self.id_).distinct(), self.id_, how)
        # A row is in replicas + 1 cells at most, so the k best are among so many rows; repeats are dropped from those alone.
        best = topk(rows, query, k * (self.replicas + 1), self.metric, id_=self.id_, vec=self.vec)
        return best if not self.replicas else best.groupBy(self.id_).agg(F.first("score").alias("score")).orderBy(*ordered(self.metric, id_=self.id_)).limit(k)

    def reached(self, spark, pairs: DataFrame, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
        """query_id, id, hit: of each pair of a query (query_id, query) and a row, whether the row lies in a cell that the query's search for k reads.

        A search gives the best of what it reads, so it finds one of the true k best if and only if it's read."""
        probe, least = self.probe, k * (self.replicas + 1)

        @F.pandas_udf("array<int>")
        def cells(q: pd.Series) -> pd.Series:
            return q.map(lambda x: np.array(probe(x, nprobe, least), np.int32))

        probed = queries.select("query_id", cells("query").alias("_cells"))
        placed = pairs.select("query_id", self.id_).join(self.rows(spark).select(self.id_, "cell"), self.id_, "left").join(probed, "query_id")
        return placed.groupBy("query_id", self.id_).agg(F.max(F.coalesce(F.array_contains("_cells", F.col("cell")), F.lit(False))).alias("hit"))


def search_mode(df: DataFrame, mode: str, query, k: int, path: str | None = None, id_: str = "id", vec: str = "vector", **options) -> DataFrame:
    """Search by a mode string. Graph families have no graph walk here: they scan all cells of an index, so their answer is exact."""
    m = parse_mode(mode)
    opts = build_options(m.family, options)
    if m.family == "FLAT" or m.metric in BINARY:
        if m.codec == "sq8":
            from .quantize import sq8_two_pass

            return sq8_two_pass(df, query, k, m.metric, id_, vec)
        if m.codec and m.codec != "binary":
            return two_pass(df, query, k, m.metric, m.codec, id_, vec)
        return topk(df, query, k, m.metric, id_=id_, vec=vec)
    if path is None:
        raise ValueError("an index needs a path in shared storage")
    return searched(build_mode(df, mode, path, id_, vec, **options), df.sparkSession, mode, query, k, **options)


def build_mode(df: DataFrame, mode: str, path: str, id_: str = "id", vec: str = "vector", **options) -> Cells:
    """The stored index of a mode that has one."""
    m, opts = parse_mode(mode), build_options(parse_mode(mode).family, options)
    return Cells.build(df, path, m.metric, opts.get("n_cells", 16), opts.get("replicas", 1 if m.family == "SPANN" else 0), id_, vec)


def searched(index: Cells, spark, mode: str, query, k: int, allowed: DataFrame | None = None, deleted: DataFrame | None = None, **options) -> DataFrame:
    m, opts = parse_mode(mode), build_options(parse_mode(mode).family, options)
    return index.search(spark, query, k, opts.get("nprobe") if m.family in ("IVF", "SPANN") else len(index.centroids), allowed, deleted)

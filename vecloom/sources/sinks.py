"""What a search found, in the driver's memory: for results of top-k size."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame


class Result:
    """Collects once; ids and scores first, other columns as fields."""

    def __init__(self, found: DataFrame, id_: str = "id", score: str = "score"):
        self.id_, self.score = id_, score
        self.columns = found.columns
        self.rows = found.collect()

    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.rows]

    def to_dict(self) -> dict:
        """{id: {column: value}} in the result's order."""
        return {r[self.id_]: {k: v for k, v in r.asDict(recursive=True).items() if k != self.id_} for r in self.rows}

    def to_numpy(self) -> tuple[np.ndarray, np.ndarray]:
        ids = [r[self.id_] for r in self.rows]
        return np.array(ids, np.int64 if all(isinstance(i, int) for i in ids) else object), np.array([r[self.score] for r in self.rows], np.float64)

    def to_tuple(self) -> tuple[np.ndarray, np.ndarray, list[dict]]:
        """ids, scores, fields."""
        return (*self.to_numpy(), [{k: v for k, v in d.items() if k not in (self.id_, self.score)} for d in self.to_list()])

    def to_json(self) -> str:
        return json.dumps(self.to_list(), default=str)

    def to_pandas(self):
        import pandas as pd

        return pd.DataFrame(self.to_list(), columns=self.columns)

    def to_arrow(self):
        import pyarrow as pa

        return pa.Table.from_pylist(self.to_list()) if self.rows else pa.table({c: [] for c in self.columns})

    def to_polars(self):
        import polars  # optional

        return polars.from_arrow(self.to_arrow())


def write_indexed(df: DataFrame, path: str, sort_by: list[str], bloom: list[str] = ()) -> None:
    """Parquet laid out for filters: range-partitioned and sorted by some fields, so that row groups have narrow ranges, with bloom filters for others."""
    out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by).write
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)

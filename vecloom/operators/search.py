"""Exact search: top-k, batches of queries, ranges, merges, rescoring."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.metrics import ascending, distance, resolve, vector
from ..plans.where import apply_where
from ..sources.shipping import spread

#: Bytes of query vectors that are broadcast at once; larger query sets go in blocks.
QUERY_BYTES = 8 << 20


def ordered(metric: str, score: str = "score", id_: str = "id") -> list[Column]:
    """Nearest first; ties (to nine places) by id; NaN and null last."""
    s = F.round(F.when(F.isnan(score), None).otherwise(F.col(score)), 9)
    return [s.asc_nulls_last() if ascending(metric) else s.desc_nulls_last(), F.col(id_).asc()]


def without(df: DataFrame, deleted: DataFrame | None, id_: str) -> DataFrame:
    return df if deleted is None else df.join(deleted.select(id_).distinct(), id_, "left_anti")


def topk(df: DataFrame, query, k: int = 10, metric: str = "ip", where: str | None = None, deleted: DataFrame | None = None, filter_ids: DataFrame | None = None, id_: str = "id", vec: str = "vector", fields: list[str] | None = None) -> DataFrame:
    """The k nearest rows: id, score and fields, nearest first. k of 0 gives none, k beyond the rows all of them.

    Filters stay below the score, so they reach the scan; fields are joined to the k rows afterwards.
    """
    rows = without(apply_where(df, where), deleted, id_)
    if filter_ids is not None:
        rows = rows.join(filter_ids.select(id_).distinct(), id_, "left_semi")
    scored = rows.select(F.col(id_), distance(metric, F.col(vec), vector(query)).alias("score")).where("score is not null")
    best = scored.orderBy(*ordered(metric, id_=id_)).limit(max(0, k))
    if fields:
        best = best.join(df.select(id_, *fields), id_).orderBy(*ordered(metric, id_=id_))
    return best


def range_search(df: DataFrame, query, threshold: float, metric: str = "l2", max_results: int = 1000, where: str | None = None, deleted: DataFrame | None = None, id_: str = "id", vec: str = "vector") -> DataFrame:
    """Live rows within the threshold (at least it, for the inner product), nearest first, max_results at most."""
    rows = without(apply_where(df, where), deleted, id_)
    scored = rows.select(F.col(id_), distance(metric, F.col(vec), vector(query)).alias("score"))
    inside = F.col("score") <= threshold if ascending(metric) else F.col("score") >= threshold
    return scored.where(inside & ~F.isnan("score")).orderBy(*ordered(metric, id_=id_)).limit(max(0, max_results))


def query_blocks(queries: DataFrame, query_id: str = "query_id", query_vec: str = "query") -> list[DataFrame]:
    """The queries in parts of about QUERY_BYTES of vectors, at least one."""
    size = queries.agg(F.coalesce(F.sum(F.size(query_vec).cast("bigint") * 8), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // QUERY_BYTES))
    return [queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) for b in range(blocks)]


def batch_topk(df: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", where: str | None = None, deleted: DataFrame | None = None, id_: str = "id", vec: str = "vector", query_id: str = "query_id", query_vec: str = "query") -> DataFrame:
    """query_id, rank, id, score: the k nearest live rows of each query.

    Queries go in blocks of QUERY_BYTES, each against all rows. For inner product, squared distance and cosine a task multiplies its
    rows by a block's queries, a batch at a time, and gives only its own k best of each query; other metrics are expressions over pairs with
    the broadcast queries.
    """
    rows = without(apply_where(df, where), deleted, id_).select(F.col(id_), F.col(vec))
    w = Window.partitionBy(query_id).orderBy(*ordered(metric, id_=id_))
    out = None
    for part in query_blocks(queries.select(F.col(query_id), F.col(query_vec).alias("_q")), query_id, "_q"):
        if resolve(metric) in PRODUCTS:
            scored = products(rows, part, max(0, k), resolve(metric), id_, vec, query_id)
        else:
            scored = rows.crossJoin(F.broadcast(part)).select(query_id, id_, distance(metric, F.col(vec), F.col("_q")).alias("score")).where("score is not null")
        best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, "rank", id_, "score")
        out = best if out is None else out.union(best)
    return out


PRODUCTS = {"ip", "l2", "cosine"}
#: Rows and queries of a matrix product.
TILE_ROWS, TILE_QUERIES = 4096, 256


def whole_vectors(batch: pa.RecordBatch, dim: int):
    """The rows of a batch of (id, vector) whose vectors have so many components, none of them null, TILE_ROWS at a time: ids, matrix."""
    column = batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    for lo in range(0, batch.num_rows, TILE_ROWS):
        at = lo + np.flatnonzero(sizes[lo : lo + TILE_ROWS] == dim)
        if not len(at):
            continue
        flat = column.take(pa.array(at)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
        if flat.null_count:
            ok = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), dim).any(1)
            at, x = at[ok], x[ok]
        ids = batch.column(0).take(pa.array(at))
        if len(at):
            yield ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) and not ids.null_count else np.array(ids.to_pylist(), object), x


def whole_queries(queries: DataFrame, query_id: str, query_vec: str) -> dict[int, tuple[list, np.ndarray]]:
    """By dimension the ids and the matrix of a block of queries, without those that are null or hold nulls."""
    by_dim: dict[int, tuple[list, list]] = {}
    for r in queries.select(F.col(query_id).alias("i"), F.col(query_vec).alias("v")).collect():  # a block of QUERY_BYTES
        if r.v is not None and None not in r.v:
            names, vecs = by_dim.setdefault(len(r.v), ([], []))
            names.append(r.i)
            vecs.append(np.array(r.v, np.float64))
    return {dim: (names, np.array(vecs).reshape(len(names), dim)) for dim, (names, vecs) in by_dim.items()}


def slack(dim: int, a: np.ndarray, b: np.ndarray) -> float:
    """More than scores by a matrix product can be off, places beyond the ninth included; a, b: squared lengths."""
    size = float(np.max(a, initial=0) + np.max(b, initial=0))
    return 2e-9 + 1e-15 * (dim + 8) * size if np.isfinite(size) else np.inf


def products(rows: DataFrame, queries: DataFrame, k: int, metric: str, id_: str, vec: str, query_id: str) -> DataFrame:
    """query_id, id, score: of each task's rows the k best of each query; rows of another length than a query's score nothing.

    Matrix products of TILE_ROWS x TILE_QUERIES, whose expanded squares lose digits of near vectors, only leave out what can't be among
    the k best so far; the rest is scored pair by pair."""
    asked = whole_queries(queries, query_id, "_q")
    sign = 1.0 if ascending(metric) else -1.0

    def coarse(q, qq, x, xx):
        s = q @ x.T
        if metric == "l2":
            return qq[:, None] + xx - 2 * s
        if metric == "cosine":
            d = np.sqrt(qq[:, None] * xx)
            return np.where(d < 1e-30, 1.0, 1.0 - s / np.maximum(d, 1e-300))
        return -s

    def exact(q, x):
        if metric == "l2":
            return ((x - q) ** 2).sum(1)
        s = (q * x).sum(1)
        if metric == "cosine":
            d = np.sqrt((q**2).sum(1) * (x**2).sum(1))
            s = np.where(d < 1e-30, 1.0, 1.0 - s / np.maximum(d, 1e-300))
        return s

    def best(held):
        """Of arrays of (query, rank, score, id) the k best of each query, by query."""
        q, rank, score, ids = (np.concatenate([h[c] for h in held]) for c in range(4))
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(rank[order], kind="stable")]
        order = order[np.argsort(q[order], kind="stable")]
        q = q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
        order = order[keep]
        return q[keep], rank[order], score[order], ids[order]

    def run(batches):
        held = {}  # by dimension and block of queries: (query, rank, score, id) of the k best so far, and the rank of the k-th
        for batch in batches if k else ():
            for dim, (names, vecs) in asked.items():
                for ids, x in whole_vectors(batch, dim):
                    xx = (x**2).sum(1)
                    for lo in range(0, len(names), TILE_QUERIES):
                        q = vecs[lo : lo + TILE_QUERIES]
                        qq = (q**2).sum(1)
                        with np.errstate(all="ignore"):
                            s = coarse(q, qq, x, xx)
                            off = slack(dim, qq, xx) if metric != "cosine" else 2e-9 + 1e-15 * (dim + 8)
                            old, limit = held.get((dim, lo), (None, np.full(len(q), np.inf)))
                            if len(x) > k and np.isinf(limit).any():
                                limit = np.minimum(limit, np.partition(np.where(np.isnan(s), np.inf, s), k - 1, axis=1)[:, k - 1] + off)
                            at, row = np.nonzero(~(s > (limit + off)[:, None]))
                            found = [] if old is None else [old]
                            for i in range(0, len(at), 65_536):
                                score = exact(q[at[i : i + 65_536]], x[row[i : i + 65_536]])
                                rank = np.where(np.isnan(score), np.inf, sign * np.round(score, 9))
                                found.append((at[i : i + 65_536], rank, score, ids[row[i : i + 65_536]]))
                        if not found:
                            continue
                        now = best(found)
                        last = np.flatnonzero(np.r_[now[0][1:] != now[0][:-1], True]) if len(now[0]) else np.zeros(0, int)
                        full = np.bincount(now[0], minlength=len(q))[now[0][last]] >= k
                        limit = np.full(len(q), np.inf)
                        limit[now[0][last][full]] = now[1][last][full]
                        held[dim, lo] = now, limit
        for (dim, lo), ((at, _, score, ids), _) in held.items():
            names = asked[dim][0][lo : lo + TILE_QUERIES]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at.tolist()], q_type), pa.array(ids.tolist(), id_type), pa.array(score, pa.float64())], [query_id, id_, "score"])

    types = [rows.schema[id_].dataType, queries.schema[query_id].dataType]
    id_type, q_type = (to_arrow_type(t) for t in types)
    return spread(rows).mapInArrow(run, f"`{query_id}` {types[1].simpleString()}, `{id_}` {types[0].simpleString()}, score double")


def merge_topk(parts: list[DataFrame], k: int, metric: str = "ip", id_: str = "id") -> DataFrame:
    """Merges scored parts: an id counts once, with its best score."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.min("score") if ascending(metric) else F.max("score")
    return every.groupBy(id_).agg(best.alias("score")).orderBy(*ordered(metric, id_=id_)).limit(k)


def rescore(candidates: DataFrame, df: DataFrame, query, k: int, metric: str, id_: str = "id", vec: str = "vector") -> DataFrame:
    """The exact k best of a shortlist."""
    return topk(df.join(F.broadcast(candidates.select(id_).distinct()), id_, "left_semi"), query, k, metric, id_=id_, vec=vec)


#: Metrics that the approximate scan knows.
APPROXIMATE = {"ip", "l2", "cosine", "l1", "chebyshev", "canberra", "bray_curtis"}


def checked_eps(metric: str, eps: float) -> float:
    if resolve(metric) not in APPROXIMATE:
        raise ValueError(f"{metric} has no approximate scan")
    if not eps > 0 or eps == float("inf"):
        raise ValueError("eps must be positive and finite")
    return float(eps)


def approx_rounded(df: DataFrame, query, k: int, metric: str, eps: float = 1e-4, **kw) -> DataFrame:
    """Top-k whose scores are rounded to multiples of eps after ranking."""
    return topk(df, query, k, metric, **kw).withColumn("score", F.round(F.col("score") / checked_eps(metric, eps)) * eps)


def approx_topk(df: DataFrame, query, k: int, metric: str, eps: float = 1e-4, every: int | None = None, wide: int = 20, id_: str = "id", vec: str = "vector", where: str | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """A shortlist of wide * k rows (200 at least) by one in `every` dimensions, then the exact k best, their scores rounded to multiples of eps.

    By default every other dimension is read of 32 or more, and all of fewer, of which a part would tell too little."""
    checked_eps(metric, eps)
    every = every or (2 if len(query) >= 32 else 1)
    rows = without(apply_where(df, where), deleted, id_)
    keep = list(range(0, len(query), every))
    few = rows.select(F.col(id_), F.filter(vec, lambda x, i: i % every == 0).alias(vec))
    short = topk(few, [query[i] for i in keep], max(wide * k, 200), metric, id_=id_, vec=vec)
    return rescore(short, rows, query, k, metric, id_, vec).withColumn("score", F.round(F.col("score") / eps) * eps)


def profile(df: DataFrame, query, k: int = 10, metric: str = "ip", where: str | None = None, deleted: DataFrame | None = None, id_: str = "id", vec: str = "vector") -> dict:
    """Runs a search and tells rows in the table, rows scored after filter and deletions, results, seconds and the physical plan."""
    from pyspark.sql import Observation

    seen = Observation("profile")
    live = without(apply_where(df, where), deleted, id_).observe(seen, F.count(F.lit(1)).alias("scored"))
    out = topk(live, query, k, metric, id_=id_, vec=vec)
    began = time.perf_counter()
    rows = out.collect()  # k rows
    took = time.perf_counter() - began
    return {"rows": df.count(), "scored": seen.get["scored"], "results": len(rows), "seconds": took, "plan": out._jdf.queryExecution().explainString(out.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))}


def gather(df: DataFrame, ids: list, id_: str = "id") -> DataFrame:
    """Rows of the given ids in their order; an unknown id is an error."""
    order = df.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{id_} {df.schema[id_].dataType.simpleString()}, _at int")
    found = df.join(F.broadcast(order), id_)
    missing = order.join(found.select(id_).distinct(), id_, "left_anti").count()
    if missing:
        raise KeyError(f"{missing} unknown ids")
    return found.orderBy("_at").drop("_at")


def head(df: DataFrame, n: int, seq: str) -> DataFrame:
    return df.orderBy(seq).limit(n)


def tail(df: DataFrame, n: int, seq: str) -> DataFrame:
    return df.orderBy(F.desc(seq)).limit(n).orderBy(seq)


def query(df: DataFrame, where: str | None = None, filter_ids: DataFrame | None = None, id_: str = "id") -> DataFrame:
    """Rows by filter, else by ids (an unknown one is an error), else none."""
    if where is not None:
        return apply_where(df, where)
    if filter_ids is None:
        return df.limit(0)
    ids = filter_ids.select(id_).distinct()
    if missing := ids.join(df.select(id_), id_, "left_anti").count():
        raise KeyError(f"{missing} unknown ids")
    return df.join(ids, id_, "left_semi")

"""Vector codecs: SQ8 and binary as Column expressions, PQ, RaBitQ and PolarVec with numpy in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.metrics import ascending, resolve, vector
from ..sources.shipping import spread
from .search import TILE_QUERIES, ordered, rescore, slack, topk, whole_queries, whole_vectors

#: Rows that codebooks are fitted on, at most; every row is encoded.
SAMPLE_ROWS = 50_000
#: Share of all rows that a shortlist by codes of about a bit a dimension has at least: the more rows, the more lie between a near one and its code.
SHORT = 0.02
#: Rows up to which a shortlist is cut to its very length and broadcast.
NARROW = 100_000


def width(codec: str, k: int, rows: int) -> int:
    """Rows of a codec's shortlist for the k best."""
    name = codec.lower()
    if name == "sq8":
        return max(20 * k, 200)
    few, share = (32, SHORT) if name.startswith("pq") else (200, SHORT) if name == "rabitq" else (20, SHORT if int(name.removeprefix("polarvec") or 4) < 4 else 0)
    return max(few * k, int(np.ceil(share * rows)))


def bounds(df: DataFrame, vec: str = "vector") -> tuple[list[float], list[float]]:
    """Minimum and maximum of each dimension."""
    rows = df.select(F.posexplode(vec)).groupBy("pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).orderBy("pos").collect()  # one row a dimension
    return [float(r.lo) for r in rows], [float(r.hi) for r in rows]


def sq8_encode(vec: Column, lo: list[float], hi: list[float], rounding: bool = False) -> Column:
    """array<int> of 0..255: truncated against (max - min) / 255, or, as the flat codec has it, rounded."""
    low = vector(lo)
    scale = vector([(h - x) / 255 if h > x else 1.0 for x, h in zip(lo, hi)])
    steps = F.zip_with(F.zip_with(vec, low, lambda x, m: x.cast("double") - m), scale, lambda d, s: d / s)
    return F.transform(steps, lambda x: F.least(F.greatest(F.round(x, 0) if rounding else F.floor(x), F.lit(0)), F.lit(255)).cast("int"))


def sq8_decode(codes: Column, lo: list[float], hi: list[float]) -> Column:
    scale = vector([(h - x) / 255 if h > x else 1.0 for x, h in zip(lo, hi)])
    return F.zip_with(F.zip_with(codes, scale, lambda c, s: c * s), vector(lo), lambda x, m: x + m)


def sq8_two_pass(df: DataFrame, query, k: int, metric: str = "ip", id_: str = "id", vec: str = "vector") -> DataFrame:
    """A shortlist by decoded codes (20 k rows, 200 at least; for cosine 100 k, 500), then the exact k best."""
    lo, hi = bounds(df, vec)
    coarse = df.select(F.col(id_), sq8_decode(sq8_encode(F.col(vec), lo, hi, True), lo, hi).alias("_c"))
    wide = max(100 * k, 500) if resolve(metric) == "cosine" else width("sq8", k, 0)
    return rescore(topk(coarse, query, wide, metric, id_=id_, vec="_c"), df, query, k, metric, id_, vec)


def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the values: both zeros are one, NaN is the largest."""
    b = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return (b ^ ((b >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def _value(key: int) -> float:
    b = np.array([key], np.uint64) ^ np.uint64(1 << 63)
    b = b.view(np.int64)
    return float((b ^ ((b >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def middles(df: DataFrame, lo: list[float], hi: list[float], vec: str = "vector", bins: int = 1024, few: int = 100_000) -> list[float]:
    """For each dimension the value at place n // 2 of its n values in ascending order, exactly; lo and hi are its bounds.

    Tasks count values by bins, and the bin that holds the place is cut into bins in turn until all dimensions' bins hold few values or one value each."""
    dim = len(lo)
    rows = spread(df.select(F.array(*[F.get(vec, F.lit(i)).cast("double") for i in range(dim)]).alias("v")))
    low, high = ([int(x) for x in _keys(np.array(v, np.float64))] for v in (lo, hi))
    below, place, inside = [0] * dim, None, None

    def held(batches):
        """Dimension and key of the values within the bounds so far."""
        a, b = np.array(low, np.uint64), np.array(high, np.uint64)
        for batch in batches:
            flat = batch.column(0).flatten()
            key, d = _keys(flat.to_numpy(zero_copy_only=False).astype(np.float64)), np.tile(np.arange(dim), batch.num_rows)
            ok = (key >= a[d]) & (key <= b[d]) & ~flat.is_null().to_numpy(zero_copy_only=False)
            yield d[ok], key[ok]

    while inside is None or (sum(inside) > few and low != high):
        step = [-(-(h - x + 1) // bins) for x, h in zip(low, high)]

        def count(batches):
            a, w, n = np.array(low, np.uint64), np.array(step, np.uint64), np.zeros(dim * bins, np.int64)
            for d, key in held(batches):
                n += np.bincount(d * bins + ((key - a[d]) // w[d]).astype(np.int64), minlength=dim * bins)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

        n = np.zeros(dim * bins, np.int64)
        for r in rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a bin and dimension at most
            n[r["at"]] = r.n
        n = n.reshape(dim, bins)
        place = [int(x) // 2 for x in n.sum(1)] if place is None else place
        inside = []
        for i, sums in enumerate(n.cumsum(1)):
            b = min(int(np.searchsorted(sums, place[i] - below[i], "right")), bins - 1)
            below[i] += int(sums[b - 1]) if b else 0
            low[i], high[i] = low[i] + b * step[i], min(high[i], low[i] + (b + 1) * step[i] - 1)
            inside.append(int(n[i, b]))

    if low == high:
        return [_value(x) for x in low]

    def values(batches):
        for d, key in held(batches):
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(key.view(np.int64))], ["d", "key"])

    left = rows.mapInArrow(values, "d int, key long").toPandas()  # `few` rows at most, or those of dimensions with one value
    return [_value(int(np.sort(left["key"].to_numpy()[left["d"].to_numpy() == i].view(np.uint64))[place[i] - below[i]])) for i in range(dim)]


def binary_thresholds(df: DataFrame, dim: int, vec: str = "vector") -> list[float]:
    """0.5 where all values are 0 or 1, else the median (the middle of the range where the median is an end of it)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.exists(vec, lambda x: (x != 0) & (x != 1)), 1).otherwise(0)).alias("real")).first()
    if not row.n or not row.real:
        return [0.5] * dim
    lo, hi = (x[:dim] for x in bounds(df, vec))
    return [m if a < m < b else (a + b) / 2 for m, a, b in zip(middles(df, lo, hi, vec), lo, hi)]


def binary_encode(vec: Column, thresholds: list[float]) -> Column:
    """array<boolean>, true above the threshold."""
    return F.zip_with(vec, vector(thresholds), lambda x, t: x.cast("double") > t)


def _sample(df: DataFrame, id_: str, vec: str, rows: int = SAMPLE_ROWS) -> np.ndarray:
    got = df.select(F.col(vec).alias("v")).orderBy(F.xxhash64(id_), id_).limit(rows).toPandas()["v"]
    return np.array(got.tolist(), np.float64)


def kmeans(x: np.ndarray, k: int, rounds: int = 20, seed: int = 42) -> np.ndarray:
    """Lloyd's algorithm with farthest-point starts on a fitted sample; empty cells are drawn anew from the largest."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        centres.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
        cell = d.argmin(1)
        sizes = np.bincount(cell, minlength=k)
        new = np.stack([np.bincount(cell, x[:, i], k) for i in range(x.shape[1])], 1) / np.maximum(sizes, 1)[:, None]
        for j in np.flatnonzero(sizes == 0):
            new[j] = x[rng.choice(np.flatnonzero(cell == sizes.argmax()))]
        if np.allclose(new, c):
            break
        c = new
    return c


def _nearest(books: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each row's codewords, a few hundred rows at a time."""
    wide, out = books.shape[2], np.zeros((len(x), len(books)), np.int32)
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        for i, b in enumerate(books):
            out[lo : lo + 256, i] = ((part[:, None, i * wide : (i + 1) * wide] - b) ** 2).sum(2).argmin(1)
    return out


@dataclass
class PQ:
    books: np.ndarray  # parts x 256 x width

    @classmethod
    def fit(cls, df: DataFrame, parts: int = 8, id_: str = "id", vec: str = "vector") -> PQ:
        x = _sample(df, id_, vec)
        if x.shape[1] % parts:
            raise ValueError("the dimension isn't a multiple of the number of parts")
        width = x.shape[1] // parts
        return cls(np.array([kmeans(x[:, i * width : (i + 1) * width], 256, 15) for i in range(parts)]))

    def encode(self, df: DataFrame, id_: str = "id", vec: str = "vector") -> DataFrame:
        books = self.books

        def run(batches):
            for pdf in batches:
                codes = _nearest(books, np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1))
                yield pd.DataFrame({"id": pdf["id"], "codes": list(codes)})

        kind = df.schema[id_].dataType.simpleString()
        return df.select(F.col(id_).alias("id"), F.col(vec).alias("v")).mapInPandas(run, f"id {kind}, codes array<int>").withColumnRenamed("id", id_)

    def scores(self, codes: DataFrame, query, metric: str = "ip", id_: str = "id") -> DataFrame:
        """By a table of the query's distances to all codewords (inner product, else squared distance)."""
        q = np.asarray(query, float).reshape(len(self.books), 1, -1)
        lut = (self.books * q).sum(2) if resolve(metric) == "ip" else ((self.books - q) ** 2).sum(2)
        score = F.lit(0.0)
        for i in range(len(lut)):
            score = score + F.get(vector(lut[i]), F.get("codes", F.lit(i)))
        return codes.select(id_, score.alias("score"))

    def shortlist(self, codes: DataFrame, query, k: int, metric: str = "ip", id_: str = "id") -> DataFrame:
        return self.scores(codes, query, metric, id_).orderBy(*ordered(metric, id_=id_)).limit(k)

    def batch_shortlist(self, codes: DataFrame, queries: list, k: int, metric: str = "ip", id_: str = "id") -> DataFrame:
        """query (its place in the list), id, score: the k best by codes of each query. A task looks all queries' tables up for a batch of
        codes at a time and gives its own k best of each."""
        q = np.array([np.asarray(x, float) for x in queries]).reshape(len(queries), len(self.books), 1, -1)
        lut = (self.books * q).sum(3) if resolve(metric) == "ip" else ((self.books - q) ** 2).sum(3)  # queries x parts x 256
        sign = 1.0 if ascending(metric) else -1.0

        def run(batches):
            for pdf in batches:
                c = np.array(pdf["codes"].tolist(), np.int64).reshape(len(pdf), -1)
                ids = pdf["id"].to_numpy()
                for n, table in enumerate(lut):
                    score = sum(table[i][c[:, i]] for i in range(c.shape[1]))
                    rank = sign * np.round(score, 9)
                    near = np.flatnonzero(rank <= np.partition(rank, k - 1)[k - 1]) if len(rank) > k else np.arange(len(rank))
                    near = near[np.argsort(ids[near], kind="stable")]
                    near = near[np.argsort(rank[near], kind="stable")][:k]
                    yield pd.DataFrame({"query": np.full(len(near), n, np.int32), "id": ids[near], "score": score[near]})

        kind = codes.schema[id_].dataType.simpleString()
        found = codes.select(F.col(id_).alias("id"), "codes").mapInPandas(run, f"query int, id {kind}, score double")
        w = Window.partitionBy("query").orderBy(*ordered(metric))
        return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n").withColumnRenamed("id", id_)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows, scaled to keep lengths; filled up to a power of two."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    y *= np.where(np.random.default_rng(42).random(n) < 0.5, -1.0, 1.0)
    h = 1
    while h < n:
        y = y.reshape(len(x), n // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return y / np.sqrt(n)


@dataclass
class Coarse:
    """A fitted codec for batches of vectors: decoded(x) gives c and rest, for which a row scores |c - turned(q)|^2 + rest (inner product: c . turned(q))."""

    kind: str
    fitted: tuple

    @classmethod
    def fit(cls, df: DataFrame, codec: str, id_: str = "id", vec: str = "vector") -> Coarse:
        """sq8, pq<parts>, rabitq (one bit a dimension and the length), polarvec<bits> (uniform bits of the rotated dimensions)."""
        name = codec.lower()
        if name.startswith("pq"):
            return cls("pq", (PQ.fit(df, int(name[2:] or 8), id_, vec).books,))
        if name == "sq8":
            lo, hi = (np.array(x) for x in bounds(df, vec))
            return cls("sq8", (lo, np.where(hi > lo, (hi - lo) / 255, 1.0)))
        bits = 1 if name == "rabitq" else int(name.removeprefix("polarvec") or 4)
        if bits == 1:
            return cls("bit", ())
        r = hadamard(_sample(df, id_, vec))
        return cls("box", (r.min(0), np.maximum((r.max(0) - r.min(0)) / ((1 << bits) - 1), 1e-12), (1 << bits) - 1))

    def turned(self, q: np.ndarray) -> np.ndarray:
        return hadamard(q) if self.kind in ("bit", "box") else q

    def decoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "pq":
            books = self.fitted[0]
            return np.concatenate([b[c] for b, c in zip(books, _nearest(books, x).T)], 1), np.zeros(len(x))
        if self.kind == "sq8":
            lo, scale = self.fitted
            return np.clip(np.floor((x - lo) / scale + 0.5), 0, 255) * scale + lo, np.zeros(len(x))
        r = hadamard(x)
        if self.kind == "box":
            low, step, most = self.fitted
            back = np.clip(np.round((r - low) / step), 0, most) * step + low
            return back, ((r - back) ** 2).sum(1)
        norm, root = np.sqrt((r**2).sum(1)), np.sqrt(r.shape[1])
        c = np.where(r > 0, 1.0, -1.0) * (norm / root / np.maximum(np.abs(r).sum(1) / np.maximum(norm, 1e-30) / root, 1e-6))[:, None]
        return c, norm**2 - (c**2).sum(1)


def _pair_scores(c: np.ndarray, rest: np.ndarray, q: np.ndarray, ip: bool) -> np.ndarray:
    return (c * q).sum(1) if ip else ((c - q) ** 2).sum(1) + rest


def _places(score: np.ndarray, ip: bool) -> np.ndarray:
    """Where scores stand in the ranking, smaller first."""
    return np.where(np.isnan(score), np.inf, (-1.0 if ip else 1.0) * np.round(score, 9))


def coarse_scores(df: DataFrame, coarse: Coarse, query, metric: str, id_: str, vec: str) -> DataFrame:
    q, ip = coarse.turned(np.asarray([query], float)), resolve(metric) == "ip"

    def run(batches):
        for pdf in batches:
            c, rest = coarse.decoded(np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1))
            yield pd.DataFrame({"id": pdf["id"], "score": _pair_scores(c, rest, q, ip)})

    kind = df.schema[id_].dataType.simpleString()
    return df.select(F.col(id_).alias("id"), F.col(vec).alias("v")).mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_)


def coarse_ranks(df: DataFrame, queries: DataFrame, pairs: DataFrame, coarse: Coarse, metric: str = "l2", id_: str = "id", vec: str = "vector", query_id: str = "query_id", query_vec: str = "query") -> DataFrame:
    """query_id, id, before: of each pair of a query and a row, how many rows stand before that row in the query's ranking by the codec (inner product or
    squared distance). A row is in the query's shortlist of n if fewer than n do.

    queries is a block of search.query_blocks, pairs has a few rows a query. Tasks count, so nothing but counts is shuffled, however long shortlists are.
    """
    ip = resolve(metric) == "ip"
    if resolve(metric) not in ("ip", "l2"):
        raise ValueError(f"no ranks by {metric}")

    def keys(batches):
        for pdf in batches:
            c, rest = coarse.decoded(np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1))
            q = coarse.turned(np.array(pdf["q"].tolist(), float).reshape(len(pdf), -1))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "at": _places(_pair_scores(c, rest, q, ip), ip)})

    types = [queries.schema[query_id].dataType, df.schema[id_].dataType]
    rows = df.select(F.col(id_).alias("b"), F.col(vec).alias("v"))
    asked = queries.select(F.col(query_id).alias("a"), F.col(query_vec).alias("q"))
    wanted = pairs.select(F.col(query_id).alias("a"), F.col(id_).alias("b")).join(rows, "b").join(asked, "a").select("a", "b", "v", "q")
    named: dict = {}
    for r in wanted.mapInPandas(keys, f"a {types[0].simpleString()}, b {types[1].simpleString()}, at double").collect():  # a few rows a query of the block
        named.setdefault(r.a, []).append((r["at"], r.b))
    blocks = {}
    for dim, (names, vecs) in whole_queries(queries, query_id, query_vec).items():
        have = [i for i, n in enumerate(names) if n in named]
        most = max((len(named[names[i]]) for i in have), default=0)
        if most:
            at = np.array([[p for p, _ in named[names[i]]] + [-np.inf] * (most - len(named[names[i]])) for i in have])  # nothing stands before -inf
            rid = [[b for _, b in named[names[i]]] + [named[names[i]][0][1]] * (most - len(named[names[i]])) for i in have]
            blocks[dim] = [names[i] for i in have], coarse.turned(vecs[have]), at, np.array(rid) if isinstance(rid[0][0], int) else np.array(rid, object)
    sizes = {n: len(v) for n, v in named.items()}

    def run(batches):
        counts = {dim: np.zeros(at.shape, np.int64) for dim, (_, _, at, _) in blocks.items()}
        for batch in batches:
            for dim, (_, turned, at, rid) in blocks.items():
                for ids, x in whole_vectors(batch, dim):
                    c, rest = coarse.decoded(x)
                    own = (c**2).sum(1) + np.abs(rest)
                    for lo in range(0, len(turned), TILE_QUERIES):
                        q, mine, names = turned[lo : lo + TILE_QUERIES], at[lo : lo + TILE_QUERIES], rid[lo : lo + TILE_QUERIES]
                        qq = (q**2).sum(1)
                        off = slack(q.shape[1], qq, own)
                        with np.errstate(all="ignore"):
                            s = -(q @ c.T) if ip else qq[:, None] + ((c**2).sum(1) + rest) - 2 * (q @ c.T)
                            i, j = np.nonzero(~(s > (mine.max(1) + off)[:, None]))
                            some = s[i, j]
                            for n in range(mine.shape[1]):
                                gap = some - mine[i, n]
                                before = gap < -off
                                near = np.flatnonzero(~(np.abs(gap) > off))  # too near to tell by the matrix product
                                place = _places(_pair_scores(c[j[near]], rest[j[near]], q[i[near]], ip), ip)
                                limit = mine[i[near], n]
                                before[near] = (place < limit) | ((place == limit) & (ids[j[near]] < names[i[near], n]).astype(bool))
                                counts[dim][lo : lo + TILE_QUERIES, n] += np.bincount(i[before], minlength=len(q))
        for dim, (names, _, _, rid) in blocks.items():
            a = [n for n in names for _ in range(sizes[n])]
            b = [x for n, row in zip(names, rid.tolist()) for x in row[: sizes[n]]]
            found = [x for n, row in zip(names, counts[dim].tolist()) for x in row[: sizes[n]]]
            yield pa.RecordBatch.from_arrays([pa.array(a, arrow[0]), pa.array(b, arrow[1]), pa.array(found, pa.int64())], [query_id, id_, "n"])

    arrow = [to_arrow_type(x) for x in types]
    counted = spread(df.select(id_, vec)).mapInArrow(run, f"`{query_id}` {types[0].simpleString()}, `{id_}` {types[1].simpleString()}, n long")
    return counted.groupBy(query_id, id_).agg(F.sum("n").alias("before"))


def two_pass(df: DataFrame, query, k: int, metric: str = "ip", codec: str = "pq", id_: str = "id", vec: str = "vector") -> DataFrame:
    """A coarse shortlist by codec (pq, rabitq, polarvec or polarvec<bits>), then the exact k best."""
    name = codec.lower()
    rows = df.count()
    wide = width(name, k, rows)
    if name.startswith("pq"):
        pq = PQ.fit(df, int(name[2:] or 8), id_, vec)
        scored = pq.scores(pq.encode(df, id_, vec), query, metric, id_)
    else:
        scored = coarse_scores(df, Coarse.fit(df, name, id_, vec), query, metric, id_, vec)
    if wide <= NARROW:
        return rescore(scored.orderBy(*ordered(metric, id_=id_)).limit(wide), df, query, k, metric, id_, vec)
    # A long shortlist is all up to a score, which at least so many rows reach, and is neither sorted nor broadcast.
    place = F.when(~F.isnan("score"), F.round("score", 9)) * (1 if ascending(metric) else -1)
    last = scored.agg(F.percentile_approx(place, min(1.0, wide / rows + 2e-4), 10_000)).first()[0]
    return topk(df.join(scored.where(place <= last).select(id_), id_, "left_semi"), query, k, metric, id_=id_, vec=vec)


def half(df: DataFrame, vec: str = "vector") -> DataFrame:
    """Values rounded through 16-bit floats."""

    @F.pandas_udf("array<float>")
    def narrow(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return df.withColumn(vec, narrow(F.col(vec)))

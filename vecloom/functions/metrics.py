"""Sixteen distances as Column expressions. All arithmetic is in doubles; only the inner product ranks descending."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {
    "ip": "ip", "inner_product": "ip", "inner": "ip", "dot": "ip",
    "l2": "l2", "l2sq": "l2", "l2_squared": "l2", "euclidean": "l2",
    "cosine": "cosine", "cos": "cosine", "cosine_distance": "cosine",
    "hamming": "hamming", "jaccard": "jaccard", "tanimoto": "tanimoto",
    "l1": "l1", "manhattan": "l1", "cityblock": "l1",
    "haversine": "haversine", "haversine_m": "haversine", "geo": "haversine",
    "correlation": "correlation", "pearson": "correlation",
    "hellinger": "hellinger", "wasserstein": "wasserstein", "wasserstein1d": "wasserstein", "emd": "wasserstein",
    "dice": "dice", "sorensen": "dice", "sorensen_dice": "dice",
    "jensen_shannon": "jensen_shannon", "js": "jensen_shannon",
    "chebyshev": "chebyshev", "chebychev": "chebyshev", "linf": "chebyshev",
    "canberra": "canberra", "bray_curtis": "bray_curtis",
}
METRICS = sorted(set(ALIASES.values()))
EARTH_M = 6371008.8
INF = float("inf")


def resolve(metric: str) -> str:
    try:
        return ALIASES[metric.lower().replace("-", "_")]
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}") from None


def ascending(metric: str) -> bool:
    """Whether smaller is nearer."""
    return resolve(metric) != "ip"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x, y)))


def _one(a: Column, f) -> Column:
    return _sum(F.transform(a, f))


def _bit(x: Column) -> Column:
    return x > 0.5


def _number(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


def _no_mass(a: Column) -> Column:
    """Whether a vector can't be a distribution: a negative or non-finite part."""
    return F.exists(a, lambda x: (x < 0) | ~_finite(x))


def _cosine(a, b):
    d = F.sqrt(_one(a, lambda x: x * x) * _one(b, lambda x: x * x))
    return F.when(d < 1e-30, 1.0).otherwise(1.0 - _pairs(a, b, lambda x, y: x * y) / d)


def _overlap(a, b):
    both = _pairs(a, b, lambda x, y: _number(_bit(x) & _bit(y)))
    either = _pairs(a, b, lambda x, y: _number(_bit(x) | _bit(y)))
    return F.when(either == 0, 0.0).otherwise(1.0 - both / either)


def _dice(a, b):
    both = _pairs(a, b, lambda x, y: _number(_bit(x) & _bit(y)))
    total = _pairs(a, b, lambda x, y: _number(_bit(x)) + _number(_bit(y)))
    return F.when(total == 0, 0.0).otherwise(1.0 - 2.0 * both / total)


def _haversine(a, b):
    lon1, lat1, lon2, lat2 = (F.radians(F.get(v, F.lit(i))) for v in (a, b) for i in (0, 1))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    fits = (F.size(a) == 2) & (F.size(b) == 2) & F.forall(a, _finite) & F.forall(b, _finite) & (F.abs(F.get(a, F.lit(1))) <= 90) & (F.abs(F.get(b, F.lit(1))) <= 90)
    return F.when(fits, 2 * EARTH_M * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))).otherwise(INF)


def _correlation(a, b):
    n = F.size(a).cast("double")
    sa, sb = _one(a, lambda x: x), _one(b, lambda x: x)
    saa, sbb, sab = _one(a, lambda x: x * x), _one(b, lambda x: x * x), _pairs(a, b, lambda x, y: x * y)
    va, vb = F.greatest(saa - sa * sa / n, F.lit(0.0)), F.greatest(sbb - sb * sb / n, F.lit(0.0))
    d = F.sqrt(va * vb)
    r = F.least(F.greatest((sab - sa * sb / n) / d, F.lit(-1.0)), F.lit(1.0))
    return F.when(n == 0, 0.0).when(d <= 2.220446049250313e-16, F.when(a == b, 0.0).otherwise(1.0)).otherwise(1.0 - r)


def let(values: dict[str, Column], body) -> Column:
    """body of a struct of values, each of which is evaluated once; a sum used inside a lambda would be summed for every element."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _masses(a, b, zero_both, zero_one, value):
    return let({"sa": _one(a, lambda x: x), "sb": _one(b, lambda x: x)}, lambda s: _of_masses(a, b, s["sa"], s["sb"], zero_both, zero_one, value))


def _of_masses(a, b, sa, sb, zero_both, zero_one, value):
    return F.when(_no_mass(a) | _no_mass(b), INF).when((sa <= 0) & (sb <= 0), zero_both).when((sa <= 0) | (sb <= 0), zero_one).otherwise(value(sa, sb))


def _hellinger(a, b):
    def value(sa, sb):
        c = _pairs(a, b, lambda x, y: F.sqrt(x * y)) / F.sqrt(sa * sb)
        return F.sqrt(1.0 - F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))

    return _masses(a, b, 0.0, 1.0, value)


def _wasserstein(a, b):
    def value(sa, sb):
        steps = F.zip_with(a, b, lambda x, y: x / sa - y / sb)
        start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
        inner = F.slice(steps, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        return F.aggregate(inner, start, lambda s, x: F.struct((s["c"] + x).alias("c"), (s["d"] + F.abs(s["c"] + x)).alias("d")), lambda s: s["d"])

    return _masses(a, b, 0.0, INF, value)


def _jensen_shannon(a, b):
    def term(p, m):
        return F.when(p > 0, 0.5 * p * F.ln(p / m)).otherwise(0.0)

    def value(sa, sb):
        shares = F.zip_with(a, b, lambda x, y: F.struct((x / sa).alias("p"), (y / sb).alias("q"), ((x / sa + y / sb) / 2).alias("m")))
        return F.sqrt(F.greatest(_sum(F.transform(shares, lambda s: term(s["p"], s["m"]) + term(s["q"], s["m"]))), F.lit(0.0)))

    return _masses(a, b, 0.0, math.sqrt(math.log(2)), value)


def _canberra(a, b):
    return _pairs(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y))))


def _bray_curtis(a, b):
    top, low = _pairs(a, b, lambda x, y: F.abs(x - y)), _pairs(a, b, lambda x, y: F.abs(x + y))
    return F.when(low == 0, F.when(top == 0, 0.0).otherwise(INF)).otherwise(top / low)


_BODY = {
    "ip": lambda a, b: _pairs(a, b, lambda x, y: x * y),
    "l2": lambda a, b: _pairs(a, b, lambda x, y: (x - y) * (x - y)),
    "cosine": _cosine,
    "hamming": lambda a, b: _pairs(a, b, lambda x, y: _number(_bit(x) != _bit(y))),
    "jaccard": _overlap,
    "tanimoto": _overlap,
    "l1": lambda a, b: _pairs(a, b, lambda x, y: F.abs(x - y)),
    "haversine": _haversine,
    "correlation": _correlation,
    "hellinger": _hellinger,
    "wasserstein": _wasserstein,
    "dice": _dice,
    "jensen_shannon": _jensen_shannon,
    "chebyshev": lambda a, b: F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0)),
    "canberra": _canberra,
    "bray_curtis": _bray_curtis,
}


def vector(values) -> Column:
    """A literal array<double>."""
    return F.array(*[F.lit(float(x)) for x in values]) if len(values) else F.array().cast("array<double>")


def distance(metric: str, a: Column, b: Column) -> Column:
    """The distance of two numeric array columns; null if either is null or their lengths differ."""
    return F.when(F.size(a) == F.size(b), _BODY[resolve(metric)](_doubles(a), _doubles(b)))


def pack_bits(a: Column, dim: int, threshold: float = 0.5) -> Column:
    """Bits x > threshold in words of 63 bits (array<bigint>), the lowest bit first."""
    words = []
    for at in range(0, dim, 63):
        bits = [F.when(F.get(a, F.lit(i)) > threshold, F.lit(1 << (i - at)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(at, min(dim, at + 63))]
        word = bits[0]
        for b in bits[1:]:
            word = word.bitwiseOR(b)
        words.append(word)
    return F.array(*words)


def packed_hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def _packed(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def packed_jaccard(a: Column, b: Column) -> Column:
    """1 - shared bits / bits of either; 0 without bits."""
    both, either = _packed(a, b, lambda x, y: x.bitwiseAND(y)), _packed(a, b, lambda x, y: x.bitwiseOR(y))
    return F.when(either == 0, 0.0).otherwise(1.0 - both / either)


def packed_dice(a: Column, b: Column) -> Column:
    """1 - 2 * shared bits / all bits; 0 without bits."""
    both, total = _packed(a, b, lambda x, y: x.bitwiseAND(y)), _packed(a, b, lambda x, y: x) + _packed(a, b, lambda x, y: y)
    return F.when(total == 0, 0.0).otherwise(1.0 - 2.0 * both / total)


def hamming_bytes(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of bytes (numbers from 0 to 255)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int"))).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def mass_statistics(a: Column) -> Column:
    """struct(inv_mass, entropy) of a distribution: what the Jensen-Shannon distance needs of a row, to be kept as columns; null without mass."""
    v = _doubles(a)
    return let({"s": _one(v, lambda x: x)}, lambda m: F.when(_no_mass(v) | (m["s"] <= 0), None).otherwise(F.struct((1.0 / m["s"]).alias("inv_mass"), _one(v, lambda x: F.when(x > 0, x / m["s"] * F.ln(x / m["s"])).otherwise(0.0)).alias("entropy"))))


def compute_distance(a, b, metric: str = "ip") -> float:
    """The distance of two vectors on the driver."""
    name = resolve(metric)
    x, y = np.asarray(a, np.float64), np.asarray(b, np.float64)
    if x.shape != y.shape or x.ndim != 1:
        raise ValueError("two vectors of one length are needed")
    with np.errstate(all="ignore"):
        return float(_NUMPY[name](x, y))


def _np_cosine(x, y):
    d = math.sqrt((x @ x) * (y @ y))
    return 1.0 if d < 1e-30 else 1.0 - x @ y / d


def _np_overlap(x, y):
    p, q = x > 0.5, y > 0.5
    return 1.0 - (p & q).sum() / (p | q).sum() if (p | q).any() else 0.0


def _np_dice(x, y):
    p, q = x > 0.5, y > 0.5
    return 1.0 - 2.0 * (p & q).sum() / (p.sum() + q.sum()) if p.any() or q.any() else 0.0


def _np_haversine(x, y):
    if len(x) != 2 or not np.isfinite([*x, *y]).all() or max(abs(x[1]), abs(y[1])) > 90:
        return INF
    (lon1, lat1), (lon2, lat2) = np.radians(x), np.radians(y)
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(max(h, 0.0), 1.0)))


def _np_correlation(x, y):
    if not len(x):
        return 0.0
    p, q = x - x.mean(), y - y.mean()
    d = math.sqrt((p @ p) * (q @ q))
    return (0.0 if (x == y).all() else 1.0) if d <= 2.220446049250313e-16 else 1.0 - min(max(p @ q / d, -1.0), 1.0)


def _np_masses(zero_both, zero_one, value):
    def run(x, y):
        if not np.isfinite([*x, *y]).all() or min([*x, *y, 0.0]) < 0:
            return INF
        if x.sum() <= 0 or y.sum() <= 0:
            return zero_both if x.sum() <= 0 and y.sum() <= 0 else zero_one
        return value(x / x.sum(), y / y.sum())

    return run


def _np_jensen_shannon(p, q):
    m = (p + q) / 2
    return math.sqrt(max(sum((0.5 * v[v > 0] * np.log(v[v > 0] / m[v > 0])).sum() for v in (p, q)), 0.0))


def _np_bray_curtis(x, y):
    top, low = np.abs(x - y).sum(), np.abs(x + y).sum()
    return top / low if low else (0.0 if not top else INF)


_NUMPY = {
    "ip": lambda x, y: x @ y,
    "l2": lambda x, y: ((x - y) ** 2).sum(),
    "cosine": _np_cosine,
    "hamming": lambda x, y: ((x > 0.5) != (y > 0.5)).sum(),
    "jaccard": _np_overlap,
    "tanimoto": _np_overlap,
    "l1": lambda x, y: np.abs(x - y).sum(),
    "haversine": _np_haversine,
    "correlation": _np_correlation,
    "hellinger": _np_masses(0.0, 1.0, lambda p, q: math.sqrt(1.0 - min(max(np.sqrt(p * q).sum(), 0.0), 1.0))),
    "wasserstein": _np_masses(0.0, INF, lambda p, q: np.abs(np.cumsum(p - q))[:-1].sum()),
    "dice": _np_dice,
    "jensen_shannon": _np_masses(0.0, math.sqrt(math.log(2)), _np_jensen_shannon),
    "chebyshev": lambda x, y: np.abs(x - y).max(initial=0.0),
    "canberra": lambda x, y: np.nan_to_num(np.abs(x - y) / (np.abs(x) + np.abs(y)), nan=0.0).sum(),
    "bray_curtis": _np_bray_curtis,
}


def register(spark) -> None:
    """compute_distance(a, b, metric) for SQL, in Arrow batches; null with a null or with lengths that differ."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, metric: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or m is None or len(x) != len(y) else compute_distance(x, y, m) for x, y, m in zip(a, b, metric)], dtype="float64")

    spark.udf.register("compute_distance", run)

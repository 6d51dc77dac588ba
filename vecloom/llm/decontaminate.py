"""Benchmark decontamination: an FM-index per training shard.

A shard is a bounded number of words of whole documents (a document is never cut). Its words become symbols; words that no
benchmark item has cannot be part of a match and end a segment, as does a document's end, and segments
shorter than every window are left out. Backward search through wavelet-tree ranks finds all distinct windows of the benchmark
at once, sampled suffix positions locate them, and the positions merge into spans to remove.

The benchmark goes to the workers in parts of a checked size; more than one part means more than one
pass, whose spans are merged by row, with the same result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_WORDS, batches_by_bytes, memo, stored, table, texts_of
from .fm_index import FMIndex

WINDOW = 8
PART_BYTES = 16 << 20  # of benchmark text in one pass: 8 M windows of 36 bytes at most, a third of that in ordinary text
SHARD_WORDS, BATCH_BYTES = 1_500_000, 8 << 20


class Windows:
    """The distinct windows of a part of the benchmark, as symbol rows, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.symbols: dict[bytes, int] = {}
        at = self.symbols.setdefault
        words = [np.array([at(w, len(self.symbols) + 1) for w in (text or "").encode().translate(LOWER_WORDS).split()], np.int32) for _, text in items]
        size = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate([*words, np.zeros(window, np.int32)])
        count = np.where(size >= window, size - window + 1, np.minimum(size, 1))
        item = np.repeat(np.arange(len(items)), count)
        first = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(size) - size, count)
        sizes = np.minimum(size, window)[item]
        rows = flat[first[:, None] + np.arange(window)]
        rows[np.arange(window) >= sizes[:, None]] = 0  # a short item's window ends with it
        _, kept, which = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
        self.rows, self.sizes = rows[kept].astype(np.int64), sizes[kept]
        self.names = [i for i, _ in items]
        pairs = np.unique(np.stack([which.ravel(), item], 1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        self.item, self.begin = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1))
        self.shortest = int(self.sizes.min(initial=window))

    def items_of(self, found: np.ndarray) -> list[str]:
        """The items of some windows, by name."""
        return sorted({self.names[i] for w in np.unique(found) for i in self.item[self.begin[w] : self.begin[w + 1]].tolist()})


def shard_hits(parts: list[tuple[np.ndarray, np.ndarray]], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, window) of all occurrences; parts: symbols and each document's number of words."""
    sizes = np.concatenate([s for _, s in parts])
    raw = np.concatenate([x for x, _ in parts])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # Segments: runs of known words inside a document.
    known = raw > 0
    cut = known.copy()
    cut[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
    start = np.flatnonzero(cut)
    ends = known.copy()
    ends[:-1] &= ~known[1:] | (doc[1:] != doc[:-1])
    stop = np.flatnonzero(ends) + 1
    long = stop - start >= windows.shortest
    start, stop = start[long], stop[long]
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none
    size = stop - start
    # The text: segments one after another, each with a 0 behind.
    offset = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(offset[-1], np.int64)
    source = np.repeat(start - offset[:-1], size + 1) + np.arange(len(text))
    inner = np.ones(len(text), bool)
    inner[offset[1:] - 1] = False
    text[inner] = raw[source[inner]]
    index = FMIndex(text, len(windows.symbols) + 1)
    low, high = index.search(windows.rows, windows.sizes)
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + low[which]
    at = source[index.locate(rows)]
    return doc[at], at - begin[doc[at]], which


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals that overlap or touch, by start."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > stops[:-1]
    first = np.flatnonzero(new)
    return starts[first], np.append(stops[first[1:] - 1], stops[-1:])


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], window: int, kind: str) -> DataFrame:
    box = docs.sparkSession.sparkContext.broadcast(items)  # PART_BYTES at most, but for a single longer item
    name = uuid.uuid4().hex

    def run(batches):
        windows = memo(name, lambda: Windows(box.value, window))
        get = windows.symbols.get

        def answer(ids, parts):
            doc, first, which = shard_hits(parts, windows)
            sizes = np.concatenate([s for _, s in parts])
            order = np.argsort(doc, kind="stable")
            doc, first, which = doc[order], first[order], which[order]
            bounds = np.searchsorted(doc, np.arange(len(sizes) + 1))
            spans, names = [], []
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    spans.append([])
                    names.append([])
                    continue
                s, e = merged(first[a:b], first[a:b] + windows.sizes[which[a:b]])
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e)])
                names.append(windows.items_of(which[a:b]))
            columns = [pa.concat_arrays(ids), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(names, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["row", "n_words", "spans", "items"])

        ids, parts, held = [], [], 0
        for batch in batches_by_bytes(batches, 1, BATCH_BYTES):
            raw, off = texts_of(batch.column(1))
            norm = raw.tobytes().translate(LOWER_WORDS)
            words = [norm[a:b].split() for a, b in zip(off.tolist(), off[1:].tolist())]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            symbols = np.fromiter((get(w, 0) for ws in words for w in ws), np.int32, int(sizes.sum()))
            ids.append(batch.column(0))
            parts.append((symbols, sizes))
            held += len(symbols)
            if held >= SHARD_WORDS:
                yield answer(ids, parts)
                ids, parts, held = [], [], 0
        if ids:
            yield answer(ids, parts)

    return docs.mapInArrow(run, f"row {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, spans (merged [start, end) in words) and items (sorted) with occurring windows.

    An item of fewer words than a window is one window, one without words or a null text has none; items without an id are left out. Null and
    empty documents have no words. Every row gives a row, also if rows share an id or have none. Texts are read whole: one longer than
    a shard is a shard of its own. Columns other than the id and the text are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // part_bytes))
    if passes == 1:
        return _pass(rows, [(r.item_id, r.text) for r in bench.collect()], window, kind).withColumnRenamed("row", "doc_id")
    # Rows are numbered once, in a written table, so that all passes know them by one number.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    every = None
    for p in range(passes):
        part = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        found = _pass(rows.select("row", "text"), [(r.item_id, r.text) for r in part.collect()], window, "bigint")
        every = found if every is None else every.union(found.where(F.size("items") > 0))
    gathered = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Sorted spans merge in one fold: a span extends the last one or follows it.
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda acc: F.element_at(acc, -1)

    def step(acc, x):
        joins = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"])
        longer = F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return rows.select("row", "doc_id").join(gathered, "row").select("doc_id", "n_words", F.aggregate("s", empty, step).alias("spans"), "items")


def with_verdict(found: DataFrame, least_items: int = 2) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"))


def cut_spans(text: str, spans) -> str:
    """The text without the words of [start, end) spans and what lies between them."""
    data = text.encode()
    norm = np.frombuffer(data.translate(LOWER_WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], norm, [False]]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : first[s]])
        at = int(end[e - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdict(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def brute(docs, items, window: int = WINDOW):
    """For tests: rows of op2 from (doc_id, text) and (item_id, text) pairs."""
    split = lambda t: (t or "").encode().translate(LOWER_WORDS).split()
    out = []
    for d, text in docs:
        words, hit, names = split(text), set(), set()
        for i, t in items:
            w = split(t)
            for k in range(max(min(1, len(w)), len(w) - window + 1)):
                p = w[k : k + window]
                for a in range(len(words) - len(p) + 1):
                    if words[a : a + len(p)] == p:
                        hit.update(range(a, a + len(p)))
                        names.add(str(i))
        out.append((d, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2))
    return out


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS size, array_to_string(w[i : i + 7], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, least(1, len(w))) + 1)) AS i FROM b)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS i FROM d, sizes)
), m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

"""Substring deduplication by level-wise doubling.

A window of `width` words is repeated only if each part of it is. So short windows are counted first, and only windows
whose parts are repeated are tried at twice the length, up to the width or until none is left. Counting every
short window isn't needed: each full window is represented at a level by its minimiser, the sub-window of that
length with the smallest hash. Equal windows have equal minimisers, so a window whose minimiser isn't
repeated anywhere isn't either; nothing is lost and about one position in fourteen is counted at the first level.

At the last level, that of the full windows, two independent 64-bit hashes stand for a window, so equality of
both is equality of words but for chances of 2**-128 a pair.

Windows are counted in buckets by hash. A chunk of documents sends each of its hashes once: with its place if the hash is unique
in the chunk, else only with the note that it is repeated, since the chunk's own places are then known to be
repeated. So a passage that a third of all documents share comes to its bucket once a chunk, not once a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, U64, batches_by_bytes, discard, release, stored, table, text_bytes, texts_of, trim, window_hashes, word_hashes, word_spans

WIDTH, SHORTEST = 35, 9
CHUNK_BYTES = 4 << 20
BUCKET_PLACES = 1_000_000
SECOND_BYTES, SECOND_WORDS = 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B  # bases of the second hash
PLACES = "k bigint, runs binary"


def levels(width: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths that end with the width, each at most twice the one before."""
    out = [width]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def sliding(a: np.ndarray, size: int, take) -> np.ndarray:
    """take (minimum or maximum) over a[i : i + size] for each i that has so many."""
    have, span = a, 1
    while span * 2 <= size:
        have = take(have[:-span], have[span:])
        span *= 2
    rest = size - span
    return take(have[: len(have) - rest], have[rest:]) if rest else have


class Chunk:
    """Word hashes of some documents, one after another."""

    def __init__(self, column):
        raw, offsets = texts_of(column)
        norm, first, end, self.begin = word_spans(raw, SPACE_WORDS, offsets)
        self.words = word_hashes(norm, first, end)
        self.spans = norm, first, end
        self.sizes = np.diff(self.begin)
        self.n = len(self.words)

    def second(self, length: int, at: np.ndarray) -> np.ndarray:
        """Another hash of the windows at some positions."""
        return window_hashes(word_hashes(*self.spans, SECOND_BYTES), length, SECOND_WORDS)[at]

    def full(self, width: int) -> np.ndarray:
        """Whether a window of the width starts at a word and stays in its document."""
        left = np.repeat(self.begin[1:], self.sizes) - np.arange(self.n)
        return left >= width

    def anchors(self, length: int, width: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the minimisers of the wanted windows, and all hashes at this length."""
        h = window_hashes(self.words, length) | U64(1)
        inside = width - length + 1
        least = sliding(h, inside, np.minimum)
        marks = np.where(wanted[: len(least)], least, U64(0))
        cover = sliding(np.concatenate([np.zeros(inside - 1, U64), marks, np.zeros(inside - 1, U64)]), inside, np.maximum)
        return np.flatnonzero((h == cover[: len(h)]) & (cover[: len(h)] > 0)), h

    def still(self, length: int, width: int, flags: np.ndarray) -> np.ndarray:
        """Windows whose minimiser at this length is flagged as repeated."""
        h = window_hashes(self.words, length) | U64(1)
        inside = width - length + 1
        some = np.where(flags[: len(h)], h, U64(2**64 - 1))
        out = np.zeros(self.n, bool)
        same = sliding(some, inside, np.minimum) == sliding(h, inside, np.minimum)
        out[: len(same)] = same
        return out & self.full(width)


def to_runs(at: np.ndarray) -> bytes:
    """Sorted positions as int32 pairs [start, stop)."""
    if not len(at):
        return b""
    new = np.flatnonzero(np.diff(at) > 1)
    return np.stack([at[np.append(0, new + 1)], at[np.append(new, len(at) - 1)] + 1], 1).astype("<i4").tobytes()


def flags_of(runs, begin: np.ndarray, n: int) -> np.ndarray:
    """Marks of each document's runs over the words of a chunk."""
    edge = np.zeros(n + 1, np.int32)
    for b, data in zip(begin, runs):
        if data:
            pairs = np.frombuffer(data, "<i4").reshape(-1, 2)
            np.add.at(edge, pairs[:, 0] + b, 1)
            np.add.at(edge, pairs[:, 1] + b, -1)
    return np.cumsum(edge[:-1]) > 0


def by_document(keys: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """(k, positions) rows from single places."""
    order = np.lexsort((at, keys))
    keys, at = keys[order], at[order].astype("<i4")
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    offsets = np.append(first, len(at)).astype(np.int32) * 4
    blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(at.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(keys[first]), blobs], ["k", "at"])


def _places(length: int, before: int | None, width: int, buckets: int):
    """Rows (bucket, keys, hashes, second, at) of a level; bucket -1: places that the chunk itself knows to be repeated."""

    def one(columns):
        keys, chunk = columns[0].to_numpy(zero_copy_only=False), Chunk(columns[1])
        if not chunk.n:
            return None
        wanted = chunk.full(width) if before is None else chunk.still(before, width, flags_of(columns[2].to_pylist(), chunk.begin, chunk.n))
        at, h = chunk.anchors(length, width, wanted) if chunk.n >= width else (np.zeros(0, np.int64), np.zeros(0, U64))
        h = h[at]
        g = chunk.second(length, at) if length == width and len(at) else np.zeros(len(at), U64)
        order = np.lexsort((g, h))
        at, h, g = at[order], h[order], g[order]
        new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(h)))
        alone = count == 1
        doc = np.searchsorted(chunk.begin, at, "right") - 1
        k, local = keys[doc], at - chunk.begin[doc]
        sent_k, sent_at, sent_h, sent_g = k[first], np.where(alone, local[first], -1), h[first], g[first]
        where = ((sent_h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)  # hashes ascend, so buckets do
        cuts = np.searchsorted(where, np.arange(buckets + 1))
        known = np.repeat(~alone, count)
        rows = [(b, sent_k[x:y].tobytes(), sent_h[x:y].tobytes(), sent_g[x:y].tobytes() if length == width else b"", sent_at[x:y].astype("<i4").tobytes()) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
        if known.any():
            rows.append((-1, k[known].tobytes(), b"", b"", local[known].astype("<i4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(5)], ["bucket", "keys", "hashes", "second", "at"])

    def run(batches):
        release()
        for batch in batches_by_bytes(whole(batches), 1, CHUNK_BYTES):
            out = one(batch.columns)
            if out is not None:
                yield out

    def whole(batches):
        """Small batches put together, up to a chunk."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += int(texts_of(batch.column(1))[1][-1])
            if size >= CHUNK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if size or held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]

    return run


def _count(table_: pa.Table) -> pa.Table:
    """The places of a bucket whose hash came more than once, or came as repeated."""
    join = lambda c, kind: np.frombuffer(b"".join(table_.column(c).to_pylist()), kind)
    keys, h, g, at = join("keys", np.int64), join("hashes", U64), join("second", U64), join("at", "<i4")
    order = np.lexsort((g, h)) if len(g) else np.argsort(h, kind="stable")
    keys, h, at = keys[order], h[order], at[order]
    same = h[1:] == h[:-1]
    if len(g):
        g = g[order]
        same &= g[1:] == g[:-1]
    repeated = (np.append(False, same) | np.append(same, False)) & (at >= 0)
    out = by_document(keys[repeated], at[repeated])
    del keys, h, g, at, order, same, repeated
    trim()
    return pa.Table.from_batches([out])


def _known(batches):
    for batch in batches:
        for keys, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield by_document(np.frombuffer(keys, np.int64), np.frombuffer(at, "<i4"))


def _merge(batches):
    for batch in batches:
        runs = [to_runs(np.unique(np.frombuffer(b"".join(blobs), "<i4"))) for blobs in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.binary())], ["k", "runs"])


def attach(docs: DataFrame, places: DataFrame, how: str, key: str = "k", runs: str = "runs") -> DataFrame:
    """Documents with their runs (columns named key and runs). Runs grow with the documents, so both sides are shuffled, at every size."""
    return docs.join(places.withColumnsRenamed({"k": key, "runs": runs}).hint("merge"), key, how)


def repeated_windows(docs: DataFrame, width: int, shortest: int = SHORTEST) -> DataFrame | None:
    """k, runs: the starts of all windows whose words also start elsewhere; None if there are none. docs: k, text."""
    total = text_bytes(docs)[1]
    before, places = None, None
    for length in levels(width, shortest):
        # Words take three bytes at least on average, or there are few of them in a place's window anyway.
        density = 2 / (width - length + 2) if before is None else 0.4
        buckets = int(max(12, total / 4 * density / BUCKET_PLACES))
        source = docs.select("k", "text") if before is None else attach(docs.select("k", "text"), places, "inner").select("k", "text", "runs")
        sent = stored(source.mapInArrow(_places(length, before, width, buckets), "bucket int, keys binary, hashes binary, second binary, at binary"), f"substring-{length}")
        counted = sent.where("bucket >= 0").select("bucket", "keys", "hashes", "second", "at").groupBy("bucket").applyInArrow(_count, "k bigint, at binary")
        known = sent.where("bucket < 0").select("keys", "at").mapInArrow(_known, "k bigint, at binary")
        last, places = places, stored(counted.union(known).groupBy("k").agg(F.collect_list("at").alias("at")).mapInArrow(_merge, PLACES), f"places-{length}")
        discard(sent, last)
        if places.isEmpty():
            return None
        before = length
    return places


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("k", F.xxhash64("doc_id", "text"))


def kept_words(words: list[bytes], runs: bytes | None, width: int) -> list[bytes]:
    if not runs:
        return words
    out, at = [], 0
    for start, stop in np.frombuffer(runs, "<i4").reshape(-1, 2).tolist():
        out += words[at:start] if start > at else []
        at = max(at, stop - 1 + width)
    return out + words[at:]


def substring_dedup(docs: DataFrame, width: int = WIDTH, shortest: int = SHORTEST, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, with_text, the kept words joined by single spaces.

    A word goes if it lies in a window of width words whose sequence also starts anywhere else, in the same
    document or another. Texts without repeats keep all words (with_text: the text as it was). Null and empty texts, and those of fewer
    than width words, keep all; rows repeated with one id and text count as two documents. Texts of any length are read whole, one in
    one task. Columns other than the id and the text are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = keyed(docs, doc_id, text)
    places = repeated_windows(rows, width, shortest)
    rows = rows.withColumn("runs", F.lit(None).cast("binary")) if places is None else attach(rows, places, "left")

    def run(batches):
        release()
        for batch in batches_by_bytes(batches, 1, CHUNK_BYTES):
            n_words, n_removed, sha, texts = [], [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split()
                kept = kept_words(words, runs, width)
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(joined.decode() if runs else text)
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    out = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * with_text
    return rows.select("doc_id", "text", "runs").mapInArrow(run, out)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i : i + 34], ' ')) AS h, md5(array_to_string(w[i : i + 34], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)),
rep AS (SELECT h, m FROM win GROUP BY h, m HAVING count(*) > 1),
hit AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM win JOIN rep USING (h, m)) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS joined FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k, ks FROM d LEFT JOIN hit USING (doc_id)
  ) WHERE ks IS NULL OR NOT list_contains(ks, k) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

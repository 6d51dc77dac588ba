"""What the training-data operators share: the shared folder, byte tables, hashes, Arrow glue."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship, spread

_OWN_DIR: list[str] = []

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1


_MEMO: dict[str, object] = {}


def memo(name: str, build):
    """What an operator keeps in a Python worker between tasks; only the last operator's is kept, as workers outlive stages."""
    if name not in _MEMO:
        release()
        _MEMO[name] = build()
    return _MEMO[name]


def release() -> None:
    """Drops what earlier operators kept in this worker and gives the freed memory back to the system."""
    _MEMO.clear()
    trim()


def trim() -> None:
    """Gives freed memory back; a worker that waits for its next task holds little then."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


#: Bytes of an Arrow batch between the JVM and a worker, against 64 MB by default: texts are long, and both sides hold batches.
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df  # long texts are worth a shuffle where all lie in a few row groups


def prepare(spark: SparkSession) -> None:
    """Ships the package, and keeps Arrow batches small if the session doesn't say otherwise."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "1b").rstrip("b") == str(64 << 20):
        spark.conf.set(name, f"{ARROW_BYTES}b")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder, else, in a local session only, an own one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/") if "://" in root or not root.startswith(("/", "file:")) else "file://" + root.removeprefix("file:").rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="vecloom-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return "file://" + _OWN_DIR[0]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/vecloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and it survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    # Shuffle files go with the end of the write: what comes after reads the table, also if executors are lost.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()} if df is not None else ():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            if path.getName().startswith("vecloom-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns, name: str) -> str:
    """A name like this one that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, to size chunks and buckets by."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def category_ranges(*categories: str) -> str:
    """The characters of Unicode categories (their first letters, or both) as ranges of a regular expression's class."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)).startswith(categories)
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


def lower_word_table() -> bytes:
    """bytes.translate table: A-Z to lower case, ASCII other than letters and digits to a space.

    Bytes from 0x80 up stay, so a UTF-8 word keeps its bytes; splitting the result at spaces gives
    the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text.
    """
    keep = lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
    return bytes(c + 32 if 65 <= c <= 90 else c if keep(c) else 32 for c in range(256))


LOWER_WORDS = lower_word_table()
#: The words [^\x20\x09-\x0D]+, unchanged.
SPACE_WORDS = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that equal sums give equal keys and near sums far ones."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}
KEPT_POWERS = 1 << 19
#: Words hashed at a time: some 200 KB of text, for which the prefix sums stay in the processor's cache.
HASHED_WORDS = 1 << 15


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n; up to KEPT_POWERS they are kept between calls, as workers outlive stages."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _powers(base, max(n + n // 4, 1 << 16) if n <= KEPT_POWERS else n)
        if n <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


def word_spans(data: np.ndarray, table: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the documents that lie end to end in data (uint8), starts: their n + 1 offsets.

    Gives the translated bytes, the words' first and end offsets, and the first word of each document
    (n + 1 values). A word never crosses a document's end.
    """
    norm = np.frombuffer(table, np.uint8)[data]
    inside = norm != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = starts[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return norm, first, end, np.searchsorted(first, starts)


def word_hashes(norm: np.ndarray, first: np.ndarray, end: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """64-bit hashes of words: a polynomial over their bytes, with the length, finalised. No Python object per word."""
    if not len(first):
        return np.zeros(0, U64)
    out = np.empty(len(first), U64)
    # In blocks of words, so that the prefix sums take bounded memory.
    for a in range(0, len(first), HASHED_WORDS):
        b = min(a + HASHED_WORDS, len(first))
        lo, hi = int(first[a]), int(end[b - 1])
        part = norm[lo:hi].astype(U64) + U64(1)
        size = end[a:b] - first[a:b]
        # sum over a word of byte[i] * base**(i - first) by Horner over the longest words' positions would loop;
        # the prefix sum over base**-i does it in one pass, as an odd base has an inverse.
        inv = powers(pow(base, -1, 1 << 64), hi - lo)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(part * inv, out=total[1:])
        h = (total[end[a:b] - lo] - total[first[a:b] - lo]) * powers(base, hi - lo + 1)[end[a:b] - 1 - lo]
        out[a:b] = mix64(h + size.astype(U64) * U64(0xD6E8FEB86659FD93))
    return out


def window_hashes(words: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Hashes of all len(words) - width + 1 windows; windows over a document's end are the caller's to drop."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    # By doubling: the hash of 2k words is that of k, times base**k, plus that of the next k.
    have, out, used = words, None, 0
    size, rest = 1, width
    while rest:
        if rest & 1:
            if out is None:
                out = have[: len(words) - size + 1].copy()
                used = size
            else:
                m = len(words) - used - size + 1
                out = out[:m] * U64(pow(base, size, 1 << 64)) + have[used : used + m]
                used += size
        rest >>= 1
        if rest:
            m = len(words) - 2 * size + 1
            have = have[:m] * U64(pow(base, size, 1 << 64)) + have[size : size + m]
            size *= 2
    return mix64(out[:n])


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def batches_by_bytes(batches, column: int, limit: int):
    """Re-cuts a stream of Arrow batches to slices of about limit bytes of that string column, a row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        off = texts_of(batch.column(column))[1]
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
        del batch
    trim()

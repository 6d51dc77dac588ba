"""Token ids in Arrow files of fixed-size lists.

Documents are range-partitioned by id, so that shard files in order hold ids in ascending document order. A shard is one
Arrow IPC file whose batches hold equal-length sequences as fixed-size lists: ``ids``, ``used`` (false for the padding
at the shard's end) and ``ends`` (true at each document's last id), uncompressed, so that any sequence can be mapped
without a copy; the shard's document ids lie beside it. Files are written under names of their own attempt and count only once
the stored manifest names them, so a retried or speculative task leaves no trace in the result.

Byte-level BPE works on pre-tokens one by one. A space before a character that isn't white space always begins a pre-token, and
so does what follows letters and isn't one. Texts are cut at such places, and each distinct piece goes through the library once per worker.
A text that holds an added token of the tokenizer goes through the library whole.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_by_bytes, memo, shared_path, stored, table, text_bytes, texts_of

SEQUENCE, BATCH_SEQUENCES = 2048, 256
SHARD_BYTES = 32 << 20  # of text
BATCH_BYTES = 4 << 20
CACHE_PIECES, LONGEST_KEPT = 600_000, 64
GROUP = 64  # pieces in a call of the library
#: By byte: 1 first of a character that can't be white space (those of U+0080-U+00BF, U+1000-U+3FFF and beyond U+DFFF don't count), 2 letter A-Z, 4 visible ASCII that is no letter, 8 space.
KINDS = np.zeros(256, np.uint8)
for _first, _stop in ((0x21, 0x7F), (0xC3, 0xE1), (0xE4, 0xEE)):
    KINDS[_first:_stop] |= 1
KINDS[0x21:0x7F] |= 4
for _first in b"Aa":
    KINDS[_first : _first + 26] ^= 6
KINDS[0x20] = 8


def pieces_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of the pieces of texts that lie end to end: each begins with its text, at a space before what isn't white space, or between A-Z and ASCII that is neither letter nor white space."""
    kinds = KINDS[raw]
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw):
        cut[:-2] = (kinds[:-1] == 8) & (kinds[1:] & 1 > 0)
        cut[1:-1] |= (kinds[:-1] & 2 > 0) & (kinds[1:] & 4 > 0)
        cut[offsets[1:][offsets[1:] > 0] - 1] &= kinds[offsets[1:][offsets[1:] > 0] - 1] != 8  # what follows is another text
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder(dict):
    """piece -> its ids as little-endian bytes. special: special tokens in a text are found, as by the library's default."""

    def __init__(self, path: str, special: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        tokens = self.tokenizer.get_added_tokens_decoder()
        added = [re.escape(t.content.encode()) for t in tokens.values() if special or not t.special]
        self.find_added = re.compile(b"|".join(added)).finditer if added else lambda raw: ()
        # The library cuts texts at a special token, so pieces can share a call with it between them.
        plain = special and len(tokens) == 1 and all(t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word) for t in tokens.values())
        self.between = next((t.content, i) for i, t in tokens.items()) if plain else None

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        raw, offsets = texts_of(column)
        whole = set()
        for m in self.find_added(raw.data):
            # Texts lie end to end, so a match can be of two; both are read whole then.
            whole.update(range(int(np.searchsorted(offsets, m.start(), "right")) - 1, int(np.searchsorted(offsets, m.end() - 1, "right"))))
        bounds = pieces_of(raw, offsets)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        names, begins = texts_of(pieces.dictionary.cast(pa.large_string()))
        names, begins = names.tobytes(), begins.tolist()
        ids = self.of([names[a:b] for a, b in zip(begins, begins[1:])])
        _, ends, data = pa.array(ids, pa.large_binary()).take(pieces.indices).buffers()
        out, ends = data.to_pybytes() if data else b"", np.frombuffer(ends, np.int64)
        cuts = ends[np.searchsorted(bounds, offsets)].tolist()
        return [self.by_library([raw[offsets[i] : offsets[i + 1]].tobytes().decode()])[0] if i in whole else out[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        out = list(map(self.get, pieces))
        new = [i for i, x in enumerate(out) if x is None]
        if len(self) + len(new) > CACHE_PIECES:
            self.clear()  # but for the pieces met just now, which hold the frequent ones
            self.update((p, x) for p, x in zip(pieces, out) if x is not None and len(p) <= LONGEST_KEPT)
        for a in range(0, len(new), GROUP * GROUP):
            part = new[a : a + GROUP * GROUP]
            for i, x in zip(part, self.together([pieces[i].decode() for i in part])):
                out[i] = x
                if len(pieces[i]) <= LONGEST_KEPT:
                    self[pieces[i]] = x
        return out

    def together(self, pieces: list[str]) -> list[bytes]:
        """by_library, several pieces a call where the special token can stand between them."""
        if self.between is None or any(self.between[0] in p for p in pieces):
            return self.by_library(pieces)
        mark, mark_id = self.between
        found = self.tokenizer.encode_batch_fast([mark.join(pieces[a : a + GROUP]) + mark for a in range(0, len(pieces), GROUP)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, self.kind) for e in found])
        stops = (np.flatnonzero(ids == mark_id) * self.kind.itemsize).tolist()
        data, step = ids.tobytes(), self.kind.itemsize
        return [data[a + step : b] for a, b in zip([-step, *stops], stops)] if len(stops) == len(pieces) else self.by_library(pieces)

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str) -> Encoder:
    return memo(f"tokens {path}", lambda: Encoder(path, special=True))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def file_schema(kind, length: int) -> pa.Schema:
    ids = pa.uint16() if kind.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("used", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Packs documents into equal-length sequences, a batch at a time."""

    def __init__(self, sink, kind, length: int):
        self.schema, self.kind, self.length = file_schema(kind, length), kind, length
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts, self.ends, self.held, self.total = [], [], 0, 0

    def add(self, data: bytes) -> None:
        self.parts.append(data)
        self.held += len(data) // self.kind.itemsize
        self.total += len(data) // self.kind.itemsize
        self.ends.append(self.held - 1)
        if self.held >= self.length * BATCH_SEQUENCES:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.parts), self.kind)
        whole = len(flat) if last else len(flat) // self.length * self.length
        room = -(-whole // self.length) * self.length
        ids, used, ends = np.zeros(room, self.kind), np.zeros(room, bool), np.zeros(room, bool)
        ids[:whole], used[:whole] = flat[:whole], True
        at = np.array(self.ends, np.int64)
        ends[at[at < whole]] = True
        if room:
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, used, ends)]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        self.parts, self.ends, self.held = [flat[whole:].tobytes()], (at[at >= whole] - whole).tolist(), len(flat) - whole

    def close(self) -> None:
        self.flush(True)
        self.writer.close()


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, length: int = SEQUENCE, shard_bytes: int = SHARD_BYTES, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents in ascending id order; gives the manifest: shard, file, docs, tokens.

    Null and empty texts are their end id alone; rows without an id come first; repeated ids lie side by side.
    """
    spark = docs.sparkSession
    model = tokenizer or default_tokenizer()
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shards = max(1, -(-text_bytes(rows)[1] // shard_bytes))
    # Length and hash of the text break ties, so that one id can't fill a shard beyond its rows that are alike, and rows of one id have a fixed order.
    order = ["doc_id", F.octet_length("text"), F.xxhash64("text")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyarrow import fs

        code = encoder(model)
        shard, name, writer, n = TaskContext.get().partitionId(), uuid.uuid4().hex, None, 0
        system, folder = fs.FileSystem.from_uri(path)
        for batch in batches_by_bytes(batches, 1, BATCH_BYTES):
            if writer is None:
                system.create_dir(folder, recursive=True)
                sink, index = (system.open_output_stream(f"{folder}/{shard:07d}-{name}.{x}") for x in ("arrow", "docs.arrow"))
                writer = ShardWriter(sink, code.kind, length)
                schema = pa.schema([("doc_id", pa.int64())])
                ids = pa.ipc.new_file(index, schema)
            end = np.array([end_id], code.kind).tobytes()
            for data in code.encode_column(batch.column(1)):
                writer.add(data + end)
            ids.write_batch(pa.record_batch([batch.column(0)], schema=schema))
            n += batch.num_rows
        if writer is not None:
            for x in (writer, sink, ids, index):
                x.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": f"{shard:07d}-{name}", "docs": n, "tokens": writer.total}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return stored(rows.mapInArrow(run, "shard int, file string, docs bigint, tokens bigint"), "token-manifest")


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    bases = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{folder}/{row['file']}.docs.arrow") as f:
                    doc_ids = pa.ipc.open_file(f).read_all().column(0)
                sizes, sums = [], []
                crc = held = 0
                with system.open_input_file(f"{folder}/{row['file']}.arrow") as f:
                    file = pa.ipc.open_file(f)
                    for k in range(file.num_record_batches):
                        part = file.get_batch(k)
                        ids, used, ends = (part.column(c).values.to_numpy(zero_copy_only=False) for c in ("ids", "used", "ends"))
                        wide = ids[: int(used.sum())].astype("<u4")
                        at = 0
                        for stop in (np.flatnonzero(ends) + 1).tolist():
                            sums.append(zlib.crc32(wide[at:stop], crc))
                            sizes.append(held + stop - at)
                            at, crc, held = stop, 0, 0
                        if at < len(wide):
                            crc, held = zlib.crc32(wide[at:], crc), held + len(wide) - at
                if len(sizes) != len(doc_ids) or sum(sizes) != row["tokens"]:
                    raise ValueError(f"shard {row['file']} isn't whole")
                starts = row["base"] + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                for a in range(0, len(sizes), 10_000):
                    b = a + 10_000
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(a, 10_000).combine_chunks(), pa.array(starts[a:b]), pa.array(sizes[a:b], pa.int64()), pa.array(sums[a:b], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = bases.repartition(max(1, min(manifest.count(), 10_000)), "shard")
    return tasks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), path), path)

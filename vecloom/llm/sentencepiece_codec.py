"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A merge-type encoding is the one split into pieces in which every two neighbours, merged again on
their own, come out as they are. So it can be found from left to right: take the longest piece that
matches, keep it if it is compatible with the piece before, else try the next shorter one, and step
back where none is left. A position reached by compatible pieces is always reached by the same ones
(they are the encoding of that prefix), so one bit for each position that failed keeps the search linear.
Matches come from an Aho-Corasick automaton, compatibility from re-merging the two pieces (kept by pair).

Pieces never hold a space mark after another character, nor a letter beside another character, nor
characters that have no piece (all checked on loading), so texts are cut there first and each distinct part is encoded once per worker.

Null is encoded as an empty text, which has no ids. U+2581 in a text counts as a space, as in the library.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_by_bytes, memo, table

SPACE = "▁"
BATCH_BYTES = 4 << 20
#: Parts that a worker keeps; beyond, it starts anew.
CACHE_PARTS, CACHE_CHARS = 300_000, 48
LETTER = re.compile(r"[^\W\d_¹²³¼½¾]")
PARTS = re.compile(r"\n| *[^\W\d_¹²³¼½¾]+| *(?:[\d_¹²³¼½¾]|[^\w \n])+| +")
#: For models with pieces that mix letters with other characters.
COARSE_PARTS = re.compile(r"\n| *[^ \n]+| +")


class Codec:
    """A SentencePiece BPE model with byte fallback and no text normalisation but the space marks."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without text normalisation are supported")
        self.prefix = " " if spec.add_dummy_prefix else ""
        kinds = pb.ModelProto.SentencePiece
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(len(model.pieces), bool)
        self.byte_ids = [0] * 256
        for i, p in enumerate(model.pieces):
            self.score.append(p.score)
            if p.type == kinds.NORMAL:
                self.ids[p.piece] = i
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.is_byte[i] = True
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (kinds.UNKNOWN, kinds.CONTROL):
                self.surface.append(model.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else b"")
            else:
                raise ValueError("user-defined and unused pieces are not supported")
        self.chars = {c for p in self.ids for c in p}
        if any(c not in self.ids for c in self.chars):
            raise ValueError("a character of the pieces has no piece of its own")
        for p in self.ids:
            if "\n" in p or SPACE in p.lstrip(SPACE):
                raise ValueError("a piece goes over a part's end")
        mixed = any(bool(LETTER.match(a)) != bool(LETTER.match(b)) for p in self.ids for a, b in zip(p, p[1:]) if a != SPACE)
        self.cut = (COARSE_PARTS if mixed else PARTS).findall
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pieces = {i: p for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging best pairs first (leftmost among equals) leaves of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            p, q = self.pieces[a], self.pieces[b]
            known = self.pairs[key] = self.merged(p + q) == [p, q]
        return known

    def reachable(self, a: int) -> bool:
        """Whether merging gives the piece itself from its own text."""
        known = self.alone.get(a)
        if known is None:
            p = self.pieces[a]
            known = self.alone[a] = self.merged(p) == [p]
        return known

    def known_run(self, text: str) -> list[int]:
        """Ids of a text all of whose characters have pieces, by backtracking."""
        n = len(text)
        if (one := self.ids.get(text)) is not None and self.reachable(one):
            return [one]
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.automaton.iter(text):
            starts[end - size + 1].append((size, i))  # shorter ones come first
        failed = bytearray((n >> 3) + 1)
        pos, path = 0, []  # path: [choice at the position, id, size]
        choice = len(starts[0]) - 1
        while pos < n:
            last = path[-1][1] if path else None
            found = False
            while choice >= 0:
                size, i = starts[pos][choice]
                end = pos + size
                if not failed[end >> 3] >> (end & 7) & 1 and (self.reachable(i) if last is None else self.compatible(last, i)):
                    path.append((choice, i, size))
                    pos, found = end, True
                    break
                choice -= 1
            if found:
                choice = len(starts[pos]) - 1 if pos < n else -1
                continue
            failed[pos >> 3] |= 1 << (pos & 7)
            if not path:
                raise AssertionError("no encoding: the pieces don't cover a character")
            choice, _, size = path.pop()
            pos -= size
            choice -= 1
        return [i for _, i, _ in path]

    def part_ids(self, part: str) -> list[int]:
        """Ids of one part, in which spaces stand at the start only; characters without a piece become bytes."""
        out: list[int] = []
        run: list[str] = []
        for c in part.replace(" ", SPACE):
            if c in self.chars:
                run.append(c)
            else:
                if run:
                    out += self.known_run("".join(run))
                    run = []
                out += [self.byte_ids[b] for b in c.encode()]
        return out + self.known_run("".join(run)) if run else out

    def parts(self, text: str) -> list[str]:
        return self.cut(self.prefix + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self.part_ids(part)]

    def raw(self, ids) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of ids: space marks become spaces, the first one (put there on encoding) goes, bytes become UTF-8."""
        data = self.raw(ids)
        if self.prefix and len(ids) and not self.is_byte[ids[0]] and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


class PartCache(dict):
    """part -> (ids as decimal text, ids as little-endian int32, decoded bytes)."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, part: str):
        ids = self.codec.part_ids(part)
        entry = (",".join(map(str, ids)).encode(), np.array(ids, "<i4").tobytes(), self.codec.raw(ids))
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[part] = entry
        return entry


def part_cache(path: str) -> PartCache:
    return memo(f"pieces {path}", lambda: PartCache(Codec(path)))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mapper(path: str, with_ids: bool):
    def run(batches):
        cache = part_cache(path)
        codec = cache.codec
        for batch in batches_by_bytes(batches, 1, BATCH_BYTES):
            n_tokens, sha, back, blobs = [], [], [], []
            for text in batch.column(1).to_pylist():
                entries = list(map(cache.__getitem__, codec.parts(text or "")))
                ids = b",".join([e[0] for e in entries])
                n_tokens.append(ids.count(b",") + 1 if ids else 0)
                sha.append(hashlib.sha256(ids).hexdigest())
                data = b"".join([e[2] for e in entries])
                if entries and codec.prefix:
                    data = data[1:]  # the first part starts with the space that encoding put there
                back.append(hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    blobs.append(b"".join([e[1] for e in entries]))
            columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, the ids themselves.

    Null and empty texts have no ids. Repeated rows give repeated results; other columns are left out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_mapper(model or default_model(), with_ids), out)


def decode_documents(encoded: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds the decoded text of an array<int> column of ids; null ids give a null text."""
    path = model or default_model()

    @F.pandas_udf(T.StringType())
    def decode(column):
        codec = part_cache(path).codec
        return column.map(lambda x: None if x is None else codec.decode(list(x)))

    return encoded.withColumn("decoded", decode(F.col(ids)))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)

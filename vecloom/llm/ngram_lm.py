"""Language-model scores by deleted interpolation.

p(w | u, v) = a * c(u, v, w) / c(u, v) + b * c(v, w) / c(v) + d * c(w) / N + e / (V + 1), where the weights depend on the bucket of the context's
count: that of c(u, v) if the pair was seen, else that of c(v), by powers of two. They are learned by expectation-maximisation on held-out
counts: a tenth of the training documents is taken out of the counts ("deleted"), and the weights are those that make its tokens likeliest under
what is left. Scoring then uses the counts of all training documents.

Documents are put in chunks by their ids' hash. A chunk asks for each of its distinct tokens, pairs and triples once, as sorted 64-bit hashes cut into
buckets; a bucket adds up the counts that chunks bring along and answers each with the totals in the order of its question, so
answers hold no keys and are mostly small numbers. No n-gram comes to a bucket more than once a chunk, however frequent it is. Tokens and pairs are
asked for in one round and triples in two more, each a half of the hashes, so that the shuffle files of one round are gone before the next begins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, U64, mix64, release, stored, table, text_bytes, texts_of, word_hashes, word_spans
from .language_id import fold

CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 1_500_000
ADD = 0.1
CONTEXTS, GRID, ROUNDS = 24, 60, 60
TRIPLE_ROUNDS = 2
END, START = U64(0x1E35A7BD5F0C9D21), U64(0x0B4711D2C8E6F3A9)
SMALL_LOG = -12.0  # of a probability, in the grid of the held-out tokens
SIDE = GRID + 1


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of documents one after another, each with its end, and n + 1 offsets."""
    raw, offsets = texts_of(column)
    norm, first, end, begin = word_spans(raw, SPACE_WORDS, offsets)
    words = word_hashes(norm, first, end)
    sizes = np.diff(begin) + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], U64)
    inner = np.ones(len(out), bool)
    inner[at[1:] - 1] = False
    out[inner], out[at[1:] - 1] = words, END
    return out, at


def lowered(column) -> pa.Array:
    """A-Z to lower case, other bytes as they are."""
    raw, offsets = texts_of(column)
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(lower.tobytes())])


def pairs_of(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[at[:-1]] = START
    return mix64(before * U64(0x9E3779B97F4A7C15) + t)


def triples_of(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of each token with the two before it; before a document's first token there are starts. No hash depends on another document."""
    one, two = np.empty_like(t), np.empty_like(t)
    one[1:], two[2:] = t[:-1], t[:-2]
    one[at[:-1]] = START
    two[at[:-1]] = START
    second = at[:-1] + 1
    two[second[second < at[1:]]] = START
    return mix64(mix64(two * U64(0xA0761D6478BD642F) + one) * U64(0xE7037ED1A0B428DB) + t)


class Chunk:
    """Distinct tokens, pairs and triples of a chunk, sorted, with the chunk's own places among them. Kinds are numbered from 1: tokens,
    pairs, and triples by the remainder of their hash."""

    def __init__(self, column, kinds):
        self.t, self.at = tokens(lowered(column))
        self.sizes = np.diff(self.at)
        self.keys: dict[int, np.ndarray] = {}
        self.index: dict[int, np.ndarray] = {}
        self.places: dict[int, np.ndarray | slice] = {}
        triples = triples_of(self.t, self.at) if max(kinds) > 2 else None
        for kind in kinds:
            if kind > 2:
                place = np.flatnonzero(triples % U64(TRIPLE_ROUNDS) == kind - 3)
                values = triples[place]
            else:
                place, values = slice(None), self.t if kind == 1 else pairs_of(self.t, self.at)
            self.places[kind] = place
            self.keys[kind], self.index[kind] = np.unique(values, return_inverse=True)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys change their bucket."""
    where = ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    return np.searchsorted(where, np.arange(buckets + 1))


def packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 4 or 8 bytes each."""
    top = int(counts.max(initial=0))
    return counts.astype("u1" if top < 1 << 8 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: "u1", 4: "<u4", 8: "<u8"}[len(data) // n] if n else "u1").astype(np.int64)


def asked(buckets: int, groups: int, kinds: tuple[int, ...]):
    """A chunk's questions: (kind, bucket, chunk, gone, keys, counts), with its own training counts; gone: it is of the deleted part."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        release()
        c = Chunk(t.column("text"), kinds)
        chunk = key[0].as_py()
        training = np.repeat(t.column("part").to_numpy() < 2, c.sizes)
        rows = []
        for kind in kinds:
            keys, index = c.keys[kind], c.index[kind]
            counts = np.bincount(index[training[c.places[kind]]], minlength=len(keys))
            edge = cuts(keys, buckets)
            rows += [(kind, b, chunk, chunk >= groups, keys[x:y].tobytes(), packed(counts[x:y])) for b, (x, y) in enumerate(zip(edge, edge[1:])) if x < y]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], ["kind", "bucket", "chunk", "gone", "keys", "counts"])

    return run


def _answer(t: pa.Table) -> pa.Table:
    """Totals of a bucket, for each chunk in the order that it asked, and for chunks of the deleted part what that part has.

    A row of chunk -1 has in sums the tokens and distinct tokens of all training documents and of the kept ones.
    """
    blobs = t.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(blobs), U64)
    sizes = [len(x) // 8 for x in blobs]
    counts = np.concatenate([unpacked(x, n) for x, n in zip(t.column("counts").to_pylist(), sizes)])
    gone = t.column("gone").to_pylist()
    of_gone = np.repeat(np.array(gone), sizes)
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    every, deleted = np.zeros(int(new.sum()), np.int64), np.zeros(int(new.sum()), np.int64)
    np.add.at(every, group, counts)
    np.add.at(deleted, group[of_gone], counts[of_gone])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    kept = every - deleted
    totals = [int(every.sum()), int((every > 0).sum()), int(kept.sum()), int((kept > 0).sum())]
    a = [packed(every[group[x:y]]) for x, y in zip(edge, edge[1:])] + [b""]
    d = [packed(deleted[group[x:y]]) if g else b"" for x, y, g in zip(edge, edge[1:], gone)] + [b""]
    n = len(sizes) + 1
    kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
    columns = [pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array([*t.column("chunk").to_pylist(), -1], pa.int64()), pa.array([*sizes, 0], pa.int64()), pa.array(a, pa.binary()), pa.array(d, pa.binary()), pa.array([None] * len(sizes) + [totals], pa.list_(pa.int64()))]
    return pa.table(columns, ["kind", "bucket", "chunk", "size", "total", "deleted", "sums"])


class Counts:
    """A chunk's answers at its places: c(w), c(v), c(v, w), c(u, v), c(u, v, w); a document's first token has the document start as its context,
    and no pair before it."""

    def __init__(self, c: Chunk, answers: pa.Table, starts: tuple[int, int], without_deleted: bool):
        got = {kind: [] for kind in c.keys}
        for kind, bucket, n, total, gone in zip(*(answers.column(x).to_pylist() for x in ("kind", "bucket", "size", "total", "deleted"))):
            x = unpacked(total, n)
            got[kind].append((bucket, x - unpacked(gone, n) if without_deleted else x))
        at = {}
        for kind, rows in got.items():
            every = np.concatenate([x for _, x in sorted(rows, key=lambda r: r[0])]) if rows else np.zeros(0, np.int64)
            at[kind] = every[c.index[kind]]
        self.word, self.pair, self.triple = at[1], at[2], np.zeros(len(c.t), np.int64)
        for kind in range(3, 3 + TRIPLE_ROUNDS):
            self.triple[c.places[kind]] = at[kind]
        self.context, self.before = np.empty_like(self.word), np.empty_like(self.word)
        self.context[1:], self.before[1:] = self.word[:-1], self.pair[:-1]
        self.context[c.at[:-1]] = starts[1] if without_deleted else starts[0]
        self.before[c.at[:-1]] = 0

    def estimates(self, n: int) -> list[np.ndarray]:
        """Of each token by the triple, the pair and the token alone; 0 for a context that wasn't seen."""
        by = lambda x, y: np.where(y > 0, x / np.maximum(y, 1), 0.0)
        return [by(self.triple, self.before), by(self.pair, self.context), self.word / max(n, 1)]

    def buckets(self) -> np.ndarray:
        return np.where(self.before > 0, CONTEXTS + context_bucket(self.before), context_bucket(self.context))


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then by powers of two."""
    return np.minimum(CONTEXTS - 1, np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0))


def learn(cells: np.ndarray, at: np.ndarray, floor: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (buckets x 4) by EM. cells: their numbers; at: held-out tokens and sums of the logarithms of the three estimates by cell.

    A cell stands for its tokens by the geometric means of their estimates, which differ by a factor of 1.6 in a cell at most.
    """
    bucket, rest = np.divmod(cells, SIDE**3)
    n = at[:, 0]
    places = rest // SIDE**2, rest // SIDE % SIDE, rest % SIDE
    terms = np.stack([*(np.where(c > 0, 10 ** (at[:, i + 1] / np.maximum(n, 1)), 0.0) for i, c in enumerate(places)), np.full(len(n), floor)])
    weights, known = np.full((2 * CONTEXTS, 4), 1 / 4), np.zeros(2 * CONTEXTS, bool)
    for b in range(2 * CONTEXTS):
        mine = (bucket == b) & (n > 0)
        if not mine.any():
            continue
        known[b], w = True, weights[b]
        for _ in range(rounds):
            each = w[:, None] * terms[:, mine]
            w = (each / each.sum(0) * n[mine]).sum(1) / n[mine].sum()
            w = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
        weights[b] = w
    for b in np.flatnonzero(~known) if known.any() else []:  # a bucket that held-out text never met takes the nearest one's weights, of its half if it can
        near = np.flatnonzero(known)
        near = near[(near >= CONTEXTS) == (b >= CONTEXTS)] if ((near >= CONTEXTS) == (b >= CONTEXTS)).any() else near
        weights[b] = weights[near[np.abs(near - b).argmin()]]
    return weights


def cell_of(p: np.ndarray) -> np.ndarray:
    """0 for an impossible token, else the place of log10 p in the grid."""
    log = np.log10(np.maximum(p, 1e-300))
    return np.where(p > 0, 1 + np.clip(((1 - log / SMALL_LOG) * GRID).astype(np.int64), 0, GRID - 1), 0)


def score_documents(docs: DataFrame, folds: int = 10, add: float = ADD, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the space-separated words of the lower-cased text (A-Z only) and one end, so a null or empty text is its
    end alone. Documents with crc32(id) mod folds of 0 are held out, those of 1 are the deleted part that weights are
    learned on. Repeated rows count each time. Without training documents all counts are 0 and N is 0. Texts are read whole; a chunk has
    one text at least, whatever its length. Columns other than the id and the text are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), fold(doc_id, folds).cast("int").alias("rest"))
    n_docs, size = text_bytes(rows)
    out_schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    if not n_docs:
        return spark.createDataFrame([], out_schema)
    groups = max(1, -(-size // chunk_bytes))
    # The deleted part has chunks of its own, so that learning reads it alone.
    deleted_groups = max(1, -(-groups // folds))
    key = F.xxhash64("doc_id", F.octet_length("text"))
    chunk = F.when(F.col("rest") == 1, F.pmod(key, F.lit(deleted_groups)) + groups).otherwise(F.pmod(key, F.lit(groups)))
    part = F.when(F.col("rest") == 0, 2).when(F.col("rest") == 1, 1).otherwise(0).cast("int")
    rows = rows.select("doc_id", "text", part.alias("part"), chunk.alias("chunk"))
    buckets = int(max(12, size / 6 / BUCKET_KEYS))
    every_kind, answers = tuple(range(1, 3 + TRIPLE_ROUNDS)), None
    for kinds in ((1, 2), *((k,) for k in every_kind[2:])):
        questions = rows.select("text", "part", "chunk").groupBy("chunk").applyInArrow(asked(buckets, groups, kinds), "kind int, bucket int, chunk bigint, gone boolean, keys binary, counts binary")
        got = stored(questions.groupBy("kind", "bucket").applyInArrow(_answer, "kind int, bucket int, chunk bigint, size bigint, total binary, deleted binary, sums array<bigint>"), "lm-answers")
        answers = got if answers is None else answers.union(got)
    four = [F.sum(F.col("sums")[i]).cast("bigint") for i in range(4)]
    n_all, v_all, n_kept, v_kept = (int(x or 0) for x in answers.where("chunk = -1 and kind = 1").agg(*four).first())
    trained = rows.agg(F.coalesce(F.sum(F.when(F.col("part") < 2, 1)), F.lit(0)), F.coalesce(F.sum(F.when(F.col("part") == 0, 1)), F.lit(0))).first()
    starts = (int(trained[0]), int(trained[1]))
    answers = answers.where("chunk >= 0").select(F.col("chunk").alias("a_chunk"), "kind", "bucket", "size", "total", "deleted")

    def held(key: tuple[pa.Scalar, ...], t: pa.Table, a: pa.Table) -> pa.Table:
        cell, sums = np.zeros(0, np.int64), np.zeros((0, 4))
        if t.num_rows and a.num_rows:
            c = Counts(Chunk(t.column("text"), every_kind), a, starts, True)
            estimates, which = c.estimates(n_kept), c.buckets()
            for p in estimates:
                which = which * SIDE + cell_of(p)
            cell, index = np.unique(which, return_inverse=True)
            logs = (np.log10(np.maximum(p, 1e-300)) for p in estimates)
            sums = np.stack([np.bincount(index, w, len(cell)) for w in (np.ones(len(which)), *logs)], 1)
        return pa.table([pa.array(cell.astype(np.int32)), *(pa.array(sums[:, i]) for i in range(4))], ["cell", "n", "l3", "l2", "l1"])

    learning = rows.where("part = 1").select("text", "chunk").groupBy("chunk").cogroup(answers.where(F.col("a_chunk") >= groups).groupBy("a_chunk")).applyInArrow(held, "cell int, n double, l3 double, l2 double, l1 double")
    found = learning.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "l3", "l2", "l1"))).toArrow()  # as many rows as the grid has cells at most
    weights = learn(found.column(0).to_numpy().astype(np.int64), np.stack([found.column(i).to_numpy() for i in range(1, 5)], 1), 1 / (v_kept + 1))
    floor, base_floor = 1 / (v_all + 1), n_all + add * (v_all + 1)

    def score(key: tuple[pa.Scalar, ...], t: pa.Table, a: pa.Table) -> pa.Table:
        chunk = Chunk(t.column("text"), every_kind)
        c = Counts(chunk, a, starts, False)
        bucket, begin = c.buckets(), chunk.at[:-1]
        p = weights[bucket, 3] * floor
        for i, estimate in enumerate(c.estimates(n_all)):
            p += weights[bucket, i] * estimate
        model = np.add.reduceat(np.log10(p), begin)
        base = np.add.reduceat(np.log10((c.word + add) / base_floor), begin)
        known = np.add.reduceat((c.word > 0).astype(np.int64), begin)
        n = len(begin)
        return pa.table([t.column("doc_id"), pa.array(t.column("part").to_numpy() == 2), pa.array(chunk.sizes.astype(np.int64)), pa.array(known), pa.array(np.full(n, n_all, np.int64)), pa.array(base), pa.array(model)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.groupBy("chunk").cogroup(answers.groupBy("a_chunk")).applyInArrow(score, out_schema)


def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))

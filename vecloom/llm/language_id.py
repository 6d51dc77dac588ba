"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts the words and the character n-grams (with word bounds) of a bounded sample of labelled documents, by language. A
word's score in a language mixes the two as a log-probability. The scripts of a word's letters narrow its candidate
languages to those whose training words use one of them. Viterbi then labels the words of a text: staying in a language is
free, switching costs a penalty, so a foreign word inside a passage doesn't cut it but a foreign passage does. The
document's language is the one that labels most letters; its score is their share.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_bytes, category_ranges, memo, table

#: Runs of letters: \\w has numbers of all kinds (½, ②, Ⅷ) besides, which are no letters.
WORD = re.compile(rf"[^\W_{category_ranges('N')}]+")
#: The same for texts below U+0250, with a class that is a small bitmap.
LATIN_TEXT, LATIN_WORD = re.compile(r"[\x00-ɏ]*\Z"), re.compile(r"[^\W\d_²³¹¼½¾]+")
UNKNOWN = "und"
#: Labelled documents to fit on and bytes of their texts, at most (one document is taken whatever its length), and characters of a gram.
SAMPLE_DOCS, SAMPLE_BYTES, GRAM = 5_000, 64 << 20, 3
#: Occurrences in the sample from which a word counts by itself, and not by its spelling alone.
LEAST_COUNT = 1
SWITCH = 12.0
BATCH_BYTES = 4 << 20
CACHE_WORDS = 200_000
#: First code points of script ranges, and their scripts.
SCRIPTS = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "indic"),
    (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
_FIRST = [a for a, _ in SCRIPTS]


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a lower-cased text."""
    text = (text or "").lower()
    return (LATIN_WORD if LATIN_TEXT.match(text) else WORD).findall(text)


def scripts(word: str) -> set[str]:
    return {SCRIPTS[bisect_right(_FIRST, ord(c)) - 1][1] for c in word}


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]


class Model:
    """Log-scores of words by language."""

    def __init__(self, langs, words, gram_counts, script_sets):
        self.langs, self.words, self.grams, self.scripts = langs, words, gram_counts, script_sets
        self.word_total = [sum(c.values()) + 1 for c in words]
        self.gram_total = [sum(c.values()) + 1 for c in gram_counts]
        self.kinds = len({g for c in gram_counts for g in c}) + 1

        table = {g: i + 1 for i, g in enumerate(sorted({g for c in gram_counts for g in c}))}
        self.gram_row = table
        self.gram_log = np.array([[math.log((c.get(g, 0) + 0.05) / (t + 0.05 * self.kinds)) for c, t in zip(gram_counts, self.gram_total)] for g in ["", *table]]).reshape(len(table) + 1, len(langs))

    def parts(self):
        return self.langs, self.words, self.grams, self.scripts

    def scores(self, words: list[str]) -> np.ndarray:
        """words x languages: 0 for the likeliest language, negative for the others."""
        mine = [grams(w) for w in words]
        rows = np.fromiter((self.gram_row.get(g, 0) for gs in mine for g in gs), np.int64)
        starts = np.concatenate([[0], np.cumsum([len(gs) for gs in mine])[:-1]]).astype(np.int64)
        spelled = np.maximum(np.add.reduceat(self.gram_log[rows], starts), -600.0)
        whole = np.array([[c.get(w, 0) for c in self.words] for w in words]) / np.array(self.word_total)
        # A word that training saw counts by its frequency as well, else by its spelling alone.
        out = np.where(whole > 0, np.log(0.7 * whole + 0.3 * np.exp(spelled)), math.log(0.3) + spelled)
        for i, w in enumerate(words):
            if not w.isascii():
                used = scripts(w)
                fits = np.array([bool(used & s) for s in self.scripts])
                if fits.any():
                    out[i, ~fits] = -1000.0
        out -= out.max(1, keepdims=True)
        return np.maximum(out, -20.0).astype(np.float32)


class ScoreCache(dict):
    """word -> row of a matrix of scores, which a worker keeps between tasks."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1 << 14, len(model.langs)), np.float32)

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The scores of the words of each text."""
        if len(self) > CACHE_WORDS:
            self.clear()
        new = [w for w in {w for ws in texts for w in ws} if w not in self]
        if new:
            at = len(self)
            if at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((at + 2 * len(new), self.rows.shape[1]), np.float32)])
            self.rows[at : at + len(new)] = self.model.scores(new)
            self.update(zip(new, range(at, at + len(new))))
        return [self.rows[list(map(self.__getitem__, ws))] if ws else self.rows[:0] for ws in texts]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, least_count: int = LEAST_COUNT, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits on a sample of distinct labelled documents, those of the smallest hashes of id, language and text, word by word on executors.

    Documents are added in that order while both bounds hold; texts are taken whole. What comes to the driver are the sample's counts by
    language of words (those seen least_count times), n-grams and scripts. Rows whose id, text or language is null aren't learned from.
    """

    def count(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang_, Counter()).update(words_of(text_))
        rows = []
        for a, c in words.items():
            spelled, seen = Counter(), Counter()
            for w, n in c.items():
                for g in grams(w):
                    spelled[g] += n
                for s in scripts(w):
                    seen[s] += n
            rows += [(a, kind, x, n) for kind, part in (("w", c), ("g", spelled), ("s", seen)) for x, n in part.items()]
        columns = [pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "kind", "key", "n"])

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    labelled = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id), F.col(lang), F.col(text)).alias("h"))
    # Hashes first, and only as many as leave enough for the sample, so that few rows are grouped and only the sample's texts are moved.
    n = labelled.count()
    few = F.col("h") <= int(-(2**63) + min(1.0, 8 * sample_docs / max(1, n)) * (2**64 - 1)) if n > 8 * sample_docs else F.lit(True)
    order = labelled.where(few).groupBy("h").agg(F.max(F.octet_length("text")).alias("size")).orderBy("h").limit(sample_docs).collect()  # at most sample_docs hashes
    held = np.cumsum([r.size for r in order])
    chosen = docs.sparkSession.createDataFrame([(r.h,) for i, r in enumerate(order) if not i or held[i] <= sample_bytes], "h bigint")
    rows = labelled.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"]).select("lang", "text")
    counted = rows.mapInArrow(count, "lang string, kind string, key string, n bigint").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).where((F.col("kind") != "w") | (F.col("n") >= least_count))
    by: dict[str, dict[str, Counter]] = {"w": {}, "g": {}, "s": {}}
    for r in counted.collect():
        for kind in by:
            by[kind].setdefault(r.lang, Counter())
        by[r.kind][r.lang][r.key] = r.n
    langs = sorted(by["g"])
    # A script belongs to a language if it writes one in a thousand of its words.
    own = [{s for s, n in by["s"][a].items() if 1000 * n >= sum(by["s"][a].values())} for a in langs]
    return Model(langs, [by["w"][a] for a in langs], [by["g"][a] for a in langs], own)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label of each word for many texts at once. scores: words x languages arrays."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
    at = 0
    while at < len(order):
        longest = len(scores[order[at]])
        if not longest:
            break
        # Texts of similar length go together, so that little of the block is padding.
        group = [i for i in order[at : at + max(8, min(512, 400_000 // longest))] if len(scores[i])]
        at += max(8, min(512, 400_000 // longest))
        sizes = np.array([len(scores[i]) for i in group])
        langs = scores[group[0]].shape[1]
        block = np.zeros((longest, len(group), langs), np.float32)
        for j, i in enumerate(group):
            block[: sizes[j], j] = scores[i]
        came = np.empty((longest, len(group)), np.int8)  # the best language before, for those who switch
        stay = np.empty((longest, len(group), langs), bool)
        value = block[0].copy()
        for t in range(1, longest):
            m = int(np.searchsorted(-sizes, -t, "left"))  # texts longer than t come first
            v = value[:m]
            top = v.argmax(1)
            switch = v[np.arange(m), top][:, None] - penalty
            came[t, :m] = top
            stay[t, :m] = v >= switch
            value[:m] = np.maximum(v, switch) + block[t, :m]
        label = value.argmax(1)
        paths = np.zeros((longest, len(group)), np.int8)
        for t in range(longest - 1, -1, -1):
            m = int(np.searchsorted(-sizes, -t, "left"))
            paths[t, :m] = label[:m]
            if t:
                rows = np.arange(m)
                label[:m] = np.where(stay[t, rows, label[:m]], label[:m], came[t, :m])
        for j, i in enumerate(group):
            out[i] = paths[: sizes[j], j].copy()
    return out


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH, doc_id: str = "doc_id", text: str = "text", with_spans: bool = True) -> DataFrame:
    """Per row: doc_id, lang_pred, score and, with_spans, spans (lang, start, end in words).

    `und` with score 0 where the text is null or has no letter, or where no language was learned. Only the text is read, whole, whatever
    its length; repeated rows give repeated results.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    box = docs.sparkSession.sparkContext.broadcast(model.parts())  # counts of a bounded sample
    name = uuid.uuid4().hex

    def run(batches):
        cache = memo(name, lambda: ScoreCache(Model(*box.value)))
        own = cache.model
        for batch in batches_by_bytes(batches, 1, BATCH_BYTES):
            texts = list(map(words_of, batch.column(1).to_pylist()))
            scores = cache.of(texts) if own.langs else []
            paths = viterbi(scores, penalty) if own.langs else [np.zeros(0, np.int8)] * len(texts)
            pred, share, spans = [], [], []
            for ws, path in zip(texts, paths):
                if not len(path):
                    pred.append(UNKNOWN)
                    share.append(0.0)
                    spans.append([])
                    continue
                letters = np.bincount(path, np.array([len(w) for w in ws], float), len(own.langs))
                best = int(letters.argmax())
                pred.append(own.langs[best])
                share.append(float(letters[best] / letters.sum()))
                if with_spans:
                    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                    spans.append([{"lang": own.langs[path[a]], "start": a, "end": b} for a, b in zip(cuts, cuts[1:])])
            columns, names = [batch.column(0), pa.array(pred, pa.string()), pa.array(share, pa.float64())], ["doc_id", "lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    out = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<lang:string,start:bigint,end:bigint>>" * with_spans
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, out)


def fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fold_of(doc_id, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model, with_spans=False).withColumn("held_out", fold("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score")

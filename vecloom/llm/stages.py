"""The operators as stages on a corpus: each takes documents with any columns and gives the same columns back."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, fresh, memo, stored
from .decontaminate import cut_spans, find_contamination
from .language_id import BATCH_BYTES, SWITCH, Model, ScoreCache, train, viterbi, words_of
from .simhash_dedup import near_duplicates, small
from .substring_dedup import CHUNK_BYTES, WIDTH, attach, kept_words, repeated_windows


def with_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Adds the hash of id and text by which stages find their rows again, under a name that no column has."""
    key = fresh(docs.columns, "_key")
    return docs.withColumn(key, F.xxhash64(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")))), key


def changed(docs: DataFrame, how, columns: list[str], schema) -> DataFrame:
    """docs with new texts by how(batch) -> Arrow texts; n_chars, where there is one, follows."""
    at = schema.names.index("text")

    def run(batches):
        for batch in batches_by_bytes(batches, at, CHUNK_BYTES):
            texts = how(batch)
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(len(columns))], columns)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else out


def keep_identified(docs: DataFrame, least_score: float = 0.5, penalty: float = SWITCH) -> DataFrame:
    """Documents whose main language labels at least half of their letters; those without letters go."""
    model = train(docs)
    box = docs.sparkSession.sparkContext.broadcast(model.parts())
    at, name = docs.columns.index("text"), uuid.uuid4().hex

    def run(batches):
        cache = memo(name, lambda: ScoreCache(Model(*box.value)))
        for batch in batches_by_bytes(batches, at, BATCH_BYTES):
            texts = list(map(words_of, batch.column(at).to_pylist()))
            keep = []
            # Nothing learned (no labelled text): every text with a letter is kept.
            paths = viterbi(cache.of(texts), penalty) if box.value[0] else [np.zeros(len(ws), np.int8) for ws in texts]
            for ws, path in zip(texts, paths):
                letters = np.bincount(path, np.array([len(w) for w in ws], float)) if len(path) else np.zeros(1)
                keep.append(bool(len(path)) and letters.max() >= least_score * letters.sum())
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class of near duplicates; of rows alike in id and text one, too."""
    rows, key = with_key(docs)
    found = near_duplicates(docs).groupBy(F.col("k").alias(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("keep").cast("long")).alias("kept")).where("kept < n")
    found = stored(found, "gone")
    out = rows.join(small(found.select(key), 16), key, "left_anti")
    again = found.where("kept > 0").select(key)  # repeated rows of which one stays
    if not again.isEmpty():
        out = out.unionByName(rows.join(small(again, 16), key, "left_semi").dropDuplicates([key]))
    return out.select(docs.columns)


def cut_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Texts without the words of repeated windows; texts without repeats stay as they are."""
    rows, key = with_key(docs)
    places = repeated_windows(rows.select(F.col(key).alias("k"), F.coalesce("text", F.lit("")).alias("text")), width)
    if places is None:
        return docs
    runs_name = fresh(rows.columns, "_runs")

    def how(batch):
        out = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column(runs_name).to_pylist()):
            out.append(b" ".join(kept_words(text.encode().split(), runs, width)).decode() if runs else text)
        return pa.array(out, pa.string())

    return changed(attach(rows, places, "left", key, runs_name).select(*docs.columns, runs_name), how, docs.columns, docs.schema)


def cut_benchmark(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """Documents without those that hold windows of least_items items or more; of the others the windows are cut out."""
    rows, key = with_key(docs)
    spans_name, items_name = fresh(rows.columns, "_spans"), fresh(rows.columns, "_items")
    found = find_contamination(rows.select(key, "text"), benchmark, doc_id=key).where(F.size("items") > 0)
    found = stored(found.groupBy(F.col("doc_id").alias(key)).agg(F.first("spans").alias(spans_name), F.max(F.size("items")).alias(items_name)), "contaminated")
    joined = rows.join(small(found, 256), key, "left").where(F.coalesce(items_name, F.lit(0)) < least_items)

    def how(batch):
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column(spans_name).to_pylist()):
            out.append(cut_spans(text, [(s["start"], s["end"]) for s in spans]) if spans else text)
        return pa.array(out, pa.string())

    return changed(joined.select(*docs.columns, spans_name), how, docs.columns, docs.schema)

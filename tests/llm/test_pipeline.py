"""Every stage of the pipeline on a whole small corpus, held against plain Python on what the stage before kept."""

import collections
import hashlib
import os
import re

import pytest

from vecloom.llm.common import shared_path
from vecloom.llm.language_id import identify, train

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
pipeline = pytest.importorskip("corpus_pipeline")


def lower_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def kept_of_near_duplicates(docs):
    sets = []
    for r in docs:
        w = lower_words(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    classes = {}
    for i, r in enumerate(docs):
        classes.setdefault(find(i), []).append(r.doc_id)
    return {min(c) for c in classes.values()}


def without_repeats(docs, width=35):
    count, split = collections.Counter(), {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs}
    for w in split.values():
        count.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = {}
    for d, w in split.items():
        hit = {k for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        out[d] = [x for k, x in enumerate(w) if k not in hit]
    return out


def without_benchmark(docs, items, window=8):
    windows = collections.defaultdict(set)
    for r in items:
        w = lower_words(r.text)
        for i in range(max(min(1, len(w)), len(w) - window + 1)):
            windows[tuple(w[i : i + window])].add(r.item_id)
    sizes, out = {len(x) for x in windows}, {}
    for r in docs:
        w, hit, found = lower_words(r.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        if len(found) < 2:
            out[r.doc_id] = [x for k, x in enumerate(w) if k not in hit]
    return out


def test_stages_by_brute_force(spark):
    import public_tokenizers
    import sentencepiece

    docs, rows = spark.read.parquet(f"{SF}/documents.parquet"), {}
    rows["start"] = docs.collect()
    says = {r.doc_id: r for r in identify(docs, train(docs)).collect()}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(path := shared_path(spark, name))
        docs = spark.read.parquet(path)
        rows[name] = docs.collect()
    ids = {n: {r.doc_id for r in rs} for n, rs in rows.items()}
    assert ids["language_id"] == {i for i, r in says.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert ids["near_dedup"] == kept_of_near_duplicates(rows["language_id"])
    text = {n: {r.doc_id: r.text for r in rows[n]} for n in ("language_id", "near_dedup", "substring_dedup", "decontaminate")}
    assert all(text["near_dedup"][i] == text["language_id"][i] for i in ids["near_dedup"])
    assert {i: (t or "").split() for i, t in text["substring_dedup"].items()} == {i: " ".join(w).split() for i, w in without_repeats(rows["near_dedup"]).items()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert {i: lower_words(t) for i, t in text["decontaminate"].items()} == without_benchmark(rows["substring_dedup"], items)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows["sentencepiece"]:
        want = model.encode(text["decontaminate"][r.doc_id] or "", num_threads=1)
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert ids["sentencepiece"] == ids["decontaminate"]

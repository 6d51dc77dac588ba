"""Decontamination and substring deduplication against brute force."""

import collections
import hashlib
import random

import numpy as np

from vecloom.llm import decontaminate as D
from vecloom.llm import substring_dedup as S
from vecloom.llm.fm_index import FMIndex, WaveletMatrix, suffix_array


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(1)
    for _ in range(40):
        text = rng.integers(0, rng.integers(2, 6), rng.integers(1, 120))
        text[-1] = 0
        key = lambda i: [(int(x), i + k) if x == 0 else (int(x), -1) for k, x in enumerate(text[i:])]
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=key)
        w = WaveletMatrix(text, 6)
        i = rng.integers(0, len(text) + 1, 20)
        c = rng.integers(0, 6, 20)
        assert w.rank(c, i).tolist() == [int((text[:a] == b).sum()) for a, b in zip(i, c)]
        assert w.access(np.arange(len(text))).tolist() == text.tolist()


def test_locate():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 400)
    text[rng.integers(0, 400, 30)] = 0
    text[-1] = 0
    index = FMIndex(text, 4)
    pattern = np.array([[1, 2, 0], [3, 1, 2]])
    low, high = index.search(pattern, np.array([2, 3]))
    for p, a, b in zip(([1, 2], [3, 1, 2]), low, high):
        want = [i for i in range(400) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_contamination(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"W{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(90)))) for i in range(40)]
    items = [(i, docs[i][1][: rng.randrange(80)]) for i in range(8)] + [(20, "w1, w2! W3"), (21, None), (22, ""), (23, "never seen words")]
    docs += [(100, None), (101, ""), (102, docs[0][1] * 5), (103, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as items", "text as spans")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(D.brute(docs, items))
    assert sorted(map(tuple, D.with_verdict(D.find_contamination(df, bench)).collect())) == want
    monkeypatch.setattr(D, "SHARD_WORDS", 50)
    assert sorted(map(tuple, D.with_verdict(D.find_contamination(df, bench, part_bytes=400)).collect())) == want
    none = D.with_verdict(D.find_contamination(df, bench.limit(0))).collect()
    assert len(none) == len(docs) and all(r.n_items == 0 for r in none)
    assert D.find_contamination(df.limit(0), bench).count() == 0


def test_second_hash(monkeypatch):
    """Windows whose first hashes are equal and whose words aren't are told apart at the last level."""
    import pyarrow as pa

    monkeypatch.setattr(S, "word_hashes", lambda norm, first, end, base=0: np.full(len(first), 7, np.uint64) if not base else np.arange(len(first)).astype(np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(f"w{i}" for i in range(40))])], ["k", "text"])
    sent = pa.Table.from_batches(list(S._places(35, None, 35, 4)(iter([batch]))))
    assert S._count(sent.filter(pa.compute.greater_equal(sent["bucket"], 0))).num_rows == 0 and -1 not in sent["bucket"].to_pylist()


def test_rows_that_share_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(1, passage), (1, "other " + passage[:40]), (None, passage), (None, "x"), (1, passage), (2, " ".join(f"v{i}" for i in range(300_000)) + " " + passage)]
    items = [(i, " ".join(f"p{k}" for k in range(i, i + 12))) for i in range(12)]
    df, bench = (spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id")))
    want = sorted(D.brute(docs, items), key=repr)
    for size in (1 << 20, 400, 150):
        assert sorted(map(tuple, D.with_verdict(D.find_contamination(df, bench, part_bytes=size)).collect()), key=repr) == want


def test_stages_keep_columns_of_any_name(spark):
    from vecloom.llm.stages import cut_benchmark, cut_repeats, drop_near_duplicates

    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} {passage} b{i} " + " ".join(f"c{i}x{j}" for j in range(200)), i, f"s{i}", i, i, i, "r", None) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _runs long, _spans string, _items long, _key long, k long, runs string, at binary")
    bench = spark.createDataFrame([(1, passage[:80])], "item_id long, text string")
    for stage in (cut_repeats, lambda d: cut_benchmark(d, bench), drop_near_duplicates):
        got = stage(df)
        assert got.columns == df.columns
        assert {tuple(r)[2:] for r in got.collect()} == {r[2:] for r in rows}
    assert all("p30" not in r.text for r in cut_repeats(df).collect()) and all("p3 " not in r.text for r in cut_benchmark(df, bench).collect())


def test_cut_spans():
    assert D.cut_spans("Ab, cd-ef gh!", [(1, 3)]) == "Ab,  gh!"
    assert D.cut_spans("a b", [(0, 2)]) == ""


def brute(docs, width):
    count, split = collections.Counter(), [(t or "").encode().split() for _, t in docs]
    for w in split:
        count.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(docs, split):
        hit = {k for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        kept = [x for k, x in enumerate(w) if k not in hit]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(spark, monkeypatch):
    assert S.levels(35) == [9, 18, 35] and S.levels(4) == [4]
    rng = random.Random(5)
    base = [f"x{i}" for i in range(300)]
    docs = []
    for i in range(50):
        t = [rng.choice(base) for _ in range(rng.randrange(150))]
        if docs and rng.random() < 0.6:
            other = docs[rng.randrange(len(docs))][1].split()
            a = rng.randrange(len(other) + 1)
            t[len(t) // 2 : len(t) // 2] = other[a : a + rng.randrange(70)]
        docs.append((i, " ".join(t)))
    docs += [(100, None), (101, ""), (102, "a " * 200), (None, docs[3][1]), (5, docs[5][1]), (103, "\tä  b\n" * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as k", "text as runs").repartition(3)
    for width in (35, 7):
        assert sorted(map(tuple, S.substring_dedup(df, width).collect()), key=repr) == brute(docs, width)
    monkeypatch.setattr(S, "CHUNK_BYTES", 500)
    assert sorted(map(tuple, S.substring_dedup(df, 35).collect()), key=repr) == brute(docs, 35)
    assert S.substring_dedup(df.limit(0)).count() == 0
    assert S.substring_dedup(df.where("doc_id = 0")).first().n_removed == 0


def test_hashing_takes_little_memory():
    """A worker that hashes a chunk's words holds little beside them, at the time and later; blocks don't change hashes."""
    import tracemalloc

    from vecloom.llm import common

    words = [b"w%d" % i for i in range(65_536)] + [b"long" * 200_000, b"w3"] + [b"some" * (i % 9) + b"x" for i in range(500_000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    norm, first, end, _ = common.word_spans(data, common.SPACE_WORDS, np.array([0, len(data)]))
    common._POWERS.clear()
    tracemalloc.start()
    got = common.word_hashes(norm[:8_000_000], *(x[end <= 8_000_000] for x in (first, end)))
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 80e6 and now - got.nbytes < 16e6, (peak, now - got.nbytes)
    assert got[3] == got[65_537]
    for i in [*range(0, len(got), 9973), 65_536]:
        assert got[i] == common.word_hashes(np.frombuffer(words[i], np.uint8), np.array([0]), np.array([len(words[i])]))[0]

import random

import numpy as np

from vecloom.llm import simhash_dedup as H
from vecloom.llm.components import components


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(docs):
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for i in range(len(docs)):
        out.setdefault(find(i), []).append(docs[i][0])
    return {d: min(g) for g in out.values() for d in g}


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_classes_and_recall(spark, monkeypatch):
    monkeypatch.setattr(H, "LIST_ROWS", 64)  # so that the recursion is at work on few rows
    monkeypatch.setattr(H, "LEAF_ROWS", 32)
    rng = random.Random(4)
    docs = []
    for i in range(120):
        docs.append((len(docs), " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300)))))
        for _ in range(rng.choice([0, 0, 1, 3])):
            docs.append((len(docs), near(rng, docs[-1][1], rng.randrange(4))))
    docs += [(1000, "a b"), (1001, "a, b"), (1002, "a c"), (1003, None), (1004, ""), (1005, "!!")]
    plain = [(i, t if t not in ("a, b", "!!") else {"a, b": "a b", "!!": ""}[t]) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as node", "text as part")
    got = {r.doc_id: r for r in H.near_duplicates(df).collect()}
    want = classes(plain)
    wrong = [i for i in want if got[i].class_id != want[i]]
    assert len(wrong) <= 0.1 * sum(want[i] != i for i in want) and len(got) == len(docs)
    assert got[1001].class_id == 1000 and got[1003].keep and got[1004].keep and got[1002].class_id == 1002
    kept = [r for r in got.values() if r.keep]
    assert len(kept) == len({r.class_id for r in got.values()})


def test_dense_family_and_empty(spark):
    rng = random.Random(6)
    base = " ".join(f"w{i}" for i in range(200))
    docs = [(i, near(rng, base, 2)) for i in range(200)] + [(900, base), (901, base), (None, base)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = H.near_duplicates(df)
    rows = got.collect()
    assert {r.class_size for r in rows} == {203} and sum(r.keep for r in rows) == 1
    assert H.near_duplicates(df.limit(0)).count() == 0


def test_pivots():
    # A's ball takes B; C is near B alone, and is left to the second search.
    fp = np.array([[0, 0], [2**30 - 1, 0], [2**60 - 1, 0]], np.uint64)
    size = np.full(3, 10)
    assert [x.tolist() for x in H.pivots(fp, size, 35, 64, 0.8)] == [[0], [1], [30]]
    x, y, d = H.crossing(fp, size, np.array([1, 1, 3]), 35, 64, 0.8)
    assert (x.tolist(), y.tolist(), d.tolist()) == ([2], [1], [30])


def test_near_pairs_by_brute_force():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**64, (300, 2), np.uint64)
    fp[150:] = fp[:150] ^ (np.uint64(1) << rng.integers(0, 64, (150, 2), np.uint64))
    want = {(i, j) for i in range(300) for j in range(300) if sum(bin(int(a ^ b)).count("1") for a, b in zip(fp[i], fp[j])) <= 50}
    for cells in (100, 1 << 18):
        H.BLOCK_CELLS, before = cells, H.BLOCK_CELLS
        got = {(int(a), int(b)) for x, y, _ in H.near_pairs(fp, None, 50, 64) for a, b in zip(x, y)}
        both = {(int(a), int(b)) for x, y, _ in H.near_pairs(fp[:100], fp[100:], 50, 64) for a, b in zip(x, y)}
        H.BLOCK_CELLS = before
        assert got == {(i, j) for i, j in want if i < j} and both == {(i, j - 100) for i, j in want if i < 100 <= j}


def test_chain(spark):
    # A and B, B and C are similar; the fingerprints of A and C are far apart: one class of three.
    for seed in range(2):
        rng = random.Random(seed)
        b = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        a = [f"a{rng.randrange(10**6)}" for _ in range(20)] + b[20:]
        c = b[:-20] + [f"c{rng.randrange(10**6)}" for _ in range(20)]
        docs = [(i, " ".join(w)) for i, w in enumerate((a, b, c))]
        got = {r.doc_id: r.class_id for r in H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == classes(docs) == {0: 0, 1: 0, 2: 0}


def test_crowded_lists(spark, monkeypatch):
    """A family that fills lists beyond a task's share gives the classes that it gives in one list."""
    for name, value in (("LIST_ROWS", 32), ("LEAF_ROWS", 16), ("HOT", 2), ("PROBE", 1)):
        monkeypatch.setattr(H, name, value)
    rng = random.Random(9)
    base = " ".join(f"w{i}" for i in range(150))
    docs = [(i, near(rng, base, 1)) for i in range(260)] + [(300 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(50))) for i in range(60)]
    rows = H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r.class_size == 260 for r in rows) == 260 and sum(r.class_size == 1 for r in rows) == 60


def test_repeated_rows_and_long_text(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(400_000))
    docs = [(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g"), (3, long), (4, long + " end"), (5, None), (5, None), (None, "x y")]
    rows = H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [r.keep for r in rows if r.class_id == 1].count(True) == 1 and sum(r.class_id == 1 for r in rows) == 4
    assert {r.class_id for r in rows if r.doc_id in (3, 4)} == {3} and all(r.keep for r in rows if r.doc_id == 5)
    from vecloom.llm.stages import drop_near_duplicates

    kept = drop_near_duplicates(spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, _key long")).collect()
    assert sorted((r.doc_id or 0, r._key) for r in kept)[1:] in ([(1, k), (3, 4), (5, 6), (5, 7)] for k in range(3))


def test_fingerprints():
    h = np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64)
    offsets = np.array([0, 0, 1000, 1001, 5000])
    got = H.simhash(h, offsets)
    for d in range(4):
        part = h[offsets[d] : offsets[d + 1]]
        for w in range(2):
            bits = H.mix64(part + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % 2**64))
            want = sum(1 << b for b in range(64) if 2 * int(((bits >> np.uint64(b)) & np.uint64(1)).sum()) > len(part))
            assert int(got[d, w]) == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 10), (20, 20)] + [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[13] == 10 and got[160] == 100 and got[559] == 500 and 20 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

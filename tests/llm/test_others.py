"""Top-k, archives, licenses, language scores, language ids, the pipeline."""

import math
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from vecloom.llm import exact_topk, language_id, license_scan, ngram_lm, warc
from vecloom.llm.common import shared_path

SF = "/root/testdata/sf0.001"


def test_exact_topk(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12) * (1 + 5 * (i % 7 == 0))]) for i in range(400)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1050, [0.0] * 12), (2000, None), (2050, [float("nan")] * 12), (2100, [1.0, None]), (2150, [float("inf")]), (2200, [1.0, 2.0]), (2250, []), (None, [1.0])]
    rows += [rows[5], rows[50], (50, rows[7][1])]  # ids that are repeated, also a query's
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as score", "vec_id as rank")
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    for n_q, (q, x) in enumerate(valid):
        if q % 50 == 0:
            best = sorted(((-dot(x, v), c) for n_c, (c, v) in enumerate(valid) if n_c != n_q))[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(map(tuple, exact_topk.exact_topk(df).collect())) == sorted(want)
    assert exact_topk.exact_topk(df.limit(0)).count() == 0
    assert exact_topk.exact_topk(df.where("vec_id in (100, 101)")).count() == 1


def test_archives(spark):
    fake = "zz\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nmore"
    rows = [(1, "a\nb", "x"), (2, "a", "x"), (3, "b", None), (4, "b", ""), (None, "c", "x"), (5, "d", fake), (6, "e", "WARC/1.1\r\nContent-Length: 1000000\r\n\r\n"), (7, None, "é" * 3000), (8, "e", "WARC/1.1\r\n" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as digest", "url as keep").repartition(2)
    want = {None: ("revisit", 2), 1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None)}
    for split in (64, 1000, 1 << 20):
        path = shared_path(spark, "w")
        warc.write_archives(df, path)
        got = {r.page_id: r for r in warc.read_archives(spark, path, split).collect()}
        assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == want
        assert all(r.payload_bytes == len((t or "").encode()) for i, _, t in rows for r in [got[i]])
        assert bytes(got[5].payload).decode() == fake and got[1].payload is None
    small = shared_path(spark, "w")
    warc.write_archives(df, small, min_bytes=5)
    assert {r.record_type for r in warc.read_archives(spark, small).collect()} == {"response"}
    empty = shared_path(spark, "w")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_cut_archive(spark, tmp_path):
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "part-0.txt").write_bytes((record(1, "abc") + record(2, "defg") + record(3, "x" * 500)[:-90]).encode())
    assert sorted(r.page_id for r in warc.read_archives(spark, f"file://{tmp_path}", 100).collect()) == [1, 2]


OPT, END, VAR = "<<beginOptional>>", "<<endOptional>>", '<<var;name="x";match=".{%d,%d}">>'


def test_license_automata():
    a = license_scan.Automaton(f"a {OPT}b {OPT}c{END}{END} d {VAR % (0, 3)} e")
    w = lambda s: s.encode().split()
    for text in ("a d e", "a b d e", "a b c d x e", "a d x y e"):
        assert a.match(w(text), 0) == len(w(text)), text
    for text in ("a c d e", "a d x y z e", "b d e", "a b"):
        assert a.match(w(text), 0) is None, text
    assert a.find(w("a d e q a b d e")) == [(0, 3), (4, 8)]
    for bad in (f"{OPT}x", f"x{END}", "<<opt>> x", f"{OPT}x{END}"):
        with pytest.raises(ValueError):
            license_scan.Automaton(bad)
    none = license_scan.Automaton(f"a {VAR % (0, 0)} b")
    assert none.match(w("a b"), 0) == 2 and none.match(w("a x b"), 0) is None


def as_regex(template):
    """The template as an ordinary regular expression over ' word word ', for tests."""
    out, at = "", 0
    for m in [*license_scan.MARK.finditer(template), None]:
        out += "".join(f"{w.decode()} " for w in license_scan.words_of(template[at : m.start() if m else None]))
        if m is None:
            return re.compile(" " + out)
        at = m.end()
        out += "(?:" if m[1] else ")?" if m[2] else "(?:[^ ]+ ){%d,%d}" % (int(m[3]) > 0, (int(m[4]) + 1) // 2)


def test_license_labels_by_brute_force():
    """Texts made from the templates, whole or with one word changed, against regular expressions."""
    import random

    rng = random.Random(3)
    for name, template in license_scan.TEMPLATES.items():
        a, brute = license_scan.Automaton(template), as_regex(template)
        for trial in range(6):
            words, skip = [], 0
            at = 0
            for m in [*license_scan.MARK.finditer(template), None]:
                if not skip:
                    words += [w.decode() for w in license_scan.words_of(template[at : m.start() if m else None])]
                if m is None:
                    break
                at = m.end()
                if m[1]:
                    skip += bool(skip) or trial % 2
                elif m[2]:
                    skip -= bool(skip)
                elif not skip:
                    words += [f"x{i}" for i in range(rng.randrange(int(m[3]) > 0, 1 + min(3, (int(m[4]) + 1) // 2)))]
            if trial > 2:
                words[rng.randrange(len(words))] = "other"
            words = ["and", "so", *words, "it", "goes"]
            got = bool(a.find([w.encode() for w in words]))
            assert got == bool(brute.search(" " + " ".join(words) + " ")), (name, trial)
            assert got or trial > 2, name


def test_license_places_of_long_text():
    words = ["mit", "license"] * 200_000
    joined = (" " + " ".join(words) + " ").encode()
    began = time.perf_counter()
    assert license_scan.places(joined, b" mit license ") == list(range(0, len(words), 2))
    assert time.perf_counter() - began < 5


def test_license_scan(spark):
    texts = ["Released under the MIT License.", "gnu general-public LICENSE x mit license", None, "", "Licensed under the Apache License, Version 2.0", "cc by cc by", "submit license", "ﬁ mit license"]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({x for _, x in hits}))), t
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
    assert got[0].labels == "mit,mit-notice" and got[4].labels == "apache,apache-2.0-notice" and got[2].score == 0.0


def test_language_scores(spark):
    docs = [(i, f"The cat {'sat on' if i % 2 else 'ate'} the mat W{i % 7}") for i in range(60)] + [(100, None), (101, ""), (None, "Été the"), (7, "\tx\x0by")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as chunk", "text as part")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for _, t in docs]
    rest = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 for i, _ in docs]
    count = Counter(w for t, r in zip(toks, rest) if r for w in t)
    n, v = sum(count.values()), len(count)
    want = {(i, t): (r == 0, len(k), sum(count[w] > 0 for w in k), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in k)) for (i, t), k, r in zip(docs, toks, rest)}
    for chunk in (8 << 20, 200):
        got = ngram_lm.score_documents(df, chunk_bytes=chunk).collect()
        assert len(got) == len(docs)
        for r in got:
            fits = [x for (i, _), x in want.items() if i == r.doc_id]
            assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4] and abs(r.base_score - x[4]) < 1e-9 for x in fits)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert ngram_lm.score_documents(df.limit(0)).count() == 0


def interpolated(docs, rounds=ngram_lm.ROUNDS):
    """Scores by the definition: exact counts, EM token by token. docs: (id, text)."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "</s>"] for _, t in docs]
    rest = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 for i, _ in docs]

    def counts(keep):
        word, pair, triple, starts = Counter(), Counter(), Counter(), 0
        for t, r in zip(toks, rest):
            if keep(r):
                word.update(t[1:])
                pair.update(zip(t, t[1:]))
                triple.update(zip(t, t[1:], t[2:]))
                starts += 1
        n, v = sum(word.values()), len(word)
        context = lambda x: starts if x == "<s>" else word[x]

        def of(t, i):
            before, c = pair[t[i - 2], t[i - 1]] if i > 1 else 0, context(t[i - 1])
            which = ngram_lm.CONTEXTS + bucket(before) if before else bucket(c)
            return which, (triple[t[i - 2], t[i - 1], t[i]] / before if before else 0.0, pair[t[i - 1], t[i]] / c if c else 0.0, word[t[i]] / max(n, 1), 1 / (v + 1))

        return of

    bucket = lambda c: min(ngram_lm.CONTEXTS - 1, c.bit_length())
    kept, every = counts(lambda r: r > 1), counts(lambda r: r > 0)
    held = {}
    for t, r in zip(toks, rest):
        if r == 1:
            for i in range(1, len(t)):
                b, p = kept(t, i)
                held.setdefault(b, []).append(p)
    weights = {}
    for b, ps in held.items():
        ps, w = np.array(ps), np.full(4, 1 / 4)
        for _ in range(rounds):
            each = w * ps
            w = np.maximum((each / each.sum(1)[:, None]).mean(0), 1e-6)
            w /= w.sum()
        weights[b] = w
    half = lambda b: b >= ngram_lm.CONTEXTS

    def nearest(b):
        same = [x for x in weights if half(x) == half(b)] or list(weights)
        return weights[min(same, key=lambda x: (abs(x - b), x))]

    out = []
    for t in toks:
        total = 0.0
        for i in range(1, len(t)):
            b, p = every(t, i)
            total += math.log10((nearest(b) if weights else np.full(4, 1 / 4)) @ np.array(p))
        out.append(total)
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 900])
def test_interpolated_scores_by_brute_force(spark, chunk):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    chain = {w: rng.choice(words, 5).tolist() for w in words}
    docs = []
    for i in range(150):
        w = [words[int(rng.integers(300))]]
        for _ in range(int(rng.integers(5, 60))):
            w.append(chain[w[-1]][int(rng.integers(5))] if rng.random() < 0.8 else words[min(299, int(rng.exponential(40)))])
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, docs[3][1]), (903, "unseen words only"), (5, "The W1 w2")]
    want = interpolated(docs)
    rows = ngram_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=chunk).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.score, r.n_tokens))
    for (i, _), s in zip(docs, want):
        assert any(abs(x - s) <= 0.01 * n for x, n in got[i]), (i, s, got[i])


def test_ngrams_stay_in_their_documents():
    import pyarrow as pa

    texts = ["a b c", "", "b", None, "c a b c d", "x y"]
    one = {t: ngram_lm.triples_of(*ngram_lm.tokens(pa.array([t], pa.string()))).tolist() for t in texts}
    for order in (texts, texts[::-1], texts[2:] + texts[:2]):
        got = ngram_lm.triples_of(*ngram_lm.tokens(pa.array(order, pa.string()))).tolist()
        assert got == [h for t in order for h in one[t]]


def test_interpolation_weights():
    side = ngram_lm.SIDE
    cells = np.array([((3 * side + 0) * side + 30) * side + 10, (3 * side * side + 0) * side + 10])
    at = np.array([[90, 0.0, 90 * -1.0, 90 * -4.0], [10, 0.0, 0.0, 10 * -4.0]])
    w = ngram_lm.learn(cells, at, 1e-6)
    assert abs(w.sum(1) - 1).max() < 1e-9 and w[3, 1] > 0.8 and (w[4] == w[3]).all() and (w[30] == w[3]).all()
    assert (ngram_lm.learn(np.zeros(0, np.int64), np.zeros((0, 4)), 1e-6) == 1 / 4).all()


def test_language_id(spark):
    en, fr, ru = "the cat sat on the mat with this thing and that", "le chat est sur la table avec une chose pour nous", "кошка сидит на столе и смотрит"
    docs = [(i, (en, fr, ru)[i % 3], ("en", "fr", "ru")[i % 3]) for i in range(60)]
    model = language_id.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr", "ru"]
    ask = [(1, "that cat and the mat", "fr"), (2, "une table pour le chat", None), (3, None, "en"), (4, "123 !! ½ ² ① Ⅷ", "en"), (5, "столе", "en"), (6, f"{en} {en} {fr} {fr} {fr}", "en"), (6, "", None)]
    got = {(r.doc_id, r.lang_pred): r for r in language_id.identify(spark.createDataFrame(ask, "doc_id long, text string, lang_pred string"), model).collect()}
    assert {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "ru"), (6, "fr"), (6, "und")} == set(got)
    spans = got[6, "fr"].spans
    assert [s.lang for s in spans] == ["en", "fr"] and spans[0].end == 22 and 0.5 < got[6, "fr"].score < 1
    nothing = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.identify(spark.createDataFrame(ask, "doc_id long, text string, x string"), nothing).collect()} == {"und"}


def test_letters():
    """Words are runs of letters by category, for both patterns."""
    import unicodedata

    for c in [*map(chr, range(1, 0x3000)), "①", "Ⅷ", "日", "𝟙", "𝔸", "〇", "一"]:
        letter = any(unicodedata.category(x)[0] == "L" for x in c.lower())
        assert bool(language_id.words_of(f" {c} ")) == letter, hex(ord(c))
        assert bool(language_id.words_of(f" {c} \u3000")) == letter


def test_viterbi():
    rng = np.random.default_rng(5)
    texts = [rng.normal(size=(n, 3)).astype(np.float32) for n in (1, 5, 0, 7, 6)]
    import itertools

    for s, path in zip(texts, language_id.viterbi(texts, 1.5)):
        value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert len(path) == len(s)
        if len(s):
            assert value(path) >= max(map(value, itertools.product(range(3), repeat=len(s)))) - 1e-4


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage = " ".join(f"the{i}" for i in range(60))
    own = lambda x: " ".join(f"the{x}{i}" for i in range(80)) + " "
    mine = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, own("a") + passage), (10**6 + 3, own("b") + passage + " and the"), (10**6 + 4, "and here the " + bench[0]), (10**6 + 5, docs.first().text)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in mine], docs.schema)).withColumn("k", docs.doc_id)
    seen = {}
    for name, stage in pipeline.STAGES:
        new = stage(spark, docs, SF)
        if name != pipeline.STAGES[-1][0]:
            assert new.columns == docs.columns
        new.write.parquet(path := shared_path(spark, name))
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert not {10**6, 10**6 + 1} & set(seen["language_id"]) and len(seen["language_id"]) > 190
    assert not {10**6 + 5, 0} <= set(seen["near_dedup"])
    assert "the30" not in seen["substring_dedup"][10**6 + 2].text and "the30" not in seen["substring_dedup"][10**6 + 3].text
    cut = seen["decontaminate"].get(10**6 + 4)
    assert cut is None or bench[0][20:60] not in cut.text
    assert set(seen["sentencepiece"]) == set(seen["decontaminate"])
    empty = docs.limit(0)
    docs0 = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs0 = stage(spark, docs0, SF)
        assert docs0.count() == 0
    assert empty.count() == 0

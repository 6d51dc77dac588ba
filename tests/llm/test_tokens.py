import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer

from vecloom.llm import token_binary as B
from vecloom.llm.common import shared_path


def library():
    t = Tokenizer.from_file(B.default_tokenizer())
    t.encode_special_tokens = True
    return t


def test_pretokens_as_the_library():
    code, t = B.Encoder(B.default_tokenizer()), library()
    texts = ["a" + c + c + "b 1" + c + " " + c + "x" for c in map(chr, range(1, 0x3200))] + ["it's we'll \n\n x", "  a\t\tb ", "<|endoftext|> x", "日本 1½²", "_a_ __", "'S 're"]
    got = code.encode(texts)
    for text, data, want in zip(texts, got, t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(data, code.kind).tolist() == want.ids, repr(text)


def test_round_trip(spark):
    rows = [(5, "five words are in here", 1), (1, None, 2), (3, "three " * 700, 3), (2, "", 4), (9, "last", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    path = shared_path(spark, "t")
    got = sorted(map(tuple, B.read_shards(B.write_shards(df, path, length=64, shard_bytes=2000), path).collect()))
    start, want, t = 0, [], library()
    for i, text, _ in sorted(rows):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = shared_path(spark, "t")
    assert B.read_shards(B.write_shards(df.limit(0), empty), empty).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d")], "doc_id long, text string")
    path = shared_path(spark, "t")
    got = B.read_shards(B.write_shards(df, path), path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 1] and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_added_tokens_as_by_default(spark):
    t = Tokenizer.from_file(B.default_tokenizer())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n\nb", "日本 <|endoftext|>語", "<|endoftext|", "plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = shared_path(spark, "t")
    got = sorted(map(tuple, B.read_shards(B.write_shards(df, path, length=64), path).collect()))
    start, want = 0, []
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want and want[0][2] == 5


def test_pieces_share_calls_of_the_library():
    """New words go through the library together, and words that were met in a text once don't again."""
    code, sent = B.Encoder(B.default_tokenizer(), special=True), []

    class Counting:
        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return tokenizer.encode_batch_fast(texts, **how)

    tokenizer, code.tokenizer = code.tokenizer, Counting()
    texts = [" ".join(f"{a}{b}{c}, x" for c in "abcdefghij") for a in "abcdefghij" for b in "abcdefghij"]
    want = [np.array(e.ids, code.kind).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert code.encode(texts) == want and len(sent) <= 1200 / 32
    sent.clear()
    assert code.encode(texts[::-1]) == want[::-1] and not sent


def test_places_where_texts_are_cut(monkeypatch):
    import random

    rng = random.Random(4)
    parts = [*" " * 6, *"\n\t\x0b\x85\xa0\u1680\u2003\u3000\u200b\x1c_'\u201c,.<|>19\xbdAstv\xe9\u0416\u4e2d\u0939\u3068\U0001f600", "'s", "'re ", "  ", "<|endoftext|>", "<|endof", "text|>", "word"]
    texts = ["", " ", "a"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    for special in (True, False):
        code, t = B.Encoder(B.default_tokenizer(), special), Tokenizer.from_file(B.default_tokenizer())
        t.encode_special_tokens = not special
        want = [np.array(e.ids, code.kind).tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        assert code.encode(texts) == want
        monkeypatch.setattr(B, "CACHE_PIECES", 500)
        assert [x for a in range(0, len(texts), 100) for x in code.encode(texts[a : a + 100])] == want and len(code) < 2000
        monkeypatch.undo()
    assert code.encode([]) == [] and code.encode([""]) == [b""] and code.encode([None, "a", None])[::2] == [b"", b""]

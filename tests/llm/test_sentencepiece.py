import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from vecloom.llm.sentencepiece_codec import Codec, decode_documents, default_model, encode_documents


@pytest.fixture(scope="module")
def both():
    return Codec(default_model()), sentencepiece.SentencePieceProcessor(model_file=default_model())


def test_as_the_library(both):
    codec, library = both
    rng = random.Random(1)
    bits = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "▁", "日本", "😀", "́", "123", "<0x0A>", "<s>", "aaaa", "ing", "\x00", "#", "    ", "\r\n", "가", "².", "²a"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(1500)]
    pieces = list(codec.ids)
    texts += ["".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randrange(10))) for _ in range(1500)]
    texts += ["", " ", "a" * 3000, " " * 50, "x" + " " * 9 + "y", "\n" * 5]
    for t in texts:
        ids = library.encode(t)
        assert codec.encode(t) == ids, repr(t)
        assert codec.decode(ids) == library.decode(ids), repr(t)


def test_documents(spark, both):
    _, library = both
    rows = [(1, "Hello  world", 5), (2, None, 6), (2, "", 7), (None, "é\n日", 8), (1, "Hello  world", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, tuple(r.ids)) for r in encode_documents(df).collect()}
    assert got == {(i, tuple(library.encode(t or ""))) for i, t, _ in rows}
    assert encode_documents(df.limit(0)).count() == 0
    back = decode_documents(encode_documents(df))
    assert {r.decoded for r in back.collect()} == {"Hello  world", "", "é\n日"}

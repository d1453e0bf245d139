"""Token counts and piece ids against the public library, and round trips."""

import random

import pytest

from tangentia.llm.queries import model_path
from tangentia.llm.sentencepiece_codec import decode_pieces, encode_pieces
from tangentia.llm.token_counts import token_counts
from samples import ODD


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def texts():
    rng = random.Random(1)
    words = ["the", "Ofthion", "été", "日本語", "ſ", "🙂", "<s>", "</s>", "  ", "\t", "\n", "a" * 40, "0x1F", "—", "\u0000"]
    return [t for _, t in ODD] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)] + ["the" * 1500, " " * 3000, "é" * 500]


def test_ids_and_counts_are_the_librarys(spark, docs_of, library):
    rows = list(enumerate(texts()))
    docs = docs_of(rows)
    ids = {r["doc_id"]: r for r in encode_pieces(docs, model_path(), verify=True).collect()}
    counts = {r["doc_id"]: r for r in token_counts(docs, model_path()).collect()}
    for i, t in rows:
        expected = library.encode(t or "")
        assert list(ids[i]["piece_ids"]) == expected and ids[i]["round_trip"]
        assert counts[i]["n_tokens"] == len(expected) and counts[i]["n_bytes"] == len((t or "").encode())


def test_decoding(spark, docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(texts())])
    back = decode_pieces(encode_pieces(docs, model_path()), model_path()).select("text", "decoded").collect()
    assert all((r["text"] or "") == r["decoded"] for r in back)


def test_odd_rows_and_empty_tables(spark, docs_of):
    assert token_counts(docs_of(ODD), model_path()).count() == len(ODD)
    assert encode_pieces(docs_of([]), model_path(), verify=True).count() == 0
    assert token_counts(docs_of([]), model_path()).count() == 0

"""SentencePiece encoding and decoding, held against the library."""

import hashlib
import random

import numpy as np
import sentencepiece
from barloom.llm import pieces
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

PROCESSOR = pieces.load("piece_bpe_32k.model")
ENCODER = pieces.Encoder(PROCESSOR)


def same(text):
    return np.frombuffer(ENCODER.encode(text), "<u4").tolist() == PROCESSOR.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    assert same(text)


def test_pieces_in_a_row():
    random.seed(7)
    parts = [PROCESSOR.id_to_piece(i) for i in range(259, 32000, 3)] + [" ", "  ", "▁", "\n", "\0", "</s>", "<s>", "<0x41>", "\U0001f600", "क्", "².", " ", "　"] * 300
    for _ in range(4000):
        assert same("".join(random.choice(parts) for _ in range(random.randrange(12))))


def test_long_texts_without_white_space():
    random.seed(8)
    for text in (" " * 999, "=" * 777, "a" * 50_000, "ab" * 20_000, "".join(random.choice("etaoinshrdlu") for _ in range(50_000)), "\n" * 3000, "漢" * 3000):
        assert same(text)


def test_places_that_failed_are_left(monkeypatch):
    """Backtracking happens, and no place is tried again after it has failed: the work stays in proportion to the text."""
    tries = []
    encoder = pieces.Encoder(PROCESSOR)
    fit = encoder._fit
    monkeypatch.setattr(encoder, "_fit", lambda a, b: tries.append((a, b)) or fit(a, b))
    monkeypatch.setattr(pieces, "REMEMBERED", 1)
    rng = random.Random(3)
    text = "▁" + "".join(rng.choice("aeinrst") for _ in range(3000))
    out = encoder.backtrack(text)
    assert out == PROCESSOR.encode(text[1:])
    assert len(out) < len(tries) < 4 * len(text)


def test_fit_is_plain_merging():
    random.seed(9)
    known = list(ENCODER.text)
    score = ENCODER.score
    near = [i for i in known if ENCODER.text[i].strip("▁").isascii()][:3000]
    for _ in range(4000):
        a, b = random.choice(near), random.choice(near)
        alone = [ENCODER.text[a], ENCODER.text[b]]
        assert ENCODER._fit(a, b) == (pieces.merges("".join(alone), score)[-1][1] == alone)


def test_query_and_odd_rows(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=__import__("public_tokenizers").path("piece_bpe_32k.model"))

    def plain(text):
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    def rows(df):
        return sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect()), key=str)

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(pieces.op13_pieces(spark, "/root/testdata/sf0.001")) == sorted(((False, r["doc_id"], *plain(r["text"])) for r in docs.collect()), key=str)
    digest = lambda df: pieces.decode_ids(pieces.encode_texts(df)).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    odd = odd.withColumns({"ids": F.lit(0), "n_tokens": F.lit("x"), "decoded": F.lit(1)})
    assert rows(digest(odd)) == sorted(((r["doc_id"] is None, r["doc_id"], *plain(r["text"])) for r in odd.collect()), key=str)
    assert digest(odd.where("false")).count() == 0
    assert pieces.decode_ids(spark.createDataFrame([(1, None)], "k int, ids binary")).collect() == [(1, None, None)]

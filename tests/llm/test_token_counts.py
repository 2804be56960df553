"""Token counts against the library."""

import random

import public_tokenizers as P
import pytest
import sentencepiece

from worktally.llm import token_counts as T

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library(spark, library):
    r = random.Random(1)
    parts = ["the ", "größe", "\n\n", "don't", "  ", "   ", "▁", "œuvre", "漢字", "x²", "\x00", "\x85", "\xa0", "42", "<s>", "</s>", "<0x0A>", "<unk>", "_a_", "…", "\t ", "½", "🤷‍♂️", "é", "internationalization"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 200))), 0) for i in range(150)]
    rows += [(None, None, 1), (7, "", 2), (7, "", 2), (8, " ", 0), (9, "a" * 20_000, 3), (9, " " * 3_001, 3), (10, "ab" * 3_000 + " word" * 300_000, 4), *rows[:5]]
    got = T.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), MODEL, 1000).collect()
    want = []
    for d, t, _ in rows:
        n = len(library.encode(t or ""))
        want.append((repr(d), len((t or "").encode()), n, n > 1000))
    assert sorted((repr(x.id), x.n_bytes, x.n_tokens, x.over_limit) for x in got) == sorted(want)
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL, 1).count() == 0


def test_words_of_random_letters(library):
    r = random.Random(2)
    pieces = T.Pieces(MODEL)
    plain = [x.replace(T.SPACE, " ") for x in pieces.ranks]
    for _ in range(3_000):
        text = "".join(r.choice(plain) for _ in range(r.randint(1, 12)))
        assert pieces.count(text) == len(library.encode(text)), text
    assert pieces.count("") == 0


def test_memory_of_words_is_bounded(monkeypatch, library):
    monkeypatch.setattr(T, "CACHE", 10)
    monkeypatch.setattr(T, "LONG", 50)
    pieces = T.Pieces(MODEL)
    text = " ".join(f"word{i} longer{i}" + "z" * (i % 90) for i in range(200))
    assert pieces.count(text) == len(library.encode(text)) and len(pieces) <= 10
    assert all(len(w) <= T.KEPT for w in pieces)

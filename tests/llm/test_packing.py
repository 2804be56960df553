import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from worktally.llm import packing as K

RANKS = P.path("byte_bpe_50k.tiktoken")


def check(spark, rows, size, **more):
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = more.get("markers") == {}
    got = K.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, P.PATTERN, size=size, **more).collect()
    want = []
    for d, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        a, b, k = 0, (len(ids) - 1) % size + 1, 0
        while a < len(ids):
            want.append((repr(d), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            a, b, k = b, b + size, k + 1
    assert sorted((repr(r.id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= size
    return len(seqs), sum(w[3] for w in want)


def test_round_trip(spark):
    r = random.Random(1)
    parts = ["the ", "größe", "\n\n", "don't", "  ", "œuvre", "漢字", "x²", "\x1c", "\x85", "\xa0", "42", "<|endoftext|>", "_a_", "…", "\t ", "½", "Ⅷ", "é"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 200)))) for i in range(80)]
    rows += [(None, None), (7, ""), (7, ""), (9, "a" * 5000), (None, "word " * 3000)]
    rows += [(300, "<|endoftext|>"), (301, "a <|endoftext|><|endoftext|>  b\n<|endoftext|> x <|endoftext"), (302, "é <|endoftext|>漢")]
    check(spark, rows, 64, markers={})
    n, total = check(spark, rows, 128)
    assert n <= 1.05 * total / 128 + 1
    assert K.pack_documents(spark.createDataFrame([], "doc_id long, text string, shard int"), RANKS, P.PATTERN).count() == 0


def test_copies_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 100)
    rows = [(1, "the same document")] * 2000 + [(i, f"another {i}") for i in range(2, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = K.pack_documents(docs, RANKS, P.PATTERN, size=128).collect()
    assert Counter(r.id for r in got) == Counter(d for d, _ in rows)
    assert max(Counter(r.sequence_id >> 32 for r in got).values()) <= 200


def test_search_tries_equal_bins_once():
    lengths = np.array([600] * 2_000 + [400] * 2_000 + [390] * 2_250 + [500] * 1_500)
    begin = time.time()
    after = K.swap_search(K.best_fit(lengths, 1024), lengths, 1024)
    assert sorted(i for b in after for i in b) == list(range(len(lengths))) and time.time() - begin < 10


@pytest.mark.parametrize("seed", range(3))
def test_search_never_worsens(seed):
    r = np.random.default_rng(seed)
    lengths = np.concatenate([r.integers(1, 101, 300), r.integers(30, 60, 300)])
    bins = K.best_fit(lengths, 100)
    n, before = len(bins), sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    after = K.swap_search([list(b) for b in bins], lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(600))
    assert all(sum(lengths[i] for i in b) <= 100 for b in after)
    assert len(after) <= n and sum(sum(lengths[i] for i in b) ** 2 for b in after) >= before

"""Repeated byte strings against a brute-force version."""

import random

import pytest

from worktally.llm.suffix_dedup import repeats


def brute(rows, k=50):
    first = {}
    far = float("inf")
    data = [(far if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - k + 1):
            s = b[i:i + k]
            first[s] = min(first.get(s, far), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if first[b[i:i + k]] < d:
                gone[i:i + k] = b"\1" * k
        spans, i = [], 0
        while i < len(b):
            if gone[i]:
                j = i
                while j < len(b) and gone[j]:
                    j += 1
                spans.append((i, j - i))
                i = j
            else:
                i += 1
        out.append((None if d == far else d, len(b), tuple(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.n_bytes, tuple((s.start, s.length) for s in r.spans), bytes(r.kept)) for r in repeats(df, **more).collect()]
    key = repr
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    word = ["ab", "the", "größe", "x", "ction", "\0", "\n", "é", "no no"]
    text = lambda n: " ".join(r.choice(word) for _ in range(n))
    shared = [text(n) for n in (8, 12, 20, 40, 200)]
    rows = []
    for i in range(120):
        parts = [text(r.randint(0, 30)) for _ in range(r.randint(1, 4))]
        if r.random() < 0.7:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        rows.append((r.randint(0, 150), "".join(parts)))
    rows += [(500 + i, rows[3][1]) for i in range(30)]  # a group of copies
    check(spark, rows, block_bytes=4000)


def test_edges(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(30_000))
    rows = [(1, None), (2, ""), (None, "a" * 200), (3, "a" * 200), (4, "a" * 49), (5, "a" * 51), (6, long), (7, long[5:] + "z"),
            (7, long[:100]), (8, "é" * 60), (9, "é" * 25), (2, "a" * 120)]
    check(spark, rows)
    check(spark, rows, block_bytes=64)


def test_empty_table_and_extra_columns(spark):
    assert repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "x" * 60, 5, "s")], "doc_id long, text string, block int, id string")
    assert [len(r.kept) for r in repeats(df).collect()] == [60]

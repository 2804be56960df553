"""Near-duplicate components against a brute-force version."""

import random
import re

import pytest

from worktally.llm.jaccard_join import near_duplicates


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    far = 1 << 70
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), far), far if d is None else d)
    return sorted([(repr(d), len(s), repr(None if low[find(i)] == far else low[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))])


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.id), r.n_shingles, repr(r.component_id)) for r in near_duplicates(df, **more).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("seed,cut", [(0, None), (1, 3)])
def test_equals_brute_force(spark, seed, cut, monkeypatch):
    if cut:  # many small tasks under a hub
        monkeypatch.setattr("worktally.llm.jaccard_join.STRAYS", cut)
        monkeypatch.setattr("worktally.llm.jaccard_join.MEMBERS", cut + 2)
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = text(30)
    rows, base = [], [text(r.randint(20, 120)) for _ in range(6)]
    for b in base:
        for _ in range(25):  # copies that drift: some link with the base, some only with each other
            c = list(b)
            for _ in range(r.randint(0, 4)):
                c[r.randrange(len(c))] = r.choice(vocab)
            rows.append(" ".join(c))
    for _ in range(40):
        rows.append(" ".join(text(20) + shared + text(r.randint(0, 9))))
    rows += ["a b c", "A  b\tc", "a b", "solo", "solo", *rows[:20]]
    r.shuffle(rows)
    check(spark, [(r.randint(0, 10_000), t) for t in rows], block_bytes=5000)


def test_edges(spark):
    long = " ".join(f"x{i % 9000}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (4, "a b c d e f"), (None, "only"), (None, "other"), (7, long), (8, long + " y"), (7, "q r s t u v")]
    check(spark, rows)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string, n int")).count() == 0

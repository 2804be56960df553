"""The byte model against a plain recursive one, and word counts against a dictionary."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from worktally.llm.ppm import ORDER, score


def brute(rows):
    low = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    follow = [defaultdict(Counter) for _ in range(ORDER + 1)]
    words = Counter()
    tokens = lambda b: [*re.findall(rb"[^\x20\x09-\x0D]+", b), None]
    for _, t, train in rows:
        if train:
            words.update(tokens(low(t)))
            x = bytes(ORDER) + low(t) + b"\xff"
            for i in range(ORDER, len(x)):
                for k in range(ORDER + 1):
                    follow[k][x[i - k:i]][x[i]] += 1

    def p(x, i):
        out, excluded = 0.0, set()
        for k in range(ORDER, -1, -1):
            f = follow[k].get(x[i - k:i])
            if not f:
                continue
            d = len(f) - len(excluded)
            n = sum(c for s, c in f.items() if s not in excluded) + d
            if x[i] in f:
                return out + math.log10(f[x[i]] / n)
            if d:
                out += math.log10(d / n)
            excluded = set(f)
        return out - math.log10(256 - len(excluded))

    n, v = sum(words.values()), len(words)
    out = []
    for d, t, train in rows:
        x, tk = bytes(ORDER) + low(t) + b"\xff", tokens(low(t))
        out.append((d, len(tk), sum(words[w] > 0 for w in tk), sum(math.log10(words[w] + 1) for w in tk),
                    sum(p(x, i) for i in range(ORDER, len(x))), n, v))
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = [(r.id, r.n_tokens, r.n_known, r.known_log, r.score, r.train_tokens, r.vocabulary) for r in score(df, F.col("learn"), **more).collect()]
    want = brute(rows)
    key = lambda r: (repr(r[0]), r[1], round(r[4], 2))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[5:] == w[5:]
        assert abs(g[3] - w[3]) < 1e-6 and abs(g[4] - w[4]) < 1e-3 * max(1, len(rows)), (g, w)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("worktally.llm.ppm.GROUP", 3)
    r = random.Random(3)
    bits = ["the ", "Tion", "é", "a", " b", "\n", "ing ", "größe", "zz"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60))), i % 7 != 2) for i in range(60)]
    rows += [(None, None, True), (5, "", False), (5, "", False), (9, "\0\0a\0", True), (9, "x" * 3000, False)]
    check(spark, rows, block_bytes=900)


def test_nothing_to_learn_and_empty(spark):
    rows = [(1, "abc d", False), (2, None, False)]
    check(spark, rows)
    assert score(spark.createDataFrame([], "doc_id long, text string, learn boolean"), F.col("learn")).count() == 0

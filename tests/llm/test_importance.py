"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from worktally.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, max_n, buckets):
    w = WORD.findall((text or "").translate(LOW))
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)


def brute(rows, target, percent, min_words, max_n, buckets, seed):
    raw, aim = Counter(), Counter()
    for _, t in rows:
        raw.update(features(t, max_n, buckets)[0])
    for t in target:
        aim.update(features(t, max_n, buckets)[0])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for d, t in rows:
        f, n = features(t, max_n, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], 2**63 - 1 if x[0] is None else x[0]))
    return out, able[:percent * len(able) // 100]


def check(spark, rows, target, percent=30, min_words=5, max_n=1, buckets=50, seed=2024):
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int")
    got = I.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, min_words, max_n, buckets, seed).collect()
    want, drawn = brute(rows, target, percent, min_words, max_n, buckets, seed)
    assert sorted((repr(x.id), x.n_words, x.n_features, x.weight, x.score) for x in got) == sorted((repr(x[0]), *x[1:]) for x in want)
    ranked = sorted((x for x in got if x.rank), key=lambda x: x.rank)
    assert [x.rank for x in ranked] == list(range(1, len(drawn) + 1))
    assert [(x.id, x.score) for x in ranked] == [(x[0], x[4]) for x in drawn]
    return ranked


def test_equals_brute_force(spark):
    r = random.Random(5)
    vocab = ["The", "the", "größe", "Ä", "42", "a1b", "x", "漢字", "\xa0", "é", "o'clock", "\x00", "zz-top", "İ"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "..."]) for _ in range(n))
    rows = [(i, text(r.randint(0, 40))) for i in range(150)]
    rows += [(None, None), (None, text(30)), (3, text(20)), (3, ""), (900, "word " * 100_000), *rows[:10]]
    target = [text(r.randint(0, 30)) for _ in range(20)] + [None, ""]
    for max_n in (1, 2, 3):
        assert check(spark, rows, target, max_n=max_n)
    assert not check(spark, rows, target, percent=0)
    check(spark, rows, target, percent=100)
    check(spark, rows, [], percent=50)


def test_equal_scores_are_ranked_by_id(spark, monkeypatch):
    """Rows of one score in several runs of ids, as a hot score has them."""
    monkeypatch.setattr("worktally.operators.grouping.RUN", 8)
    rows = spark.range(500).select((F.col("id") * 7 % 501).alias("id"), F.lit(30).alias("n_words"), (F.col("id") % 3 % 2).cast("long").alias("score"))
    got = [(x.rank, x.score, x.id) for x in I.draw(rows, 70, 20).where("rank is not null").orderBy("rank").collect()]
    want = sorted(((-x.score, x.id) for x in rows.collect()))[:350]
    assert got == [(i + 1, -s, d) for i, (s, d) in enumerate(want)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert I.resample(none, none).count() == 0
    short = spark.createDataFrame([(1, "few words")], "doc_id long, text string")
    assert [x["rank"] for x in I.resample(short, none).collect()] == [None]

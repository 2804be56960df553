"""Operators made of built-in functions only, against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from worktally.llm import line_dedup, quality_llr, replication, url_rules
from worktally.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def h64(x, seed=42):
    v = x.encode() if isinstance(x, str) else (x & (2**64 - 1)).to_bytes(8, "little")
    n = xxhash.xxh64_intdigest(v, seed)
    return n - 2**64 if n >= 2**63 else n


# quality_llr

def grams(text, m=quality_llr.BUCKETS):
    h = [h64(w) for w in WORD.findall(text or "")]
    return [x % m for x in h] + [h64(b, h64(a) & (2**64 - 1)) % m for a, b in zip(h, h[1:])]


def test_quality_equals_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(60)] + ["é#", "$a|", "Ab"]
    run = " ".join(r.choice(vocab) for _ in range(12))
    rows = [(i, "".join(r.choice(vocab) + r.choice([" ", "\n", " \t"]) for _ in range(r.randint(0, 80))) + (run + "\n") * r.randint(0, 4)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a b c d e f g h " * 3), (103, "x\nx\n\n x\nx"), (None, "q " * 40), (102, "dup id"), (102, "dup id"), (104, "z" * 50_000)]
    docs = spark.createDataFrame([(*x, 1.5) for x in rows], "doc_id long, text string, llr double")
    trusted = {i for i in range(0, 60, 2)} | {102}
    weight = quality_llr.weights(docs, spark.createDataFrame([(i,) for i in trusted] * 2 + [(None,)], "doc_id long"))
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in trusted:
            target.update(grams(t))
    m, n_raw, n_target = quality_llr.BUCKETS, sum(raw.values()), sum(target.values())
    want = [round(1e6 * (math.log((target[b] + 1) / (raw[b] + 1)) + math.log((n_raw + m) / (n_target + m)))) for b in range(m)]
    assert all(abs(a - b) <= 1 for a, b in zip(weight, want, strict=True))
    got = []
    for x in quality_llr.judge(docs, weight, -0.01).collect():
        got.append((repr(x.doc_id), x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, round(x.llr, 9), x.kept))
    out = []
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = grams(t)
        llr = sum(weight[b] for b in g) / len(g) / 1e6 if g else 0.0
        bad = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        out.append((repr(d), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), bad, round(llr, 9), not bad and llr >= -0.01))
    assert sorted(got) == sorted(out)


def test_quality_without_trusted(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert set(quality_llr.weights(docs, none)) == {0}
    assert quality_llr.judge(docs.limit(0), [0] * quality_llr.BUCKETS, 0).count() == 0


# line_dedup

def brute_lines(rows, k):
    """(id, text, lines deleted, lines) of each row: a line goes if a run of k words or more that holds it stands earlier."""
    docs = {}
    for d, t in rows:
        docs.setdefault((2**63 - 1 if d is None else d, h64(t or "")), t or "")
    full = {key: [(i, x, len(WORD.findall(x))) for i, x in enumerate(docs[key].split("\n")) if WORD.search(x)] for key in sorted(docs)}
    places = {}
    for key in full:
        for i, x in enumerate(full[key]):
            places.setdefault(x[1], []).append((key, i))
    gone = {key: set() for key in full}
    for key, lines in full.items():
        for i, x in enumerate(lines):
            for other, j in places[x[1]]:
                theirs = full[other]
                if (other, j) >= (key, i) or i and j and lines[i - 1][1] == theirs[j - 1][1]:
                    continue  # not earlier, or not the start of the common run
                n = 0
                while i + n < len(lines) and j + n < len(theirs) and lines[i + n][1] == theirs[j + n][1]:
                    n += 1
                if sum(x[2] for x in lines[i:i + n]) >= k:
                    gone[key] |= set(range(lines[i][0], lines[i + n - 1][0] + 1))
    out = []
    for d, t in rows:
        lines, g = (t or "").split("\n"), gone[2**63 - 1 if d is None else d, h64(t or "")]
        out.append((repr(d), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in g), len(g), 0 if t is None else len(lines)))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark):
    r = random.Random(4)
    line = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 8)))
    shared = ["\n".join(line() for _ in range(n)) for n in (1, 3, 6, 12)]
    rows = []
    for i in range(80):
        parts = [line() for _ in range(r.randint(0, 5))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        rows.append((r.randint(0, 60), "\n".join(parts)))
    rows += [(None, None), (None, rows[0][1]), (3, None), (90, "x y\n" * 300), (91, rows[5][1]), (91, rows[5][1]), (92, ""), (93, "\n\n"), (94, "\n".join(f"long {i % 1700}" for i in range(3_000)))]
    df = spark.createDataFrame([(*x, 0, "d", "g", "r") for x in rows], "doc_id long, text string, n_lines int, doc string, gone string, run string")
    assert line_dedup.dedup_lines(df).columns == ["doc_id", "text", "doc", "gone", "run", "n_lines", "n_removed", "words_removed"]
    assert {tuple(x) for x in line_dedup.dedup_lines(df).select("doc", "gone", "run").collect()} == {("d", "g", "r")}
    got = sorted([(repr(x.doc_id), x.text, x.n_removed, x.n_lines) for x in line_dedup.dedup_lines(df, min_words=10).collect()], key=repr)
    assert got == brute_lines(rows, 10)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_runs(rows, k):
    """Numbers of the lines in any run of k words or more that stands earlier, for rows of different ids."""
    docs = {d: [(i, x, len(WORD.findall(x))) for i, x in enumerate(t.split("\n")) if WORD.search(x)] for d, t in rows}
    first, gone = {}, {d: set() for d in docs}
    spans = [(d, a, b) for d in sorted(docs) for a in range(len(docs[d])) for b in range(a + 1, len(docs[d]) + 1)]
    for d, a, b in spans:
        if sum(x[2] for x in docs[d][a:b]) >= k and first.setdefault(tuple(x[1] for x in docs[d][a:b]), (d, a)) < (d, a):
            gone[d] |= set(range(docs[d][a][0], docs[d][b - 1][0] + 1))
    return sorted((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(gone[d])) for d, t in rows)


def test_whole_runs_are_deleted(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(10))
    own = " ".join(f"c{i}" for i in range(55))
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n \n{b}\n{own}"), (3, f"{b}\n{own[3:]}")]
    out = lambda rows, **more: sorted((x.doc_id, x.text, x.n_removed) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect())
    assert out(rows) == [(1, rows[0][1], 0), (2, own, 3), (3, rows[2][1], 0)]
    r = random.Random(9)
    line = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 8)))
    shared = ["\n".join(line() for _ in range(n)) for n in (1, 3, 6, 12)]
    rows = []
    for i in range(50):
        parts = [line() for _ in range(r.randint(0, 5))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        rows.append((i, "\n".join(parts)))
    rows.append((90, "x y\n" * 30))
    want = brute_runs(rows, 10)
    assert out(rows, min_words=10) == want
    assert [(int(d), t, n) for d, t, n, _ in sorted(brute_lines(rows, 10), key=lambda x: int(x[0]))] == want


# url_rules

def test_urls_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "PART", 20)
    r = random.Random(5)
    rules = [("org", "/", "allow"), ("a.org", "/x/", "block"), ("a.org", "/x/y", "allow"), ("a.org", "/x/y/z", "block"), ("com", "", "block"),
             ("b.com", "/é", "allow"), ("ORG", "/x", "block"), ("b.com", "/é", "block")]
    hosts = ["a.org", "w.a.org", "B.com", "ba.org", "org", "x.b.COM", "net", "", "a..org", "a.org:80"]
    urls = [f"{r.choice(['http', 'x'])}://{r.choice(hosts)}{r.choice(['', '/', '/x', '/x/', '/x/y', '/x/yy', '/x/y/z1', '/é/q', '/x/\U0010ffff'])}{r.choice(['', '?q=/', '#f', '?a://b'])}" for _ in range(400)]
    urls += [None, "", "a.org/x/", "://", "http://a.org", "http://a.org/x/" + "y" * 40_000, *urls[:30]]
    df = spark.createDataFrame([(i % 100, u, "s", "b", "a") for i, u in enumerate(urls)], "page_id long, url string, rule string, b string, at string")
    got = [(x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()]
    low = {}
    for h, p, v in rules:
        low[h.lower(), p] = min(v, low.get((h.lower(), p), v))
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = host.lower()
        fit = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in low.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i % 100, host, path, *(max(fit)[2:] if fit else (None, "allow"))))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert url_rules.judge(df.limit(0), spark.createDataFrame([], "host string, path string, verdict string")).count() == 0
    out = url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert out.columns == ["page_id", "url", "b", "at", "host", "path", "rule", "verdict"]
    assert {tuple(x) for x in out.select("b", "at").collect()} == {("b", "a")}
    # a hot host is dealt to its parts: the sweep's window reads an exchange by host and part
    plan = out._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1]
    sweep = plan[plan.index("Window [last(open"):]
    below = next(x for x in sweep.split("\n")[1:] if not re.search("Sort|InputAdapter|Codegen", x))
    assert re.search(r"Exchange hashpartitioning\(at#\d+, part#\d+", below), below


# replication

def test_replication_equals_brute_force(spark):
    r = random.Random(6)
    rows = [(i, f"t{i}", r.choice(["hot"] * 6 + ["a", "b", None]), 9) for i in range(400)] + [(None, None, "a", 1), (5, "x", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place int")
    weights = {"hot": 1.0, "a": 2.0, "b": 0.0}
    got = Counter((repr(x.doc_id), x.source, x.copy) for x in replication.replicate(df, 3, spark.createDataFrame(list(weights.items()), "source string, weight double"), 1000).collect())
    n = Counter(x[2] for x in rows)
    want = Counter()
    for d, _, s, _ in rows:
        rate = weights.get(s, 0) / sum(weights.get(k, 0) for k in n) * 1000 / n[s]
        u = int(hashlib.md5(f"3:{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u and rate:
            k += 1
            p *= rate / k
            total += p
        want.update((repr(d), s, c) for c in range(1, k + 1))
    assert got == want
    out = replication.replicate(df).select("place", "rate").collect()
    assert [x.place for x in out] == sorted(x.place for x in out)
    assert replication.replicate(df.limit(0)).count() == 0


def test_steps_of_large_rates(spark):
    rate = 40_000.0
    x = spark.range(1).select(replication.first_step(F.lit(rate)).alias("first"), replication.poisson_steps(F.lit(rate)).alias("steps")).first()
    logs = [0.0, *itertools.accumulate(math.log(k) for k in range(1, 43_000))]
    want = list(itertools.accumulate(math.exp(k * math.log(rate) - rate - logs[k]) for k in range(43_000)))
    assert len(x.steps) < 30 * rate ** 0.5 and want[x.first - 1] < 2**-52
    assert all(abs(a - b) < 1e-9 for a, b in zip(x.steps, want[x.first:]))


def test_mix_shuffles_whole_texts(spark, monkeypatch, tmp_path):
    rows = [(i, f"t{i % 40}" if i % 9 else None, "ab"[i % 3 == 0], "en", 2) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["op4_poisson_mix"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    above, below = re.split(r"RepartitionByExpression.*", plan)
    assert "md5(cast(text" in above and re.search(r"Project \[[^\n]*\btext#", below.split("Generate")[0])
    whole = replication.replicate
    monkeypatch.setattr(replication, "replicate", lambda *a, **b: whole(*a, **b).withColumn("text", F.lit("t1")))
    with pytest.raises(Exception, match="text of a copy"):
        QUERIES["op4_poisson_mix"](spark, str(tmp_path)).collect()

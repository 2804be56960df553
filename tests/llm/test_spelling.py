"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from worktally.llm import spelling as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows, every=97, min_chars=5, min_count=3, ratio=2):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def found(docs, **more):
    return sorted((x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in S.variants(docs, **more).collect())


def corpus(r):
    stems = ["maison", "häuser", "house", "houses", "banana", "aaaaa", "aaaaaa", "Straße", "receive", "été", "abcab", "ÀÿÀÿÀ", "mississippi"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(r.randint(0, 60)):
            w = r.choice(stems)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                p, c = r.randrange(len(w) + 1), r.choice("aeséß")
                w = r.choice([w[:p] + c + w[p:], w[:p] + w[p + 1:], w[:p] + c + w[p + 1:]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "-", "1", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("rare", [8, 1])
def test_equals_brute_force(spark, monkeypatch, rare):
    monkeypatch.setattr(S, "RARE", rare)
    r = random.Random(rare)
    rows = corpus(r)
    rows += [(None, None), (5, ""), (None, rows[3][1]), *rows[:9], (200, "verylong" * 4_000 + " house" * 50_000), (201, "x" * 5_000 + " " + "x" * 5_001), *[(202, "x" * 5_000)] * 3, *[(203, "x" * 5_001)] * 7]
    docs = spark.createDataFrame([(*x, "w") for x in rows], "doc_id long, text string, word string")
    for more in ({"every": 3}, {"every": 0, "min_count": 1, "min_chars": 1}):
        got = found(docs, **more)
        assert got == brute(rows, **more) and any(x[3] for x in got) and any(x[5] != x[3] for x in got if x[3])
    assert found(docs) == brute(rows)
    assert found(docs.limit(0)) == []


def test_long_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "LIST", 4)
    rows = corpus(random.Random(7))
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), min_count=1) == brute(rows, min_count=1)


def test_chains_of_forms(spark):
    chain = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(i, " ".join([w] * 3 * 2**i)) for i, w in enumerate(chain)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), every=0)
    assert {x[5] for x in got} == {"abcdefghij"} and [x[3] for x in got] == [*chain[1:], None]


def test_dictionary_holds_the_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(S, "RARE", 2)
    words = ["banana", "bandana", "anabel", "cabana"]
    got = S.dictionary(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    marked = [S._marked(w, S.marks(5)) for w in words]
    n = Counter(m[i:i + q] for m in marked for q in (3, 4) for i in range(len(m) - q + 1))
    assert got == {g: c for g, c in n.items() if c >= 2} and {len(g) for g in got} == {3, 4}
    monkeypatch.setattr(S, "GRAMS", 20)
    assert len(S.dictionary(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))) <= 20


letters = st.text("abc", min_size=5, max_size=12)


@settings(max_examples=400, deadline=None)
@given(letters, st.integers(0, 12), st.sampled_from("abc"), st.integers(0, 2), st.sets(st.text("abc\x02\x03", min_size=3, max_size=4)))
def test_bound_holds_for_any_dictionary(a, p, c, kind, longer):
    """The grams that one edit leaves alone stand in the other word too, and each keeps one at least."""
    p = min(p, len(a) - 1)
    b = [a[:p] + c + a[p:], a[:p] + a[p + 1:], a[:p] + c + a[p + 1:]][kind]
    if a == b or len(b) < 5:
        return
    ends = S.marks(5)
    longer = {g[:k] for g in longer for k in range(3, len(g) + 1)}
    x, y = S.decompose(S._marked(a, ends), longer), S.decompose(S._marked(b, ends), longer)
    shared = sum((Counter(g for _, g in x) & Counter(g for _, g in y)).values())
    least = max(len(x) - S.affected(x, ends, len(a)), len(y) - S.affected(y, ends, len(b)))
    assert shared >= least >= 1
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    first = lambda w: sorted(S.decompose(S._marked(w, ends), longer), key=lambda v: (v[1], v[0]))[:S.affected(S.decompose(S._marked(w, ends), longer), ends, len(w)) + 1]
    shift = {(p2, g) for p2, g in first(long)}
    assert any((p2, g) in shift or len(a) != len(b) and (p2 + 1, g) in shift for p2, g in first(short))

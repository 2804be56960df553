"""The pipeline's stages against plain versions, on a small table with planted cases."""

import base64
import random
import re
from collections import Counter

import corpus_pipeline as C
from pyspark.sql import functions as F
from worktally.llm.queries import QUERIES

from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_native import brute_lines


def test_stages(spark, tmp_path):
    r = random.Random(8)
    vocab = ["the", "and", "of", "house", "river", "green", "walk", "stone", "light", "over"]
    text = lambda n: " ".join(r.choice(vocab) + str(r.randint(0, 99)) for _ in range(n))
    passage, tail = text(60), text(12)
    rows = [(i, text(80) + "\n" + text(30), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, text(70) + "\n" + passage + "\n" + tail + "\n" + text(9), "en", "s0", 0) for i in range(5)]
    rows += [(200, rows[1][1], "en", "s1", 0), (201, " ".join(rows[2][1].split()[:-1]), "en", "s1", 0), (202, None, "en", "s1", 0), (203, "12 34", None, None, 5), (None, text(40), None, None, 1)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    have = docs
    for name, stage in C.STAGES:
        out = stage(spark, have, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, have = [tuple(x) for x in have.collect()], spark.read.parquet(f"{tmp_path}/{name}")
        after = [tuple(x) for x in have.collect()]
        if name != "best_fit_pack":
            assert have.columns == C.COLUMNS
        if name == "language_id":
            assert Counter(after) == Counter(x for x in before if x[1] and re.search("[a-z]", x[1]))
        if name == "line_dedup":
            want = brute_lines([x[:2] for x in before], 50)
            assert sorted((repr(x[0]), x[1]) for x in after) == sorted((d, t) for d, t, n, _ in want if not n or t.strip())
            assert sum(passage in x[1] for x in after) == sum(tail in x[1] for x in after) == 1
        if name == "jaccard_join":
            keep = {d for d, _, c in components([x[:2] for x in before]) if d == c}
            assert sorted(map(repr, after)) == sorted(map(repr, {x for x in before if repr(x[0]) in keep}))
        if name == "poisson_mix":
            assert set(after) <= set(before)
        if name == "best_fit_pack":
            assert Counter(x.doc_id for x in have.where("piece = 0").collect()) == Counter(x[0] for x in before)
    assert C.run(spark, str(tmp_path)).count() == len(after)


def test_language_stage_drops_gibberish_and_keeps_clean_texts(spark):
    r = random.Random(3)
    clean = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*C.COLUMNS)
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = ["x 12 34 %% " * 60, base64.b64encode(r.randbytes(600)).decode(), "<td><td/><br>{;}" * 50, "".join(r.choice(letters) for _ in range(700)),
            " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(100))]
    junk = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in C.identify_language(spark, clean.unionByName(junk), "").collect()}
    assert got == {x.doc_id for x in clean.where(F.col("text").rlike("\\p{L}")).collect()}


def test_language_stage_without_labels_keeps_texts(spark):
    rows = [(1, "the house", None, "s", 9), (2, "12 34", None, "s", 5), (3, None, None, "s", 0), (4, "漢字", None, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in C.identify_language(spark, docs, "").collect()) == [1, 4]


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES] == list(range(1, 14))

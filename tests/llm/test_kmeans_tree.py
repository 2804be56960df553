import numpy as np

from worktally.llm import kmeans_tree as T


def brute(rows, k, step):
    ok = [(d, np.array(v, float)) for d, v in rows if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % step == 0:
            s = sorted(((-(a @ b) / np.sqrt((a @ a) * (b @ b)), d) for d, b in ok if d != q))[:k]
            out[q] = s
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    return T.search(df, lambda c: c % 10 == 0, **more).collect()


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE", 800)
    monkeypatch.setattr(T, "LEAF", 20)
    monkeypatch.setattr(T, "PROBES", 60)
    monkeypatch.setattr(T, "CELL", 50)
    r = np.random.default_rng(0)
    centres = r.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.4 * r.normal(size=16)).astype(np.float32).tolist(), "x") for i in range(1500)]
    rows += [(2000 + i, rows[7][1], "x") for i in range(300)]  # one vector many times
    rows += [(5000, None, "x"), (5010, [0.0] * 16, "x"), (5020, [float("nan")] * 16, "x"), (5030, [None] * 16, "x"), (5040, [1.0], "x"), (None, [1.0] * 16, "x")]
    got = run(spark, rows)
    want = brute([(d, v) for d, v, _ in rows if v is None or len(v) == 16], 5, 10)
    by = {}
    for x in got:
        by.setdefault(x.query_id, []).append(x)
    assert set(by) == set(want)
    hit = 0
    for q, found in by.items():
        found.sort(key=lambda x: x.rank)
        assert [x.rank for x in found] == [1, 2, 3, 4, 5]
        assert [(-x.score, x.id) for x in found] == sorted((-x.score, x.id) for x in found)
        hit += len({x.id for x in found} & {d for _, d in want[q]})
    assert hit >= 0.95 * 5 * len(want)
    copies = by[2000]
    assert [x.id for x in copies] == [7, 2001, 2002, 2003, 2004]


def test_small_and_empty(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 1.0], "x"), (2, [0.0, 1.0], "x")]
    got = sorted((x.query_id, x.rank, x.id) for x in run(spark, rows))
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert run(spark, [(0, None, "x")]) == [] and run(spark, []) == []


def test_the_driver_sees_tree_and_probes_only(spark, monkeypatch):
    """The sample stays in a task: what comes to the driver does not grow with it, and the tree is the one fitted on it."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(T, "LEAF", 100)
    monkeypatch.setattr(T, "PROBES", 10)
    seen = []
    for name in ("collect", "toArrow", "toPandas"):
        def counted(self, f=getattr(DataFrame, name)):
            out = f(self)
            seen.append(len(out))
            return out
        monkeypatch.setattr(DataFrame, name, counted)
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 8))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    T.search(df, lambda c: c % 10 == 0)
    assert seen and max(seen) < 300  # of 2,000 vectors, all in the sample
    monkeypatch.undo()
    sample = df.selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS vector").orderBy("id").limit(2000)
    (centres, kids, leaves), ids, probes = T.fitted(sample, 3)
    x = np.array([v for _, v, _ in rows])
    want = T.fit_tree(T._unit(x), 3)
    assert np.array_equal(centres, want[0]) and kids == want[1] and leaves == want[2]
    assert ids.tolist() == list(range(200)) and np.array_equal(probes, x[:200])


def test_no_join_can_broadcast_the_queries_of_all_leaves(spark):
    """Repeated for each leaf it visits, a query is large; Spark takes the size before, so a join would send all to the driver."""
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    found = T.search(df, lambda c: c % 10 == 0)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert found.count() == 150

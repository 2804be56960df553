import os

from pyspark.sql import functions as F

from worktally.streaming import jobs as J


def stream_of(spark, tmp_path, frames):
    """A folder stream that takes one file, hence one frame, per trigger."""
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, "id long, version int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in os.listdir(tmp_path / "in"):
            os.utime(tmp_path / "in" / f) if i == 0 else None
    return (spark.readStream.schema("id long, version int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))


def test_latest_version_over_batches(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")], [(2, 0, "old"), (3, 1, "d")]])
    got = {r.id: r.text for r in J.ingest_latest(s, "id", "version").collect()}
    assert got == {1: "c", 2: "b", 3: "d"}


def test_bad_rows_never_stop_the_job(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[(1, 1, "5"), (2, 1, "x")], [(3, 1, None), (4, 1, "6")]])
    rows, dead = J.dead_letters(s, F.col("text").try_cast("int").isNotNull())
    assert sorted(r.id for r in rows.collect()) == [1, 4] and sorted(r.id for r in dead.collect()) == [2, 3]


def test_replayed_batch_leaves_no_doubles(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[(1, 1, "a")], [(2, 1, "b")]])
    home = J.per_batch(s, "replay", lambda b, *_: b)
    # the same batch written again replaces its own folder only
    spark.createDataFrame([(1, 1, "a")], "id long, version int, text string").write.mode("overwrite").parquet(f"{home}/rows/batch=0")
    assert J.read_parts(spark, home).count() == 2


def test_messages_stay_unique_after_a_restart(spark, tmp_path):
    home = str(tmp_path / "home")
    s = stream_of(spark, tmp_path, [[(1, 5, "a"), (1, 4, "b"), (None, 1, "n")], [(1, 1, "late copy"), (2, 0, "late")]])
    at = s.withColumn("at", F.make_date(F.lit(2024), F.lit(1), F.col("version") + 1).cast("timestamp"))
    got = sorted((r.id or 0, r.text) for r in J.dedup_messages(at, "id", "at", home).collect())
    assert [g[0] for g in got] == [0, 1, 2]
    stream_of(spark, tmp_path, [[(2, 30, "again"), (3, 1, "new")]])
    later = J.dedup_messages(at, "id", "at", home).collect()
    assert sorted(r.id or 0 for r in later) == [0, 1, 2, 3] and {r.text for r in later if r.id == 2} == {"late"}


def test_progress_counts_late_rows_and_goes_on(spark, tmp_path):
    home = str(tmp_path / "home")
    s = stream_of(spark, tmp_path, [[(1, 20, "A"), (2, 20, "A")], [(3, 1, "A"), (4, 20, "B")]])
    at = s.withColumn("at", F.make_date(F.lit(2024), F.lit(1), F.col("version")).cast("timestamp"))
    count = lambda: {(r.window_start.day, r.status): r.n for r in J.progress_counts(at, "at", "text", home=home).collect()}
    assert count() == {(20, "A"): 2, (1, "A"): 1, (20, "B"): 1}
    assert count()[20, "A"] == 2
    stream_of(spark, tmp_path, [[(5, 20, "A")]])
    assert count() == {(20, "A"): 3, (1, "A"): 1, (20, "B"): 1}


def test_batches_touch_their_own_buckets_only(spark, tmp_path):
    home = str(tmp_path / "home")
    s = stream_of(spark, tmp_path, [[(i, 1, "a") for i in range(50)], [(7, 2, "b")], [(7, 2, "tie"), (8, 0, "old"), (None, 1, "n")]])
    got = {r.id: r.text for r in J.ingest_latest(s, "id", "version", home, buckets=8).collect()}
    assert got == {i: "tie" if i == 7 else "a" for i in range(50)} | {None: "n"}
    wrote = {d: len([x for x in os.listdir(f"{home}/rows/{d}") if x.startswith("bucket=")]) for d in os.listdir(f"{home}/rows")}
    assert wrote["batch=1"] == 1 or "batch=1" not in wrote and len(wrote) >= 2
    assert len(os.listdir(f"{home}/manifest")) <= 2
    # nothing new: the table is read as it is, without a merge
    assert {r.id: r.text for r in J.ingest_latest(s, "id", "version", home, buckets=8).collect()} == got
    plan = J.ingest_latest(s, "id", "version", home, buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    stream_of(spark, tmp_path, [[(8, 3, "late")]])
    assert {r.id: r.text for r in J.ingest_latest(s, "id", "version", home, buckets=8).collect()} == got | {8: "late"}


def test_a_merge_that_runs_again_changes_nothing(spark, tmp_path):
    from worktally.streaming.buckets import BucketTable
    rows = lambda *x: spark.createDataFrame(x, "id long, version int, text string")
    table = BucketTable(spark, str(tmp_path / "t"), "id", "version", rows((1, 1, "a")).schema, 4)
    assert table.read().count() == 0
    table.merge(rows((1, 1, "a"), (2, 1, "a"), (1, 1, "b")), 0)
    table.merge(rows((1, 2, "c"), (3, 1, "d")), 1)
    want = sorted(map(tuple, table.read().collect()))
    table.merge(rows((1, 2, "c"), (3, 1, "d")), 1)  # lost before the stream had noted it
    assert sorted(map(tuple, table.read().collect())) == want == [(1, 2, "c"), (2, 1, "a"), (3, 1, "d")]
    table.merge(rows(), 2)
    for b in range(3, 7):
        table.merge(rows((b, 1, "x")), b)
    assert table.read().count() == 6 and len(table.manifests()) == 2


def test_ids_are_state_and_no_batch_reads_what_is_stored(spark, tmp_path):
    """Four batches, a restart and late copies; the rows stored before may even be gone."""
    import shutil
    home = str(tmp_path / "home")
    s = stream_of(spark, tmp_path, [[(1, 5, "a"), (1, 4, "b")], [(1, 1, "late"), (2, 3, "c")], [(2, 0, "late"), (None, 1, "n"), (None, 1, "n")], [(3, 1, "d")]])
    at = s.withColumn("at", F.make_date(F.lit(2024), F.lit(1), F.col("version") + 1).cast("timestamp"))
    got = sorted((r.id or 0, r.text) for r in J.dedup_messages(at, "id", "at", home).collect())
    assert got == [(0, "n"), (0, "n"), (1, "b"), (2, "c"), (3, "d")]
    for part in os.listdir(f"{home}/rows"):
        if part.startswith("batch="):
            shutil.move(f"{home}/rows/{part}", str(tmp_path / f"away-{part}"))
    stream_of(spark, tmp_path, [[(1, 9, "again"), (3, 9, "again"), (4, 1, "new")]])
    assert [(r.id, r.text) for r in J.dedup_messages(at, "id", "at", home).collect()] == [(4, "new")]


def test_ids_meet_the_engines_own_state_and_a_batch_run_again_changes_nothing(spark, tmp_path):
    """No row goes to a Python worker, and the first stream may lose its note of a batch that the second has taken."""
    home = str(tmp_path / "home")
    s = stream_of(spark, tmp_path, [[(1, 5, "a"), (1, 4, "b"), (None, 1, "n")], [(1, 1, "late"), (2, 3, "c"), (2, 2, "d"), (None, 1, "n")]])
    at = s.withColumn("at", F.make_date(F.lit(2024), F.lit(1), F.col("version") + 1).cast("timestamp"))
    run = lambda: sorted((r.id or 0, r.text) for r in J.dedup_messages(at, "id", "at", home).collect())
    first = run()
    state = spark.read.format("state-metadata").load(f"{home}/ids/state")
    assert {r.operatorName for r in state.collect()} == {"dedupe"}
    for f in ("1", ".1.crc"):
        os.remove(f"{home}/state/commits/{f}")
    assert run() == first and [i for i, _ in first] == [0, 0, 1, 2] and os.listdir(f"{home}/arrivals") == []

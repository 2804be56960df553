import os
import random

from pyspark.sql import functions as F

from worktally.operators import files as FI
from worktally.operators import normalise as NO
from worktally.operators import textdocs as TX
from worktally.sources import files as SF
from worktally.sources import sinks as SK
from worktally.sources import tables as ST


def test_archive_guard(spark):
    rows = [(1, "ok/a.csv", 5), (1, "../../evil.sh", 5), (1, "a/../b.csv", 5), (1, "a/../../b.csv", 5), (1, "/etc/x.csv", 5),
            (1, "run.EXE", 500), (1, "..", 0), (2, "a", 1), (2, "b", 1), (2, "c", 1), (3, "a.csv", 60), (3, "b.csv", 60), (3, "c.exe", 600)]
    df = spark.createDataFrame(rows, "archive_id int, member string, size_bytes long")
    got = {(r.archive_id, r.member): r.verdict for r in FI.archive_guard(df, max_members=7, max_bytes=100).collect()}
    assert got[1, "ok/a.csv"] == got[1, "a/../b.csv"] == "ACCEPTED"
    assert {got[1, m] for m in ("../../evil.sh", "a/../../b.csv", "/etc/x.csv", "..")} == {"UNSAFE_PATH"}
    assert got[1, "run.EXE"] == "BLOCKED_TYPE"
    assert {v for (a, _), v in got.items() if a == 3} == {"ARCHIVE_TOO_LARGE"}
    many = FI.archive_guard(df, max_members=2, max_bytes=10 ** 6).filter("archive_id = 2")
    assert {r.verdict for r in many.collect()} == {"ARCHIVE_TOO_MANY"}


def test_triage(spark):
    names = ["desktop.ini", "Thumbs.db", "hours.xlsx", "image.png", "IMG_0042.jpg", "a.sh", "notes.txt", "README", ".csv"]
    df = spark.createDataFrame([(n, False) for n in names] + [("copy.pdf", True)], "name string, dup boolean")
    got = {r["name"]: (r.processing_status, r.is_noise, r.is_candidate) for r in FI.triage(df, F.col("name"), F.col("dup")).collect()}
    assert got["desktop.ini"][0] == got["Thumbs.db"][0] == "IGNORED_NOISE"
    assert got["hours.xlsx"] == ("DETECTED", False, True) and got["image.png"][2] and got["IMG_0042.jpg"][2]
    assert got["a.sh"] == ("UNSUPPORTED_FILE_TYPE", True, False) and got["notes.txt"] == ("UNSUPPORTED_FILE_TYPE", False, False)
    assert got["README"][2] and got["copy.pdf"][0] == "DUPLICATE_FILE"


def test_duplicates_point_to_the_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, None), (6, None)], "file_id int, text string")
    got = {r.file_id: (r.is_duplicate, r.duplicate_of) for r in FI.mark_duplicates(df, F.sha2("text", 256)).collect()}
    assert got == {1: (False, None), 3: (True, 1), 2: (False, None), 5: (False, None), 6: (False, None)}


def test_path_metadata(spark):
    df = spark.createDataFrame([("Acme/x/Timesheets - April 15 2026 Susan Savage.pdf",), ("Ana_Lopez_Apr-2026.xlsx",), ("V/scan.png",)], "rel_path string")
    got = [(r.vendor, r.period_text, r.person) for r in FI.path_metadata(df).collect()]
    assert got == [("Acme", None, "Susan Savage"), (None, "Apr-2026", "Ana Lopez"), ("V", None, None)]


def test_inventory_skips_hidden(spark, tmp_path):
    for name in ["a/b/x.csv", "a/.git/y.csv", "__MACOSX/z.csv", ".h.csv", "top.PDF"]:
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text("12345")
    got = {(r.folder_path, r.file_name, r.file_ext, r.size_bytes) for r in SF.inventory(spark, str(tmp_path)).collect()}
    assert got == {("a/b", "x.csv", ".csv", 5), ("", "top.PDF", ".pdf", 5)}


def test_delimited_text(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('name;in;out;hours\nAna;09:00;;8\nBob;08:00;17:00;9\n;;;\nshort;row\ntoo;many;cells;in;it\n"a;b";"say ""x""";1;2\n')
    rows, lost = SF.read_delimited(spark, str(path))
    assert sorted(tuple(r) for r in rows.collect()) == sorted([
        ("name", "in", "out", "hours"), ("Ana", "09:00", "", "8"), ("Bob", "08:00", "17:00", "9"), ("short", "row", "", ""), ("a;b", 'say "x"', "1", "2")])
    assert lost.first().lost_rows == 1
    latin = tmp_path / "l.csv"
    latin.write_bytes("José,1\nAna,2\n".encode("latin-1"))
    assert sorted(r.c0 for r in SF.read_delimited(spark, str(latin))[0].collect()) == ["Ana", "José"]


def test_delimited_folder_is_read_file_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("José,1\nAna,2\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("Hours of May\nRené;3;x\nZoë;4;y\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("\n\n")
    rows, lost = SF.read_delimited(spark, str(tmp_path))
    assert sorted(tuple(r) for r in rows.collect()) == [("Ana", "2", ""), ("Hours of May", "", ""), ("José", "1", ""), ("René", "3", "x"), ("Zoë", "4", "y")]
    assert lost.first().lost_rows == 0


def test_json_records(spark):
    df = spark.createDataFrame([('{"d":"2026-04-01","b":"30.0","h":"7.5","zz":1}',), ('{"d":"x","b":"","h":null}',), ("{oops",)], "js string")
    good, bad = ST.read_json_records(df, "js", "d string, b string, h string", {"b": 0.0, "h": None})
    assert [(r.b, r.h) for r in good.collect()] == [(30.0, 7.5), (0.0, None)] and bad.count() == 1


def test_table_append_and_pruned_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "k int, v string, batch_id int")
    for _ in range(2):
        ST.append_table(df, str(tmp_path / "t"), ["batch_id"])
    back = ST.read_table(spark, str(tmp_path / "t"), ["k", "batch_id"]).filter("batch_id = 2")
    assert back.count() == 2 and back.columns == ["k", "batch_id"]


def test_summary_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', "")], "p string, q string, r string")
    SK.write_summary_csv(df, str(tmp_path / "c"))
    assert tuple(spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "c")).na.fill("").first()) == ("a,b", 'say "x"', "")


def test_pipe_tables(spark):
    text = "intro\n| date | h |\n|---|:-:|\n| 1 | 8 |\n\n| alone | row |\nx\n  |a|b|\n|c||\n|e|f|"
    got = [(r.table_no, r.row_no, r.cells) for r in TX.pipe_tables(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()]
    assert got == [(1, 0, ["date", "h"]), (1, 1, ["1", "8"]), (2, 0, ["a", "b"]), (2, 1, ["c"]), (2, 2, ["e", "f"])]


def test_text_blocks_with_pages_on_one_line(spark):
    page = "word " * 15
    text = f"{page}--- PAGE BREAK ---{page}\nmore\n=====\nshort"
    lines = TX.lines_of(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = TX.block_summary(TX.segment_lines(lines)).orderBy("block_no").collect()
    assert [(r.rule, r["lines"]) for r in got] == [("PAGE_BREAK", 1), ("PAGE_BREAK", 2)]


def test_text_blocks_by_line_count(spark):
    rows = [(1, i, f"line {'x' if i % 3 else ''}" if i % 3 else "") for i in range(200)]
    got = TX.block_summary(TX.segment_lines(spark.createDataFrame(rows, "doc_id int, line_no int, line string"))).orderBy("block_no").collect()
    assert [r["lines"] for r in got] == [60, 60, 13] and {r.rule for r in got} == {"LINE_COUNT"}


def test_token_rows_equal_the_sequential_rule(spark):
    rnd = random.Random(4)
    tokens = [(p, i, float(rnd.randint(0, 90)), float(rnd.randint(0, 400)) + rnd.random(), float(rnd.choice([0, 6, 8, 12])))
              for p in (1, 2) for i in range(150)]
    df = spark.createDataFrame(tokens, "page_id long, token_id long, x double, y double, h double")
    got = {}
    for r in TX.cluster_rows(df).collect():
        got.setdefault((r.page_id, r.segment, r.row_no), set()).add(r.token_id)
    want = []
    for p in (1, 2):
        mine = [t for t in tokens if t[0] == p]
        heights = sorted(t[4] for t in mine if t[4] > 0)
        tol, rows = max(heights[len(heights) // 2] * 0.6, 4), []
        for t in sorted(mine, key=lambda t: (t[3], t[2], t[1])):
            c = t[3] + t[4] / 2
            row = next((r for r in rows if abs(c - r[0]) <= tol), None)
            if row is None:
                rows.append((c, {t[1]}))
            else:
                row[1].add(t[1])
        want += [(p, frozenset(r[1])) for r in rows]
    assert sorted((k[0], sorted(v)) for k, v in got.items()) == sorted((p, sorted(v)) for p, v in want)


def test_name_on_the_line_before_a_signature(spark):
    rows = [(1, 0, "Totals"), (1, 1, "Greta Costa"), (1, 2, "____ Employee signature"), (2, 0, "Ana Novak | Employee sign"), (3, 0, "Name: Bo Ek")]
    got = {r.doc_id: r["name"] for r in NO.name_from_lines(spark.createDataFrame(rows, "doc_id int, line_no int, line string")).collect()}
    assert got[3] == "Bo Ek" and got[2] in ("sign", "Ana Novak")


def test_page_mix(spark):
    rows = [(d, 100 if i < n else 3) for d, n in ((1, 10), (2, 0), (3, 7), (4, 3), (5, 5)) for i in range(10)]
    got = {r.doc_id: r.kind for r in FI.page_mix(spark.createDataFrame(rows, "doc_id int, text_chars int")).collect()}
    assert got == {1: "text", 2: "image", 3: "text", 4: "image", 5: "mixed"}


def test_reports_by_batch_write_few_files_in_order(spark, tmp_path):
    """Rows of all batches lie in every part; files number as many as batches and tasks, not their product, and keep the report's order."""
    from worktally.operators import reports as RP
    n, batches = 4000, 25
    rows = spark.range(0, n, 1, 8).select(
        F.col("id").alias("finding_id"), (F.col("id") % batches).cast("int").alias("batch_id"), F.lit("R").alias("rule_code"),
        F.element_at(F.array(*[F.lit(x) for x in ("ERROR", "BLOCKER", "INFO")]), (F.col("id") % 3 + 1).cast("int")).alias("severity"),
        (F.lit(n) - F.col("id")).alias("created_at"), F.lit(1).alias("employee_id"), F.lit(1).alias("file_id"), F.lit("OPEN").alias("status"))
    files = spark.range(0, n, 1, 8).select(
        F.col("id").alias("file_id"), (F.col("id") % batches).cast("int").alias("batch_id"), *[F.lit(x).alias(x) for x in (
            "folder_path", "file_name", "file_ext", "detected_name", "match_status", "processing_status")], F.lit(5).alias("size_bytes"),
        F.lit(1).alias("matched_employee_id"), *[F.lit(True).alias(x) for x in ("ocr_required", "is_duplicate", "is_noise")])
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        SK.write_reports({"exceptions": RP.exceptions(rows), "files": RP.file_inventory(files)}, str(tmp_path))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        labels = ["status", "total", "processed", "failed", "ignored", "duplicates", "review", "payroll_ready"]
        counters = rows.groupBy("batch_id").agg(*[F.count("*").alias(x) for x in labels])
        SK.write_reports({"summary": RP.batch_summary(counters)}, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("exceptions", "files"):
        parts = [str(f) for f in (tmp_path / name).rglob("*.parquet")]
        assert len(parts) <= batches + 8, (name, len(parts))
        assert spark.read.parquet(str(tmp_path / name)).count() == n
    # some bytes a batch, yet one file each: not all by one task
    assert len({f.name.split("-")[1] for f in (tmp_path / "summary").rglob("*.parquet")}) >= 4
    for f in (tmp_path / "exceptions").rglob("*.parquet"):
        got = [(r.severity, -r.finding_id) for r in spark.read.parquet(str(f)).collect()]
        assert got == sorted(got)

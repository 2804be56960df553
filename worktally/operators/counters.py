"""Counters for dashboards, batches, files and months. One pass each, conditions inside the counts."""

from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import hours as H


def count_where(cond):
    return F.count_if(F.coalesce(cond, F.lit(False)))


def dashboard(batches, findings):
    """Batches by status, open blockers, open warnings (errors included): one row."""
    statuses = {"processing": "PROCESSING", "needs_review": "NEEDS_REVIEW",
                "payroll_ready": "PAYROLL_READY", "failed": "FAILED"}
    is_open = F.col("status") == "OPEN"
    seen = findings.agg(F.struct(
        count_where(is_open & (F.col("severity") == "BLOCKER")).alias("b"),
        count_where(is_open & F.col("severity").isin("WARNING", "ERROR")).alias("w")).alias("x")).scalar()
    out = batches.agg(F.count("*").alias("total"),
                      *[count_where(F.col("status") == v).alias(k) for k, v in statuses.items()])
    return out.withColumn("_x", seen).select(
        "total", *statuses, F.col("_x.b").alias("open_blockers"), F.col("_x.w").alias("open_warnings"))


def finalise(files, submissions, findings):
    """Batch counters and status from files, ready submissions and open blockers."""
    status = F.col("processing_status")
    base = files.groupBy("batch_id").agg(
        F.count("*").alias("total"), count_where(F.col("is_noise")).alias("ignored"),
        count_where(F.col("is_duplicate")).alias("duplicates"),
        count_where(status.isin("COMPLETED", "MATCHED", "NORMALIZED")).alias("processed"),
        count_where(status == "FAILED").alias("failed"),
        count_where(status.isin("NEEDS_REVIEW", "EXTRACTION_FAILED")).alias("review"))
    ready = submissions.groupBy("batch_id").agg(
        count_where(F.col("payroll_status") == "READY").alias("payroll_ready"))
    blockers = findings.groupBy("batch_id").agg(
        count_where((F.col("status") == "OPEN") & (F.col("severity") == "BLOCKER")).alias("open_blockers"))
    out = base.join(ready, "batch_id", "left").join(blockers, "batch_id", "left")
    out = out.fillna(0, ["payroll_ready", "open_blockers"])
    stuck = (F.col("failed") > 0) | (F.col("review") > 0) | (F.col("open_blockers") > 0)
    return out.withColumn("status", F.when(stuck, "NEEDS_REVIEW").otherwise("PAYROLL_READY"))


def progress(files):
    status = F.col("processing_status")
    out = files.groupBy("batch_id").agg(
        F.count("*").alias("total"), count_where(status == "COMPLETED").alias("done"),
        count_where(status == "FAILED").alias("failed"), count_where(status == "NEEDS_REVIEW").alias("review"))
    return out.withColumn("pct", F.round(F.col("done") * 100 / F.greatest("total", F.lit(1)), 1))


def file_stats(files):
    candidate = ~F.col("is_noise") & ~F.col("is_duplicate") & F.col("is_candidate")
    status, match = F.col("processing_status"), F.col("matched_employee_id")
    return files.groupBy("batch_id").agg(
        count_where(F.col("ocr_required")).alias("ocr_files"),
        count_where(match.isNotNull()).alias("matched"),
        count_where(match.isNull() & candidate).alias("unmatched"),
        count_where(status.isin("EXTRACTION_FAILED", "FAILED")).alias("extraction_failed"),
        count_where(status == "NON_TIMESHEET_DOCUMENT").alias("non_sheet"))


def severity_histogram(findings):
    live = findings.filter((F.col("status") == "OPEN") & ~F.col("rule_code").isin(P.ADMIN_RULES))
    return live.groupBy("batch_id").agg(*[
        count_where(F.col("severity") == s).alias(f"{s.lower()}_count") for s in P.SEVERITIES])


def file_hours(entries, key="submission_id"):
    """Sum of calculated hours, else of entered hours when that sum is missing or zero."""
    sums = entries.groupBy(key).agg(F.sum("calculated_hours").alias("c"), F.sum("entered_hours").alias("e"))
    total = F.coalesce(F.nullif(F.col("c"), F.lit(0)), F.nullif(F.col("e"), F.lit(0)), F.lit(0))
    return sums.select(key, total.alias("hours"))


def day_hours():
    """Regular plus overtime; calculated, then entered, when both are zero."""
    split = F.coalesce("regular_hours", F.lit(0)) + F.coalesce("overtime_hours", F.lit(0))
    return F.coalesce(F.nullif(split, F.lit(0)),
                      H.first_nonzero(F.col("calculated_hours"), F.col("entered_hours"))).cast(H.HOURS)


def month_totals(entries):
    return entries.withColumn("_h", day_hours()).groupBy(
        "submission_id", F.date_trunc("month", "work_date").cast("date").alias("month")).agg(
        F.sum("_h").alias("hours"), F.count("*").alias("rows"))


def calendar_summary(sheets, candidates_without):
    """Sheets, their hours, and files that produced none: one row."""
    missing = candidates_without.agg(F.count("*").alias("n")).scalar()
    return sheets.agg(F.count("*").alias("sheets"), F.sum("hours").alias("total_hours")).withColumn(
        "not_extracted", missing)


def hour_buckets(entries, key="employee_id"):
    """Regular, overtime, sick, vacation, holiday and payable hours, worked days, distinct dates."""
    h = H.first_nonzero(F.col("calculated_hours"), F.col("entered_hours"))
    kind, leave = F.col("entry_type"), F.coalesce("leave_type", F.lit(""))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, h)), F.lit(0))
    return entries.groupBy(key).agg(
        F.sum("regular_hours").alias("regular"), F.sum("overtime_hours").alias("overtime"),
        total((kind == "LEAVE") & (leave == "SICK")).alias("sick"),
        total((kind == "LEAVE") & (leave != "SICK")).alias("other_leave"),
        total(kind == "HOLIDAY").alias("holiday"),
        F.sum(F.col("regular_hours") + F.col("overtime_hours")).alias("payable"),
        F.count_if(kind == "WORK").alias("worked_days"), F.count_distinct("work_date").alias("unique_dates"),
        F.min("work_date").alias("first_date"), F.max("work_date").alias("last_date"))


def approve_queue(jobs, messages):
    """Messages awaiting approval per crawl job (0 when none)."""
    n = messages.groupBy("job_id").agg(count_where(F.col("status") == "PENDING_APPROVAL").alias("pending"))
    return jobs.join(n, "job_id", "left").fillna(0, ["pending"])


def vendor_rollup(submissions, totals, vendors):
    """Per vendor: submissions, distinct employees, hours, ready ones; vendors with none drop out."""
    joined = submissions.filter(F.col("vendor_id").isNotNull()).join(
        totals.select("submission_id", "regular_hours", "overtime_hours"), "submission_id", "left")
    sums = joined.groupBy("vendor_id").agg(
        F.count("*").alias("submissions"), F.count_distinct("employee_id").alias("employees"),
        F.coalesce(F.sum("regular_hours"), F.lit(0)).alias("regular_hours"),
        F.coalesce(F.sum("overtime_hours"), F.lit(0)).alias("overtime_hours"),
        count_where(F.col("payroll_status") == "READY").alias("ready"))
    return sums.join(vendors.select("vendor_id", "name"), "vendor_id")


def completeness(profile, entries, key="doc_id", least=P.COMPLETE_RATIO):
    """Entries found against the candidate rows of the source, in percent; incomplete below ``least``. No candidates: complete."""
    got = entries.groupBy(key).agg(F.count("*").alias("entries"))
    out = profile.join(got, key, "left").fillna(0, ["entries"])
    rows = F.col("candidate_rows")
    pct = F.when(rows > 0, F.round((F.col("entries") * 100 / rows), 1)).otherwise(100)
    return out.withColumns({"completeness_pct": pct, "incomplete": (rows > 0) & (F.col("entries") < rows * least)})


def compare_engines(results, name="model"):
    """Score of each engine (ten an entry, the completeness in percent, less its seconds) and which is best; ties: the first name."""
    scored = results.withColumn("score", F.round(F.col("entries") * 10 + F.col("pct") - F.col("seconds"), 2))
    top = scored.agg(F.min_by(name, F.struct((-F.col("score")).alias("a"), F.col(name).alias("b"))).alias("m")).scalar()
    return scored.withColumn("best", F.col(name) == top)

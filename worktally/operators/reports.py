"""Report tables: plain projections over joined facts, ready to be written."""

from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions.rows import fixed_text, formula_safe, percent_text
from worktally.operators.payroll import overtime_rate, rate_as_of, worked_until

MONEY = "decimal(18,2)"


def yes_no(flag):
    return F.when(flag, "Yes").otherwise("No")


def text(c):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def by_batch(df, *order):
    """In order of the batch, then of ``order``, by as many tasks as a shuffle has. A table written by batch costs a file for each of
    them, so its parts are not merged for having few bytes; a large batch is dealt over several tasks."""
    keys = ["batch_id", *order]
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def batch_summary(counters):
    """Counters of a batch as label and value rows."""
    labels = ["status", "total", "processed", "failed", "ignored", "duplicates", "review", "payroll_ready"]
    pairs = ", ".join(f"'{c}', cast({c} as string)" for c in labels)
    return by_batch(counters).select("batch_id", F.expr(f"stack({len(labels)}, {pairs}) as (label, value)"))


def file_inventory(files):
    """Files, batch by batch."""
    return by_batch(files, "file_id").select(
        "batch_id", "file_id", formula_safe(text("folder_path")).alias("folder"),
        formula_safe(F.col("file_name")).alias("file_name"), text("file_ext").alias("file_ext"),
        F.round(F.coalesce("size_bytes", F.lit(0)) / 1024, 1).alias("size_kb"),
        formula_safe(text("detected_name")).alias("detected_employee"),
        text("matched_employee_id").alias("matched_employee"), "match_status",
        yes_no(F.col("ocr_required")).alias("ocr"), yes_no(F.col("is_duplicate")).alias("duplicate"),
        yes_no(F.col("is_noise")).alias("noise"), F.col("processing_status").alias("status"))


def entry_rows(entries, submissions):
    """Entries with their submission's batch, day name and zero-filled hours, batch by batch in order of employee and day."""
    subs = submissions.select("submission_id", "batch_id")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = entries.join(subs, "submission_id").select(
        "batch_id", "entry_id", "employee_id", F.col("work_date").cast("string").alias("work_date"),
        F.date_format("work_date", "EEEE").alias("day"), "in_min", "out_min", "break_minutes",
        "entered_hours", "calculated_hours", zero("regular_hours").alias("regular_hours"),
        zero("overtime_hours").alias("overtime_hours"), "entry_type")
    return by_batch(out, "employee_id", "work_date", "entry_id")


def severity_rank(severity):
    """Semantic order, worst first (the alphabetical order is the default of the reports)."""
    return F.array_position(F.array(*[F.lit(s) for s in P.SEVERITIES]), severity)


def exceptions(findings):
    """Findings, batch by batch in order of severity, as text, and time."""
    return by_batch(findings, "severity", "created_at", "finding_id").select(
        "batch_id", "finding_id", "severity", severity_rank(F.col("severity")).alias("severity_rank"),
        "rule_code", text("employee_id").alias("employee"), text("file_id").alias("file"), "status")


def employee_summary(submissions, totals, people):
    names = people.select("employee_id", "full_name")
    out = submissions.join(names, "employee_id", "left").join(totals, "submission_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "submission_id", text("employee_id").alias("employee"),
        formula_safe(F.coalesce("full_name", F.lit("Unknown"))).alias("name"),
        zero("entries").alias("entries"), F.round(zero("regular_hours"), 2).alias("regular_hours"),
        F.round(zero("overtime_hours"), 2).alias("overtime_hours"), zero("leave_days").alias("leave_days"),
        "approval_status", "validation_status", "payroll_status")


def _paid(submissions, totals, rates):
    rated = rate_as_of(submissions, rates, worked_until()).join(
        totals.select("submission_id", "regular_hours", "overtime_hours"), "submission_id", "left")
    rated = rated.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("regular_hours", "overtime_hours")})
    ot = overtime_rate(F.col("regular_rate"), F.col("overtime_rate")).cast("decimal(12,4)")
    rated = rated.withColumn("overtime_rate", ot)
    return rated.withColumns({
        "regular_pay": (F.col("regular_hours") * F.col("regular_rate")).cast(MONEY),
        "overtime_pay": (F.col("overtime_hours") * F.col("overtime_rate")).cast(MONEY)})


def payroll_report(submissions, totals, rates, people):
    """Hours, rates and pay as text; a missing or zero figure shows its filler."""
    names = people.select("employee_id", "full_name")
    out = _paid(submissions, totals, rates).join(names, "employee_id", "left")
    total = (F.col("regular_pay") + F.col("overtime_pay")).cast(MONEY)
    shown = lambda c, filler: F.coalesce(F.nullif(c, F.lit(0)).cast("string"), F.lit(filler))
    return out.select(
        "submission_id", text("employee_id").alias("employee"),
        formula_safe(F.coalesce("full_name", F.lit("Unknown"))).alias("name"), "regular_hours", "overtime_hours",
        shown(F.col("regular_rate"), "MISSING").alias("regular_rate"),
        shown(F.col("overtime_rate"), "MISSING").alias("overtime_rate"),
        shown(F.col("regular_pay"), "MISSING").alias("regular_pay"),
        shown(F.col("overtime_pay"), "N/A").alias("overtime_pay"),
        shown(total, "MISSING").alias("total_pay"), F.lit("USD").alias("currency"), "payroll_status")


def pay_export(submissions, totals, rates, people):
    """READY submissions only; missing rates count as zero."""
    names = people.select("employee_id", "full_name", "employee_code")
    out = _paid(submissions.filter("payroll_status = 'READY'"), totals, rates).join(names, "employee_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(MONEY)
    code = F.coalesce(F.nullif(F.col("employee_code"), F.lit("")), F.col("employee_id").cast("string"))
    return out.select(
        "submission_id", formula_safe(F.coalesce(code, F.lit(""))).alias("employee_id"),
        formula_safe(F.coalesce("full_name", F.lit(""))).alias("employee_name"),
        text("start_date").alias("period_start"), text("end_date").alias("period_end"),
        F.round("regular_hours", 2).alias("reg_hours"), F.round("overtime_hours", 2).alias("ot_hours"),
        zero("regular_pay").alias("reg_pay"), zero("overtime_pay").alias("ot_pay"),
        (zero("regular_pay") + zero("overtime_pay")).alias("total_pay"), F.lit("USD").alias("currency"),
        F.lit("").alias("cost_center"), F.lit("").alias("department"))


def file_summary(files, submissions, hours, findings, people):
    """One row per file, also for files without an hours sheet; the reason is in ``notes``."""
    latest = submissions.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(
        F.max_by(F.struct("submission_id", "start_date", "end_date", "approval_status", "payroll_status"),
                 F.struct("submitted_at", "submission_id")).alias("sub"))
    live = findings.filter("status = 'OPEN'")
    serious, warning = F.col("severity").isin("BLOCKER", "ERROR"), F.col("severity") == "WARNING"
    by_sub = live.groupBy("submission_id").agg(F.count_if(serious).alias("s_bad"), F.count_if(warning).alias("s_warn"))
    by_file = live.groupBy("file_id").agg(
        F.count_if(serious).alias("f_bad"), F.count_if(warning).alias("f_warn"),
        F.array_sort(F.collect_set("rule_code")).alias("f_codes"))
    names = people.select(F.col("employee_id").alias("matched_employee_id"), "full_name")
    out = (files.join(latest, "file_id", "left").withColumn("submission_id", F.col("sub.submission_id"))
           .join(hours, "submission_id", "left").join(by_sub, "submission_id", "left")
           .join(by_file, "file_id", "left").join(names, "matched_employee_id", "left"))
    has = F.col("sub").isNotNull()
    status = F.col("processing_status")
    reason = (F.when(F.col("is_noise"), "NOISE_FILE").when(F.col("is_duplicate"), "DUPLICATE_FILE")
              .when(status.isin("UNSUPPORTED_FILE_TYPE", "NON_TIMESHEET_DOCUMENT", "NEEDS_REVIEW"), status)
              .when(status.isin("EXTRACTION_FAILED", "FAILED"), "EXTRACTION_FAILED")
              .when(~has & F.col("is_candidate"), "MISSING_SUBMISSION").when(~has, "MISSING"))
    codes = F.when(~has, F.col("f_codes"))
    notes = F.concat_ws(" | ", F.array_compact(F.array(reason)), codes)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    figure = lambda c: fixed_text(F.when(has, zero(c)))
    share = lambda c: (F.col(c) / 100).cast("decimal(6,4)")
    return out.select(
        "batch_id", "file_id", formula_safe(F.col("file_name")).alias("file_name"),
        formula_safe(text("folder_path")).alias("folder_path"), status.alias("document_type"),
        formula_safe(text("detected_name")).alias("employee_candidate"),
        formula_safe(text("full_name")).alias("matched_employee"), text("match_status").alias("match_status"),
        F.coalesce(percent_text(F.when(F.col("match_percent") != 0, share("match_percent"))), F.lit(""))
        .alias("match_confidence"), text("extraction_method").alias("extraction_method"),
        status.alias("extraction_status"),
        percent_text(F.coalesce(share("extraction_percent"), F.lit(0))).alias("extraction_confidence"),
        "entry_count", figure("hours").alias("total_hours"), figure("regular").alias("regular_hours"),
        figure("overtime").alias("overtime_hours"),
        F.coalesce(F.col("sub.start_date").cast("string"), F.lit("")).alias("period_start"),
        F.coalesce(F.col("sub.end_date").cast("string"), F.lit("")).alias("period_end"),
        F.coalesce("sub.approval_status", F.lit("")).alias("approval_status"),
        F.when(has, F.coalesce("sub.payroll_status", F.lit(""))).when(~F.col("is_candidate"), "EXCLUDED")
        .otherwise("NOT_READY").alias("payroll_status"),
        F.when(has, zero("s_bad")).otherwise(zero("f_bad")).alias("blocker_count"),
        F.when(has, zero("s_warn")).otherwise(zero("f_warn")).alias("warning_count"),
        yes_no(F.col("ocr_required")).alias("ocr_used"), yes_no(F.col("is_duplicate")).alias("duplicate"),
        formula_safe(F.when(notes == "", "OK").otherwise(notes)).alias("notes"))

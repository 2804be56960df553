"""Counters, joins, report tables, calendars and corrections."""

from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import rows as RW
from worktally.operators import calendar as CAL
from worktally.operators import changes as CH
from worktally.operators import counters as CO
from worktally.operators import entries as E
from worktally.operators import paging as PG
from worktally.operators import payroll as PAY
from worktally.operators import reports as RP
from worktally.operators import rules as R
from worktally.operators.grouping import latest_per_key
from worktally.plans.core import totals_of, weekly_of
from worktally.plans.registry import query
from worktally.session import shared_folder
from worktally.sources import sinks as SK
from worktally.sources import tables as ST
from worktally.sources.stages import staged


def subs_of(t):
    """Submissions with batch, file and the verdict of the stored findings."""
    df = R.readiness(t.fx_submission, t.fx_finding)
    e = F.col("employee_id")
    return df.withColumns({"batch_id": F.floor(e / 50).cast("int"), "file_id": F.when(e % 3 != 2, e * 5)})


# --- joins ---

@query("c01_entry_submission_join", "entry_id:long, submission_id:long, approver_name:string",
       "SELECT entry_id, s.submission_id, approver_name FROM fx_entry e JOIN fx_submission s ON s.submission_id = e.submission_id")
def c01(t):
    return E.with_submission(t.fx_entry.select("entry_id", "submission_id"), t.fx_submission, "approver_name")


@query("c02_vendor_chain", "submission_id:long, vendor_id:long, vendor_name:string",
       """SELECT submission_id, COALESCE(s.vendor_id, e.vendor_id) AS vendor_id, v.name AS vendor_name FROM fx_submission s
          LEFT JOIN fx_employee e ON e.employee_id = s.employee_id
          LEFT JOIN fx_vendor v ON v.vendor_id = COALESCE(s.vendor_id, e.vendor_id)""")
def c02(t):
    return E.with_vendor(t.fx_submission, t.fx_employee, t.fx_vendor)


@query("c06_missing_submitters", "employee_id:long",
       "SELECT employee_id FROM fx_employee e WHERE is_active AND NOT EXISTS (SELECT 1 FROM fx_submission s WHERE s.employee_id = e.employee_id)")
def c06(t):
    return R.not_submitted(t.fx_employee, t.fx_submission)


@query("c07_missing_files", "file_id:long, processing_status:string",
       """SELECT file_id, processing_status FROM fx_file WHERE NOT is_noise AND NOT is_duplicate AND is_candidate
          AND file_id NOT IN (SELECT file_id FROM ck_sub WHERE file_id IS NOT NULL)""")
def c07(t):
    return R.missing_files(t.fx_file, subs_of(t))


@query("c15_latest_submission", "employee_id:long, last_seen:string",
       """SELECT e.employee_id, CAST(MAX(s.end_date) AS VARCHAR) AS last_seen FROM fx_employee e
          LEFT JOIN fx_order_sub s ON s.employee_id = e.employee_id WHERE is_active GROUP BY 1""")
def c15(t):
    return R.latest_activity(t.fx_employee, t.fx_order_sub, "end_date")


@query("c18_cascading_delete", "name:string, n:long",
       """SELECT 'files' AS name, COUNT(*) AS n FROM fx_file WHERE batch_id <> 1
  UNION ALL SELECT 'submissions', COUNT(*) FROM ck_sub WHERE batch_id <> 1
  UNION ALL SELECT 'entries', COUNT(*) FROM fx_entry e WHERE FLOOR(employee_id / 50) <> 1
  UNION ALL SELECT 'findings', COUNT(*) FROM fx_finding WHERE batch_id <> 1""")
def c18(t):
    doomed = t.fx_file.filter("batch_id = 1").select("batch_id").distinct()
    kept = CH.without_batches({
        "files": (t.fx_file, "batch_id", None), "findings": (t.fx_finding, "batch_id", None),
        "submissions": (subs_of(t), "batch_id", None), "entries": (t.fx_entry, "submission_id", "submissions")},
        doomed)
    return CH.union_counts(kept)


@query("e12_latest_per_key", "employee_id:long, submission_id:long, end_date:string",
       """SELECT employee_id, submission_id, end_date FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY employee_id
          ORDER BY end_date DESC, submission_id DESC) AS rn FROM fx_order_sub) q WHERE rn = 1""")
def e12(t):
    return latest_per_key(t.fx_order_sub, "employee_id", "end_date", "submission_id")


@query("a12_table_round_trip", "entry_id:long, work_date:string, entered_hours:double",
       """SELECT entry_id, CAST(work_date AS VARCHAR) AS work_date, entered_hours FROM fx_entry
          WHERE work_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""")
def a12(t):
    path = shared_folder(t.spark, "table")
    for part in (0, 1):  # appended in two loads
        ST.append_table(t.fx_entry.filter(F.col("entry_id") % 2 == part), path, ["work_date"])
    back = ST.read_table(t.spark, path, ["entry_id", "work_date", "entered_hours"])
    return back.filter(F.col("work_date").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date")))


# --- counters ---

@query("d01_dashboard", "total:long, processing:long, needs_review:long, payroll_ready:long, failed:long, "
       "open_blockers:long, open_warnings:long",
       """SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'PROCESSING') AS processing,
  COUNT(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review, COUNT(*) FILTER (status = 'PAYROLL_READY') AS payroll_ready,
  COUNT(*) FILTER (status = 'FAILED') AS failed,
  (SELECT COUNT(*) FROM fx_finding WHERE status = 'OPEN' AND severity = 'BLOCKER') AS open_blockers,
  (SELECT COUNT(*) FROM fx_finding WHERE status = 'OPEN' AND severity IN ('WARNING', 'ERROR')) AS open_warnings FROM fx_batch""")
def d01(t):
    return CO.dashboard(t.fx_batch, t.fx_finding)


@query("d02_finalisation", "batch_id:long, total:long, ignored:long, duplicates:long, processed:long, failed:long, "
       "review:long, payroll_ready:long, open_blockers:long, status:string", "SELECT * FROM ck_final")
def d02(t):
    return CO.finalise(t.fx_file, subs_of(t), t.fx_finding)


@query("d03_progress", "batch_id:long, total:long, done:long, failed:long, review:long, pct:double",
       """SELECT *, ROUND(done * 100.0 / GREATEST(total, 1), 1) AS pct FROM (SELECT batch_id, COUNT(*) AS total,
  COUNT(*) FILTER (processing_status = 'COMPLETED') AS done, COUNT(*) FILTER (processing_status = 'FAILED') AS failed,
  COUNT(*) FILTER (processing_status = 'NEEDS_REVIEW') AS review FROM fx_file GROUP BY 1) q""")
def d03(t):
    return CO.progress(t.fx_file)


@query("d04_file_stats", "batch_id:long, ocr_files:long, matched:long, unmatched:long, extraction_failed:long, non_sheet:long",
       """SELECT batch_id, COUNT(*) FILTER (ocr_required) AS ocr_files, COUNT(matched_employee_id) AS matched,
  COUNT(*) FILTER (matched_employee_id IS NULL AND NOT is_noise AND NOT is_duplicate AND is_candidate) AS unmatched,
  COUNT(*) FILTER (processing_status IN ('EXTRACTION_FAILED', 'FAILED')) AS extraction_failed,
  COUNT(*) FILTER (processing_status = 'NON_TIMESHEET_DOCUMENT') AS non_sheet FROM fx_file GROUP BY 1""")
def d04(t):
    return CO.file_stats(t.fx_file)


@query("d05_severity_histogram", "batch_id:long, blocker_count:long, error_count:long, warning_count:long, info_count:long",
       """SELECT batch_id, COUNT(*) FILTER (severity = 'BLOCKER') AS blocker_count, COUNT(*) FILTER (severity = 'ERROR') AS error_count,
  COUNT(*) FILTER (severity = 'WARNING') AS warning_count, COUNT(*) FILTER (severity = 'INFO') AS info_count
FROM fx_finding WHERE status = 'OPEN' AND rule_code <> 'TWO_MONTH_INACTIVE' GROUP BY 1""")
def d05(t):
    return CO.severity_histogram(t.fx_finding)


@query("d07_file_totals", "submission_id:long, hours:double",
       """SELECT submission_id, COALESCE(NULLIF(SUM(calculated_hours), 0), SUM(entered_hours), 0) AS hours
          FROM fx_order_entry GROUP BY 1""")
def d07(t):
    return CO.file_hours(t.fx_order_entry)


VENDOR_SQL = """
SELECT v.vendor_id, v.name, COUNT(*) AS submissions, COUNT(DISTINCT employee_id) AS employees,
  COALESCE(SUM(t.regular_hours), 0) AS regular_hours, COALESCE(SUM(t.overtime_hours), 0) AS overtime_hours,
  COUNT(*) FILTER (payroll_status = 'READY') AS ready
FROM ck_sub s JOIN fx_vendor v ON v.vendor_id = s.vendor_id LEFT JOIN ck_totals t ON t.submission_id = s.submission_id GROUP BY 1, 2"""


@query("d08_vendor_rollup", "vendor_id:long, name:string, submissions:long, employees:long, regular_hours:double, "
       "overtime_hours:double, ready:long", VENDOR_SQL)
def d08(t):
    return CO.vendor_rollup(subs_of(t), totals_of(t), t.fx_vendor)


@query("d10_month_gate", "months:long, enough:long",
       """SELECT COUNT(DISTINCT year(end_date) * 12 + month(end_date)) AS months,
          CASE WHEN COUNT(DISTINCT year(end_date) * 12 + month(end_date)) >= 2 THEN 1 ELSE 0 END AS enough
          FROM fx_order_sub WHERE payroll_status <> 'CANCELLED'""")
def d10(t):
    return R.month_gate(t.fx_order_sub).withColumn("enough", F.col("enough").cast("int"))


@query("d17_calendar_summary", "sheets:long, total_hours:double, not_extracted:long",
       """SELECT COUNT(*) AS sheets, SUM(h) AS total_hours,
  (SELECT COUNT(*) FROM fx_file WHERE NOT is_noise AND NOT is_duplicate AND is_candidate
     AND file_id NOT IN (SELECT file_id FROM ck_sub WHERE file_id IS NOT NULL)) AS not_extracted
FROM (SELECT submission_id, SUM(regular_hours + overtime_hours) AS h FROM ck_totals GROUP BY 1) q""")
def d17(t):
    sheets = totals_of(t).select("submission_id", (F.col("regular_hours") + F.col("overtime_hours")).alias("hours"))
    return CO.calendar_summary(sheets, R.missing_files(t.fx_file, subs_of(t)))


HOURS_SQL = "COALESCE(NULLIF(calculated_hours, 0), NULLIF(entered_hours, 0), 0)"


@query("d18_hour_buckets", "employee_id:long, regular:double, overtime:double, sick:double, other_leave:double, holiday:double, "
       "payable:double, worked_days:long, unique_dates:long, first_date:string, last_date:string",
       f"""SELECT employee_id, SUM(regular_hours) AS regular, SUM(overtime_hours) AS overtime,
  COALESCE(SUM({HOURS_SQL}) FILTER (leave_type = 'SICK' AND entry_type = 'LEAVE'), 0) AS sick,
  COALESCE(SUM({HOURS_SQL}) FILTER (leave_type IS NULL AND entry_type = 'LEAVE'), 0) AS other_leave,
  COALESCE(SUM({HOURS_SQL}) FILTER (entry_type = 'HOLIDAY'), 0) AS holiday,
  SUM(regular_hours + overtime_hours) AS payable, COUNT(*) FILTER (entry_type = 'WORK') AS worked_days,
  COUNT(DISTINCT work_date) AS unique_dates, MIN(work_date) AS first_date, MAX(work_date) AS last_date
FROM fx_claim GROUP BY employee_id""")
def d18(t):
    return CO.hour_buckets(t.fx_claim)


@query("d19_approve_queue", "job_id:long, pending:long",
       """SELECT j.job_id, COUNT(m.job_id) AS pending FROM (SELECT DISTINCT job_id FROM fx_message) j LEFT JOIN
          (SELECT job_id FROM fx_message WHERE stored_status = 'PENDING_APPROVAL') m ON m.job_id = j.job_id GROUP BY 1""")
def d19(t):
    m = t.fx_message.withColumn("status", F.col("stored_status"))
    return CO.approve_queue(m.select("job_id").distinct(), m)


DAY_HOURS_SQL = f"CASE WHEN regular_hours + overtime_hours <> 0 THEN regular_hours + overtime_hours ELSE {HOURS_SQL} END"


@query("d21_month_totals", "submission_id:long, month:string, hours:double, rows:long",
       f"""SELECT submission_id, CAST(date_trunc('month', work_date) AS DATE) AS month, SUM({DAY_HOURS_SQL}) AS hours,
          COUNT(*) AS rows FROM fx_claim GROUP BY 1, 2""")
def d21(t):
    return CO.month_totals(t.fx_claim)


# --- order, pages, text ---

@query("f01_page_query", "batch_id:long, status:string, created_at:string",
       """SELECT batch_id, status, CAST(created_at AS DATE) AS created_at FROM fx_batch WHERE status = 'NEEDS_REVIEW'
          ORDER BY fx_batch.created_at DESC, batch_id LIMIT 100 OFFSET 200""")
def f01(t):
    page = PG.page(t.fx_batch.filter("status = 'NEEDS_REVIEW'"), [("created_at", True), ("batch_id", False)], 200, 100)
    return page.withColumn("created_at", F.col("created_at").cast("date"))


@query("f01_deep_page", "batch_id:long, status:string, size:double",
       "SELECT batch_id, status, size FROM fx_batch ORDER BY status, size DESC, batch_id LIMIT 150 OFFSET 1100")
def f01_deep(t):
    return PG.page(t.fx_batch, [("status", False), ("size", True), ("batch_id", False)], 1100, 150)


@query("f02_severity_order", "finding_id:long, severity:string, severity_rank:long",
       """SELECT finding_id, severity, CASE severity WHEN 'BLOCKER' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 3 ELSE 4 END
          AS severity_rank FROM fx_finding ORDER BY severity DESC, created_at DESC, finding_id LIMIT 100""")
def f02(t):
    page = PG.page(t.fx_finding, [("severity", True), ("created_at", True), ("finding_id", False)], 0, 100)
    return page.withColumn("severity_rank", PG.worst_first("severity", P.SEVERITIES))


@query("f03_name_order", "file_id:long, detected_name:string",
       "SELECT file_id, detected_name FROM fx_file ORDER BY lower(COALESCE(detected_name, 'z')), file_id LIMIT 500")
def f03(t):
    return PG.page(t.fx_file.withColumn("_name", PG.by_name("detected_name")), [("_name", False), ("file_id", False)], 0, 500)


@query("b13_formula_neutraliser", "file_id:long, file_name:string",
       """SELECT file_id, CASE WHEN substr(file_name, 1, 1) IN ('=', '+', '-', '@') THEN CONCAT('''', file_name)
          ELSE file_name END AS file_name FROM fx_file""")
def b13(t):
    return t.fx_file.select("file_id", RW.formula_safe(F.col("file_name")).alias("file_name"))


@query("b14_rule_exclusion", "finding_id:long, rule_code:string",
       """SELECT finding_id, rule_code FROM fx_finding WHERE rule_code NOT IN ('TWO_MONTH_INACTIVE')
          AND status = 'OPEN' AND severity = 'WARNING'""")
def b14(t):
    return R.excluding(t.fx_finding, ["TWO_MONTH_INACTIVE"], status="OPEN", severity="WARNING", batch_id=None)


@query("h31_text_formats", "submission_id:long, hours:string, share:string",
       """SELECT submission_id, COALESCE(CAST(CAST(h AS DECIMAL(18,2)) AS VARCHAR), 'MISSING') AS hours,
          CONCAT(CAST(submission_id % 101 AS VARCHAR), '%') AS share
          FROM (SELECT submission_id, CASE WHEN submission_id % 7 = 0 THEN NULL ELSE SUM(entered_hours) END AS h FROM fx_entry GROUP BY 1) q""")
def h31(t):
    s = t.fx_entry.groupBy("submission_id").agg(F.sum("entered_hours").alias("h"))
    k = F.col("submission_id")
    return s.select(k, RW.fixed_text(F.when(k % 7 != 0, F.col("h"))).alias("hours"),
                    RW.percent_text((k % 101 / 100).cast("decimal(6,4)")).alias("share"))


# --- reports ---

R1_COLS = "batch_id:long, label:string, value:string"
R1_SQL = """SELECT batch_id, label, value FROM (UNPIVOT (SELECT batch_id, status, CAST(total AS VARCHAR) AS total,
  CAST(processed AS VARCHAR) AS processed, CAST(failed AS VARCHAR) AS failed, CAST(ignored AS VARCHAR) AS ignored,
  CAST(duplicates AS VARCHAR) AS duplicates, CAST(review AS VARCHAR) AS review, CAST(payroll_ready AS VARCHAR) AS payroll_ready
  FROM ck_final) ON status, total, processed, failed, ignored, duplicates, review, payroll_ready INTO NAME label VALUE value)"""


@query("r01_batch_summary", R1_COLS, R1_SQL)
def r01(t):
    return RP.batch_summary(CO.finalise(t.fx_file, subs_of(t), t.fx_finding))


@query("r02_file_inventory", "batch_id:long, file_id:long, folder:string, file_name:string, file_ext:string, size_kb:double, "
       "detected_employee:string, matched_employee:string, match_status:string, ocr:string, duplicate:string, noise:string, status:string",
       """SELECT batch_id, file_id, folder_path AS folder, CASE WHEN substr(file_name, 1, 1) IN ('=', '-', '@')
    THEN CONCAT('''', file_name) ELSE file_name END AS file_name, file_ext, ROUND(size_bytes / 1024, 1) AS size_kb,
  CASE WHEN detected_name LIKE '-%' THEN CONCAT('''', detected_name) ELSE COALESCE(detected_name, '') END AS detected_employee,
  COALESCE(CAST(matched_employee_id AS VARCHAR), '') AS matched_employee, match_status,
  CASE WHEN ocr_required THEN 'Yes' ELSE 'No' END AS ocr, CASE WHEN is_duplicate THEN 'Yes' ELSE 'No' END AS duplicate,
  CASE WHEN is_noise THEN 'Yes' ELSE 'No' END AS noise, processing_status AS status FROM fx_file""")
def r02(t):
    return RP.file_inventory(t.fx_file)


@query("r03_entries", "batch_id:long, entry_id:long, employee_id:long, work_date:string, day:string, in_min:long, out_min:long, "
       "break_minutes:long, entered_hours:double, calculated_hours:double, regular_hours:double, overtime_hours:double, entry_type:string",
       """SELECT s.batch_id, w.entry_id, w.employee_id, CAST(work_date AS VARCHAR) AS work_date, dayname(work_date) AS day, in_min, out_min,
  break_minutes, entered_hours, calculated_hours, regular_hours, overtime_hours, entry_type FROM ck_weekly w JOIN ck_sub s
  ON s.submission_id = w.submission_id""")
def r03(t):
    return RP.entry_rows(weekly_of(t), subs_of(t))


@query("r04_exceptions", "batch_id:long, finding_id:long, severity:string, severity_rank:long, rule_code:string, employee:string, "
       "file:string, status:string",
       """SELECT batch_id, finding_id, severity, list_position(['BLOCKER', 'ERROR', 'WARNING', 'INFO'], severity) AS severity_rank,
          rule_code, CAST(employee_id AS VARCHAR) AS employee, CAST(file_id AS VARCHAR) AS file, status FROM fx_finding""")
def r04(t):
    return RP.exceptions(t.fx_finding)


@query("r05_employee_summary", "submission_id:long, employee:string, name:string, entries:long, regular_hours:double, "
       "overtime_hours:double, leave_days:long, approval_status:string, validation_status:string, payroll_status:string",
       """SELECT s.submission_id, CAST(s.employee_id AS VARCHAR) AS employee, CASE WHEN full_name LIKE '=%' THEN CONCAT('''', full_name)
    ELSE COALESCE(full_name, 'Unknown') END AS name, t.entries, ROUND(t.regular_hours, 2) AS regular_hours,
  ROUND(t.overtime_hours, 2) AS overtime_hours, t.leave_days, approval_status, validation_status, payroll_status
FROM ck_sub s LEFT JOIN fx_people p ON p.employee_id = s.employee_id LEFT JOIN ck_totals t ON t.submission_id = s.submission_id""")
def r05(t):
    return RP.employee_summary(subs_of(t), totals_of(t), t.fx_people)


@query("r06_vendor_summary", "vendor_id:long, name:string, submissions:long, employees:long, regular_hours:double, "
       "overtime_hours:double, ready:long", VENDOR_SQL)
def r06(t):
    return CO.vendor_rollup(subs_of(t), totals_of(t), t.fx_vendor)


@query("r07_payroll_report", "submission_id:long, employee:string, name:string, regular_hours:double, overtime_hours:double, "
       "regular_rate:string, overtime_rate:string, regular_pay:string, overtime_pay:string, total_pay:string, currency:string, payroll_status:string",
       """SELECT m.submission_id, CAST(m.employee_id AS VARCHAR) AS employee, CASE WHEN full_name LIKE '=%' THEN CONCAT('''', full_name)
    ELSE COALESCE(full_name, 'Unknown') END AS name, rh AS regular_hours, oh AS overtime_hours,
  COALESCE(CAST(rr AS VARCHAR), 'MISSING') AS regular_rate, COALESCE(CAST(CAST(orate AS DECIMAL(12,4)) AS VARCHAR), 'MISSING') AS overtime_rate,
  COALESCE(CAST(NULLIF(rp, 0) AS VARCHAR), 'MISSING') AS regular_pay, COALESCE(CAST(NULLIF(op, 0) AS VARCHAR), 'N/A') AS overtime_pay,
  COALESCE(CAST(NULLIF(rp + op, 0) AS VARCHAR), 'MISSING') AS total_pay, 'USD' AS currency, payroll_status
FROM ck_money m LEFT JOIN fx_people p ON p.employee_id = m.employee_id""")
def r07(t):
    return RP.payroll_report(subs_of(t), totals_of(t), t.fx_rate, t.fx_people)


R8_COLS = ("submission_id:long, employee_id:string, employee_name:string, period_start:string, period_end:string, reg_hours:double, "
           "ot_hours:double, reg_pay:double, ot_pay:double, total_pay:double, currency:string, cost_center:string, department:string")
R8_SQL = """SELECT m.submission_id, COALESCE(employee_code, CAST(m.employee_id AS VARCHAR)) AS employee_id,
  CASE WHEN full_name LIKE '=%' THEN CONCAT('''', full_name) ELSE full_name END AS employee_name,
  CAST(start_date AS VARCHAR) AS period_start, CAST(end_date AS VARCHAR) AS period_end, rh AS reg_hours, oh AS ot_hours,
  COALESCE(rp, 0) AS reg_pay, COALESCE(op, 0) AS ot_pay, COALESCE(rp, 0) + COALESCE(op, 0) AS total_pay,
  'USD' AS currency, '' AS cost_center, '' AS department
FROM ck_money m LEFT JOIN fx_people p ON p.employee_id = m.employee_id WHERE payroll_status = 'READY'"""


@query("r08_pay_export", R8_COLS, R8_SQL)
def r08(t):
    return RP.pay_export(subs_of(t), totals_of(t), t.fx_rate, t.fx_people)


R9_COLS = ("batch_id:long, file_id:long, file_name:string, folder_path:string, document_type:string, employee_candidate:string, "
           "matched_employee:string, match_status:string, match_confidence:string, extraction_method:string, extraction_status:string, "
           "extraction_confidence:string, entry_count:long, total_hours:string, regular_hours:string, overtime_hours:string, "
           "period_start:string, period_end:string, approval_status:string, payroll_status:string, blocker_count:long, "
           "warning_count:long, ocr_used:string, duplicate:string, notes:string")


def summary_of(t):
    w = weekly_of(t).groupBy("submission_id").agg(
        F.sum("calculated_hours").alias("c"), F.sum("entered_hours").alias("e"),
        F.sum("regular_hours").alias("regular"), F.sum("overtime_hours").alias("overtime"))
    hours = w.select("submission_id", F.coalesce(F.nullif(F.col("c"), F.lit(0)), F.col("e")).alias("hours"),
                     "regular", "overtime")
    return RP.file_summary(t.fx_file, subs_of(t), hours, t.fx_finding, t.fx_people)


@query("r09_file_summary", R9_COLS, "SELECT * FROM ck_summary")
def r09(t):
    return summary_of(t)


@query("a10_report_sink", "name:string, n:long",
       f"""SELECT 'summary' AS name, COUNT(*) AS n FROM ({R1_SQL}) a UNION ALL SELECT 'files', COUNT(*) FROM fx_file
  UNION ALL SELECT 'entries', COUNT(*) FROM ck_weekly UNION ALL SELECT 'exceptions', COUNT(*) FROM fx_finding
  UNION ALL SELECT 'employees', COUNT(*) FROM ck_sub UNION ALL SELECT 'vendors', COUNT(*) FROM ({VENDOR_SQL}) v
  UNION ALL SELECT 'payroll', COUNT(*) FROM ck_money UNION ALL SELECT 'export', COUNT(*) FROM ({R8_SQL}) x""")
def a10(t):
    root = shared_folder(t.spark, "reports")
    people, rates = t.fx_people, t.fx_rate
    entries, subs = staged(weekly_of(t), "weekly"), staged(subs_of(t), "subs")  # these and the totals feed several reports
    totals = staged(PAY.submission_totals(entries.withColumn("is_holiday", F.col("entry_type") == "HOLIDAY")), "totals")
    reports = {"summary": RP.batch_summary(CO.finalise(t.fx_file, subs, t.fx_finding)),
               "files": RP.file_inventory(t.fx_file), "entries": RP.entry_rows(entries, subs),
               "exceptions": RP.exceptions(t.fx_finding),
               "employees": RP.employee_summary(subs, totals, people),
               "vendors": CO.vendor_rollup(subs, totals, t.fx_vendor),
               "payroll": RP.payroll_report(subs, totals, rates, people),
               "export": RP.pay_export(subs, totals, rates, people)}
    SK.write_reports(reports, root)
    return CH.union_counts({n: t.spark.read.parquet(f"{root}/{n}") for n in reports})


@query("a11_csv_summary_sink", R9_COLS, "SELECT * FROM ck_summary")
def a11(t):
    path = shared_folder(t.spark, "summary")
    SK.write_summary_csv(summary_of(t), path)
    back = t.spark.read.option("header", "true").option("escape", '"').csv(path)
    return back.na.fill("")


# --- calendar, corrections, approvals ---

@query("j04_inactivity_report", "employee_id:long, last_seen:string, months_inactive:long, never_submitted:long",
       """SELECT employee_id, CAST(last AS VARCHAR) AS last_seen, CASE WHEN last IS NULL THEN NULL ELSE date_sub('month', last, DATE '2001-01-15') END
            AS months_inactive, CASE WHEN last IS NULL THEN 1 ELSE 0 END AS never_submitted
FROM (SELECT e.employee_id, MAX(s.end_date) AS last FROM fx_employee e LEFT JOIN fx_order_sub s ON s.employee_id = e.employee_id
  WHERE is_active GROUP BY 1) q WHERE last IS NULL OR last < DATE '2000-11-15'""")
def j04(t):
    out = R.inactivity_report(t.fx_employee, t.fx_order_sub, "2001-01-15")
    return out.withColumn("never_submitted", F.col("never_submitted").cast("int"))


@query("j08_calendar_gaps", "submission_id:long, work_date:string",
       f"""SELECT submission_id, CAST(d AS DATE) AS work_date FROM (SELECT submission_id, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS d
  FROM fx_submission) s WHERE isodow(d) <= 5 AND NOT EXISTS (SELECT 1 FROM fx_claim c WHERE c.submission_id = s.submission_id
  AND c.work_date = s.d GROUP BY work_date HAVING SUM({DAY_HOURS_SQL}) > 0)""")
def j08(t):
    days = t.fx_claim.withColumn("h", CO.day_hours()).groupBy("submission_id", "work_date").agg(F.sum("h").alias("hours"))
    return CAL.missing_days(t.fx_submission, days)


@query("j09_day_labels", "entry_id:long, label:string",
       f"""SELECT entry_id, CASE WHEN overtime_hours > 0 THEN 'OT' WHEN entry_type = 'LEAVE' THEN COALESCE(leave_type, 'Leave')
          WHEN entry_type = 'HOLIDAY' THEN 'Holiday' WHEN {DAY_HOURS_SQL} = 0 THEN '' ELSE 'Work' END AS label FROM fx_claim""")
def j09(t):
    return t.fx_claim.withColumn("hours", CO.day_hours()).select("entry_id", CAL.day_label().alias("label"))


def patched(t):
    base = t.fx_entry.withColumn("validation_status", F.lit("PASSED"))
    return CH.overlay(base, t.fx_patch, "entry_id")


@query("b12_manual_override", "entry_id:long, entered_hours:double, in_min:long, entry_type:string, validation_status:string",
       """SELECT e.entry_id, COALESCE(p.entered_hours, e.entered_hours) AS entered_hours, COALESCE(p.in_min, e.in_min) AS in_min,
          COALESCE(p.entry_type, e.entry_type) AS entry_type, CASE WHEN p.entry_id IS NULL THEN 'PASSED' ELSE 'PENDING' END AS validation_status
          FROM fx_entry e LEFT JOIN fx_patch p ON p.entry_id = e.entry_id""")
def b12(t):
    return patched(t)


@query("j05_change_capture", "entry_id:long, field:string, before:string, after:string",
       """SELECT e.entry_id, 'entered_hours' AS field, CAST(e.entered_hours AS VARCHAR) AS before, CAST(p.entered_hours AS VARCHAR) AS after
  FROM fx_entry e JOIN fx_patch p ON p.entry_id = e.entry_id WHERE p.entered_hours <> e.entered_hours
UNION ALL SELECT e.entry_id, 'in_min', CAST(e.in_min AS VARCHAR), CAST(p.in_min AS VARCHAR)
  FROM fx_entry e JOIN fx_patch p ON p.entry_id = e.entry_id WHERE p.in_min <> e.in_min
UNION ALL SELECT e.entry_id, 'entry_type', e.entry_type, p.entry_type
  FROM fx_entry e JOIN fx_patch p ON p.entry_id = e.entry_id WHERE p.entry_type <> e.entry_type""")
def j05(t):
    return CH.changes(t.fx_entry, patched(t), "entry_id", ["entered_hours", "in_min", "entry_type"])


@query("j05_audit_records", "entity_id:string, action:string, fields:string, before_json:string, after_json:string, version:long",
       """SELECT CAST(entry_id AS VARCHAR) AS entity_id, 'UPDATE' AS action, concat_ws(',', CASE WHEN h THEN 'entered_hours' END, CASE WHEN i THEN 'in_min' END, CASE WHEN k THEN 'entry_type' END) AS fields,
  '{' || concat_ws(',', CASE WHEN h THEN '"entered_hours":' || h0 END, CASE WHEN i THEN '"in_min":' || i0 END, CASE WHEN k THEN '"entry_type":"' || k0 || '"' END) || '}' AS before_json,
  '{' || concat_ws(',', CASE WHEN h THEN '"entered_hours":' || h1 END, CASE WHEN i THEN '"in_min":' || i1 END, CASE WHEN k THEN '"entry_type":"' || k1 || '"' END) || '}' AS after_json,
  entry_id % 3 AS version
FROM (SELECT e.entry_id, e.entered_hours AS h0, e.in_min AS i0, e.entry_type AS k0, p.entered_hours AS h1, p.in_min AS i1, p.entry_type AS k1,
    COALESCE(p.entered_hours <> e.entered_hours, FALSE) AS h, COALESCE(p.in_min <> e.in_min, FALSE) AS i, COALESCE(p.entry_type <> e.entry_type, FALSE) AS k
  FROM fx_entry e JOIN fx_patch p ON p.entry_id = e.entry_id) q WHERE h OR i OR k""")
def j05_audit(t):
    fields = ["entry_id", "entered_hours", "in_min", "entry_type"]
    records = CH.audit_log(t.fx_entry.select(*fields), patched(t).select(*fields), "entry_id", "entry", "UPDATE")
    home = shared_folder(t.spark, "audit")
    part = F.col("entity_id").cast("long") % 3
    for version in (0, 1, 2, 1):  # the second is written twice, as after a lost run
        CH.append_version(records.filter(part == version), home, version)
    return CH.read_log(t.spark, home).withColumn("fields", F.array_join("fields", ","))


@query("j06_approval_application", "submission_id:long, approval_status:string, approver_name:string, approver_email:string, approved_on:string",
       """SELECT s.submission_id, COALESCE(e.status, s.approval_status) AS approval_status,
  COALESCE(NULLIF(e.name, ''), s.approver_name) AS approver_name, COALESCE(e.email, s.approver_email) AS approver_email,
  CASE WHEN e.status = 'APPROVED' THEN CAST(e.decided_at AS DATE) END AS approved_on
FROM fx_submission s LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY submission_id ORDER BY decided_at DESC, event_id DESC) AS rn
  FROM fx_approval) e ON e.submission_id = s.submission_id AND rn = 1""")
def j06(t):
    out = CH.apply_approvals(t.fx_submission, t.fx_approval)
    return out.withColumn("approved_on", F.col("approved_at").cast("date"))


@query("j07_resolve_and_refinalise", "batch_id:long, open_blockers:long, status:string",
       """SELECT b.batch_id, COUNT(*) FILTER (x.severity = 'BLOCKER' AND x.status = 'OPEN' AND x.finding_id % 10 > 2) AS open_blockers,
  CASE WHEN bool_or(stuck) OR COUNT(*) FILTER (x.severity = 'BLOCKER' AND x.status = 'OPEN' AND x.finding_id % 10 > 2) > 0
    THEN 'NEEDS_REVIEW' ELSE 'PAYROLL_READY' END AS status
FROM (SELECT batch_id, bool_or(processing_status IN ('FAILED', 'NEEDS_REVIEW', 'EXTRACTION_FAILED')) AS stuck FROM fx_file GROUP BY 1) b
LEFT JOIN fx_finding x ON x.batch_id = b.batch_id GROUP BY 1""")
def j07(t):
    fixes = t.fx_finding.filter("finding_id % 10 <= 2").select(
        "finding_id", F.lit("HR").alias("reviewer"), F.lit("checked").alias("note"))
    return CO.finalise(t.fx_file, subs_of(t), CH.resolve(t.fx_finding, fixes))

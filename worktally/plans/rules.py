"""Validation rules, their union and the readiness verdict."""

from pyspark.sql import functions as F

from worktally import params as P
from worktally.operators import entries as E
from worktally.operators import rules as R
from worktally.operators.payroll import submission_totals
from worktally.plans.core import weekly_of
from worktally.plans.registry import query
from worktally.sources.stages import staged

COLS = ("rule_code:string, severity:string, file_id:string, submission_id:string, entry_id:string, "
        "employee_id:string, expected_value:string, actual_value:string")


def rows(code, severity, source, where="TRUE", expected="NULL", actual="NULL",
         file_id="NULL", submission_id="NULL", entry_id="NULL", employee_id="NULL"):
    """SELECT text of one rule in the finding schema."""
    return (f"SELECT {code} AS rule_code, {severity} AS severity, {file_id} AS file_id, "
            f"{submission_id} AS submission_id, {entry_id} AS entry_id, {employee_id} AS employee_id, "
            f"CAST({expected} AS VARCHAR) AS expected_value, CAST({actual} AS VARCHAR) AS actual_value "
            f"FROM {source} WHERE {where}")


ENTRY_IDS = dict(submission_id="submission_id", entry_id="entry_id", employee_id="employee_id")
SUB_IDS = dict(submission_id="submission_id", employee_id="employee_id")
CANDIDATE = "NOT is_noise AND NOT is_duplicate AND is_candidate"
CLAIM = "COALESCE(NULLIF(calculated_hours, 0), NULLIF(entered_hours, 0), CAST(0 AS DECIMAL(10,2)))"


def unseen(code, status="AND x.status = 'OPEN'"):
    return (f"NOT EXISTS (SELECT 1 FROM fx_finding x WHERE x.file_id = f.file_id "
            f"AND x.rule_code = '{code}' {status})")


SQL = {
    "i01": rows("'EMPLOYEE_NOT_MATCHED'", "'WARNING'", "fx_file f",
                f"{CANDIDATE} AND matched_employee_id IS NULL AND {unseen('EMPLOYEE_NOT_MATCHED')}",
                file_id="file_id"),
    "i02": rows("'EXTRACTION_FAILED'", "'BLOCKER'", "fx_file f",
                f"{CANDIDATE} AND processing_status IN ('EXTRACTION_FAILED', 'NEEDS_REVIEW', 'FAILED') "
                f"AND entry_count = 0 AND {unseen('EXTRACTION_FAILED')}", file_id="file_id"),
    "i03": rows("'NON_TIMESHEET_DOCUMENT'", "'INFO'", "fx_file f",
                "processing_status = 'NON_TIMESHEET_DOCUMENT' AND "
                + unseen("NON_TIMESHEET_DOCUMENT", ""), file_id="file_id"),
    "i04": rows("'DAILY_HOURS_EXCEED'", "'ERROR'", "fx_claim", f"{CLAIM} > 16", "16",
                f"CAST({CLAIM} AS DECIMAL(10,2))", **ENTRY_IDS),
    "i05": rows("'DAILY_REGULAR_LIMIT_EXCEEDED'", "'WARNING'", "ck_weekly",
                "regular_hours > daily_limit + 0.1", "CAST(daily_limit AS DECIMAL(10,2))",
                "CAST(regular_hours AS DECIMAL(10,2))", **ENTRY_IDS),
    "i06": rows("'WEEKLY_HOURS_EXCEED'", "CASE WHEN allowed THEN 'WARNING' ELSE 'ERROR' END",
                f"""(SELECT submission_id, employee_id, strftime(work_date, '%Y-W%W') AS week,
                    SUM({CLAIM}) AS total, MAX(weekly_limit) AS lim, BOOL_AND(ot_allowed) AS allowed
                    FROM ck_weekly WHERE entry_type = 'WORK' GROUP BY ALL) q""",
                "total > lim", "CAST(lim AS DECIMAL(10,2))", "CAST(total AS DECIMAL(20,2))", **SUB_IDS),
    "i07": rows("'HOLIDAY_WORK'", "'WARNING'", "ck_holiday", "holiday_name IS NOT NULL", "0",
                f"CAST({CLAIM} AS DECIMAL(10,2))", **ENTRY_IDS),
    "i08": rows("'MISSING_APPROVAL'", "'BLOCKER'", "fx_submission",
                "approver_name IS NULL AND approver_email IS NULL", **SUB_IDS),
    "i09": rows("'LATE_SUBMISSION'", "'WARNING'",
                "fx_submission s JOIN fx_period p ON p.period_id = s.period_id",
                "submitted_at > cutoff_date", "cutoff_date", "CAST(submitted_at AS DATE)", **SUB_IDS),
    "i10": rows("'MISSING_RATE'", "'BLOCKER'", "fx_submission s",
                """EXISTS (SELECT 1 FROM fx_employee e WHERE e.employee_id = s.employee_id)
                   AND s.employee_id NOT IN (SELECT employee_id FROM fx_rate
                     WHERE DATE '2024-02-01' BETWEEN effective_start
                       AND COALESCE(effective_end, DATE '9999-12-31'))""", **SUB_IDS),
    "i11": rows("'HOURS_TOTAL_MISMATCH'", "'ERROR'", "ck_weekly",
                f"{CLAIM} > 0 AND abs({CLAIM} - regular_hours - overtime_hours) > 0.1",
                f"CAST({CLAIM} AS DECIMAL(10,2))",
                "CAST(regular_hours + overtime_hours AS DECIMAL(10,2))", **ENTRY_IDS),
    "i12": rows("'MISSING_TIMESHEET'", "'ERROR'", "fx_employee",
                "is_active AND employee_id NOT IN (SELECT employee_id FROM fx_submission)",
                employee_id="employee_id"),
    "i13": rows("'TWO_MONTH_INACTIVE'", "'WARNING'",
                """(SELECT e.employee_id, MAX(s.submitted_at) AS last FROM fx_employee e
                    LEFT JOIN fx_order_sub s ON s.employee_id = e.employee_id
                    WHERE is_active GROUP BY 1) q""",
                """(last IS NULL OR last < DATE '2000-11-15') AND (
                    SELECT COUNT(DISTINCT strftime(end_date, '%Y-%m')) FROM fx_order_sub
                    WHERE payroll_status <> 'CANCELLED') >= 2""", employee_id="employee_id"),
    "i14": rows("'INVALID_DATE'", "'ERROR'", "ck_built",
                "work_date IS NULL AND raw_date LIKE 'INVALID%'", actual="raw_date", file_id="file_id",
                submission_id="submission_id", entry_id="seq", employee_id="employee_id"),
    "i17": rows("'DAILY_HOURS_MISMATCH'", "'ERROR'", "ck_split", "mismatch",
                "CAST(calculated_hours AS DECIMAL(10,2))", "CAST(entered_hours AS DECIMAL(10,2))",
                **ENTRY_IDS),
    "i18": rows("'OVERTIME_NOT_ALLOWED'", "'ERROR'", "ck_split",
                "NOT ot_allowed AND payroll_hours > daily_limit", "0",
                "CAST(payroll_hours - daily_limit AS DECIMAL(10,2))", **ENTRY_IDS),
    "i19": rows("'OUT_OF_PERIOD_ENTRY'", "'WARNING'", "fx_claim",
                "work_date < DATE '2024-01-08' OR work_date > DATE '2024-01-21'",
                actual="work_date", **ENTRY_IDS),
}


def later_rows(code):
    from worktally.plans.core import DISPOSITION_SQL
    return f"""SELECT d.disposition AS rule_code,
  CASE d.disposition WHEN 'OVERLAPPING_DATE_CONFLICT' THEN 'BLOCKER' WHEN 'DUPLICATE_DATE' THEN 'WARNING'
       ELSE 'ERROR' END AS severity,
  d.file_id, d.submission_id, d.seq AS entry_id, b.employee_id,
  CASE WHEN d.disposition = 'OVERLAPPING_DATE_CONFLICT' THEN
    CAST(CAST(COALESCE(NULLIF(s_calc, 0), s_ent, 0) AS DECIMAL(10,2)) AS VARCHAR) END AS expected_value,
  CASE d.disposition WHEN 'DUPLICATE_DATE' THEN CAST(b.work_date AS VARCHAR)
    WHEN 'IMPLAUSIBLE_HOURS' THEN CAST(CAST(GREATEST(COALESCE(entered_hours, 0),
         COALESCE(calculated_hours, 0)) AS DECIMAL(10,2)) AS VARCHAR)
    ELSE CAST(CAST(COALESCE(entered_hours, 0) AS DECIMAL(10,2)) AS VARCHAR) END AS actual_value
FROM ({DISPOSITION_SQL}) d JOIN ck_built b ON b.seq = d.seq WHERE d.disposition IN ({code})"""


@query("i01_employee_not_matched", COLS, SQL["i01"])
def i01(t):
    return R.employee_not_matched(t.fx_file, t.fx_finding)


@query("i02_extraction_failed", COLS, SQL["i02"])
def i02(t):
    return R.extraction_failed(t.fx_file, t.fx_file.select("file_id", "entry_count"), t.fx_finding)


@query("i03_non_timesheet_document", COLS, SQL["i03"])
def i03(t):
    return R.non_sheet(t.fx_file, t.fx_finding)


@query("i04_daily_hours_exceed", COLS, SQL["i04"])
def i04(t):
    return R.apply_rule(t.fx_claim, R.daily_hours_rule())


@query("i05_daily_regular_limit", COLS, SQL["i05"])
def i05(t):
    return R.apply_rule(weekly_of(t), R.regular_limit_rule())


@query("i06_weekly_hours_exceed", COLS, SQL["i06"])
def i06(t):
    return R.weekly_hours_exceed(weekly_of(t))


@query("i07_holiday_work", COLS, SQL["i07"])
def i07(t):
    return R.holiday_work(t.fx_claim, t.fx_employee, t.fx_holiday)


@query("i07_holiday_flags", "entry_id:long, entry_type:string, is_holiday:long, holiday_name:string",
       """SELECT entry_id, entry_type, CASE WHEN holiday_name IS NOT NULL THEN 1 ELSE 0 END AS is_holiday, holiday_name FROM ck_holiday""")
def i07_flags(t):
    """The rule's second output: all entries, flagged."""
    named = R.with_holiday(t.fx_claim, t.fx_employee, t.fx_holiday)
    return R.flag_holidays(named).withColumn("is_holiday", F.col("is_holiday").cast("int"))


@query("d06_flagged_holiday_hours", "submission_id:long, holiday_hours:double, leave_days:long, entries:long",
       """SELECT submission_id, COALESCE(SUM(calculated_hours) FILTER (holiday_name IS NOT NULL), 0) AS holiday_hours,
          COUNT(*) FILTER (entry_type = 'LEAVE') AS leave_days, COUNT(*) AS entries FROM ck_holiday GROUP BY 1""")
def d06_flagged(t):
    """Submission totals that count holiday hours by the flag the rule has set."""
    return submission_totals(R.flag_holidays(R.with_holiday(t.fx_claim, t.fx_employee, t.fx_holiday)))


@query("c05_holiday_match", "entry_id:long, employee_type:string, holiday_name:string",
       "SELECT entry_id, employee_type, holiday_name FROM ck_holiday")
def c05(t):
    return R.with_holiday(t.fx_claim, t.fx_employee, t.fx_holiday)


@query("c05_holiday_scoped_only", "entry_id:long, employee_type:string, holiday_name:string",
       "SELECT entry_id, employee_type, holiday_name FROM ck_holiday_scoped")
def c05_scoped(t):
    scoped = t.fx_holiday.filter(F.col("applies_to").isNotNull())
    return R.with_holiday(t.fx_claim, t.fx_employee, scoped)


@query("i08_missing_approval", COLS, SQL["i08"])
def i08(t):
    return R.missing_approval(t.fx_submission)


@query("i09_late_submission", COLS, SQL["i09"])
def i09(t):
    return R.late_submission(t.fx_submission, t.fx_period)


@query("i09_late_flags", "submission_id:long, is_late:long",
       """SELECT submission_id, CASE WHEN submitted_at > cutoff_date THEN 1 ELSE 0 END AS is_late
          FROM fx_submission s LEFT JOIN fx_period p ON p.period_id = s.period_id""")
def i09_flags(t):
    """The rule's second output: all submissions, flagged."""
    as_of = F.lit("2024-02-01").cast("date")
    return R.with_submission_facts(t.fx_submission, t.fx_period, t.fx_employee, t.fx_rate, as_of).withColumn("is_late", F.col("is_late").cast("int"))


@query("c08_late_check", "submission_id:long, submitted_at:string, cutoff_date:string",
       """SELECT submission_id, CAST(CAST(submitted_at AS DATE) AS VARCHAR) AS submitted_at, cutoff_date
          FROM fx_submission s, fx_period p
          WHERE p.period_id = s.period_id AND s.submitted_at > p.cutoff_date""")
def c08(t):
    return R.late_rows(t.fx_submission, t.fx_period).withColumn(
        "submitted_at", F.col("submitted_at").cast("date"))


@query("i10_missing_rate", COLS, SQL["i10"])
def i10(t):
    return R.missing_rate(t.fx_submission, t.fx_employee, t.fx_rate, F.lit("2024-02-01").cast("date"))


@query("i11_hours_total_mismatch", COLS, SQL["i11"])
def i11(t):
    return R.apply_rule(weekly_of(t), R.total_mismatch_rule())


@query("i12_missing_timesheet", COLS, SQL["i12"])
def i12(t):
    return R.missing_sheet(t.fx_employee, t.fx_submission)


@query("i13_two_month_inactive", COLS, SQL["i13"])
def i13(t):
    return R.two_month_inactive(t.fx_employee, t.fx_order_sub, "2001-01-15")


def built_of(t):
    return E.build_entries(t.fx_raw, t.fx_employee, t.fx_vendor)


@query("i14_invalid_date", COLS, SQL["i14"], heavy=True)
def i14(t):
    return R.build_findings(built_of(t), ["INVALID_DATE"])


@query("i15_duplicate_or_conflicting_date", COLS, later_rows("'OVERLAPPING_DATE_CONFLICT', 'DUPLICATE_DATE'"), heavy=True)
def i15(t):
    return R.build_findings(built_of(t), ["OVERLAPPING_DATE_CONFLICT", "DUPLICATE_DATE"])


@query("i16_implausible_hours", COLS, later_rows("'IMPLAUSIBLE_HOURS'"), heavy=True)
def i16(t):
    return R.build_findings(built_of(t), ["IMPLAUSIBLE_HOURS"])


@query("i17_daily_hours_mismatch", COLS, SQL["i17"])
def i17(t):
    return R.apply_rule(weekly_of(t), R.hours_mismatch_rule())


@query("i18_overtime_not_allowed", COLS, SQL["i18"])
def i18(t):
    return R.apply_rule(weekly_of(t), R.overtime_barred_rule())


@query("i19_out_of_period_entry", COLS, SQL["i19"])
def i19(t):
    day = lambda d: F.lit(d).cast("date")
    return R.out_of_period(t.fx_claim, day("2024-01-08"), day("2024-01-21"))


ISSUES_SQL = """
SELECT submission_id, CAST(work_date AS VARCHAR) AS work_date,
  CASE WHEN SUM(COALESCE(entered_hours, 0)) > 16 THEN 'DAILY_HOURS_EXCEED' ELSE 'ZERO_HOURS_DAY' END AS rule_code,
  SUM(COALESCE(entered_hours, 0)) AS hours
FROM fx_claim GROUP BY submission_id, work_date
HAVING SUM(COALESCE(entered_hours, 0)) > 16 OR SUM(COALESCE(entered_hours, 0)) = 0
UNION ALL SELECT submission_id, NULL, 'MISSING_HOURS', COUNT(*) FROM fx_claim
WHERE COALESCE(entered_hours, 0) = 0 GROUP BY submission_id"""


@query("i21_zero_or_missing_hours", "submission_id:long, work_date:string, rule_code:string, hours:double",
       f"SELECT * FROM ({ISSUES_SQL}) q WHERE rule_code <> 'DAILY_HOURS_EXCEED'")
def i21(t):
    return R.day_issues(t.fx_claim).filter(F.col("rule_code") != "DAILY_HOURS_EXCEED")


@query("d11_daily_sum_issues", "submission_id:long, work_date:string, rule_code:string, hours:double",
       ISSUES_SQL + """ UNION ALL SELECT submission_id, NULL, 'WEEKLY_HOURS_EXCEED', SUM(entered_hours)
       FROM fx_claim GROUP BY 1 HAVING SUM(entered_hours) > 80""")
def d11(t):
    # one pass over the days feeds both the day rules and the total
    return R.day_issues(t.fx_claim).unionByName(R.doubled_week(t.fx_claim), allowMissingColumns=True)


ALL_ENTRY = ["i05", "i06", "i11", "i17", "i18"]


def batch_findings(t, subs=None):
    """All findings of a batch. Each base table is read in one tagged pass that lists a row's findings, exploded once; only
    totals of weeks and the roster's missing sheets need a second look, at written tables."""
    weekly = staged(weekly_of(t), "weekly")
    subs = subs or submission_facts(t)
    claims = R.with_holiday(t.fx_claim, t.fx_employee, t.fx_holiday)
    return R.union_all([
        R.apply_rules(weekly, [R.regular_limit_rule(), R.total_mismatch_rule(), R.hours_mismatch_rule(),
                               R.overtime_barred_rule()]),
        R.weekly_hours_exceed(weekly),
        R.apply_rules(claims, [R.daily_hours_rule(), R.holiday_rule()]),
        R.apply_rules(subs, R.submission_rules()),
        R.missing_sheet(t.fx_employee, subs)])


def submission_facts(t):
    return staged(R.with_submission_facts(t.fx_submission, t.fx_period, t.fx_employee, t.fx_rate, F.lit("2024-02-01").cast("date")), "submissions")


UNION_SQL = "\nUNION ALL ".join(SQL[k] for k in [*ALL_ENTRY, "i04", "i07", "i08", "i09", "i10", "i12"])


@query("g01_rule_union", COLS, UNION_SQL)
def g01(t):
    return batch_findings(t)


@query("i22_readiness_verdict",
       "submission_id:long, blockers:long, errors:long, warnings:long, validation_status:string, "
       "payroll_status:string",
       f"""SELECT s.submission_id, COUNT(*) FILTER (severity = 'BLOCKER') AS blockers,
  COUNT(*) FILTER (severity = 'ERROR') AS errors, COUNT(*) FILTER (severity = 'WARNING') AS warnings,
  CASE WHEN COUNT(*) FILTER (severity IN ('BLOCKER', 'ERROR')) > 0 THEN 'FAILED' ELSE 'PASSED' END
    AS validation_status,
  CASE WHEN COUNT(*) FILTER (severity IN ('BLOCKER', 'ERROR')) > 0 THEN 'NOT_READY' ELSE 'READY' END
    AS payroll_status
FROM fx_submission s LEFT JOIN ({UNION_SQL}) f ON f.submission_id = s.submission_id
GROUP BY s.submission_id""")
def i22(t):
    subs = submission_facts(t)
    return R.readiness(subs.select("submission_id"), batch_findings(t, subs))


@query("g04_refresh_by_rule", "rule_code:string, status:string, severity:string, n:long",
       f"""SELECT rule_code, status, severity, COUNT(*) AS n FROM (
  SELECT rule_code, status, severity FROM fx_finding
  WHERE NOT (status = 'OPEN' AND rule_code IN ({", ".join(f"'{c}'" for c in P.REGENERATED_RULES)}))
  UNION ALL SELECT rule_code, 'OPEN', severity FROM ({SQL["i04"]}) n) q GROUP BY ALL""")
def g04(t):
    old = t.fx_finding.select("rule_code", "severity", "status")
    new = R.apply_rule(t.fx_claim, R.daily_hours_rule()).select("rule_code", "severity", "status")
    return R.refresh(old, new).groupBy("rule_code", "status", "severity").agg(F.count("*").alias("n"))


@query("c16_idempotent_insert", "file_id:string, rule_code:string",
       f"SELECT file_id, rule_code FROM ({SQL['i02']}) q")
def c16(t):
    stuck = t.fx_file.filter(F.col("processing_status").isin("EXTRACTION_FAILED", "NEEDS_REVIEW", "FAILED"))
    rows_ = R.candidates(stuck).filter(F.col("entry_count") == 0)
    return R.without_open(R.finding(rows_, "EXTRACTION_FAILED", "BLOCKER"), t.fx_finding)


DOMAINS = {"severity": ["BLOCKER", "ERROR", "WARNING"], "status": ["OPEN", "IGNORED"]}
DOMAIN_SQL = """SELECT finding_id, 'severity' AS bad_column FROM fx_finding
WHERE severity NOT IN ('BLOCKER', 'ERROR', 'WARNING')
UNION ALL SELECT finding_id, 'status' FROM fx_finding WHERE status NOT IN ('OPEN', 'IGNORED')"""


@query("i00_constraint_check", "finding_id:long, bad_column:string", DOMAIN_SQL)
def i00(t):
    return R.outside_domain(t.fx_finding, DOMAINS)


@query("b15_enumeration_check", "bad_column:string, n:long",
       f"SELECT bad_column, COUNT(*) AS n FROM ({DOMAIN_SQL}) q GROUP BY 1")
def b15(t):
    return R.outside_domain(t.fx_finding, DOMAINS).groupBy("bad_column").agg(F.count("*").alias("n"))

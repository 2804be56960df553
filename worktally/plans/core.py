"""Entries, overtime, rates and pay: the main path from shifts to a payroll run."""

from pyspark.sql import functions as F

from worktally.functions import hours as H
from worktally.operators import entries as E
from worktally.operators import payroll as PAY
from worktally.operators import rules as R
from worktally.operators.grouping import first_and_last
from worktally.plans.registry import query
from worktally.sources.stages import staged


def hours_of(t):
    return E.with_hours(t.fx_entry)


def split_of(t):
    return E.with_daily_split(E.with_vendor(hours_of(t), t.fx_employee, t.fx_vendor))


def weekly_of(t):
    """Weekly overtime reads the split rows twice, so they are written first."""
    return E.weekly_overtime(staged(split_of(t), "split"))


def totals_of(t):
    worked = weekly_of(t).withColumn("is_holiday", F.col("entry_type") == "HOLIDAY")
    return PAY.submission_totals(worked)


def pay_of(t, period=None):
    """Pay of the submissions that passed. The verdict is written once; rates and totals meet those rows only."""
    subs = PAY.payable(R.readiness(t.fx_submission, t.fx_finding), period)
    subs = staged(subs.select("submission_id", "employee_id", "start_date", "end_date"), "gated")
    return PAY.payroll_results(subs, totals_of(t), t.fx_rate)


@query("h06_worked_hours", "entry_id:long, calculated_hours:double, method:string",
       "SELECT entry_id, calculated_hours, method FROM ck_hours")
def h06(t):
    return hours_of(t)


@query("h08_daily_split", "entry_id:long, regular_hours:double, overtime_hours:double",
       "SELECT entry_id, regular_hours, overtime_hours FROM ck_split")
def h08(t):
    return split_of(t)


@query("h10_payable_hours", "entry_id:long, mismatch:long, payroll_hours:double",
       "SELECT entry_id, CAST(mismatch AS INT) AS mismatch, payroll_hours FROM ck_split")
def h10(t):
    return hours_of(t).withColumn("mismatch", F.col("mismatch").cast("int"))


@query("h09_plausibility_cap", "entry_id:long, hours:double, implausible:long",
       """SELECT event_id AS entry_id, CAST(value AS DECIMAL(10,2)) % 30 AS hours,
          CASE WHEN CAST(value AS DECIMAL(10,2)) % 30 > 24 THEN 1 ELSE 0 END AS implausible FROM events""")
def h09(t):
    df = t.events.select(F.col("event_id").alias("entry_id"),
                         (F.col("value").cast(H.HOURS) % 30).alias("entered_hours"))
    df = E.mark_implausible(df.withColumn("calculated_hours", F.col("entered_hours")))
    return df.withColumn("hours", F.col("entered_hours")).withColumn(
        "implausible", F.col("implausible").cast("int"))


@query("e02_same_day_collision", "entry_id:long, submission_id:long, collision:string",
       """SELECT entry_id, submission_id,
  CASE WHEN entry_id <= seed THEN 'FIRST'
       WHEN in_min <> s_in OR out_min <> s_out THEN 'SECOND_SHIFT'
       WHEN abs(COALESCE(NULLIF(s_calc, 0), s_ent, 0) - entered_hours) > 0.1
         THEN 'OVERLAPPING_DATE_CONFLICT' ELSE 'DUPLICATE_DATE' END AS collision
FROM (SELECT *, FIRST_VALUE(entry_id) OVER w AS seed, FIRST_VALUE(in_min) OVER w AS s_in,
        FIRST_VALUE(out_min) OVER w AS s_out, FIRST_VALUE(calculated_hours) OVER w AS s_calc,
        FIRST_VALUE(entered_hours) OVER w AS s_ent
      FROM (SELECT * REPLACE (CAST(floor(in_min / 360) * 360 AS INT) AS in_min,
                              CAST(floor(out_min / 360) * 360 AS INT) AS out_min) FROM ck_hours)
      WINDOW w AS (PARTITION BY submission_id, work_date ORDER BY entry_id)) q""")
def e02(t):
    # clock times in quarter-day steps, so that equal windows occur
    df = E.mark_implausible(hours_of(t)).withColumns(
        {c: (F.floor(F.col(c) / 360) * 360).cast("int") for c in ("in_min", "out_min")})
    return E.same_day_collisions(df)


@query("e03_weekly_overtime",
       "entry_id:long, regular_hours:double, overtime_hours:double, moved_hours:double",
       "SELECT entry_id, regular_hours, overtime_hours, move AS moved_hours FROM ck_weekly")
def e03(t):
    return weekly_of(t)


@query("d06_submission_totals",
       "submission_id:long, regular_hours:double, overtime_hours:double, leave_days:long, "
       "holiday_hours:double, entries:long",
       "SELECT * FROM ck_totals")
def d06(t):
    return totals_of(t)


@query("c03_rate_as_of",
       "submission_id:long, employee_id:long, regular_rate:double, overtime_rate:double, "
       "effective_start:string",
       "SELECT * FROM ck_rated")
def c03(t):
    return PAY.rate_as_of(t.fx_submission, t.fx_rate, PAY.worked_until())


@query("c04_active_rate_missing", "submission_id:long, employee_id:long",
       """SELECT submission_id, employee_id FROM fx_submission s WHERE NOT EXISTS (
          SELECT 1 FROM fx_rate r WHERE r.employee_id = s.employee_id
            AND r.effective_start <= DATE '2024-01-20'
            AND (r.effective_end IS NULL OR r.effective_end >= DATE '2024-01-20'))""")
def c04(t):
    day = F.lit("2024-01-20").cast("date")
    return PAY.without_active_rate(t.fx_submission, t.fx_rate, day)


PAY_COLUMNS = ("submission_id:long, employee_id:long, regular_hours:double, overtime_hours:double, "
               "leave_days:long, holiday_hours:double, regular_rate:double, overtime_rate:double, "
               "regular_pay:double, overtime_pay:double, total_pay:double, payroll_status:string")


@query("j03_payroll_result", PAY_COLUMNS,
       "SELECT *, regular_pay + overtime_pay AS total_pay FROM ck_pay")
def j03(t):
    return pay_of(t)


@query("j03_payroll_of_period", PAY_COLUMNS,
       """SELECT p.*, regular_pay + overtime_pay AS total_pay FROM ck_pay p
          JOIN fx_submission s ON s.submission_id = p.submission_id WHERE s.period_id = 2""")
def j03_period(t):
    return pay_of(t, period=2)


@query("j03_missing_rate_findings", "submission_id:string, employee_id:string, rule_code:string, severity:string, status:string",
       """SELECT CAST(submission_id AS VARCHAR) AS submission_id, CAST(employee_id AS VARCHAR) AS employee_id, 'MISSING_RATE' AS rule_code,
          'BLOCKER' AS severity, 'OPEN' AS status FROM ck_pay WHERE payroll_status = 'BLOCKED'""")
def j03_findings(t):
    return R.missing_pay_rate(pay_of(t))


@query("d09_payroll_run_totals",
       "submissions:long, employees:long, ready:long, blocked:long, total_regular_hours:double, "
       "total_overtime_hours:double, total_regular_pay:double, total_overtime_pay:double, "
       "total_pay:double, run_status:string",
       """SELECT COUNT(*) AS submissions, COUNT(DISTINCT employee_id) AS employees,
  COUNT(*) FILTER (payroll_status = 'READY') AS ready,
  COUNT(*) FILTER (payroll_status <> 'READY') AS blocked,
  SUM(regular_hours) FILTER (payroll_status = 'READY') AS total_regular_hours,
  SUM(overtime_hours) FILTER (payroll_status = 'READY') AS total_overtime_hours,
  SUM(regular_pay) FILTER (payroll_status = 'READY') AS total_regular_pay,
  SUM(overtime_pay) FILTER (payroll_status = 'READY') AS total_overtime_pay,
  SUM(regular_pay + overtime_pay) FILTER (payroll_status = 'READY') AS total_pay,
  CASE WHEN COUNT(*) FILTER (payroll_status <> 'READY') > 0 THEN 'NEEDS_REVIEW'
       ELSE 'FINALIZED' END AS run_status FROM ck_pay""")
def d09(t):
    return PAY.run_totals(pay_of(t))


@query("h07_lab_hours", "seq:long, hours:double",
       """SELECT seq, COALESCE(CASE WHEN punched > 0 AND punched <= 16 THEN punched END,
  CASE WHEN h1 > 0 AND h1 <= 24 THEN h1 END, CASE WHEN h2 > 0 AND h2 <= 24 THEN h2 END, 0) AS hours
FROM (SELECT entry_id AS seq, CAST(entered_hours * 2.5 AS DECIMAL(10,2)) AS h1, entered_hours AS h2,
  ROUND(GREATEST(out_min + CASE WHEN out_min < in_min THEN 720 ELSE 0 END - in_min - break_minutes, 0)
        / 60.0, 2) AS punched FROM fx_entry) q""")
def h07(t):
    c = F.col("entered_hours")
    hours = H.lab_hours(F.col("in_min"), F.col("out_min"), F.col("break_minutes"),
                        (c * F.lit("2.5").cast("decimal(2,1)")), c)
    return t.fx_entry.select(F.col("entry_id").alias("seq"), hours.alias("hours"))


@query("h11_payroll_hours_choice", "submission_id:long, payroll_hours:double, reasons:string",
       """SELECT submission_id, COALESCE(approved, submitted, calculated) AS payroll_hours,
  CASE WHEN approved IS NOT NULL AND submitted IS NOT NULL AND abs(approved - submitted) > 0.25
         THEN 'APPROVED_DIFFERS'
       WHEN approved IS NULL AND submitted IS NULL THEN 'NO_STATED_TOTAL' ELSE '' END AS reasons
FROM (SELECT submission_id, SUM(entered_hours) AS calculated,
   CASE WHEN submission_id % 3 = 0 THEN NULL ELSE SUM(entered_hours) + submission_id % 2 END AS submitted,
   CASE WHEN submission_id % 4 < 2 THEN NULL ELSE SUM(entered_hours) END AS approved
   FROM fx_entry GROUP BY submission_id) q""")
def h11(t):
    s = t.fx_entry.groupBy("submission_id").agg(F.sum("entered_hours").alias("calculated"))
    k, c = F.col("submission_id"), F.col("calculated")
    s = s.withColumn("submitted", F.when(k % 3 != 0, c + k % 2)) \
         .withColumn("approved", F.when(k % 4 >= 2, c))
    hours, reasons = H.payroll_hours_choice(c, F.col("submitted"), F.col("approved"))
    return s.select("submission_id", hours.alias("payroll_hours"),
                    F.array_join(reasons, ",").alias("reasons"))


DISPOSITION_SQL = """
SELECT seq, file_id, submission_id, CAST(work_date AS VARCHAR) AS work_date,
  CASE WHEN work_date IS NULL THEN CASE WHEN raw_date LIKE 'INVALID%' THEN 'INVALID_DATE' ELSE 'NO_DATE' END
    WHEN seed IS NOT NULL AND seq > seed AND NOT COALESCE(in_min IS NOT NULL AND out_min IS NOT NULL
          AND s_in IS NOT NULL AND s_out IS NOT NULL AND (in_min <> s_in OR out_min <> s_out), FALSE)
      THEN CASE WHEN abs(COALESCE(NULLIF(s_calc, 0), s_ent, 0) - COALESCE(entered_hours, 0)) > 0.1
                THEN 'OVERLAPPING_DATE_CONFLICT' ELSE 'DUPLICATE_DATE' END
    WHEN implausible THEN 'IMPLAUSIBLE_HOURS' ELSE 'STORED' END AS disposition
FROM ck_built"""


@query("j02_entry_builder", "seq:long, file_id:long, submission_id:string, work_date:string, disposition:string, vendor_id:long, "
       "entered_hours:double, calculated_hours:double, payroll_hours:double, regular_hours:double, overtime_hours:double, moved_hours:double",
       "SELECT * FROM ck_store", heavy=True)
def j02(t):
    return store_of(t).entries


def store_of(t):
    return E.entry_store(t.fx_raw, t.fx_employee, t.fx_vendor)


REVIEWED = 5  # of the submissions under test, every fifth employee's findings are still open; the others are resolved


def findings_of(store):
    """Findings of a built store: what the builder removed, row rules in one pass, and weeks over their limit."""
    stored = store.stored()
    return R.union_all([
        R.build_findings(store.entries),
        R.apply_rules(stored, [R.daily_hours_rule(), R.regular_limit_rule(), R.total_mismatch_rule(), R.hours_mismatch_rule(), R.overtime_barred_rule()]),
        R.weekly_hours_exceed(stored)])


def reviewed(findings):
    still = F.col("employee_id").isNull() | (F.col("employee_id").cast("long") % REVIEWED == 0)
    return findings.withColumn("status", F.when(still, "OPEN").otherwise("RESOLVED"))


@query("j02_claim_findings", "rule_code:string, severity:string, file_id:string, submission_id:string, entry_id:string, employee_id:string, "
       "expected_value:string, actual_value:string", "SELECT * FROM ck_store_finding", heavy=True)
def j02_findings(t):
    return findings_of(store_of(t))


@query("j02_claims_to_pay", "submission_id:string, employee_id:long, entries:long, blockers:long, errors:long, warnings:long, validation_status:string, "
       "payroll_status:string, regular_hours:double, overtime_hours:double, leave_days:long, regular_pay:double, overtime_pay:double, total_pay:double",
       """SELECT s.submission_id, s.employee_id, COALESCE(t.entries, 0) AS entries, COALESCE(blockers, 0) AS blockers,
  COALESCE(errors, 0) AS errors, COALESCE(warnings, 0) AS warnings,
  CASE WHEN COALESCE(blockers, 0) + COALESCE(errors, 0) > 0 THEN 'FAILED' ELSE 'PASSED' END AS validation_status,
  CASE WHEN COALESCE(blockers, 0) + COALESCE(errors, 0) > 0 THEN 'NOT_READY' WHEN rr IS NULL THEN 'BLOCKED' ELSE 'READY' END AS payroll_status,
  COALESCE(rh, 0) AS regular_hours, COALESCE(oh, 0) AS overtime_hours, COALESCE(leave, 0) AS leave_days,
  CASE WHEN COALESCE(blockers, 0) + COALESCE(errors, 0) = 0 THEN CAST(COALESCE(rh, 0) * rr AS DECIMAL(18,4)) END AS regular_pay,
  CASE WHEN COALESCE(blockers, 0) + COALESCE(errors, 0) = 0 THEN CAST(COALESCE(oh, 0) * orate AS DECIMAL(18,4)) END AS overtime_pay,
  CASE WHEN COALESCE(blockers, 0) + COALESCE(errors, 0) = 0 THEN CAST(COALESCE(rh, 0) * rr + COALESCE(oh, 0) * orate AS DECIMAL(18,4)) END AS total_pay
FROM (SELECT q.*, r.regular_rate AS rr, CASE WHEN COALESCE(r.overtime_rate, 0) = 0 THEN r.regular_rate * 1.5 ELSE r.overtime_rate END AS orate
  FROM (SELECT submission_id, MIN(employee_id) AS employee_id, COALESCE(MAX(e), MIN(s)) AS day
    FROM (SELECT submission_id, employee_id, file_id, arg_min_null(work_date, seq) AS s, arg_max_null(work_date, seq) AS e FROM ck_typed GROUP BY ALL) f
    GROUP BY submission_id) q
  LEFT JOIN LATERAL (SELECT * FROM fx_rate r WHERE r.employee_id = q.employee_id AND r.effective_start <= q.day
    AND (r.effective_end IS NULL OR r.effective_end >= q.day) ORDER BY r.effective_start DESC LIMIT 1) r ON TRUE) s
LEFT JOIN (SELECT submission_id, COUNT(*) AS entries, SUM(regular_hours) AS rh, SUM(overtime_hours) AS oh,
    COUNT(*) FILTER (entry_type = 'LEAVE') AS leave FROM ck_stored GROUP BY 1) t ON t.submission_id = s.submission_id
LEFT JOIN (SELECT submission_id, COUNT(*) FILTER (severity = 'BLOCKER') AS blockers, COUNT(*) FILTER (severity = 'ERROR') AS errors,
    COUNT(*) FILTER (severity = 'WARNING') AS warnings FROM ck_store_finding
    WHERE employee_id IS NULL OR CAST(employee_id AS BIGINT) % 5 = 0 GROUP BY 1) f ON f.submission_id = s.submission_id""", heavy=True)
def j02_pay(t):
    """From claims as extracted to pay: every submission with its verdict, and the pay of those that passed."""
    store = store_of(t)
    verdict = staged(R.readiness(store.submissions, reviewed(findings_of(store))), "verdict")
    totals = PAY.submission_totals(store.stored().withColumn("is_holiday", F.col("entry_type") == "HOLIDAY"))
    gated = PAY.payable(verdict).select("submission_id", "employee_id", "start_date", "end_date")
    paid = PAY.payroll_results(gated, totals, t.fx_rate)
    hours = totals.select("submission_id", "entries", "regular_hours", "overtime_hours", "leave_days")
    paid = paid.select("submission_id", "regular_pay", "overtime_pay", "total_pay", F.col("payroll_status").alias("_run"))
    out = verdict.join(hours, "submission_id", "left").join(paid, "submission_id", "left")
    return out.withColumn("payroll_status", F.coalesce("_run", "payroll_status")).fillna(0, ["entries", "regular_hours", "overtime_hours", "leave_days"])


@query("j01_submission_builder",
       "submission_id:string, batch_id:long, employee_id:long, file_id:long, start_date:string, "
       "end_date:string, files:long, rows:long",
       """SELECT submission_id, MIN(batch_id) AS batch_id, MIN(employee_id) AS employee_id,
  arg_min(file_id, fseq) AS file_id, CAST(MIN(s) AS VARCHAR) AS start_date,
  CAST(MAX(e) AS VARCHAR) AS end_date, COUNT(*) AS files, SUM(n) AS rows
FROM (SELECT submission_id, batch_id, employee_id, file_id, MIN(seq) AS fseq, COUNT(*) AS n,
        arg_min_null(work_date, seq) AS s, arg_max_null(work_date, seq) AS e
      FROM ck_typed GROUP BY ALL) f GROUP BY submission_id""", heavy=True)
def j01(t):
    return E.build_submissions(t.fx_raw)


@query("e11_period_span", "file_id:long, first_date:string, last_date:string, low:string, high:string",
       """SELECT file_id, CAST(arg_min(work_date, seq) FILTER (work_date IS NOT NULL) AS VARCHAR) AS first_date,
  CAST(arg_max(work_date, seq) FILTER (work_date IS NOT NULL) AS VARCHAR) AS last_date,
  CAST(MIN(work_date) AS VARCHAR) AS low, CAST(MAX(work_date) AS VARCHAR) AS high
  FROM ck_typed GROUP BY file_id""", heavy=True)
def e11(t):
    from worktally.functions import dates as D
    dated = t.fx_raw.withColumn("d", D.parse_date(F.col("raw_date")))
    return first_and_last(dated, "file_id", "d", "seq")

"""Validation rules. Every rule maps frames to rows of one finding schema."""

from functools import reduce

from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import dates as D
from worktally.functions import hours as H
from worktally.operators.grouping import attach
from worktally.operators.payroll import without_active_rate

IDS = ["file_id", "submission_id", "entry_id", "employee_id"]


def finding(df, code, severity, expected=None, actual=None):
    """Projects offending rows to the finding schema; ids the frame lacks are NULL."""
    ids = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in IDS]
    text = [(F.lit(None) if v is None else v).cast("string") for v in (expected, actual)]
    sev = F.lit(severity) if isinstance(severity, str) else severity
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(code.alias("rule_code"), sev.alias("severity"), *ids,
                     text[0].alias("expected_value"), text[1].alias("actual_value"),
                     F.lit("OPEN").alias("status"))


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def candidates(files):
    """Files that are neither noise nor duplicate and may hold an hours sheet."""
    return files.filter(~F.col("is_noise") & ~F.col("is_duplicate") & F.col("is_candidate"))


def without_open(new, existing, keys=("file_id", "rule_code"), any_status=False):
    """Left anti: findings with no OPEN finding (or none at all) for the same keys."""
    seen = existing if any_status else existing.filter(F.col("status") == "OPEN")
    seen = seen.select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct()
    return new.join(seen, list(keys), "left_anti")


# --- files ---

def employee_not_matched(files, existing):
    rows = candidates(files).filter(F.col("matched_employee_id").isNull())
    return without_open(finding(rows, "EMPLOYEE_NOT_MATCHED", "WARNING"), existing)


def extraction_failed(files, extractions, existing):
    stuck = candidates(files).filter(
        F.col("processing_status").isin("EXTRACTION_FAILED", "NEEDS_REVIEW", "FAILED"))
    with_rows = extractions.filter(F.col("entry_count") > 0).select("file_id").distinct()
    rows = stuck.join(with_rows, "file_id", "left_anti")
    return without_open(finding(rows, "EXTRACTION_FAILED", "BLOCKER"), existing)


def non_sheet(files, existing):
    rows = files.filter(F.col("processing_status") == "NON_TIMESHEET_DOCUMENT")
    return without_open(finding(rows, "NON_TIMESHEET_DOCUMENT", "INFO"), existing, any_status=True)


# --- entries ---

def claimed():
    return H.first_nonzero(F.col("calculated_hours"), F.col("entered_hours"))


# Row rules are (code, severity, condition, expected, actual); one alone is a filter, several share
# a pass over the entries.

def daily_hours_rule(limit=P.MAX_DAILY_HOURS):
    return "DAILY_HOURS_EXCEED", "ERROR", claimed() > limit, F.lit(limit), claimed()


def regular_limit_rule():
    limit = F.coalesce(F.col("daily_limit"), F.lit(P.DAILY_LIMIT)).cast(H.HOURS)
    hit = F.col("regular_hours") > limit + H.hours_lit(P.HOURS_TOLERANCE)
    return "DAILY_REGULAR_LIMIT_EXCEEDED", "WARNING", hit, limit, F.col("regular_hours")


def total_mismatch_rule():
    parts = (F.coalesce("regular_hours", F.lit(0)) + F.coalesce("overtime_hours", F.lit(0))).cast(H.HOURS)
    hit = (claimed() > 0) & (F.abs(claimed() - parts) > H.hours_lit(P.HOURS_TOLERANCE))
    return "HOURS_TOTAL_MISMATCH", "ERROR", hit, claimed(), parts


def hours_mismatch_rule():
    return ("DAILY_HOURS_MISMATCH", "ERROR", F.col("mismatch"), F.col("calculated_hours"),
            F.col("entered_hours").cast(H.HOURS))


def overtime_barred_rule(strict=False):
    """Hours above the limit where the vendor bars overtime; ``strict`` only after a split."""
    hours = F.col("overtime_hours") if strict else F.col("payroll_hours") - F.col("daily_limit")
    return "OVERTIME_NOT_ALLOWED", "ERROR", ~F.col("overtime_enabled") & (hours > 0), F.lit("0"), hours.cast(H.HOURS)


def apply_rule(entries, rule):
    code, severity, hit, expected, actual = rule
    return finding(entries.filter(hit), code, severity, expected, actual)


def apply_rules(entries, rules):
    """Findings of several row rules in one pass over the entries."""
    made = [F.when(hit, F.struct(
        F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"),
        expected.cast("string").alias("expected_value"), actual.cast("string").alias("actual_value")))
        for code, severity, hit, expected, actual in rules]
    ids = [(F.col(c) if c in entries.columns else F.lit(None)).cast("string").alias(c) for c in IDS]
    return entries.select(*ids, F.inline(F.array_compact(F.array(*made))), F.lit("OPEN").alias("status"))


def weekly_hours_exceed(entries):
    work = entries.filter((F.col("entry_type") == "WORK") & F.col("work_date").isNotNull())
    weeks = work.groupBy("submission_id", "employee_id",
                         D.monday_week_label(F.col("work_date")).alias("week")).agg(
        F.sum(claimed()).alias("total"),
        F.max(F.coalesce("weekly_limit", F.lit(P.WEEKLY_LIMIT))).cast(H.HOURS).alias("limit"),
        F.bool_and(F.coalesce("overtime_enabled", F.lit(True))).alias("allowed"))
    over = weeks.filter(F.col("total") > F.col("limit"))
    severity = F.when(F.col("allowed"), "WARNING").otherwise("ERROR")
    return finding(over, "WEEKLY_HOURS_EXCEED", severity, F.col("limit"), F.col("total"))


def with_holiday(entries, employees, holidays):
    """Adds holiday_name: calendars of the employee's type or unscoped ones; all if none applies.

    The lookup holds one row per date, with the names by employee type as a map, so entries are never multiplied.
    """
    per = holidays.groupBy("holiday_date", "applies_to").agg(F.min(F.struct("calendar_id", "holiday_name")).alias("b"))
    scoped_row = F.col("applies_to").isNotNull()
    by_date = per.groupBy("holiday_date").agg(
        F.min("b").alias("_any"), F.min(F.when(~scoped_row, F.col("b"))).alias("_open"),
        F.map_from_entries(F.collect_list(F.when(scoped_row, F.struct("applies_to", "b")))).alias("_types"))
    # the types are those of an enumeration: a few
    facts = holidays.agg(F.struct((F.count_if(~scoped_row) > 0).alias("open"), F.collect_set("applies_to").alias("types"))).scalar()
    out = entries.join(employees.select("employee_id", "employee_type"), "employee_id", "left")
    out = out.withColumnRenamed("work_date", "holiday_date").join(by_date, "holiday_date", "left")
    out = out.withColumn("_own", F.try_element_at("_types", F.col("employee_type")))
    scoped = facts["open"] | F.coalesce(F.array_contains(facts["types"], F.col("employee_type")), F.lit(False))
    own_first = (F.when(F.col("_own").isNull() | (F.col("_open.calendar_id") < F.col("_own.calendar_id")),
                        F.coalesce("_open.holiday_name", "_own.holiday_name"))
                 .otherwise(F.col("_own.holiday_name")))
    name = F.when(F.col("employee_type").isNull() | ~scoped, F.col("_any.holiday_name")).otherwise(own_first)
    works = (F.col("entry_type") == "WORK") & (claimed() > 0)
    return (out.withColumn("holiday_name", F.when(works, name))
            .withColumnRenamed("holiday_date", "work_date")
            .drop("_any", "_open", "_own", "_types"))


def holiday_rule():
    """For rows that ``with_holiday`` has named."""
    return "HOLIDAY_WORK", "WARNING", F.col("holiday_name").isNotNull(), F.lit("0"), claimed()


def flag_holidays(named):
    """The rows themselves, updated: is_holiday where work fell on a holiday (a true flag stays)."""
    was = F.col("is_holiday") if "is_holiday" in named.columns else F.lit(False)
    return named.withColumn("is_holiday", F.coalesce(was, F.lit(False)) | F.col("holiday_name").isNotNull())


def holiday_work(entries, employees, holidays):
    return apply_rule(with_holiday(entries, employees, holidays), holiday_rule())


BUILD_SEVERITY = {"INVALID_DATE": "ERROR", "OVERLAPPING_DATE_CONFLICT": "BLOCKER",
                  "DUPLICATE_DATE": "WARNING", "IMPLAUSIBLE_HOURS": "ERROR"}


def build_findings(built, codes=tuple(BUILD_SEVERITY)):
    """Findings for rows the entry builder did not store."""
    rows = built.filter(F.col("disposition").isin(*codes))
    sev = reduce(lambda c, kv: c.when(F.col("disposition") == kv[0], kv[1]),
                 BUILD_SEVERITY.items(), F.when(F.lit(False), ""))
    actual = (F.when(F.col("disposition") == "INVALID_DATE", F.col("raw_date"))
              .when(F.col("disposition") == "IMPLAUSIBLE_HOURS", F.col("day_max").cast("string"))
              .when(F.col("disposition") == "DUPLICATE_DATE", F.col("work_date").cast("string"))
              .otherwise(F.coalesce("entered_hours", F.lit(0)).cast(H.HOURS).cast("string")))
    expected = F.when(F.col("disposition") == "OVERLAPPING_DATE_CONFLICT", F.col("seed_hours"))
    rows = rows.withColumn("entry_id", F.col("seq"))
    return finding(rows, F.col("disposition"), sev, expected, actual)


def period_split(entries, start, end, day="work_date"):
    """(kept, outside): undated rows are kept."""
    outside = F.col(day).isNotNull() & ~F.col(day).between(start, end)
    return entries.filter(~outside), entries.filter(outside)


def out_of_period(entries, start, end):
    _, outside = period_split(entries, start, end)
    return finding(outside, "OUT_OF_PERIOD_ENTRY", "WARNING", None, F.col("work_date"))


def day_issues(entries, max_daily=P.MAX_DAILY_HOURS):
    """Per submission and day: over the limit or without hours; plus rows lacking hours."""
    days = entries.groupBy("submission_id", "work_date").agg(
        F.sum(H.first_nonzero(F.col("entered_hours"))).alias("hours"))
    over = F.when(F.col("hours") > max_daily, "DAILY_HOURS_EXCEED").when(F.col("hours") == 0, "ZERO_HOURS_DAY")
    per_day = days.withColumn("rule_code", over).filter(F.col("rule_code").isNotNull())
    lacking = entries.groupBy("submission_id").agg(
        F.count_if(H.first_nonzero(F.col("entered_hours")) == 0).alias("hours"))
    lacking = lacking.filter(F.col("hours") > 0).select(
        "submission_id", F.lit(None).cast("date").alias("work_date"),
        F.col("hours").cast(H.HOURS).alias("hours"), F.lit("MISSING_HOURS").alias("rule_code"))
    return per_day.unionByName(lacking)


def doubled_week(entries, weekly=P.WEEKLY_LIMIT):
    """Total above twice the weekly limit."""
    total = entries.groupBy("submission_id").agg(F.sum(H.first_nonzero(F.col("entered_hours"))).alias("hours"))
    return total.filter(F.col("hours") > 2 * weekly).withColumn("rule_code", F.lit("WEEKLY_HOURS_EXCEED"))


# --- submissions ---

def missing_approval(subs):
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return finding(subs.filter(blank("approver_name") & blank("approver_email")),
                   "MISSING_APPROVAL", "BLOCKER")


def late_rows(subs, periods):
    """Submissions received after the start of the cutoff day of their period."""
    p = periods.select("period_id", "cutoff_date")
    return subs.join(p, "period_id").filter(F.col("submitted_at") > F.col("cutoff_date").cast("timestamp_ntz"))


def late_submission(subs, periods):
    return finding(late_rows(subs, periods), "LATE_SUBMISSION", "WARNING",
                   F.col("cutoff_date"), F.col("submitted_at").cast("date"))


def with_submission_facts(subs, periods, employees, rates, as_of):
    """One row per submission with what its rules look at: cutoff_date, is_late, and whether its employee is known and has a rate on ``as_of``.

    Periods and employees are keyed by their ids. Each table is read once.
    """
    known = employees.select("employee_id", F.lit(True).alias("is_known"))
    valid = (F.col("effective_start") <= as_of) & (F.col("effective_end").isNull() | (F.col("effective_end") >= as_of))
    rated = rates.filter(valid).groupBy("employee_id").agg(F.lit(True).alias("is_rated"))
    out = subs.join(periods.select("period_id", "cutoff_date"), "period_id", "left").join(known, "employee_id", "left").join(rated, "employee_id", "left")
    late = F.col("submitted_at") > F.col("cutoff_date").cast("timestamp_ntz")
    return out.withColumn("is_late", F.coalesce(late, F.lit(False))).fillna(False, ["is_known", "is_rated"])


def submission_rules():
    """Row rules for submissions with their facts."""
    none = F.lit(None)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return [("MISSING_APPROVAL", "BLOCKER", blank("approver_name") & blank("approver_email"), none, none),
            ("LATE_SUBMISSION", "WARNING", F.col("is_late"), F.col("cutoff_date"), F.col("submitted_at").cast("date")),
            ("MISSING_RATE", "BLOCKER", F.col("is_known") & ~F.col("is_rated"), none, none)]


def missing_rate(subs, employees, rates, as_of):
    known = subs.join(employees.select("employee_id"), "employee_id", "left_semi")
    return finding(without_active_rate(known, rates, as_of), "MISSING_RATE", "BLOCKER")


def not_submitted(employees, subs):
    """Active employees without a submission (left anti)."""
    sent = subs.filter(F.col("employee_id").isNotNull()).select("employee_id").distinct()
    return employees.filter("is_active").join(sent, "employee_id", "left_anti")


def missing_sheet(employees, subs):
    return finding(not_submitted(employees, subs), "MISSING_TIMESHEET", "ERROR")


def latest_activity(employees, subs, on):
    """Active employees with the latest value of ``on`` (NULL when they never submitted)."""
    last = subs.groupBy("employee_id").agg(F.max(on).alias("last_seen"))
    return employees.filter("is_active").join(last, "employee_id", "left")


def months_of_data(subs, day="end_date"):
    """Scalar subquery: distinct months, cancelled submissions left out."""
    live = subs.filter(F.col(day).isNotNull() & (F.col("payroll_status") != "CANCELLED"))
    return live.agg(F.count_distinct(F.date_trunc("month", day)).alias("n")).scalar()


def inactive(employees, subs, as_of, on="submitted_at", months=P.INACTIVE_MONTHS):
    """Never seen, or last seen before ``as_of`` minus the threshold; needs two months of data."""
    cutoff = F.add_months(F.lit(as_of).cast("date"), -months)
    gone = F.col("last_seen").isNull() | (F.col("last_seen") < cutoff)
    return latest_activity(employees, subs, on).filter(gone & (months_of_data(subs) >= 2))


def two_month_inactive(employees, subs, as_of):
    return finding(inactive(employees, subs, as_of), "TWO_MONTH_INACTIVE", "WARNING")


def readiness(subs, findings):
    """FAILED / NOT_READY when an OPEN blocker or error exists, else PASSED / READY."""
    open_now = findings.filter((F.col("status") == "OPEN") & F.col("submission_id").isNotNull())
    counts = open_now.groupBy(F.col("submission_id").cast("string").alias("submission_id")).agg(
        F.count_if(F.col("severity") == "BLOCKER").alias("blockers"),
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    out = attach(subs.withColumn("_sid", F.col("submission_id").cast("string")),
                 counts.withColumnRenamed("submission_id", "_sid"), ["_sid"]).drop("_sid")
    out = out.fillna(0, ["blockers", "errors", "warnings"])
    blocked = (F.col("blockers") > 0) | (F.col("errors") > 0)
    return (out.withColumn("validation_status", F.when(blocked, "FAILED").otherwise("PASSED"))
            .withColumn("payroll_status", F.when(blocked, "NOT_READY").otherwise("READY")))


def missing_pay_rate(results):
    """A blocker for every payroll result held back for want of a rate."""
    return finding(results.filter("payroll_status = 'BLOCKED'"), "MISSING_RATE", "BLOCKER")


def refresh(existing, new, owned=P.REGENERATED_RULES):
    """Drops OPEN findings of the owned codes, keeps all others, appends the new ones."""
    keep = existing.filter(~((F.col("status") == "OPEN") & F.col("rule_code").isin(owned)))
    return keep.unionByName(new, allowMissingColumns=True)


def outside_domain(df, domains):
    """Rows whose column value is not one of the allowed ones, one row per violation."""
    bad = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(allowed)), F.lit(c))
        for c, allowed in domains.items()]))
    return df.withColumn("bad_column", F.explode(bad))


def excluding(findings, codes, **equal):
    """Findings outside ``codes``; of ``equal`` (column = value) those with a value must hold as well."""
    conds = [F.col(c) == v for c, v in equal.items() if v is not None]
    return findings.filter(reduce(lambda a, b: a & b, conds, ~F.col("rule_code").isin(*codes)))


def missing_files(files, submissions):
    """Candidate files that no submission came from."""
    have = submissions.filter(F.col("file_id").isNotNull()).select("file_id").distinct()
    return candidates(files).join(have, "file_id", "left_anti")


def period_counts(entries, start, end, key="submission_id", day="work_date"):
    """Rows inside (undated ones too) and outside of a period per key, and the span of those kept."""
    ok = F.col(day).isNull() | F.col(day).between(start, end)
    kept = F.when(ok, F.col(day))
    return entries.groupBy(key).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("outside"),
                                    F.min(kept).alias("first_date"), F.max(kept).alias("last_date"))


def month_gate(subs, day="end_date", least=2):
    """Number of months with data, cancelled submissions left out, and whether they are enough to judge inactivity."""
    live = subs.filter((F.col("payroll_status") != "CANCELLED") & F.col(day).isNotNull())
    n = F.count_distinct(F.date_trunc("month", day))
    return live.agg(n.alias("months"), (n >= least).alias("enough"))


def inactivity_report(employees, subs, as_of, on="end_date", months=P.INACTIVE_MONTHS):
    """Inactive employees with the whole months since they were last seen (null: never)."""
    since = F.floor(F.months_between(F.lit(as_of).cast("date"), F.col("last_seen")))
    return inactive(employees, subs, as_of, on, months).withColumns({"months_inactive": since, "never_submitted": F.col("last_seen").isNull()})

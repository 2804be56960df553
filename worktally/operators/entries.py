"""Entry building: hours, daily split, same-day collisions, weekly overtime.

``entry_store`` is the one path from claims, as extracted, to entries that rules, verdict and pay read.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import dates as D
from worktally.functions import hours as H
from worktally.operators.grouping import attach, computed, in_runs, run_totals, totals_before, totals_in_runs
from worktally.sources.stages import staged


def with_vendor(df, employees, vendors, own="vendor_id"):
    """Vendor of the row, else of the employee; limits and overtime flag attached (left joins)."""
    emp = employees.select("employee_id", F.col("vendor_id").alias("_emp_vendor"))
    out = df.join(emp, "employee_id", "left")
    chosen = F.coalesce(F.col(own), F.col("_emp_vendor")) if own in df.columns else F.col("_emp_vendor")
    out = out.withColumn("vendor_id", chosen.cast("long")).drop("_emp_vendor")
    ven = vendors.select(F.col("vendor_id").cast("long").alias("vendor_id"),
                         F.col("name").alias("vendor_name"), "daily_limit", "weekly_limit",
                         "overtime_enabled")
    return out.join(ven, "vendor_id", "left")


def with_hours(df):
    """Adds calculated_hours, method, mismatch and payroll_hours."""
    start, end, entered = F.col("in_min"), F.col("out_min"), F.col("entered_hours").cast(H.HOURS)
    hours, method = H.worked_hours(start, end, F.col("break_minutes"), entered)
    out = df.withColumns({"calculated_hours": hours, "method": method})
    disagree = H.hours_disagree(entered, F.col("calculated_hours"), start, end)
    return (out.withColumn("mismatch", disagree)
            .withColumn("payroll_hours",
                        H.payable_hours(entered, F.col("calculated_hours"), F.col("mismatch"))))


def with_daily_split(df):
    """Adds regular_hours and overtime_hours under the vendor's daily limit."""
    regular, overtime = H.split_hours(F.col("payroll_hours"), F.col("daily_limit").cast(H.HOURS),
                                      F.col("overtime_enabled"))
    return df.withColumns({"regular_hours": regular, "overtime_hours": overtime})


def mark_implausible(df, cap=P.MAX_PLAUSIBLE_HOURS):
    """Adds day_max and the flag ``implausible``."""
    top = F.greatest(F.coalesce("entered_hours", F.lit(0)).cast(H.HOURS),
                     F.coalesce("calculated_hours", F.lit(0)).cast(H.HOURS))
    return df.withColumn("day_max", top).withColumn("implausible", F.col("day_max") > cap)


def weekly_overtime(df, keys=("submission_id",), day="work_date", row_id="entry_id"):
    """Moves regular hours above the weekly limit to overtime, latest day first.

    Rows of one week are ordered by day (at most seven) and then by id, so the running total is
    taken over per-run sums; a submission of any size never sits in one window.
    """
    week = df.withColumn("_week", D.iso_week(F.col(day)))
    return moved_to_overtime(totals_before(week, [*keys, "_week"], row_id, coarse=[(day, True)], whole=True, _prev="regular_hours"), day)


def moved_to_overtime(ran, day="work_date"):
    """The step of ``weekly_overtime`` for rows with the regular hours of their week, and of the rows before them there."""
    limit = F.coalesce(F.col("weekly_limit"), F.lit(P.WEEKLY_LIMIT)).cast(H.HOURS)
    allowed = F.coalesce(F.col("overtime_enabled"), F.lit(True))
    left = F.col("_prev_all") - limit - F.col("_prev")
    move = F.when(allowed & F.col(day).isNotNull(),
                  F.greatest(F.lit(0), F.least(F.col("regular_hours"), left))).otherwise(0)
    return (ran.withColumn("moved_hours", move.cast(H.HOURS))
            .withColumn("regular_hours", (F.col("regular_hours") - F.col("moved_hours")).cast(H.HOURS))
            .withColumn("overtime_hours", (F.col("overtime_hours") + F.col("moved_hours")).cast(H.HOURS))
            .drop("_week", "_prev", "_prev_all"))


def same_day_collisions(df, key="submission_id", day="work_date", seq="entry_id"):
    """Labels later rows of a day against the first stored row of that day.

    FIRST and SECOND_SHIFT rows stay; OVERLAPPING_DATE_CONFLICT and DUPLICATE_DATE rows go. An
    implausible row is never stored, so it cannot be the first one.
    """
    return collisions(attach(df, first_of_day(df, key, day, seq), [key, day]), seq).drop("_s_in", "_s_out")


SEED = ["seed_id", "_s_in", "_s_out", "seed_hours"]


def first_of_day(df, key="submission_id", day="work_date", seq="entry_id"):
    """The first storable row of every day, as the columns ``SEED``."""
    storable = df.filter(F.col(day).isNotNull() & ~F.col("implausible"))
    # figures by themselves, not a struct, so that they are aggregated by hash and no rows are sorted for it
    clocks = [F.min_by(c, seq).alias(f"_s_{c[:-4]}") for c in ("in_min", "out_min")]
    hours = [F.min_by(c, seq).cast(H.HOURS) for c in ("calculated_hours", "entered_hours")]
    return storable.groupBy(key, day).agg(F.min(seq).alias("seed_id"), *clocks, H.first_nonzero(*hours).alias("seed_hours"))


def collisions(out, seq="entry_id"):
    """The labels of ``same_day_collisions`` for rows that ``first_of_day`` has been joined to."""
    clocks = [F.col(c).isNotNull() for c in ("in_min", "out_min", "_s_in", "_s_out")]
    second = (clocks[0] & clocks[1] & clocks[2] & clocks[3]
              & ((F.col("in_min") != F.col("_s_in")) | (F.col("out_min") != F.col("_s_out"))))
    gap = F.abs(F.col("seed_hours") - F.coalesce("entered_hours", F.lit(0)).cast(H.HOURS))
    later = F.col(seq) > F.col("seed_id")
    label = (F.when(F.col("seed_id").isNull() | ~later, "FIRST")
             .when(second, "SECOND_SHIFT")
             .when(gap > H.hours_lit(P.HOURS_TOLERANCE), "OVERLAPPING_DATE_CONFLICT")
             .otherwise("DUPLICATE_DATE"))
    return out.withColumn("collision", label)


def typed_claims(raw, employees, vendors):
    """Extracted string rows to typed ones, with hours, plausibility and the limits of their vendor."""
    typed = computed(
        raw.withColumn("submission_id", submission_key()),
        work_date=D.parse_date(F.col("raw_date")), in_min=D.parse_minutes(F.col("in_text")),
        out_min=D.parse_minutes(F.col("out_text")), entered_hours=H.figure(F.col("hours_text"), H.HOURS),
        break_minutes=F.coalesce(F.round(H.figure(F.col("break_text"), "double")).cast("int"), F.lit(0)))
    return with_vendor(mark_implausible(with_hours(typed)), employees, vendors)


def judge_claims(typed):
    """Adds the ``disposition`` of every typed row and its daily split: STORED, or the finding that removes the row."""
    return disposed(same_day_collisions(typed, seq="seq"))


def disposed(labelled):
    """The step of ``judge_claims`` for rows with their label of the day."""
    judged = labelled.withColumn(
        "disposition",
        F.when(F.col("work_date").isNull() & F.upper(F.trim("raw_date")).startswith("INVALID_"),
               "INVALID_DATE")
        .when(F.col("work_date").isNull(), "NO_DATE")
        .when(F.col("collision").isin("OVERLAPPING_DATE_CONFLICT", "DUPLICATE_DATE"), F.col("collision"))
        .when(F.col("implausible"), "IMPLAUSIBLE_HOURS").otherwise("STORED"))
    return with_daily_split(judged)


def build_entries(raw, employees, vendors):
    """Extracted string rows to typed entries with a ``disposition`` for every row.

    STORED rows carry hours and the daily split; the other labels name the finding that removed
    the row. ``entry_store`` applies weekly overtime as well.
    """
    return judge_claims(typed_claims(raw, employees, vendors))


class EntryStore(NamedTuple):
    """``entries``: every claim with its disposition and, if STORED, its final hours. ``submissions``: their spans."""

    entries: DataFrame
    submissions: DataFrame

    def stored(self):
        return self.entries.filter("disposition = 'STORED'").withColumn("entry_id", F.col("seq"))


PARTS = ["regular_hours", "overtime_hours"]
# What the typed columns and the vendor's id say already; the store does not carry it along.
TYPED_TEXTS = ["in_text", "out_text", "hours_text", "break_text", "vendor_name"]


def entry_store(raw, employees, vendors):
    """Builds the entries of ``raw`` once and writes them; all later steps read the written table.

    Claims are parsed into a first stage. The first row of each day and the stored hours of each week come from its narrow
    columns, one row per run of a day; with these facts the whole rows are judged and moved to overtime in a single exchange.
    Rows that are not STORED have no regular, overtime or moved hours and take no part in a week's total.
    """
    typed = staged(typed_claims(raw, employees, vendors).drop(*TYPED_TEXTS), "claims")
    rows = in_runs(typed.withColumn("_week", D.iso_week(F.col("work_date"))), "seq")
    keys, coarse, days = ["submission_id", "_week"], [("work_date", True)], ["submission_id", "work_date"]
    dated = rows.filter(F.col("work_date").isNotNull())
    seeded = attach(dated, first_of_day(dated, seq="seq"), days)
    facts = run_totals(counted_hours(disposed(collisions(seeded, "seq"))), keys, coarse, whole=True, keep=SEED, _prev="regular_hours")
    judged = disposed(collisions(attach(rows, facts, [*keys, "work_date", "_run"]), "seq"))
    final = moved_to_overtime(totals_in_runs(counted_hours(judged), keys, "seq", coarse, _prev="regular_hours"))
    stored = F.col("disposition") == "STORED"
    final = final.withColumns({c: F.when(stored, F.col(c)) for c in [*PARTS, "moved_hours", "payroll_hours"]})
    return EntryStore(staged(final.drop("collision", "seed_id", "_s_in", "_s_out"), "entries"), spans(typed))


def counted_hours(judged):
    """Hours of rows that are not STORED are zero, so that they take no part in totals."""
    return judged.withColumns({c: F.when(F.col("disposition") == "STORED", F.col(c)).otherwise(F.lit(0)).cast(H.HOURS) for c in PARTS})


def submission_key():
    """One submission per batch and employee; unmatched files keep their own."""
    return F.when(F.col("employee_id").isNotNull(),
                  F.concat(F.lit("e"), F.col("employee_id").cast("string"), F.lit("-b"),
                           F.col("batch_id").cast("string"))) \
        .otherwise(F.concat(F.lit("f"), F.col("file_id").cast("string")))


def build_submissions(raw):
    """Submission span: first and last dated row per file, widened over the merged files."""
    return spans(computed(raw, work_date=D.parse_date(F.col("raw_date"))))


def spans(dated):
    """``build_submissions`` of rows whose dates are typed."""
    per_file = dated.groupBy("batch_id", "file_id", "employee_id").agg(
        F.min_by("work_date", "seq").alias("start_date"),
        F.max_by("work_date", "seq").alias("end_date"),
        F.min("seq").alias("seq"), F.count("*").alias("rows"))
    per_file = per_file.withColumn("submission_id", submission_key())
    return per_file.groupBy("submission_id").agg(
        F.first("batch_id").alias("batch_id"), F.first("employee_id").alias("employee_id"),
        F.min_by("file_id", "seq").alias("file_id"),
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"),
        F.count("*").alias("files"), F.sum("rows").alias("rows"))


def with_submission(entries, submissions, *columns):
    """Entries with columns of their submission; entries without one drop out."""
    return entries.join(submissions.select("submission_id", *columns), "submission_id")

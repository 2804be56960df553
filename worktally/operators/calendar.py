"""Calendars: missing weekdays, day labels, month pages."""

from pyspark.sql import functions as F


def days_of(submissions):
    """Every calendar day of every submission's period."""
    span = F.sequence("start_date", "end_date", F.expr("interval 1 day"))
    return submissions.filter("start_date <= end_date").select(
        "submission_id", "employee_id", F.explode(span).alias("work_date"))


def missing_days(submissions, day_hours):
    """Weekdays inside the period without hours; ``day_hours`` has one row per submission and day."""
    days = days_of(submissions).filter(F.weekday("work_date") < 5)
    worked = day_hours.filter("hours > 0").select("submission_id", "work_date")
    return days.join(worked, ["submission_id", "work_date"], "left_anti")


def day_label():
    """Overtime, leave, holiday, absent, off, work: the first that applies."""
    kind = F.upper(F.coalesce("entry_type", F.lit("WORK")))
    leave = F.nullif(F.col("leave_type"), F.lit(""))
    return (F.when(F.coalesce("overtime_hours", F.lit(0)) > 0, "OT")
            .when((kind == "LEAVE") | leave.isNotNull(), F.coalesce(leave, F.lit("Leave")))
            .when(kind == "HOLIDAY", "Holiday").when(kind == "ABSENT", "Absent")
            .when((kind == "WEEKEND") | (F.coalesce("hours", F.lit(0)) == 0), "")
            .otherwise("Work"))

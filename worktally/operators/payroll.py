"""Rates as of a date, payroll results and run totals."""

from pyspark.sql import functions as F

from worktally import params as P
from worktally.operators.grouping import attach


def rate_as_of(probes, rates, as_of, key="employee_id"):
    """Left as-of join: the latest-starting rate valid on ``as_of`` for every row.

    Pairs are formed between distinct (key, day) probes and the rates of that key, never between
    rows, so a key that holds most rows costs no more than its distinct days.
    """
    rows = probes.withColumn("_as_of", as_of)
    days = rows.select(key, "_as_of").distinct()
    r = rates.select(F.col(key).alias("_rk"), "regular_rate", "overtime_rate",
                     "effective_start", "effective_end")
    valid = ((F.col(key) == F.col("_rk")) & (F.col("effective_start") <= F.col("_as_of"))
             & (F.col("effective_end").isNull() | (F.col("effective_end") >= F.col("_as_of"))))
    best = (days.join(r, valid).groupBy(key, "_as_of")
            .agg(F.max(F.struct("effective_start", "regular_rate", "overtime_rate")).alias("_r"))
            .select(key, "_as_of", "_r.*"))
    return attach(rows, best, [key, "_as_of"]).drop("_as_of")


def without_active_rate(probes, rates, as_of, key="employee_id"):
    """Left anti: rows whose key has no rate valid on ``as_of``."""
    rows = probes.withColumn("_as_of", as_of)
    r = rates.select(F.col(key).alias("_rk"), "effective_start", "effective_end")
    valid = ((F.col(key) == F.col("_rk")) & (F.col("effective_start") <= F.col("_as_of"))
             & (F.col("effective_end").isNull() | (F.col("effective_end") >= F.col("_as_of"))))
    return rows.join(r, valid, "left_anti").drop("_as_of")


def worked_until(default=None):
    """Last day of the worked period, else its first day, else ``default``."""
    cols = [F.col("end_date"), F.col("start_date")]
    return F.coalesce(*cols, F.lit(default).cast("date")) if default else F.coalesce(*cols)


def submission_totals(entries, *keys, holiday="is_holiday"):
    """Hours, leave days and holiday hours per submission."""
    keys = keys or ("submission_id",)
    on_holiday = F.when(F.col(holiday), F.col("calculated_hours"))
    return entries.groupBy(*keys).agg(
        F.coalesce(F.sum("regular_hours"), F.lit(0)).alias("regular_hours"),
        F.coalesce(F.sum("overtime_hours"), F.lit(0)).alias("overtime_hours"),
        F.count_if(F.col("entry_type") == "LEAVE").alias("leave_days"),
        F.coalesce(F.sum(on_holiday), F.lit(0)).alias("holiday_hours"),
        F.count("*").alias("entries"))


def overtime_rate(regular, overtime):
    """The stated rate, else one and a half times the regular one (zero counts as missing)."""
    return F.when(overtime.isNull() | (overtime == 0),
                  (regular * F.lit(P.OVERTIME_FACTOR).cast("decimal(3,1)"))).otherwise(overtime)


def payable(submissions, period=None):
    """Submissions a payroll run takes: validated and ready, of one period where it is given."""
    ready = submissions.filter("validation_status = 'PASSED' AND payroll_status = 'READY'")
    return ready if period is None else ready.filter(F.col("period_id") == period)


def payroll_results(submissions, totals, rates):
    """One result per submission: pay where a rate is valid, else BLOCKED. Without entries it has zero hours."""
    rated = rate_as_of(submissions, rates, worked_until())
    out = rated.join(totals, "submission_id", "left")
    hours = [c for c in totals.columns if c.endswith("_hours")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast(out.schema[c].dataType)) for c in hours})
    ot_rate = overtime_rate(F.col("regular_rate"), F.col("overtime_rate")).cast("decimal(12,4)")
    out = out.withColumn("overtime_rate", ot_rate)
    pay = {f"{k}_pay": (F.col(f"{k}_hours") * F.col(f"{k}_rate")).cast("decimal(18,4)")
           for k in ("regular", "overtime")}
    out = out.withColumns(pay)
    return (out.withColumn("total_pay", F.col("regular_pay") + F.col("overtime_pay"))
            .withColumn("payroll_status",
                        F.when(F.col("regular_rate").isNull(), "BLOCKED").otherwise("READY")))


def run_totals(results):
    """Totals over READY results; counts of ready and blocked ones."""
    ready = F.col("payroll_status") == "READY"
    sums = {c: F.coalesce(F.sum(F.when(ready, F.col(c))), F.lit(0))
            for c in ("regular_hours", "overtime_hours", "regular_pay", "overtime_pay", "total_pay")}
    return results.agg(
        F.count("*").alias("submissions"), F.count_distinct("employee_id").alias("employees"),
        F.count_if(ready).alias("ready"), F.count_if(~ready).alias("blocked"),
        *[e.alias(f"total_{c}".replace("total_total", "total")) for c, e in sums.items()],
        F.when(F.count_if(~ready) > 0, "NEEDS_REVIEW").otherwise("FINALIZED").alias("run_status"))

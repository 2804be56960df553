"""Hour arithmetic as Column expressions (minutes of day in, decimal hours out)."""

from pyspark.sql import functions as F

from worktally import params as P

HOURS = "decimal(10,2)"
# What a number can look like. A cast raises, and catches, an exception for any other text, which costs more than all else in a row.
FIGURE = r"(?i)^[\x00-\x20]*[-+]?[\p{Nd}.][\p{Nd}a-fxp.+-]*[\x00-\x20]*$"


def hours_lit(x):
    return F.lit(x).cast(HOURS)


def figure(text, kind):
    """Text as a number, NULL when it is none."""
    return F.when(text.rlike(FIGURE), text).try_cast(kind)


def clock_hours(start, end, pause):
    """Hours between two minutes of day, next day when the end is earlier; never below zero."""
    span = end + F.when(end < start, 1440).otherwise(0) - start - pause
    return F.round(F.greatest(span, F.lit(0)) / 60, 2).cast(HOURS)


def worked_hours(start, end, pause, entered):
    """(hours, method): clock times first, entered hours when they are missing or doubtful."""
    clock = clock_hours(start, end, pause)
    has_clock = start.isNotNull() & end.isNotNull()
    doubtful = (clock > P.AMPM_DOUBT_HOURS) & (entered > 0) & (entered <= P.AMPM_DOUBT_HOURS)
    doubtful = F.coalesce(doubtful, F.lit(False))
    hours = F.when(has_clock & ~doubtful, clock).otherwise(entered)
    method = (F.when(has_clock & doubtful, "ENTERED_HOURS_USED_AMPM_AMBIGUITY")
              .when(has_clock, "CALCULATED_FROM_IN_OUT")
              .when(entered.isNotNull(), "HOURS_FROM_FILE_ONLY")
              .otherwise("NO_HOURS"))
    return hours, method


def hours_disagree(entered, calculated, start, end):
    """True when both figures exist, clock times were used, and they differ by more than allowed."""
    gap = F.abs(entered - calculated) > hours_lit(P.HOURS_TOLERANCE)
    return F.coalesce(gap & start.isNotNull() & end.isNotNull(), F.lit(False))


def payable_hours(entered, calculated, disagree):
    return F.when(disagree, entered).otherwise(calculated)


def split_hours(hours, limit, overtime_allowed):
    """(regular, overtime) of one day."""
    limit = F.coalesce(limit, hours_lit(P.DAILY_LIMIT))
    allowed = F.coalesce(overtime_allowed, F.lit(True))
    hours = F.coalesce(hours, hours_lit(0))
    regular = F.when(allowed, F.least(hours, limit)).otherwise(hours)
    return regular.cast(HOURS), (hours - regular).cast(HOURS)


def first_nonzero(*cols):
    """First figure that is neither missing nor zero, else 0."""
    return F.coalesce(*[F.when(c != 0, c) for c in cols], hours_lit(0))


def lab_hours(start, end, pause, *figures):
    """Punch hours with a half-day wrap, if above 0 and at most 16, else the first plausible figure."""
    span = end + F.when(end < start, 720).otherwise(0) - start - F.coalesce(pause, F.lit(0))
    punched = F.round(F.greatest(span, F.lit(0)) / 60, 2).cast(HOURS)
    ok = F.when((punched > 0) & (punched <= P.LAB_MAX_PUNCH_HOURS), punched)
    rest = [F.when((f > 0) & (f <= P.MAX_PLAUSIBLE_HOURS), f.cast(HOURS)) for f in figures]
    return F.coalesce(ok, *rest, hours_lit(0))


def payroll_hours_choice(calculated, submitted, approved):
    """Approved total, else submitted, else calculated; with the reasons for a manual check."""
    gap = F.abs(approved - submitted) > F.lit(P.TOTAL_TOLERANCE).cast("decimal(4,2)")
    reasons = F.array_compact(F.array(
        F.when(approved.isNotNull() & F.coalesce(gap, F.lit(False)), "APPROVED_DIFFERS"),
        F.when(approved.isNull() & submitted.isNull(), "NO_STATED_TOTAL")))
    return F.coalesce(approved, submitted, calculated), reasons

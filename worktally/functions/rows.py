"""Reading hours, dates and labels out of single text lines."""

from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import dates as D
from worktally.functions import patterns as RX
from worktally.functions.names import bind

NUM = "decimal(10,2)"


def groups(text, pattern, *idx):
    """Capture groups of the first match, NULL when absent or empty."""
    return [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in idx]


def find_date(line, day_first=True):
    """First date in a line: ISO, then slashed (day first, swapped when impossible), then named."""
    iso, = groups(line, r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b", 1)
    slashed, = groups(line, r"\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{4})\b", 1)
    day_named, = groups(line, rf"(?i)\b(\d{{1,2}}\s+(?:{RX.MONTH})\.?\s+\d{{4}})\b", 1)
    month_named, = groups(line, rf"(?i)\b((?:{RX.MONTH})\.?\s+\d{{1,2}},?\s+\d{{4}})\b", 1)
    return F.coalesce(D.year_first_date(iso), D.numeric_date(slashed, day_first),
                      D.named_date(day_named), D.named_date(month_named))


def span_hours(start, end):
    """Hours between two written clock times, next day when the end is earlier."""
    gap = D.parse_minutes(end) - D.parse_minutes(start)
    return F.round(F.when(gap < 0, gap + 1440).otherwise(gap) / 60, 2).cast(NUM)


def extract_row(line):
    """Struct of work_date, day, start, end, regular, overtime, total for a row-like line.

    After dates and times are stripped, one number is the total, two are regular and overtime,
    three or more end in regular, overtime, total; without numbers the clock times decide.
    """
    rest = line
    for strip in RX.ROW_STRIPS:
        rest = F.regexp_replace(rest, strip, "")
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(rf"\b{RX.NUMBER}\b"), F.lit(1)),
                          lambda x: x.cast(NUM))
    times = F.regexp_extract_all(line, F.lit(RX.CLOCK), F.lit(1))
    day = F.initcap(F.nullif(F.regexp_extract(line, f"({RX.LINE_WEEKDAY})", 1), F.lit("")))

    def build(x):
        used = F.filter(x.n, lambda v: v > 0)
        return bind(F.struct(x.n.alias("n"), x.t.alias("t"), x.d.alias("d"), x.day.alias("day"),
                             F.when(F.size(used) > 0, used).otherwise(x.n).alias("w")), judge)

    def judge(x):
        start, end, count = F.get(x.t, 0), F.get(x.t, 1), F.size(x.w)
        second = F.get(x.n, 1)
        by_clock = F.when(count == 0, span_hours(start, end))
        regular = (F.when(count.isin(1, 2), F.get(x.w, 0)).when(count >= 3, F.get(x.w, count - 3))
                   .otherwise(by_clock))
        overtime = F.when(count == 2, second).when(count >= 3, F.get(x.w, count - 2))
        total = (F.when(count == 1, F.get(x.w, 0))
                 .when(count == 2, F.get(x.w, 0) + F.greatest(second, F.lit(0)))
                 .when(count >= 3, F.get(x.w, count - 1)).otherwise(by_clock))
        return F.struct(x.d.alias("work_date"), x.day.alias("day"), start.alias("start"), end.alias("end"),
                        regular.cast(NUM).alias("regular"), overtime.cast(NUM).alias("overtime"),
                        total.cast(NUM).alias("total"))

    return bind(F.struct(numbers.alias("n"), times.alias("t"), find_date(line).alias("d"), day.alias("day")), build)


def reject_reason(total, day, start, end):
    """Why a row is not accepted, or NULL."""
    outside = ~day.between(start, end)
    return (F.when(total > P.MAX_PLAUSIBLE_HOURS, "IMPOSSIBLE_HOURS")
            .when(total <= 0, "NO_HOURS").when(F.coalesce(outside, F.lit(False)), "OUTSIDE_PERIOD"))


def stated_total(text, pattern):
    """First stated figure above 0 and within the hours of a month."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast(NUM))
    return F.get(F.filter(found, lambda v: (v > 0) & (v <= P.MAX_MONTH_HOURS)), 0)


def label_value(line, field):
    """Value after a label, without closing punctuation; at least two characters."""
    value = F.trim(F.regexp_replace(F.trim(F.regexp_extract(line, RX.LABELS[field], 1)), r"^[.,;:]+|[.,;:]+$", ""))
    return F.when(F.length(value) > 1, value)


def find_period(text):
    """Struct of start, end and kind: explicit range, else month and year, else ISO week."""
    a, b = groups(text, RX.PERIOD_RANGE, 1, 2)
    c, d = groups(text, RX.DATE_RANGE, 1, 2)
    start = D.numeric_date(F.coalesce(a, c), True)
    end = D.numeric_date(F.when(a.isNotNull(), b).otherwise(d), True)
    month, year = groups(text, RX.MONTH_YEAR, 1, 2)
    first = D.valid_date(year.try_cast("int"), D.month_number(month), F.lit(1))
    week, wyear = groups(text, RX.WEEK_YEAR, 1, 2)
    monday = F.date_add(F.date_trunc("week", F.make_date(wyear.try_cast("int"), F.lit(1), F.lit(4))).cast("date"),
                        (week.try_cast("int") - 1) * 7)
    monday = F.when(week.try_cast("int").between(1, 53), monday)
    ranged = start.isNotNull() & end.isNotNull()
    return (F.when(ranged, F.struct(start.alias("start"), end.alias("end"), F.lit("RANGE").alias("kind")))
            .when(first.isNotNull(), F.struct(first.alias("start"), F.last_day(first).alias("end"), F.lit("MONTH").alias("kind")))
            .when(monday.isNotNull(), F.struct(monday.alias("start"), F.date_add(monday, 6).alias("end"), F.lit("WEEK").alias("kind"))))


def text_row(line):
    """Struct of work_date, in_min, out_min, hours for lines with a date (month first)."""
    written = F.nullif(F.regexp_extract(line, RX.ROW_DATE, 1), F.lit(""))
    hours = F.nullif(F.regexp_extract(line, RX.ROW_HOURS, 1), F.lit("")).try_cast(NUM)
    times = F.regexp_extract_all(line, F.lit(RX.ROW_CLOCK), F.lit(1))
    return F.struct(D.parse_date(written).alias("work_date"),
                    D.parse_work_minutes(F.get(times, 0)).alias("in_min"),
                    D.parse_work_minutes(F.get(times, 1)).alias("out_min"), hours.alias("hours"))


def formula_safe(value):
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def safe_identifier(value, size=80):
    """Anything but letters, digits, ``_ - .`` becomes ``_``; cut to ``size``."""
    return F.substring(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{N}_.\-]", "_"), 1, size)


def percent_text(ratio):
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))


def fixed_text(value, missing="MISSING"):
    return F.coalesce(value.cast("decimal(18,2)").cast("string"), F.lit(missing))


def split_sender(raw):
    """(name, address) of ``Name <address>``; a bare address has an empty name."""
    s = F.trim(raw)
    shaped = s.rlike(r"^.*<[^>]+>$")
    name = F.regexp_replace(F.trim(F.regexp_extract(s, r"^(.*?)\s*<([^>]+)>$", 1)), '^"+|"+$', "")
    mail = F.regexp_extract(s, r"^(.*?)\s*<([^>]+)>$", 2)
    return (F.when(shaped, name).otherwise(F.lit("")),
            F.lower(F.trim(F.when(shaped, mail).otherwise(s))))

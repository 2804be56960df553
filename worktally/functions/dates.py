"""Dates, clock times and week keys as Column expressions."""

from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions.names import bind

# Accepted ways of writing a date and a clock time.
ISO_START = r"^(\d{4})-(\d{2})-(\d{2})"
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
NUMERIC = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$"
DAY_NAMED = r"(?i)^(\d{1,2})[-\s]+([a-z]{3,9})\.?[-,\s]+(\d{4}|\d{2})$"
MONTH_NAMED = r"(?i)^([a-z]{3,9})\.?[-\s]+(\d{1,2})[-,\s]+(\d{4}|\d{2})$"
WEEKDAY = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?[.,\s]+"
TIME_AFTER = r"(?i)[\sT]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[ap]m)?$"
ORDINAL = r"(?i)(\d)(?:st|nd|rd|th)\b"
MONTH_WORDS = P.MONTHS_SHORT + P.MONTHS_LONG
CLOCK = r"(\d{1,2}[:.]\d{2})"
BARE_HOUR = r"(?:^|[^\w])(\d{1,2})\s*(?:am|pm)(?:$|[^\w])"


def try_date(text, layout):
    return F.try_to_timestamp(text, F.lit(layout)).cast("date")


def valid_date(year, month, day):
    """Date of whole numbers, NULL when there is no such day. Never fails, so costs no exceptions.

    Every argument is used several times: pass bound values (``_dated``), or each use is worked out anew for every row.
    """
    ok = month.between(1, 12) & day.between(1, 31) & year.between(1, 9999)
    date = F.when(ok, F.date_add(F.make_date(year, month, F.lit(1)), day - 1))
    return F.when(F.month(date) == month, date)


def _dated(year, month, day, read=None):
    """``valid_date``, or ``read(year, month, day)``, of values that are worked out once."""
    parts = F.struct(year.alias("y"), month.alias("m"), day.alias("d"))
    return bind(parts, lambda x: (read or valid_date)(x.y, x.m, x.d))


def _numbers(text, pattern, *groups):
    return [F.regexp_extract(text, pattern, g).try_cast("int") for g in groups]


def _digits(text, *spans):
    """Numbers at fixed places of a text that is known to hold digits there."""
    return [F.substring(text, at, n).try_cast("int") for at, n in spans]


def _full_year(year):
    """Years of two digits: below ``P.CENTURY_PIVOT`` in this century, else in the last one."""
    return F.when(year < P.CENTURY_PIVOT, year + 2000).when(year < 100, year + 1900).otherwise(year)


def month_number(word):
    at = F.array_position(F.array(*[F.lit(m) for m in MONTH_WORDS]), F.lower(word))
    return F.when(at > 0, (at - 1) % 12 + 1).cast("int")


def year_first_date(text, day_first=False, pattern=YEAR_FIRST):
    """``year/a/b``: month before day, but day before month where ``day_first`` is set and b can be a month."""
    def read(y, a, b):
        date = valid_date(y, a, b)
        return F.when(b <= 12, valid_date(y, b, a)).otherwise(date) if day_first else date
    return F.when(text.rlike(pattern), _dated(*_numbers(text, pattern, 1, 2, 3), read))


def numeric_date(text, day_first):
    """``a/b/year``: in the given order, swapped only when that gives no date."""
    def read(y, a, b):
        y = _full_year(y)
        usual = (b, a) if day_first else (a, b)
        return bind(y, lambda full: F.coalesce(valid_date(full, *usual), valid_date(full, *usual[::-1])))
    a, b, y = _numbers(text, NUMERIC, 1, 2, 3)
    return F.when(text.rlike(NUMERIC), _dated(y, a, b, read))


def named_date(text):
    def read(pattern, word, day):
        def made(y, m, d):
            return bind(F.struct(_full_year(y).alias("y"), month_number(m).alias("m")), lambda x: valid_date(x.y, x.m, d))
        d, y = _numbers(text, pattern, day, 3)
        return _dated(y, F.regexp_extract(text, pattern, word), d, made)
    return F.when(text.rlike(DAY_NAMED), read(DAY_NAMED, 2, 1)).when(text.rlike(MONTH_NAMED), read(MONTH_NAMED, 1, 2))


def parse_date(text, day_first=False):
    """ISO text first (a bad ISO date is NULL), then numbers in the given order, year-first, then named months.

    Numbers may be parted by slashes, dashes or dots; a leading weekday, a trailing clock time and ordinal endings play no part.
    """
    def bare(s):
        s = F.regexp_replace(F.regexp_replace(s, WEEKDAY, ""), TIME_AFTER, "")
        return F.regexp_replace(s, ORDINAL, "$1")

    def read(s):
        unusable = F.lower(s).isin(P.EMPTY_TOKENS) | F.upper(s).startswith("INVALID")
        return (F.when(unusable, None)
                .when(s.rlike(ISO_START), _dated(*_digits(s, (1, 4), (6, 2), (9, 2))))
                .otherwise(bind(bare(s), lambda b: F.coalesce(
                    numeric_date(b, day_first), year_first_date(b, day_first), year_first_date(b, day_first, COMPACT), named_date(b)))))
    return bind(F.trim(text), read)


def parse_minutes(text, infer_pm=False):
    """Minute of day from ``9:30``, ``9.30 pm`` or ``5 pm``; NULL when out of range."""
    def read(s):
        """A bare hour is looked for only where there is no clock."""
        return bind(F.regexp_extract(s, CLOCK, 1), lambda clock: bind(F.struct(
            F.when(clock != "", F.translate(clock, ".", ":")).otherwise(F.concat(F.regexp_extract(s, BARE_HOUR, 1), F.lit(":0"))).alias("clock"),
            s.contains("pm").alias("pm"), s.contains("am").alias("am")), split))

    def split(x):
        hour, minute = [F.substring_index(x.clock, ":", at).try_cast("int") for at in (1, -1)]
        return bind(F.struct(hour.alias("h"), minute.alias("m"), x.pm.alias("pm"), x.am.alias("am")), shift)

    def shift(x):
        hour = F.when(x.pm & (x.h < 12), x.h + 12).when(~x.pm & x.am & (x.h == 12), 0)
        if infer_pm:
            hour = hour.when(~x.pm & ~x.am & (x.h > 0) & (x.h < 8), x.h + 12)
        hour = hour.otherwise(x.h)
        return F.when(hour.between(0, 23) & x.m.between(0, 59), hour * 60 + x.m)

    return bind(F.lower(F.trim(text)), read)


def parse_work_minutes(text):
    """As ``parse_minutes`` for worked shifts: midnight is no time, 1 to 7 without am/pm is pm."""
    def read(x):
        marked = F.upper(x.s).rlike("AM|A[.]M|PM|P[.]M")
        return F.when(x.t == 0, None).when(x.t.between(60, 479) & ~marked, x.t + 720).otherwise(x.t)
    return bind(F.struct(text.alias("s"), parse_minutes(text).alias("t")), read)


def repair_pm(start, end):
    """An end before the start and before noon is taken as afternoon."""
    return F.when((end < start) & (end < 720), end + 720).otherwise(end)


def break_minutes(text):
    """Digits only; below 10 the figure is hours."""
    digits = F.regexp_replace(text, r"[^0-9.]", "")
    value = digits.try_cast("decimal(12,4)")
    minutes = F.when(value < 10, F.floor(value * 60)).otherwise(F.floor(value))
    return F.coalesce(minutes.cast("int"), F.lit(0))


def clock_text(minutes):
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def iso_week(day):
    """Monday of the week: equal exactly when ISO year and week are equal."""
    return F.date_sub(day, F.weekday(day))


def monday_week_label(day):
    """Year-bound label ``yyyy-Www`` with weeks starting on Monday, week 0 before the first one."""
    number = F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7)
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


def epoch_artefact(ts):
    """``INVALID_1900-..`` for spreadsheet epoch artefacts, else NULL."""
    hit = (F.year(ts) == 1900) & (F.month(ts) == 1) & F.dayofmonth(ts).between(2, 28)
    return F.when(hit, F.concat(F.lit("INVALID_"), F.date_format(ts, "yyyy-MM-dd")))


def resolve_period(kind, value, monday_weeks=False):
    """(start, end) columns of a month, ISO week, year or ``a:b`` period given as text columns."""
    month = try_date(F.concat(value, F.lit("-01")), "yyyy-MM-dd")
    year = F.make_date(value.try_cast("int"), F.lit(1), F.lit(1))
    wy = F.regexp_extract(value, r"^(\d{4})-W(\d{1,2})$", 1).try_cast("int")
    wn = F.regexp_extract(value, r"^(\d{4})-W(\d{1,2})$", 2).try_cast("int")
    if monday_weeks:
        first = F.make_date(wy, F.lit(1), F.lit(1))
        anchor = F.date_add(first, F.pmod(F.lit(7) - F.weekday(first), F.lit(7)))
    else:
        anchor = F.date_trunc("week", F.make_date(wy, F.lit(1), F.lit(4))).cast("date")
    week = F.coalesce(F.date_add(anchor, (wn - 1) * 7), try_date(value, "yyyy-MM-dd"))
    left, right = F.split_part(value, F.lit(":"), F.lit(1)), F.split_part(value, F.lit(":"), F.lit(2))
    start = (F.when(kind == "month", month).when(kind == "week", week).when(kind == "year", year)
             .when(kind == "custom", try_date(left, "yyyy-MM-dd")))
    end = (F.when(kind == "month", F.last_day(month)).when(kind == "week", F.date_add(week, 6))
           .when(kind == "year", F.date_add(F.add_months(year, 12), -1))
           .when(kind == "custom", try_date(right, "yyyy-MM-dd")))
    return start, end


def day_name(d):
    """English name of the day."""
    return F.date_format(d, "EEEE")


def is_weekday(d):
    """Monday to Friday."""
    return F.weekday(d) < 5

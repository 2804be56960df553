import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from worktally.functions import dates as D
from worktally.functions import hours as H
from worktally.functions import names as N
from worktally.functions import rows as RW



def day(text):
    return dt.date.fromisoformat(text)


def test_ambiguous_dates_follow_the_locale(column):
    assert column(["03/04/2026"], D.parse_date(F.col("x"))) == [day("2026-03-04")]
    assert column(["03/04/2026"], D.parse_date(F.col("x"), day_first=True)) == [day("2026-04-03")]


def test_dates_in_many_layouts(column):
    texts = ["INVALID_1900-01-05", "", "nan", None, "2026-02-31", "2026-05-01 08:00", "5-Apr-2026", "April 5, 2026",
             "5 april 2026", "25/12/2026", "12-25-2026", "not a date", "Apr. 5 2026", "31/02/2026"]
    want = [None, None, None, None, None, day("2026-05-01"), day("2026-04-05"), day("2026-04-05"),
            day("2026-04-05"), day("2026-12-25"), day("2026-12-25"), None, day("2026-04-05"), None]
    assert column(texts, D.parse_date(F.col("x"))) == want


def test_clock_times(column):
    texts = ["06:00", "5:00pm", "12:00am", "9.30", "5 pm", "25:00", "", None, "12:15 PM", "07:75"]
    assert column(texts, D.parse_minutes(F.col("x"))) == [360, 1020, 0, 570, 1020, None, None, None, 735, None]
    assert column(["06:00", "09:00", "6:00 am"], D.parse_minutes(F.col("x"), infer_pm=True)) == [1080, 540, 360]
    assert column(["0:00", "5:30", "5:30 AM", "08:00"], D.parse_work_minutes(F.col("x"))) == [None, 1050, 330, 480]


def test_breaks(column):
    assert column(["0.5", "30", "45 min", "", "x", "1"], D.break_minutes(F.col("x"))) == [30, 30, 45, 0, 0, 60]


def test_week_labels_at_year_ends(column):
    start = dt.date(1994, 12, 20)
    days = [start + dt.timedelta(n) for n in range(3000)]
    assert column(days, D.monday_week_label(F.col("x")), "date") == [d.strftime("%Y-W%W") for d in days]
    assert column(days, D.iso_week(F.col("x")), "date") == [d - dt.timedelta(d.weekday()) for d in days]


def test_periods(spark):
    rows = [("month", "2026-04"), ("week", "2026-W17"), ("year", "2026"), ("custom", "2026-01-02:2026-01-09"),
            ("all", None), ("week", "2026-04-20")]
    df = spark.createDataFrame(rows, "kind string, value string")
    start, end = D.resolve_period(F.col("kind"), F.col("value"))
    got = [(str(r[0]), str(r[1])) for r in df.select(start, end).collect()]
    assert got == [("2026-04-01", "2026-04-30"), ("2026-04-20", "2026-04-26"), ("2026-01-01", "2026-12-31"),
                   ("2026-01-02", "2026-01-09"), ("None", "None"), ("2026-04-20", "2026-04-26")]
    monday, _ = D.resolve_period(F.col("kind"), F.col("value"), monday_weeks=True)
    assert str(df.select(monday).collect()[1][0]) == "2026-04-27"


def test_worked_hours(spark):
    rows = [(540, 1020, 60, None), (None, None, 0, Decimal("8.00")), (540, 1080, 0, Decimal("3.00")),
            (1320, 360, 0, None), (480, 479, 0, Decimal("8.00")), (None, 480, 0, None), (540, 545, 30, None)]
    df = spark.createDataFrame(rows, "a int, z int, b int, e decimal(10,2)")
    hours, method = H.worked_hours(F.col("a"), F.col("z"), F.col("b"), F.col("e"))
    got = [(r[0] if r[0] is None else float(r[0]), r[1]) for r in df.select(hours, method).collect()]
    assert got == [(7.0, "CALCULATED_FROM_IN_OUT"), (8.0, "HOURS_FROM_FILE_ONLY"), (9.0, "CALCULATED_FROM_IN_OUT"),
                   (8.0, "CALCULATED_FROM_IN_OUT"), (8.0, "ENTERED_HOURS_USED_AMPM_AMBIGUITY"), (None, "NO_HOURS"),
                   (0.0, "CALCULATED_FROM_IN_OUT")]


def test_daily_split(spark):
    df = spark.createDataFrame([(Decimal(10), Decimal(8), True), (Decimal(10), Decimal(8), False), (Decimal(10), None, None),
                                (None, Decimal(8), True)], "h decimal(10,2), l decimal(10,2), ok boolean")
    reg, ot = H.split_hours(F.col("h"), F.col("l"), F.col("ok"))
    assert [(float(r[0]), float(r[1])) for r in df.select(reg, ot).collect()] == [(8, 2), (10, 0), (8, 2), (0, 0)]


def test_extracted_names(column):
    texts = ["Susan Savage April", "Savage, Susan", "Richard TS", "Monthly Time Record", "Jane Doe Reimbursement",
             "JOHN SMITH", "Mary-Jane O'Brien", "Muthuraj Anbalagan Week Start", "", None, "Al", "Bharath 2024 Muddada", "KIM O'NEIL-ROSS"]
    want = ["Susan Savage", "Susan Savage", None, None, "Jane Doe", "John Smith", "Mary-Jane O'Brien",
            "Muthuraj Anbalagan", None, None, None, "Bharath Muddada", "Kim O'Neil-Ross"]
    assert column(texts, N.clean_extracted(F.col("x"))) == want


def test_names_for_matching_and_files(column):
    assert column(["Susan_Savage_April", "JANE DOE 2026", "acme Inc", "TS 12"], N.clean_for_matching(F.col("x"))) == \
        ["Susan Savage", "Jane Doe", "acme", ""]
    files = ["x/Richard Watson April 2026.xlsx", "employee_John_Smith_may2026.pdf", "Bharath_TS_April_2026.pdf"]
    assert column(files, N.from_file_name(F.col("x")))[0] == "Richard Watson"
    assert column(files, N.from_file_name(F.col("x")))[2] is None


def test_address_veto(spark):
    df = spark.createDataFrame([("Ana Lopez", "12B ana lopez Court"), ("Ana Lopez", "Ana Lopez, 5 Main Street"),
                                ("A+b", "1 a+b road")], "n string, t string")
    assert [r[0] for r in df.select(N.looks_like_address(F.col("n"), F.col("t"))).collect()] == [True, False, True]


def test_formula_and_text_helpers(column):
    assert column(["=cmd|calc", "@SUM(A1)", "-2+3", "John Smith", None, "\tx"], RW.formula_safe(F.col("x"))) == \
        ["'=cmd|calc", "'@SUM(A1)", "'-2+3", "John Smith", None, "'\tx"]
    assert column(["a b/c@d.e", None], RW.safe_identifier(F.col("x"))) == ["a_b_c_d.e", ""]
    df_like = ['"Ana" <Ana@X.io>', "bob@x.io", "Ana Lopez <a@b>"]
    name, mail = RW.split_sender(F.col("x"))
    assert column(df_like, name) == ["Ana", "", "Ana Lopez"]
    assert column(df_like, mail) == ["ana@x.io", "bob@x.io", "a@b"]


def test_row_extraction(column):
    texts = ["Mon 2026-05-04 09:00 17:30 8.0 PROJ-101 fix", "19/05/2026 7.5 1.5", "May 19, 2026 9:00 AM 5:30 PM",
             "19 May 2026 8 2 10", "no date 8.0", "13/25/2026 8", "2026-05-04 0 0"]
    got = column(texts, RW.extract_row(F.col("x")))
    pick = [(str(r.work_date), r.regular and float(r.regular), r.overtime and float(r.overtime),
             None if r.total is None else float(r.total)) for r in got]
    assert pick[0] == ("2026-05-04", 8.0, None, 8.0) and got[0].day == "Mon" and got[0].start == "09:00"
    assert pick[1] == ("2026-05-19", 7.5, 1.5, 9.0)
    assert pick[3] == ("2026-05-19", 8.0, 2.0, 10.0)
    assert pick[4][0] == "None" and pick[5][0] == "None"


def test_periods_in_text(column):
    got = column(["Period: 01/05/2026 to 15/05/2026", "April 2026 sheet", "Week 21, 2026", "nothing"], RW.find_period(F.col("x")))
    assert [(str(p.start), str(p.end), p.kind) if p else None for p in got] == [
        ("2026-05-01", "2026-05-15", "RANGE"), ("2026-04-01", "2026-04-30", "MONTH"),
        ("2026-05-18", "2026-05-24", "WEEK"), None]


def test_everyday_date_layouts(column):
    want = day("2024-01-05")
    texts = ["2024/01/05", "Mon, Jan 5, 2024", "Friday 01/05/2024", "01/05/2024 00:00", "20240105", "1.5.2024", "Jan-05-2024", "January 5th, 2024",
             "5 Jan 24", "2024-1-5", "2024-01-05T09:30:00", "Jan 5 2024 9:30 pm", "1/5/24"]
    assert column(texts, D.parse_date(F.col("x"))) == [want] * len(texts)
    assert column(["5.1.2024", "2024/05/01", "20240501", "2024/01/25"], D.parse_date(F.col("x"), day_first=True)) == [want] * 3 + [day("2024-01-25")]
    assert column(["1/5/75", "1/5/76", "2024/13/01", "20241301", "Monday", "5th"], D.parse_date(F.col("x"))) == [day("2075-01-05"), day("1976-01-05")] + [None] * 4

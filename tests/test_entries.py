import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from worktally.operators import entries as E
from worktally.operators import grouping as G
from worktally.operators import payroll as PAY
from worktally.operators import rules as R


def sequential_overtime(rows, limit):
    """Latest day first, then id: excess regular hours of a week become overtime."""
    weeks = {}
    for r in rows:
        weeks.setdefault((r["submission_id"], r["work_date"] - dt.timedelta(r["work_date"].weekday())), []).append(r)
    out = {}
    for group in weeks.values():
        excess = sum(r["regular_hours"] for r in group) - limit
        for r in sorted(group, key=lambda r: (-r["work_date"].toordinal(), r["entry_id"])):
            move = max(Decimal(0), min(r["regular_hours"], excess)) if r["overtime_enabled"] else Decimal(0)
            excess -= move
            out[r["entry_id"]] = (r["regular_hours"] - move, r["overtime_hours"] + move)
    return out


@pytest.mark.parametrize("run", [4, 1 << 16])
def test_weekly_overtime_equals_the_sequential_rule(spark, monkeypatch, run):
    monkeypatch.setattr(G, "RUN", run)
    rnd = random.Random(7)
    rows = []
    for i in range(1500):
        hot = rnd.random() < 0.4  # one submission holds a large share of all rows
        rows.append(dict(entry_id=i, submission_id=1 if hot else rnd.randint(2, 60), overtime_enabled=rnd.random() < 0.9 or hot,
                         work_date=dt.date(2024, 1, 1) + dt.timedelta(rnd.randint(0, 40)),
                         regular_hours=Decimal(rnd.randint(0, 800)) / 100, overtime_hours=Decimal(rnd.randint(0, 200)) / 100,
                         weekly_limit=Decimal(40)))
    for r in rows:
        r["overtime_enabled"] = r["submission_id"] % 7 != 0
    df = spark.createDataFrame(rows, "entry_id long, submission_id long, overtime_enabled boolean, work_date date, "
                               "regular_hours decimal(10,2), overtime_hours decimal(10,2), weekly_limit decimal(10,2)")
    got = {r.entry_id: (r.regular_hours, r.overtime_hours) for r in E.weekly_overtime(df).collect()}
    assert got == sequential_overtime(rows, Decimal(40))


def test_forty_five_hour_week(spark):
    rows = [(i, 1, dt.date(2024, 1, 1 + i), Decimal(9) if i < 5 else Decimal(0)) for i in range(5)]
    df = spark.createDataFrame(rows, "entry_id long, submission_id long, work_date date, regular_hours decimal(10,2)")
    df = df.withColumns({"overtime_hours": F.lit(0).cast("decimal(10,2)"), "weekly_limit": F.lit(None).cast("decimal(10,2)"),
                         "overtime_enabled": F.lit(None).cast("boolean")})
    out = E.weekly_overtime(df).agg(F.sum("regular_hours"), F.sum("overtime_hours")).first()
    assert tuple(map(float, out)) == (40.0, 5.0)


def sequential_collisions(rows):
    stored, out = {}, {}
    for r in sorted(rows, key=lambda r: r["entry_id"]):
        key = (r["submission_id"], r["work_date"])
        first = stored.get(key)
        if first is None:
            out[r["entry_id"]] = "FIRST"
            if not r["implausible"]:
                stored[key] = r
            continue
        clocks = [r["in_min"], r["out_min"], first["in_min"], first["out_min"]]
        if None not in clocks and (clocks[0] != clocks[2] or clocks[1] != clocks[3]):
            out[r["entry_id"]] = "SECOND_SHIFT"
        else:
            held = first["calculated_hours"] or first["entered_hours"] or 0
            out[r["entry_id"]] = "OVERLAPPING_DATE_CONFLICT" if abs(held - (r["entered_hours"] or 0)) > Decimal("0.1") else "DUPLICATE_DATE"
    return out


def test_same_day_collisions_equal_the_sequential_rule(spark):
    rnd = random.Random(3)
    pick = lambda *v: rnd.choice(v)
    rows = [dict(entry_id=i, submission_id=rnd.randint(1, 9), work_date=dt.date(2024, 1, rnd.randint(1, 4)),
                 in_min=pick(None, 480, 540), out_min=pick(None, 960, 1020), entered_hours=pick(None, Decimal("8"), Decimal("8.05"), Decimal("7")),
                 calculated_hours=pick(None, Decimal("8"), Decimal("0")), implausible=pick(True, False, False)) for i in range(300)]
    df = spark.createDataFrame(rows, "entry_id long, submission_id long, work_date date, in_min int, out_min int, "
                               "entered_hours decimal(10,2), calculated_hours decimal(10,2), implausible boolean")
    got = {r.entry_id: r.collision for r in E.same_day_collisions(df).collect()}
    assert got == sequential_collisions(rows)


def test_rates_as_of(spark):
    d = dt.date
    rates = spark.createDataFrame([
        (1, Decimal(20), None, d(2023, 1, 1), None), (1, Decimal(22), Decimal(0), d(2024, 1, 10), d(2024, 1, 20)),
        (2, Decimal(30), Decimal(45), d(2024, 2, 1), None)],
        "employee_id long, regular_rate decimal(10,4), overtime_rate decimal(10,4), effective_start date, effective_end date")
    subs = spark.createDataFrame([(1, 1, None, d(2024, 1, 15)), (2, 1, None, d(2024, 1, 25)), (3, 1, d(2024, 1, 12), None),
                                  (4, 2, None, d(2024, 1, 15)), (5, None, None, d(2024, 1, 15))],
                                 "submission_id long, employee_id long, start_date date, end_date date")
    got = {r.submission_id: r.regular_rate and float(r.regular_rate) for r in PAY.rate_as_of(subs, rates, PAY.worked_until()).collect()}
    assert got == {1: 22.0, 2: 20.0, 3: 22.0, 4: None, 5: None}
    missing = PAY.without_active_rate(subs, rates, F.lit("2024-01-15").cast("date"))
    assert sorted(r.submission_id for r in missing.collect()) == [4, 5]


def test_pay_uses_one_and_a_half_times_when_no_overtime_rate(spark):
    d = dt.date(2024, 1, 15)
    subs = spark.createDataFrame([(1, 1, d, d), (2, 2, d, d)], "submission_id long, employee_id long, start_date date, end_date date")
    totals = spark.createDataFrame([(1, Decimal(40), Decimal(5)), (2, Decimal(8), Decimal(0))],
                                   "submission_id long, regular_hours decimal(10,2), overtime_hours decimal(10,2)")
    rates = spark.createDataFrame([(1, Decimal(20), Decimal(0), d, None)],
                                  "employee_id long, regular_rate decimal(10,4), overtime_rate decimal(10,4), effective_start date, effective_end date")
    out = {r.submission_id: r for r in PAY.payroll_results(subs, totals, rates).collect()}
    assert float(out[1].total_pay) == 40 * 20 + 5 * 30 and out[2].payroll_status == "BLOCKED"
    run = PAY.run_totals(PAY.payroll_results(subs, totals, rates)).first()
    assert (run.ready, run.blocked, float(run.total_pay), run.run_status) == (1, 1, 950.0, "NEEDS_REVIEW")


def test_payroll_takes_ready_and_passed_submissions_of_its_period(spark):
    d = dt.date(2024, 1, 15)
    subs = spark.createDataFrame([(i, i, d, d, 1 + (i == 5)) for i in range(1, 6)],
                                 "submission_id long, employee_id long, start_date date, end_date date, period_id int")
    found = spark.createDataFrame([("2", "BLOCKER", "OPEN"), ("3", "BLOCKER", "RESOLVED"), ("4", "ERROR", "OPEN"), ("3", "WARNING", "OPEN")],
                                  "submission_id string, severity string, status string")
    judged = R.readiness(subs, found)
    ids = lambda df: sorted(int(r.submission_id) for r in df.collect())
    assert ids(PAY.payable(judged)) == [1, 3, 5]
    assert ids(PAY.payable(judged, period=1)) == [1, 3]
    totals = spark.createDataFrame([(1, Decimal(8), Decimal(0))], "submission_id long, regular_hours decimal(10,2), overtime_hours decimal(10,2)")
    rates = spark.createDataFrame([(1, Decimal(20), Decimal(0), d, None), (3, Decimal(20), Decimal(0), d, None)],
                                  "employee_id long, regular_rate decimal(10,4), overtime_rate decimal(10,4), effective_start date, effective_end date")
    out = PAY.payroll_results(PAY.payable(judged), totals, rates)
    assert ids(out) == [1, 3, 5]  # a submission without entries keeps its result
    assert ids(R.missing_pay_rate(out)) == [5]


def test_rules_together_equal_rules_alone(spark):
    rows = [(i, 1, Decimal(i % 20), Decimal(i % 9), Decimal(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "entry_id long, submission_id long, calculated_hours decimal(10,2), regular_hours decimal(10,2), overtime_hours decimal(10,2)")
    df = df.withColumns({"entered_hours": F.col("calculated_hours"), "daily_limit": F.lit(6).cast("decimal(5,2)")})
    rules = [R.daily_hours_rule(), R.regular_limit_rule(), R.total_mismatch_rule()]
    key = lambda r: (r.rule_code, r.entry_id, r.expected_value, r.actual_value)
    together = sorted(key(r) for r in R.apply_rules(df, rules).collect())
    alone = sorted(key(r) for rule in rules for r in R.apply_rule(df, rule).collect())
    assert together == alone and together


def test_unscoped_rules_for_holidays(spark):
    d = dt.date(2024, 1, 1)
    hol = spark.createDataFrame([(2, "INTERNAL", d, "Own"), (1, "OTHER", d, "Foreign")],
                                "calendar_id int, applies_to string, holiday_date date, holiday_name string")
    emp = spark.createDataFrame([(1, "INTERNAL"), (2, "NOBODY"), (3, None), (4, "OTHER")], "employee_id long, employee_type string")
    ent = spark.createDataFrame([(e, e, d, "WORK", Decimal(8), None) for e in (1, 2, 3, 4)],
                                "entry_id long, employee_id long, work_date date, entry_type string, calculated_hours decimal(5,2), entered_hours decimal(5,2)")
    got = {r.entry_id: r.holiday_name for r in R.with_holiday(ent, emp, hol).collect()}
    assert got == {1: "Own", 2: "Foreign", 3: "Foreign", 4: "Foreign"}


def raw_claims(spark, rows):
    names = ("seq", "file_id", "employee_id", "raw_date", "in_text", "out_text", "hours_text", "break_text", "entry_type")
    return spark.createDataFrame([dict(zip(names, r, strict=True)) | {"batch_id": 1, "leave_type": None} for r in rows],
                                 "seq long, file_id long, employee_id long, batch_id int, raw_date string, in_text string, out_text string, "
                                 "hours_text string, break_text string, entry_type string, leave_type string")


def store_inputs(spark):
    employees = spark.createDataFrame([(1, 7), (2, 8)], "employee_id long, vendor_id long")
    vendors = spark.createDataFrame([(7, "V", Decimal(8), Decimal(40), True), (8, "W", Decimal(8), Decimal(40), False)],
                                    "vendor_id long, name string, daily_limit decimal(5,2), weekly_limit decimal(6,2), overtime_enabled boolean")
    return employees, vendors


def test_store_from_messy_claims_to_final_hours(spark):
    days = [f"2024-01-0{d}" for d in range(1, 7)]
    rows = [(i, 10, 1, d, "08:00", "17:00", "9", "0", "WORK") for i, d in enumerate(days)]  # six nine-hour days of a week
    rows += [(10, 10, 1, days[0], None, None, "9", "", "WORK"),  # the same day once more
             (11, 11, 1, days[1], None, None, "3", "", "WORK"),  # another figure for a stored day
             (12, 10, 1, days[2], "18:00", "20:00", "2", "0", "WORK"),  # a second shift
             (13, 10, 1, "INVALID_x", None, None, "5", "", "WORK"), (14, 10, 1, "none", None, None, "5", "", "WORK"),
             (15, 10, 1, "2024-01-09", None, None, "30", "", "WORK"), (16, 10, 1, "2024-01-09", None, None, "7", "", "WORK"),
             (20, 20, 2, days[0], "08:00", "18:00", "10", "0", "WORK"), (21, 21, None, "01/02/2024", None, None, None, None, "LEAVE")]
    store = E.entry_store(raw_claims(spark, rows), *store_inputs(spark))
    got = {r.seq: r for r in store.entries.collect()}
    assert len(got) == len(rows)
    assert {k: r.disposition for k, r in got.items() if r.disposition != "STORED"} == {
        10: "DUPLICATE_DATE", 11: "OVERLAPPING_DATE_CONFLICT", 13: "INVALID_DATE", 14: "NO_DATE", 15: "IMPLAUSIBLE_HOURS"}
    assert all(r.regular_hours is None and r.moved_hours is None for r in got.values() if r.disposition != "STORED")
    week = [r for k, r in got.items() if r.submission_id == "e1-b1" and r.disposition == "STORED" and str(r.work_date) < "2024-01-08"]
    assert sum(r.regular_hours for r in week) == 40 and sum(r.overtime_hours for r in week) == 6 * 9 + 2 - 40
    assert got[5].regular_hours == 0 and got[4].regular_hours == 6 and got[0].regular_hours == 8  # latest days first: 8 of the sixth, 2 of the fifth
    assert (got[20].regular_hours, got[20].overtime_hours) == (10, 0) and got[21].regular_hours == 0
    subs = {r.submission_id: r for r in store.submissions.collect()}
    assert set(subs) == {"e1-b1", "e2-b1", "f21"} and subs["e1-b1"].files == 2 and str(subs["e1-b1"].end_date) == "2024-01-09"
    assert {r.entry_id for r in store.stored().collect()} == set(got) - {10, 11, 13, 14, 15}


def test_store_of_a_hot_week_equals_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr(G, "RUN", 16)
    rnd = random.Random(4)
    rows = [(i, 10, 1, f"2024-01-0{rnd.randint(1, 7)}", f"{rnd.randint(0, 11):02d}:{i % 60:02d}", f"{rnd.randint(12, 23)}:{i // 60 % 60:02d}", "1", "0", "WORK") for i in range(400)]
    store = E.entry_store(raw_claims(spark, rows), *store_inputs(spark))
    kept = store.stored().collect()
    assert len(kept) > 300
    split = [dict(entry_id=r.seq, submission_id=r.submission_id, work_date=r.work_date, overtime_enabled=True, regular_hours=r.regular_hours + r.moved_hours,
                  overtime_hours=r.overtime_hours - r.moved_hours) for r in kept]
    assert {r.seq: (r.regular_hours, r.overtime_hours) for r in kept} == sequential_overtime(split, Decimal(40))


def test_whole_rows_are_written_twice_and_exchanged_once(spark, monkeypatch):
    """First rows and totals of a week come from narrow columns; only the last step moves whole rows."""
    plans, write = {}, E.staged
    monkeypatch.setattr(E, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    rows = [(i, 10, 1, "2024-01-02", "08:00", "17:00", "9", "0", "WORK") for i in range(3)]
    store = E.entry_store(raw_claims(spark, rows), *store_inputs(spark))
    assert list(plans) == ["claims", "entries"] and store.entries.count() == 3
    assert "SortAggregate" not in plans["entries"]
    read = [line for line in plans["entries"].splitlines() if "FileScan" in line]
    assert sum("file_id" in line.split("ReadSchema")[0] for line in read) == 1


def test_breaks_and_hours_that_are_no_numbers(spark):
    texts = ["nan", "inf", "60 min", "abc", "", None, "30", " 30.4 ", "1e1", "-5", ".5"]
    rows = [(i, i, 1, "2024-01-02", None, None, x, x, "WORK") for i, x in enumerate(texts)]
    got = {r.seq: r for r in E.typed_claims(raw_claims(spark, rows), *store_inputs(spark)).collect()}
    assert [got[i].break_minutes for i in range(len(texts))] == [0, 0, 0, 0, 0, 0, 30, 30, 10, -5, 1]
    hours = [None] * 6 + [Decimal(x) for x in ("30", "30.4", "10", "-5", "0.5")]
    assert [got[i].entered_hours for i in range(len(texts))] == hours


def test_empty_store(spark):
    store = E.entry_store(raw_claims(spark, []), *store_inputs(spark))
    assert store.entries.count() == 0 and store.submissions.count() == 0


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1]
    return plan.count("FileScan"), plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") + plan.count("Exchange rangepartitioning")


@pytest.mark.parametrize("name, most", [("j03_payroll_result", 6), ("d09_payroll_run_totals", 6), ("g01_rule_union", 8), ("i22_readiness_verdict", 9), ("e03_weekly_overtime", 2), ("c10_containment_match", 4)])
def test_final_plans_read_few_tables(spark, name, most):
    from __spark_entry__ import queries
    n, shuffles = scans(queries()[name](spark, "/root/testdata/sf0.001"))
    print(name, n, shuffles)
    assert n <= most

"""Extraction side: dates, times, names, grids, filled-in sheets, clean-up of rows."""

from pyspark.sql import functions as F

from worktally.functions import dates as D
from worktally.functions import hours as H
from worktally.functions import names as N
from worktally.functions import rows as RW
from worktally.operators import counters as CO
from worktally.operators import normalise as NO
from worktally.operators import rules as R
from worktally.operators.grouping import computed, ordered_distinct
from worktally.plans.registry import query
from worktally.sources.stages import staged


def typed(t):
    """Messy rows with dates, minutes and hours parsed."""
    return computed(t.fx_raw, work_date=D.parse_date(F.col("raw_date")),
                    in_min=D.parse_minutes(F.col("in_text")), out_min=D.parse_minutes(F.col("out_text")),
                    entered_hours=F.col("hours_text").try_cast(H.HOURS))


def day(text):
    return F.lit(text).cast("date")


@query("h01_parse_date", "seq:long, us:string, eu:string",
       """SELECT seq, CAST(work_date AS VARCHAR) AS us, CAST(CASE WHEN raw_date LIKE '%/%' THEN COALESCE(
            TRY_STRPTIME(raw_date, '%d/%m/%Y'), TRY_STRPTIME(raw_date, '%m/%d/%Y'))::DATE ELSE work_date END AS VARCHAR) AS eu
          FROM ck_typed""", heavy=True)
def h01(t):
    return t.fx_raw.select("seq", D.parse_date(F.col("raw_date")).alias("us"),
                           D.parse_date(F.col("raw_date"), day_first=True).alias("eu"))


LAYOUTS = ["yyyy/MM/dd", "EEE, MMM d, yyyy", "EEEE MM/dd/yyyy", "MM/dd/yyyy HH:mm", "yyyyMMdd", "M.d.yyyy", "MMM-dd-yyyy", "MMMM d'th', yyyy",
           "d MMMM yy", "yyyy-M-d", "yyyy-MM-dd'T'HH:mm:ss", "dd-MMM-yyyy"]


@query("h01_date_layouts", "o_orderkey:long, us:string", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS us FROM orders")
def h01_layouts(t):
    """Order dates written in a dozen layouts and read again."""
    written = F.coalesce(*[F.when(F.col("o_orderkey") % len(LAYOUTS) == i, F.date_format("o_orderdate", x)) for i, x in enumerate(LAYOUTS)])
    return t.orders.select("o_orderkey", D.parse_date(written).alias("us"))


@query("h02_parse_time", "seq:long, in_min:long, out_min:long, inferred:long",
       """SELECT seq, in_min, out_min, CASE WHEN out_min BETWEEN 60 AND 479 THEN out_min + 720 ELSE out_min END AS inferred
          FROM ck_typed""", heavy=True)
def h02(t):
    return t.fx_raw.select("seq", D.parse_minutes(F.col("in_text")).alias("in_min"),
                           D.parse_minutes(F.col("out_text")).alias("out_min"),
                           D.parse_minutes(F.col("out_text"), infer_pm=True).alias("inferred"))


@query("h03_parse_time_work", "seq:long, in_min:long, in_text24:string",
       """SELECT seq, m AS in_min, CONCAT(lpad(CAST(m // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(m % 60 AS VARCHAR), 2, '0')) AS in_text24
FROM (SELECT seq, CASE WHEN in_min = 0 THEN NULL WHEN in_min BETWEEN 60 AND 479 AND NOT regexp_matches(upper(in_text), 'AM|PM')
        THEN in_min + 720 ELSE in_min END AS m FROM ck_typed) q WHERE m IS NOT NULL""", heavy=True)
def h03(t):
    out = t.fx_raw.select("seq", D.parse_work_minutes(F.col("in_text")).alias("in_min"))
    return out.filter("in_min IS NOT NULL").withColumn("in_text24", D.clock_text(F.col("in_min")))


@query("h04_break_minutes", "seq:long, minutes:long",
       """SELECT seq, CASE break_text WHEN '' THEN 0 WHEN '30' THEN 30 WHEN '30.0' THEN 30 WHEN 'abc' THEN 0
          WHEN '0.5' THEN 30 ELSE 60 END AS minutes FROM fx_raw""")
def h04(t):
    return t.fx_raw.select("seq", D.break_minutes(F.col("break_text")).alias("minutes"))


@query("h05_pm_repair", "entry_id:long, out_min:long",
       """SELECT entry_id, out_min + CASE WHEN out_min < in_min AND out_min < 720 THEN 720 ELSE 0 END AS out_min
          FROM fx_entry""")
def h05(t):
    return t.fx_entry.select("entry_id", D.repair_pm(F.col("in_min"), F.col("out_min")).alias("out_min"))


@query("h12_week_keys", "o_orderkey:long, iso_monday:string, label:string",
       """SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS iso_monday,
          strftime(o_orderdate, '%Y-W%W') AS label FROM orders""")
def h12(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", D.iso_week(d).alias("iso_monday"), D.monday_week_label(d).alias("label"))


@query("h13_day_name", "o_orderkey:long, day_name:string, is_weekday:long",
       """SELECT o_orderkey, dayname(o_orderdate) AS day_name, CASE WHEN isodow(o_orderdate) <= 5 THEN 1 ELSE 0 END
          AS is_weekday FROM orders""")
def h13(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", D.day_name(d).alias("day_name"), D.is_weekday(d).cast("int").alias("is_weekday"))


FULL = "CONCAT(split_part(p.full_name, ' ', 1), ' ', split_part(p.full_name, ' ', 2))"


@query("h14_clean_extracted_name", "employee_id:long, cleaned:string",
       f"""SELECT p.employee_id, CASE CAST(p.employee_id % 12 AS INT) WHEN 0 THEN 'Susan Savage' WHEN 1 THEN 'Susan Savage'
    WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 'Jane Doe' WHEN 8 THEN NULL WHEN 10 THEN NULL
    ELSE {FULL} END AS cleaned FROM fx_person p""")
def h14(t):
    return t.fx_name.select("employee_id", N.clean_extracted(F.col("name")).alias("cleaned"))


@query("h15_clean_matching_name", "employee_id:long, cleaned:string",
       f"""SELECT p.employee_id, CASE CAST(p.employee_id % 12 AS INT) WHEN 0 THEN 'Susan Savage' WHEN 1 THEN 'Savage, Susan'
    WHEN 2 THEN 'Richard' WHEN 3 THEN '' WHEN 4 THEN 'Jane Doe' WHEN 5 THEN CONCAT({FULL}, ' Week Start')
    WHEN 8 THEN 'total hours' WHEN 10 THEN '' ELSE {FULL} END AS cleaned FROM fx_person p""")
def h15(t):
    return t.fx_name.select("employee_id", N.clean_for_matching(F.col("name")).alias("cleaned"))


@query("h16_name_from_file_name", "file_id:long, person:string",
       """SELECT file_id, CASE CAST(file_id % 11 AS INT) WHEN 0 THEN 'Ana Lopez' WHEN 4 THEN 'Boris Smith'
          WHEN 6 THEN 'Timesheets Chloe Okafor' WHEN 7 THEN 'Ito Hugo' WHEN 10 THEN 'Dmitri Novak' END AS person
          FROM fx_path""")
def h16(t):
    return t.fx_path.select("file_id", N.from_file_name(F.col("rel_path")).alias("person"))


@query("h17_name_from_text", "doc_id:long, name:string",
       """SELECT doc_id, COALESCE(arg_min(CASE k WHEN 0 THEN split_part('Ana Lopez,Boris Smith,Chloe Ito', ',', m + 1)
            ELSE 'signature' END, line_no) FILTER (k IN (0, 13))) AS name FROM ck_form GROUP BY doc_id""")
def h17(t):
    return NO.name_from_lines(t.fx_form)


@query("h17_name_from_header", "file_id:long, name:string",
       """SELECT file_id, CASE WHEN MAX(h) > 0 THEN 'Ana Lopez' END AS name FROM fx_grid GROUP BY 1
          HAVING COUNT(*) FILTER (part = 'H' AND row_no < 15) > 0""", heavy=True)
def h17_header(t):
    return NO.name_from_header(staged(NO.grid_rows(cells_of(t)), "grid"))


@query("h18_address_veto", "employee_id:long, vetoed:long",
       """SELECT employee_id, CASE WHEN employee_id % 3 = 0 THEN 1 ELSE 0 END AS vetoed FROM fx_person""")
def h18(t):
    p = t.fx_person.withColumn("text", F.when(F.col("employee_id") % 3 == 0, F.concat(
        F.lit("ship to 12B "), F.upper("full_name"), F.lit(" Court, unit 4"))).otherwise(
        F.concat(F.lit("call "), F.col("full_name"), F.lit(" on 5th street"))))
    return p.select("employee_id", N.looks_like_address(F.col("full_name"), F.col("text")).cast("int").alias("vetoed"))


def cells_of(t):
    """Grid rows to cells, one scan of the grid."""
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    col = lambda *v: F.array(*[F.lit(x[1:]) if x.startswith("=") else F.col(x) for x in v])
    g, part = t.fx_grid, F.col("part")
    values = (F.when(part == "P", lit("Employee: Ana Lopez", "", "", "", "", "", "", ""))
              .when((part == "H") & (F.col("layout") == 0), lit("Date", "Time In", "Time Out", "Break", "Total Hours", "Leave Type", "Sick", "Notes"))
              .when((part == "H") & (F.col("layout") == 1), lit("Work Date", "Start", "End", "Lunch", "Regular Hrs", "Billable Hours", "Daily Total", "Status"))
              .when(part == "H", lit("Day", "Date", "In", "Out", "Worked", "Vacation", "Update date", "Category"))
              .when(F.col("layout") == 0, col("d", "i", "o", "b", "w", "l", "s", "=x"))
              .when(F.col("layout") == 1, col("d", "i", "o", "b", "w", "s", "=", "l"))
              .otherwise(col("=Mon", "d", "i", "o", "w", "s", "d", "l")))
    return g.select("file_id", "row_no", F.posexplode(values).alias("col_no", "value"))


@query("e10_header_row", "file_id:long, header_row:long",
       "SELECT file_id, MIN(row_no) AS header_row FROM ck_layout WHERE part = 'H' AND row_no < 15 GROUP BY file_id", heavy=True)
def e10(t):
    return NO.header_rows(cells_of(t))


@query("e10_files_without_header", "file_id:long",
       "SELECT file_id FROM fx_grid GROUP BY 1 HAVING COUNT(*) FILTER (part = 'H' AND row_no < 15) = 0", heavy=True)
def e10_missing(t):
    return NO.files_without_header(cells_of(t))


@query("e10_header_row_any_depth", "file_id:long, header_row:long",
       "SELECT file_id, MIN(row_no) AS header_row FROM fx_grid WHERE part = 'H' GROUP BY 1", heavy=True)
def e10_deep(t):
    return NO.header_rows(cells_of(t), depth=None)


GRID_SQL = """
SELECT file_id, row_no, CASE WHEN d LIKE 'INVALID%' THEN d WHEN d LIKE '%/%' THEN '2024-01-09' ELSE d END AS work_date,
  CASE i WHEN '9:15 AM' THEN 555 WHEN '7:30' THEN 1170 WHEN '09:00' THEN 540 END AS in_min,
  CASE o WHEN '5:45 pm' THEN 1065 WHEN '17:30' THEN 1050 END AS out_min,
  CASE WHEN layout = 2 THEN 0 WHEN b = '0.5' THEN 30 WHEN b = '45 min' THEN 45 ELSE 0 END AS break_minutes,
  COALESCE(CASE layout WHEN 0 THEN COALESCE(CASE WHEN s = '8' THEN 8 END, TRY_CAST(w AS DECIMAL(10,2)))
    WHEN 1 THEN COALESCE(NULLIF(TRY_CAST(w AS DECIMAL(10,2)), 0), CASE WHEN s = '8' THEN 8 END)
    ELSE COALESCE(CASE WHEN s = '8' THEN 8 END, NULLIF(TRY_CAST(w AS DECIMAL(10,2)), 0)) END,
    CASE WHEN l = 'Public holiday' THEN 0 END) AS hours,
  CASE layout WHEN 0 THEN CASE WHEN s = '8' THEN 'LEAVE' WHEN l = 'pto' THEN 'LEAVE' WHEN l = 'Public holiday' THEN 'HOLIDAY' ELSE 'WORK' END
    WHEN 1 THEN CASE l WHEN 'pto' THEN 'LEAVE' WHEN 'Public holiday' THEN 'HOLIDAY' ELSE 'WORK' END
    ELSE CASE WHEN l = 'pto' THEN 'LEAVE' WHEN l = 'Public holiday' THEN 'HOLIDAY' WHEN s = '8' THEN 'LEAVE' ELSE 'WORK' END END AS entry_type,
  CASE layout WHEN 0 THEN CASE WHEN s = '8' THEN 'SICK' WHEN l = 'pto' THEN 'PTO' END
    WHEN 1 THEN CASE WHEN l = 'pto' THEN 'PTO' END
    ELSE CASE WHEN l = 'pto' THEN 'PTO' WHEN s = '8' THEN 'VACATION' END END AS leave_type
FROM fx_grid WHERE part = 'D' AND h < 15 AND d <> ''"""


@query("h19_grid_entries", "file_id:long, row_no:long, work_date:string, in_min:long, out_min:long, break_minutes:long, "
       "hours:double, entry_type:string, leave_type:string", GRID_SQL, heavy=True)
def h19(t):
    return NO.grid_entries(cells_of(t))


@query("h20_leave_detection", "entry_type:string, leave_type:string, n:long",
       f"SELECT entry_type, leave_type, COUNT(*) AS n FROM ({GRID_SQL}) q GROUP BY ALL", heavy=True)
def h20(t):
    return NO.grid_entries(cells_of(t)).groupBy("entry_type", "leave_type").agg(F.count("*").alias("n"))


@query("h21_text_line_rows", "doc_id:long, line_no:long, work_date:string, in_min:long, hours:double",
       """SELECT doc_id, line_no, substr(line, 1, 10) AS work_date, CASE WHEN m = 0 THEN NULL WHEN m BETWEEN 60 AND 479 THEN m + 720 ELSE m END AS in_min,
  CAST(split_part(line, ' ', 3) AS DECIMAL(10,2)) AS hours
FROM (SELECT *, CAST(substr(line, 12, 2) AS INT) * 60 + CAST(substr(line, 15, 2) AS INT) AS m FROM fx_line WHERE line LIKE '2024-%') q""", heavy=True)
def h21(t):
    rows = t.fx_line.select("doc_id", "line_no", RW.text_row(F.col("line")).alias("r"))
    return rows.filter("r.work_date IS NOT NULL").select("doc_id", "line_no", "r.*")


@query("h22_rule_rows", "doc_id:long, line_no:long, work_date:string, regular:double, overtime:double, total:double",
       "SELECT doc_id, line_no, work_date, regular, overtime, total FROM ck_form_rows", heavy=True)
def h22(t):
    return NO.form_rows(t.fx_form)


@query("h23_row_acceptance", "doc_id:long, line_no:long, reason:string",
       "SELECT doc_id, line_no, reason FROM ck_judged", heavy=True)
def h23(t):
    return NO.judged_rows(t.fx_form)


@query("h23_totals_compare", "doc_id:long, calculated:double, rejected:long, submitted:double, differs:long",
       """SELECT j.doc_id, COALESCE(SUM(total) FILTER (reason IS NULL), 0) AS calculated, COUNT(reason) AS rejected,
  MAX(submitted) AS submitted, CASE WHEN COUNT(*) FILTER (reason IS NULL) > 0 AND
    abs(COALESCE(SUM(total) FILTER (reason IS NULL), 0) - MAX(submitted)) > 0.25 THEN 1 ELSE 0 END AS differs
FROM ck_judged j LEFT JOIN ck_form_totals f ON f.doc_id = j.doc_id GROUP BY j.doc_id""", heavy=True)
def h23b(t):
    return NO.totals_check(t.fx_form).withColumn("differs", F.col("differs").cast("int"))


@query("h24_document_totals", "doc_id:long, submitted:double, approved:double",
       "SELECT doc_id, submitted, approved FROM ck_form_totals", heavy=True)
def h24(t):
    return NO.form_header(t.fx_form)


@query("h25_period_detection", "doc_id:long, start:string, end:string, kind:string",
       'SELECT doc_id, p_start AS start, p_end AS "end", kind FROM ck_form_period', heavy=True)
def h25(t):
    return NO.form_period(t.fx_form)


@query("h26_header_labels", "doc_id:long, employee_name:string, employee_code:string, department:string, "
       "manager:string, company:string, approval:string",
       """SELECT doc_id, arg_min(split_part('Ana Lopez,Boris Smith,Chloe Ito', ',', m + 1), line_no) FILTER (k = 0) AS employee_name,
  arg_min(CONCAT('E-', line_no % 100), line_no) FILTER (k = 1) AS employee_code,
  MAX(CASE WHEN k = 2 THEN 'Field Ops' END) AS department, MAX(CASE WHEN k = 2 THEN 'Greta Costa' END) AS manager,
  arg_min(CONCAT('Acme', line_no % 4), line_no) FILTER (k = 3) AS company,
  arg_min(CASE WHEN k = 4 AND m <> 0 THEN 'pending' ELSE 'approved' END, line_no) FILTER (k IN (4, 6)) AS approval
FROM ck_form GROUP BY doc_id""", heavy=True)
def h26(t):
    return NO.form_header(t.fx_form)


@query("h27_date_search", "line_no:long, day_first:string, month_first:string",
       """SELECT line_no, CAST(CASE WHEN k = 7 THEN CASE WHEN m = 0 THEN DATE '2024-01-01' END WHEN k = 8 THEN day
    WHEN k IN (9, 10, 11) THEN make_date(2024, 1, dd)
    WHEN k = 14 THEN CASE WHEN dd <= 12 THEN make_date(2024, dd, 1) ELSE make_date(2024, 1, dd) END END AS VARCHAR) AS day_first,
  CAST(CASE WHEN k = 7 THEN CASE WHEN m = 0 THEN DATE '2024-01-01' END WHEN k = 8 THEN day
    WHEN k = 9 THEN CASE WHEN dd <= 12 THEN make_date(2024, dd, 1) ELSE make_date(2024, 1, dd) END
    WHEN k IN (10, 11, 14) THEN make_date(2024, 1, dd) END AS VARCHAR) AS month_first FROM ck_form""", heavy=True)
def h27(t):
    return t.fx_form.select("line_no", RW.find_date(F.col("line")).alias("day_first"),
                            RW.find_date(F.col("line"), day_first=False).alias("month_first"))


@query("h28_epoch_artefact", "event_id:long, flag:string",
       """SELECT event_id, CASE WHEN event_id % 40 BETWEEN 1 AND 27 THEN CONCAT('INVALID_1900-01-', lpad(CAST(event_id % 40 + 1 AS VARCHAR), 2, '0')) END
          AS flag FROM events""")
def h28(t):
    d = F.date_add(day("1900-01-01"), (F.col("event_id") % 40).cast("int"))
    return t.events.select("event_id", D.epoch_artefact(d).alias("flag"))


@query("h34_lab_mapping", "seq:long, break_minutes:long, hours:double",
       """SELECT entry_id AS seq, CAST(break_minutes / 60.0 * 60 AS BIGINT) AS break_minutes, entered_hours AS hours
          FROM fx_entry WHERE entry_type = 'WORK'""")
def h34(t):
    lunch = t.fx_entry.withColumns({"lunch_hours": F.col("break_minutes") / 60, "seq": F.col("entry_id")})
    return NO.lab_records(lunch)


@query("b04_period_split", "submission_id:long, kept:long, outside:long, first_date:string, last_date:string",
       """SELECT submission_id, COUNT(*) FILTER (ok) AS kept, COUNT(*) FILTER (NOT ok) AS outside,
  MIN(work_date) FILTER (ok) AS first_date, MAX(work_date) FILTER (ok) AS last_date
FROM (SELECT *, work_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AS ok FROM fx_claim) q GROUP BY 1""")
def b04(t):
    return R.period_counts(t.fx_claim, day("2024-01-05"), day("2024-01-20"))


@query("b05_lenient_period_filter", "seq:long, work_date:string",
       """SELECT seq, CAST(work_date AS VARCHAR) AS work_date FROM ck_typed
          WHERE work_date IS NULL OR work_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""", heavy=True)
def b05(t):
    return R.period_split(typed(t), day("2024-01-10"), day("2024-01-20"))[0]


@query("b06_period_resolver", "o_orderkey:long, start:string, end:string",
       """SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN date_trunc('month', d) WHEN 1 THEN date_trunc('week', d)
    WHEN 2 THEN date_trunc('year', d) WHEN 3 THEN d END AS DATE) AS start,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN last_day(d) WHEN 1 THEN date_trunc('week', d) + INTERVAL 6 DAY
    WHEN 2 THEN make_date(year(d), 12, 31) WHEN 3 THEN d + INTERVAL 9 DAY END AS DATE) AS "end"
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) q""")
def b06(t):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    iso_year = F.year(F.date_add(D.iso_week(d), 3))
    week = F.concat(iso_year.cast("string"), F.lit("-W"), F.weekofyear(d).cast("string"))
    kind = F.when(k == 0, "month").when(k == 1, "week").when(k == 2, "year").when(k == 3, "custom").otherwise("all")
    value = (F.when(k == 0, F.date_format(d, "yyyy-MM")).when(k == 1, week).when(k == 2, F.date_format(d, "yyyy"))
             .when(k == 3, F.concat(d.cast("string"), F.lit(":"), F.date_add(d, 9).cast("string"))))
    rows = computed(t.orders, kind=kind, value=value)
    start, end = D.resolve_period(F.col("kind"), F.col("value"))
    return rows.select("o_orderkey", start.alias("start"), end.alias("end"))


@query("b07_ghost_rows", "seq:long, file_id:long",
       """SELECT seq, file_id FROM (SELECT *, MAX(CASE WHEN real THEN 1 ELSE 0 END) OVER d AS any_real,
    FIRST_VALUE(seq) OVER (PARTITION BY file_id, work_date ORDER BY seq) AS first_seq, COUNT(*) OVER (PARTITION BY file_id) AS n
  FROM (SELECT *, in_min IS NOT NULL OR out_min IS NOT NULL OR COALESCE(entered_hours, 0) > 0 AS real
        FROM (SELECT seq, file_id, work_date, CASE WHEN seq % 3 = 0 THEN in_min END AS in_min,
                CASE WHEN seq % 7 = 0 THEN out_min END AS out_min, CASE WHEN seq % 4 = 0 THEN entered_hours END AS entered_hours
              FROM ck_typed) z) y WINDOW d AS (PARTITION BY file_id, work_date)) x
WHERE real OR (any_real = 0 AND seq = first_seq) OR n < 3""", heavy=True)
def b07(t):
    k = F.col("seq")
    thin = typed(t).withColumns({"in_min": F.when(k % 3 == 0, F.col("in_min")),
                                 "out_min": F.when(k % 7 == 0, F.col("out_min")),
                                 "entered_hours": F.when(k % 4 == 0, F.col("entered_hours"))})
    return NO.drop_ghosts(thin)


@query("d14_completeness_score", "file_id:long, confidence:double", "SELECT file_id, confidence FROM ck_scored", heavy=True)
def d14(t):
    return NO.completeness(NO.document_facts(typed(t)))


@query("b08_status_gating", "file_id:long, status:string",
       """SELECT file_id, CASE WHEN rows >= 1 AND dated / rows >= 0.5 AND with_hours / rows >= 0.3 AND confidence >= 0.6
          THEN 'NORMALIZED' ELSE 'NEEDS_REVIEW' END AS status FROM ck_scored""", heavy=True)
def b08(t):
    return NO.gate(NO.completeness(NO.document_facts(typed(t))))


@query("e04_best_candidate", "file_id:long, candidate:long, entries:long, with_hours:long",
       """SELECT file_id, candidate, entries, with_hours FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id
    ORDER BY entries DESC, with_hours DESC, has_name DESC, candidate) AS rn
  FROM (SELECT file_id, CAST(seq % 4 AS INT) AS candidate, COUNT(*) AS entries,
          COUNT(*) FILTER (entered_hours IS NOT NULL OR (in_min IS NOT NULL AND out_min IS NOT NULL)) AS with_hours,
          MAX(CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END) AS has_name FROM ck_typed GROUP BY ALL) a) b WHERE rn = 1""", heavy=True)
def e04(t):
    hours = F.col("entered_hours").isNotNull() | (F.col("in_min").isNotNull() & F.col("out_min").isNotNull())
    cands = typed(t).groupBy("file_id", (F.col("seq") % 4).cast("int").alias("candidate")).agg(
        F.count("*").alias("entries"), F.count_if(hours).alias("with_hours"),
        F.bool_or(F.col("seq") % 5 == 0).alias("has_name"))
    return NO.best_candidate(cands)


@query("e07_outlier_dates", "submission_id:long, line_number:long, work_date:string, n:long",
       """SELECT submission_id, line_number, work_date, COUNT(*) AS n FROM (SELECT *, COUNT(*) OVER (PARTITION BY submission_id) AS c,
    (SELECT list_sort(list(work_date))[COUNT(*) // 2 + 1] FROM fx_order_entry i WHERE i.submission_id = o.submission_id) AS med
  FROM fx_order_entry o) q WHERE c < 3 OR abs(date_diff('day', med, work_date)) <= 35 GROUP BY ALL""")
def e07(t):
    kept = NO.drop_outlier_dates(t.fx_order_entry, key="submission_id")
    return kept.groupBy("submission_id", "line_number", "work_date").agg(F.count("*").alias("n"))


@query("e08_key_dedup", "file_id:long, seq:long",
       """SELECT file_id, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id, work_date, floor(in_min / 240), floor(out_min / 240)
          ORDER BY COALESCE(entered_hours, 0) DESC, seq) AS rn FROM ck_typed) q WHERE rn = 1""", heavy=True)
def e08(t):
    rows = typed(t).withColumns({"i": F.floor(F.col("in_min") / 240), "o": F.floor(F.col("out_min") / 240)})
    hours = F.coalesce("entered_hours", F.lit(0))
    return NO.larger_of_equal_keys(rows, ["file_id", "work_date", "i", "o"], hours, "seq")


@query("e09_sheet_merge", "file_id:long, seq:long, merged:long",
       """SELECT file_id, seq, CASE WHEN ok THEN 1 ELSE 0 END AS merged FROM (
  SELECT r.*, d.sheets > 1 AND d.span <= 65 AS ok, d.best,
    ROW_NUMBER() OVER (PARTITION BY r.file_id, work_date ORDER BY sheet_no, seq) AS rn
  FROM fx_sheet r JOIN (SELECT file_id, COUNT(*) AS sheets, date_diff('day', MIN(lo), MAX(hi)) AS span,
      arg_min(sheet_no, -n * 10 + sheet_no) AS best
    FROM (SELECT file_id, sheet_no, COUNT(*) AS n, MIN(work_date) AS lo, MAX(work_date) AS hi FROM fx_sheet GROUP BY 1, 2) s
    GROUP BY 1) d ON d.file_id = r.file_id) q
WHERE CASE WHEN ok THEN rn = 1 ELSE sheet_no = best END""")
def e09(t):
    return NO.merge_sheets(t.fx_sheet).withColumn("merged", F.col("merged").cast("int"))


@query("g05_ordered_distinct", "submission_id:long, entry_type:string, first_seen:long",
       "SELECT submission_id, entry_type, MIN(entry_id) AS first_seen FROM fx_entry GROUP BY 1, 2")
def g05(t):
    return ordered_distinct(t.fx_entry, ["submission_id", "entry_type"], "entry_id")


@query("g02_prioritised_union", "file_id:long, entries:long, name:string",
       """SELECT file_id, SUM(n) AS entries, arg_min(name, src) FILTER (name IS NOT NULL) AS name FROM (
  SELECT file_id, 0 AS src, COUNT(*) AS n, MAX(CASE WHEN file_id % 3 = 0 THEN NULL ELSE 'model' END) AS name
  FROM fx_raw WHERE seq % 2 = 0 GROUP BY 1
  UNION ALL SELECT file_id, 1, COUNT(*), MAX('vision') FROM fx_raw WHERE seq % 2 = 1 GROUP BY 1) u GROUP BY 1""")
def g02(t):
    model = t.fx_raw.filter("seq % 2 = 0").withColumn("name", F.when(F.col("file_id") % 3 != 0, "model"))
    return NO.prioritised_union("file_id", "name", model, t.fx_raw.filter("seq % 2 = 1").withColumn("name", F.lit("vision")))


@query("d20_engine_comparison", "model:string, score:double, best:long",
       """SELECT model, score, CASE WHEN ROW_NUMBER() OVER (ORDER BY score DESC, model) = 1 THEN 1 ELSE 0 END AS best
FROM (SELECT entry_type AS model, ROUND(COUNT(*) * 10 + COUNT(*) FILTER (entered_hours > 4) * 100.0 / COUNT(*)
   - SUM(break_minutes) / 1000.0, 2) AS score FROM fx_entry GROUP BY 1) q""")
def d20(t):
    r = t.fx_entry.groupBy(F.col("entry_type").alias("model")).agg(
        F.count("*").alias("entries"), (F.count_if(F.col("entered_hours") > 4) * 100 / F.count("*")).alias("pct"),
        (F.sum("break_minutes") / 1000).alias("seconds"))
    return CO.compare_engines(r).withColumn("best", F.col("best").cast("int"))

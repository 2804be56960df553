"""Turning extracted rows and cell grids into clean dated entries."""

from functools import reduce

from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import dates as D
from worktally.functions import patterns as RX
from worktally.functions import rows as RW
from worktally.operators.grouping import attach, computed
from worktally.operators.textdocs import upper_median
from worktally.sources.stages import staged

NUM = "decimal(10,2)"


def has_data():
    timed = F.col("in_min").isNotNull() | F.col("out_min").isNotNull()
    return timed | F.coalesce(F.col("entered_hours") > 0, F.lit(False))


def drop_ghosts(rows, key="file_id", day="work_date", seq="seq"):
    """Rows without time and hours go, unless a date has no other row: then its first one stays.

    Documents of fewer than three rows are left alone.
    """
    df = rows.withColumn("_real", has_data())
    per_day = df.groupBy(key, day).agg(F.bool_or("_real").alias("_any"), F.min(seq).alias("_first"))
    per_doc = df.groupBy(key).agg(F.count("*").alias("_n"))
    df = attach(attach(df, per_day, [key, day], null_keys=True), per_doc, [key])
    keep = F.col("_real") | (~F.col("_any") & (F.col(seq) == F.col("_first"))) | (F.col("_n") < 3)
    return df.filter(keep).drop("_real", "_any", "_first", "_n")


def drop_outlier_dates(rows, key="file_id", day="work_date", days=P.OUTLIER_DAYS):
    """Keeps rows within ``days`` of the document's upper median date; needs three rows."""
    medians = upper_median(rows, [key], day, "median_date")
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    df = attach(attach(rows, medians, [key]), counts, [key])
    near = F.abs(F.datediff(F.col(day), F.col("median_date"))) <= days
    return df.filter((F.col("_n") < 3) | F.coalesce(near, F.lit(False))).drop("_n")


def document_facts(rows, key="file_id"):
    """Per document: rows, dated rows, rows with hours, first and last date, a name."""
    timed = F.col("in_min").isNotNull() & F.col("out_min").isNotNull()
    hours = F.coalesce(F.col("entered_hours") > 0, F.lit(False)) | timed
    return rows.groupBy(key).agg(
        F.count("*").alias("rows"), F.count("work_date").alias("dated"), F.count_if(hours).alias("with_hours"),
        F.min("work_date").alias("first_date"), F.max("work_date").alias("last_date"),
        F.max("employee_id").alias("name"))


def completeness(facts):
    """Score 0 to 1: name .25, span .05 + .05, any row .25, dated share .2, hours share .2."""
    # hundredths over rows: one division, so the figure does not depend on the order of additions
    flag = lambda c, w: F.when(F.col(c).isNotNull(), w).otherwise(0)
    rows = F.col("rows")
    fixed = flag("name", 25) + flag("first_date", 5) + flag("last_date", 5) + 25
    score = F.when(rows > 0, (fixed * rows + 20 * (F.col("dated") + F.col("with_hours"))) / (100 * rows)) \
        .otherwise((fixed - 25) / 100)
    return facts.withColumn("confidence", F.round(F.least(score, F.lit(1.0)), 4))


def gate(facts):
    """NORMALIZED or NEEDS_REVIEW."""
    ok = ((F.col("rows") >= P.MIN_ENTRIES) & (F.col("dated") / F.col("rows") >= P.MIN_DATED_RATIO)
          & (F.col("with_hours") / F.col("rows") >= P.MIN_HOURS_RATIO)
          & (F.col("confidence") >= P.MIN_CONFIDENCE))
    return facts.withColumn("status", F.when(ok, "NORMALIZED").otherwise("NEEDS_REVIEW"))


def best_candidate(candidates, key="file_id"):
    """Most entries, then most with hours, then one with a name; the first wins ties."""
    rank = F.struct((-F.col("entries")).alias("a"), (-F.col("with_hours")).alias("b"),
                    (-F.col("has_name").cast("int")).alias("c"), F.col("candidate").alias("d"))
    rest = [c for c in candidates.columns if c != key]
    return candidates.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("_w")).select(key, "_w.*")


def larger_of_equal_keys(rows, keys, hours, seq):
    """One row per key: most hours, the earlier row on a tie."""
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct((-hours).alias("a"), F.col(seq).alias("b"))
    won = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_w"))
    return won.select(*keys, "_w.*")


def merge_sheets(rows, key="file_id", sheet="sheet_no", day="work_date", seq="seq"):
    """Sheets of one document merge by first-seen date when they span few days, else the largest
    sheet (the first on a tie) is taken whole."""
    sheets = rows.groupBy(key, sheet).agg(F.count("*").alias("_n"), F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    docs = sheets.groupBy(key).agg(
        F.count("*").alias("_sheets"), F.datediff(F.max("_hi"), F.min("_lo")).alias("_span"),
        F.min_by(sheet, F.struct((-F.col("_n")).alias("a"), F.col(sheet).alias("b"))).alias("_best"))
    firsts = rows.groupBy(key, day).agg(F.min_by(seq, F.struct(sheet, seq)).alias("_first"))
    df = attach(attach(rows, docs, [key]), firsts, [key, day], null_keys=True)
    merged = (F.col("_sheets") > 1) & (F.col("_span") <= P.MULTISHEET_SPAN_DAYS)
    keep = F.when(merged, F.col(seq) == F.col("_first")).otherwise(F.col(sheet) == F.col("_best"))
    return df.filter(keep).withColumn("merged", merged).drop("_sheets", "_span", "_best", "_first")


# --- cell grids: (file_id, row_no, col_no, value) ---

def cell_text(value):
    return F.trim(F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), "\n", " ")))


def header_rows(cells, depth=P.HEADER_SEARCH_ROWS):
    """First of the leading ``depth`` rows (None: of all rows) in which two or more header keywords occur."""
    # one bit per keyword: rows combine by bitwise or, without exploding or counting distinct
    text = cell_text(F.col("value"))
    bits = [F.when(text.contains(w), F.lit(1 << i)).otherwise(F.lit(0)) for i, w in enumerate(P.HEADER_KEYWORDS)]
    mask = reduce(lambda a, b: a.bitwiseOR(b), bits)
    leading = cells if depth is None else cells.filter(F.col("row_no") < depth)
    per_row = leading.groupBy("file_id", "row_no").agg(F.bit_or(mask).alias("hits"))
    return per_row.filter(F.bit_count("hits") >= 2).groupBy("file_id").agg(F.min("row_no").alias("header_row"))


def files_without_header(cells, depth=P.HEADER_SEARCH_ROWS):
    """Files in which ``header_rows`` finds nothing, so that ``grid_entries`` has no rows of them."""
    return cells.select("file_id").distinct().join(header_rows(cells, depth), "file_id", "left_anti")


def column_role(name):
    """Role of a header cell by the first rule that applies."""
    has = lambda p: name.rlike(p)
    breaks = F.lit(False)
    for w in P.BREAK_KEYWORDS:
        breaks = breaks | name.contains(w)
    # fixed values: header wordings
    return (F.when(name.isin("date", "work date", "date of work") | (has(r"\bdate\b") & ~name.contains("update")), "DATE")
            .when(name.isin("in", "time in", "clock in", "start", "start time", "in time") | has(r"\bin\b(?! out)"), "IN")
            .when(name.isin("out", "time out", "clock out", "end", "end time", "out time") | has(r"\bout\b"), "OUT")
            .when(breaks, "BREAK")
            .when(has(r"regular\s*(billable\s*)?(hrs?|hours?)") | has(r"billable\s*(hrs?|hours?)"), "HOURS")
            .when(has(r"daily\s*total|total\s*(hrs?|hours?)"), "TOTAL")
            .when(has(r"\bhrs?\b|\bhours?\b|\bworked\b"), "HOURS")
            .when(has(r"leave|type|category|sick|vacation|pto|absence|status"), "LEAVE"))


def leave_of(value, column):
    """Struct (entry_type, leave_type, hours, kind) of a leave-column cell; kind OVERRIDE sets hours,
    FILL only where none were found before."""
    low, figure = F.lower(value), F.regexp_replace(value, r"[^0-9.]", "").try_cast(NUM)
    label = lambda t, l, h, k: F.struct(F.lit(t).alias("entry_type"), l.alias("leave_type"),
                                        h.cast(NUM).alias("hours"), F.lit(k).alias("kind"))
    none = F.lit(None).cast("string")
    named = F.when(F.length(value) <= 10, F.upper(value)).otherwise(value)
    first_word = F.substring(F.upper(F.split(column, r"\s+")[0]), 1, 10)
    paid = column.rlike("vacation|pto|annual|privilege|casual|earned|flexi")
    return (F.when(low.isin(P.LEAVE_TOKENS), label("LEAVE", named, F.lit(None), "NONE"))
            .when(low.rlike(r"\bholiday\b|\bph\b|\bpublic\b"), label("HOLIDAY", none, F.lit(0), "FILL"))
            .when(column.contains("sick") & (figure > 0), label("LEAVE", F.lit("SICK"), figure, "OVERRIDE"))
            .when(~column.contains("sick") & paid & (figure > 0), label("LEAVE", first_word, figure, "OVERRIDE")))


def grid_rows(cells):
    """(file_id, row_no, cells): the cells of a row as an array in order of columns."""
    return cells.groupBy("file_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", F.coalesce("value", F.lit("")).alias("value")))).alias("cells"))


def column_roles(rows, depth=P.HEADER_SEARCH_ROWS):
    """(file_id, header_row, roles): of the first of the leading ``depth`` rows (None: of all) with two or more header keywords,
    the columns that have a role, as an array of (col_no, column, role)."""
    leading = rows if depth is None else rows.filter(F.col("row_no") < depth)
    # a row's texts as one, cells apart by a mark that is in no keyword: each keyword is looked for once a row
    text = F.lower(F.regexp_replace(F.array_join(F.transform("cells", lambda c: c["value"]), "\u0001"), "\n", " "))
    hits = reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in P.HEADER_KEYWORDS])
    heads = leading.filter(hits >= 2).groupBy("file_id").agg(F.min(F.struct("row_no", "cells")).alias("h"))
    named = F.transform("h.cells", lambda c: F.struct(c["col_no"].alias("col_no"), cell_text(c["value"]).alias("column")))
    roles = F.filter(F.transform(named, lambda c: F.struct(c["col_no"].alias("col_no"), c["column"].alias("column"), column_role(c["column"]).alias("role"))),
                     lambda c: c["role"].isNotNull())
    return heads.select("file_id", F.col("h.row_no").alias("header_row"), roles.alias("roles"))


def grid_entries(cells, depth=P.HEADER_SEARCH_ROWS):
    """Cells below the header row to one entry per dated row.

    Date, in and out: first usable column. Break: last. Hours: a total or leave figure overrides,
    the last one wins; other hour columns fill in only when nothing was found before. Files whose
    leading ``depth`` rows hold no header have no entries: see ``files_without_header``.

    A file's roles are found once, over rows as arrays, and applied to each row inside it: cells are neither exploded
    nor joined. Rows are written first, as the header and the rows below it both read them.
    """
    rows = staged(grid_rows(cells), "grid")
    data = rows.join(column_roles(rows, depth), "file_id").filter("row_no > header_row")
    role_of = lambda c: F.get(F.filter("roles", lambda r: r["col_no"] == c["col_no"]), F.lit(0))
    known = F.transform("cells", lambda c: F.struct(F.trim(c["value"]).alias("value"), role_of(c).alias("r")))
    known = F.filter(known, lambda c: c["r"].isNotNull() & ~F.lower(c["value"]).isin("nan", "none", "", "-", "n/a"))
    return row_entries(data.select("file_id", "row_no", known.alias("known")))


def row_entries(data):
    """(file_id, row_no, known): known cells in order of columns, each (value, (col_no, column, role)), to entries."""
    marked = lambda c: c["value"].startswith("INVALID_")
    clock = lambda c: c["value"].rlike(r"\d+:\d+")
    figure = lambda c: F.regexp_replace(c["value"], r"[^0-9.]", "").try_cast(NUM)
    of = lambda name, *more: F.filter("known", lambda c: reduce(lambda a, b: a & b(c), more, (c["r"]["role"] == name) & ~marked(c)))
    found = lambda cells, make: F.filter(F.transform(cells, make), lambda x: x.isNotNull())
    first, last = lambda xs: F.get(xs, F.lit(0)), lambda xs: F.try_element_at(xs, F.lit(-1))
    data = computed(data, leaves=found(of("LEAVE"), lambda c: leave_of(c["value"], c["r"]["column"])))
    hour = F.filter("known", lambda c: c["r"]["role"].isin("HOURS", "TOTAL", "LEAVE") & ~marked(c))
    leave = lambda c, kind: F.when(c["r"]["role"] == "LEAVE", kind(leave_of(c["value"], c["r"]["column"])))
    fill = lambda c: (F.when((c["r"]["role"] == "HOURS") & (figure(c) > 0), figure(c))
                      .otherwise(leave(c, lambda v: F.when(v["kind"] == "FILL", v["hours"]))))
    over = lambda c: (F.when((c["r"]["role"] == "TOTAL") & (figure(c) >= 0), figure(c))
                      .otherwise(leave(c, lambda v: F.when(v["kind"] == "OVERRIDE", v["hours"]))))
    bad = last(F.transform(F.filter("known", lambda c: (c["r"]["role"] == "DATE") & marked(c)), lambda c: c["value"]))
    out = computed(
        data, _date=first(found(of("DATE"), lambda c: D.parse_date(c["value"]))), _bad=bad,
        in_min=first(found(of("IN", clock), lambda c: D.parse_work_minutes(c["value"]))),
        out_min=first(found(of("OUT", clock), lambda c: D.parse_work_minutes(c["value"]))),
        break_minutes=F.coalesce(last(found(of("BREAK"), lambda c: D.break_minutes(c["value"]))), F.lit(0)),
        hours=F.coalesce(last(found(hour, over)), first(found(hour, fill))),
        entry_type=F.coalesce(last(F.transform("leaves", lambda v: v["entry_type"])), F.lit("WORK")),
        leave_type=last(F.transform(F.filter("leaves", lambda v: v["entry_type"] == "LEAVE"), lambda v: v["leave_type"])))
    text = F.coalesce(F.col("_bad"), F.col("_date").cast("string"))
    return out.withColumn("work_date", text).filter("work_date IS NOT NULL").drop("_date", "_bad", "known", "leaves")


# --- filled-in sheets as lines ---

def first_label(lines, field):
    """Value of a label on the first line that has one."""
    found = lines.select("doc_id", "line_no", RW.label_value(F.col("line"), field).alias("value"))
    return found.groupBy("doc_id").agg(
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("line_no"))).alias(field))


def form_header(lines):
    """Labels, approval word, period and stated totals per document, in one pass."""
    line = F.col("line")
    picks = {f: RW.label_value(line, f) for f in RX.LABELS}
    picks["approval"] = F.lower(F.nullif(F.regexp_extract(line, RX.APPROVAL_WORD, 1), F.lit("")))
    picks["submitted"] = RW.stated_total(line, RX.SUBMITTED_TOTAL)
    picks["total"] = RW.stated_total(line, RX.TOTAL)
    picks["approved"] = RW.stated_total(line, RX.APPROVED_TOTAL)
    per_line = lines.select("doc_id", "line_no", *[c.alias(n) for n, c in picks.items()])
    first = lambda n: F.min_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n)
    out = per_line.groupBy("doc_id").agg(*[first(n) for n in picks])
    return out.withColumn("submitted", F.coalesce("submitted", "total")).drop("total")


def form_period(lines):
    """Period per document: any explicit range beats any month, which beats any week."""
    p = computed(lines, p=RW.find_period(F.col("line"))).filter("p IS NOT NULL")
    rank = F.when(F.col("p.kind") == "RANGE", 0).when(F.col("p.kind") == "MONTH", 1).otherwise(2)
    best = p.groupBy("doc_id").agg(F.min_by("p", F.struct(rank.alias("r"), F.col("line_no").alias("l"))).alias("p"))
    return best.select("doc_id", "p.*")


def form_rows(lines):
    """Rows that hold a date and hours."""
    rows = computed(lines, r=RW.extract_row(F.col("line")))
    return rows.filter("r.work_date IS NOT NULL AND r.total IS NOT NULL").select("doc_id", "line_no", "r.*")


def judged_rows(lines):
    """Rows with their reject reason against the document's period."""
    period = form_period(lines).select("doc_id", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    rows = form_rows(lines).join(period, "doc_id", "left")
    return rows.withColumn("reason", RW.reject_reason(
        F.col("total"), F.col("work_date"), F.col("p_start"), F.col("p_end")))


def totals_check(lines):
    """Accepted hours against the submitted total, per document."""
    accepted = judged_rows(lines).groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("total"))), F.lit(0)).alias("calculated"),
        F.count("reason").alias("rejected"), F.count_if(F.col("reason").isNull()).alias("accepted"))
    out = accepted.join(form_header(lines).select("doc_id", "submitted", "approved"), "doc_id", "left")
    gap = F.abs(F.col("calculated") - F.col("submitted")) > F.lit(P.TOTAL_TOLERANCE).cast("decimal(4,2)")
    return out.withColumn("differs", F.coalesce(gap & (F.col("accepted") > 0), F.lit(False)))


def name_from_lines(lines):
    """Person named in the text: a label, else a signature on the same line. Words after a label count whatever they are, as
    the running rules have it: ``Employee signature`` names ``signature``."""
    line = F.col("line")
    nonempty = lambda c: F.nullif(F.trim(c), F.lit(""))
    label = nonempty(F.regexp_extract(line, RX.TEXT_LABEL, 1))
    signature = nonempty(F.regexp_extract(line, RX.TEXT_SIGNATURE, 1))
    per_line = lines.select("doc_id", "line_no", label.alias("label"), signature.alias("signature"))
    first = lambda n: F.min_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("line_no")))
    out = per_line.groupBy("doc_id").agg(first("label").alias("label"), first("signature").alias("signature"))
    return out.select("doc_id", F.coalesce("label", "signature").alias("name"))


def name_from_header(rows, depth=P.HEADER_SEARCH_ROWS):
    """(file_id, name): the person named in the rows above the column headers, for every file with headers.

    The first row with a label and a name that holds no word of an address, company or form; else the first row whose last
    filled cell is a name of two or three capitalised words. ``rows`` is a table as ``grid_rows`` makes it.
    """
    heads = column_roles(rows, depth).select("file_id", "header_row")
    above = rows.join(heads, "file_id").filter("row_no < header_row")
    cells = F.filter(F.transform("cells", lambda c: F.trim(c["value"])), lambda x: x != "")
    strange = lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(w) for w in [*P.NOT_A_PERSON, *sorted(P.COMPANY_STOPWORDS)]])
    above = computed(above, filled=cells)
    above = computed(above, label=F.trim(F.regexp_extract(F.array_join("filled", " "), RX.HEADER_LABEL, 1)), last=F.try_element_at("filled", F.lit(-1)))
    label = F.when((F.col("label") != "") & ~strange(F.col("label")), F.col("label"))
    alone = F.when(F.col("last").rlike(RX.HEADER_NAME) & ~F.col("last").rlike(RX.NOT_A_NAME_CELL) & ~strange(F.col("last")), F.col("last"))
    found = above.select("file_id", "row_no", label.alias("label"), alone.alias("alone"))
    first = lambda n: F.min_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("row_no")))
    best = found.groupBy("file_id").agg(F.coalesce(first("label"), first("alone")).alias("name"))
    return heads.select("file_id").join(best, "file_id", "left")


def prioritised_union(key, name, *sources):
    """Rows of several sources counted per key, with the name from the first source that has one."""
    tagged = [s.select(key, name).withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    return both.groupBy(key).agg(F.count("*").alias("entries"), F.min_by(name, F.when(F.col(name).isNotNull(), F.col("_src"))).alias(name))


def lab_records(rows, lunch="lunch_hours", hours="entered_hours"):
    """Worked rows of a lab export: the lunch in hours becomes a break in whole minutes."""
    return rows.filter(F.col("entry_type") == "WORK").withColumns({"break_minutes": F.round(F.col(lunch) * 60).cast("int"), "hours": F.col(hours)})

"""Document text: pipe tables, source-row profile, blocks, merged parts, token rows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import dates as D
from worktally.functions import patterns as RX
from worktally.functions.names import bind
from worktally.operators.grouping import attach, totals_before
from worktally.session import by_value


def pipe_tables(docs, text="text"):
    """Rows of pipe tables in a text cell: (doc_id, table_no, row_no, cells).

    Works inside the row with array functions: no explode of lines, no shuffle.
    """
    def is_row(line):
        s = F.trim(line)
        return s.startswith("|") & (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2)

    def cells(line):
        inner = F.regexp_replace(F.trim(line), r"^\|+|\|+$", "")
        return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))

    def blocks(x):
        def at(i):
            return F.coalesce(F.get(x.hit, i - 1), F.lit(False))

        spots = F.sequence(F.lit(1), F.size(x.hit))
        begins = F.filter(spots, lambda i: at(i) & ~at(i - 1))
        ends = F.filter(spots, lambda i: at(i) & ~at(i + 1))
        return F.zip_with(begins, ends, lambda a, z: F.slice(x.line, a, z - a + 1))

    def table(lines):
        rows = F.transform(lines, cells)
        return F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike(r"^[-: ]+$")))

    lines = F.split(F.col(text), "\n")
    pack = bind(lines, lambda a: F.struct(a.alias("line"), F.transform(a, is_row).alias("hit")))
    tables = F.transform(bind(pack, blocks), table)
    tables = F.filter(tables, lambda t: F.size(t) >= 2)
    out = docs.select("doc_id", F.posexplode(tables).alias("table_no", "rows"))
    return out.select("doc_id", (F.col("table_no") + 1).alias("table_no"),
                      F.posexplode("rows").alias("row_no", "cells"))


def line_dates(line):
    """Every date written in a line, parsed; unknown layouts give NULL elements."""
    found = F.regexp_extract_all(line, F.lit(f"({RX.LINE_DATE})"), F.lit(1))
    return F.transform(found, lambda s: F.coalesce(
        D.year_first_date(s), D.numeric_date(s, False), D.named_date(s)))


def source_profile(lines):
    """Per document: candidate rows, section headers, dates written and their range."""
    s = F.trim("line")
    dated = s.rlike(RX.LINE_DATE)
    number = s.rlike(RX.LINE_NUMBER)
    row = dated | (s.rlike(RX.LINE_WEEKDAY) & number) | (s.rlike(RX.LINE_TIME) & number)
    marked = lines.select("doc_id", row.alias("row"), s.rlike(RX.SECTION).alias("section"),
                          line_dates(s).alias("dates"))
    return marked.groupBy("doc_id").agg(
        F.count_if("row").alias("candidate_rows"), F.count_if("section").alias("sections"),
        F.sum(F.when(F.col("row"), F.size("dates")).otherwise(0)).alias("date_count"),
        F.min(F.array_min("dates")).alias("first_date"), F.max(F.array_max("dates")).alias("last_date"))


def lines_of(docs, text="text"):
    """Text cells to lines, with every page-break mark on a line of its own."""
    apart = F.regexp_replace(F.col(text), f"({RX.PAGE_BREAK})", "\n$1\n")
    return docs.select("doc_id", F.posexplode(F.split(apart, "\n")).alias("line_no", "line"))


def segment_lines(lines):
    """Lines with their block: pages of over 50 characters if there are two or more, else sections
    if there are two or more, else every 60 non-blank lines. Lines outside any block drop out.

    Running totals are two-level, so one document may hold any share of the lines.
    """
    s = F.trim("line")
    df = lines.withColumns({"_break": s.rlike(RX.PAGE_BREAK).cast("int"),
                            "_section": s.rlike(RX.SECTION).cast("int"),
                            "_solid": (s != "").cast("int")})
    df = totals_before(df, ["doc_id"], "line_no", _page="_break", _sect="_section", _rank="_solid")
    df = df.withColumns({"_page": F.col("_page") + F.col("_break"),
                         "_sect": F.col("_sect") + F.col("_section")})
    inner = (F.col("_solid") == 1) & (F.col("_break") == 0)
    ends = df.groupBy("doc_id", "_page").agg(
        F.min(F.when(inner, F.col("line_no"))).alias("_from"),
        F.max(F.when(inner, F.col("line_no"))).alias("_to"))
    df = attach(df, ends, ["doc_id", "_page"])
    length = F.when(F.col("line_no").between(F.col("_from"), F.col("_to")) & (F.col("_break") == 0),
                    F.when(F.col("line_no") == F.col("_from"), F.length(F.ltrim("line")))
                    .when(F.col("line_no") == F.col("_to"), F.length(F.rtrim("line")))
                    .otherwise(F.length("line")) + 1)
    pages = df.groupBy("doc_id", "_page").agg((F.sum(length) - 1).alias("_chars"))
    df = attach(df, pages, ["doc_id", "_page"])
    # one row per page and one flag per section line: partial sums, then one row per document
    docs = pages.groupBy("doc_id").agg(F.count_if(F.col("_chars") > 50).alias("_pages"))
    sections = df.groupBy("doc_id").agg(F.sum("_section").alias("_sections"))
    df = attach(attach(df, docs, ["doc_id"]), sections, ["doc_id"])
    rule = F.when(F.col("_pages") > 1, "PAGE_BREAK").when(F.col("_sections") > 1, "SECTION").otherwise("LINE_COUNT")
    df = df.withColumn("rule", rule)
    block = (F.when(F.col("rule") == "PAGE_BREAK",
                    F.when((F.col("_chars") > 50) & (F.col("_break") == 0), F.col("_page")))
             .when(F.col("rule") == "SECTION", F.when(F.col("_sect") > 0, F.col("_sect")))
             .otherwise(F.floor(F.col("_rank") / P.BLOCK_LINES)))
    return df.select("doc_id", "line_no", "line", "rule", block.cast("long").alias("block_no"),
                     (F.col("_solid") == 1).alias("solid")).filter("block_no IS NOT NULL")


def block_summary(segmented):
    """Extent of every block that holds text."""
    return segmented.groupBy("doc_id", "block_no", "rule").agg(
        F.min(F.when(F.col("solid"), F.col("line_no"))).alias("first_line"),
        F.max(F.when(F.col("solid"), F.col("line_no"))).alias("last_line"),
        F.count_if("solid").alias("lines")).filter("lines > 0")


def best_engine(results):
    """Highest score per document; the first engine wins ties; documents without text drop out."""
    best = results.groupBy("doc_id").agg(
        F.min_by(F.struct("engine", "score", "has_text"),
                 F.struct((-F.col("score")).alias("s"), F.col("engine_rank").alias("r"))).alias("_b"))
    return best.select("doc_id", "_b.*").filter("has_text").drop("has_text")


def merge_parts(parts, separator):
    """Text parts in order, tables counted, mean confidence (missing counts as 0).

    Parts are joined in runs first, so no single task sorts a long document's parts at once.
    """
    ordered = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        F.col("text") != "", F.struct("pos", "text")))), lambda s: s.text), separator)
    runs = parts.withColumn("_run", F.floor(F.col("pos") / 4096)).groupBy("doc_id", "_run").agg(
        ordered().alias("text"), F.sum("tables").alias("tables"), F.count("*").alias("parts"),
        F.sum(F.coalesce("confidence", F.lit(0))).alias("_conf")).withColumn("pos", F.col("_run"))
    return runs.groupBy("doc_id").agg(
        ordered().alias("text"), F.sum("tables").alias("tables"), F.sum("parts").alias("parts"),
        (F.sum("_conf") / F.sum("parts")).alias("confidence"))


def upper_median(df, keys, value, name):
    """``sorted[n div 2]`` per group from counts per distinct value (never the raw group)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    up_to = w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumns({"_c": F.sum("_n").over(up_to), "_t": F.sum("_n").over(w)})
    reached = F.col("_c") >= F.floor(F.col("_t") / 2) + 1
    return counts.filter(reached).groupBy(*keys).agg(F.min(value).alias(name))


def cluster_rows(tokens):
    """Positioned tokens to text rows: (page_id, row_no within segment, token_id).

    A token joins the first row whose seed centre is near enough, in (y, x) order. Pages are cut
    where no later token can reach an earlier seed (top edge below every earlier centre plus the
    tolerance); that is decided on one-unit bands, so only a run of touching bands goes to one
    grouped-map call.
    """
    heights = upper_median(tokens.filter("h > 0"), ["page_id"], "h", "_med")
    df = attach(tokens, heights, ["page_id"])
    df = df.withColumn("tol", F.greatest(F.coalesce("_med", F.lit(12.0)) * 0.6, F.lit(4.0))).drop("_med")
    df = df.withColumns({"cy": F.col("y") + F.col("h") / 2, "_band": F.floor("y")})
    bands = df.groupBy("page_id", "_band").agg(
        F.min("y").alias("_top"), F.max("cy").alias("_low"), F.max("tol").alias("_tol"))
    w = W.partitionBy("page_id").orderBy("_band")
    prev = F.max("_low").over(w.rowsBetween(W.unboundedPreceding, -1))
    bands = bands.withColumn("_cut", F.coalesce((F.col("_top") > prev + F.col("_tol")), F.lit(False)).cast("int"))
    bands = bands.withColumn("segment", F.sum("_cut").over(w)).select("page_id", "_band", "segment")
    df = attach(df, bands, ["page_id", "_band"])
    cols = ["page_id", "segment", "token_id", "x", "y", "cy", "tol"]
    # neighbouring segments share a call, which keeps the number of calls low
    return df.select(*cols).groupBy("page_id", F.floor(F.col("segment") / 256)).applyInPandas(
        _cluster, "page_id long, segment long, row_no long, token_id long, x double")


def _cluster(pdf):
    pdf = pdf.sort_values(["segment", "y", "x", "token_id"], kind="stable")
    seeds, labels, current = [], [], None
    for segment, cy, tol in zip(pdf["segment"], pdf["cy"], pdf["tol"]):
        if segment != current:
            seeds, current = [], segment
        row = next((i for i, s in enumerate(seeds) if abs(cy - s) <= tol), None)
        if row is None:
            seeds.append(cy)
            row = len(seeds) - 1
        labels.append(row)
    return pdf.assign(row_no=labels)[["page_id", "segment", "row_no", "token_id", "x"]]


by_value(__name__)

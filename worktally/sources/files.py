"""File sources: recursive inventory and delimited text of unknown delimiter."""

from pyspark.sql import functions as F

from worktally.operators.files import base_name, extension, folder


def inventory(spark, root):
    """One row per visible file below ``root``; contents are not read.

    Hidden files, hidden folders and ``__MACOSX`` are left out.
    """
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", F.col("length").alias("size_bytes")))
    base = F.lit(root.rstrip("/") + "/")
    rel = F.regexp_replace(F.split_part(F.col("path"), base, F.lit(-1)), "^/+", "")
    out = found.withColumn("rel_path", rel)
    hidden = F.exists(F.split("rel_path", "/"),
                      lambda p: p.startswith(".") | (F.lower(p) == "__macosx"))
    return out.filter(~hidden).select(
        "rel_path", folder(F.col("rel_path")).alias("folder_path"),
        base_name(F.col("rel_path")).alias("file_name"),
        extension(base_name(F.col("rel_path"))).alias("file_ext"), "size_bytes")


# Delimiters tried, in order of preference.
DELIMITERS = [",", ";", "\t", "|"]


def _cells(line, delimiter):
    """Delimiters outside quoted cells; ``line`` must be without its quoted parts."""
    return F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))


def file_layouts(lines):
    """(file, utf8, sep, width) per file of ``lines`` (file, value): how to read it, judged by all its lines.

    The delimiter is the one whose most frequent number per line (zero apart) covers most lines, the width one cell more;
    comma and one cell where none occurs. Undecodable UTF-8 anywhere makes the whole file Latin-1.
    """
    bare = F.regexp_replace(_latin("value"), '"[^"]*"', "")
    counts = lines.select("file", F.is_valid_utf8("value").alias("ok"), bare.alias("bare")).groupBy(
        "file", *[_cells(F.col("bare"), d).alias(f"n{i}") for i, d in enumerate(DELIMITERS)]).agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and("ok").alias("ok"))
    each = counts.select("file", "rows", "ok", F.posexplode(F.array(*[F.col(f"n{i}") for i in range(len(DELIMITERS))])).alias("d", "n"))
    each = each.groupBy("file", "d", "n").agg(F.sum("rows").alias("rows"), F.bool_and("ok").alias("ok"))
    rank = F.struct((F.col("n") > 0).alias("found"), F.when(F.col("n") > 0, F.col("rows")).alias("rows"), (-F.col("d")).alias("d"), F.col("n"))
    best = each.groupBy("file").agg(F.bool_and("ok").alias("utf8"), F.max(rank).alias("b"))
    sep = F.get(F.array(*[F.lit(d) for d in DELIMITERS]), F.when(F.col("b.found"), -F.col("b.d")).otherwise(0))
    return best.select("file", "utf8", sep.alias("sep"), F.when(F.col("b.found"), F.col("b.n") + 1).otherwise(1).alias("width"))


def _latin(value):
    return F.decode(F.col(value).cast("binary"), "ISO-8859-1")


def read_delimited(spark, path, columns=None):
    """(rows, lost): all-string cells without a header, blanks kept as ``""``, blank rows dropped.

    Encoding, delimiter and width are those of each file (``file_layouts``); given ``columns`` set the width. Short rows are
    filled with blanks, and so are files narrower than the widest. ``lost`` is a one-row frame counting lines with too many cells.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    layouts = file_layouts(lines)
    width = len(columns) if columns else layouts.agg(F.max("width")).first()[0] or 1
    names = columns or [f"c{i}" for i in range(width)]
    limit = F.lit(len(columns)) if columns else F.col("width")
    text = F.regexp_replace(F.when(F.col("utf8"), F.col("value")).otherwise(_latin("value")), "^\\uFEFF", "")
    rows = lines.join(layouts, "file").select("sep", limit.alias("limit"), text.alias("text"))
    bare = F.regexp_replace("text", '"[^"]*"', "")
    n = F.coalesce(*[F.when(F.col("sep") == d, _cells(bare, d)) for d in DELIMITERS]) + 1
    rows = rows.withColumn("n", n)
    lost = rows.agg(F.count_if(F.col("n") > F.col("limit")).alias("lost_rows"))
    full = rows.filter("n <= limit").withColumn("text", F.concat("text", F.expr(f"repeat(sep, {width} - n)")))
    schema = ", ".join(f"`{c}` string" for c in names)
    parsed = [F.when(F.col("sep") == d, F.from_csv("text", schema, {"sep": d, "escape": '"'})) for d in DELIMITERS]
    out = full.select(F.coalesce(*parsed).alias("r")).select("r.*").na.drop("all").na.fill("")
    return out.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in names]), lost

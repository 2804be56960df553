"""Deletes runs of lines that stood earlier, in this or another document, by winnowing.

Lines without a word are set aside. From each line on, a *window* is the fewest lines that hold ``min_words`` words; its
least line hash is its fingerprint. Documents that share a run of that many words share the run's windows, so their
fingerprints are guaranteed to agree. Windows whose fingerprint stands nowhere else drop out; the positions of the rest
are joined on the content of the window with the earliest one, and each match marks its lines. What stood earlier stays,
later repeats go.

Matches are extended both ways. Windows that look ahead miss the last lines of a run, up to ``min_words`` - 1 words, as a
window from there reaches into the text after the run. So each line also ends a window, the fewest lines back from it that
hold ``min_words`` words. A line of a run lies in the window from the run's first line, or has that many words of the run
before it and ends a window inside the run: both kinds together cover exactly the runs. A window that is least both ways
is taken once.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

SALTS = 16  # a hot fingerprint or run is dealt to so many tasks
_NAME = "worktally line dedup "  # begins the names of own columns beside those of the caller


def _key(id_col, text_col):
    """Id and text hash name a row: repeated rows of one document share a name."""
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))


def _salted(facts):
    """``facts`` for every salt."""
    return facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def repeated_lines(docs, id_col="doc_id", text_col="text", min_words=50):
    """(doc, gone): the numbers (from 0) of the lines to delete, as runs, for the documents that have some."""
    rows = docs.select(_key(id_col, text_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = rows.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # words: runs of characters other than the blanks 0x20 and 0x09-0x0D
    words = F.regexp_count("line", F.lit("[^\\x20\\x09-\\x0D]+"))
    lines = lines.select("doc", "pos", F.xxhash64("line").alias("h"), words.alias("n")).where("n > 0")
    lines = lines.repartition("doc").dropDuplicates(["doc", "pos"])  # one shuffle, which every use below reads again
    order = Window.partitionBy("doc").orderBy("pos")
    lines = lines.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    ahead = Window.partitionBy("doc").orderBy("before").rangeBetween(Window.currentRow, min_words - 1)
    back = Window.partitionBy("doc").orderBy(F.col("before") + F.col("n")).rangeBetween(1 - min_words, Window.currentRow)
    windows = lines.select("doc", "pos", F.collect_list("h").over(ahead).alias("hs"), F.sum("n").over(ahead).alias("words"), F.max("pos").over(ahead).alias("end")).where(F.col("words") >= min_words)
    # a window back that falls short without its last line is also one ahead
    more = lines.select("doc", F.min("pos").over(back).alias("pos"), F.collect_list("h").over(back).alias("hs"), F.sum("n").over(back).alias("words"), F.col("pos").alias("end"), "n")
    windows = windows.union(more.where(F.col("words") - F.col("n") >= min_words).drop("n"))
    salt = F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS)).cast("int").alias("salt")
    windows = windows.select("doc", "pos", "end", salt, F.array_min("hs").alias("mark"), F.struct(F.xxhash64("hs").alias("a"), F.xxhash64(F.lit(1), "hs").alias("b")).alias("run"))
    # fingerprints that stand at one place only cannot repeat
    many = windows.groupBy("mark").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mark")
    left = windows.join(_salted(many), ["mark", "salt"])
    first = left.groupBy("run").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    later = left.join(_salted(first), ["run", "salt"]).where(F.struct("doc", "pos") > F.col("first")).select("doc", "pos", "end")
    # matches that overlap become runs of lines
    order = Window.partitionBy("doc").orderBy("pos", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = later.withColumn("new", F.when(F.col("pos") <= upto, 0).otherwise(1))
    run = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = new.withColumn("run", run).groupBy("doc", "run").agg(F.min("pos").alias("a"), F.max("end").alias("b"))
    return runs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gone"))


def dedup_lines(docs, id_col="doc_id", text_col="text", min_words=50):
    """The columns of ``docs`` with the text shortened, and n_lines, n_removed and words_removed.

    A line goes if it lies in a run of lines with ``min_words`` words or more that also stands earlier: in a document of
    smaller id or further up in the same text. Lines are compared exactly (by a 64-bit hash); wordless lines count for
    nothing, and go when they stand between deleted lines of one run. Rows of one id are ordered by the hash of their
    text, equal rows are one document and are returned as often as they occur; a null id comes after all others. Null
    texts stay null; a text of which nothing is left is empty. Columns named as the three added ones are replaced; all
    other columns are kept, whatever their names.
    """
    added = ["n_lines", "n_removed", "words_removed"]
    named = [c for c in docs.columns if c not in added]
    doc, cuts = _NAME + "doc", _NAME + "gone"
    gone = repeated_lines(docs, id_col, text_col, min_words).withColumnsRenamed({"doc": doc, "gone": cuts})
    out = docs.select(*[F.col(f"`{c}`") for c in named], _key(id_col, text_col).alias(doc)).join(gone, doc, "left")
    runs = F.col(f"`{cuts}`")
    lines = F.split(F.col(text_col), "\n")
    inside = lambda i: F.exists(runs, lambda g: (g["a"] <= i) & (i <= g["b"]))
    kept = F.array_join(F.filter(lines, lambda x, i: ~inside(i)), "\n")
    cut = F.array_join(F.filter(lines, lambda x, i: inside(i)), "\n")
    removed = F.coalesce(F.aggregate(runs, F.lit(0), lambda s, g: s + g["b"] - g["a"] + 1), F.lit(0))
    text = F.when(runs.isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"`{c}`") for c in named],
                      F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), removed.alias("n_removed"),
                      F.when(runs.isNull(), 0).otherwise(F.regexp_count(cut, F.lit("[^\\x20\\x09-\\x0D]+"))).alias("words_removed"))

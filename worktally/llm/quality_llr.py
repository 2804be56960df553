"""Quality rules, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed to ``BUCKETS`` counters; two multinomials with add-one smoothing, one over the trusted
texts and one over all texts, give each bucket a weight ln(p_target / p_raw). A text's ratio is the sum of the weights of
its n-grams over their number. Weights are rounded to whole millionths, so sums do not depend on order and the threshold
decides every document the same way on every run. The weights are ``BUCKETS`` numbers whatever the corpus, so they are
fetched once and sent along as a constant. Everything else are built-in functions inside the row: a text is only shuffled
to meet its label.
"""

from pyspark.sql import functions as F

from worktally.operators.grouping import computed

BUCKETS = 1 << 14
SCALE = 1_000_000
BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def _words(text):
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _features(h):
    """Buckets of the words and of the pairs of neighbours, from the word hashes in column ``h``."""
    m = F.lit(BUCKETS)
    single = F.transform(h, lambda x: F.pmod(x, m))
    pairs = F.transform(F.slice(F.col(h), F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(F.col(h), i), x), m))
    return single, pairs


def weights(docs, trusted, id_col="doc_id", text_col="text"):
    """List of ``BUCKETS`` weights in millionths. ``trusted`` is a DataFrame with the ids of the target; ids it repeats count once."""
    marks = trusted.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(True))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(marks.hint("merge"), "_id", "left")  # by a shuffle at every size
    rows = computed(rows.select(F.coalesce("_trusted", F.lit(False)).alias("t"), F.transform(_words("_text"), lambda w: F.xxhash64(w)).alias("w")), h=F.col("w"))
    single, pairs = _features("h")
    counts = rows.select("t", F.explode(F.concat(single, pairs)).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("raw"), F.count_if("t").alias("target")).collect()
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.f], target[r.f] = r.raw, r.target
    if not sum(target):
        return [0] * BUCKETS
    from math import log
    scale = log((sum(raw) + BUCKETS) / (sum(target) + BUCKETS))
    return [round(SCALE * (log((t + 1) / (n + 1)) + scale)) for t, n in zip(target, raw, strict=True)]


def judge(docs, weight, threshold, text_col="text"):
    """The columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    Words are runs of characters other than 0x20 and 0x09-0x0D; lines are what lies between line feeds. base_failed:
    fewer than 20 words, or over 30 % of words in windows of eight words that the text holds twice or more (the first
    included). kept: not base_failed and llr at least ``threshold``. llr is 0 without words; a null text has none.
    Columns of the result's names are replaced. Repeated rows are judged alike.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    named = [c for c in docs.columns if c not in added]
    rows = docs.select(*named, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = computed(rows, _words=_words("_text"))
    rows = computed(rows, _h=F.transform("_words", lambda w: F.xxhash64(w)),
                    word_chars=F.aggregate("_words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)))
    h = F.col("_h")
    n = F.size("_h")
    runs = F.transform(F.slice(h, F.lit(1), F.greatest(n - 7, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 8)]))
    table = F.split(F.lit(",".join(map(str, weight))), ",").cast("array<long>")
    single, pairs = _features("_h")
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, f: s + F.get(table, f.cast("int")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = computed(rows, _runs=runs, _sum=add(single) + add(pairs), _lines=lines)
    # windows in order of hash: those with an equal neighbour occur twice or more; then the words they cover
    s = F.array_sort(F.transform("_runs", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), s))
    rows = computed(rows, _order=F.col("_sorted"))
    o = F.col("_order")
    starts = F.array_sort(F.transform(F.filter(o, lambda x, k: (F.get(o, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(o, k - 1)["h"] == x["h"]))), lambda x: x["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                          lambda a, i: F.struct((a["n"] + i + 8 - F.greatest(i, a["end"])).alias("n"), (i + 8).alias("end")), lambda a: a["n"])
    grams = 2 * n - 1
    rows = computed(rows, n_words=n.cast("long"), n_symbols=F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
                    n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                    n_repeat_words=F.when(o.isNull(), F.lit(0)).otherwise(covered).cast("long"),
                    llr=F.when(n > 0, F.col("_sum") / grams / SCALE).otherwise(F.lit(0.0)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return rows.select(*named, *added)

"""Resamples a corpus towards a target distribution by hashed n-gram importance weights.

Features are runs of up to ``max_n`` words, hashed to buckets by CRC. How often the corpus and the target use a bucket gives
the bucket's gain, a scaled log ratio in whole numbers; a text's weight is the floored mean of its features' gains, and the
texts of highest weight plus seeded Gumbel noise are drawn: sampling without replacement in proportion to weight.

Texts become features with Arrow kernels, a batch at a time: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode`` turn words into numbers; shifted copies of the numbers are the n-grams, of which only the distinct
pairs (shorter run, next word) are hashed, each going on from the CRC of the shorter run; a ``take`` of gains and a sum per
segment give the weights. Two passes read the texts: one counts buckets (a task sends at most one row per bucket), one
weighs. The second writes five numbers a text; only these are ranked.

Ranks need no global sort. Scores are whole numbers in a bounded range (see ``draw``), so rows per score are counted first;
a row's rank is the number of rows with a higher score, plus its place among rows of its own score, which is found by
two-level running counts.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from worktally.llm import blocks as B
from worktally.operators.grouping import totals_before
from worktally.session import shared_folder

BUCKETS = 10_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what lies between words, after A-Z are lower-cased


def _features(texts, max_n, buckets):
    """(bucket of each feature, row of each feature, words of each row) of an array of texts."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BREAK)
    flat, row = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists))
    full = pc.greater(pc.binary_length(flat), 0)
    row = row[np.asarray(full.to_numpy(zero_copy_only=False), bool)]
    coded = pc.dictionary_encode(pc.filter(flat, full))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    word = np.asarray(coded.indices).astype(np.int64)
    spelled = [x.encode() for x in coded.dictionary.to_pylist()]
    n_words = np.bincount(row, minlength=len(texts))
    crc = np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled))
    spaced = [b" " + x for x in spelled] if max_n > 1 else []
    run, at, out, rows = word, np.arange(len(word)), [crc[word] % buckets], [row]
    for n in range(2, max_n + 1):
        last = at + n - 1
        on = last < len(word)
        on[on] = row[last[on]] == row[at[on]]
        at, run = at[on], run[on]
        pairs, run = np.unique(run * max(1, len(spelled)) + word[at + n - 1], return_inverse=True)
        crc = np.fromiter((zlib.crc32(spaced[w], c) for c, w in zip(crc[pairs // max(1, len(spelled))].tolist(), (pairs % max(1, len(spelled))).tolist(), strict=True)), np.int64, len(pairs))
        out.append(crc[run] % buckets)
        rows.append(row[at])
    return np.concatenate(out), np.concatenate(rows), n_words


def bucket_counts(docs, max_n=1, buckets=BUCKETS, text_col="text"):
    """List of how often all texts use each bucket: ``buckets`` numbers, whatever the corpus."""
    B.bounded(docs.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_features(batch.column(0), max_n, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(raw, target, scale=1000):
    """floor(scale * ln of the smoothed ratio of target to raw) of each bucket."""
    m, s_all, t_all = len(raw), sum(raw), sum(target)
    return [math.floor(scale * math.log(float((t + 1) * (s_all + m)) / float((s + 1) * (t_all + m)))) for s, t in zip(raw, target, strict=True)]


def weigh(docs, gain, max_n=1, id_col="doc_id", text_col="text"):
    """id, n_words, n_features and weight (floored mean gain of the features, 0 without any) of each row."""
    B.bounded(docs.sparkSession)
    table = np.array(gain, np.int64)

    def weights(batches):
        for batch in batches:
            bucket, row, n_words = _features(batch.column(1), max_n, len(table))
            order = np.argsort(row, kind="stable")
            n = np.bincount(row, minlength=len(n_words))
            total = np.zeros(len(n_words), np.int64)
            if len(row):
                full = np.flatnonzero(n)
                total[full] = np.add.reduceat(table.take(bucket[order]), (np.cumsum(n) - n)[full])
            yield pa.record_batch([batch.column(0), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(weights, "id long, n_words long, n_features long, weight long")


def noise(seed, id_col="id", scale=1000):
    """floor(scale * Gumbel noise) of a row, from the first 32 bits of SHA-256 of ``seed:id`` (null id: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored, percent, min_words):
    """Adds rank to rows with id, n_words and score: 1, 2, ... for the floor(percent * N / 100) highest scores of the N rows
    with ``min_words`` words or more, ties to the smaller id; null for the others.

    ``scored`` is read several times: give a written table. Rows per score are fetched: a gain lies within 1000 * ln(10^15)
    of 0 and the noise within -3,131 and 22,874, so there are less than 110,000 different scores whatever the corpus. A null id
    comes after all others; rows with one id are ranked in any order.
    """
    spark = scored.sparkSession
    able = F.col("n_words") >= min_words
    found = sorted(scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    wanted = percent * sum(r.n for r in found) // 100
    before, offsets = 0, []
    for r in found:
        if before >= wanted:
            break
        offsets.append((r.score, before))
        before += r.n
    if not offsets:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = able & (F.col("score") >= offsets[-1][0])
    offsets = F.broadcast(spark.createDataFrame(offsets, "score long, _higher long"))
    place = totals_before(scored.where(high).withColumn("_pos", F.coalesce("id", F.lit(2**63 - 1))), ["score"], "_pos", _equal=F.lit(1))
    rank = F.col("_higher") + F.col("_equal") + 1
    drawn = place.join(offsets, "score").withColumn("rank", F.when(rank <= wanted, rank).cast("long")).select(*scored.columns, "rank")
    return drawn.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs, target, percent=10, min_words=20, max_n=1, buckets=BUCKETS, seed=2024, id_col="doc_id", text_col="text", target_text_col="text"):
    """A row per row of ``docs``: id, n_words, n_features, weight, score, rank (null: not drawn). Other columns are left out.

    ``target`` is a table of texts of the wanted kind. Words are runs of letters a-z (A-Z lower-cased), digits and all
    characters beyond ASCII. A null or empty text has no features and weight 0; repeated rows count, and are ranked, each for
    itself. An empty target gives every bucket the gain of one unseen there.
    """
    gain = gains(bucket_counts(docs, max_n, buckets, text_col), bucket_counts(target, max_n, buckets, target_text_col))
    home = shared_folder(docs.sparkSession, "importance")
    weigh(docs, gain, max_n, id_col, text_col).withColumn("score", F.col("weight") + noise(seed)).write.parquet(home)
    return draw(docs.sparkSession.read.parquet(home), percent, min_words)


B.by_value(__name__)

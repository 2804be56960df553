"""Mixes sources to target weights by Poisson replication, and shuffles the copies globally.

Every document of a source is repeated a Poisson number of times whose mean is the source's repetition rate (target rows
over rows there are). The Poisson distribution is inverted at a number drawn from a hash of the seed and the document id,
so a document's count depends on nothing else, and reruns and retries give the same rows. Each copy has a hash as its
place; a range partitioning by it is the global shuffle.
"""

from pyspark.sql import functions as F

SMALL = 100_000  # rates of at most so many sources are sent to every task


def uniform(*parts):
    """A number in [0, 1) with 52 bits from the MD5 of its parts, joined by colons (null: empty)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rates(docs, source_col="source", weights=None, total=None):
    """(source, n, rate): ``total`` rows (default: as many as there are) dealt to sources by ``weights``.

    ``weights`` is a DataFrame (source, weight) or None for equal weights. They are scaled to add up to one over the
    sources that occur; a source without a weight gets none. A null source is a source like others.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double"))
        counts = counts.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    sums = counts.agg(F.sum("n").alias("_n"), F.sum("weight").alias("_w"))
    whole = F.col("_n") if total is None else F.lit(float(total))
    return counts.crossJoin(F.broadcast(sums)).select("source", "n", F.coalesce(F.col("weight") / F.col("_w") * whole / F.col("n"), F.lit(0.0)).alias("rate"))


def first_step(rate):
    """The count from which on steps are listed: what lies below it is under 2^-52 together."""
    return F.greatest(F.lit(0), F.floor(rate - 12 * F.sqrt(rate) - 30)).cast("int")


def poisson_steps(rate):
    """Cumulative Poisson probabilities of ``first_step``, the next count ... as an array, far enough that what is left is
    below 2^-52. The array grows with the root of the rate."""
    first, last = first_step(rate), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    below = F.aggregate(F.when(first > 1, F.sequence(F.lit(1), first - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + F.log(k.cast("double")))
    # exp underflows for large rates: take each probability in logarithms
    state = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps"), below.alias("logs"))

    def step(s, k):
        logs = s["logs"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)
        p = F.exp(k * F.log(rate) - rate - logs)
        return F.struct((s["sum"] + p).alias("sum"), F.concat(s["steps"], F.array(s["sum"] + p)).alias("steps"), logs.alias("logs"))

    return F.when(rate > 0, F.aggregate(F.sequence(first, last), state, step, lambda s: s["steps"])).otherwise(F.array(F.lit(1.0)))


def replicate(docs, seed=0, weights=None, total=None, id_col="doc_id", source_col="source"):
    """The columns of ``docs`` (renamed nowhere) with rate, copy (from 1) and place, a number in [0, 1), for each copy.

    Rows are dealt to partitions by ranges of place and sorted in them: the order of the result is the global shuffle.
    Rows with equal ids get equal counts; a null id hashes like an empty one. A weight of 0 drops its source.
    """
    plan = rates(docs, source_col, weights, total).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), first_step(F.col("rate")).alias("_first"), poisson_steps(F.col("rate")).alias("_steps"))
    if plan.limit(SMALL + 1).count() <= SMALL:  # a small table of checked size; else Spark joins by a shuffle
        plan = F.broadcast(plan)
    out = docs.withColumn("_u", uniform(F.lit(seed), F.col(id_col))).join(plan, F.col(source_col).eqNullSafe(F.col("_source")))
    # the count is the number of steps that the uniform number has passed
    count = F.col("_first") + F.size(F.filter("_steps", lambda c: c <= F.col("_u")))
    named = [c for c in docs.columns if c not in ("rate", "copy", "place")]
    out = out.withColumn("_count", count).where("_count > 0").select(*named, F.col("_rate").alias("rate"), F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("copy"))
    out = out.withColumn("place", uniform(F.lit(seed), F.lit("place"), F.col(id_col), F.col("copy")))
    return out.repartitionByRange("place").sortWithinPartitions("place")

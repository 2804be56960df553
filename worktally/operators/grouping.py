"""Per-group selection that survives hot groups.

A window over a whole group sends the group to one task. These helpers reach the same rows by a
partially aggregated ``groupBy`` and a join back (one row per key on the small side, so adaptive
skew handling can split the large side), or by two-level running totals whose windows never span more
than ``RUN`` rows of detail.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN = 1 << 16


def computed(df, **cols):
    """Adds columns through a generator: each is evaluated once per row, and later filters and
    projections use the value instead of repeating a long expression."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def attach(df, facts, keys, how="left", null_keys=False):
    """Joins ``facts`` (one row per key) onto ``df``. With ``null_keys`` NULL keys pair up too; the
    plain form keeps the key partitioning, so a window over the same keys needs no second shuffle."""
    if not null_keys:
        return df.join(facts, list(keys), how)
    added = [c for c in facts.columns if c not in keys]
    right = facts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *added)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(right, cond, how).drop(*[f"_k_{k}" for k in keys])


def top_rows(df, keys, order, k, rank="rank"):
    """The first ``k`` rows of every group with their rank. Every task keeps at most ``k`` rows per
    group before the shuffle, so a hot group costs no more than others."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def in_runs(df, pos):
    """Adds ``_run``: runs of at most ``RUN`` positions."""
    return df.withColumn("_run", F.floor(F.col(pos) / RUN))


def run_totals(tagged, keys, coarse=(), whole=False, keep=(), **sums):
    """One row per run of ``in_runs``, for every ``name=column`` with the sum over earlier runs of the group; see ``totals_before``.

    ``keep`` names columns that are the same in all rows of a run.
    """
    coarse_cols = [c for c, _ in coarse]
    run_keys = [*keys, *coarse_cols, "_run"]
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in coarse] + [F.col("_run")]
    runs = tagged.groupBy(*run_keys).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()], *[F.first(c).alias(c) for c in keep])
    over = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*keys)
    return runs.select(*run_keys, *keep, *[F.sum(f"_sum_{n}").over(over).alias(f"_base_{n}") for n in sums],
                       *[F.sum(f"_sum_{n}").over(group).alias(f"{n}_all") for n in sums if whole])


def totals_in_runs(out, keys, pos, coarse=(), **sums):
    """Sums over earlier rows, for rows that ``run_totals`` has been joined to."""
    inside = W.partitionBy(*keys, *[c for c, _ in coarse], "_run").orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    for n, v in sums.items():
        total = F.coalesce(F.col(f"_base_{n}"), F.lit(0)) + F.coalesce(F.sum(v).over(inside), F.lit(0))
        out = out.withColumn(n, total)
    return out.drop("_run", *[f"_base_{n}" for n in sums])


def totals_before(df, keys, pos, coarse=(), whole=False, **sums):
    """Adds, for every ``name=column``, the sum over earlier rows of the group (0 for the first);
    with ``whole`` also the sum over the group as ``name_all``.

    Rows are ordered by ``(*coarse, pos)``; ``pos`` holds whole numbers unique within keys and
    coarse. Detail windows cover runs of at most ``RUN`` positions; only one total per run is
    ordered over the whole group. ``coarse`` lists leading columns as ``(name, descending)`` pairs.
    """
    tagged = in_runs(df, pos)
    out = attach(tagged, run_totals(tagged, keys, coarse, whole, **sums), [*keys, *[c for c, _ in coarse], "_run"])
    return totals_in_runs(out, keys, pos, coarse, **sums)


def latest_per_key(df, key, *order, keep=()):
    """One row per key: the one with the largest ``order`` columns; ``keep`` names further columns to carry."""
    names = [*order, *[c for c in keep if c not in order]]
    best = df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_w"))
    return best.select(key, "_w.*")


def ordered_distinct(df, keys, seq):
    """Different values of ``keys`` with the first ``seq`` they come at: ordering by it keeps the order of first sight."""
    return df.groupBy(*keys).agg(F.min(seq).alias("first_seen"))


def first_and_last(df, key, value, seq):
    """First and last value in order of ``seq``, and the smallest and largest, of the rows that have one."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(key).agg(F.min_by(value, seq).alias("first_date"), F.max_by(value, seq).alias("last_date"),
                                  F.min(value).alias("low"), F.max(value).alias("high"))

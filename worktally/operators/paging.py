"""Orders and pages of large tables without sorting them whole."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256


def by_name(column, missing="z"):
    """Sort key: case folded, a missing name as ``missing``."""
    return F.lower(F.coalesce(F.col(column), F.lit(missing)))


def worst_first(column, order):
    """Rank of a value in ``order`` (1 is the worst); values outside it come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(column))
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))


def _number(df, column, descending):
    """A double in the order of the column, nulls where Spark puts them; equal numbers for different values do no harm."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):  # the first six bytes
        c = F.conv(F.substring(F.rpad(F.hex(F.encode(c, "UTF-8")), 12, "0"), 1, 12), 16, 10).cast("double")
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp")).cast("double")
    elif isinstance(kind, T.BooleanType):
        c = c.cast("int").cast("double")
    else:
        c = F.when(F.isnan(c.cast("double")), F.lit(float("inf"))).otherwise(c.cast("double"))
    return F.coalesce(-c if descending else c, F.lit(float("inf") if descending else float("-inf")))


def _order(order):
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in order]


def page(df, order, offset, limit):
    """Rows ``offset`` to ``offset + limit`` in ``order``, a list of (column, descending) that names each row uniquely.

    The first column's range is cut in ``BUCKETS`` parts of about equal size, whose rows are counted. Only the parts that
    the page lies in are ordered, and each task keeps at most the rows up to the page's end in them: a deep page costs no more
    than one near the start, and nothing is sorted whole.
    """
    lead = _number(df, *order[0])
    numbered = df.withColumn("_lead", lead)
    parts = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = sorted(set(numbered.agg(F.percentile_approx("_lead", parts).alias("c")).first().c or []))
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    bucket = F.size(F.filter(edges, lambda e: e <= F.col("_lead")))
    numbered = numbered.withColumn("_bucket", bucket)
    counts = {r["_bucket"]: r.n for r in numbered.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}  # at most BUCKETS
    before, inside, skipped = 0, [], 0
    for b in sorted(counts):
        if before + counts[b] <= offset:
            skipped += counts[b]
        elif before < offset + limit:
            inside.append(b)
        before += counts[b]
    rows = numbered.filter(F.col("_bucket").isin(inside) if inside else F.lit(False)).drop("_lead", "_bucket")
    return rows.orderBy(*_order(order)).offset(offset - skipped).limit(limit)


def page_after(df, order, last, limit):
    """The ``limit`` rows after the row whose order columns are ``last`` (keyset paging; none of them may be null)."""
    beyond, equal = [], F.lit(True)
    for (c, down), v in zip(order, last, strict=True):
        beyond.append(equal & ((F.col(c) < F.lit(v)) if down else (F.col(c) > F.lit(v))))
        equal = equal & (F.col(c) == F.lit(v))
    return df.filter(reduce(lambda a, b: a | b, beyond)).orderBy(*_order(order)).limit(limit)

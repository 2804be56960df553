"""Tables: master and fact data in and out, keep-latest upserts, nested records."""

from pyspark.sql import functions as F

from worktally.operators.grouping import attach


def read_table(spark, path, columns=None, fmt="parquet", **options):
    """Columnar or JDBC table; give ``columns`` to prune the scan."""
    df = spark.read.format(fmt).options(**options).load(path) if path else \
        spark.read.format(fmt).options(**options).load()
    return df.select(*columns) if columns else df


def append_table(df, path, partition_by=()):
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def keep_latest(old, new, key, version):
    """One row per key: the highest version wins, new rows win ties."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    won = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, "_src")).alias("_w"))
    return won.select(key, "_w.*").select(*old.columns)


def append_text(old, new, marker="[OCR]"):
    """Adds new text below a marker, joins warnings, replaces tables only when present."""
    right = new.select("file_id", F.col("text").alias("_t"), F.col("warnings").alias("_w"),
                       F.col("tables").alias("_tab"))
    out = attach(old, right.withColumnRenamed("file_id", "file_id"), ["file_id"])
    joined = F.concat(F.col("text"), F.lit(f"\n\n{marker}\n"), F.coalesce("_t", F.lit("")))
    text = (F.when(F.col("_t").isNull() & F.col("_w").isNull(), F.col("text"))
            .when(F.coalesce("text", F.lit("")) != "", F.trim(joined)).otherwise(F.col("_t")))
    none = F.array().cast("array<string>")
    return (out.withColumn("text", text)
            .withColumn("warnings", F.concat(F.coalesce("warnings", none), F.coalesce("_w", none)))
            .withColumn("tables", F.coalesce("_tab", "tables")).drop("_t", "_w", "_tab"))


def read_json_records(df, column, schema, numbers):
    """(good, quarantine): strings parsed by ``schema``; unknown keys ignored.

    ``numbers`` maps a field to the default for blank or bad text (None keeps NULL).
    """
    full = f"{schema}, _corrupt string"
    parsed = df.withColumn("_r", F.from_json(column, full, {"mode": "PERMISSIVE",
                                                            "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    fields = [f.split()[0] for f in schema.split(",")]
    cols = []
    for f in fields:
        c = F.col(f"_r.{f}")
        if f in numbers:
            c = F.coalesce(F.nullif(c, F.lit("")).try_cast("double"), F.lit(numbers[f]).cast("double"))
        cols.append(c.alias(f))
    good = parsed.filter(~bad).select(*df.columns, *cols)
    return good, parsed.filter(bad).select(*df.columns)

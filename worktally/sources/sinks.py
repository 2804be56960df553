"""Report sinks."""


def write_reports(reports, root, fmt="parquet"):
    """Each report table under its name; partitioned by batch where it has one.

    Such a table should come in order of its batch: then a task holds a few batches, or a part of a large one, and the files number as
    many as there are batches and tasks. In any other order every task writes a file for every batch.
    """
    for name, df in reports.items():
        w = df.write.mode("overwrite")
        if "batch_id" in df.columns:
            w = w.partitionBy("batch_id")
        w = w.option("header", "true") if fmt == "csv" else w
        w.format(fmt).save(f"{root}/{name}")


def write_summary_csv(df, path):
    """Summary rows as CSV with a header; every text column must be formula-safe already."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option(
        "escape", '"').csv(path)

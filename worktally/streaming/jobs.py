"""Structured Streaming jobs.

State and output live below ``home``. A job called again with the same ``home`` goes on where it stopped: files it has read are
skipped, and what it has stored counts. Without ``home`` a new folder in the shared one is taken, so the run starts afresh.
"""

from pyspark.sql import functions as F

from worktally.session import by_value, shared_folder
from worktally.streaming.buckets import BucketTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark, folder, name, files_per_trigger=None):
    """Stream over the parquet files of one table; the schema is taken from the files there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def run_available(writer, home):
    """Processes what is there and stops; offsets are kept under ``home``."""
    q = writer.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def append_out(stream, purpose, home=None):
    """Appends a stream to parquet and returns the result as a table."""
    spark = stream.sparkSession
    home = home or shared_folder(spark, purpose)
    run_available(stream.writeStream.format("parquet").option("path", f"{home}/rows").outputMode("append"), home)
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def per_batch(stream, purpose, change, home=None, by=()):
    """Writes ``change(batch, batch_id, home)`` of every micro-batch, partitioned by the columns ``by``.

    Each batch has its own folder, overwritten on replay, so a retried batch leaves no doubles. Returns the home folder; read
    all batches with ``read_parts``.
    """
    home = home or shared_folder(stream.sparkSession, purpose)

    def write(batch, batch_id):
        change(batch, batch_id, home).write.mode("overwrite").partitionBy(*by).parquet(f"{home}/rows/batch={batch_id}")

    run_available(stream.writeStream.foreachBatch(write), home)
    return home


def read_parts(spark, home):
    return spark.read.option("basePath", f"{home}/rows").parquet(f"{home}/rows")


def ingest_latest(stream, key, version, home=None, buckets=16):
    """Incremental ingest: the latest version per key (of equal versions the one that came later) in a bucketed table.

    Every batch is merged into the buckets its keys fall in; the others are left alone. The result is a plain scan. A batch
    that runs again starts from the table as it was before it, so a replay changes nothing. ``buckets`` holds for the life of a home.
    Null keys are one key.
    """
    spark = stream.sparkSession
    home = home or shared_folder(spark, "ingest")
    table = BucketTable(spark, home, key, version, stream.schema, buckets)
    run_available(stream.writeStream.foreachBatch(table.merge), home)
    return table.read()


def earliest(rows, key, event_time):
    """Of every id the row with the earliest time; rows of one id and time are taken in the order of their text. Null times come first."""
    at = F.coalesce(F.unix_micros(F.col(event_time).cast("timestamp")), F.lit(-(2**63)))
    order = F.struct(at.alias("at"), F.to_json(F.struct(*rows.columns)).alias("tie"))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("_w")).select("_w.*")


def dedup_messages(stream, key, event_time, home=None):
    """First arrival of every message id (in one batch the earliest); ids are remembered for good, however late a copy comes.

    Two streams: the first reduces a batch to one row per id, a plain aggregate below ``arrivals``; the second is run on what
    that batch wrote and drops ids it knows. The ids are its keyed state in RocksDB, so a batch looks up its own ids only, and costs
    the same however many came before. A batch that runs again goes on with the arrivals it wrote; those are deleted once the second
    stream has noted them, and written anew they hold known ids only. Null ids are no ids: all such messages stay.
    """
    spark = stream.sparkSession
    home = home or shared_folder(spark, "dedup")
    schema = stream.schema

    def admit(batch, batch_id):
        named = F.col(key).isNotNull()
        batch.filter(~named).write.mode("overwrite").parquet(f"{home}/rows/batch=unnamed-{batch_id}")
        arrived = f"{home}/arrivals/batch={batch_id}"
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(arrived).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path(arrived, "_SUCCESS")):  # the second stream may have begun to read them
            earliest(batch.filter(named), key, event_time).write.mode("overwrite").parquet(arrived)
        firsts = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{home}/arrivals").dropDuplicates([key])
        write = lambda b, i: b.write.mode("overwrite").parquet(f"{home}/rows/batch={i}")
        run_available(firsts.writeStream.foreachBatch(write), f"{home}/ids")
        fs.delete(path(arrived), True)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        run_available(stream.writeStream.foreachBatch(admit), home)
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{home}/rows")


def progress_counts(stream, event_time, status, width="1 day", home=None):
    """Counts per window and status: each batch stores its own counts, and reading adds them up. No row is too late."""
    timed = stream.withColumn("_at", F.col(event_time).cast("timestamp"))
    count = lambda b, *_: (b.groupBy(F.window("_at", width).alias("w"), F.col(status).alias("status")).agg(F.count("*").alias("n"))
                           .select(F.col("w.start").alias("window_start"), "status", "n"))
    home = per_batch(timed, "progress", count, home)
    return read_parts(stream.sparkSession, home).groupBy("window_start", "status").agg(F.sum("n").alias("n"))


def dead_letters(stream, good, purpose="letters", home=None):
    """Rows failing ``good`` go to a dead-letter table; the batch itself never fails on them and is written once."""
    mark = lambda b, *_: b.withColumn("dead_letter", F.when(good, 0).otherwise(1))
    home = per_batch(stream, purpose, mark, home, by=["dead_letter"])
    parts = read_parts(stream.sparkSession, home)
    return parts.filter("dead_letter = 0").drop("dead_letter"), parts.filter("dead_letter = 1").drop("dead_letter")


by_value(__name__)

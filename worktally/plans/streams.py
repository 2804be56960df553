"""Streaming runs over the given tables; checked against the batch result."""

from pyspark.sql import functions as F

from worktally.functions import hours as H
from worktally.operators import entries as E
from worktally.operators import rules as R
from worktally.plans.registry import query
from worktally.plans.rules import COLS, SQL
from worktally.session import shared_folder
from worktally.streaming import jobs as J


def events_stream(t):
    """``events`` as files in order of time, each eleventh row twenty days late, read in four micro-batches or more."""
    folder = shared_folder(t.spark, "events")
    n = max(4, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    arrival = F.when(F.col("event_id") % 11 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 20 DAYS")).otherwise(F.col("ts").cast("timestamp"))
    events = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    events.repartitionByRange(n, arrival).write.parquet(folder)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", n // 4).parquet(folder)


@query("k01_incremental_ingest", "user_id:long, event_id:long, event_type:string",
       """SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
          FROM events) q WHERE rn = 1""")
def k01(t):
    return J.ingest_latest(events_stream(t).select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("k02_message_dedup", "event_id:long, user_id:long", "SELECT DISTINCT event_id, user_id FROM events")
def k02(t):
    cols = ["event_id", "user_id", "ts"]
    copies = F.when(F.col("event_id") % 3 == 0, 2).otherwise(1)
    twice = events_stream(t).select(*cols, F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    home = shared_folder(t.spark, "dedup")
    J.dedup_messages(twice, "event_id", "ts", home)
    return J.dedup_messages(twice, "event_id", "ts", home)  # started again: nothing is new


@query("k03_progress_counters", "day:string, status:string, n:long",
       "SELECT CAST(ts AS DATE) AS day, event_type AS status, COUNT(*) AS n FROM events GROUP BY 1, 2")
def k03(t):
    out = J.progress_counts(events_stream(t), "ts", "event_type")
    return out.withColumn("day", F.col("window_start").cast("date"))


@query("k04_stateless_rules", COLS,
       f"""{SQL["i17"]} UNION ALL SELECT 'DAILY_HOURS_EXCEED', 'ERROR', NULL, submission_id, entry_id,
  employee_id, '9', CAST(CAST(COALESCE(NULLIF(calculated_hours, 0), entered_hours) AS DECIMAL(10,2)) AS VARCHAR) FROM ck_hours
  WHERE COALESCE(NULLIF(calculated_hours, 0), entered_hours) > 9""")
def k04(t):
    shifts = E.with_hours(shift_stream(t))
    return J.append_out(R.apply_rules(shifts, [R.hours_mismatch_rule(), R.daily_hours_rule(limit=9)]), "rules")


def shift_stream(t):
    """fx_entry over a stream of events."""
    value = F.col("value").cast(H.HOURS)
    s = events_stream(t).select(
        F.col("event_id").alias("entry_id"), F.col("user_id").alias("employee_id"), F.col("ts").cast("date").alias("work_date"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("in_min"), (value % 14).cast("decimal(5,2)").alias("entered_hours"),
        (F.col("event_id") % 4 * 15).cast("int").alias("break_minutes"))
    late = F.when(F.col("entry_id") % 7 == 0, 30).otherwise(0)
    out = (F.col("in_min") + F.floor(F.col("entered_hours") * 60) + F.col("break_minutes") + late) % 1440
    half = F.when(F.dayofmonth("work_date") <= 15, 1).otherwise(2)
    return s.withColumns({"out_min": out.cast("int"), "submission_id": F.col("employee_id") * 10 + half})


@query("k05_dead_letters", "event_id:long, outcome:string",
       "SELECT event_id, CASE WHEN value > 100 THEN 'DEAD' ELSE 'KEPT' END AS outcome FROM events")
def k05(t):
    text = F.concat(F.when(F.col("value") > 100, "x").otherwise(""), F.col("value").cast("string"))
    rows = events_stream(t).withColumn("text", text)
    kept, dead = J.dead_letters(rows, F.col("text").try_cast("double").isNotNull())
    return kept.withColumn("outcome", F.lit("KEPT")).unionByName(dead.withColumn("outcome", F.lit("DEAD")))

"""Corrections, approvals, resolutions, deletions and their audit trail."""

from functools import reduce

from pyspark.sql import functions as F

from worktally.operators.grouping import attach


def overlay(base, patches, key):
    """Non-null patch fields win; patched rows go back to PENDING. ``patches`` has one row per key."""
    fields = [c for c in patches.columns if c != key]
    right = patches.select(F.col(key), *[F.col(c).alias(f"_p_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = attach(base, right, [key])
    out = out.withColumns({c: F.coalesce(F.col(f"_p_{c}"), F.col(c)) for c in fields})
    status = F.when(F.col("_hit"), "PENDING")
    if "validation_status" in base.columns:
        status = F.coalesce(status, F.col("validation_status"))
    return out.withColumn("validation_status", status).drop("_hit", *[f"_p_{c}" for c in fields])


def changes(before, after, key, fields):
    """One row per changed field: key, field, before, after (inserts and deletes included)."""
    b = before.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    a = after.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    both = b.join(a, key, "full")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("before"),
                               F.col(f"a_{f}").alias("after")) for f in fields])
    moved = F.filter(pairs, lambda p: ~p.before.eqNullSafe(p.after))
    return both.select(key, F.inline(moved))


def audit_rows(change_rows, key, entity, action):
    """Audit records with before and after as JSON, one per changed entity."""
    as_map = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", c)))))
    # fields per entity are few and fixed by the schema
    return change_rows.groupBy(key).agg(as_map("before").alias("before_json"), as_map("after").alias("after_json")) \
        .withColumns({"entity_type": F.lit(entity), "action": F.lit(action)})


def apply_approvals(submissions, events):
    """The latest approval event per submission sets status, approver and time."""
    last = events.groupBy("submission_id").agg(
        F.max_by(F.struct("status", "name", "email", "decided_at"), F.struct("decided_at", "event_id")).alias("_e"))
    out = attach(submissions, last, ["submission_id"])
    hit = F.col("_e").isNotNull()
    given = lambda c: F.nullif(F.col(f"_e.{c}"), F.lit(""))
    return (out.withColumn("approval_status", F.when(hit, F.col("_e.status")).otherwise(F.col("approval_status")))
            .withColumn("approver_name", F.coalesce(given("name"), F.col("approver_name")))
            .withColumn("approver_email", F.coalesce(given("email"), F.col("approver_email")))
            .withColumn("approved_at", F.when(F.col("_e.status") == "APPROVED", F.col("_e.decided_at"))).drop("_e"))


def resolve(findings, resolutions):
    """Marks findings resolved and notes who did it."""
    out = attach(findings, resolutions.select("finding_id", "reviewer", "note"), ["finding_id"])
    hit = F.col("reviewer").isNotNull()
    note = F.concat_ws(" ", F.concat(F.lit("[RESOLVED by "), F.col("reviewer"), F.lit("]")), F.nullif(F.col("note"), F.lit("")))
    return (out.withColumn("status", F.when(hit, "RESOLVED").otherwise(F.col("status")))
            .withColumn("action_required", F.when(hit, note)).drop("reviewer", "note"))


def without_batches(tables, doomed):
    """Cascading delete. ``tables`` maps a name to (frame, key to drop by, parent name or None).

    Children are removed by left anti joins against the parent's removed keys, parents first.
    """
    kept, gone = {}, {}
    for name, (df, key, parent) in tables.items():
        keys = doomed.select(key) if parent is None else gone[parent].select(key)
        keys = keys.distinct()
        kept[name] = df.join(keys, key, "left_anti")
        gone[name] = df.join(keys, key, "left_semi")
    return kept


def union_counts(frames):
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def audit_log(before, after, key, entity, action):
    """One record per row that changed, appeared or went: entity_id, fields (names of what changed), before_json, after_json.

    Works on any columns, nested ones too: a field changes when its JSON does. The JSON holds the changed fields with their
    types; a field that ``fields`` names and the JSON lacks is null there.
    """
    fields = [c for c in before.columns if c != key and c in after.columns]
    side = lambda df, name: df.select(key, F.struct(*fields).alias(name), F.lit(True).alias(f"_in_{name}"))
    both = side(before, "_b").join(side(after, "_a"), key, "full")
    as_json = lambda s, f: F.to_json(F.struct(F.col(f"{s}.{f}").alias(f)))
    new = F.col("_in__b").isNull() | F.col("_in__a").isNull()
    moved = {f: new & F.coalesce(F.col(f"_b.{f}").isNotNull() | F.col(f"_a.{f}").isNotNull(), F.lit(False)) | ~as_json("_b", f).eqNullSafe(as_json("_a", f)) for f in fields}
    only = lambda s: F.to_json(F.struct(*[F.when(moved[f], F.col(f"{s}.{f}")).alias(f) for f in fields]))
    names = F.array_compact(F.array(*[F.when(moved[f], F.lit(f)) for f in fields]))
    out = both.withColumn("fields", names).filter(new | (F.size("fields") > 0))
    kind = F.when(F.col("_in__b").isNull(), "INSERT").when(F.col("_in__a").isNull(), "DELETE").otherwise(F.lit(action))
    return out.select(F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), kind.alias("action"), "fields",
                      F.when(F.col("_in__b"), only("_b")).alias("before_json"), F.when(F.col("_in__a"), only("_a")).alias("after_json"))


def append_version(records, home, version):
    """Adds the records of one change to the log below ``home``. A version written again replaces itself: a replay leaves no doubles."""
    records.write.mode("overwrite").parquet(f"{home.rstrip('/')}/version={int(version)}")


def read_log(spark, home):
    """All records with their version."""
    return spark.read.option("basePath", home).parquet(home)

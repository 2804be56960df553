"""A table in buckets by key that takes one merge per micro-batch.

Rows of a key live in one bucket. A merge reads the buckets its keys fall in, keeps the latest row per key, and writes
those buckets anew below the batch's own folder; a manifest then names, for each bucket, the batch that holds it.
Nothing is changed in place: a reader sees the table before or after a batch, and a batch that is run again starts from
the manifest of the batch before it and replaces its own folder. Buckets that no kept manifest names are deleted.
"""

from pyspark.sql import functions as F


class BucketTable:
    def __init__(self, spark, home, key, version, schema, buckets):
        self.spark, self.home, self.key, self.version, self.schema, self.buckets = spark, home.rstrip("/"), key, version, schema, buckets

    def path(self, batch, bucket):
        return f"{self.home}/rows/batch={batch}/bucket={bucket}"

    def _folder(self, path):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def manifests(self):
        """Numbers of the batches that were merged to the end, ascending."""
        at, fs = self._folder(f"{self.home}/manifest")
        if not fs.exists(at):
            return []
        done = [x.getPath() for x in fs.listStatus(at)]
        return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, batch):
        """{bucket: batch that holds it}: at most as many entries as there are buckets."""
        rows = self.spark.read.schema("bucket int, holder long").parquet(f"{self.home}/manifest/batch={batch}").collect()
        return {r.bucket: r.holder for r in rows}

    def merge(self, rows, batch):
        """Merges a batch; equal versions go to the new row, within a batch to the larger row."""
        done = [b for b in self.manifests() if b < batch]
        held = self.manifest(done[-1]) if done else {}
        rest = [c for c in self.schema.names if c != self.key]
        last = F.max_by(F.struct(*rest), F.struct(self.version, "_new", *[F.to_json(F.struct(*rest)).alias("_tie")])).alias("_w")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        new = rows.select(*self.schema.names, F.lit(1).alias("_new"), bucket)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        if touched:
            paths = [self.path(held[b], b) for b in touched if b in held]
            if paths:
                old = self.spark.read.schema(self.schema).parquet(*paths)
                new = new.unionByName(old.select(*self.schema.names, F.lit(0).alias("_new"), bucket))
            merged = new.groupBy("bucket", self.key).agg(last).select("bucket", self.key, "_w.*").select("bucket", *self.schema.names)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.home}/rows/batch={batch}")
        held.update(dict.fromkeys(touched, batch))
        entries = self.spark.createDataFrame([(b, int(h)) for b, h in sorted(held.items())], "bucket int, holder long")
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.home}/manifest/batch={batch}")
        self._forget(done[:-1], {(h, b) for b, h in held.items()} | {(h, b) for b, h in (self.manifest(done[-1]) if done else {}).items()})

    def _forget(self, older, kept):
        """Deletes manifests before the last two, and the buckets that only they name."""
        for batch in older:
            for bucket, holder in self.manifest(batch).items():
                if (holder, bucket) not in kept:
                    at, fs = self._folder(self.path(holder, bucket))
                    fs.delete(at, True)
            at, fs = self._folder(f"{self.home}/manifest/batch={batch}")
            fs.delete(at, True)

    def read(self):
        """The table as of the last whole batch: one scan of the buckets' files."""
        done = self.manifests()
        held = self.manifest(done[-1]) if done else {}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self.path(h, b) for b, h in sorted(held.items())])

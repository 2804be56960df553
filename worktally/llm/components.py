"""Connected components of a link table, by alternating large and small stars."""

from pyspark.sql import functions as F

from worktally.session import shared_folder


def components(links, a="a", b="b"):
    """(node, root) for every node of a link: the root is the least node that links reach.

    Nodes may be of any type with an order. A star around a hot node is never gathered: each step is a minimum per node
    (combined before the shuffle) and a join. Each round is written to the shared folder, which cuts the lineage.
    """
    spark = links.sparkSession
    home = shared_folder(spark, "components")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")

    def settle(df, step):
        path = f"{home}/{step}"
        df.distinct().write.parquet(path)
        out = spark.read.parquet(path)
        return out, out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges, mark = settle(edges, 0)
    step = 0
    while True:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = settle(small.unionByName(low.withColumnRenamed("m", "v")), step)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

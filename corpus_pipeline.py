"""From raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from pyspark.sql import functions as F

from worktally.llm import jaccard_join, language_id, line_dedup, packing, replication
from worktally.llm.queries import MIX_SEED, tokenizer
from worktally.session import prepare, shared_folder
from worktally.sources.stages import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # hashing vectors and a tokenizer are beyond SQL: tests compare with brute force


def identify_language(spark, docs, sf_dir):
    """Drops documents in none of the languages learned: no text, no letter, or a cosine under ``least_scores``.

    Where no row has a language nothing can be learned, and only documents without a letter go.
    """
    prepare(spark)
    model = language_id.train(docs, F.lit(True))
    if not model[0]:
        return docs.where(F.col("text").rlike("\\p{L}")).select(*docs.columns)
    # judged once and written: the least scores and the rows kept are both read from there
    judged = staged(language_id.predict(docs, model, keep=docs.columns), "judged")
    least = F.array(*[F.lit(x) for x in language_id.least_scores(judged)])
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= F.get(least, language_id.length_class()))).select(*docs.columns)


def drop_repeated_lines(spark, docs, sf_dir):
    """Deletes later repeats of runs of 50 words or more, and documents of which no word is left."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs)
    out = out.where(~((F.col("n_removed") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps of each group of linked documents the one with the least id; of repeated rows one stays."""
    prepare(spark)
    least = jaccard_join.near_duplicates(docs).where("id <=> component_id").select(F.col("id").alias("_id")).distinct()
    key = F.xxhash64("text")
    kept = docs.join(least, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.withColumn("_text", key).dropDuplicates(["doc_id", "_text"]).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Repeats documents so that all sources get equal expected shares of as many rows as there are, in global random order."""
    prepare(spark)
    return replication.replicate(docs, MIX_SEED).select(*docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """Packs the token pieces of all documents into sequences of at most 1024 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, *tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", identify_language), ("line_dedup", drop_repeated_lines), ("jaccard_join", drop_near_duplicates),
          ("poisson_mix", mix_sources), ("best_fit_pack", pack_sequences)]


def run(spark, sf_dir):
    """Applies the stages to ``documents`` of ``sf_dir``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    home = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs

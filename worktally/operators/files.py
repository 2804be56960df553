"""File side: archive guard, triage, duplicates, path metadata, document type."""

from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import names as N
from worktally.functions import patterns as RX
from worktally.operators.grouping import attach


def base_name(path):
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(name):
    """Lower-case extension with its dot; dots that only lead a name do not count."""
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1))


def stem(name):
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def escapes(path):
    """True when the resolved path leaves the target folder."""
    def step(acc, part):
        depth = acc.depth + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(acc.low, depth).alias("low"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    low = F.aggregate(F.split(path, "/"), start, step, lambda acc: acc.low)
    return path.startswith("/") | (low < 0)


def archive_guard(members, max_members=P.MAX_ARCHIVE_MEMBERS, max_bytes=P.MAX_ARCHIVE_BYTES):
    """Verdict per member; an archive over a limit is rejected as a whole.

    Sizes are never negative, so the running size passes the limit exactly when the sum does: one
    aggregate per archive is enough.
    """
    own = (F.when(escapes(F.col("member")), "UNSAFE_PATH")
           .when(extension(base_name(F.col("member"))).isin(P.BLOCKED_EXTENSIONS), "BLOCKED_TYPE")
           .otherwise("ACCEPTED"))
    judged = members.withColumn("verdict", own)
    facts = judged.groupBy("archive_id").agg(
        F.count("*").alias("_n"),
        F.sum(F.when(F.col("verdict") == "ACCEPTED", F.col("size_bytes"))).alias("_bytes"))
    out = attach(judged, facts, ["archive_id"])
    whole = (F.when(F.col("_n") > max_members, "ARCHIVE_TOO_MANY")
             .when(F.col("_bytes") > max_bytes, "ARCHIVE_TOO_LARGE"))
    return out.withColumn("verdict", F.coalesce(whole, F.col("verdict"))).drop("_n", "_bytes")


def mark_duplicates(files, content_hash, order="file_id"):
    """The first file of a hash is the original; later ones point to it. NULL is never a copy."""
    hashed = files.withColumn("content_hash", content_hash)
    firsts = (hashed.filter(F.col("content_hash").isNotNull()).groupBy("content_hash")
              .agg(F.min(order).alias("_first")))
    out = hashed.join(firsts, "content_hash", "left")
    copy = F.col("_first").isNotNull() & (F.col("_first") < F.col(order))
    return (out.withColumn("duplicate_of", F.when(copy, F.col("_first")))
            .withColumn("is_duplicate", copy).drop("_first"))


def triage(files, name, duplicate):
    """Status, noise and candidate flags by the first rule that applies."""
    low, ext = F.lower(name), extension(name)
    noise = F.lit(False)
    for word in P.NOISE_NAMES:
        noise = noise | low.endswith(word)
    blocked = ext.isin(P.BLOCKED_EXTENSIONS)
    foreign = (ext != "") & ~ext.isin(P.SUPPORTED_EXTENSIONS)
    return (files.withColumn("file_ext", ext)
            .withColumn("processing_status",
                        F.when(noise, "IGNORED_NOISE").when(blocked | foreign, "UNSUPPORTED_FILE_TYPE")
                        .when(duplicate, "DUPLICATE_FILE").otherwise("DETECTED"))
            .withColumn("is_noise", noise | blocked)
            .withColumn("is_candidate", ~(noise | blocked | foreign)))


def path_metadata(files, path="rel_path"):
    """Vendor folder, period text and person name read from a relative path."""
    p = F.col(path)
    bare = stem(base_name(p))
    everything = F.concat_ws(" ", F.split(folder(p), "/"), bare)
    words = F.regexp_replace(bare, r"[_\-]+", " ")
    words = F.regexp_replace(words, RX.PATH_DATE_WORDS, " ")
    words = F.regexp_replace(words, rf"(?i)\b(?:{'|'.join(P.COMPANY_STOPWORDS)})\b", " ")
    words = F.regexp_replace(words, RX.PATH_DOC_WORDS, " ")
    rest = N.bind(F.array_join(N.words(words), " "), lambda s: F.when(
        (F.length(s) > 3) & (F.size(F.filter(F.split(s, " "),
                                             lambda w: w.rlike(r"^[A-Z][A-Za-z\-']+$"))) >= 2), s))
    tail = F.regexp_extract(bare, RX.TRAILING_NAME, 1)
    return (files.withColumn("vendor", F.nullif(F.split(folder(p), "/")[0], F.lit("")))
            .withColumn("period_text", F.nullif(F.regexp_extract(everything, RX.PATH_PERIOD, 1), F.lit("")))
            .withColumn("person", F.when(tail != "", tail).otherwise(rest)))


def document_type(text):
    """Keyword hits decide between hours sheet, other document and unknown."""
    def decide(h):
        return (F.when((h.yes >= 2) & (h.yes > h.no), "TIMESHEET_CANDIDATE")
                .when((h.no >= 2) & (h.no >= h.yes), "NON_TIMESHEET_DOCUMENT")
                .when(h.yes >= 1, "TIMESHEET_CANDIDATE").otherwise("UNKNOWN_DOCUMENT_NEEDS_REVIEW"))
    hits = F.struct(F.regexp_count(text, F.lit(RX.DOC_YES)).alias("yes"),
                    F.regexp_count(text, F.lit(RX.DOC_NO)).alias("no"))
    short = F.length(F.trim(F.coalesce(text, F.lit("")))) < 20
    return F.when(short, "UNKNOWN_DOCUMENT_NEEDS_REVIEW").otherwise(N.bind(hits, decide))


def extraction_score(text, table_rows, confidence):
    """2 per table row, 1 per date, up to 8 for length, 3 times confidence; 0 for empty text."""
    dates = F.regexp_count(text, F.lit(RX.SCORE_DATES))
    length = F.least((F.length(text) / 500).cast("decimal(12,3)"), F.lit(8).cast("decimal(12,3)"))
    score = table_rows * 2 + dates + length + confidence * 3
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0)).otherwise(F.round(score, 2))


def is_sufficient(text, widest_table):
    """Enough text or a real table, and something that looks like an hours sheet."""
    table = widest_table > 2
    enough = F.length(F.trim(text)) >= P.MIN_TEXT_CHARS
    return table | (enough & text.rlike(RX.HAS_SHEET_SIGNS))


def page_mix(pages):
    """Per document: text, image or mixed from page facts (page chars, images)."""
    texty = F.col("text_chars") >= P.MIN_PAGE_CHARS
    d = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(texty).alias("text_pages"),
        F.count_if(~texty).alias("image_pages"),
        F.floor(F.avg(F.when(texty, F.col("text_chars")))).alias("avg_chars"))
    share = F.lit(P.PAGE_MAJORITY)
    kind = (F.when(F.col("pages") == 0, "unknown").when(F.col("text_pages") == 0, "image")
            .when(F.col("image_pages") == 0, "text")
            .when(F.col("text_pages") / F.col("pages") >= share, "text")
            .when(F.col("image_pages") / F.col("pages") >= share, "image").otherwise("mixed"))
    return d.withColumn("kind", kind).fillna(0, ["avg_chars"])

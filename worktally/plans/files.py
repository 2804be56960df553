"""File side on documents, pages and lines."""

from pyspark.sql import functions as F

from worktally.operators import counters as CO
from worktally.operators import files as FI
from worktally.operators import rules as R
from worktally.operators import textdocs as TX
from worktally.plans.registry import query
from worktally.session import by_value, shared_folder
from worktally.sources import files as SF
from worktally.sources import tables as ST


@query("a01_file_inventory", "folder_path:string, file_ext:string, has_size:long",
       "SELECT DISTINCT 'source=' || source || '/lang=' || lang AS folder_path, '.txt' AS file_ext, 1 AS has_size FROM documents")
def a01(t):
    root = shared_folder(t.spark, "inventory")
    docs = t.documents.select("source", "lang", "text")
    docs.repartition("source", "lang").write.partitionBy("source", "lang").text(root)
    found = SF.inventory(t.spark, root).filter(F.col("file_ext") != "")
    return found.groupBy("folder_path", "file_ext").agg(
        F.min((F.col("size_bytes") > 0).cast("int")).alias("has_size"))


@query("a02_archive_guard", "archive_id:long, member:string, verdict:string",
       """SELECT archive_id, member, CASE WHEN SUM(own_size) OVER (PARTITION BY archive_id) > 60000
         THEN 'ARCHIVE_TOO_LARGE' ELSE verdict END AS verdict
FROM (SELECT *, CASE WHEN verdict = 'ACCEPTED' THEN size_bytes ELSE 0 END AS own_size FROM (
  SELECT *, CASE WHEN starts_with(member, '../') OR starts_with(member, '/') THEN 'UNSAFE_PATH'
    WHEN member LIKE '%.exe' THEN 'BLOCKED_TYPE' ELSE 'ACCEPTED' END AS verdict FROM fx_member) a) b""")
def a02(t):
    return FI.archive_guard(t.fx_member, max_bytes=60000)


@query("a03_delimited_load", "entry_id:string, work_date:string, hours:string",
       """SELECT CAST(entry_id AS VARCHAR) AS entry_id, CAST(work_date AS VARCHAR) AS work_date,
          COALESCE(CAST(calculated_hours AS VARCHAR), '') AS hours FROM fx_claim""")
def a03(t):
    path = shared_folder(t.spark, "delimited")
    t.fx_claim.select("entry_id", "work_date", "calculated_hours").write.option("sep", ";").csv(path)
    return SF.read_delimited(t.spark, path, ["entry_id", "work_date", "hours"])[0]


@query("a03_mixed_folder", "entry_id:string, work_date:string, hours:string",
       """SELECT CAST(entry_id AS VARCHAR) AS entry_id, CAST(work_date AS VARCHAR) AS work_date,
          CASE WHEN entry_id % 5 = 0 THEN '' ELSE COALESCE(CAST(calculated_hours AS VARCHAR), '') END AS hours FROM fx_claim
          UNION ALL SELECT 'Läufe', '', ''""")
def a03_mixed(t):
    """Files of two delimiters and encodings below one folder, those of the second with a title line each; each fifth row is short."""
    path = shared_folder(t.spark, "mixed")
    parts = [F.col("entry_id").cast("string"), F.col("work_date").cast("string"),
             F.when(F.col("entry_id") % 5 != 0, F.coalesce(F.col("calculated_hours").cast("string"), F.lit("")))]
    rows = t.fx_claim
    for i, (sep, encoding) in enumerate([(",", "UTF-8"), (";", "ISO-8859-1")]):
        lines = rows.filter(F.col("entry_id") % 2 == i).select(F.concat_ws(sep, *parts).alias("line"))
        if i:  # a task writes one file, whose title tells the encoding of its lines
            lines = lines.mapInArrow(_titled, "line string")
        lines.select(F.encode("line", encoding).cast("string").alias("line")).write.mode("append").text(path)
    read = SF.read_delimited(t.spark, path, ["entry_id", "work_date", "hours"])[0]
    title = F.col("entry_id") == "Läufe"
    return read.filter(~title).unionByName(read.filter(title).distinct())


def _titled(batches):
    import pyarrow as pa
    for i, batch in enumerate(batches):
        if i == 0:
            yield pa.RecordBatch.from_arrays([pa.array(["Läufe"], batch.schema.field(0).type)], schema=batch.schema)
        yield batch


by_value(__name__)


@query("a04_json_ingest", "event_id:long, k:double, outcome:string",
       """SELECT event_id, CASE WHEN NOT json_valid(js) THEN NULL
            ELSE COALESCE(TRY_CAST(NULLIF(json_extract_string(js, '$.k'), '') AS DOUBLE), 0) END AS k,
          CASE WHEN json_valid(js) THEN 'GOOD' ELSE 'QUARANTINE' END AS outcome FROM fx_json""")
def a04(t):
    good, bad = ST.read_json_records(t.fx_json, "js", "k string", {"k": 0.0})
    return good.withColumn("outcome", F.lit("GOOD")).unionByName(
        bad.withColumn("outcome", F.lit("QUARANTINE")), allowMissingColumns=True)


@query("a05_pipe_tables", "doc_id:long, table_no:long, row_no:long, cells:string",
       """SELECT doc_id, DENSE_RANK() OVER (PARTITION BY doc_id ORDER BY grp) AS table_no,
  ROW_NUMBER() OVER (PARTITION BY doc_id, grp ORDER BY pos) - 1 AS row_no,
  array_to_string(list_transform(string_split(trim(trim(line), '|'), '|'), lambda x: trim(x)), '~') AS cells
FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, grp) AS n FROM ck_pipe_rows) q WHERE n >= 2""", heavy=True)
def a05(t):
    return TX.pipe_tables(t.fx_table_text).withColumn("cells", F.array_join("cells", "~"))


@query("a06_keep_latest_upsert", "employee_id:long, entry_id:long, entered_hours:double",
       """SELECT employee_id, entry_id, entered_hours FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY employee_id ORDER BY work_date DESC, src DESC, entry_id DESC) AS rn
  FROM (SELECT employee_id, entry_id, entered_hours, work_date, 0 AS src FROM fx_entry WHERE entry_id % 2 = 0
        UNION ALL SELECT employee_id, entry_id, entered_hours, work_date, 1 FROM fx_entry WHERE entry_id % 2 = 1)
  u) r WHERE rn = 1""")
def a06(t):
    e = t.fx_entry.select("employee_id", "entry_id", "entered_hours", "work_date")
    newest = lambda df: ST.keep_latest(df.limit(0), df, "employee_id", F.struct("work_date", "entry_id"))
    old, new = e.filter("entry_id % 2 = 0"), e.filter("entry_id % 2 = 1")
    return ST.keep_latest(newest(old), newest(new), "employee_id", "work_date")


@query("a07_text_append", "file_id:long, text:string, warnings:string, tables:string",
       """SELECT f.doc_id AS file_id, CASE WHEN f.doc_id % 3 = 0 THEN f.text
    WHEN COALESCE(f.text, '') = '' THEN 'scanned' ELSE trim(CONCAT(f.text, chr(10), chr(10), '[OCR]', chr(10), 'scanned')) END AS text,
  CASE WHEN f.doc_id % 3 = 0 THEN 'old' ELSE 'old,ocr' END AS warnings,
  CASE WHEN f.doc_id % 3 <> 0 AND f.doc_id % 2 = 0 THEN 'new table' ELSE 'old table' END AS tables
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN '' ELSE text END AS text FROM documents) f""")
def a07(t):
    k = F.col("doc_id")
    old = t.documents.select(
        k.alias("file_id"), F.when((k % 5 == 0) & (k % 3 != 0), "").otherwise(F.col("text")).alias("text"),
        F.array(F.lit("old")).alias("warnings"), F.lit("old table").alias("tables"))
    new = t.documents.filter(k % 3 != 0).select(
        k.alias("file_id"), F.lit("scanned").alias("text"), F.array(F.lit("ocr")).alias("warnings"),
        F.when(k % 2 == 0, "new table").alias("tables"))
    return ST.append_text(old, new).withColumn("warnings", F.array_join("warnings", ","))


TRIAGE_SQL = """
SELECT *, CASE WHEN noise THEN 'IGNORED_NOISE' WHEN ext = '.exe' OR ext = '.txt' THEN 'UNSUPPORTED_FILE_TYPE'
    WHEN dup THEN 'DUPLICATE_FILE' ELSE 'DETECTED' END AS processing_status
FROM (SELECT file_id, split_part(rel_path, '/', 2) AS name,
        regexp_extract(split_part(rel_path, '/', 2), '[.][^.]*$') AS ext,
        split_part(rel_path, '/', 2) = 'thumbs.db' AS noise,
        ROW_NUMBER() OVER (PARTITION BY html ORDER BY file_id) > 1 AS dup FROM fx_path) q"""


@query("b01_file_triage", "file_id:long, processing_status:string, file_ext:string, is_noise:long, is_candidate:long",
       f"""SELECT file_id, processing_status, ext AS file_ext,
  CASE WHEN noise OR ext = '.exe' THEN 1 ELSE 0 END AS is_noise,
  CASE WHEN processing_status IN ('DETECTED', 'DUPLICATE_FILE') THEN 1 ELSE 0 END AS is_candidate
FROM ({TRIAGE_SQL}) t""")
def b01(t):
    hashed = FI.mark_duplicates(t.fx_path, F.sha2("html", 256))
    out = FI.triage(hashed, FI.base_name(F.col("rel_path")), F.col("is_duplicate"))
    return out.withColumns({c: F.col(c).cast("int") for c in ("is_noise", "is_candidate")})


@query("b02_candidate_filter", "file_id:long, processing_status:string",
       "SELECT file_id, processing_status FROM fx_file WHERE NOT is_noise AND NOT is_duplicate AND is_candidate")
def b02(t):
    return R.candidates(t.fx_file)


@query("b03_path_metadata", "file_id:long, vendor:string, period_text:string, person:string",
       r"""SELECT file_id, split_part(rel_path, '/', 1) AS vendor,
  NULLIF(regexp_extract(replace(rel_path, '/', ' '),
    '((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[_ -]?[0-9][0-9][0-9][0-9]|[0-9][0-9][0-9][0-9][_-][0-9][0-9])', 1, 'i'), '') AS period_text,
  CASE WHEN regexp_matches(stem, '(^|[^A-Za-z0-9_])[A-Z][A-Za-z''-]+[ ]+[A-Z][A-Za-z''-]+ *$')
    THEN regexp_extract(stem, '([A-Z][A-Za-z''-]+[ ]+[A-Z][A-Za-z''-]+) *$', 1)
    WHEN len(list_filter(string_split(kept, ' '), lambda w: regexp_matches(w, '^[A-Z][A-Za-z''-]+$'))) >= 2
      AND length(kept) > 3 THEN kept END AS person
FROM (SELECT *, array_to_string(list_filter(string_split(regexp_replace(stem, '[_-]+', ' ', 'g'), ' '),
        lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]{1,2}$|^[0-9]{4}$')
         AND lower(w) NOT IN ('jan','feb','april','january','llc','timesheets','timesheet','week','record','hours')), ' ') AS kept
  FROM (SELECT *, regexp_replace(split_part(rel_path, '/', 2), '[.][^.]*$', '') AS stem FROM fx_path) a) b""")
def b03(t):
    return FI.path_metadata(t.fx_path)


@query("e01_hash_dedup", "file_id:long, content_hash:string, is_duplicate:long, duplicate_of:long",
       """SELECT file_id, h AS content_hash, CASE WHEN f < file_id THEN 1 ELSE 0 END AS is_duplicate,
  CASE WHEN f < file_id THEN f END AS duplicate_of
FROM (SELECT file_id, h, CASE WHEN h IS NULL THEN NULL ELSE MIN(file_id) OVER (PARTITION BY h) END AS f
  FROM (SELECT file_id, CASE WHEN file_id % 97 = 5 THEN NULL ELSE sha256(text) END AS h FROM fx_file) a) b""")
def e01(t):
    key = F.when(F.col("file_id") % 97 != 5, F.sha2("text", 256))
    out = FI.mark_duplicates(t.fx_file.drop("is_duplicate"), key)
    return out.withColumn("is_duplicate", F.col("is_duplicate").cast("int"))


@query("i20_duplicate_file", "file_id:long, processing_status:string",
       """SELECT file_id, 'DUPLICATE_FILE' AS processing_status FROM (
  SELECT file_id, ROW_NUMBER() OVER (PARTITION BY text ORDER BY file_id) AS rn FROM fx_file) q WHERE rn > 1""")
def i20(t):
    out = FI.mark_duplicates(t.fx_file.drop("is_duplicate"), F.sha2("text", 256)).filter("is_duplicate")
    return out.withColumn("processing_status", F.lit("DUPLICATE_FILE"))


@query("b09_document_type", "doc_id:long, document_type:string",
       r"""SELECT doc_id, CASE WHEN length(trim(text, ' ')) < 20 THEN 'UNKNOWN_DOCUMENT_NEEDS_REVIEW'
    WHEN yes >= 2 AND yes > no THEN 'TIMESHEET_CANDIDATE'
    WHEN no >= 2 AND no >= yes THEN 'NON_TIMESHEET_DOCUMENT' WHEN yes >= 1 THEN 'TIMESHEET_CANDIDATE'
    ELSE 'UNKNOWN_DOCUMENT_NEEDS_REVIEW' END AS document_type
FROM (SELECT doc_id, text, len(list_filter(w, lambda x: x IN ('hour', 'hours', 'timesheet', 'regular', 'overtime', 'employee', 'approved'))) AS yes,
    len(list_filter(w, lambda x: x IN ('invoice', 'receipt', 'statement')))
      + len(regexp_extract_all(lower(text), '(^|[^a-z0-9_])amount[ ]+due([^a-z0-9_]|$)')) AS no
  FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM fx_kw) a) b""", heavy=True)
def b09(t):
    return t.fx_kw.select("doc_id", FI.document_type(F.col("text")).alias("document_type"))


PROFILE_SQL = """
SELECT doc_id, COUNT(*) FILTER (regexp_matches(line, '^20|^Mon')) AS candidate_rows,
  COUNT(*) FILTER (starts_with(line, 'Week')) AS sections,
  COUNT(*) FILTER (starts_with(line, '20')) AS date_count,
  CAST(MIN(CASE WHEN starts_with(line, '20') THEN substr(line, 1, 10) END) AS VARCHAR) AS first_date,
  CAST(MAX(CASE WHEN starts_with(line, '20') THEN substr(line, 1, 10) END) AS VARCHAR) AS last_date
FROM fx_line GROUP BY doc_id"""


@query("d13_source_profile", "doc_id:long, candidate_rows:long, sections:long, date_count:long, first_date:string, last_date:string",
       PROFILE_SQL, heavy=True)
def d13(t):
    return TX.source_profile(t.fx_line)


@query("d12_extraction_completeness", "doc_id:long, entries:long, completeness_pct:double, incomplete:long",
       f"""SELECT p.doc_id, COALESCE(n, 0) AS entries,
  CASE WHEN candidate_rows > 0 THEN ROUND(COALESCE(n, 0) * 100.0 / candidate_rows, 1) ELSE 100 END AS completeness_pct,
  CASE WHEN candidate_rows > 0 AND COALESCE(n, 0) < candidate_rows * 0.7 THEN 1 ELSE 0 END AS incomplete
FROM ({PROFILE_SQL}) p LEFT JOIN (SELECT employee_id, COUNT(*) AS n FROM fx_entry
  WHERE entry_type = 'WORK' GROUP BY 1) e ON e.employee_id = p.doc_id""", heavy=True)
def d12(t):
    worked = t.fx_entry.filter("entry_type = 'WORK'").withColumn("doc_id", F.col("employee_id"))
    return CO.completeness(TX.source_profile(t.fx_line), worked).withColumn("incomplete", F.col("incomplete").cast("int"))


@query("d15_extraction_score", "doc_id:long, engine:string, score:double",
       "SELECT doc_id, engine, score FROM ck_engine", heavy=True)
def d15(t):
    return scored(t)


def scored(t):
    return t.fx_engine.withColumn("score", FI.extraction_score(
        F.col("text"), F.col("table_rows"), (F.col("confidence_pct") / 100).cast("decimal(6,4)")))


@query("e05_best_engine", "doc_id:long, engine:string, score:double",
       """SELECT doc_id, engine, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id
          ORDER BY score DESC, engine_rank) AS rn FROM ck_engine) q WHERE rn = 1 AND trim(text) <> ''""", heavy=True)
def e05(t):
    return TX.best_engine(scored(t).withColumn("has_text", F.trim("text") != ""))


@query("d16_merged_parts", "doc_id:long, text:string, tables:long, confidence:double",
       """SELECT conv_id AS doc_id, string_agg(NULLIF(text, ''), ' -- ' ORDER BY turn) AS text, SUM(turn % 3) AS tables,
          ROUND(AVG((turn * 7 % 10) / 10.0), 6) AS confidence FROM conversations GROUP BY conv_id""")
def d16(t):
    parts = t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text", (F.col("turn") % 3).alias("tables"),
        (F.col("turn") * 7 % 10 / 10).alias("confidence"))
    return TX.merge_parts(parts, " -- ").withColumn("confidence", F.round("confidence", 6))


@query("e13_text_blocks", "doc_id:long, block_no:long, rule:string, first_line:long, last_line:long, lines:long",
       """SELECT doc_id, block AS block_no, rule, MIN(line_no) FILTER (line <> '') AS first_line,
  MAX(line_no) FILTER (line <> '') AS last_line, COUNT(*) FILTER (line <> '') AS lines
FROM (SELECT *, CASE rule WHEN 'PAGE_BREAK' THEN CASE WHEN chars > 50 AND line <> '=====' THEN page END
        WHEN 'SECTION' THEN NULLIF(sect, 0) ELSE CAST(FLOOR(solid / 60) AS BIGINT) END AS block
  FROM (SELECT *, CASE WHEN COUNT(DISTINCT CASE WHEN chars > 50 THEN page END) OVER (PARTITION BY doc_id) > 1
           THEN 'PAGE_BREAK' WHEN MAX(sect) OVER (PARTITION BY doc_id) > 1 THEN 'SECTION' ELSE 'LINE_COUNT' END AS rule
    FROM (SELECT l.*, chars FROM ck_lines l LEFT JOIN (
        SELECT doc_id, page, length(trim(string_agg(line, chr(10) ORDER BY line_no), chr(10))) AS chars FROM ck_lines
        WHERE line <> '=====' GROUP BY 1, 2) p ON p.doc_id = l.doc_id AND p.page = l.page) a) b) c
WHERE block IS NOT NULL GROUP BY doc_id, block, rule HAVING COUNT(*) FILTER (line <> '') > 0""")
def e13(t):
    return TX.block_summary(TX.segment_lines(t.fx_line))


@query("h32_content_presence", "doc_id:long, sufficient:long",
       r"""SELECT doc_id, CASE WHEN doc_id % 4 > 2 OR (length(trim(text)) >= 80 AND regexp_matches(lower(text),
   '[0-9]{1,2}:[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|(^|[^a-z0-9_])(hours?|hrs?)([^a-z0-9_]|$)'))
   THEN 1 ELSE 0 END AS sufficient FROM fx_kw""", heavy=True)
def h32(t):
    ok = FI.is_sufficient(F.col("text"), F.col("doc_id") % 4)
    return t.fx_kw.select("doc_id", ok.cast("int").alias("sufficient"))


@query("h33_page_mix", "doc_id:long, pages:long, text_pages:long, image_pages:long, avg_chars:long, kind:string",
       """SELECT doc_id, pages, text_pages, pages - text_pages AS image_pages,
  COALESCE(FLOOR(a), 0) AS avg_chars, CASE WHEN text_pages = 0 THEN 'image' WHEN text_pages = pages THEN 'text'
    WHEN text_pages * 10 >= pages * 7 THEN 'text' WHEN (pages - text_pages) * 10 >= pages * 7 THEN 'image'
    ELSE 'mixed' END AS kind
FROM (SELECT doc_id, COUNT(*) AS pages, COUNT(*) FILTER (text_chars >= 30) AS text_pages,
        AVG(text_chars) FILTER (text_chars >= 30) AS a FROM fx_page_fact GROUP BY 1) q""")
def h33(t):
    return FI.page_mix(t.fx_page_fact)


# a fold over each segment's tokens in order: the first seed near enough takes the token, else it becomes a seed
TOKEN_ROWS_SQL = """
WITH RECURSIVE tok AS (SELECT user_id AS page_id, event_id AS token_id, value % 100 AS x, CAST(event_id % 997 AS DOUBLE) AS y,
    CAST(event_id % 5 + 6 AS DOUBLE) AS h FROM events),
med AS (SELECT page_id, list_sort(list(h))[len(list(h)) // 2 + 1] AS m FROM tok WHERE h > 0 GROUP BY 1),
near AS (SELECT t.*, greatest(COALESCE(m, 12.0::DOUBLE) * 0.6::DOUBLE, 4.0::DOUBLE) AS tol, y + h / 2 AS cy, floor(y) AS band FROM tok t LEFT JOIN med USING (page_id)),
bands AS (SELECT page_id, band, MIN(y) AS top, MAX(cy) AS low, MAX(tol) AS tol FROM near GROUP BY 1, 2),
cuts AS (SELECT page_id, band, CASE WHEN top > MAX(low) OVER (PARTITION BY page_id ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + tol
    THEN 1 ELSE 0 END AS cut FROM bands),
parts AS (SELECT page_id, band, SUM(cut) OVER (PARTITION BY page_id ORDER BY band) AS segment FROM cuts),
tokens AS MATERIALIZED (SELECT n.page_id, segment, token_id, cy, tol, ROW_NUMBER() OVER (PARTITION BY n.page_id, segment ORDER BY y, x, token_id) AS k
  FROM near n JOIN parts p ON p.page_id = n.page_id AND p.band = n.band),
fold AS (SELECT page_id, segment, k, token_id, [cy] AS seeds, 0 AS row_no FROM tokens WHERE k = 1
  UNION ALL SELECT page_id, segment, k, token_id, CASE WHEN hit IS NULL THEN list_append(seeds, cy) ELSE seeds END, COALESCE(hit - 1, len(seeds))
  FROM (SELECT t.*, seeds, NULLIF(list_position(list_transform(seeds, lambda s: abs(t.cy - s) <= t.tol), TRUE), 0) AS hit
    FROM fold f JOIN tokens t ON t.page_id = f.page_id AND t.segment = f.segment AND t.k = f.k + 1) q)
SELECT page_id, segment, row_no, token_id FROM fold"""


@query("e14_token_rows", "page_id:long, segment:long, row_no:long, token_id:long", TOKEN_ROWS_SQL, heavy=True)
def e14(t):
    tokens = t.events.select(
        F.col("user_id").alias("page_id"), F.col("event_id").alias("token_id"),
        (F.col("value") % 100).alias("x"), (F.col("event_id") % 997).cast("double").alias("y"),
        (F.col("event_id") % 5 + 6).cast("double").alias("h"))
    return TX.cluster_rows(tokens)

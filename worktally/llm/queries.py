"""Registered queries of this subpackage, with SQL for an independent engine where SQL can state them."""

from pyspark.sql import functions as F

from worktally.llm import importance, jaccard_join, kmeans_tree, language_id, line_dedup, packing, ppm, quality_llr, replication, spelling, suffix_dedup, token_counts, url_rules
from worktally.session import prepare

TOKENIZER = "byte_bpe_50k.tiktoken"
MIX_SEED = 7
#: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
QUALITY_THRESHOLD = -0.06
QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def wrap(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def tokenizer():
    """(file, word pattern) of the public tokenizer; the file has the same path on all hosts."""
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def remainder(m, id_col="doc_id"):
    """crc32 of the id as text, modulo m; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


@query("op1_suffix_dedup")
def op1(spark, t):
    out = suffix_dedup.repeats(t("documents"))
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"]), F.lit(0).cast("long"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_language_id")
def op2(spark, t):
    docs = t("documents").withColumn("held_out", remainder(5) == 0)
    return language_id.predict(docs, language_id.train(docs, ~F.col("held_out")), keep=["doc_id", "held_out"])


@query("op3_ppm_score")
def op3(spark, t):
    out = ppm.score(t("documents"), remainder(7) != 2)
    base = F.col("known_log") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("vocabulary") + 1.0)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")


@query("op4_poisson_mix", f"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, n, (1.0::DOUBLE / (SELECT count(*) FROM c)::DOUBLE) * (SELECT count(*) FROM documents)::DOUBLE / n::DOUBLE AS rate FROM c),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r),
l AS (SELECT source, rate, k, sum(CASE WHEN k > 0 THEN ln(k::DOUBLE) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS logs FROM k),
s AS (SELECT source, rate, k, sum(exp(k * ln(rate) - rate - logs)) OVER (PARTITION BY source ORDER BY k) AS upto FROM l),
d AS (SELECT doc_id, source, lang, n_chars, CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, s.rate, count(*) FILTER (s.upto <= d.u) AS times FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
e AS (SELECT *, unnest(range(1, times + 1)) AS copy FROM n)
SELECT doc_id, source, lang, n_chars, CAST(copy AS INTEGER) AS copy, round(rate, 9) AS rate,
 CAST('0x' || substr(md5('{MIX_SEED}:place:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS place FROM e""")
def op4(spark, t):
    docs = t("documents").select("doc_id", "text", "source", "lang", "n_chars").withColumn("digest", F.md5("text"))
    # the digest is taken again from each copy, so that texts go through the shuffle and none is lost or mixed up
    same = F.md5("text").eqNullSafe(F.col("digest"))
    n_chars = F.when(same, F.col("n_chars")).otherwise(F.raise_error("the text of a copy differs from its document")).alias("n_chars")
    return replication.replicate(docs, MIX_SEED).select("doc_id", "source", "lang", n_chars, "copy", F.round("rate", 9).alias("rate"), "place")


@query("op5_best_fit_pack")
def op5(spark, t):
    return packing.pack_documents(t("documents"), *tokenizer()).withColumnRenamed("id", "doc_id")


@query("op6_kmeans_tree")
def op6(spark, t):
    return kmeans_tree.search(t("embeddings"), lambda c: c % 50 == 0).withColumnRenamed("id", "vec_id")


@query("op7_jaccard_join", """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)""")
def op7(spark, t):
    return jaccard_join.near_duplicates(t("documents")).withColumnRenamed("id", "doc_id")


@query("op8_quality_llr")
def op8(spark, t):
    docs = t("documents").select("doc_id", "text")
    trusted = t("labels").where("quality = 1").select("doc_id")
    return quality_llr.judge(docs, quality_llr.weights(docs, trusted), QUALITY_THRESHOLD).drop("text")


@query("op9_line_dedup", """
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
n AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM n WHERE n > 0),
m AS (SELECT y.doc_id, y.pos, y.i, y.n, x.doc_id AS other, y.i - x.i AS shift FROM b x JOIN b y ON x.line = y.line AND (x.doc_id < y.doc_id OR x.doc_id = y.doc_id AND x.i < y.i)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS run FROM m),
c AS (SELECT doc_id, min(pos) AS a, max(pos) AS z FROM r GROUP BY doc_id, other, shift, run HAVING sum(n) >= 50),
g AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN (SELECT DISTINCT * FROM c) c ON l.doc_id = c.doc_id AND l.pos BETWEEN c.a AND c.z),
o AS (SELECT n.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(sum(n.n) FILTER (g.pos IS NOT NULL), 0) AS words_removed, string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (g.pos IS NULL) AS kept
 FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.pos = n.pos GROUP BY n.doc_id)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed, CAST(words_removed AS INTEGER) AS words_removed, md5(coalesce(kept, '')) AS kept_md5 FROM o""")
def op9(spark, t):
    out = line_dedup.dedup_lines(t("documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "words_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query("op10_url_filter", f"""
WITH r(rh, rp, rv) AS (VALUES {_RULES_SQL}),
u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT p.k, max({{'n': length(rh || rp), 'h': length(rh), 'rule': rh || rp, 'v': rv}}) AS b FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY p.k)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM p LEFT JOIN h USING (k)""")
def op10(spark, t):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(t("pages").select("page_id", "url"), rules).drop("url")


# DuckDB has no CRC: its table of 256 entries and the fold over a text's bytes, as SQL
_CRC_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc_sql(text):
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), "
            f"lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)")


@query("op11_importance_resample", f"""
WITH {_CRC_SQL},
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents),
x AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
v AS (SELECT DISTINCT w FROM (SELECT w FROM w UNION ALL SELECT w FROM x)),
h AS (SELECT w, {_crc_sql('w')} % 10000 AS b FROM v, crc_table),
s AS (SELECT b, count(*) AS s FROM w JOIN h USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM x JOIN h USING (w) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)),
f AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM w JOIN h USING (w) JOIN g USING (b) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN f USING (doc_id)),
e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM e WHERE n_features >= 20) THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)""")
def op11(spark, t):
    out = importance.resample(t("documents"), t("benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query("op12_token_counts")
def op12(spark, t):
    import public_tokenizers
    return token_counts.count_tokens(t("documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096).withColumnRenamed("id", "doc_id")


@query("op13_spelling_variants", f"""
WITH RECURSIVE {_CRC_SQL},
o AS (SELECT doc_id, w, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2),
k AS (SELECT doc_id::VARCHAR || ':' || w AS key, w, times FROM o),
h AS (SELECT w, times, CAST({_crc_sql('key')} AS BIGINT) AS h FROM k, crc_table),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, times FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN (SELECT min(other) FROM near WHERE near.word = words.word AND near.m = best.m) END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
path AS (SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT path.word, forms.form, k + 1 FROM path JOIN forms ON forms.word = path.here WHERE forms.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, (SELECT max_by(here, k) FROM path WHERE path.word = f.word) AS root FROM forms f""")
def op13(spark, t):
    return spelling.variants(t("documents")).select("word", "n", "n_near", "form", "form_n", "root")

"""People: candidate names, exact and containment tiers, similarity, decisions."""

from pyspark.sql import functions as F

from worktally.functions import names as N
from worktally.operators import matching as MA
from worktally.operators.grouping import top_rows
from worktally.plans.registry import query

PROBES_SQL = """
SELECT employee_id AS probe_id, CASE CAST(employee_id % 9 AS INT) WHEN 0 THEN full_name WHEN 1 THEN upper(full_name)
  WHEN 2 THEN split_part(full_name, ' ', 2) WHEN 3 THEN CONCAT(full_name, ' Junior') WHEN 4 THEN email
  WHEN 5 THEN CONCAT(split_part(full_name, ' ', 2), ' ', split_part(full_name, ' ', 1)) WHEN 6 THEN ''
  WHEN 7 THEN CONCAT('Timesheet ', full_name, ' April') ELSE 'Zed Unknown' END AS name FROM {fx_people}"""


def probes_of(t):
    return t.spark.sql(PROBES_SQL, fx_people=people_of(t))


def people_of(t):
    e = t.fx_employee.select("employee_id", "is_active", "email")
    return t.fx_person.join(e, "employee_id")


def roster_of(t):
    return people_of(t).filter("is_active").select("employee_id", "full_name", "email")


def typo_probes(t):
    """Names with one letter dropped or doubled, for every person."""
    n, k = F.col("full_name"), F.col("employee_id")
    cut = (k % 5 + 2).cast("int")
    name = F.when(k % 2 == 0, F.concat(F.substring(n, 1, 1), F.expr("substring(full_name, 3)"))).otherwise(
        F.concat(n.substr(F.lit(1), cut), n.substr(cut, F.lit(80))))
    return t.fx_person.select(k.alias("probe_id"), name.alias("name"))


@query("c09_exact_match", "probe_id:long, employee_id:long, method:string",
       "SELECT probe_id, employee_id, method FROM ck_exact WHERE employee_id IS NOT NULL")
def c09(t):
    clean = probes_of(t).withColumn("name", N.clean_for_matching(F.col("name"))).filter("name <> ''")
    return MA.exact(clean, roster_of(t))


@query("c10_containment_match", "probe_id:long, employee_id:long, confidence:double, method:string",
       "SELECT probe_id, employee_id, confidence, method FROM ck_contained")
def c10(t):
    clean = probes_of(t).withColumn("name", N.clean_for_matching(F.col("name"))).filter("name <> ''")
    return MA.contained(clean, roster_of(t))


@query("c12_match_decision", "probe_id:long, employee_id:long, confidence:double, method:string, match_status:string",
       """SELECT p.probe_id, COALESCE(x.employee_id, c.employee_id) AS employee_id,
  CASE WHEN x.employee_id IS NOT NULL THEN 1 ELSE COALESCE(c.confidence, 0) END AS confidence,
  COALESCE(x.method, c.method, CASE WHEN p.name = '' THEN 'NO_NAME' ELSE 'NO_MATCH' END) AS method,
  CASE WHEN x.employee_id IS NOT NULL OR c.confidence >= 0.85 THEN 'AUTO_MATCHED' WHEN c.confidence >= 0.6 THEN 'NEEDS_REVIEW'
    ELSE 'NOT_MATCHED' END AS match_status
FROM ck_probe p LEFT JOIN ck_exact x ON x.probe_id = p.probe_id LEFT JOIN ck_contained c ON c.probe_id = p.probe_id""")
def c12(t):
    probes = probes_of(t)
    return MA.decide(probes, MA.match(probes, roster_of(t), fuzzy=False))


@query("c12_match_all_tiers", "probe_id:long, employee_id:long, confidence:double, method:string, match_status:string, alternatives:long, next_employee:long, next_score:double", heavy=True)
def c12_all(t):
    probes = probes_of(t)
    decided = MA.decide(probes, MA.match(probes, roster_of(t)))
    following = F.get("alternatives", F.lit(0))
    return decided.select("*", F.coalesce(F.size("alternatives"), F.lit(0)).alias("n"), following["employee_id"].alias("next_employee"),
                          following["score"].alias("next_score")).drop("alternatives").withColumnRenamed("n", "alternatives")


@query("c13_candidate_name", "file_id:long, candidate:string",
       """SELECT file_id, COALESCE(CASE WHEN length(trim(e)) > 2 THEN trim(e) END, CASE WHEN length(detected_name) > 2 THEN detected_name END) AS candidate
          FROM (SELECT file_id, detected_name, CASE file_id % 4 WHEN 0 THEN ' Al ' WHEN 1 THEN '  Greta Costa ' END AS e FROM fx_file) q""")
def c13(t):
    files = t.fx_file.select("file_id", F.col("detected_name").alias("path_name"))
    k = F.col("file_id") % 4
    extracted = t.fx_file.select("file_id", F.when(k == 0, " Al ").when(k == 1, "  Greta Costa ").alias("extracted_name"))
    return MA.candidate_names(files, extracted.filter("extracted_name IS NOT NULL"))


@query("c14_sender_match", "message_id:string, employee_id:long, how:string",
       """SELECT message_id, e.employee_id, 'EMAIL' AS how FROM ck_sender s JOIN fx_employee e ON e.email = s.sender_email AND e.is_active
UNION ALL SELECT message_id, MIN(p.employee_id), 'NAME' FROM ck_sender s JOIN ck_roster p ON p.clean = lower(s.sender_name)
  WHERE s.sender_email NOT IN (SELECT email FROM fx_employee WHERE is_active) GROUP BY 1""")
def c14(t):
    k = F.col("probe_id")
    people = people_of(t).select(F.col("employee_id").alias("probe_id"), "full_name", "email")
    senders = people.select(k.cast("string").alias("message_id"),
                            F.when(k % 3 == 0, F.col("email")).otherwise("other@mail.test").alias("sender_email"),
                            F.when(k % 5 == 0, "").otherwise(F.col("full_name")).alias("sender_name"))
    return MA.match_sender(senders, roster_of(t))


@query("c11_fuzzy_match", "probe_id:long, employee_id:long, confidence:double, alternatives:long", heavy=True)
def c11(t):
    probes = typo_probes(t)
    best = MA.with_alternatives(MA.similar(probes, roster_of(t)))
    named = probes.withColumn("name", F.lower(F.trim("name")))
    return named.join(best, "name").select("probe_id", "employee_id", "confidence", F.size("alternatives").alias("alternatives"))


@query("e06_top_alternatives", "probe_id:long, rank:long, employee_id:long, score:double",
       """SELECT probe_id, rn AS rank, employee_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY probe_id
          ORDER BY score DESC, employee_id) AS rn FROM ck_scores) q WHERE rn BETWEEN 2 AND 6 AND score >= 0.6""")
def e06(t):
    ranked = top_rows(scores_of(t), ["probe_id"], [F.desc("score"), F.asc("employee_id")], 6)
    return ranked.filter("rank >= 2 AND score >= 0.6")


def scores_of(t):
    """Scored candidates: the entries of a submission with a score each."""
    return t.fx_entry.select(F.col("submission_id").alias("probe_id"), F.col("entry_id").alias("employee_id"),
                             (F.col("break_minutes") / 100 + F.col("entered_hours") / 50).cast("decimal(8,4)").alias("score"))


@query("f04_alternatives_cut", "probe_id:long, best:string",
       """SELECT probe_id, string_agg(CAST(employee_id AS VARCHAR), ',' ORDER BY rn) AS best FROM (SELECT *, ROW_NUMBER() OVER (
          PARTITION BY probe_id ORDER BY score DESC, employee_id) AS rn FROM ck_scores) q WHERE rn <= 3 GROUP BY 1""")
def f04(t):
    best = top_rows(scores_of(t), ["probe_id"], [F.desc("score"), F.asc("employee_id")], 3)
    cut = best.groupBy("probe_id").agg(F.array_sort(F.collect_list(F.struct("rank", "employee_id"))).alias("r"))
    return cut.select("probe_id", F.array_join(F.transform("r", lambda x: x.employee_id.cast("string")), ",").alias("best"))


@query("g03_token_overlap", "doc_id:long, subset:long, shared:long",
       """SELECT doc_id, CASE WHEN list_has_all(b, a) THEN 1 ELSE 0 END AS subset, len(list_intersect(a, b)) AS shared
FROM (SELECT p.employee_id AS doc_id, list_distinct(string_split(lower(p.full_name), ' ')) AS a,
  list_distinct(string_split(lower(q.full_name), ' ')) AS b FROM fx_person p JOIN fx_person q
  ON q.employee_id = p.employee_id - CASE WHEN p.employee_id > 56 AND p.employee_id % 2 = 0 THEN 56 WHEN p.employee_id > 8 THEN 8 ELSE 0 END) x""")
def g03(t):
    a = t.fx_person.select(F.col("employee_id").alias("doc_id"), MA.word_set(F.col("full_name")).alias("a"))
    b = t.fx_person.select(F.col("employee_id").alias("k"), MA.word_set(F.col("full_name")).alias("b"))
    d = F.col("doc_id")  # against the person 56 or 8 numbers before: names that share two words or one
    j = a.join(b, d - F.when((d > 56) & (d % 2 == 0), 56).when(d > 8, 8).otherwise(0) == F.col("k"))
    return MA.overlap(j).withColumn("subset", F.col("subset").cast("int"))

"""Messages: scan, flattening, classification, triage and approval; sender fields."""

from pyspark.sql import functions as F

from worktally.functions import rows as RW
from worktally.operators import messages as M
from worktally.plans.registry import query

CONF = "decimal(6,3)"
# subjects of fx_message by number, and what the patterns make of them
RULES_SQL = """
SELECT *, CASE WHEN veto THEN 0 WHEN bare THEN 0 WHEN score >= 0.40 THEN 1 ELSE 0 END AS is_sheet,
  CASE WHEN veto THEN 0.95 WHEN bare THEN 0.70 WHEN score >= 0.40 THEN LEAST(score, 0.95) ELSE GREATEST(0.05, 1 - score) END AS confidence,
  CASE WHEN veto THEN 'VETO' WHEN bare THEN 'NO_ATTACHMENT' WHEN score = 0 THEN 'NO_SIGNAL' ELSE concat_ws(',',
    CASE WHEN s > 0 THEN 'SUBJECT' END, CASE WHEN b > 0 THEN 'BODY' END, CASE WHEN a > 0 THEN 'ATTACHMENT' END) END AS reason
FROM (SELECT *, s + b + a AS score, attachment_name IS NULL AND s + b + a < 0.25 AS bare
  FROM (SELECT *, subject IN ('Invoice 77', 'Newsletter') AS veto,
    CASE WHEN subject IN ('Timesheet for January', 'Weekly hours', 'TS 2024 attached') THEN 0.50 ELSE 0.00 END AS s,
    CASE WHEN body LIKE 'Please find%' THEN 0.25 ELSE 0.00 END AS b,
    CASE WHEN attachment_name = 'sheet.xlsx' OR attachment_mime = 'application/pdf' THEN 0.30 ELSE 0.00 END AS a
    FROM fx_message) x) y"""


def messages_of(t):
    one = F.array(F.struct(F.col("attachment_name").alias("name"), F.col("attachment_mime").alias("mime")))
    none = F.array().cast("array<struct<name:string,mime:string>>")
    return t.fx_message.withColumn("attachments", F.when(F.col("attachment_name").isNull(), none).otherwise(one))


@query("a08_message_scan", "message_id:string, received_day:long",
       """SELECT message_id, received_day FROM fx_message WHERE received_day >= 5 AND received_day < 20
          AND lower(subject) LIKE '%timesheet%'""")
def a08(t):
    return M.in_range(t.fx_message, 5, 20, column="received_day",
                      extra=F.lower("subject").contains("timesheet"))


@query("a09_message_flattening", "message_id:string, body:string, files:string",
       """SELECT message_id, CONCAT('Dear all', CASE WHEN body = '' THEN '' ELSE CONCAT(' ', body) END) AS body,
          COALESCE(attachment_name || '/' || attachment_mime, '') AS files FROM fx_message""")
def a09(t):
    part = lambda mime, name, aid, text: F.struct(
        mime.alias("mime"), name.alias("filename"), aid.alias("attachment_id"), F.lit(10).alias("size"), text.alias("text"))
    lit, none = F.lit, F.lit(None).cast("string")
    parts = F.array(part(lit("text/plain"), lit(""), none, lit("Dear all")), part(lit("text/plain"), lit(""), none, F.col("body")),
                    part(lit("text/html"), lit(""), none, lit("<p>x</p>")),
                    part(F.col("attachment_mime"), F.coalesce("attachment_name", lit("")),
                         F.when(F.col("attachment_name").isNotNull(), "a1"), lit("")))
    flat = M.flatten_parts(t.fx_message.withColumn("parts", parts))
    files = F.array_join(F.transform("attachments", lambda a: F.concat_ws("/", a["name"], a["mime"])), ",")
    return flat.withColumn("files", files)


@query("b10_message_rules", "message_id:string, is_sheet:long, confidence:double, reason:string",
       f"SELECT message_id, is_sheet, confidence, reason FROM ({RULES_SQL}) q")
def b10(t):
    out = M.classify_by_rules(messages_of(t))
    return out.withColumn("is_sheet", F.col("is_sheet").cast("int"))


@query("b11_two_source_blend", "message_id:string, is_sheet:long, confidence:double, method:string",
       f"""SELECT message_id, CASE WHEN decisive THEN is_sheet WHEN model = is_sheet THEN model
    WHEN mconf >= 0.7 THEN model ELSE is_sheet END AS is_sheet,
  CASE WHEN decisive THEN confidence WHEN model = is_sheet THEN LEAST(0.6 * mconf + 0.4 * confidence + 0.1, 1)
    WHEN mconf >= 0.7 THEN mconf ELSE confidence END AS confidence,
  CASE WHEN NOT decisive AND (model = is_sheet OR mconf >= 0.7) THEN 'MODEL' ELSE 'RULE_BASED' END AS method
FROM (SELECT *, confidence >= 0.8 AS decisive, CAST(job_id % 2 AS INT) AS model,
   CAST((job_id * 13 + turn * 7) % 101 AS DECIMAL(6,3)) * 0.01 AS mconf FROM ({RULES_SQL}) r) q""")
def b11(t):
    r = M.classify_by_rules(messages_of(t))
    mconf = (F.col("job_id") * 13 + F.col("turn") * 7) % 101
    yes, conf, method = M.blend(F.col("is_sheet"), F.col("confidence"), F.col("job_id") % 2 == 1,
                                (mconf.cast(CONF) / 100).cast(CONF))
    return r.select("message_id", yes.cast("int").alias("is_sheet"), conf.alias("confidence"), method.alias("method"))


@query("c17_approved_subset", "message_id:string, status:string",
       """SELECT message_id, CASE WHEN stored_status <> 'PENDING_APPROVAL' THEN stored_status WHEN job_id % 2 = 0 THEN 'EXTRACTED'
          ELSE 'SKIPPED' END AS status FROM fx_message""")
def c17(t):
    m = t.fx_message.withColumn("status", F.col("stored_status"))
    return M.approve(m, m.filter("job_id % 2 = 0").select("message_id"))


@query("j10_message_triage", "job_id:long, scanned:long, sheets:long, skipped:long, attachments:long",
       f"""SELECT job_id, COUNT(*) AS scanned, COUNT(*) FILTER (n > 0) AS sheets, COUNT(*) FILTER (n = 0) AS skipped, SUM(n) AS attachments
FROM (SELECT *, CASE WHEN is_sheet = 1 AND attachment_name = 'sheet.xlsx' THEN 1 ELSE 0 END AS n FROM ({RULES_SQL}) r
  WHERE stored_status NOT IN ('EXTRACTED', 'SKIPPED')) q GROUP BY 1""")
def j10(t):
    stored = t.fx_message.select("message_id", F.col("stored_status").alias("status"))
    return M.job_counts(M.triage(messages_of(t), stored))


@query("h29_sender_split", "message_id:string, sender_name:string, sender_email:string",
       """SELECT message_id, CASE WHEN turn % 2 = 0 THEN CONCAT('Person ', job_id) ELSE '' END AS sender_name,
          CONCAT('p', job_id, '@mail.test') AS sender_email FROM fx_message""")
def h29(t):
    return M.with_sender(t.fx_message)


@query("h30_safe_identifier", "message_id:string, ident:string",
       """SELECT message_id, substr(regexp_replace(sender, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 80) AS ident FROM fx_message""")
def h30(t):
    return t.fx_message.select("message_id", RW.safe_identifier(F.col("sender")).alias("ident"))

"""Mail messages: scan, flattening, two-tier classification, triage, approval."""

from functools import reduce

from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import patterns as RX
from worktally.functions.rows import split_sender
from worktally.operators.grouping import computed


def in_range(messages, start, end, column="received_on", extra=None):
    """Messages received in ``[start, end)``, optionally narrowed by another predicate."""
    out = messages.filter((F.col(column) >= start) & (F.col(column) < end))
    return out.filter(extra) if extra is not None else out


def is_document(name):
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [low.endswith(e) for e in P.ATTACHMENT_EXTENSIONS])


def flatten_parts(messages, parts="parts", body_chars=None):
    """Text parts joined (and cut to ``body_chars`` characters if given); named parts become attachments.

    ``parts`` is an array of (mime, filename, attachment_id, size, text).
    """
    named = lambda p: (p.filename != "") & p.attachment_id.isNotNull()
    texts = F.transform(F.filter(F.col(parts), lambda p: ~F.coalesce(named(p), F.lit(False)) & (p.mime == "text/plain") & (p.text != "")),
                        lambda p: p.text)
    files = F.transform(F.filter(F.col(parts), lambda p: F.coalesce(named(p), F.lit(False))),
                        lambda p: F.struct(p.filename.alias("name"), p.mime.alias("mime"), p["size"].alias("size")))
    body = F.array_join(texts, " ")
    return (messages.withColumn("body", body if body_chars is None else F.substring(body, 1, body_chars))
            .withColumn("attachments", files).drop(parts))


def with_sender(messages, column="sender"):
    name, mail = split_sender(F.col(column))
    return messages.withColumns({"sender_name": name, "sender_email": mail})


def classify_by_rules(messages):
    """is_sheet, confidence and reasons from subject, body and attachments (name, mime)."""
    subject, body = F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))
    files = F.coalesce(F.col("attachments"), F.array().cast("array<struct<name:string,mime:string>>"))
    fits = F.exists(files, lambda a: F.coalesce(is_document(a["name"]), F.lit(False))
                    | F.coalesce(a.mime.isin(P.ATTACHMENT_MIMES), F.lit(False)))
    df = computed(messages, _veto=subject.rlike(RX.SUBJECT_NO), _subj=subject.rlike(RX.SUBJECT_YES),
                  _body=body.rlike(RX.BODY_YES), _fits=fits, _none=F.size(files) == 0)
    add = lambda c, w: F.when(F.col(c), F.lit(w).cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)"))
    df = df.withColumn("_score", add("_subj", P.SUBJECT_SCORE) + add("_body", P.BODY_SCORE) + add("_fits", P.ATTACHMENT_SCORE))
    dec = lambda v: F.lit(v).cast("decimal(6,3)")
    s = F.col("_score").cast("decimal(6,3)")
    yes = s >= dec(P.MESSAGE_THRESHOLD)
    bare = F.col("_none") & (s < dec(0.25))
    conf = F.when(yes, F.least(s, dec(0.95))).otherwise(F.greatest(dec(0.05), dec(1) - s))
    reasons = F.array_compact(F.array(F.when(F.col("_subj"), "SUBJECT"), F.when(F.col("_body"), "BODY"),
                                      F.when(F.col("_fits"), "ATTACHMENT")))
    return df.withColumns({
        "is_sheet": ~F.col("_veto") & ~bare & yes,
        "confidence": F.when(F.col("_veto"), dec(P.VETO_CONFIDENCE)).when(bare, dec(P.NO_ATTACHMENT_CONFIDENCE)).otherwise(conf),
        "reason": F.when(F.col("_veto"), "VETO").when(bare, "NO_ATTACHMENT")
        .when(F.size(reasons) == 0, "NO_SIGNAL").otherwise(F.array_join(reasons, ","))}).drop(
        "_veto", "_subj", "_body", "_fits", "_none", "_score")


def blend(rule_yes, rule_conf, model_yes, model_conf):
    """(is_sheet, confidence, method) of the rule tier and a model's scores."""
    dec = lambda v: F.lit(v).cast("decimal(6,3)")
    mixed = F.least(model_conf * dec(0.6) + rule_conf * dec(0.4) + dec(0.1), dec(1))
    rules = (rule_conf >= dec(P.DECISIVE_CONFIDENCE)) | model_conf.isNull()
    agree = ~rules & (model_yes == rule_yes)
    model = ~rules & ~agree & (model_conf >= dec(P.MODEL_OVERRIDE))
    return (F.when(agree | model, model_yes).otherwise(rule_yes),
            F.when(agree, mixed).when(model, model_conf).otherwise(rule_conf).cast("decimal(8,4)"),
            F.when(agree | model, "MODEL").otherwise("RULE_BASED"))


def triage(new, stored):
    """Classifies messages not processed before and sets their next status.

    ``stored`` holds earlier messages by id; EXTRACTED and SKIPPED ones are not touched again.
    """
    done = stored.filter(F.col("status").isin("EXTRACTED", "SKIPPED")).select("message_id").distinct()
    fresh = classify_by_rules(new.join(done, "message_id", "left_anti"))
    saved = F.size(F.filter(F.coalesce(F.col("attachments"), F.array().cast("array<struct<name:string,mime:string>>")),
                            lambda a: F.coalesce(is_document(a["name"]), F.lit(False))))
    return (fresh.withColumn("saved", F.when(F.col("is_sheet"), saved).otherwise(0))
            .withColumn("status", F.when(F.col("saved") > 0, "PENDING_APPROVAL").otherwise("SKIPPED"))
            .withColumn("skip_reason", F.when(~F.col("is_sheet"), "NOT_A_TIMESHEET")
                        .when(F.col("saved") == 0, "NO_DOCUMENT")))


def job_counts(triaged):
    return triaged.groupBy("job_id").agg(
        F.count("*").alias("scanned"), F.count_if(F.col("status") == "PENDING_APPROVAL").alias("sheets"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"), F.sum("saved").alias("attachments"))


def approve(messages, approved):
    """Approved pending messages become EXTRACTED, other pending ones SKIPPED, the rest stay."""
    pending = messages.filter("status = 'PENDING_APPROVAL'")
    taken = pending.join(approved, "message_id", "left_semi").withColumn("status", F.lit("EXTRACTED"))
    left = pending.join(approved, "message_id", "left_anti").withColumn("status", F.lit("SKIPPED"))
    return taken.unionByName(left).unionByName(messages.filter("status <> 'PENDING_APPROVAL' OR status IS NULL"))

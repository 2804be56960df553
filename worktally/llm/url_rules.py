"""Judges urls by host and path prefix rules, with a sorted sweep.

A host is reversed label by label, so that a host and all its subdomains share a prefix; a rule (host, path) fits the keys
``reversed host, separator, path...`` of the url's host and of each host above it. Those keys are an interval, from the
rule's key up to the key with a last byte 0xFF, and intervals of one host nest. In key order, a rule's start makes it the
active one and its end hands over to the rule it lies in; the active rule is the top of the stack of open rules. A url's
key takes the active rule, and of the hosts above it the longest rule wins.

The sweep runs over different (host, path) pairs, by rule host. A host with many pairs is cut in parts by a hash, each
with the rules of that host: no part exceeds about ``PART`` pairs, whatever share of urls lies under one host.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

PART = 1 << 18
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """(host, path): the part after the first ``://`` up to / ? # or end, A-Z lower-cased; then up to ? # or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _key(host, path):
    return F.concat(F.encode(F.array_join(F.reverse(F.split(host, "\\.")), "."), "UTF-8"), F.lit(b"\x00"), F.encode(path, "UTF-8"))


def judge(pages, rules, url_col="url", default="allow"):
    """The columns of ``pages`` with host, path, rule and verdict (columns of these names are replaced).

    ``rules`` is a DataFrame (host, path, verdict). A rule fits a host that equals its own or ends in ``.`` and it, if
    the path starts with the rule's. The longest text host + path wins, then the longer host. rule is that text, or null
    and the verdict ``default``. Of rules that are alike the smallest verdict counts. A null url, or one without ``://``, has an
    empty host and path.
    """
    rules = (rules.groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.min("verdict").alias("verdict")))
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(url)
    added = ("host", "path", "rule", "verdict")
    pages = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in added]).alias("row"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    # the rule that a rule lies in: the longest other one of its host whose path is a beginning of its path
    begins = rules.select("host", F.col("path").alias("inner"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).where(F.col("n") < F.length("inner"))
    outer = (begins.select("host", "inner", F.expr("substring(inner, 1, n)").alias("path")).join(rules.select("host", "path"), ["host", "path"])
             .groupBy("host", F.col("inner").alias("path")).agg(F.max_by("path", F.length("path")).alias("outer")))
    rules = rules.join(outer, ["host", "path"], "left")
    # every host a url's host lies in, itself included
    pairs = pages.select("host", "path").distinct()
    label = F.split("host", "\\.")
    above = pairs.select("host", "path", F.explode(F.sequence(F.lit(1), F.size(label))).alias("k")).select(
        "host", "path", F.array_join(F.slice(F.split("host", "\\."), F.col("k"), F.lit(2**31 - 1) - F.col("k")), ".").alias("at"))
    # a hot host's pairs meet its rules under several salts, and are then dealt to its parts
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    above = above.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    above = above.join(rules.select(F.col("host").alias("at")).distinct().select("at", salts), ["at", "salt"])
    parts = above.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    none = F.lit(None)
    urls = above.join(parts.select("at", "parts", salts), ["at", "salt"]).select("at", F.pmod(F.xxhash64(F.lit(1), "host", "path"), "parts").cast("int").alias("part"), _key(F.col("at"), F.col("path")).alias("key"),
                                          F.lit(1).alias("turn"), "host", "path", none.cast("string").alias("open"))
    held = rules.join(parts, rules.host == parts["at"]).select("host", "path", "outer", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = _key(F.col("host"), F.col("path"))
    edge = lambda key, turn, rule: held.select(F.col("host").alias("at"), "part", key.alias("key"), F.lit(turn).alias("turn"),
                                               none.cast("string").alias("host"), none.cast("string").alias("path"), rule.alias("open"))
    # "open": the path of the active rule after a "/"-independent mark; "-" is no rule
    mark = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    events = urls.unionByName(edge(own, 0, mark(F.col("path")))).unionByName(edge(F.concat(own, F.lit(b"\xff")), 2, mark(F.col("outer")))).repartition("at", "part")
    sweep = Window.partitionBy("at", "part").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = events.withColumn("open", F.last("open", ignorenulls=True).over(sweep)).where("turn = 1 AND open LIKE '+%'")
    hit = active.select("host", "path", "at", F.expr("substring(open, 2)").alias("begin")).join(
        rules.select(F.col("host").alias("at"), F.col("path").alias("begin"), "verdict"), ["at", "begin"])
    best = hit.groupBy("host", "path").agg(F.max(F.struct((F.length("at") + F.length("begin")).alias("n"), F.length("at").alias("h"), F.concat("at", "begin").alias("rule"), "verdict")).alias("b"))
    return pages.join(best, ["host", "path"], "left").select("row.*", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))

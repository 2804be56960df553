"""Matching extracted names to the roster: exact, token containment, similarity, decision."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import names as N
from worktally.functions.similarity import CHARS, SURE, Names, Roster, likeness, upper_bounds
from worktally.session import by_value
from worktally.sources.stages import staged

PROBE_BLOCK = 20000  # distinct probes per similarity call
ROSTER_BLOCK = 512   # roster names per similarity call at least; rounded up to a power of two
BLOCKS = 50          # blocks of the roster; a larger one has larger blocks, of ``MOST_BLOCK`` names at most
MOST_BLOCK = 16383
FACT_ROWS = 1024     # names of a block described together
MOST_PARTS = 256
FIRST = 2            # blocks a name is compared with before the others
TOP = 6


def candidate_names(files, extracted):
    """Extracted name when longer than two characters, else the one from the path."""
    out = files.join(extracted.select("file_id", "extracted_name"), "file_id", "left")
    return out.withColumn("candidate", F.coalesce(N.usable(F.col("extracted_name")),
                                                  F.when(F.length("path_name") > 2, F.col("path_name"))))


def word_set(text):
    return F.array_sort(F.array_distinct(N.words(F.lower(text))))


def exact(probes, roster):
    """Full name, address or cleaned name equal (case folded).

    Keys of the roster are reduced to their first employee before the join, so a name held by many
    employees joins one row.
    """
    low = lambda c: F.lower(F.trim(c))
    keys = F.array(F.struct(low(F.col("full_name")).alias("key"), F.lit(1).alias("rank"), F.lit("EXACT").alias("method")),
                   F.struct(F.lower("email").alias("key"), F.lit(2).alias("rank"), F.lit("EMAIL_EXACT").alias("method")),
                   F.struct(F.lower(N.clean_for_matching(F.col("full_name"))).alias("key"), F.lit(3).alias("rank"),
                            F.lit("EXACT_CLEANED").alias("method")))
    first = (roster.select("employee_id", F.inline(keys)).filter("key IS NOT NULL AND key <> ''")
             .groupBy("key").agg(F.min(F.struct("employee_id", "rank", "method")).alias("w")))
    hit = probes.join(first, low(F.col("name")) == F.col("key"))
    return hit.select("probe_id", F.col("w.employee_id").alias("employee_id"), F.lit(1.0).alias("confidence"),
                      F.col("w.method").alias("method"))


def contained(probes, roster):
    """Token containment either way; the first employee in roster order wins. One row per probe that has one.

    Names are reduced to different word sets, those of the roster with their first employee. An inverted index
    holds every word of every set; a set asks it for its rarest word only, as whatever contains the set holds that word
    too. So one join serves both directions and names of any length, and pairs form only under a set's rarest word.
    A set of one word needs no pairs at all: the first employee of the word, and of the sets of that word alone, answer it.
    """
    p = probes.select("probe_id", word_set(F.col("name")).alias("words")).filter(F.size("words") > 0)
    p = staged(p, "probe-words")
    names = roster.select("employee_id", word_set(F.col("full_name")).alias("words")).filter(F.size("words") > 0)
    sets = p.select("words").distinct().select("words", F.lit(True).alias("asks"), F.lit(None).cast("long").alias("employee_id"))
    sets = staged(sets.unionByName(names.groupBy("words").agg(F.min("employee_id").cast("long").alias("employee_id"), F.lit(False).alias("asks"))), "word-sets")
    index = sets.select("words", "asks", "employee_id", F.explode("words").alias("word"))
    counts = index.groupBy("word").agg(F.count("*").alias("c"), F.min("employee_id").alias("first"))
    # the rarest word of a set; for single words also the first employee who has it
    anchor = index.join(counts, "word").groupBy("words", "asks").agg(
        F.min_by(F.struct("word", "employee_id", "first"), F.struct("c", "word")).alias("a"))
    anchor = anchor.select(F.col("words").alias("part"), F.col("asks").alias("part_asks"), "a.*").withColumnRenamed("employee_id", "part_id")
    anchor = staged(anchor, "anchors")
    single = (F.size("part") == 1) & F.col("part_asks")
    direct = anchor.filter(single & F.col("first").isNotNull()).select(
        F.col("part").alias("words"), F.struct(F.col("first").alias("employee_id"), F.lit(1).alias("rank"), F.lit(None).cast("int").alias("m")).alias("w"))
    pairs = anchor.filter(~single).join(index, "word").filter(
        (F.col("asks") != F.col("part_asks")) & (F.size("part") <= F.size("words")) & (F.size(F.array_except("part", "words")) == 0))
    of = lambda words, who, rank, m: F.struct(words.alias("words"), F.struct(who.alias("employee_id"), F.lit(rank).alias("rank"), m.alias("m")).alias("w"))
    # a probe inside a name, or a name inside a probe
    pairs = pairs.select(F.when(F.col("part_asks"), of(F.col("part"), F.col("employee_id"), 1, F.lit(None).cast("int")))
                         .otherwise(of(F.col("words"), F.col("part_id"), 2, F.size("part"))).alias("x")).select("x.*")
    best = direct.unionByName(pairs).groupBy("words").agg(F.min("w").alias("w"))
    out = p.join(best, "words").select("probe_id", F.size("words").alias("n"), "w.*")
    inside = F.col("rank") == 1
    conf = F.when(inside, F.least(F.lit(0.95), 0.70 + 0.05 * F.col("n"))).otherwise(
        F.least(F.lit(0.90), 0.65 + 0.05 * F.col("m")))
    return out.select("probe_id", "employee_id", F.round(conf, 4).alias("confidence"),
                      F.when(inside, "PARTIAL_SUBSET").otherwise("PARTIAL_SUPERSET").alias("method"))


def overlap(pairs, a="a", b="b"):
    """Adds subset (all words of ``a`` are in ``b``) and shared, the number of words both have."""
    return pairs.withColumns({"subset": F.size(F.array_except(a, b)) == 0, "shared": F.size(F.array_intersect(a, b))})


def similar(probes, roster):
    """The best employees by similarity for every distinct probe name, exact over the whole roster.

    The roster is dealt into blocks of names with like characters, and each thousand rows of a block are described by the most of
    each character and the least lengths in them: short rows, which every task knows. They bound the score of a
    name with any row of a block. A name is first compared with the blocks of which a part's mean is most like it, by whole
    strings; its ``TOP``-th best ratio there is a floor, and the blocks whose bound reaches it are compared in full, along
    tries that leave off where the floor is out of reach (``similarity.Trie``). What a block is asked is
    dealt to calls of a bounded number of names. Names unlike all others have a low floor and ask many blocks.
    """
    names = probes.select(F.lower(F.trim("name")).alias("name")).filter("name <> ''").distinct()
    names = staged(names, "open-names")  # read again without redoing the tiers before
    people = roster.select("employee_id", "full_name", N.clean_for_matching(F.col("full_name")).alias("cleaned")).filter("full_name IS NOT NULL")
    rows = people.count()
    bits = max(min(-(-rows // BLOCKS), MOST_BLOCK), ROSTER_BLOCK).bit_length()  # of the number within a block
    like = F.array_join(F.reverse(F.array_sort(F.split(F.lower("full_name"), ""))), "")
    parts = max(1, min(MOST_PARTS, rows >> bits))
    people = people.withColumn("_like", like).repartitionByRange(parts, "_like", "employee_id").sortWithinPartitions("_like", "employee_id").drop("_like")
    people = staged(people.withColumn("block", F.shiftright(F.monotonically_increasing_id(), bits)), "roster-blocks")
    facts = people.groupBy("block").applyInPandas(_block_facts, "block long, part int, counts binary, mean binary, least array<long>").orderBy("block", "part").toPandas()
    weight, top = P.PARTIAL_WEIGHT, TOP
    tasks = max(4 * names.sparkSession.sparkContext.defaultParallelism, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids, begin = np.unique(facts["block"].to_numpy(), return_index=True)
    counts = np.frombuffer(b"".join(facts["counts"]), np.int16).reshape(len(facts), CHARS)
    mean = np.frombuffer(b"".join(facts["mean"]), np.float32).reshape(len(facts), CHARS)
    least = np.array(facts["least"].tolist(), np.int64).reshape(len(facts), 3)

    def ask(batches):
        for batch in batches:
            for a in range(0, len(batch) if len(ids) else 0, 256):
                pdf = batch.iloc[a:a + 256]
                these = Names(pdf["name"])
                if "floor" in pdf:
                    bound = np.maximum.reduceat(upper_bounds(these, counts, least, weight), begin, axis=1)
                    at, to = np.nonzero(bound >= pdf["floor"].to_numpy()[:, None] - SURE)
                else:
                    first = np.argsort(-np.maximum.reduceat(likeness(these, mean), begin, axis=1), axis=1, kind="stable")[:, :FIRST]
                    at, to = np.repeat(np.arange(len(pdf)), first.shape[1]), first.ravel()
                yield pd.DataFrame({"name": pdf["name"].to_numpy()[at], "floor": pdf["floor"].to_numpy()[at] if "floor" in pdf else -1.0, "block": ids[to]})

    def score(lhs, rhs, windows):
        if lhs.empty or rhs.empty:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("name", object), ("employee_id", "int64"), ("score", "float64"))})
        block = Roster(rhs["employee_id"], rhs["full_name"], rhs["cleaned"], weight)
        out = []
        for a in range(0, len(lhs), 4096):
            some = lhs.iloc[a:a + 4096]
            at, who, value = block.best(Names(some["name"]), top, some["floor"], windows)
            out.append(pd.DataFrame({"name": some["name"].to_numpy()[at], "employee_id": who, "score": value}))
        return pd.concat(out)

    def compared(rows, label, windows):
        asks = staged(rows.repartition(tasks).mapInPandas(ask, "name string, floor double, block long"), label)
        calls = staged(asks.groupBy("block").agg(F.ceil(F.count("*") / PROBE_BLOCK).cast("int").alias("calls")), f"{label}-calls")
        dealt = asks.join(calls, "block").withColumn("call", F.pmod(F.xxhash64("name"), F.col("calls")).cast("int")).drop("calls")
        held = people.join(calls, "block").withColumn("call", F.explode(F.sequence(F.lit(0), F.col("calls") - 1))).drop("calls")
        dealt, held = (x.repartition(tasks, "block", "call") for x in (dealt, held))  # few bytes, much work: not to be coalesced
        return dealt.groupBy("block", "call").cogroup(held.groupBy("block", "call")).applyInPandas(lambda lhs, rhs: score(lhs, rhs, windows), "name string, employee_id long, score double")

    def ranked(scored):
        """At most ``TOP`` rows per name and block asked."""
        best = scored.groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "employee_id"))).alias("r"))
        return best.select("name", F.slice("r", 1, TOP).alias("r"))

    seen = ranked(compared(names, "first-blocks", windows=False))
    floor = F.when(F.size("r") == TOP, -F.get("r", F.lit(TOP - 1))["s"]).otherwise(-1.0)
    found = ranked(compared(seen.select("name", floor.alias("floor")), "open-blocks", windows=True))
    return found.select("name", F.transform("r", lambda x: F.struct(x.employee_id.alias("employee_id"), (-x.s).alias("score"))).alias("ranked"))


def _block_facts(pdf):
    """The most and the mean number of each character and the least lengths (cleaned: -1 if all are empty) in each part of a block."""
    block = Roster(pdf["employee_id"], pdf["full_name"], pdf["cleaned"], 1.0)
    begin = np.arange(0, len(pdf), FACT_ROWS)
    counts, least = block.facts(begin)
    mean = np.add.reduceat(block.counts.astype(np.float32), begin) / np.diff(np.append(begin, len(pdf)))[:, None].astype(np.float32)
    return pd.DataFrame({"block": pdf["block"].iloc[0], "part": np.arange(len(begin)), "counts": [c.tobytes() for c in counts],
                         "mean": [m.tobytes() for m in mean.astype(np.float32)], "least": least.tolist()})


def with_alternatives(scored, keep=5, threshold=P.REVIEW_MATCH):
    """Best employee and the next ranks at or above the review threshold."""
    rest = F.filter(F.slice("ranked", 2, TOP - 1), lambda x: x.score >= threshold)
    return scored.select("name", F.col("ranked")[0]["employee_id"].alias("employee_id"),
                         F.round(F.col("ranked")[0]["score"], 4).alias("confidence"),
                         F.slice(rest, 1, keep).alias("alternatives"))


ALTERNATIVES = "array<struct<employee_id: bigint, score: double>>"


def match(probes, roster, fuzzy=True):
    """All tiers in order; each sees only the probes the tiers before it left open. One row per matched probe.

    The probes travel as one frame: a tier writes them with its answers, the next reads those without one. alternatives
    holds the ranks after the best of the similarity tier, null for others.
    """
    none = F.lit(None).cast(ALTERNATIVES).alias("alternatives")
    columns = ["probe_id", "employee_id", "confidence", "method", "alternatives"]
    clean = probes.select("probe_id", N.clean_for_matching(F.col("name")).alias("name")).filter("name <> ''")
    clean = staged(clean, "clean-names")
    answered = lambda rows, tier: staged(rows.join(tier, "probe_id", "left"), "tier")
    first = answered(clean, exact(clean, roster))
    open_1 = first.filter("employee_id IS NULL").select("probe_id", "name")
    second = answered(open_1, contained(open_1, roster)) if fuzzy else contained(open_1, roster)
    out = first.unionByName(second, allowMissingColumns=True).filter("employee_id IS NOT NULL").withColumn("alternatives", none).select(*columns)
    if fuzzy:
        open_2 = second.filter("employee_id IS NULL").select("probe_id", "name")
        best = with_alternatives(similar(open_2, roster)).filter("confidence > 0")
        third = open_2.withColumn("name", F.lower(F.trim("name"))).join(best, "name")
        out = out.unionByName(third.select("probe_id", "employee_id", "confidence", F.lit("FUZZY").alias("method"), F.col("alternatives").cast(ALTERNATIVES).alias("alternatives")))
    return out


def decide(probes, matches, auto=P.AUTO_MATCH, review=P.REVIEW_MATCH):
    """AUTO_MATCHED, NEEDS_REVIEW or NOT_MATCHED with the method for every probe."""
    out = probes.join(matches, "probe_id", "left")
    conf = F.coalesce("confidence", F.lit(0.0))
    status = F.when(conf >= auto, "AUTO_MATCHED").when(conf >= review, "NEEDS_REVIEW").otherwise("NOT_MATCHED")
    named = N.usable(F.col("name")).isNotNull()
    cleaned = N.clean_for_matching(F.col("name")) != ""
    method = (F.when(F.col("method").isNotNull(), F.col("method")).when(~named | F.col("name").isNull(), "NO_NAME")
              .when(~cleaned, "EMPTY_AFTER_CLEAN").otherwise("NO_MATCH"))
    return out.withColumns({"match_status": status, "method": method, "confidence": conf,
                            "employee_id": F.when(conf >= review, F.col("employee_id"))})


def match_sender(messages, roster, threshold=P.SENDER_MATCH, fuzzy=True):
    """Employee of a sender: address first, else the name at or above the threshold."""
    mails = roster.filter("email IS NOT NULL").groupBy(F.lower("email").alias("sender_email")).agg(
        F.min("employee_id").alias("employee_id"))
    known = staged(messages.join(mails, "sender_email", "left"), "senders")
    by_mail = known.filter("employee_id IS NOT NULL")
    probes = known.filter("employee_id IS NULL AND sender_name <> ''").select(F.col("message_id").alias("probe_id"), F.col("sender_name").alias("name"))
    found = match(probes, roster, fuzzy).filter(F.col("confidence") >= threshold)
    by_name = found.select(F.col("probe_id").alias("message_id"), "employee_id", F.lit("NAME").alias("how"))
    return by_mail.select("message_id", "employee_id", F.lit("EMAIL").alias("how")).unionByName(by_name)


by_value(__name__)

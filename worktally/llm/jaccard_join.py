"""Near-duplicate documents by Jaccard similarity of word n-grams, joined with signature trees.

1. A block of documents asks, for each different shingle, in how many sets it occurs. Two documents of similarity t share
   a shingle among the first n - ceil(t n) + 1 of each in any common order; the order here is (frequency class, hash), so
   shared passages come last. A set with less than t of its shingles in other sets links with none (exact).
2. Equal sets are one class. For each shingle in a prefix, the least class that has it is its *hub*: classes that share
   a prefix shingle share a hub, so every pair that may link meets under a hub. A pair (hub, class) is compared at once.
3. What is left are pairs under a hub of which one did not link with it (a *stray*). Strays and members go to tasks of
   bounded size (a large hub is cut on both sides), and each task joins two signature trees: a node holds the OR of its
   sets' bitmaps and their size range, and a pair of nodes is dropped when sizes cannot fit, when the common bits allow
   too few common shingles, or when all below is one component already. Only links found leave a task.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktally.llm import blocks as B
from worktally.llm.components import components
from worktally.session import shared_folder

BITS = 2048
FANOUT = 8
STRAYS, MEMBERS = 256, 1024  # sets of each kind in one task


def shingle_sets(data, starts, ends, width):
    """(hashes, offsets): the different shingles of each document ascending; fewer words than ``width`` make one shingle."""
    at, lens, doc = B.words(data, starts, ends)
    w = B.hash_words(data, at, lens)
    n_words = np.bincount(doc, minlength=len(starts))
    first = np.cumsum(n_words) - n_words
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    begin = np.cumsum(n) - n
    pos = B.spans(first, n)  # word where each shingle starts
    size = np.repeat(np.minimum(n_words, width), n)
    h = np.zeros(len(pos), np.uint64)
    for k in range(width):
        there = size > k
        h[there] = B.mix(h[there] * np.uint64(0xA0761D6478BD642F) + w[pos[there] + k])
    h = B.mix(h + size.astype(np.uint64))
    for i, j in zip(begin.tolist(), (begin + n).tolist(), strict=True):
        h[i:j].sort()
    new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    new[begin[n > 0]] = True
    per = np.add.reduceat(new, begin[n > 0]) if len(h) else n[:0]
    out = np.zeros(len(starts) + 1, np.int64)
    counts = np.zeros(len(starts), np.int64)
    counts[n > 0] = per
    out[1:] = np.cumsum(counts)
    return h[new], out


def _fingerprints(h, off):
    """Two 64-bit sums that tell sets apart."""
    a = np.append(np.uint64(0), np.cumsum(B.mix(h), dtype=np.uint64))
    b = np.append(np.uint64(0), np.cumsum(B.mix(h ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64))
    return (a[off[1:]] - a[off[:-1]]).view(np.int64), (b[off[1:]] - b[off[:-1]]).view(np.int64)


class _Node:
    __slots__ = ("bits", "extra", "low", "high", "kids", "item", "label")


def signature_tree(items):
    """Tree over (label, n, shared shingles, key) items; neighbours are alike because they are ordered by label and least hash."""
    level = []
    for i, (label, n, shingles, _) in enumerate(items):
        x = _Node()
        mask = np.zeros(BITS, np.uint8)
        mask[(shingles.view(np.uint64) % np.uint64(BITS)).astype(np.int64)] = 1
        x.bits = int.from_bytes(np.packbits(mask).tobytes(), "big")
        x.extra, x.low, x.high, x.kids, x.item, x.label = len(shingles) - int(mask.sum()), n, n, (), i, label
        level.append(x)
    while len(level) > 1:
        up = []
        for k in range(0, len(level), FANOUT):
            kids = level[k:k + FANOUT]
            x = _Node()
            x.bits = 0
            for y in kids:
                x.bits |= y.bits
            x.extra = max(y.extra for y in kids)
            x.low, x.high = min(y.low for y in kids), max(y.high for y in kids)
            x.kids, x.item = kids, None
            x.label = kids[0].label if all(y.label is not None and y.label == kids[0].label for y in kids) else None
            up.append(x)
        level = up
    return level[0]


def tree_links(strays, members, percent):
    """Links (i, j) that join components of strays and members; items as for ``signature_tree``, label equal: joined already."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets = {}

    def members_of(side, k, items):
        if (side, k) not in sets:
            sets[side, k] = frozenset(items[k][2].tolist())
        return sets[side, k]

    found, stack = [], [(signature_tree(strays), signature_tree(members))]
    while stack:
        a, b = stack.pop()
        if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
            continue
        if a.label is not None and b.label is not None and find(a.label) == find(b.label):
            continue
        if (100 + percent) * ((a.bits & b.bits).bit_count() + min(a.extra, b.extra)) < percent * (a.low + b.low):
            continue
        if a.kids and (not b.kids or a.high - a.low >= b.high - b.low):
            stack.extend((x, b) for x in a.kids)
        elif b.kids:
            stack.extend((a, y) for y in b.kids)
        else:
            x, y = strays[a.item], members[b.item]
            if x[3] == y[3]:
                continue
            same = len(members_of(0, a.item, strays) & members_of(1, b.item, members))
            if 100 * same >= percent * (x[1] + y[1] - same):
                found.append((a.item, b.item))
                parent[find(x[0])] = find(y[0])
    return found


def near_duplicates(docs, id_col="doc_id", text_col="text", width=5, percent=80, block_bytes=B.BLOCK_BYTES):
    """One row per input row: id, n_shingles, component_id (least id reachable by links, its own included).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; two documents link when
    100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles. A text of fewer words is one
    shingle; without words or with null text the set is empty and links with nothing. Rows of equal sets are linked,
    rows with equal ids but different texts are told apart, and a null id is larger than all others (component_id is
    null if only null ids are reached). Shingles are compared by 64-bit hashes. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows, _, size = B.deal(docs, id_col, text_col, block_bytes)
    bits = B.bucket_bits(size / 6, 1 << 19)

    def look(table):
        ids, data, starts, ends = B.texts(table)
        h, off = shingle_sets(B.lower(data), starts, ends, width)
        fa, fb = _fingerprints(h, off)
        order = np.lexsort((fb, fa))
        new = np.append(True, (fa[order][1:] != fa[order][:-1]) | (fb[order][1:] != fb[order][:-1])) if len(order) else np.zeros(0, bool)
        one = np.zeros(len(ids), bool)
        one[order[new]] = True  # one document of each set
        one &= off[1:] > off[:-1]
        mine = h[B.spans(off[:-1][one], np.diff(off)[one])]
        return ids, h, off, fa, fb, one, mine

    def uniq(mine):
        s = np.sort(mine)
        at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        return s[at], np.diff(np.append(at, len(s)))

    def ask(table):
        block = table.column("block")[0].as_py()
        h, n = uniq(look(table)[-1])
        n = np.minimum(n, 255).astype(np.uint8)
        return B.asked([(k, block, B.pack40(h[i:j], bits) + n[i:j].tobytes()) for k, i, j in B.cut(h, bits)])

    def classes(table):
        bucket, got = table.column("bucket")[0].as_py(), B.bodies(table)
        n = [len(x) // 6 for _, x in got]
        h = np.concatenate([B.unpack40(x, k) for (_, x), k in zip(got, n, strict=True)])
        c = np.concatenate([np.frombuffer(x, np.uint8, offset=5 * k) for (_, x), k in zip(got, n, strict=True)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
        level = np.frexp(np.add.reduceat(c[order], at).astype(np.float64))[1].astype(np.uint8)  # 1: in one set, 2: in two or three, ...
        out = np.empty(len(h), np.uint8)
        out[order] = np.repeat(level, np.diff(np.append(at, len(h))))
        ends = np.cumsum(n)
        return B.asked([(bucket, g, out[e - k:e].tobytes()) for (g, _), k, e in zip(got, n, ends, strict=True)])

    def prefixes(table, replies):
        ids, h, off, fa, fb, one, mine = look(table)
        got = B.answers(replies)
        keys, _ = uniq(mine)
        level = np.zeros(len(keys), np.uint8)
        for k, i, j in B.cut(keys, bits):
            level[i:j] = np.frombuffer(got[k], np.uint8)
        of = level[B.Index(keys)(mine)] if len(keys) else level
        tokens, shared = [None] * len(ids), [None] * len(ids)
        n_all, at = np.diff(off), 0
        for d in np.flatnonzero(one).tolist():
            n = int(n_all[d])
            f, s = of[at:at + n], mine[at:at + n]
            at += n
            many = f > 1
            if 100 * int(many.sum()) >= percent * n:
                take = n + (-percent * n // 100) + 1
                first = np.lexsort((s, f))[:take]
                tokens[d] = s[first[f[first] > 1]].view(np.int64)
                shared[d] = s[many].view(np.int64)
        none = pa.array([x is None for x in tokens], pa.bool_()) if len(ids) else None

        def lists(parts):
            lens = np.array([0 if x is None else len(x) for x in parts], np.int64)
            flat = np.concatenate([x for x in parts if x is not None] or [np.zeros(0, np.int64)])
            o = pa.array(np.append(0, np.cumsum(lens)), pa.int32())
            return pa.ListArray.from_arrays(o, pa.array(flat, pa.int64()), mask=none) if none is not None else pa.array([], pa.list_(pa.int64()))

        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(n_all, pa.int64()), "fa": pa.array(fa, pa.int64()),
                         "fb": pa.array(fb, pa.int64()), "tokens": lists(tokens), "shared": lists(shared)})

    def join_trees(table):
        side = np.asarray(table.column("stray"))
        out = []
        for s in (True, False):
            part = table.filter(pa.array(side == s))
            v = part.column("v").to_pylist()
            rows_ = []
            for i, (n, linked) in enumerate(zip(part.column("n").to_pylist(), part.column("linked").to_pylist(), strict=True)):
                key = (v[i]["id"], v[i]["fa"], v[i]["fb"])
                rows_.append(((1,) if linked else (0, *key), n, np.asarray(part.column("shared")[i].values, np.int64), key, v[i]))
            rows_.sort(key=lambda r: (r[0][0], r[2].min() if len(r[2]) else 0, r[3]))
            out.append(rows_)
        strays, members = out
        if not strays or not members:
            pairs = []
        else:
            pairs = tree_links([r[:4] for r in strays], [r[:4] for r in members], percent)
        kind = pa.struct([("id", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64())])
        return pa.table({"a": pa.array([strays[i][4] for i, _ in pairs], kind), "b": pa.array([members[j][4] for _, j in pairs], kind)})

    by_block = rows.groupBy("block")
    levels = by_block.applyInArrow(ask, B.ASK).groupBy("bucket").applyInArrow(classes, B.ASK)
    home = shared_folder(spark, "jaccard")
    by_block.cogroup(levels.groupBy("block")).applyInArrow(
        prefixes, "id long, n long, fa long, fb long, tokens array<long>, shared array<long>").write.parquet(f"{home}/documents")
    docs_ = spark.read.parquet(f"{home}/documents")
    low = docs_.where("n > 0").groupBy("fa", "fb").agg(F.min("id").alias("id"))
    # one row per set that may link; equal sets of several blocks carry equal arrays
    (docs_.where("tokens IS NOT NULL").groupBy("fa", "fb").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("shared").alias("shared"))
     .join(low, ["fa", "fb"]).select(F.struct("id", "fa", "fb").alias("v"), "n", "tokens", "shared").write.parquet(f"{home}/sets"))
    sets = spark.read.parquet(f"{home}/sets")
    under = sets.select("v", F.explode("tokens").alias("t"))
    hubs = under.groupBy("t").agg(F.min("v").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = under.join(hubs, "t").where("v != hub").select("hub", "v").distinct()
    left = sets.select("v", "n", "shared")
    right = sets.select(F.col("v").alias("hub"), F.col("n").alias("hub_n"), F.col("shared").alias("hub_shared"))
    same = F.size(F.array_intersect("shared", "hub_shared"))
    (pairs.join(left, "v").join(right, "hub").select("hub", "v", same.alias("same"), (F.col("n") + F.col("hub_n")).alias("both"))
     .select("hub", "v", (100 * F.col("same") >= percent * (F.col("both") - F.col("same"))).alias("linked")).write.parquet(f"{home}/pairs"))
    pairs = spark.read.parquet(f"{home}/pairs")
    jobs = (pairs.groupBy("hub").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("s")).where("s > 0 AND m > 1")
            .select("hub", F.ceil(F.col("s") / STRAYS).cast("int").alias("sn"), F.ceil(F.col("m") / MEMBERS).cast("int").alias("mn")))
    inside = pairs.join(jobs, "hub")
    number = F.xxhash64("v")
    strays = inside.where("NOT linked").select("hub", "v", "linked", F.lit(True).alias("stray"), F.pmod(number, "sn").cast("int").alias("sb"),
                                               F.explode(F.sequence(F.lit(0), F.col("mn") - 1)).alias("mb"))
    members = inside.select("hub", "v", "linked", F.lit(False).alias("stray"),
                            F.explode(F.sequence(F.lit(0), F.col("sn") - 1)).alias("sb"), F.pmod(number, "mn").cast("int").alias("mb"))
    found = strays.unionByName(members).join(left, "v").groupBy("hub", "sb", "mb").applyInArrow(
        join_trees, "a struct<id: long, fa: long, fb: long>, b struct<id: long, fa: long, fb: long>")
    linked = pairs.where("linked").select(F.col("hub").alias("a"), F.col("v").alias("b")).unionByName(found)
    roots = components(linked).select(F.col("node.fa").alias("fa"), F.col("node.fb").alias("fb"), F.col("root.id").alias("root"))
    least = low.join(roots, ["fa", "fb"], "left").select("fa", "fb", F.coalesce("root", "id").alias("component_id"))
    null = F.lit(int(B.LAST))
    return (docs_.select("id", "n", "fa", "fb").join(least, ["fa", "fb"], "left")
            .select(F.nullif("id", null).alias("id"), F.col("n").alias("n_shingles"),
                    F.nullif(F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")), null).alias("component_id")))


B.by_value(__name__)

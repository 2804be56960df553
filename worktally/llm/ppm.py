"""Code length of texts under prediction by partial matching, with a pretrained byte-context trie.

A byte is predicted from the longest of its last five, four ... zero bytes that was seen in training. Method C estimates
escapes: in a context seen T times with d different followers, a follower of count c has probability c / (T + d), and
the escape to the next shorter context d / (T + d). Followers of a longer context are excluded in the shorter ones
(their counts leave T, their number leaves d). After the empty context, the bytes never seen share the rest evenly.
Five zero bytes stand before a text and an end symbol (0xFF, which no UTF-8 text holds) after it, so the probabilities
of all texts sum to one at most.

How it is spread: a block of documents needs one number per *different* string of six bytes (five of context and the
predicted one). It sends these strings with their training counts to buckets named by the three bytes before the
predicted one; all contexts of three to five bytes that compete for a string lie in that bucket. A bucket first merges
the counts of groups of blocks, then of the groups, and answers each group of blocks apart, so no task holds the requests
of all blocks. The contexts of up to two bytes come from one table of three-byte strings, at most 2^24 entries whatever
the corpus (some ten thousand in practice), which is shared as a broadcast.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktally.llm import blocks as B

ORDER = 5
RUN = 1 << 20  # bytes turned into strings at a time
GROUP = 512  # blocks whose requests one task answers
_END_TOKEN = np.uint64(0x5851F42D4C957F2D)


def _padded(data, starts, ends):
    """Texts with ``ORDER`` zero bytes before and the end symbol after; (bytes, first six-byte string, strings) of each."""
    lens = ends - starts
    begin = np.cumsum(lens + ORDER + 1) - (lens + ORDER + 1)
    out = np.zeros(int((lens + ORDER + 1).sum()), np.uint8)
    out[B.spans(begin + ORDER, lens)] = data
    out[begin + ORDER + lens] = 255
    return out, begin, lens + 1


def _strings(x, width):
    """Every ``width`` bytes as one number."""
    v = x[:len(x) - width + 1].astype(np.uint64)
    for k in range(1, width):
        v <<= np.uint64(8)
        v |= x[k:len(x) - width + 1 + k]
    return v


def _grouped(sorted_keys):
    """First index of each run of equal keys."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def _sum(keys, counts):
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = _grouped(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Level:
    """Contexts of one length: followers with counts, totals, and the counts the next shorter context gives the same followers."""

    def __init__(self, edges, counts, shorter=None, bits=0):
        self.edges, self.counts = edges, counts
        context = edges >> np.uint64(8)
        at = _grouped(context)
        self.contexts = context[at]
        self.total = np.add.reduceat(counts, at) if len(at) else counts
        self.kinds = np.diff(np.append(at, len(edges)))
        self.below = np.zeros(len(at), np.int64)
        if shorter is not None and len(at):
            low = shorter.counts[np.searchsorted(shorter.edges, edges & np.uint64((1 << bits) - 1))]
            self.below = np.add.reduceat(low, at)


def _find(keys, wanted):
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return i, (keys[i] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def levels(edges, counts, top, shorter=None, floor=0):
    """Levels ``top`` down to ``floor`` (longest first) from the longest strings."""
    kept = [(edges, counts)]
    for k in range(top - 1, floor - 1, -1):
        kept.append(_sum(kept[-1][0] & np.uint64((1 << 8 * (k + 1)) - 1), kept[-1][1]))
    out = []
    for k, (e, c) in zip(range(floor, top + 1), reversed(kept), strict=True):
        shorter = Level(e, c, shorter, 8 * k)
        out.append(shorter)
    return out[::-1]


def log_probability(wanted, all_levels):
    """log10 probability of the last byte of each string after the bytes before it."""
    out = np.zeros(len(wanted))
    open_ = np.ones(len(wanted), bool)
    less_total = np.zeros(len(wanted), np.int64)
    less_kinds = np.zeros(len(wanted), np.int64)
    kinds = np.zeros(len(wanted), np.int64)
    for k, level in zip(range(len(all_levels) - 1, -1, -1), all_levels, strict=True):
        if not len(level.edges):
            continue
        edge = wanted & np.uint64((1 << 8 * (k + 1)) - 1)
        i, seen = _find(level.contexts, edge >> np.uint64(8))
        j, has = _find(level.edges, edge)
        kinds = np.where(seen, level.kinds[i], kinds)
        d = level.kinds[i] - less_kinds
        n = np.maximum(level.total[i] - less_total + d, 1)
        hit = open_ & has
        out[hit] += np.log10(level.counts[j[hit]] / n[hit])
        open_ &= ~has
        esc = open_ & seen & (d > 0)
        out[esc] += np.log10(d[esc] / n[esc])
        less_total = np.where(seen, level.below[i], 0)
        less_kinds = np.where(seen, level.kinds[i], 0)
    out[open_] -= np.log10(256 - kinds[open_])
    return out


def _low_counts(rows):
    """Counts of three-byte strings (two of context) in the training texts: (strings ascending, counts)."""
    def count(batches):
        for batch in batches:
            data, off = B.raw(batch.column("text"))
            starts, ends = off[:-1], off[1:]
            for i, j in _runs(ends - starts, RUN):
                x, begin, n = _padded(B.lower(data[starts[i]:ends[j - 1]]), starts[i:j] - starts[i], ends[i:j] - starts[i])
                v = _strings(x, 3)[B.spans(begin + ORDER - 2, n)].astype(np.uint32)
                v.sort()
                at = _grouped(v)
                yield pa.RecordBatch.from_pydict({"s": pa.array(v[at].astype(np.int32)), "n": pa.array(np.diff(np.append(at, len(v))))})

    table = (rows.where("train").select("text").mapInArrow(count, "s int, n long").groupBy("s").agg(F.sum("n").alias("n"))).toArrow()
    s, n = np.asarray(table.column("s")).astype(np.uint64), np.asarray(table.column("n"))
    order = np.argsort(s)
    return s[order], n[order]


def _runs(lens, most):
    """(from, to) document ranges of about ``most`` bytes."""
    total, i = np.cumsum(lens), 0
    while i < len(lens):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most)))
        yield i, j
        i = j


def _block_strings(data, starts, ends, train):
    """Different six-byte strings of a block ascending, with their counts in training texts."""
    keys, counts = [], []
    for i, j in _runs(ends - starts, RUN):
        x, begin, n = _padded(data[starts[i]:ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        v = _strings(x, ORDER + 1)[B.spans(begin, n)]
        v <<= np.uint64(1)
        v |= np.repeat(train[i:j], n)
        v.sort()
        at = _grouped(v >> np.uint64(1))
        learned = np.append(0, np.cumsum(v & np.uint64(1), dtype=np.int64))
        keys.append(v[at] >> np.uint64(1))
        counts.append(np.diff(learned[np.append(at, len(v))]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _sum(np.concatenate(keys), np.concatenate(counts)) if len(keys) > 1 else (keys[0], counts[0])


def _by_bucket(keys, bits):
    """(order that puts strings by bucket, [(bucket, from, to)]): the bucket comes from the three bytes before the last."""
    top = B.mix((keys >> np.uint64(8)) & np.uint64(0xFFFFFF)) >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    order = np.argsort(top.astype(np.uint16) if bits <= 16 else top, kind="stable")
    top = top[order].astype(np.int64)
    at = _grouped(top)
    return order, list(zip(top[at].tolist(), at.tolist(), [*at[1:].tolist(), len(top)], strict=True))


def _pack(keys, counts):
    six = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return six.T.tobytes() + counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()  # bytes of a place together: they compress


def _unpack(body):
    n = len(body) // 14
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(body, np.uint8, 6 * n).reshape(6, n).T
    counts = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, 6 * n).reshape(8, n).T).reshape(-1).view("<i8")
    return wide.reshape(-1).view("<u8"), counts


def score(docs, train, id_col="doc_id", text_col="text", block_bytes=B.BLOCK_BYTES):
    """Scores every text; learns from the rows where ``train`` (a boolean Column over the id) holds.

    Returns a DataFrame per input row: id, train, n_tokens, n_known, known_log (sum over tokens of log10(count + 1)),
    score (log10 probability of the text, A-Z lower-cased, by the byte model), train_tokens (all training tokens),
    vocabulary (different ones). Tokens are words between blanks (0x20, 0x09-0x0D) and one end per text; word counts are
    exact up to 64-bit hashes (about three pairs among 10^10 different words would share one).

    Null text: empty, which still has its end. A null ``train`` counts as false. Repeated rows are learned as often as
    they occur. With nothing to learn every byte has probability 1/256. Other columns are ignored. The result is written
    to the shared folder first: its totals are known only when all blocks are done.
    """
    from worktally.session import shared_folder

    spark = docs.sparkSession
    rows, n_blocks, size = B.deal(docs, id_col, text_col, block_bytes, train=F.coalesce(train, F.lit(False)))
    low = spark.sparkContext.broadcast(_low_counts(rows))
    bits, bits_words = B.bucket_bits(size / 16, 1 << 19), B.bucket_bits(size / 32)
    groups = max(1, -(-n_blocks // GROUP))

    def look(table):
        ids, data, starts, ends, learn = B.texts(table, "train")
        return ids, B.lower(data), starts, ends, learn.astype(bool)

    def tokens(data, starts, ends):
        at, lens, doc = B.words(data, starts, ends)
        h = np.append(B.hash_words(data, at, lens), np.full(len(starts), _END_TOKEN))
        doc = np.append(doc, np.arange(len(starts)))
        order = np.argsort(h, kind="stable")
        first = _grouped(h[order])
        back = np.empty(len(h), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        return h[order][first], back, doc

    def ask(table):
        block = table.column("block")[0].as_py()
        _, data, starts, ends, learn = look(table)
        out = []
        h, back, doc = tokens(data, starts, ends)
        seen = np.bincount(back, learn[doc], len(h)).astype(np.int64)
        for k, i, j in B.cut(h, bits_words):
            out.append((-1 - k, block, h[i:j].tobytes() + seen[i:j].tobytes()))
        keys, counts = _block_strings(data, starts, ends, learn)
        order, parts = _by_bucket(keys, bits)
        for k, i, j in parts:
            out.append((k, block, _pack(keys[order[i:j]], counts[order[i:j]])))
        return B.asked(out)

    def count_words(table):
        bucket, got = table.column("bucket")[0].as_py(), B.bodies(table)
        n = [len(x) // 16 for _, x in got]
        h = np.concatenate([np.frombuffer(x, np.uint64, k) for (_, x), k in zip(got, n, strict=True)])
        c = np.concatenate([np.frombuffer(x, np.int64, k, 8 * k) for (_, x), k in zip(got, n, strict=True)])
        order = np.argsort(h, kind="stable")
        at = _grouped(h[order])
        total = np.add.reduceat(c[order], at)
        out = np.empty(len(h), np.int64)
        out[order] = np.repeat(total, np.diff(np.append(at, len(h))))
        ends, rows_out = np.cumsum(n), []
        for x, ((g, _), k, e) in enumerate(zip(got, n, ends, strict=True)):
            head = np.array([(total > 0).sum(), total.sum()] if x == 0 else [0, 0], np.int64)
            rows_out.append((bucket, g, head.tobytes() + out[e - k:e].tobytes()))
        return B.asked(rows_out)

    def merge(table):
        parts = [_unpack(x) for _, x in B.bodies(table)]
        keys, counts = _sum(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        use = counts > 0
        return pa.table({"bucket": table.column("bucket")[:1].combine_chunks(), "body": pa.array([_pack(keys[use], counts[use])], pa.binary())})

    def merge_groups(table):
        parts = [_unpack(x) for x in table.column("body").to_pylist()]
        keys, counts = _sum(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * groups, pa.int32()),
                         "part": pa.array(range(groups), pa.int32()), "model": pa.array([_pack(keys, counts)] * groups, pa.binary())})

    def answer(requests, model):
        if not requests.num_rows:
            return B.asked([])
        bucket, got = requests.column("bucket")[0].as_py(), B.bodies(requests)
        keys, counts = _unpack(model.column("model")[0].as_py())
        short = levels(*low.value, 2)
        every = levels(keys, counts, ORDER, short[0], 3) + short
        parts = [_unpack(x)[0] for _, x in got]
        asked = np.concatenate(parts)
        order = np.argsort(asked, kind="stable")
        at = _grouped(asked[order])
        out = np.empty(len(asked), np.float32)
        out[order] = np.repeat(log_probability(asked[order][at], every), np.diff(np.append(at, len(asked))))
        ends = np.cumsum([len(x) for x in parts])
        return B.asked([(bucket, g, out[e - len(x):e].tobytes()) for (g, _), x, e in zip(got, parts, ends, strict=True)])

    def finish(table, replies):
        ids, data, starts, ends, learn = look(table)
        got = B.answers(replies)
        h, back, doc = tokens(data, starts, ends)
        count = np.zeros(len(h), np.int64)
        stat = np.zeros(2, np.int64)
        for k, i, j in B.cut(h, bits_words):
            stat += np.frombuffer(got[-1 - k], np.int64, 2)
            count[i:j] = np.frombuffer(got[-1 - k], np.int64, j - i, 16)
        keys, _ = _block_strings(data, starts, ends, learn)
        order, parts = _by_bucket(keys, bits)
        value = np.empty(len(keys), np.float32)
        for k, i, j in parts:
            value[order[i:j]] = np.frombuffer(got[k], np.float32)
        find = B.Index(keys)
        scores = []
        for i, j in _runs(ends - starts, RUN):
            x, begin, n = _padded(data[starts[i]:ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
            v = value[find(_strings(x, ORDER + 1)[B.spans(begin, n)])].astype(np.float64)
            scores.append(np.add.reduceat(v, np.cumsum(n) - n))
        m = len(ids)
        c = count[back]
        known = np.bincount(doc, np.log10(c + 1.0), m)

        def tail(x, v):
            return np.append(x, v)

        gone = tail(ids == B.LAST, True)
        return pa.table({"id": pa.array(tail(ids, 0), pa.int64(), mask=gone), "train": pa.array(tail(learn, False).astype(bool)),
                         "n_tokens": pa.array(tail(np.bincount(doc, minlength=m), 0).astype(np.int64)),
                         "n_known": pa.array(tail(np.bincount(doc, c > 0, m), 0).astype(np.int64)),
                         "known_log": pa.array(tail(known, 0.0)), "score": pa.array(tail(np.concatenate(scores), 0.0)),
                         "words": pa.array(np.append(np.full(m, -1), stat[0]), pa.int64()),
                         "seen": pa.array(np.append(np.zeros(m, np.int64), stat[1]), pa.int64())})

    asks = rows.groupBy("block").applyInArrow(ask, B.ASK)
    of_words = asks.where("bucket < 0").groupBy("bucket").applyInArrow(count_words, B.ASK)
    strings = asks.where("bucket >= 0").withColumn("part", F.pmod("block", F.lit(groups))).groupBy("bucket", "part")
    model = strings.applyInArrow(merge, "bucket int, body binary").groupBy("bucket").applyInArrow(merge_groups, "bucket int, part int, model binary")
    of_strings = strings.cogroup(model.groupBy("bucket", "part")).applyInArrow(answer, B.ASK)
    done = rows.groupBy("block").cogroup(of_words.unionByName(of_strings).groupBy("block")).applyInArrow(
        finish, "id long, train boolean, n_tokens long, n_known long, known_log double, score double, words long, seen long")
    home = shared_folder(spark, "scores")
    done.write.parquet(home)
    done = spark.read.parquet(home)
    # rows with words >= 0 carry a block's share of the totals
    totals = done.where("words >= 0").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("vocabulary"), F.coalesce(F.sum("seen"), F.lit(0)).alias("train_tokens"))
    return done.where("words < 0").drop("words", "seen").crossJoin(F.broadcast(totals))


B.by_value(__name__)

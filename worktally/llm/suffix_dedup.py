"""Removes byte strings that an earlier document already holds, from a column-wise collection index.

The index is the Burrows-Wheeler transform of a document collection with its common prefix lengths, built column by
column: each round inserts one symbol of every document, moves the documents to their new order by a stable distribution
on that symbol (the LF step), and updates the common prefix of neighbours as one plus the least old one between them.
One round reads the order and the prefixes of the round before in sequence and writes new ones, as the external-file
construction does; here the "files" are arrays of one bucket, whose size is bounded by the number of buckets.

The documents of that collection are not whole texts but *segments*. Each window of ``min_bytes`` bytes names the least
hashed 20-byte seed inside it, and a segment is a run of windows that name the same occurrence. Equal windows name equal
seeds at the same place, so they meet in one bucket and in one column, and a segment has at most 81 bytes: the number of
rounds is fixed. Only seeds that occur in two documents go to the index.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktally.llm import blocks as B

SEED = 20
RUN = 1 << 18  # window starts hashed at a time
_T = B.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_B = 0x9FB21C651E98DF25


def _power(n):
    return np.uint64(pow(_B, n, 2**64))


def segments(data, starts, ends, width):
    """Runs of windows that name the same seed occurrence.

    Returns arrays: first window, number of windows, place of the seed, hash of the seed, hash of the run, document index.
    """
    n, m = len(data), SEED
    w = width - m + 1
    found = []
    bad = np.zeros(n + 1, np.int32)
    np.add.at(bad, np.maximum(starts, ends - width + 1), 1)
    np.add.at(bad, ends, -1)
    bad = np.cumsum(bad[:-1]) > 0
    for s0 in range(0, max(0, n - width + 1), RUN):
        x = data[s0:s0 + RUN + width - 1]
        k = len(x) - width + 1  # windows here
        h1 = _T[x]
        h2 = h1[:-1] * _power(1) + h1[1:]
        h4 = h2[:-2] * _power(2) + h2[2:]
        h8 = h4[:-4] * _power(4) + h4[4:]
        h16 = h8[:-8] * _power(8) + h8[8:]
        hm = B.mix(h16[:len(x) - m + 1] * _power(4) + h4[16:len(x) - m + 17])
        low, off, have = hm, np.zeros(len(hm), np.uint8), 1
        while have < w:  # leftmost minimum of w neighbouring seeds, by doubling
            step = min(have, w - have)
            right = low[step:] < low[:-step]
            off = np.where(right, off[step:] + np.uint8(step), off[:-step])
            low = np.where(right, low[step:], low[:-step])
            have += step
        at = np.arange(k) + off[:k]
        ok = ~bad[s0:s0 + k]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
        a = np.flatnonzero(new)
        if not len(a):
            continue
        stop = np.flatnonzero(np.append(ok[:-1] & (~ok[1:] | new[1:]), ok[-1])) + 1
        z = stop - 1  # last window

        def whole(s, h16=h16, h2=h2):
            if width < 16:
                return h2[s]
            v, have = h16[s], 16
            while have + 16 <= width:
                v = v * _power(16) + h16[s + have]
                have += 16
            return v * _power(16) + h16[s + width - 16]

        f = B.mix(B.mix(whole(a)) * np.uint64(3) + whole(z) + (stop - a).astype(np.uint64) * _power(3)
                  + (at[a] - a).astype(np.uint64) * _power(5))
        # least hashes are small numbers: mixed anew, they spread over the buckets
        found.append((a + s0, stop - a, at[a] + s0, B.mix(hm[at[a]] + np.uint64(1)), f))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64), z
    a, count, at, h, f = (np.concatenate(c) for c in zip(*found, strict=True))
    return a, count, at, h, f, np.searchsorted(starts, a, side="right") - 1


def _drop_empty(ids, data, starts, ends):
    """Documents with bytes only (positions tell documents apart)."""
    keep = ends > starts
    return ids[keep], data, starts[keep], ends[keep]


def _seeds(h, doc):
    """Distinct seeds ascending; whether two documents here hold it; index of each input row's seed."""
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], doc[order]
    first = np.append(True, hs[1:] != hs[:-1]) if len(hs) else np.zeros(0, bool)
    rank = np.cumsum(first) - 1
    many = np.zeros(int(first.sum()), bool)
    if len(hs):
        many[rank[1:][~first[1:] & (ds[1:] != ds[:-1])]] = True
    back = np.empty(len(h), np.int64)
    back[order] = rank
    return hs[first], many, back


def _distinct(h, f, doc_id, take):
    """Distinct runs among ``take``: (index of one, least and greatest document id, number of each row's run)."""
    i = np.flatnonzero(take)
    order = i[np.lexsort((f[i], h[i]))]
    first = np.append(True, (h[order][1:] != h[order][:-1]) | (f[order][1:] != f[order][:-1])) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    back = np.full(len(h), -1, np.int64)
    back[order] = np.cumsum(first) - 1
    ids = doc_id[order]
    low = np.minimum.reduceat(ids, at) if len(at) else ids[:0]
    high = np.maximum.reduceat(ids, at) if len(at) else ids[:0]
    return order[first], low, high, back


def collection(columns, low, width, left):
    """Rounds of the construction over ``columns`` (documents x symbols, -1 where there is none).

    Yields (column, order, class starts): documents of a class share ``width`` symbols from that column on.
    """
    n, k = columns.shape
    order = np.arange(n)
    lcp = np.zeros(n + 1, np.int16)
    for c in range(k - 1, -1, -1):
        symbol = columns[order, c]
        step = np.argsort(symbol, kind="stable")
        symbol = symbol[step]
        order = order[step]
        new = np.zeros(n + 1, np.int16)
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] >= 0))
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[::2] = step[same] + 1
            between[1::2] = step[same + 1] + 1
            new[same + 1] = np.minimum.reduceat(lcp, between)[::2] + 1
        lcp = new
        if c <= left:
            yield c, order, np.flatnonzero(lcp[:n] < width)


def _least_documents(place, count, body, low, width):
    """For each segment and window: the least document id that holds the window, from the collection index."""
    left = width - SEED
    n = len(place)
    columns = np.full((n, left + width), -1, np.int16)
    rows = np.arange(n) * (left + width) + left - place
    columns.reshape(-1)[B.spans(rows, count + width - 1)] = body
    least = np.zeros((n, left + 1), np.int64)
    for c, order, at in collection(columns, low, width, left):
        best = np.minimum.reduceat(low[order], at)
        least[order, c] = np.repeat(best, np.diff(np.append(at, n)))
    return least


def repeats(docs, id_col="doc_id", text_col="text", min_bytes=50, block_bytes=B.BLOCK_BYTES // 2):
    """Removes each byte covered by a ``min_bytes``-byte string that also starts in a document of smaller id.

    Returns one row per input row: id, n_bytes, spans array<struct<start, length>> (removed runs, in bytes), kept binary.
    Texts are UTF-8 bytes; matches never cross documents; overlapping strings count; all strings are judged on the input.
    Null text: empty. Rows with equal ids do not remove from each other; a null id comes after all others. Other columns
    are ignored, an empty table gives an empty result, and texts under ``min_bytes`` bytes are returned whole.
    """
    if min_bytes < SEED + 1:
        raise ValueError(f"min_bytes must be over {SEED}")
    rows, _, size = B.deal(docs, id_col, text_col, block_bytes)
    seeds = 2 * size / (min_bytes - SEED + 2)
    bits, bits2 = B.bucket_bits(seeds, 1 << 19), B.bucket_bits(seeds, 1 << 17)
    left = min_bytes - SEED

    def look(table):
        ids, data, starts, ends = _drop_empty(*B.texts(table))
        return ids, data, starts, ends, segments(data, starts, ends, min_bytes)

    def ask_seeds(table):
        block = table.column("block")[0].as_py()
        _, _, _, _, (_, _, _, h, _, doc) = look(table)
        h, many, _ = _seeds(h, doc)
        return B.asked([(k, block, B.pack40(h[i:j], bits) + np.packbits(many[i:j]).tobytes()) for k, i, j in B.cut(h, bits)])

    def join_seeds(table):
        bucket, got = table.column("bucket")[0].as_py(), B.bodies(table)
        # 5 bytes and one bit each
        n = [int(len(x) * 8 // 41) for _, x in got]
        h = np.concatenate([B.unpack40(x, k) for (_, x), k in zip(got, n, strict=True)])
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=5 * k), count=k) for (_, x), k in zip(got, n, strict=True)])
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
        size_of = np.diff(np.append(at, len(h)))
        hit = (size_of > 1) | (np.maximum.reduceat(many[order], at) > 0)
        out = np.empty(len(h), bool)
        out[order] = np.repeat(hit, size_of)
        ends = np.cumsum(n)
        return B.asked([(bucket, g, np.packbits(out[e - k:e]).tobytes()) for (g, _), k, e in zip(got, n, ends, strict=True)])

    def chosen(table, replies):
        ids, data, starts, ends, (a, count, at, h, f, doc) = look(table)
        uniq, _, back = _seeds(h, doc)
        hit = np.zeros(len(uniq), bool)
        for k, i, j in B.cut(uniq, bits):
            hit[i:j] = np.unpackbits(np.frombuffer(replies[k], np.uint8), count=j - i)
        one, low, high, run = _distinct(h, f, ids[doc] if len(doc) else ids[:0], hit[back] if len(back) else np.zeros(0, bool))
        return ids, data, starts, ends, a, count, at, h, doc, one, low, high, run

    def ask_runs(table, seed_replies):
        block = table.column("block")[0].as_py()
        _, data, _, _, a, count, at, h, _, one, low, high, _ = chosen(table, B.answers(seed_replies))
        hs, out = h[one], []
        for k, i, j in B.cut(hs, bits2):
            pick = one[i:j]
            lens = count[pick] + min_bytes - 1
            out.append((k, block, b"".join((np.int64(j - i).tobytes(), low[i:j].tobytes(), high[i:j].tobytes(),
                                            (at[pick] - a[pick]).astype(np.uint8).tobytes(), count[pick].astype(np.uint8).tobytes(),
                                            data[B.spans(a[pick], lens)].tobytes()))))
        return B.asked(out)

    def join_runs(table):
        bucket, got = table.column("bucket")[0].as_py(), B.bodies(table)
        parts, sizes = [], []
        for _, x in got:
            n = int(np.frombuffer(x, np.int64, 1)[0])
            sizes.append(n)
            p = 8
            part = []
            for kind in (np.int64, np.int64, np.uint8, np.uint8):
                part.append(np.frombuffer(x, kind, n, p))
                p += part[-1].nbytes
            parts.append((*part, np.frombuffer(x, np.uint8, offset=p)))
        low, high, place, count, body = (np.concatenate(c) for c in zip(*parts, strict=True))
        place, count = place.astype(np.int64), count.astype(np.int64)
        least = _least_documents(place, count, body, low, min_bytes)
        row = np.repeat(np.arange(len(low)), count)
        off = B.spans(np.zeros(len(low), np.int64), count)
        value = least[row, left - place[row] + off]
        new = np.append(True, (np.diff(row) != 0) | (np.diff(value) != 0))
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(row)))
        row, off, value = row[at], off[at], value[at]
        use = value < high[row]
        row, off, value, length = row[use], off[use], value[use], length[use]
        runs_of = np.bincount(row, minlength=len(low)).astype(np.uint8)
        e1, out = 0, []
        first = np.searchsorted(row, np.append(0, np.cumsum(sizes)))
        for (g, _), n, i, j in zip(got, sizes, first[:-1], first[1:], strict=True):
            out.append((bucket, g, runs_of[e1:e1 + n].tobytes() + off[i:j].astype(np.uint8).tobytes()
                        + length[i:j].astype(np.uint8).tobytes() + value[i:j].tobytes()))
            e1 += n
        return B.asked(out)

    def clean(table, seed_replies, run_replies):
        ids_all, data, starts_all, ends_all = B.texts(table)
        ids, _, _, _, a, _, _, h, doc, one, _, _, run = chosen(table, seed_replies)
        n_runs, offs, lens, vals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, i, j in B.cut(h[one], bits2):
            x, n = run_replies[k], j - i
            n_runs.append(np.frombuffer(x, np.uint8, n).astype(np.int64))
            m = int(n_runs[-1].sum())
            offs.append(np.frombuffer(x, np.uint8, m, n).astype(np.int64))
            lens.append(np.frombuffer(x, np.uint8, m, n + m).astype(np.int64))
            vals.append(np.frombuffer(x, np.int64, m, n + 2 * m))
        n_runs, offs, lens, vals = (np.concatenate(x) for x in (n_runs, offs, lens, vals))
        begin = np.cumsum(n_runs) - n_runs
        here = np.flatnonzero(run >= 0)
        here = here[n_runs[run[here]] > 0] if len(here) else here
        times = n_runs[run[here]]
        each = B.spans(begin[run[here]], times)
        seg = np.repeat(here, times)
        hit = vals[each] < ids[doc[seg]] if len(seg) else np.zeros(0, bool)
        start = (a[seg] + offs[each])[hit]
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + lens[each][hit] + min_bytes - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        prev = np.append(False, gone[:-1]) if len(gone) else gone
        head = starts_all[ends_all > starts_all]
        prev[head] = False
        rise = np.flatnonzero(gone & ~prev)
        nxt = np.append(gone[1:], False) if len(gone) else gone
        nxt[ends_all[ends_all > starts_all] - 1] = False
        fall = np.flatnonzero(gone & ~nxt) + 1
        owner = np.searchsorted(starts_all, rise, side="right") - 1
        per = np.bincount(owner, minlength=len(ids_all)) if len(ids_all) else np.zeros(0, np.int64)
        left_over = np.append(0, np.cumsum(~gone))
        kept_off = np.append(left_over[starts_all], left_over[-1:]) if len(ids_all) else np.zeros(1, np.int64)
        kept = pa.Array.from_buffers(pa.binary(), len(ids_all), [None, pa.py_buffer(kept_off.astype(np.int32).tobytes()), pa.py_buffer(data[~gone].tobytes())])
        runs = pa.StructArray.from_arrays([pa.array(rise - starts_all[owner], pa.int64()), pa.array(fall - rise, pa.int64())], ["start", "length"])
        return pa.table({
            "id": pa.array(ids_all, pa.int64(), mask=ids_all == B.LAST), "n_bytes": pa.array(ends_all - starts_all, pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), runs), "kept": kept})

    def split_replies(table):
        kind = np.asarray(table.column("kind"))
        return B.answers(table.filter(pa.array(kind == 0))), B.answers(table.filter(pa.array(kind == 1)))

    def finish(table, replies):
        return clean(table, *split_replies(replies))

    by_block = rows.groupBy("block")
    seeds_known = by_block.applyInArrow(ask_seeds, B.ASK).groupBy("bucket").applyInArrow(join_seeds, B.ASK)
    runs_known = by_block.cogroup(seeds_known.groupBy("block")).applyInArrow(ask_runs, B.ASK).groupBy("bucket").applyInArrow(join_runs, B.ASK)
    replies = seeds_known.withColumn("kind", F.lit(0)).unionByName(runs_known.withColumn("kind", F.lit(1)))
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(
        finish, "id long, n_bytes long, spans array<struct<start: long, length: long>>, kept binary")


B.by_value(__name__)

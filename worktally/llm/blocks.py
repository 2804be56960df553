"""Documents in blocks, and the questions blocks put to hash buckets.

Several operators must learn, for each of many small items of a text (a seed, a word, a shingle), what the whole corpus
knows about it. A row per item would cost more than the text, so the work goes in three steps, each a Spark stage:

1. documents are dealt to blocks of a bounded number of bytes, and a block sends its *distinct* items, packed, to buckets;
2. a bucket joins the packed items of all blocks and answers each block, entry by entry, in the order asked;
3. the block meets its answers again.

A frequent item counts once per block however often it occurs there, so no bucket grows with a hot key, document or
source. Everything is recomputed from the input when executors are lost.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
ITEMS_PER_BUCKET = 1 << 20
ASK = "bucket int, block int, body binary"
LAST = np.int64(2**63 - 1)  # stands for a null id: after all others


def by_value(module_name):
    """Functions of this module travel to the workers with the plan; workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def deal(docs, id_col, text_col, block_bytes=BLOCK_BYTES, **more):
    """(documents with a block number, number of blocks, bytes of text). A null text is an empty one.
    ``more`` names further columns to carry along; they must depend on id and text alone.

    The block comes from a hash of id and text: null or repeated ids spread as well. A block holds about
    ``block_bytes``, or one longer document.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[c.alias(k) for k, c in more.items()])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("block"), "id",
                       F.col("text").cast("binary").alias("text"), *more), n, size


def bucket_bits(items, per_bucket=ITEMS_PER_BUCKET):
    """Bits of the hash that name a bucket, so that a bucket holds about ``per_bucket`` items."""
    return max(0, int(np.ceil(np.log2(max(1, items / per_bucket)))))


def bounded(spark):
    """Rows go to Python in batches of some megabytes, however long their texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES // 2))
    return spark


def raw(col):
    """(bytes, offsets) of a binary column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def texts(table, *more):
    """(ids, bytes of all texts, starts, ends, further columns ...) of a block, rows in a fixed order."""
    extra = [np.asarray(table.column(c)) for c in more]
    ids = table.column("id").combine_chunks()
    ids = np.asarray(ids.fill_null(int(LAST)), dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
    data, off = raw(table.column("text"))
    if not len(ids):
        return ids, data, np.zeros(0, np.int64), np.zeros(0, np.int64), *extra
    lens = np.diff(off)
    # the order of rows from a shuffle may change when a stage runs again: sort by id, length, then content
    order = np.lexsort((lens, ids))
    tie = np.flatnonzero((np.diff(ids[order]) == 0) & (np.diff(lens[order]) == 0))
    if len(tie):
        order = np.array(sorted(order.tolist(), key=lambda i: (ids[i], lens[i], data[off[i]:off[i + 1]].tobytes())))
    if (np.diff(order) != 1).any():
        data = data[spans(off[order], lens[order])]
    ends = np.cumsum(lens[order])
    return ids[order], data, ends - lens[order], ends, *[x[order] for x in extra]


def spans(starts, lens):
    """Indices of the ranges [start, start + len), one after the other."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lens) - lens), lens)
    return shift + np.arange(total, dtype=np.int64)


def cut(sorted_hashes, bits):
    """(bucket, from, to) slices of hashes sorted ascending; the bucket is their leading bits."""
    top = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sorted_hashes), np.int64)
    at = np.flatnonzero(np.diff(top, prepend=-1))
    return list(zip(top[at].tolist(), at.tolist(), [*at[1:].tolist(), len(top)], strict=True)) if len(top) else []


def pack40(hashes, bits):
    """Five bytes of each hash below the bucket's bits."""
    v = (hashes << np.uint64(bits)) >> np.uint64(24)
    return np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(body, n):
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(body, np.uint8, 5 * n).reshape(n, 5)
    return out.reshape(-1).view("<u8")


def asked(rows):
    """Table of the schema ``ASK``-like from (bucket, block, body) rows."""
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(a, pa.int32()), "block": pa.array(b, pa.int32()), "body": pa.array(c, pa.binary())})


def words(data, starts, ends):
    """(starts, lengths, document index) of the words: runs of bytes other than 0x20 and 0x09-0x0D, inside documents."""
    ink = (data != 32) & ((data < 9) | (data > 13))
    before = np.append(False, ink[:-1]) if len(ink) else ink
    after = np.append(ink[1:], False) if len(ink) else ink
    full = ends > starts
    before[starts[full]] = False
    after[ends[full] - 1] = False
    at = np.flatnonzero(ink & ~before)
    stop = np.flatnonzero(ink & ~after) + 1
    return at, stop - at, np.flatnonzero(full)[np.searchsorted(starts[full], at, side="right") - 1] if len(at) else at


_LETTER = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hash_words(data, at, lens, run=1 << 18):
    """A 64-bit hash of each byte string [at, at + lens): a polynomial over random letter values, mixed."""
    out = np.empty(len(at), np.uint64)
    total = np.cumsum(lens)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + run)))
        n = lens[i:j]
        power = np.full(int(n.max()) + 1, 0xD1342543DE82EF95, np.uint64)
        power = np.multiply.accumulate(power)
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        out[i:j] = np.add.reduceat(_LETTER[data[spans(at[i:j], n)]] * power[place], first)
        i = j
    return mix(out + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lower(data):
    """A copy with A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)


class Index:
    """Finds the place of each number in an array of different numbers, in a few passes over tables."""

    def __init__(self, keys):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys))
        while len(left):
            bits = max(4, int(np.ceil(np.log2(len(left)))) + 3)
            mul = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * (len(self.tables) + 1) & (2**64 - 1) | 1)
            slot = (keys[left] * mul) >> np.uint64(64 - bits)
            table = np.zeros(1 << bits, np.int32)
            table[slot] = left
            self.tables.append((mul, np.uint64(64 - bits), table))
            left = left[table[slot] != left]

    def __call__(self, wanted):
        mul, shift, table = self.tables[0]
        out = table[(wanted * mul) >> shift]
        miss = np.flatnonzero(self.keys[out] != wanted)
        for mul, shift, table in self.tables[1:]:
            if not len(miss):
                break
            out[miss] = table[(wanted[miss] * mul) >> shift]
            miss = miss[self.keys[out[miss]] != wanted[miss]]
        return out


def bodies(table):
    """(block, body) pairs of a bucket in block order."""
    pairs = zip(table.column("block").to_pylist(), table.column("body").to_pylist(), strict=True)
    return sorted(pairs, key=lambda x: x[0])


def answers(table):
    """Bucket number to answer, for one block."""
    return dict(zip(table.column("bucket").to_pylist(), table.column("body").to_pylist(), strict=True))


def mix(h):
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


by_value(__name__)

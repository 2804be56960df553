"""Packs token pieces into sequences: best fit, then a local search that swaps and moves pieces between underfull bins.

Pieces are dealt to shards of bounded size by a hash, each packed in one task; a shard leaves at most a few bins that a
single global packing could have saved. Tokens stay with their document: only lengths travel.
"""

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktally.llm import blocks as B

SHARD = 20_000  # pieces packed together
MARKERS = {"<|endoftext|>": 50256}  # the public tokenizer's added token
CACHE = 400_000  # different words kept with their ids in a worker
_LETTERS, _DIGITS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
# the tokenizer's word pattern for texts of the first 256 code points
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_BLANKS}{_LETTERS}{_DIGITS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")


class Words(dict):
    """Ids of each word of the pattern, as little-endian 32-bit numbers; ``markers`` are added tokens that are never cut."""

    def __init__(self, ranks, pattern, markers):
        import regex
        import tiktoken
        with open(ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.markers = {m: np.array([i], "<u4").tobytes() for m, i in markers.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(markers, key=len, reverse=True))) + ")") if markers else None

    def __missing__(self, word):
        out = np.array(self.encoding.encode_ordinary(word), "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = out
        return out

    def ids(self, text):
        if self.cuts and any(m in text for m in self.markers):
            return b"".join([self.markers[x] if x in self.markers else self.plain(x) for x in self.cuts.split(text) if x])
        return self.plain(text) if text else b""

    def plain(self, text):
        found = _LATIN if text.isascii() or max(text) <= "ÿ" else self.pattern
        return b"".join([self[w] for w in found.findall(text)])


def tokenize(docs, ranks, pattern, id_col="doc_id", text_col="text", size=1024, end=2, markers=MARKERS):
    """Pieces of every text: id, piece, start, length, ids_crc32 (of the piece's ids as little-endian 32-bit numbers).

    A text is its ids and then ``end``. Only texts longer than ``size`` are cut: all pieces but the first have ``size``
    ids. ``ranks`` and ``pattern`` are the tokenizer's; the file must lie at the same path on every executor.
    Null text: empty (the end id alone). ``markers`` maps the tokenizer's added tokens to their ids: one that stands inside a
    text is that id, as the tokenizer's library has it by default; with {} it is ordinary text.
    """
    B.bounded(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def cut(batches):
        words = Words(ranks, pattern, markers)
        for batch in batches:
            out = {"id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = words.ids(t or "") + last
                n = len(x) // 4
                a, b = 0, (n - 1) % size + 1
                k = 0
                while a < n:
                    out["id"].append(d)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(memoryview(x)[4 * a:4 * b]))
                    a, b, k = b, b + size, k + 1
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "piece" else pa.int64()) for c, v in out.items()})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths, size):
    """Bin of each piece (longest first into the fullest bin with room), list of bins as lists of piece numbers."""
    bins, free = [], [[] for _ in range(size + 1)]
    mask = 0  # bit r: a bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            b, r = len(bins), size
            bins.append([i])
        r -= n
        if r:
            free[r].append(b)
            mask |= 1 << r
    return bins


def swap_search(bins, lengths, size):
    """Empties underfull bins by moves and one-for-one and two-for-one exchanges; every step increases the squared fill."""
    lens = lengths.tolist()
    fill = [sum(lens[i] for i in b) for b in bins]
    under = set()
    by_room = [{} for _ in range(size + 1)]  # room -> lengths of a bin's pieces -> underfull bins; alike bins are tried once
    holders = {}  # length -> room -> underfull bins that hold a piece of it

    def note(b):
        under.add(b)
        room = size - fill[b]
        by_room[room].setdefault(tuple(sorted(lens[i] for i in bins[b])), set()).add(b)
        for i in bins[b]:
            holders.setdefault(lens[i], {}).setdefault(room, set()).add(b)

    def forget(b):
        under.discard(b)
        room, kind = size - fill[b], tuple(sorted(lens[i] for i in bins[b]))
        by_room[room][kind].discard(b)
        if not by_room[room][kind]:
            del by_room[room][kind]
        for n in set(kind):
            holders[n][room].discard(b)
            if not holders[n][room]:
                del holders[n][room]
            if not holders[n]:
                del holders[n]

    for b in range(len(bins)):
        if fill[b] < size:
            note(b)

    def other(found, v):
        """A bin of ``found`` that is not v."""
        return next((b for b in found if b != v), None)

    def change(b, out, into):
        """Takes pieces ``out`` from bin b and puts ``into`` there."""
        if b in under:
            forget(b)
        bins[b] = [i for i in bins[b] if i not in out] + list(into)
        fill[b] = sum(lens[i] for i in bins[b])
        if bins[b] and fill[b] < size:
            note(b)

    def move(v, i):
        n = lens[i]
        for room in range(n, size + 1):  # tightest first
            if size - room + n <= fill[v]:
                return False
            for found in by_room[room].values():
                b = other(found, v)
                if b is not None:
                    change(v, (i,), ())
                    change(b, (), (i,))
                    return True
        return False

    def exchange(v, give):
        """Pieces ``give`` of v for one smaller piece of another bin, the one that fills most."""
        n = sum(lens[i] for i in give)
        for got in range(1, n) if n < len(holders) else sorted(k for k in holders if k < n):
            gain = n - got
            for room, found in holders.get(got, {}).items():
                b = other(found, v) if gain <= room and size - room + gain > fill[v] else None
                if b is not None:
                    j = next(k for k in bins[b] if lens[k] == got)
                    change(v, give, (j,))
                    change(b, (j,), give)
                    return True
        return False

    def split(v, i):
        """Piece i of v for two smaller pieces of another bin."""
        n = lens[i]
        for room in range(1, size + 1):
            for found in by_room[room].values():
                b = other(found, v)
                if b is None or len(bins[b]) < 2:
                    continue
                seen = {}
                for k in bins[b]:
                    for j, had in seen.items():
                        gain = n - lens[k] - had
                        if 0 < gain <= room and fill[b] + gain > fill[v]:
                            change(v, (i,), (j, k))
                            change(b, (j, k), (i,))
                            return True
                    seen[k] = lens[k]
        return False

    def step(v):
        items = sorted(bins[v], key=lambda i: -lens[i])
        if any(move(v, i) for i in items):
            return True
        if any(exchange(v, (i,)) for i in items):
            return True
        if any(exchange(v, (i, j)) for x, i in enumerate(items) for j in items[x + 1:]):
            return True
        return len(items) < 3 and any(split(v, i) for i in items)

    for v in sorted(under, key=lambda b: (fill[b], b)):
        while v in under and bins[v] and step(v):
            pass
    return [b for b in bins if b]


def pack(pieces, n_shards, size=1024):
    """Adds sequence_id (any numbers) and offset to pieces with the columns id, piece, start, length, ids_crc32.

    No sequence is longer than ``size``; offsets are gapless from 0. Pieces of full length are sequences of their own.
    Repeated rows are packed as often as they occur.
    """
    def fill(table):
        table = table.sort_by([(c, "ascending") for c in ("length", "id", "piece", "start", "ids_crc32")])
        lengths = np.asarray(table.column("length"))
        shard = table.column("shard")[0].as_py()
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for b, items in enumerate(swap_search(best_fit(lengths, size), lengths, size)):
            at = 0
            for i in items:
                seq[i], off[i] = (shard << 32) + b, at
                at += lengths[i]
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    # copies of one piece go to different shards: the hash takes in each row's number. Sorted inside their task, rows get the
    # same numbers when a task runs again
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    shard = F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(n_shards)).alias("shard")
    return pieces.select(*columns).sortWithinPartitions(*columns).select(*columns, shard).groupBy("shard").applyInArrow(
        fill, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs, ranks, pattern, id_col="doc_id", text_col="text", size=1024, end=2, markers=MARKERS):
    """``tokenize`` and ``pack``; the number of shards comes from the number of texts and bytes."""
    n, octets = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    shards = max(1, -(-(n + (octets or 0) // (4 * size)) // SHARD))
    return pack(tokenize(docs, ranks, pattern, id_col, text_col, size, end, markers), shards, size)


B.by_value(__name__)

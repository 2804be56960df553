"""Groups spelling variants of words with an index of variable-length grams.

1. *Dictionary.* Grams of ``Q_MIN`` to ``Q_MAX`` characters of the different words are counted; longer ones stay if
   frequent. The threshold grows with the vocabulary, so the dictionary holds at most ``GRAMS`` grams and is sent to all
   tasks.
2. *Decomposition.* A word, with marks at both ends, becomes its variable-length grams: at each position the longest gram of
   the dictionary (or the next ``Q_MIN`` characters), unless an earlier gram covers it.
3. *Bound.* One insertion, deletion or replacement at a place can change only the grams that hold the place or lie within
   ``Q_MAX`` - 1 characters of it. The most that any place can affect is the word's bound; all its other grams stand in
   every near word too, at a position shifted by one at most.
4. *Lists.* So two near words share one of the bound + 1 rarest grams of each, in the same order of rarity: only these
   short lists are merged. A list is kept by gram and position, and a word asks two of them: the one with the gram at its
   place, for words of its own length or one more, and for these the one with the gram a place further on.
5. *Verification.* A task holds whole lists, or parts of a long one, and compares the words of its candidates as rows of
   code points, many pairs at once; no candidate is written, only near words are.

Words, not texts, go through steps 1 to 5; counting words in the texts combines in the task before the shuffle.
"""

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktally.llm import blocks as B
from worktally.session import shared_folder

Q_MIN, Q_MAX = 2, 4
GRAMS = 1 << 17
RARE = 8  # a gram in fewer places is never in the dictionary
LIST = 1 << 12  # entries of one list that meet as a whole; longer lists are cut
ENTRIES = 1 << 17  # entries of the lists in one task
PAIRS = 1 << 18  # candidates compared at once
WIDE = 48  # longer words are compared one by one
WORDS = 1 << 18  # different words a task holds before it passes their counts on
LONG = 1 << 22  # a longer text's words are not listed at once
HEAD, TAIL = "\x02", "\x03"  # marks of a word's ends
RUN = re.compile("[a-zÀ-ÿ]+")


def count_words(docs, id_col="doc_id", text_col="text", every=97, min_chars=5, min_count=3):
    """(word, n): runs of letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of ``min_chars`` characters and
    ``min_count`` occurrences or more.

    Where ``every`` divides the CRC h of ``id:run`` (a null id is empty), the run first loses its character h % length;
    0 leaves all runs as they are.
    """
    B.bounded(docs.sparkSession)

    def counts(batches):
        total = {}
        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = raw.lower().decode("utf-8", "replace")  # of bytes, lower() changes A-Z alone
                runs = RUN.findall(text) if len(text) <= LONG else (m[0] for m in RUN.finditer(text))
                start = zlib.crc32(f"{'' if d is None else d}:".encode())
                for w, n in Counter(runs).items():
                    if every and (h := zlib.crc32(w.encode(), start)) % every == 0:
                        i = h % len(w)
                        w = w[:i] + w[i + 1:]
                    if len(w) >= min_chars:
                        total[w] = total.get(w, 0) + n
            if len(total) > WORDS:
                yield told(total)
                total = {}
        yield told(total)

    def told(total):
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def marks(min_chars):
    """Marks at each end: with so many, one edit leaves a gram at the start or the end of every word alone."""
    return max(1, Q_MAX - min_chars // 2)


def _marked(word, ends):
    return HEAD * ends + word + TAIL * ends


def dictionary(words, min_chars=5):
    """The longer grams that stand in many places, at most ``GRAMS``, with their counts; all grams of ``Q_MIN`` characters belong to it too."""
    ends = marks(min_chars)
    marked = words.select(F.concat(F.lit(HEAD * ends), "word", F.lit(TAIL * ends)).alias("w"))
    places = marked.agg(F.sum(F.length("w"))).first()[0] or 0
    least = max(RARE, -(-places * (Q_MAX - Q_MIN) // GRAMS))  # the grams of one length stand in ``places`` places at most
    of = lambda q: F.transform(
        F.when(F.length("w") >= q, F.sequence(F.lit(1), F.length("w") - (q - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col("w"), i, F.lit(q)))
    grams = F.flatten(F.array(*[of(q) for q in range(Q_MIN + 1, Q_MAX + 1)]))
    return {r.g: r.n for r in marked.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}


def decompose(marked, longer):
    """[(position, gram)] of a marked word."""
    out, end = [], 0
    for p in range(len(marked) - Q_MIN + 1):
        q = Q_MIN
        for k in range(Q_MAX, Q_MIN, -1):
            if marked[p:p + k] in longer and p + k <= len(marked):
                q = k
                break
        if p + q > end:  # else an earlier gram covers it
            out.append((p, marked[p:p + q]))
            end = p + q
    return out


def affected(grams, ends, chars):
    """The most grams that one edit can change."""
    most, reach = 0, Q_MAX - 1
    spans = [(p, p + len(g)) for p, g in grams]
    starts = [p for p, _ in grams]
    for i in range(ends, ends + chars + 1):  # only grams that start within reach of a place can be affected
        close = spans[bisect_left(starts, i - reach):bisect_right(starts, i + reach)]
        if i < ends + chars:  # the character at i goes or is replaced
            most = max(most, sum(a <= i < b or b <= i + reach + 1 for a, b in close))
        most = max(most, sum(a < i < b or b <= i + reach for a, b in close))  # a character comes before i
    return most


def index(words, sent, min_chars=5):
    """(word, n, p, gram): of each word its rarest grams, as many as its bound and one more. ``sent`` is the broadcast dictionary."""
    ends = marks(min_chars)

    def rows(batches):
        longer = sent.value
        rare = lambda x: (longer.get(x[1], 1 << 60), x[1], x[0])  # noqa: E731  the shortest grams count as the most frequent
        for batch in batches:
            at, pos, gram = [], [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                grams = decompose(_marked(w, ends), longer)
                keep = sorted(grams, key=rare)[:affected(grams, ends, len(w)) + 1]
                at += [i] * len(keep)
                pos += [p for p, _ in keep]
                gram += [g for _, g in keep]
            at = pa.array(np.array(at, np.int64))
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), pa.array(gram, pa.string())], ["word", "n", "p", "gram"])

    return words.select("word", "n").mapInArrow(rows, "word string, n long, p int, gram string")


def one_edit(a, b):
    """Whether b, of a's length or one more, differs from a by one replaced or inserted character."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def _letters(words):
    """Rows of code points, zeros at the end, of the words of at most ``WIDE`` characters; longer words have no letters."""
    short = [w if len(w) <= WIDE else "" for w in words]
    flat = np.frombuffer("".join(short).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(words), max(map(len, short), default=0) + 1), np.uint8 if not len(flat) or flat.max() < 256 else np.uint32)
    size = np.array([len(w) for w in short])
    out[np.repeat(np.arange(len(words)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _replaced(letters, a, b):
    """``one_edit`` of pairs of equal length."""
    return (letters[a] != letters[b]).sum(1) == 1


def _inserted(letters, a, b):
    """``one_edit`` of pairs of which b is one longer: up to the first difference both agree, from there on b goes on one place later."""
    x, y = letters[a], letters[b]
    later = x[:, :-1] != y[:, 1:]
    same = (x != y)[:, :-1]
    first = np.where(same.any(1), same.argmax(1), same.shape[1])
    last = np.where(later.any(1), later.shape[1] - 1 - later[:, ::-1].argmax(1), -1)
    return last < first


def _ranges(first, last):
    """(row, index) of all indices first <= index < last of each row, a bounded number at a time."""
    size = np.maximum(last - first, 0)
    done = np.append(0, np.cumsum(size))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(done, done[i] + PAIRS, side="right")) - 1)
        yield np.repeat(np.arange(i, j), size[i:j]), B.spans(first[i:j], size[i:j])
        i = j


def merge_lists(table):
    """Near words among the entries of some lists: (a, an, b, bn), b as long as a and after it, or one longer.

    ``asks``: the entry asks its list; ``holds``: it stands in it; ``on``: it asks from a place before, hence only longer words.
    """
    coded = pa.chunked_array([table.column("word").combine_chunks().dictionary_encode()]).combine_chunks() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)  # in order of code points: the same pair comes the same way round from every task
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    words, which = [words[i] for i in order], rank[np.asarray(coded.indices)]
    chars = np.array([len(w) for w in words])
    n = np.zeros(len(words), np.int64)
    n[which] = table.column("n").to_numpy()
    letters = _letters(words)
    listed = table.column("list").to_numpy()
    asks, holds, on = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "holds", "on"))
    # the entries of a list in order of length, then word: a question's candidates are neighbours
    _, listed = np.unique(listed, return_inverse=True)
    held = np.flatnonzero(holds)
    width = int(chars.max()) + 3
    key = lambda lists, chars, w: (lists * width + chars) * len(words) + w
    held = held[np.argsort(key(listed[held], chars[which[held]], which[held]), kind="stable")]
    place = key(listed[held], chars[which[held]], which[held])
    ask = np.flatnonzero(asks)
    w, l = which[ask], listed[ask]
    first = np.searchsorted(place, np.where(on[ask], key(l, chars[w] + 1, 0), key(l, chars[w], w) + 1))
    last = np.searchsorted(place, key(l, chars[w] + 2, 0))
    found = []
    for row, at in _ranges(first, last):
        a, b = w[row], which[held[at]]
        wide = chars[b] > WIDE
        near = np.zeros(len(a), bool)
        alike = chars[a] == chars[b]
        for kind, test in ((alike & ~wide, _replaced), (~alike & ~wide, _inserted)):
            near[kind] = test(letters, a[kind], b[kind])
        near[wide] = [one_edit(words[i], words[j]) for i, j in zip(a[wide].tolist(), b[wide].tolist(), strict=True)]
        found.append(np.unique(a[near] * len(words) + b[near]))
    found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    a, b = found // max(1, len(words)), found % max(1, len(words))
    return pa.table({"a": pa.array([words[i] for i in a.tolist()], pa.string()), "an": pa.array(n[a]), "b": pa.array([words[i] for i in b.tolist()], pa.string()), "bn": pa.array(n[b])})


def near_pairs(words, home, min_chars=5):
    """(a, an, b, bn): the pairs of words, a before b or shorter, that differ by one inserted, deleted or replaced character.

    ``words`` is a written table (word, n) of different words of ``min_chars`` characters or more, ``home`` a shared folder for
    the lists. A pair may come more than once.
    """
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast(dictionary(words, min_chars))
    # of the longest pieces' size a batch may be, so words are cut finer
    index(words.repartition(max(1, -(-words.count() // 50_000))), sent, min_chars).write.parquet(f"{home}/lists")
    lists = spark.read.parquet(f"{home}/lists")
    # a long list is cut in parts by word, and each question asks all parts
    size = lists.groupBy("gram", "p").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("parts")).where("parts > 1")
    yes, no = F.lit(True), F.lit(False)
    asked = lists.select("word", "n", "gram", "p").join(size, ["gram", "p"], "left").select("word", "n", "gram", "p", F.coalesce("parts", F.lit(1)).alias("parts"))
    onward = lists.select("word", "n", "gram", (F.col("p") + 1).alias("p")).join(size, ["gram", "p"], "left").select("word", "n", "gram", "p", F.coalesce("parts", F.lit(1)).alias("parts"))
    own = F.pmod(F.xxhash64("word"), "parts").cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    entries = (asked.select("word", "n", "gram", "p", own.alias("own"), every).select("word", "n", "gram", "p", "part", yes.alias("asks"), (F.col("part") == F.col("own")).alias("holds"), no.alias("on"))
               .unionByName(onward.select("word", "n", "gram", "p", every, yes.alias("asks"), no.alias("holds"), yes.alias("on"))))
    tasks = max(1, -(-2 * lists.count() // ENTRIES))
    named = F.xxhash64("gram", "p", "part")
    entries = entries.select("word", "n", named.alias("list"), "asks", "holds", "on", F.pmod(named, F.lit(tasks)).cast("int").alias("task"))
    return entries.groupBy("task").applyInArrow(merge_lists, "a string, an long, b string, bn long")


def variants(docs, id_col="doc_id", text_col="text", every=97, min_chars=5, min_count=3, ratio=2):
    """word, n, n_near, form, form_n, root of every word that ``count_words`` gives.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. form is the near word of
    largest n (ties: the smallest in code-point order) if that is at least ``ratio`` (2 or more) times the word's own n, else null; root
    follows forms to the last. Null and empty texts have no words; other columns of ``docs`` are not looked at; repeated
    rows count as often as they stand there.
    """
    spark = docs.sparkSession
    home = shared_folder(spark, "spelling")
    count_words(docs, id_col, text_col, every, min_chars, min_count).write.parquet(f"{home}/words")
    words = spark.read.parquet(f"{home}/words")
    pairs = near_pairs(words, home, min_chars).distinct()
    links = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("other"), F.col("bn").alias("m")),
                                           F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("other"), F.col("an").alias("m")))).alias("x")).select("x.*")
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                  F.when(-F.col("best.m") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f"))
    out.select("word", "n", "n_near", "f.form", "f.form_n").write.parquet(f"{home}/forms")
    out = spark.read.parquet(f"{home}/forms")
    # a form's count is at least twice the word's, so chains are short; each round doubles the steps taken
    hops, k = out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    while True:
        following = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops.join(following, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).write.parquet(f"{home}/roots-{k}")
        hops = spark.read.parquet(f"{home}/roots-{k}")
        if hops.where("moved").isEmpty():
            break
        hops, k = hops.drop("moved"), k + 1
    return out.join(hops.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


B.by_value(__name__)

"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 drawn from its code point. A letter n-gram is the elementwise product of its
letters' vectors, each rotated by its place; a text is the sum of its n-grams; a language prototype is the sum of its
training texts. A text has the language whose prototype has the largest cosine with it.

All sums are of whole numbers, so prototypes do not depend on the order of rows or tasks. Training sums each language's
n-gram counts inside a task before they are turned into a vector, and the vectors are added by Spark, one key per language
and coordinate. The prototypes are languages x dimensions numbers whatever the corpus.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worktally.llm import blocks as B

DIM = 1024
MOST_LANGUAGES = 4096  # more values than that are no language column
RUN_CHARS = 1 << 20
STEPS = 10_000
_FOLD = []


def _fold():
    """Code point to its lower-case letter, or to a space if it is no letter."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                table[c] = ord(x.lower()[0])
        _FOLD.append(table)
    return _FOLD[0]


def letter_vectors(points, dim):
    """One vector per code point."""
    out = np.empty((len(points), dim), np.int8)
    for i, p in enumerate(points.tolist()):
        bits = np.random.Generator(np.random.Philox(key=p)).integers(0, 2, dim, dtype=np.int8)
        out[i] = 2 * bits - 1
    return out


def trigrams(texts, dim):
    """(document of each n-gram, its number, vectors of the different n-grams, letters of each document)."""
    lens = np.array([len(t) + 2 for t in texts])
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _fold()[raw]
    doc = np.repeat(np.arange(len(texts)), lens)
    keep = np.append(True, (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1]))
    x, doc = x[keep], doc[keep]
    letters = np.bincount(doc, x != 32, len(texts)).astype(np.int64)
    inside = np.zeros(0x110000, bool)
    inside[x] = True
    points = np.flatnonzero(inside)
    place = np.zeros(0x110000, np.int64)
    place[points] = np.arange(len(points))
    s, k = place[x], len(points)
    ok = doc[2:] == doc[:-2]
    code = ((s[:-2] * k + s[1:-1]) * k + s[2:])[ok]
    doc = doc[:-2][ok]
    if k**3 <= 1 << 23:
        there = np.zeros(k**3, bool)
        there[code] = True
        codes = np.flatnonzero(there)
        number = np.zeros(k**3, np.int64)
        number[codes] = np.arange(len(codes))
        number = number[code]
    else:
        codes, number = np.unique(code, return_inverse=True)
    v = letter_vectors(points, dim)
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    return doc, number, (codes // (k * k), codes // k % k, codes % k), (first, second, v), letters


def _bundle(rows, n_rows, number, codes, vectors, dim, kind):
    """Sum of the n-gram vectors of each row, in slices of bounded size."""
    total = len(codes[0])
    out = np.zeros((n_rows, dim), kind)
    for a in range(0, total, 4096):
        b = min(total, a + 4096)
        table = (vectors[0][codes[0][a:b]] * vectors[1][codes[1][a:b]] * vectors[2][codes[2][a:b]]).astype(kind)
        here = (number >= a) & (number < b)
        r, c = rows[here], number[here] - a
        step = max(1, (1 << 21) // (b - a))
        for i in range(0, n_rows, step):
            j = min(n_rows, i + step)
            lo, hi = np.searchsorted(r, [i, j])
            counts = np.bincount((r[lo:hi] - i) * (b - a) + c[lo:hi], minlength=(j - i) * (b - a)).reshape(j - i, b - a)
            out[i:j] += counts.astype(kind) @ table
    return out


def _runs(texts):
    """(from, to) of documents with about ``RUN_CHARS`` characters together."""
    total = np.cumsum([len(t) + 2 for t in texts]) if texts else []
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + RUN_CHARS)))
        yield i, j
        i = j


def train(docs, learn, text_col="text", lang_col="lang", dim=DIM):
    """(languages ascending, languages x dim prototypes) from the rows where ``learn`` holds, language and text not null."""
    def add(batches):
        have = {}

        def out():
            return pa.RecordBatch.from_pydict({"lang": pa.array(list(have), pa.string()),
                                               "v": pa.array([x.tolist() for x in have.values()], pa.list_(pa.float64()))})

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in _runs(texts):
                doc, number, codes, vectors, _ = trigrams(texts[i:j], dim)
                names = sorted(set(langs[i:j]))
                of = np.array([names.index(x) for x in langs[i:j]])[doc]
                order = np.argsort(of, kind="stable")
                for name, v in zip(names, _bundle(of[order], len(names), number[order], codes, vectors, dim, np.float64), strict=True):
                    have[name] = have[name] + v if name in have else v
            if len(have) > 256:
                yield out()
                have = {}
        yield out()

    B.bounded(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).alias("lang"))
    sums = (rows.mapInArrow(add, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
            .groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")))
    found = sums.select("lang", F.col("v.x").alias("v")).limit(MOST_LANGUAGES + 1).toArrow()
    if found.num_rows > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values in {lang_col}")
    rows = sorted(zip(found.column("lang").to_pylist(), found.column("v").to_pylist(), strict=True))
    return [r[0] for r in rows], np.array([r[1] for r in rows]).reshape(len(rows), dim)


def predict(docs, model, text_col="text", keep=()):
    """The columns ``keep`` with lang_pred and score (the cosine, 0 at least).

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Of equal cosines the
    alphabetically first language wins. Other columns play no part; rows are judged one by one.
    """
    B.bounded(docs.sparkSession)
    names, protos = model
    dim = protos.shape[1]
    norms = np.sqrt((protos**2).sum(1))
    unit = protos / np.where(norms > 0, norms, 1)[:, None]
    text = text_col if text_col in keep else "_text"  # a kept text goes to Python once

    def judge(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            lang, score = [], []
            for i, j in _runs(texts):
                doc, number, codes, vectors, letters = trigrams(texts[i:j], dim)
                v = _bundle(doc, j - i, number, codes, vectors, dim, np.float32).astype(np.float64)
                if not names:
                    lang += ["und"] * (j - i)
                    score += [0.0] * (j - i)
                    continue
                size = np.sqrt((v**2).sum(1))
                cos = np.stack([(v * u).sum(1) for u in unit], 1) / np.where(size > 0, size, 1)[:, None]
                best = cos.argmax(1)
                top = np.clip(cos[np.arange(j - i), best], 0, 1)
                lang += [names[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
                score += np.where(letters > 0, top, 0.0).tolist()
            out = {c: batch.column(c) for c in batch.schema.names if c != "_text"}
            yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    rows = docs.select(*[F.col(c) for c in keep], *([] if text_col in keep else [F.col(text_col).alias(text)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(judge, f"{schema + ', ' if schema else ''}lang_pred string, score double")


def length_class(text_col="text"):
    """0 to 3: shorter texts have smaller cosines."""
    n = F.length(text_col)
    return F.when(n < 32, 0).when(n < 128, 1).when(n < 512, 2).otherwise(3)


def least_scores(judged, text_col="text", lang_col="lang"):
    """The cosine that a text of each ``length_class`` needs to count as one of the languages learned.

    Half the cosine that 99 of 100 texts of the class reach, of all whose label is the language found; 0 for a class without
    such texts. ``judged`` holds the rows of ``predict``. Cosines are counted in steps of 1 / ``STEPS``, rounded down.
    """
    right = judged.where(F.col("lang_pred") == F.col(lang_col))
    steps = right.groupBy(length_class(text_col).alias("k"), F.floor(F.col("score") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    by_class = W.partitionBy("k")  # STEPS + 1 rows at most
    below = F.coalesce(F.sum("n").over(by_class.orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumns({"below": below, "all": F.sum("n").over(by_class)})
    low = {x["k"]: x["step"] / STEPS / 2 for x in steps.where("100 * below <= all").groupBy("k").agg(F.max("step").alias("step")).collect()}
    return [low.get(k, 0.0) for k in range(4)]


B.by_value(__name__)

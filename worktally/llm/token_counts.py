"""Counts the tokens of texts without making them: byte-pair merging with a heap and a linked list.

A piece model merges neighbouring symbols in the order of its pieces' ranks, leftmost first among equals. Symbols start as
single characters in a linked list; a heap holds the neighbours that form a piece. The lowest rank is popped, its two
symbols become one, and the new neighbours go into the heap. Each merge takes one symbol away, so the count is the number
of initial symbols minus the number of merges; a symbol outside the model at the end counts its UTF-8 bytes. No
identifier is made.

A merge makes a piece, so where no piece has two characters side by side none is made across them: a text is cut at the
start of each run of spaces, which no piece has after another character, and, where the model's pieces allow it, between
letters and other characters. A task merges each different word once. Texts are neither shuffled nor sent anywhere: only counts leave
the task.
"""

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import functions as F

from worktally.llm import blocks as B

CACHE = 1_000_000  # different words kept with their counts in a task
KEPT = 64  # longer words are counted anew each time
LONG = 1 << 20  # texts of more characters are not cut into a list of words at once
SPACE = "▁"
_WORD = re.compile(" *[^ ]+| +")


class Pieces(dict):
    """Tokens of a word, by word; ``ranks`` has the rank of each piece."""

    def __init__(self, model):
        super().__init__()
        import sentencepiece
        p = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(p.vocab_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i))]
        probe = " a  ﬁ①\t"
        if p.normalize(probe) != SPACE + probe.replace(" ", SPACE) or any(p.is_unused(i) for i in plain):
            raise ValueError("only models that leave texts as they are, put a space first and have no unused pieces are counted")
        # whole numbers in the order of the scores; pieces of one score share one, and the leftmost goes first
        order = {x: k for k, x in enumerate(sorted({-p.get_score(i) for i in plain}))}
        self.ranks = {p.id_to_piece(i): order[-p.get_score(i)] for i in plain}
        self.letters = {x for x in self.ranks if len(x) == 1}
        if any(SPACE in x.lstrip(SPACE) for x in self.ranks):
            raise ValueError("a piece reaches over the start of a run of spaces")
        # letters apart from all else, if no piece mixes them
        odd = re.escape("".join(sorted({c for x in self.ranks for c in x if c.isalnum() and not c.isalpha()})))
        letter = re.compile(rf"[^\W\d_{odd}]")
        mixed = lambda x: 0 < len(letter.findall(x)) < len(x)
        part = re.compile(rf" *[^\W\d_{odd}]+| *(?:[^\w ]|[\d_{odd}])+| +")
        self.words = _WORD if any(mixed(x.lstrip(SPACE)) for x in self.ranks) else part
        self.unknown = any(p.is_byte(i) for i in range(p.vocab_size()))  # an unknown symbol counts its bytes

    def __missing__(self, word):
        out = self.merged(word.replace(" ", SPACE))
        if len(word) <= KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out

    def merged(self, text):
        """Initial symbols minus merges, with unknown symbols counted by their bytes."""
        rank_of, n = self.ranks.get, len(text)
        symbol, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank_of(text[i:i + 2]) for i in range(n - 1)]  # of a symbol and the next; the heap has rank * n + place
        pair.append(None)
        heap = [r * n + i for i, r in enumerate(pair) if r is not None]
        heapify(heap)
        left = n
        while heap:
            rank, i = divmod(heappop(heap), n)
            if pair[i] != rank:
                continue  # one of the two has changed meanwhile
            j = after[i]
            piece = symbol[i] = symbol[i] + symbol[j]
            pair[j] = symbol[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = pair[i] = rank_of(piece + symbol[k])
                if rank is not None:
                    heappush(heap, rank * n + i)
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                rank = pair[h] = rank_of(symbol[h] + piece)
                if rank is not None:
                    heappush(heap, rank * n + h)
        if not self.unknown or self.letters.issuperset(text):
            return left
        return left + sum(len(x.encode()) - 1 for x in symbol if x and x not in self.ranks)

    def count(self, text):
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")
        words = self.words.findall(text) if len(text) <= LONG else (m[0] for m in self.words.finditer(text))
        return sum(map(self.__getitem__, words))


def count_tokens(docs, model, limit, id_col="doc_id", text_col="text"):
    """A row per row of ``docs``: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). Other columns are left out.

    ``model`` is the file of a byte-pair piece model with byte fallback that keeps texts as they are; it must lie at the same path on every
    executor. Counts equal the library's, without begin and end; markers of special tokens inside a text are ordinary
    text. A null or empty text has no tokens. Whole texts are counted, however long; repeated rows are counted alike.
    """
    B.bounded(docs.sparkSession)

    def count(batches):
        pieces = Pieces(model)
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([pieces.count(x) for x in texts], pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


B.by_value(__name__)

"""Indel similarity of one string against many, vectorised over the many.

ratio(a, b) = 2 * LCS(a, b) / (|a| + |b|). The common subsequence length is found with one machine
word per candidate: bit j of ``free`` stays set while character j of the candidate is unmatched.
Candidates of over 63 characters use whole Python integers with the same recurrence.
"""

import numpy as np

from worktally.session import by_value

WORD = 63


def lcs_long(a, b):
    """Common subsequence length of two strings of any length."""
    masks = {}
    for j, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << j)
    full = (1 << len(b)) - 1
    free = full
    for ch in a:
        hit = free & masks.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(b) - bin(free).count("1")


def coded(texts):
    """(the different code points, for each character of the joined texts the number of its code point)"""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    held = np.zeros(int(points.max(initial=0)) + 1, bool)
    held[points] = True
    return np.flatnonzero(held), (np.cumsum(held) - 1)[points]


class Texts:
    """Candidate strings prepared for repeated comparison."""

    def __init__(self, texts):
        self.texts = list(texts)
        self.length = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.short = self.length <= WORD
        rows = np.flatnonzero(self.short)
        size = self.length[rows]
        begin = np.cumsum(size) - size
        letters, code = coded([self.texts[i] for i in rows])
        self.table = np.zeros((len(letters) + 1, len(self.texts)), np.uint64)  # the last row matches nothing
        for j in range(int(size.max(initial=0))):
            has = np.flatnonzero(j < size)
            self.table[code[begin[has] + j], rows[has]] |= np.uint64(1 << j)
        self.code = {chr(c): i for i, c in enumerate(letters.tolist())}
        self.masks = {ch: self.table[i] for ch, i in self.code.items()}
        self.full = (np.uint64(1) << self.length.clip(max=WORD).astype(np.uint64)) - np.uint64(1)

    def lcs(self, a, rows=None):
        """Common subsequence length of ``a`` with every candidate (or the given rows)."""
        rows = np.arange(len(self.texts)) if rows is None else rows
        full = self.full[rows]
        free = full.copy()
        zero = np.zeros(len(rows), dtype=np.uint64)
        for ch in a:
            column = self.masks.get(ch)
            hit = free & (column[rows] if column is not None else zero)
            free = ((free + hit) | (free - hit)) & full
        found = self.length[rows] - np.bitwise_count(free).astype(np.int64)
        for k in np.flatnonzero(~self.short[rows]):
            found[k] = lcs_long(a, self.texts[rows[k]])
        return found

    def ratio(self, a, rows=None):
        rows = np.arange(len(self.texts)) if rows is None else rows
        total = len(a) + self.length[rows]
        return np.where(total > 0, 2 * self.lcs(a, rows) / np.maximum(total, 1), 1.0)


def best_window(short, long):
    """Best ratio of the shorter string against windows of its length, cut ones at both ends."""
    n, m = len(short), len(long)
    if n == 0:
        return 1.0 if m == 0 else 0.0
    best = 0.0
    for i in range(1 - n, m):
        window = long[max(i, 0):i + n]
        size = n + len(window)
        if 2 * min(n, len(window)) / size > best:
            best = max(best, 2 * lcs_long(short, window) / size)
    return best


def partial_ratio(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = best_window(short, long)
    return max(best, best_window(long, short)) if len(a) == len(b) else best


def partial_ratios(first, second):
    """``partial_ratio`` of many pairs at once, in runs of bounded size; pairs with a long string one by one."""
    out = np.zeros(len(first))
    both = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(first, second)]
    easy = [i for i, (a, b) in enumerate(both) if 0 < len(a) <= WORD and len(b) <= 4 * WORD]
    for x in range(0, len(easy), 4096):
        run = easy[x:x + 4096]
        out[run] = best_windows([both[i] for i in run])
        even = [i for i in run if len(both[i][0]) == len(both[i][1])]
        if even:
            out[even] = np.maximum(out[even], best_windows([both[i][::-1] for i in even]))
    for i in set(range(len(both))) - set(easy):
        out[i] = partial_ratio(*both[i])
    return out


def best_windows(pairs):
    """``best_window`` of pairs (short, long), both not empty and the shorter of ``WORD`` characters at most.

    The cut windows at an end are the beginnings of the long string, or of both strings turned round: one run over
    its characters tells the common subsequence of each. Only whole windows are compared one by one.
    """
    n, m = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    letters, code = coded([x for p in pairs for x in p])
    begin, row = np.cumsum(n + m) - n - m, np.arange(len(pairs))
    tables = np.zeros((2, len(letters) + 1, len(pairs)), np.uint64)
    for j in range(int(n.max())):
        has = np.flatnonzero(j < n)
        tables[0, code[begin[has] + j], has] |= np.uint64(1 << j)
        tables[1, code[begin[has] + n[has] - 1 - j], has] |= np.uint64(1 << j)
    texts = np.full((2, int(m.max()), len(pairs)), len(letters))
    for j in range(texts.shape[1]):
        has = np.flatnonzero(j < m)
        texts[0, j, has] = code[begin[has] + n[has] + j]
        texts[1, j, has] = code[begin[has] + n[has] + m[has] - 1 - j]
    full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    best = np.zeros(len(pairs))
    for table, text in zip(tables, texts):
        free = full.copy()
        for t in range(int(n.max()) - 1):  # cut ones
            hit = free & table[text[t], row] if t < len(text) else np.uint64(0) * free
            free = ((free + hit) | (free - hit)) & full
            best = np.maximum(best, np.where(t < n - 1, 2 * (n - np.bitwise_count(free).astype(np.int64)) / (n + t + 1), 0.0))
    for i in range(int((m - n).max()) + 1):  # whole ones
        has = np.flatnonzero(i + n <= m)
        size, whole, free = n[has], full[has], full[has]
        for t in range(int(size.max())):
            at = np.minimum(i + t, m[has] - 1)
            hit = np.where(t < size, free & tables[0][texts[0][at, has], has], np.uint64(0))
            free = ((free + hit) | (free - hit)) & whole
        best[has] = np.maximum(best[has], (size - np.bitwise_count(free).astype(np.int64)) / size)
    return best


def token_sorted(text):
    return " ".join(sorted(text.split()))


CHARS = 128          # counters of characters; code points that share one only loosen a bound
LONGEST = 30_000     # counters hold no more; longer names are compared without bounds
SURE = 1e-9
PART = 256           # rows of a block that are passed over together
SEEDS = 64           # beginnings followed for a floor; blocks of eight times as many rows are searched by tries
LEVELS = 0.9, 0.8, 0.7, 0.6  # scores that a name's best are sought at, one after the other
FRONTIER = 1 << 20   # beginnings compared at once
TABLE = 1 << 23      # entries of a table of bounds
WINDOWS = 4096       # pairs whose windows are compared at once


def char_counts(texts):
    """texts x ``CHARS`` numbers: how often each character occurs."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % CHARS
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(row * CHARS + points, minlength=len(texts) * CHARS).clip(max=LONGEST).astype(np.int16).reshape(-1, CHARS)


def shared_chars(a, b):
    """Sum of the smaller counts, for all rows of ``a`` with all of ``b``: no common subsequence is longer."""
    out = np.zeros((len(a), len(b)), np.int16)
    for c in np.flatnonzero(a.any(0) & b.any(0)):
        out += np.minimum(a[:, c, None], b[None, :, c])
    return out


class Names:
    """Probe names: as they are, with sorted words, and what bounds need."""

    def __init__(self, names):
        self.raw, self.key = list(names), [token_sorted(n) for n in names]
        self.counts = np.maximum(char_counts(self.raw), char_counts(self.key))
        self.size = np.array([[len(n), len(k)] for n, k in zip(self.raw, self.key)], np.int64).reshape(-1, 2)


def parts_bounds(common, key, raw, least, weight):
    """The best that sorted words against those of the full name, those of the cleaned one (-1: empty) and windows of the full
    name can score if no more than ``common`` characters are shared; lengths of the name and, in ``least``, of the other side."""
    def whole(size):
        c = np.minimum(common, key)
        return np.where(key + size > 0, 2 * c / np.maximum(key + np.maximum(c, size), 1), 1.0)

    shorter = np.minimum(raw, least[..., 2])
    c = np.minimum(common, raw)
    part = np.where(shorter <= c, 1.0, 2 * c / np.maximum(shorter + c, 1))
    out = whole(least[..., 0]), np.where(least[..., 1] >= 0, whole(np.maximum(least[..., 1], 0)), 0.0), weight * part
    return [np.where(raw > LONGEST, 1.0, x) for x in out]


def upper_bounds(names, counts, least, weight):
    """The best score each name can have with rows of which ``counts`` are the most of each character and ``least`` the
    least lengths: words of the full name sorted, those of the cleaned one (-1: empty), full name as it is."""
    common = shared_chars(names.counts, counts).astype(np.float64)
    return np.maximum.reduce(parts_bounds(common, names.size[:, 1, None], names.size[:, 0, None], least, weight))


def likeness(names, mean):
    """How like each name is to rows of which ``mean`` are the mean numbers of each character: where to look first, no bound."""
    common = sum(np.minimum(names.counts[:, c, None].astype(np.float32), mean[None, :, c]) for c in range(CHARS))
    return 2 * common / np.maximum(names.size[:, 1, None] + mean.sum(1), 1)


class Trie:
    """Strings of one length as paths; each path's beginning is compared once with a name, however many rows share it."""

    def __init__(self, codes, rows):
        """``codes``: a row of character codes per string, in the order they are compared; ``rows``: what each string stands for."""
        order = np.lexsort(codes.T[::-1]) if codes.shape[1] else np.arange(len(codes))
        codes, self.rows = codes[order], rows[order]
        other = np.pad(codes[1:] != codes[:-1], ((0, 0), (0, 1)), constant_values=True)
        parts = np.append(-1, other.argmax(1))  # where each string leaves the one before
        starts = [np.zeros(1, np.int64)] + [np.flatnonzero(parts <= d) for d in range(codes.shape[1])]
        self.chars = [codes[x, d] for d, x in enumerate(starts[1:])]
        self.kids = [np.append(np.searchsorted(b, a), len(b)) for a, b in zip(starts, starts[1:])]
        self.ends = np.append(starts[-1], len(codes))

    def search(self, bits, size, need, width=None):
        """(name, row, common subsequence length) of those that reach ``need``; with ``width``, only ``width`` beginnings of
        each name are followed, the most promising. ``bits``: by code and name, where the name has the character.

        After a beginning of the string, what is left of the name and of the string bounds what may still be common: the
        bound is highest where as much is left of both.
        """
        who = np.flatnonzero(need <= np.minimum(size, len(self.chars)))
        out = [self._from(bits, size, need, width, who[a:a + 4096]) for a in range(0, len(who), 4096)]
        return [np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64) for n in range(3)]

    def _from(self, bits, size, need, width, who):
        top = who
        full = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
        node, free = np.zeros(len(who), np.int64), full[who]
        for d, (kids, chars) in enumerate(zip(self.kids, self.chars)):
            n = kids[node + 1] - kids[node]
            total = int(n.sum())
            if total > FRONTIER and len(top) > 1:
                half = [self._from(bits, size, need, width, x) for x in np.array_split(top, 2)]
                return [np.concatenate(x) for x in zip(*half)]
            of = np.repeat(np.arange(len(node)), n)
            node = np.arange(total) - np.repeat(np.cumsum(n) - n - kids[node], n)
            who, free = who[of], free[of]
            hit = free & bits[chars[node], who]
            free = ((free + hit) | (free - hit)) & full[who]
            left = len(self.chars) - d - 1
            at = np.maximum(size[who] - left, 0)
            bound = at - np.bitwise_count(free & ((np.uint64(1) << at.astype(np.uint64)) - np.uint64(1))).astype(np.int64) + np.minimum(size[who], left)
            keep = np.flatnonzero(bound >= need[who])
            if width is not None:
                keep = keep[np.lexsort((-bound[keep], who[keep]))]
                keep = keep[np.arange(len(keep)) - np.searchsorted(who[keep], who[keep]) < width]
            node, who, free = node[keep], who[keep], free[keep]
        n = self.ends[node + 1] - self.ends[node]
        row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.ends[node], n)
        return np.repeat(who, n), self.rows[row], np.repeat(size[who] - np.bitwise_count(free).astype(np.int64), n)


class Tries:
    """The strings of a block by length; ``turned``: compared from their ends, where rows share more."""

    def __init__(self, texts, turned=False, empty=True):
        length = np.array([len(t) for t in texts], np.int64)
        self.letters, code = coded(texts)
        begin = np.cumsum(length) - length
        self.tries, self.turned = {}, turned
        for m in np.unique(length):
            rows = np.flatnonzero(length == m)
            if m or empty:
                at = begin[rows, None] + (np.arange(m)[::-1] if turned else np.arange(m))
                self.tries[int(m)] = Trie(code[at], rows)

    def search(self, names, need, width=None):
        """As ``Trie.search``, over all lengths; ``need`` tells what a name needs, from its length and that of the string."""
        size = np.array([len(n) for n in names], np.int64)
        begin = np.cumsum(size) - size
        letters, code = coded(names)
        place = np.searchsorted(self.letters, letters)
        place[~np.isin(letters, self.letters)] = len(self.letters)  # the last row is never asked
        code, bits = place[code], np.zeros((len(self.letters) + 1, len(names)), np.uint64)
        for j in range(int(size.max(initial=0))):
            has = np.flatnonzero(j < size)
            bits[code[begin[has] + (size[has] - 1 - j if self.turned else j)], has] |= np.uint64(1 << j)
        out = [(*t.search(bits, size, need(size, m), width), m) for m, t in self.tries.items()]
        at, to, common = (np.concatenate([o[n] for o in out]) for n in range(3))
        return at, to, common, np.repeat([o[3] for o in out], [len(o[0]) for o in out])


class Roster:
    """A block of the roster: full and cleaned names."""

    def __init__(self, ids, full, cleaned, weight):
        full, cleaned = [f.lower() for f in full], [c.lower() for c in cleaned]
        order = sorted(range(len(full)), key=lambda i: sorted(full[i], reverse=True))  # a part holds names of like characters
        self.ids, self.weight = np.asarray(ids)[order], weight
        self.full = [full[i] for i in order]
        key, clean = [token_sorted(f) for f in self.full], [token_sorted(cleaned[i]) for i in order]
        self.texts = [Texts(key), Texts(clean), Texts(self.full)]
        self.counts = np.maximum(np.maximum(char_counts(key), char_counts(clean)), char_counts(self.full))
        self.least = np.stack([t.length for t in self.texts], 1)
        self.least[self.least[:, 1] == 0, 1] = -1
        self.sizes, kind = np.unique(self.least, axis=0, return_inverse=True)
        self.kind = kind.ravel()
        self.begin = np.arange(0, len(full), PART)
        self.tries = None
        self.part_counts, self.part_least = self.facts(self.begin)

    def facts(self, begin):
        """The most of each character and the least lengths (cleaned: -1 if all are empty) from each row of ``begin`` to the next."""
        none = np.iinfo(np.int64).max
        least = np.minimum.reduceat(np.where(self.least < 0, none, self.least), begin)
        return np.maximum.reduceat(self.counts, begin), np.where(least == none, -1, least)

    def bounds_of(self, names):
        """(for each name the number of its lengths, the best score by those, characters shared and kind of row); the
        latter None where lengths are too many for a table."""
        lengths, which = np.unique(names.size, axis=0, return_inverse=True)
        most = int(names.counts.sum(1).max(initial=0)) + 1
        if most * len(lengths) * len(self.sizes) > TABLE:
            return which.ravel(), None
        raw, key = (lengths[:, i, None, None] for i in (0, 1))
        return which.ravel(), np.maximum.reduce(parts_bounds(np.arange(most)[None, :, None], key, raw, self.sizes, self.weight)) + SURE

    def pairs(self, names, floors, which, table):
        """(row of the name, row, characters shared) of the pairs whose bound reaches the floor, by name."""
        if table is not None:
            need = np.stack([(table[w] < f).sum(0) for w, f in zip(which, floors)]).astype(np.int16)
        part = upper_bounds(names, self.part_counts, self.part_least, self.weight)
        found = []
        for p, a in enumerate(self.begin):
            some, z = np.flatnonzero(part[:, p] >= floors - SURE), min(a + PART, len(self.ids))
            if not len(some):
                continue
            common = shared_chars(names.counts[some], self.counts[a:z])
            if table is None:
                bounds = parts_bounds(common.astype(np.float64), names.size[some, 1, None], names.size[some, 0, None], self.least[a:z], self.weight)
                i, j = np.nonzero(np.maximum.reduce(bounds) >= floors[some, None] - SURE)
            else:
                i, j = np.nonzero(common >= need[some][:, self.kind[a:z]])
            found.append((some[i], a + j, common[i, j]))
        at, to, common = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in range(3))
        order = np.argsort(at, kind="stable")
        return at[order], to[order], common[order]

    def best(self, names, k, floors, windows=True):
        """(row of the name, id, score) of the ``k`` best of each name that score its floor or more; exact.

        Floors rise to the ``k``-th best score so far. Without ``windows`` scores are whole-string ratios, never above the
        true ones, and in a block of many rows the best are sought among the most promising only: they give a floor.
        """
        floors = np.asarray(floors, np.float64).copy()
        easy = (names.size > 0).all(1) & (names.size <= WORD).all(1) & (len(self.ids) > 8 * SEEDS)
        out = []
        for some, way in ((np.flatnonzero(easy), self._by_tries), (np.flatnonzero(~easy), self._by_pairs)):
            if len(some):
                at, to, score = way(names if len(some) == len(easy) else Names([names.raw[i] for i in some]), k, floors[some], windows)
                first = np.lexsort((self.ids[to], -score, at))
                first = first[np.arange(len(at)) - np.searchsorted(at[first], at[first]) < k]
                out.append((some[at[first]], self.ids[to[first]], score[first]))
        return [np.concatenate([o[n] for o in out]) for n in range(3)]

    def _by_tries(self, names, k, floors, windows):
        """Names of ``WORD`` characters at most: a common subsequence is sought along the tries, which leave off where the floor is out of reach."""
        whole = lambda f: lambda n, m: np.maximum(np.ceil((f - SURE) * (n + m) / 2), 0).astype(np.int64)
        if self.tries is None:
            self.tries = Tries(self.texts[0].texts, turned=True), Tries(self.texts[1].texts, empty=False), Tries(self.full)
        if not windows:
            found, todo = [], np.arange(len(floors))
            for least in (*LEVELS, None):  # most names end with a high one, which costs little
                at, to, common, m = self.tries[0].search([names.key[i] for i in todo], whole(np.full(len(todo), least or -1.0)), None if least else SEEDS)
                few = (np.bincount(at, minlength=len(todo)) < k) & (least is not None)
                done = np.flatnonzero(~few[at])
                found.append((todo[at[done]], to[done], 2 * common[done] / (names.size[todo[at[done]], 1] + m[done])))
                todo = todo[few]
            return [np.concatenate(x) for x in zip(*found)]
        at, to, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for tries in self.tries[:2]:
            i, j, common, m = tries.search(names.key, whole(floors))
            at, to, score = self._merged((at, i), (to, j), (score, 2 * common / (names.size[i, 1] + m)))
            self._raise(floors, at, score, k)

        def part(n, m):  # the best window may have all that is common, and no more
            s = np.minimum(n, m)
            return np.where(floors - SURE > self.weight, s + 1, np.maximum(np.ceil((floors - SURE) * s / np.maximum(2 * self.weight - floors, SURE)), 0)).astype(np.int64)

        i, j, common, m = self.tries[2].search(names.raw, part)
        shorter = np.minimum(names.size[i, 0], m)
        bound = self.weight * np.where(shorter > 0, 2 * common / np.maximum(shorter + common, 1), 0.0)
        order = np.argsort(-bound, kind="stable")  # the best first, as they raise floors for the others
        for a in range(0, len(order), WINDOWS):
            few = order[a:a + WINDOWS]
            few = few[bound[few] >= floors[i[few]] - SURE]
            if len(few):
                found = self.weight * partial_ratios([names.raw[x] for x in i[few]], [self.full[x] for x in j[few]])
                high = np.flatnonzero(found >= floors[i[few]] - SURE)
                at, to, score = self._merged((at, i[few[high]]), (to, j[few[high]]), (score, found[high]))
                self._raise(floors, at, score, k)
        near = np.flatnonzero(score >= floors[at] - SURE)
        return at[near], to[near], score[near]

    def _merged(self, at, to, score):
        """One row per pair, with its best score, by name."""
        at, to, score = (np.concatenate(x) for x in (at, to, score))
        order = np.lexsort((-score, at * len(self.ids) + to))
        at, to, score = at[order], to[order], score[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (to[1:] != to[:-1])
        return at[new], to[new], score[new]

    def _by_pairs(self, names, k, floors, windows):
        """Pair by pair: a pair is compared only where its bound reaches the floor, in each of the three ways only where that way's bound does."""
        which, table = self.bounds_of(names)
        at, to, common = self.pairs(names, floors, which, table)
        raw = names.size[at, 0]
        bounds = parts_bounds(common.astype(np.float64), names.size[at, 1], raw, self.least[to], self.weight)
        score = np.zeros(len(at))
        for n in (0, 1):
            near = np.flatnonzero((bounds[n] > score) & (bounds[n] >= floors[at] - SURE))
            score[near] = np.maximum(score[near], self._ratio(names.key, at[near], to[near], self.texts[n]))
            self._raise(floors, at, score, k)
        if windows:
            near = np.flatnonzero((bounds[2] > score) & (bounds[2] >= floors[at] - SURE))
            length = self.texts[2].length[to[near]]
            shorter, shared = np.minimum(raw[near], length), pairs_lcs(names.raw, at[near], to[near], self.texts[2])
            bound = self.weight * np.where(shorter > 0, 2 * shared / np.maximum(shorter + shared, 1), raw[near] == length)
            order = np.argsort(-bound, kind="stable")  # the best first, as they raise floors for the others
            near, bound = near[order], bound[order]
            for a in range(0, len(near), WINDOWS):
                few, most = near[a:a + WINDOWS], bound[a:a + WINDOWS]
                few = few[(most > score[few]) & (most >= floors[at[few]] - SURE)]
                if len(few):
                    score[few] = np.maximum(score[few], self.weight * partial_ratios([names.raw[i] for i in at[few]], [self.full[j] for j in to[few]]))
                    self._raise(floors, at, score, k)
        near = np.flatnonzero(score >= floors[at] - SURE)
        return at[near], to[near], score[near]

    def _raise(self, floors, at, score, k):
        """Floors rise to the ``k``-th best score of a name; ``at`` ascends."""
        high = np.flatnonzero(score >= floors[at])
        at, score = at[high], score[high]
        order = np.lexsort((-score, at))
        kth = order[np.arange(len(at)) - np.searchsorted(at, at) == k - 1]
        floors[at[kth]] = np.maximum(floors[at[kth]], score[kth])

    def _ratio(self, names, at, to, texts):
        total = np.array([len(n) for n in names], np.int64)[at] + texts.length[to]
        return np.where(total > 0, 2 * pairs_lcs(names, at, to, texts) / np.maximum(total, 1), 1.0)


def pairs_lcs(names, at, to, texts):
    """Common subsequence length of ``names[at]`` and row ``to`` of ``texts``, pair by pair, many at once."""
    out = np.zeros(len(at), np.int64)
    if not len(at):
        return out
    chars, table = texts.code, texts.table
    size = np.array([len(n) for n in names])
    step = max(256, (1 << 21) // (int(size.max()) + 1))
    for a in range(0, len(at), step):
        i, j = at[a:a + step], to[a:a + step]
        used = np.unique(i)
        codes = np.full((len(used), int(size[used].max())), len(chars), np.int64)  # the last row of the table matches nothing
        for r, x in enumerate(used):
            codes[r, :size[x]] = [chars.get(ch, len(chars)) for ch in names[x]]
        codes = codes[np.searchsorted(used, i)].T
        full = texts.full[j]
        free = full.copy()
        for code in codes:
            hit = free & table[code, j]
            free = ((free + hit) | (free - hit)) & full
        out[a:a + step] = texts.length[j] - np.bitwise_count(free).astype(np.int64)
    for p in np.flatnonzero(~texts.short[to]):
        out[p] = lcs_long(names[at[p]], texts.texts[to[p]])
    return out


by_value(__name__)

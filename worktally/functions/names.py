"""Person-name cleaning as Column expressions."""

from pyspark.sql import functions as F

from worktally import params as P
from worktally.functions import patterns as RX


def bind(value, body):
    """Evaluates ``value`` once and passes it to ``body``; keeps long chains from being copied."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text):
    """Whitespace-separated words; no empty ones."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def in_list(word, vocabulary):
    return F.array_contains(F.array(*[F.lit(v) for v in vocabulary]), word)


def title(text):
    """Every run of letters starts with a capital, also after hyphens and apostrophes."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def title_if_upper(text):
    return F.when((text == F.upper(text)) & (text != ""), title(text)).otherwise(text)


def clean_for_matching(name):
    """Digits out, separators to spaces, period and company words out, capitals to title case."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"\b\d+\b", ""), r"[_\-]+", " ")
    kept = F.filter(words(spaced), lambda w: ~F.lower(w).isin(P.MATCH_NOISE_WORDS))
    return bind(F.array_join(kept, " "), title_if_upper)


def _trim_noise(tokens):
    """Drops noise words at both ends, keeping those inside."""
    good = F.transform(tokens, lambda w: ~F.lower(w).isin(P.NAME_NOISE_WORDS))
    return bind(F.struct(tokens.alias("t"), good.alias("g")), lambda s: bind(
        F.struct(F.array_position(s.g, True).alias("a"),
                 F.array_position(F.reverse(s.g), True).alias("z")),
        lambda p: F.when(p.a == 0, F.slice(s.t, 1, 0)).otherwise(
            F.slice(s.t, p.a.cast("int"), (F.size(s.t) - p.z - p.a + 2).cast("int")))))


def clean_extracted(name):
    """A person name freed of labels and dates, or NULL when nothing sure is left."""
    swap = r"^([A-Za-z][A-Za-z\-']+),\s+([A-Za-z][A-Za-z\-' ]+)$"
    base = F.trim(name)
    swapped = F.when(base.rlike(swap), F.regexp_replace(base, swap, "$2 $1")).otherwise(base)

    def after_case(s):
        letters = F.filter(words(s), lambda w: w.rlike(r"^[A-Za-z]+$"))
        shout = F.forall(letters, lambda w: w == F.upper(w))
        cased = F.when(shout, title(s)).otherwise(s)
        tokens = words(F.regexp_replace(cased, r"\b\d+\b", ""))
        return bind(tokens, decide)

    def decide(tokens):
        return bind(F.struct(F.size(tokens).alias("n"), _trim_noise(tokens).alias("k")), lambda r: bind(
            F.struct(r.n.alias("n"), r.k.alias("k"), F.array_join(r.k, " ").alias("s")), verdict))

    def verdict(r):
        proper = F.exists(r.k, lambda w: w.rlike("^[A-Z]"))
        ok = (proper & ~((r.n >= 2) & (F.size(r.k) == 1)) & ~F.lower(r.s).isin(P.REJECTED_NAMES)
              & (F.length(r.s) > 2))
        return F.when(ok, r.s)

    return F.when(base != "", bind(swapped, after_case))


def from_file_name(path):
    """Two or more capitalised words left in a file name after dates and noise words go."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")
    spaced = F.regexp_replace(stem, r"[_\-]+", " ")
    spaced = F.regexp_replace(spaced, rf"(?i)\b(?:{RX.MONTH})\b", " ")
    spaced = F.regexp_replace(spaced, r"\b\d{4}\b|\b\d{1,2}[-/]\d{1,2}\b", " ")
    kept = F.filter(words(spaced), lambda w: ~F.lower(w).isin(P.NAME_NOISE_WORDS))
    found = bind(bind(F.array_join(kept, " "), title_if_upper),
                 lambda s: F.regexp_extract(s, RX.PROPER_RUN, 1))
    return F.nullif(found, F.lit(""))


def looks_like_address(name, text):
    """``12 Name Street`` in the text: the name is part of an address."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    streets = "|".join(P.STREET_WORDS)
    pattern = F.concat(F.lit(r"(?i)\d+\w*\s+"), quoted, F.lit(rf"\s+(?:{streets})"))
    return F.coalesce(F.regexp_like(text, pattern), F.lit(False))


def usable(name):
    """Trimmed name when longer than two characters, else NULL."""
    s = F.trim(name)
    return F.when(F.length(s) > 2, s)

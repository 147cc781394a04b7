"""Name and text similarity, search and cleaning as column expressions."""

from __future__ import annotations

import unicodedata
from array import array
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value list: legal forms dropped from company names.
COMPANY_SUFFIXES = (
    "inc", "llc", "ltd", "ab", "gmbh", "pty", "co", "corp", "sa", "srl", "as", "oy", "oyj", "ag", "bv", "nv", "se",
    "plc", "pbc", "sarl", "oü", "ou", "ug", "kg", "mbh", "lda", "limited", "incorporated", "corporation",
)
# Fixed value list: second-level labels that make a two-part public suffix.
TWO_PART_TLDS = ("co.uk", "com.au", "co.nz", "co.za", "com.br", "com.mx", "co.jp", "com.cn")


def _accent_table() -> tuple[str, str]:
    """Accented letters and their base letters, by canonical decomposition."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _accent_table()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _FROM, _TO), "[\\u0300-\\u036f]", "")


def trigrams(c: Column) -> Column:
    """Trigrams in order, words padded with two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(
        words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    )
    return F.flatten(grams)


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both."""
    ta, tb = F.array_distinct(trigrams(a)), F.array_distinct(trigrams(b))
    return F.size(F.array_intersect(ta, tb)) / F.greatest(F.lit(1), F.size(F.array_union(ta, tb)))


@lru_cache(maxsize=100_000)
def _ordered_grams(text: str) -> tuple[str, ...]:
    words = "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()
    return tuple(f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1))


def _best_run(a: str | None, b: str | None) -> float:
    """Best similarity of the trigram set of ``a`` with any run of trigrams of ``b``."""
    if not a or not b:
        return 0.0
    own, other = frozenset(_ordered_grams(a)), _ordered_grams(b)
    best, n_own = 0.0, len(own)
    starts = [i for i, g in enumerate(other) if g in own]
    for k, start in enumerate(starts):
        if len(starts) - k <= best * n_own:
            break  # a run from here on cannot hold enough shared trigrams
        seen, hits = set(), 0
        for g in other[start:]:
            if g in seen:
                continue
            seen.add(g)
            if g in own:
                hits += 1
                best = max(best, hits / (n_own + len(seen) - hits))
    return best


@lru_cache(maxsize=20_000)
def _gram_set(text: str) -> frozenset[str]:
    return frozenset(_ordered_grams(text))


@lru_cache(maxsize=50_000)
def _repeats(text: str) -> bytes:
    """For each trigram in order the place where it comes first."""
    first: dict[str, int] = {}
    return array("I", [first.setdefault(g, i) for i, g in enumerate(_ordered_grams(text))]).tobytes()


@lru_cache(maxsize=100_000)
def _best_at(hits: bytes, repeats: bytes, n_own: int) -> float:
    """``_best_run`` of ``n_own`` trigrams, told which places of the other text are shared and where its trigrams come first."""
    first = array("I", repeats)
    best = 0.0
    starts = [i for i, hit in enumerate(hits) if hit]
    for k, start in enumerate(starts):
        if len(starts) - k <= best * n_own:
            break  # a run from here on cannot hold enough shared trigrams
        seen, shared = set(), 0
        for i in range(start, len(hits)):
            if first[i] in seen:
                continue
            seen.add(first[i])
            if hits[i]:
                shared += 1
                best = max(best, shared / (n_own + len(seen) - shared))
    return best


def _best_run_over(a: str | None, b: str | None, least: float) -> float:
    """``_best_run`` where it is above ``least``, else 0.0; most pairs below are told by their shared trigrams alone.

    Which letters are shared does not matter, only where, so names that are alike share the search for the run.
    """
    if not a or not b:
        return 0.0
    own = _gram_set(a)
    hits = bytes(map(own.__contains__, _ordered_grams(b)))
    # a run holds at most the trigrams that the whole texts share
    if hits.count(1) <= least * len(own):
        return 0.0
    best = _best_at(hits, _repeats(b), len(own))
    return best if best > least else 0.0


def _fits(a: str | None, b: str | None, least: float) -> bool:
    """Whether ``_best_run`` is above ``least``; the whole of ``b`` is one of its runs, so it is tried first."""
    if not a or not b:
        return False
    own, other = _gram_set(a), _gram_set(b)
    return len(own & other) > least * len(own | other) or _best_run_over(a, b, least) > 0.0


def word_similarity_over(a: str, b: str, least: float) -> Column:
    """``word_similarity`` of two columns where it is above ``least``, else 0."""
    run = F.pandas_udf(lambda x, y: pd.Series([_best_run_over(p, q, least) for p, q in zip(x, y)], dtype="float64"), T.DoubleType())
    return run.asNondeterministic()(a, b)


def word_fits(a: str, b: str, least: float) -> Column:
    """Whether ``word_similarity`` of two columns is above ``least``."""
    run = F.pandas_udf(lambda x, y: pd.Series([_fits(p, q, least) for p, q in zip(x, y)], dtype="bool"), T.BooleanType())
    return run.asNondeterministic()(a, b)


def _word_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_best_run(x, y) for x, y in zip(a, b)], dtype="float64")


# How well ``a`` fits some part of ``b`` (asymmetric). Arrow batches: as nested array
# expressions the run search was about fifty times slower. Declared non-deterministic so
# that a filter on it is not pushed below the distinct or join that makes the pairs.
word_similarity = F.pandas_udf(_word_similarity, T.DoubleType()).asNondeterministic()


def name_tokens(c: Column) -> Column:
    """Lower-case tokens without accents, punctuation and legal forms."""
    plain = F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), "[.,\\-_'\"()&]", " ")
    return F.filter(F.split(plain, "\\s+"), lambda t: (t != "") & ~t.isin(*COMPANY_SUFFIXES))


def name_form(tokens: Column) -> Column:
    """What the name rules read of a token list."""
    return F.struct(tokens.alias("tokens"), F.array_join(tokens, " ").alias("spaced"), F.array_join(tokens, "").alias("glued"))


def form_score(x: Column, y: Column) -> Column:
    """Best of the name rules between two ``name_form``."""
    a, b = x["tokens"], y["tokens"]
    ja, jb = x["spaced"], y["spaced"]
    ca, cb = x["glued"], y["glued"]
    jaccard = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    contains = (F.length(ja) >= 3) & (F.length(jb) >= 3) & (F.contains(ja, jb) | F.contains(jb, ja))
    first_a, first_b = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    prefix = (F.length(first_a) >= 3) & (first_a == first_b)
    glued = (F.length(ca) >= 4) & (F.length(cb) >= 4)
    score = F.greatest(
        jaccard,
        F.when(contains, 0.85).otherwise(0.0),
        F.when(prefix, 0.6).otherwise(0.0),
        F.when(glued & (ca == cb), 0.95).when(glued & (F.contains(ca, cb) | F.contains(cb, ca)), 0.8).otherwise(0.0),
    )
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score)


def name_score_tokens(inbox: Column, *others: Column, alias: Column | None = None) -> Column:
    best = F.greatest(*[form_score(name_form(inbox), name_form(o)) for o in others], F.lit(0.0))
    if alias is not None:
        best = F.greatest(best, F.coalesce(alias, F.lit(0.0)))
    return F.when(F.size(inbox) == 0, 0.0).otherwise(best)


def name_score(inbox: Column, *others: Column, alias: Column | None = None) -> Column:
    """0..1 fit of a document's name with any of the given names."""
    return name_score_tokens(name_tokens(inbox), *[name_tokens(o) for o in others], alias=alias)


def learning_name(c: Column) -> Column:
    """Name form under which pair history is kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[.,\\-_'\"()&]", " "), "\\s+", " "))


def search_match(text: Column, query: str) -> Column:
    """Every query term must start some word of the text."""
    terms = [t for t in query.strip().lower().split() if t]
    words = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")

    def some_word(term):
        return F.exists(words, lambda w: w.startswith(term))

    out = F.lit(True)
    for t in terms:
        out = out & some_word(t)
    return out


def clean_text(c: Column) -> Column:
    """Control characters out, line breaks and tabs among them; runs of other white space to one blank."""
    no_ctrl = F.regexp_replace(c, "[\\x00-\\x1F\\x7F-\\x9F]", "")
    return F.trim(F.regexp_replace(no_ctrl, "[ \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+", " "))


def limit_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(c, "\\s+"), lambda w: w != ""), 1, n), " ")


def root_domain(url: Column) -> Column:
    """Registrable domain of a URL or host, two-part suffixes included."""
    host = F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), "^[a-zA-Z]+://", ""), "[/?#:].*$", ""))
    parts = F.split(F.regexp_replace(host, "^www\\.", ""), "\\.")
    n = F.size(parts)
    last2 = F.array_join(F.slice(parts, F.greatest(F.lit(1), n - 1), 2), ".")
    last3 = F.array_join(F.slice(parts, F.greatest(F.lit(1), n - 2), 3), ".")
    return F.when(n >= 3, F.when(last2.isin(*TWO_PART_TLDS), last3).otherwise(last2)).otherwise(F.array_join(parts, "."))

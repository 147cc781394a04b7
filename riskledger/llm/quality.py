"""Quality rules from tokenizer fertility.

Two public vocabularies measure each text: characters (letters and digits) per token under a
byte-level vocabulary and under one with byte fallback, the share of byte tokens, and the entropy
of its tokens. The bands within which a text is kept are taken from the corpus itself, per
language (or per script where the language is null): the median of a measure over the distinct texts
of the language, and so many deviations to either side. The mean of a short text strays more, so the
bands of the two fertilities narrow with the square root of the words. Simple counts that need no
vocabulary stand beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.llm import tokens
from riskledger.llm.frames import carried, checkpointed, if_small
from riskledger.llm.words import IS_WORD, mix, owner, text_slices, window_hashes, word_hashes, word_spans

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: First bytes of the characters that fertility counts: ASCII letters and digits, and all others.
LETTERS = np.array([chr(b).isalnum() if b < 0x80 else b & 0xC0 != 0x80 for b in range(256)])
#: Bits per token that a text of n tokens can have at most is log2(n); longer texts are measured
#: against this many tokens.
ENTROPY_TOKENS = 256

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("byte_fertility", "piece_fertility", "byte_share", "entropy_share")
#: Half a band is DEVIATIONS times the scaled median deviation, and at least this: a share of the
#: median for the fertilities, absolute for the others. The share holds from LONG words on and grows
#: like the band for shorter texts; the normal spread of a language is a little wider.
DEVIATIONS = 4.0
LEAST_HALF = {"byte_fertility": 0.03, "piece_fertility": 0.03, "byte_share": 0.1, "entropy_share": 0.05}
NARROWING = ("byte_fertility", "piece_fertility")
LONG = 1300


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The simple counts of each row of a slice of texts."""
    starts, ends, before = word_spans(data, offsets)
    rows = len(offsets) - 1
    inside = IS_WORD[data]
    out = {
        "n_words": np.diff(before),
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(SYMBOLS[data], offsets),
        "n_letters": _sums(LETTERS[data], offsets),
    }
    row = owner(before, len(starts))
    rolled = window_hashes(word_hashes(data, starts, ends), 3)
    whole = np.flatnonzero(row[: len(rolled)] == row[2:]) if len(rolled) else np.empty(0, np.int64)
    covered = np.zeros(len(starts), bool)
    if len(whole):
        own = rolled[whole] + mix(row[whole].astype(np.uint64) + np.uint64(1))  # a window counts in its text only
        order = np.argsort(own)
        at, own = whole[order], own[order]
        same = own[1:] == own[:-1]
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            covered[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    text, at = data.tobytes(), offsets.tolist()
    again = np.zeros(rows, np.int64)
    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        lines = [x for x in text[a:b].split(b"\n") if x and not x.isspace()]
        again[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = again
    return out


def fertility(words: list[bytes], n_chars: int) -> tuple[float, float, float, float]:
    """Characters per byte-level token and per piece, share of byte tokens, share of the entropy possible.

    Words are encoded one by one, each with the space before it. No words: all zero.
    """
    if not words:
        return 0.0, 0.0, 0.0, 0.0
    model = tokens.shared(tokens.Words, tokens.PIECES)
    n_bytewise, ids = model.encode(words)
    most = np.log2(min(len(ids), ENTROPY_TOKENS)) if len(ids) > 1 else 1.0
    return n_chars / n_bytewise, n_chars / len(ids), float(model.is_byte[ids].mean()), tokens.entropy(ids) / float(most)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts and fertility of each document.

    Returns id, h (hash of the text), band (the language, or the script of most letters where it is
    null), the counts and the measures. A null text has no words. Repeated rows are measured one by one.
    """
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
            scores: list[tuple[float, ...]] = []
            for _, data, offsets in text_slices(batch.column(3)):
                found = base_counts(data, offsets)
                for k in COUNTS:
                    counts[k].append(found[k])
                text, at = data.tobytes(), offsets.tolist()
                scores += [fertility(text[a:b].split(), n) for a, b, n in zip(at, at[1:], found["n_letters"].tolist(), strict=False)]
            columns = [batch.column(0), batch.column(1), batch.column(2)]
            columns += [pa.array(np.concatenate(counts[k]) if counts[k] else np.empty(0, np.int64), pa.int64()) for k in COUNTS]
            columns += [pa.array([s[i] for s in scores], pa.float64()) for i in range(len(MEASURES))]
            yield pa.record_batch(columns, ["id", "h", "band", *COUNTS, *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, h bigint, band string, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", " + ", ".join(f"{k} double" for k in MEASURES)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.coalesce(lang, script(F.col(text_col))).alias("band"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def script(text: Column) -> Column:
    """The script of the first letter: latin, greek, cyrillic, arabic, han, kana, hangul or other."""
    first = F.regexp_extract(text, r"\p{L}", 0)
    named = F.lit("other")
    for name in ("Hangul", "Han", "Arabic", "Cyrillic", "Greek", "Latin"):
        named = F.when(first.rlike(rf"\p{{Is{name}}}"), name.lower()).otherwise(named)
    return named


def bands(measured: DataFrame) -> DataFrame:
    """One row per band: for each measure its median m_ and scaled median deviation s_.

    ``measured`` must be stored. Values are rounded before the exact percentiles, so a band holds
    some thousand distinct values however many documents it has, and the result does not depend on
    the order of rows. Texts without words are left out, and copies of a text count once, so that a
    much copied text is not the measure of its language.
    """
    real = checkpointed(measured.where("n_words > 0").dropDuplicates(["band", "h"]))
    middle = if_small(real.groupBy("band").agg(*[F.percentile(F.round(k, 3), F.lit(0.5)).alias(f"m_{k}") for k in MEASURES]))
    away = real.join(middle, "band")
    spread = [F.percentile(F.round(F.abs(F.col(k) - F.col(f"m_{k}")) * _narrowing(k), 3), F.lit(0.5)) * 1.4826 for k in MEASURES]
    return middle.join(away.groupBy("band").agg(*[x.alias(f"s_{k}") for x, k in zip(spread, MEASURES, strict=True)]), "band")


def _narrowing(k: str) -> Column:
    return F.sqrt(F.col("n_words")) if k in NARROWING else F.lit(1.0)


def verdicts(measured: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept. A text without words fails the base rules."""
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    inside = F.lit(True)
    for k in MEASURES:
        least = F.lit(LEAST_HALF[k]) * (F.col(f"m_{k}") * F.sqrt(F.greatest(F.lit(1.0), F.lit(LONG) / F.greatest("n_words", F.lit(1)))) if k in NARROWING else F.lit(1.0))
        half = F.greatest(F.col(f"s_{k}") * DEVIATIONS / _narrowing(k), least)
        inside = inside & (F.abs(F.col(k) - F.col(f"m_{k}")) <= half)
    judged = measured.join(if_small(bands(measured)), "band", "left")
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return judged.select("id", "band", *COUNTS, *MEASURES, "base_failed", "kept")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per document: id, band, counts, measures, base_failed, kept.

    A null text is a text without words and is not kept; an empty table gives an empty result;
    repeated rows get equal verdicts; other columns are not read.
    """
    return verdicts(checkpointed(measure(docs, id_col, text_col, lang_col)))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged.

    Rows are matched by a hash of the language and the text, so ids may repeat or be null.
    """
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.xxhash64(lang, F.lit("|"), F.col(text_col)).alias("key"), F.col(text_col).alias("text"), lang.alias("lang"), carried(docs))
    kept = judge(rows, "key", "text", "lang").where("kept").select(F.col("id").alias("key")).distinct()
    return rows.select("key", "row").join(kept, "key", "left_semi").select("row.*")

"""Removal of repeated token windows.

Every window of ``width`` consecutive words gets a Rabin-Karp value. A window is repeated if its
words also start in a document with a smaller id; the repeated windows of a document merge into
maximal intervals, and their words go.

Spark deals the work twice. Documents are grouped by ranges of ids ("homes") of a few megabytes of
text. A home sends each of its distinct window values once, as sorted values packed by value range
("bucket"), so a passage that a third of all documents share costs one entry per home. A bucket
sees which values begin in several homes and answers each home with one bit per value: seen in an
earlier home or not. Repeats inside a home are decided there. No text and no list of pairs goes to
a bucket, and a value is compared with all others wherever they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm.words import owner, text_slices, window_hashes, word_hashes, word_spans

WIDTH = 50
HOME_BYTES = 2 << 20
LEAST_HOMES = 64


def _ordered(home: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A home by ascending id (null last), and the rank of each row's id."""
    home = home.take(pc.sort_indices(home, sort_keys=[("key", "ascending")]))
    keys = home["key"].to_numpy()
    return home, np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])]) if len(keys) else np.empty(0, np.int64)


class _Windows:
    """All windows of a home: value, rank of the document's id, row and first word in the row."""

    def __init__(self, home: pa.Table, width: int):
        home, ranks = _ordered(home)
        self.home, values, rows, places, self.words = home, [], [], [], np.zeros(len(home), np.int64)
        for first, data, offsets in text_slices(home["text"].combine_chunks()):
            starts, ends, before = word_spans(data, offsets)
            self.words[first : first + len(offsets) - 1] = np.diff(before)
            rolled = window_hashes(word_hashes(data, starts, ends), width)
            row = owner(before, len(starts))
            whole = row[: len(rolled)] == row[width - 1 :] if len(rolled) else np.empty(0, bool)
            at = np.flatnonzero(whole)
            values.append(rolled[at])
            rows.append(row[at] + first)
            places.append(at - before[row[at]])
        self.values = np.concatenate(values) if values else np.empty(0, np.uint64)
        self.rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.places = np.concatenate(places) if places else np.empty(0, np.int64)
        self.ranks = ranks[self.rows] if len(self.rows) else self.rows
        # rows come by ascending id, so the first of equal values is the smallest id
        self.order = np.argsort(self.values, kind="stable")
        in_order = self.values[self.order]
        new = np.ones(len(in_order), bool)
        new[1:] = in_order[1:] != in_order[:-1]
        self.heads = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        self.distinct = in_order[self.heads]

    def repeated(self, earlier: np.ndarray) -> np.ndarray:
        """Per window in page order: does it start in a smaller id? ``earlier``: bit per distinct value."""
        least = self.ranks[self.order][self.heads]
        out = np.empty(len(self.values), bool)
        out[self.order] = earlier[self.run] | (self.ranks[self.order] > least[self.run])
        return out


def _bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Sorted values as differences, byte by byte of equal weight: the high bytes compress away."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _count_bucket(bucket: pa.Table) -> pa.Table:
    """Answer each home of a bucket: one bit per value, set if an earlier home has the value."""
    bucket = bucket.take(pc.sort_indices(bucket, sort_keys=[("home", "ascending")]))
    parts = [_unpack(x) for x in bucket["packed"].to_pylist()]
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    again = np.zeros(len(values), bool)
    again[order[1:]] = values[order[1:]] == values[order[:-1]]
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(again[e - len(p) : e]).tobytes() for e, p in zip(ends, parts, strict=True)]
    return pa.table({"home": bucket["home"], "bucket": bucket["bucket"], "n": pa.array([len(p) for p in parts], pa.int32()), "bits": pa.array(bits, pa.binary())})


def _intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals of words covered by windows at ascending ``starts``; ends are exclusive."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(starts[1:] > starts[:-1] + width)
    return list(zip(starts[np.concatenate([[0], gaps + 1])].tolist(), (starts[np.concatenate([gaps, [len(starts) - 1]])] + width).tolist(), strict=True))


def _clean(home: pa.Table, answers: pa.Table, width: int, id_type: pa.DataType) -> pa.Table:
    w = _Windows(home, width)
    answers = answers.take(pc.sort_indices(answers, sort_keys=[("bucket", "ascending")]))
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(answers["bits"].to_pylist(), answers["n"].to_pylist(), strict=True)]
    earlier = np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)
    if len(earlier) != len(w.distinct):
        raise ValueError("a bucket's answer is missing")
    hit = np.flatnonzero(w.repeated(earlier))
    by_row = np.searchsorted(w.rows[hit], np.arange(len(w.home) + 1))
    texts = w.home["text"].cast(pa.large_binary()).to_pylist()
    spans, kept, removed = [], [], []
    for row, text in enumerate(texts):
        own = _intervals(w.places[hit[by_row[row] : by_row[row + 1]]], width)
        parts = (text or b"").split()
        for low, high in reversed(own):
            del parts[low:high]
        spans.append([{"first": a, "last": b - 1} for a, b in own])
        removed.append(sum(b - a for a, b in own))
        kept.append(b" ".join(parts).decode())
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return pa.table({"id": w.home["id"].cast(id_type), "n_words": pa.array(w.words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "kept_text": pa.array(kept, pa.string())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, home_bytes: int = HOME_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (first and last removed word), kept_text.

    ``id_col`` must be an integer column. A null text has no words; a null id counts as the largest;
    rows of one id never remove from each other; a text shorter than a window keeps all words; an
    empty table gives an empty result. Other columns are not read. Windows are judged on the input.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.coalesce("id", F.lit((1 << 63) - 1)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = max(LEAST_HOMES, math.ceil(size / home_bytes))
    cuts = [i / homes for i in range(1, homes)]
    # borders of the homes: only their evenness depends on the approximation
    found = rows.agg(F.percentile_approx("key", cuts, max(10_000, 4 * homes))).first()[0]
    borders = sorted(set(found or []))

    @F.pandas_udf("int")
    def home_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(borders, np.int64), keys.to_numpy(np.int64), side="left").astype(np.int32))

    rows = rows.withColumn("home", home_of("key"))
    buckets = homes

    def send(home: pa.Table) -> pa.Table:
        distinct = _Windows(home, width).distinct
        number = home["home"][0].as_py()
        of = _bucket_of(distinct, buckets)
        full, at = np.unique(of, return_index=True)
        parts = [_pack(x) for x in np.split(distinct, at[1:])] if len(distinct) else []
        return pa.table({"bucket": pa.array(full, pa.int32()), "home": pa.array([number] * len(parts), pa.int32()), "packed": pa.array(parts, pa.binary())})

    sent = rows.groupBy("home").applyInArrow(send, "bucket int, home int, packed binary")
    answers = sent.groupBy("bucket").applyInArrow(_count_bucket, "home int, bucket int, n int, bits binary")

    def clean(home: pa.Table, own: pa.Table) -> pa.Table:
        return _clean(home, own, width, pa.int64())

    schema = "id bigint, n_words bigint, n_removed bigint, spans array<struct<first: bigint, last: bigint>>, kept_text string"
    return rows.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(clean, schema)

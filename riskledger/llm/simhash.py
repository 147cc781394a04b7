"""SimHash near duplicates by pigeonhole blocks.

The 64 bits of a fingerprint are cut into ``BLOCKS`` blocks. Two fingerprints that differ in at
most ``distance`` bits agree in at least ``BLOCKS - distance`` blocks, so each fingerprint is keyed
by every choice of that many blocks, close pairs share a key, and the Hamming distance is checked
inside each key. Only distinct fingerprints are keyed: exact copies are one row before the join.

A bucket never lists its pairs. Up to ``BUCKET`` fingerprints a task walks the bucket and gives back
one link per fingerprint (a spanning forest of the checked links). Larger buckets are split
further: two fingerprints within three bits always meet in a value that is within one bit of one and
within two of the other, so their balls of radius two, at most 529 values in the 32 free bits, are
grouped by value. A value has at most 529 neighbours, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm import workers
from riskledger.llm.frames import carried, checkpointed, connected
from riskledger.llm.words import text_slices

SEED = 42
DISTANCE = 3
BUCKET = 8192
#: Six blocks: four of 11 bits and two of 10. Three agree, 20 choices of 31 to 33 bits.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
_SIGNED = 1 << 63


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 without words.

    A bit is set if more than half the XXH64 values have it. A text of fewer words than a
    shingle is one shingle.
    """
    parts = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = list(map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)))
    digest, seed = xxhash.xxh64_intdigest, SEED
    counts = np.zeros(64, np.int64)
    for low in range(0, len(shingles), 1 << 16):
        values = np.array([digest(s, seed) for s in shingles[low : low + (1 << 16)]], dtype="<u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: id, fp (the 64 bits as a signed long). A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            out = []
            for _, data, offsets in text_slices(batch.column(1)):
                whole, at = data.tobytes(), offsets.tolist()
                out += [fingerprint(whole[a:b], words) for a, b in zip(at, at[1:], strict=False)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp bigint")


def _tables(distance: int) -> list[tuple[int, list[int]]]:
    """(mask of the agreeing blocks as a signed long, the free bits) of each choice of blocks."""
    out = []
    for chosen in combinations(BLOCKS, len(BLOCKS) - distance):
        mask = sum(((1 << n) - 1) << at for at, n in chosen)
        out.append((mask - (1 << 64) if mask >= _SIGNED else mask, [b for b in range(64) if not mask >> b & 1]))
    return out


def bucket_links(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as two arrays of ends.

    Walks from each fingerprint not yet reached; what has been reached is not compared again.
    """
    rest = values
    tails, heads = [], []
    while len(rest) > 1:
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            at = open_.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                tails.append(found)
                heads.append(np.full(len(found), at))
                open_.extend(found)
                rest = rest[~near]
    empty = np.empty(0, np.uint64)
    return np.concatenate(tails or [empty]), np.concatenate(heads or [empty])


def links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all within ``distance`` bits."""
    spark = distinct.sparkSession
    if not 0 <= distance <= 3:
        raise ValueError("the blocks hold for up to three bits")
    tables = _tables(3)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for i, (mask, _) in enumerate(tables)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(keyed.join(sizes, ["t", "key"]))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        workers.release()
        for batch in batches:
            found = [bucket_links(np.unique(np.asarray(x, np.int64).view(np.uint64)), distance) for x in batch["fps"]]
            ends = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (tuple(f[0] for f in found), tuple(f[1] for f in found))]
            yield pd.DataFrame({"a": ends[0].view(np.int64), "b": ends[1].view(np.int64)})

    small = shared.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    out = small.select("fps").mapInPandas(walk, "a bigint, b bigint")
    large = shared.where(F.col("n") > bucket)
    if not large.isEmpty():
        out = out.union(_ball_links(spark, large, tables, distance))
    return out.distinct()


def _ball_links(spark, large: DataFrame, tables: list[tuple[int, list[int]]], distance: int) -> DataFrame:
    """Links of the buckets that are too large to walk, through the values between two ends.

    The table of flips has 20 x 529 lines at most, whatever the data, and is broadcast.
    """
    inner = distance // 2  # of the nearer end; the other end is within distance - inner
    rows = []
    for t, (_, free) in enumerate(tables):
        for n in range(distance - inner + 1):
            for bits in combinations(free, n):
                flip = sum(1 << b for b in bits)
                rows.append((t, flip - (1 << 64) if flip >= _SIGNED else flip, n <= inner))
    flips = F.broadcast(spark.createDataFrame(rows, "t int, flip bigint, near boolean"))
    balls = large.join(flips, "t").select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "near")
    met = balls.groupBy("value").agg(F.collect_set("fp").alias("fps"), F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"))
    return met.where("hub is not null and size(fps) > 1").select(F.explode("fps").alias("a"), F.col("hub").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """One row per document: id, fp, component (the smallest id that can be reached over links).

    Documents without words have fingerprint zero and are linked like any other. Repeated ids keep
    one row each; a null id is never a component unless all ids of the component are null. An
    empty table gives an empty result; other columns are not read.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("first")))
    pairs = links(distinct.select("fp"), distance, bucket)
    classes = connected(pairs)
    # classes of fingerprints that have a neighbour; the others are their own class
    member = distinct.join(classes, distinct["fp"] == classes["node"]).select("fp", "first", F.col("component").alias("class"))
    least = member.groupBy("class").agg(F.min("first").alias("least"))
    linked = member.join(least, "class").select("fp", F.col("least"))
    # stored, so that the last join reads two plain shuffles and a fingerprint of very many copies can be split
    known = checkpointed(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component")))
    return prints.join(known, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, columns unchanged.

    A null id counts as the smallest; of rows alike in the id the smaller hash of the text decides,
    and of rows alike in both one stays.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("key"), F.col(text_col).alias("text"), carried(docs))
    found = near_duplicates(rows, "key", "text", words, distance)
    first = found.groupBy("component").agg(F.lit(1).alias("one")).select(F.col("component.id").alias("id"), F.col("component.h").alias("h"))
    same = F.col("key.id").eqNullSafe(F.col("id")) & (F.col("key.h") == F.col("h"))
    return rows.drop("text").join(first, same, "left_semi").dropDuplicates(["key"]).select("row.*")

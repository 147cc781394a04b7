"""Removal of repeated lines by pairwise alignment.

Documents that share a rare line are aligned by patience diff, and the common blocks of lines are
deleted from the later document. All documents of a line need not meet: the earliest of them is
aligned with each other one, which is linear in the line's documents. A line that is too frequent
to be rare is made rare first: its documents are dealt into groups of about ``rare``, each with
its own earliest document, and these are aligned with the earliest of all. So no group is large,
no partner has more than some ``rare`` pairs for a line, and no line is left out.

A line's first document keeps it: whatever it is aligned with is earlier, and lacks the line.

With ``whole`` the result is that of aligning each document with every earlier one. A block that is
deleted is made of runs, the shortest stretches of lines that have enough characters, counted from
each line onwards and backwards. So documents are dealt by runs instead of lines, and what an
earlier document holds of a run and is still there after the first pass is aligned with the other
earlier holders in turn, twice as many in each round, until it is deleted or none is left.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskledger.llm import workers
from riskledger.llm.frames import carried, checkpointed, merged
from riskledger.session import scratch

RARE = 500
#: Characters that a common block must have to be deleted.
LEAST = 24


def line_values(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value and the characters of each line, white space at the ends left out; 0, 0 for blank lines."""
    lines = [x.strip() for x in text.split("\n")]
    values = np.array([xxhash.xxh64_intdigest(x.encode(), 7) | 1 if x else 0 for x in lines], np.uint64)
    return values.view(np.int64), np.array([len(x) for x in lines], np.int32)


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places of two line sequences, ascending: lines unique on both sides, in order, and all alike around them."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        own: dict[int, int] = {}
        for k in range(i, m):
            own[a[k]] = -1 if a[k] in own else k
        other: dict[int, int] = {}
        for k in range(j, n):
            other[b[k]] = -1 if b[k] in other else k
        anchors = [(own[x], k) for x, k in other.items() if x and k >= 0 and own.get(x, -1) >= 0]
        chain = _increasing(anchors)
        if not chain:
            continue
        for (i1, j1), (i2, j2) in zip([(i - 1, j - 1), *chain], [*chain, (m, n)], strict=True):
            todo.append((i1 + 1, i2, j1 + 1, j2))
        out += chain
    return sorted(out)


def _increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of ``anchors`` (ascending in the second place) that also ascends in the first."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for at, (i, _) in enumerate(anchors):
        pile = bisect.bisect_left(tops, i)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(i)
            ends.append(at)
        else:
            tops[pile], ends[pile] = i, at
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(anchors[at])
        at = back[at]
    return out[::-1]


def common_lines(a: Sequence[int], b: Sequence[int], sizes: Sequence[int], least: int = LEAST) -> list[int]:
    """Places in ``b`` of the aligned blocks of at least ``least`` characters."""
    out: list[int] = []
    block: list[tuple[int, int]] = []
    for pair in [*patience(a, b), (-9, -9)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(sizes[j] for _, j in block) >= least:
                out += [j for _, j in block]
            block = []
        block.append(pair)
    return out


def _line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key (id and hash of the text), values and sizes of the lines; rows alike in both once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            for low in range(0, batch.num_rows, 1000):
                found = [line_values(t) for t in texts.slice(low, 1000).to_pylist()]
                columns = [batch.column(0).slice(low, 1000), batch.column(1).slice(low, 1000)]
                columns += [pa.array([v for v, _ in found], pa.list_(pa.int64())), pa.array([s for _, s in found], pa.list_(pa.int32()))]
                yield pa.record_batch(columns, ["id", "h", "lines", "sizes"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    table = rows.mapInArrow(run, f"id {kind}, h bigint, lines array<bigint>, sizes array<int>")
    return table.select(F.struct("id", "h").alias("key"), "lines", "sizes").dropDuplicates(["key"])


def run_places(sizes: Sequence[int], least: int = LEAST) -> list[tuple[int, int]]:
    """First and last places of the shortest runs of lines with ``least`` characters, from each line onwards and backwards.

    Of any block with that many characters each line lies in such a run inside the block.
    """
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    ends = np.searchsorted(total, total[:-1] + least)  # of the run from each line: lines before its end
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1  # of the run back from each line
    at = np.arange(len(sizes))
    forth = {(i, max(int(e) - 1, i)) for i, e in zip(at.tolist(), ends, strict=True) if e < len(total)}
    return sorted(forth | {(min(int(b), i), i) for i, b in zip(at.tolist(), starts, strict=True) if b >= 0})


def _run_table(table: DataFrame, least: int) -> DataFrame:
    """key, line (value of the run), first, last (its places) of each run of ``run_places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                rows, values, firsts, lasts = [], [], [], []
                some = batch.slice(low, 1000)
                for row, (own, sizes) in enumerate(zip(some.column(1), some.column(2), strict=True)):
                    data = own.values.to_numpy()
                    for a, b in run_places(sizes.values.to_numpy(), least):
                        rows.append(row)
                        values.append(xxhash.xxh64_intdigest(data[a : b + 1].tobytes(), 7))
                        firsts.append(a)
                        lasts.append(b)
                columns = [some.column(0).take(pa.array(rows, pa.int64())), pa.array(np.array(values, np.uint64).view(np.int64)), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())]
                yield pa.record_batch(columns, ["key", "line", "first", "last"])

    kind = table.schema["key"].dataType.simpleString()
    return table.select("key", "lines", "sizes").mapInArrow(run, f"key {kind}, line bigint, first int, last int")


def pairs(table: DataFrame, rare: int = RARE) -> DataFrame:
    """earlier, later: the documents to align. ``table``: key, lines."""
    return _dealt(table.select("key", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0"), rare)


def _dealt(held: DataFrame, rare: int) -> DataFrame:
    """earlier, later of the documents that hold a line or run. ``held``: key, line, each pair once."""
    # stored, so that the join reads two plain shuffles and a very frequent line can be split
    shared = checkpointed(held.groupBy("line").agg(F.count("*").alias("n")).where("n > 1"))
    held = merged(held, shared, "line").withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / rare)))
    # a part has about ``rare`` rows, whatever the line; dealt anew, since the join has dealt whole lines
    held = held.repartition("line", "part")
    first = held.withColumn("first", F.min("key").over(Window.partitionBy("line", "part")))
    inside = first.where("first <> key").select(F.col("first").alias("earlier"), F.col("key").alias("later"))
    heads = first.where((F.col("first") == F.col("key")) & (F.col("n") > rare)).select("line", "key")
    heads = checkpointed(heads)
    least = heads.groupBy("line").agg(F.min("key").alias("first"))
    across = merged(heads, least, "line").where("first <> key").select(F.col("first").alias("earlier"), F.col("key").alias("later"))
    return inside.union(across).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, least: int = LEAST, whole: bool = False) -> DataFrame:
    """id, h (hash of the text), places: the lines to delete, of documents that have any."""
    table = checkpointed(_line_table(docs, id_col, text_col))
    if not whole:
        aligned = _aligned(table, pairs(table, rare), least)
    else:
        runs = checkpointed(_run_table(table, least))
        aligned = _rounds(table, runs, _aligned(table, _dealt(runs.select("key", "line").distinct(), rare), least), rare, least)
    # a document has at most as many partners as lines, or was aligned until its lines were gone; its places are bounded by its own text
    return aligned.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def _aligned(table: DataFrame, both: DataFrame, least: int) -> DataFrame:
    """id, h, places of the later document of each pair that has common blocks."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        workers.release()
        for batch in batches:
            found = [common_lines(a.tolist(), b.tolist(), s.tolist(), least) for a, b, s in zip(batch["a"], batch["b"], batch["sizes"], strict=True)]
            out = pd.DataFrame({"id": batch["id"], "h": batch["h"], "places": found})
            yield out[out["places"].map(len) > 0]

    first = table.select(F.col("key").alias("earlier"), F.col("lines").alias("a"))
    second = table.select(F.col("key").alias("later"), F.col("lines").alias("b"), "sizes")
    both = merged(merged(both, first, "earlier"), second, "later").select("later.id", "later.h", "a", "b", "sizes")
    kind = table.select("key.id").schema["id"].dataType.simpleString()
    return both.mapInPandas(align, f"id {kind}, h bigint, places array<int>")


def _rounds(table: DataFrame, runs: DataFrame, found: DataFrame, rare: int, least: int) -> DataFrame:
    """``found`` and what further earlier holders of the runs that are still there add to it."""
    spark, n = table.sparkSession, 0
    folder = scratch(spark, "lines")

    def stored(df: DataFrame) -> DataFrame:
        """As files, so that Spark knows the size: its guess for joins of checkpoints grows with every round."""
        nonlocal n
        n += 1
        df.write.parquet(f"{folder}/{n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{n}")

    def still(rows: DataFrame, found: DataFrame) -> DataFrame:
        gone = found.groupBy(F.struct("id", "h").alias("key")).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("gone"))
        left = F.array_except("left", F.coalesce("gone", F.array().cast("array<int>")))
        return merged(rows, gone, "key", "left").withColumn("left", left).where(F.size("left") > 0).drop("gone")

    found = stored(found)
    # copies of a text align alike: the earliest stands for them
    held = runs.groupBy("line", F.col("key.h").alias("h")).agg(F.min("key").alias("earlier"))
    heads = checkpointed(held.groupBy("line").agg(F.min("earlier").alias("head"), F.count("*").alias("n")).where("n > 1"))
    rows = runs.withColumn("left", F.sequence("first", "last")).select("key", "line", "left")
    open_ = stored(still(merged(rows, heads, "line").where("head < key").select("key", "line", "left", "n"), found))
    wanted = checkpointed(open_.select("line", "n").distinct())
    part = F.pmod(F.col("h"), F.ceil(F.col("n") / rare))
    held = merged(held, wanted, "line").withColumn("part", part).repartition("line", "part")
    held = stored(held.withColumn("rank", F.row_number().over(Window.partitionBy("line", "part").orderBy("earlier"))).select("line", "part", "rank", "earlier"))
    low = 1
    while True:
        parts = open_.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / rare) - 1)))
        asked = merged(parts, held.where((F.col("rank") >= low) & (F.col("rank") < 2 * low)), ["line", "part"]).where("earlier < key and earlier.h <> key.h")
        asked = stored(asked.select("earlier", F.col("key").alias("later")).distinct())
        if asked.isEmpty():
            return found
        more = stored(_aligned(table, asked, least))
        found = found.union(more)
        open_, low = stored(still(open_, more)), 2 * low


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, least: int = LEAST, counts: bool = True, whole: bool = False) -> DataFrame:
    """``docs`` with the repeated lines deleted, and n_lines, n_removed_lines (an input column so named is replaced).

    Without ``counts`` the columns of ``docs`` only. With ``whole`` as if each document were aligned with every earlier one,
    otherwise with the earliest holders of its lines.

    Earlier is the smaller id, a null id before all. Rows alike in id and text are one document and are not
    compared with each other; rows of one id with different texts are two documents. A null text stays null and
    has no lines; an empty text has one blank line; blank lines go only inside a block. Texts are compared as
    they came in, line by line without white space at the ends. An empty table gives an empty result.
    """
    found = repeated_lines(docs, id_col, text_col, rare, least, whole).select("id", "h", "places")
    keyed = docs.select(F.col(id_col).alias("own"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"), carried(docs.drop(text_col)))
    joined = merged(keyed, found, F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("places", i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(kept)
    extra = {"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_removed_lines": F.coalesce(F.size("places"), F.lit(0))} if counts else {}
    names = [c for c in docs.columns if c not in extra]
    return joined.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in names], *[v.alias(k) for k, v in extra.items()])

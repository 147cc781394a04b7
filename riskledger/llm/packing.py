"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

A document is its ids and one end id; only documents longer than a sequence are cut. Pieces are
dealt at random into groups of bounded size, and each group is packed by itself: best fit
decreasing, then a local search over the bins that are not full. It tries to empty the lightest
bins: a piece moves to another bin, or is exchanged for one or two smaller pieces of another bin,
whenever that makes the sum of squared fills larger; an emptied bin is gone. All such exchanges are
looked at, whatever the number of bins or of pieces in a bin.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm import tokens
from riskledger.llm.frames import checkpointed

LENGTH = 2048
END = 0
GROUP = 30_000
#: A group's bins have ids from group << GROUP_BITS on.
GROUP_BITS = 32


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole sequences, but the first may be shorter."""
    first = (n - 1) % length + 1
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = False, vocabulary: str = tokens.BYTE_BPE) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and its ids if asked for.

    A null text is empty and has the end id only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = tokens.shared(tokens.ByteBpe, vocabulary), np.array([END], "<u4").tobytes()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for low in range(0, batch.num_rows, 256):
                rows = []
                for i, text in enumerate(texts.slice(low, 256).to_pylist(), low):
                    ids = model.encode(text) + end
                    for k, (start, n) in enumerate(cuts(len(ids) // 4, length)):
                        own = ids[4 * start : 4 * (start + n)]
                        rows.append((i, k, start, n, zlib.crc32(own), own if with_ids else None))
                of, k, start, n, crc, own = zip(*rows, strict=True)
                out = [batch.column(0).take(pa.array(of)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Best fit decreasing: bins as lists of positions in ``sizes``."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = defaultdict(list)  # free tokens -> bins
    free: list[int] = []  # the keys of room, ascending
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(free, sizes[i])
        if at < len(free):
            gap = free[at]
            b = room[gap].pop()
            if not room[gap]:
                del room[gap], free[at]
        else:
            b, gap = len(bins), length
            bins.append([])
        bins[b].append(i)
        gap -= sizes[i]
        if gap:
            if gap not in room:
                bisect.insort(free, gap)
            room[gap].append(b)
    return bins


class Search:
    """Local search over the underfull bins of a packing."""

    def __init__(self, sizes: list[int], bins: list[list[int]], length: int):
        self.sizes, self.bins, self.length = sizes, bins, length
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        # by size of a part (a piece, or two): the largest part it can be exchanged for -> bins
        self.reach: dict[int, set[tuple[int, int]]] = defaultdict(set)
        self.keys: list[int] = []
        self.own: dict[int, list[tuple[int, tuple[int, int]]]] = {}
        for b in range(len(bins)):
            self._add(b)

    def _parts(self, b: int) -> dict[int, list[int]]:
        """Sizes that can leave bin ``b``, with pieces that make them up: nothing, a piece, or two pieces.

        Pieces of one size are alike, and the sizes of a bin add up to a sequence at most, so it has few of them.
        """
        of: dict[int, list[int]] = defaultdict(list)
        for i in self.bins[b]:
            of[self.sizes[i]].append(i)
        own = sorted(of)
        parts: dict[int, list[int]] = {0: []}
        for k, x in enumerate(own):
            for y in own[k:]:
                if x != y:
                    parts.setdefault(x + y, [of[x][0], of[y][0]])
                elif len(of[x]) > 1:
                    parts.setdefault(2 * x, of[x][:2])
        parts.update((x, of[x][:1]) for x in own)
        return parts

    def _add(self, b: int) -> None:
        gap = self.length - self.fill[b]
        if not gap or not self.bins[b]:
            return
        self.own[b] = [(part + gap, (b, part)) for part in self._parts(b)]
        for key, value in self.own[b]:
            if key not in self.reach:
                bisect.insort(self.keys, key)
            self.reach[key].add(value)

    def _drop(self, b: int) -> None:
        for key, value in self.own.pop(b, ()):
            self.reach[key].discard(value)
            if not self.reach[key]:
                del self.reach[key]
                del self.keys[bisect.bisect_left(self.keys, key)]

    def _exchange(self, a: int, outs: list[int], b: int, part: int) -> None:
        """Put pieces ``outs`` of bin ``a`` in bin ``b`` for the pieces that make up ``part``."""
        back = self._parts(b)[part]
        self._drop(a)
        self._drop(b)
        size = sum(self.sizes[i] for i in outs)
        self.bins[a] = [i for i in self.bins[a] if i not in outs] + back
        self.bins[b] = [i for i in self.bins[b] if i not in back] + outs
        self.fill[a] += part - size
        self.fill[b] += size - part
        self._add(a)
        self._add(b)

    def _improve(self, a: int) -> bool:
        """One exchange that moves tokens from bin ``a`` to a bin that ends up fuller than ``a`` was.

        Best is the one that leaves the least gap. Squared fill grows: with d tokens moved it
        changes by 2 d (fill(b) + d - fill(a)), which is above 0. A key less the size is the gap left in
        ``b``, so keys are looked at in their order, up to the gap of ``a`` or the best one found: none that counts is left out.
        """
        best, least = None, self.length - self.fill[a]
        for size, pieces in self._parts(a).items():
            if not pieces:
                continue
            for at in range(bisect.bisect_left(self.keys, size), len(self.keys)):
                key = self.keys[at]
                if key - size >= least:
                    break
                found = next(((b, part) for b, part in self.reach[key] if b != a and part < size), None)
                if found:
                    best, least = (pieces, *found), key - size
                    break
            if not least:
                break
        if best is None:
            return False
        self._exchange(a, *best)
        return True

    def run(self) -> list[list[int]]:
        """Drain the lightest bins one after another, again and again until a round empties none.

        Ends because every exchange makes the sum of squared fills larger.
        """
        lower = math.ceil(sum(self.fill) / self.length)
        alive, before = sum(map(bool, self.bins)), -1
        while lower < alive != before:
            before = alive
            for a in sorted(self.own, key=lambda b: self.fill[b]):
                while self.bins[a] and self._improve(a):
                    pass
                alive -= not self.bins[a]
                if alive <= lower:
                    break
        return [b for b in self.bins if b]


def pack_group(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Bins as lists of positions in ``sizes``; pieces of a whole sequence stand alone."""
    whole = [[i] for i, s in enumerate(sizes) if s == length]
    rest = [i for i, s in enumerate(sizes) if s < length]
    own = [sizes[i] for i in rest]
    found = Search(own, best_fit(own, length), length).run()
    return whole + [[rest[i] for i in b] for b in found]


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` (id, piece, start, length, ids_crc32) with sequence_id and offset.

    ``pieces`` must be stored, so that a repeated task sees the same rows. A group keeps
    about ``group`` pieces, so the bins lost to grouping are at most one in ``group / 2`` or so.
    Repeated rows are packed one by one. An empty table gives an empty result.
    """
    count = pieces.count()
    groups = max(1, round(count / group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bins = pack_group(rows["length"].tolist(), length)
        order = [i for b in bins for i in b]
        out = rows.iloc[order].reset_index(drop=True)
        ends = np.cumsum(out["length"].to_numpy())
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        firsts = np.concatenate([[0], np.cumsum([len(b) for b in bins])[:-1]]).astype(int)
        begins = ends - out["length"].to_numpy()
        out["offset"] = begins - begins[firsts][number]
        out["sequence_id"] = out["group"] * (1 << GROUP_BITS) + number
        return out.drop(columns="group")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("group").applyInPandas(run, f"{kinds}, `offset` bigint, `sequence_id` bigint")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Cut, tokenize and pack ``docs``: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(checkpointed(token_pieces(docs, id_col, text_col, length)), length, group)


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. Ids of documents must be unique."""
    pieces = token_pieces(docs, id_col, text_col, length, with_ids=True).select("id", "piece", "ids")
    rows = packed.select("id", "piece", "sequence_id", "offset").join(pieces, ["id", "piece"])
    joined = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return joined.select("sequence_id", F.flatten("parts.ids").alias("ids"))

"""Benchmark decontamination by the q-gram lemma.

Items and documents are compared in lower case with white space folded. An item is searched as
overlapping windows, long ones and a finer class of shorter ones, so a quoted part counts too; items
shorter than a window can be are looked for as they are, from word border to word border. A window of m characters leaks if some region of
a document is within k = error * m edits of it. By the q-gram lemma such a region holds at least
m + 1 - q (k + 1) of the window's q-grams, all on k + 1 neighbouring diagonals (place in the document
less place in the window). The filter loses nothing:

1. places where the document has any q-gram of the items are counted over a sliding length; regions
   with too few are passed over;
2. elsewhere, shared q-grams are counted per window in overlapping bands of 2 (k + 1) diagonals;
   bands that reach the bound are kept;
3. each kept band is verified by banded alignment.

Items go to the tasks in blocks of bounded size; the documents are read once per block and never
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskledger.llm import workers
from riskledger.llm.words import window_hashes

Q = 8
ERROR = 0.08
WINDOW = 128
STEP = 64
#: The finer class of windows.
PART = 84
PART_STEP = 16
LEAST = 32
#: Characters of items in one block; an index entry takes some 20 bytes each.
BLOCK = 1_000_000
SLICE = 300_000  # characters of documents looked at together
BITS = 22
#: Windows are sorted into classes of like length, each with a bound of its own.
CLASSES = (32, 48, 64, 96, 1 << 30)


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    """Characters as numbers from 1; 0 stands for no character."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)


def budget(m: int, error: float = ERROR, q: int = Q) -> int:
    """Edits allowed in a window of m characters: no more than the lemma can bound from below."""
    return max(0, min(int(error * m), (m + 1) // q - 2))


def bound(m: int, k: int, q: int = Q) -> int:
    return m + 1 - q * (k + 1)


@dataclass
class Index:
    """The windows of a block of items of one length class."""

    items: list  # item of each window
    windows: list[np.ndarray]
    grams: np.ndarray  # sorted distinct q-gram values
    firsts: np.ndarray  # of each value: its postings are firsts[i] to firsts[i + 1]
    windows_of: np.ndarray  # postings: window, place in the window
    places: np.ndarray
    bits: np.ndarray
    edits: np.ndarray  # per window
    least: np.ndarray  # per window: q-grams that must be shared
    q: int

    @property
    def reach(self) -> int:
        """Longest region of the class."""
        return max(len(w) + int(k) for w, k in zip(self.windows, self.edits, strict=True))


@dataclass
class Short:
    """The items of a block that are shorter than windows can be."""

    items: list
    windows: list[np.ndarray]
    edits: np.ndarray

    def __post_init__(self):
        self.by_length: dict[int, dict[bytes, list]] = {}
        for item, w in zip(self.items, self.windows, strict=True):
            self.by_length.setdefault(len(w), {}).setdefault(w.tobytes(), []).append(item)
        self.values = {n: np.unique(np.concatenate([window_hashes(np.frombuffer(w, np.uint64), n) for w in own])) for n, own in self.by_length.items()}


def window_starts(length: int, window: int, step: int) -> list[int]:
    """Places of windows every ``step`` characters and at the end."""
    starts = list(range(0, max(1, length - window + 1), step))
    if length > window and starts[-1] + window < length:
        starts.append(length - window)
    return starts


def build(items: list[tuple[object, str]], q: int = Q, error: float = ERROR, window: int = WINDOW, step: int = STEP, least: int = LEAST, part: int = PART, part_step: int = PART_STEP) -> list[Index | Short]:
    """Indexes of a block of (item, text), one per length class in use."""
    if least < 2 * q:
        raise ValueError("windows must be at least two q-grams long")
    found: dict[int, tuple[list, list]] = {}
    short: tuple[list, list] = ([], [])
    for item, text in items:
        letters = codes(normalise(text or ""))
        if len(letters) < least:
            if len(letters):
                short[0].append(item)
                short[1].append(letters)
            continue
        places = {(s, min(len(letters), s + window)) for s in window_starts(len(letters), window, step)}
        if part < len(letters):
            places |= {(s, s + part) for s in window_starts(len(letters), part, part_step)}
        for s, end in sorted(places):
            w = letters[s:end]
            kind = next(i for i, top in enumerate(CLASSES) if len(w) < top)
            own = found.setdefault(kind, ([], []))
            own[0].append(item)
            own[1].append(w)
    out = []
    for names, windows in found.values():
        values = [window_hashes(w, q) for w in windows]
        flat = np.concatenate(values)
        of = np.repeat(np.arange(len(windows), dtype=np.int32), [len(v) for v in values])
        place = np.concatenate([np.arange(len(v), dtype=np.int32) for v in values])
        order = np.argsort(flat, kind="stable")
        grams, firsts = np.unique(flat[order], return_index=True)
        bits = np.zeros(1 << BITS, bool)
        bits[(grams >> np.uint64(64 - BITS)).astype(np.int64)] = True
        edits = np.array([budget(len(w), error, q) for w in windows])
        low = np.array([bound(len(w), int(k), q) for w, k in zip(windows, edits, strict=True)])
        out.append(Index(names, windows, grams, np.append(firsts, len(flat)), of[order], place[order], bits, edits, low, q))
    if short[0]:
        out.append(Short(*short, np.zeros(len(short[0]), np.int64)))
    return out


def banded(patterns: list[np.ndarray], edits: np.ndarray, regions: list[np.ndarray], lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against any part of its region, and the end of that part.

    ``lows``: the band's first diagonal as a place in the region (may be negative). All alignments
    are worked out together, a row of the band at a time; beyond the budget the value only says so.
    """
    n = len(patterns)
    width = int(4 * (edits.max() + 1) + 1)  # the band and the budget on either side
    longest = max(map(len, patterns))
    lows = lows - (edits + 1)
    far = 1 << 20
    text = np.zeros((n, longest + width + 1), np.uint64)
    for i, region in enumerate(regions):  # text[i, x] is the region's character lows[i] + x
        a, b = max(0, int(lows[i])), min(len(region), int(lows[i]) + text.shape[1])
        if b > a:
            text[i, a - int(lows[i]) : b - int(lows[i])] = region[a:b]
    lengths = np.array([len(p) for p in patterns])
    sizes = np.array([len(r) for r in regions])
    letters = np.full((n, longest), np.uint64((1 << 63) - 1))
    for i, p in enumerate(patterns):
        letters[i, : len(p)] = p
    x = np.arange(width)
    ends = lows[:, None] + x  # place before which the region has been read, at row 0
    costs = np.where((ends >= 0) & (ends <= sizes[:, None]), 0, far).astype(np.int64)
    best, at = np.full(n, far), np.zeros(n, np.int64)
    for row in range(longest):
        skip = np.full((n, width), far)
        skip[:, :-1] = costs[:, 1:] + 1  # the pattern's letter has no partner
        same = costs + (text[:, row : row + width] != letters[:, row : row + 1])
        costs = np.minimum(same, skip)
        costs = np.minimum.accumulate(costs - x, axis=1) + x  # letters of the region without partner
        place = lows[:, None] + row + 1 + x
        costs = np.where((place >= 0) & (place <= sizes[:, None]), np.minimum(costs, far), far)
        done = np.flatnonzero(lengths == row + 1)
        if len(done):
            where = costs[done].argmin(axis=1)
            best[done] = costs[done, where]
            at[done] = lows[done] + row + 1 + where
    return best, at


def search(texts: list[str], indexes: list[Index | Short]) -> list[tuple[int, object, int, int, int]]:
    """(row, item, first, end, edits) of the best region of each item in each text.

    Places are in the normalised text; ``first`` is where the region begins at the earliest.
    """
    best: dict[tuple[int, object], tuple[int, int, int]] = {}
    low, size, rows = 0, 0, []
    normal = [normalise(t) for t in texts]
    for i, t in enumerate(normal):
        rows.append(t)
        size += len(t) + 1
        if size >= SLICE or i + 1 == len(normal):
            letters = codes("\0".join(rows))
            border = np.cumsum([0] + [len(r) + 1 for r in rows])
            letters[border[1:-1] - 1] = 0
            values: dict[int, np.ndarray] = {}
            for index in indexes:
                if isinstance(index, Short):
                    found = _search_short(letters, border, index)
                else:
                    if index.q not in values:
                        values[index.q] = window_hashes(letters, index.q)
                    found = _search_slice(letters, values[index.q], border, index)
                for row, item, first, end, edits in found:
                    key = (low + row, item)
                    if key not in best or (edits, first) < (best[key][2], best[key][0]):
                        best[key] = (first, end, edits)
            low, size, rows = i + 1, 0, []
    return [(row, item, *found) for (row, item), found in best.items()]


def _search_column(column: pa.Array, indexes: list[Index | Short]) -> list[tuple[int, object, int, int, int]]:
    """``search`` over a column, some hundred texts at a time."""
    texts = pc.fill_null(column, "")
    return [(low + row, *rest) for low in range(0, len(texts), 256) for row, *rest in search(texts.slice(low, 256).to_pylist(), indexes)]


def _search_short(letters: np.ndarray, border: np.ndarray, index: Short) -> Iterator[tuple[int, object, int, int, int]]:
    """Exact finds whose ends are not inside a word."""
    kinds, back = np.unique(letters, return_inverse=True)
    inside = np.array([bool(x) and chr(int(x) - 1).isalnum() for x in kinds], bool)[back]
    inside = np.concatenate([inside, [False]])
    cut = np.ones(len(letters) + 1, bool)  # places with a word border
    cut[1:-1] = ~(inside[:-2] & inside[1:-1])
    for n, known in index.by_length.items():
        values = window_hashes(letters, n)
        for at in np.flatnonzero(cut[: len(values)] & cut[n : n + len(values)] & np.isin(values, index.values[n])).tolist():
            row = int(np.searchsorted(border, at, side="right")) - 1
            for item in known.get(letters[at : at + n].tobytes(), ()):
                yield row, item, at - int(border[row]), at - int(border[row]) + n, 0


def _search_slice(letters: np.ndarray, values: np.ndarray, border: np.ndarray, index: Index) -> Iterator[tuple[int, object, int, int, int]]:
    if not len(values):
        return
    known = index.bits[(values >> np.uint64(64 - BITS)).astype(np.int64)]
    # a region has at least the bound of known places; mark all places of such stretches
    need, reach = int(index.least.min()), index.reach
    total = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])
    stop = np.minimum(np.arange(len(values)) + reach, len(values))
    full = (total[stop] - total[:-1] >= need) & known
    if not full.any():
        return
    edge = np.zeros(len(values) + 1, np.int32)
    starts = np.flatnonzero(full)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stop[starts], -1)
    places = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & known)
    # exact look-up, then one line per shared q-gram
    gram = np.searchsorted(index.grams, values[places])
    gram[gram == len(index.grams)] = 0
    real = index.grams[gram] == values[places]
    places, gram = places[real], gram[real]
    for a in range(0, len(places), 200_000):  # bounded memory; a margin keeps regions whole
        b = min(len(places), a + 200_000)
        margin = int(np.searchsorted(places, places[b - 1] + 2 * reach, side="right"))
        yield from _verify(letters, border, index, places[a:margin], gram[a:margin])


def _verify(letters: np.ndarray, border: np.ndarray, index: Index, places: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, object, int, int, int]]:
    counts = index.firsts[gram + 1] - index.firsts[gram]
    posting = np.repeat(index.firsts[gram], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    window, place = index.windows_of[posting].astype(np.int64), index.places[posting].astype(np.int64)
    diagonal = np.repeat(places, counts) - place
    step = index.edits[window] + 1
    upper = diagonal // step
    # each diagonal lies in two bands: band g holds diagonals g * step to (g + 2) * step - 1
    window, place, band = np.tile(window, 2), np.tile(place, 2), np.concatenate([upper, upper - 1])
    order = np.lexsort((place, band, window))
    window, place, band = window[order], place[order], band[order]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (window[1:] != window[:-1]) | (band[1:] != band[:-1])
    distinct = fresh.copy()
    distinct[1:] |= place[1:] != place[:-1]
    heads = np.flatnonzero(fresh)
    shared = np.add.reduceat(distinct.astype(np.int64), heads) if len(heads) else np.empty(0, np.int64)
    kept = heads[shared >= index.least[window[heads]]] if len(heads) else heads
    for a in range(0, len(kept), 512):
        some = kept[a : a + 512]
        w, lows = window[some], band[some] * (index.edits[window[some]] + 1)
        lengths = np.array([len(index.windows[i]) for i in w])
        # the text in which the middle of the region lies
        middle = np.clip(lows + index.edits[w] + 1 + lengths // 2, 0, len(letters) - 1)
        row = np.searchsorted(border, middle, side="right") - 1
        begin, end = border[row], border[row + 1] - 1
        regions, shifts = [], []
        for i in range(len(some)):
            lo = max(int(begin[i]), int(lows[i] - index.edits[w[i]] - 1))
            hi = min(int(end[i]), int(lows[i] + 3 * (index.edits[w[i]] + 1) + lengths[i]))
            regions.append(letters[lo:max(lo, hi)])
            shifts.append(lo)
        shifts = np.array(shifts)
        cost, at = banded([index.windows[i] for i in w], index.edits[w], regions, lows - shifts)
        for i in np.flatnonzero(cost <= index.edits[w]):
            last = int(shifts[i] + at[i] - begin[i])
            yield int(row[i]), index.items[w[i]], max(0, last - int(lengths[i]) - int(cost[i])), last, int(cost[i])


def blocks(items: DataFrame, id_col: str, text_col: str, size: int = BLOCK) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``size`` characters; one block at a time is on the driver."""
    block, held = [], 0
    for row in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, **limits) -> DataFrame:
    """One row per document and item found in it: id, item, first, last, edits of the best region.

    A null text holds nothing; items shorter than ``least`` characters count whole and unchanged only; repeated
    rows give repeated results; without items or documents the result is empty.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, first bigint, last bigint, edits int"
    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    out = spark.createDataFrame([], schema)
    for some in blocks(items, item_col, item_text, block):
        held = spark.sparkContext.broadcast(build(some, **limits))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            workers.release()
            for batch in batches:
                found = _search_column(batch.column(1), held.value)
                if found:
                    row, item, first, end, edits = zip(*found, strict=True)
                    columns = [batch.column(0).take(pa.array(row)), pa.array(item, item_arrow), pa.array(first, pa.int64()), pa.array([e - 1 for e in end], pa.int64()), pa.array(edits, pa.int32())]
                    yield pa.record_batch(columns, ["id", "item", "first", "last", "edits"])

        out = out.union(docs.select(id_col, text_col).mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, **limits) -> DataFrame:
    """The rows of ``docs`` in which no item is found, columns unchanged. Narrow: no shuffle."""
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    for some in blocks(items, item_col, item_text, block):
        held = spark.sparkContext.broadcast(build(some, **limits))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            workers.release()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in _search_column(batch.column(place), held.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

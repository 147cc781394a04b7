"""Spelling variants of frequent words, by PartEnum signatures of their letters.

A word's multiset of letters is a binary vector with a place for every (letter, occurrence). One
inserted, deleted or replaced letter changes at most two places. The places are cut into PARTS parts;
two vectors that differ in at most two places agree in all but two parts, so every choice of
PARTS - 2 parts gives a signature, and near words share one exactly.

Words are joined on equal signatures and verified letter by letter. A signature of many anagrams is
split by the letters at the near end of the word: one edit leaves either the first HEAD or the last
TAIL letters as they are, so each row is keyed by a signature and one of the two. A pair that meets
under several keys counts under the first one only, and a group gives back one row per member with
what it found, never its pairs. Groups of more than GROUP words are verified in blocks spread over
tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm import workers
from riskledger.llm.frames import checkpointed
from riskledger.llm.words import mix
from riskledger.session import scratch

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A word's form has at least so many times its occurrences.
TIMES = 10

PARTS = 4
CHOICES = list(combinations(range(PARTS), PARTS - 2))
HEAD, TAIL = 4, 3  # whatever the edit of a word of 7 letters or more, one of the two stays
GROUP = 20_000
#: Longer words are compared one pair at a time.
WIDE = 64
#: Distinct words that a task holds before it hands them on.
HELD = 400_000

#: Frequent letters in turn go to different parts.
_ORDER = "entaiohrsulcdfgbmzwyqxvpkj"
_RANK = np.arange(256) + len(_ORDER)
_RANK[[ord(c) for c in _ORDER]] = range(len(_ORDER))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 31) -> DataFrame:
    """word, n: how often each word of LEAST_LETTERS letters or more occurs over all texts, at least LEAST_COUNT times.

    Words are runs of ASCII letters and the characters from U+00C0 to U+00FF; only A-Z are lower-cased.
    If ``damage`` divides the CRC-32 of ``<id>:<run>``, the run loses the letter at that number modulo
    its length, which plants misspellings; 0 plants none. A null id is an empty string there, a
    null text has no words. Counts are joined in a task before the shuffle.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        total: Counter[str] = Counter()
        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1), strict=True):
                low = (text.as_py() or "").encode().lower().decode()  # bytes: A-Z only
                found = Counter(runs.findall(low))
                start = zlib.crc32(f"{own.as_py()}:".encode())
                for word, n in found.items():
                    if damage:
                        h = zlib.crc32(word.encode(), start)
                        if not h % damage:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LETTERS:
                                continue
                    total[word] += n
                if len(total) > HELD:
                    yield _counts(total)
                    total.clear()
        yield _counts(total)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _counts(total: Counter[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def part_of(letters: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """The part of the place (letter, occurrence from 0)."""
    return (_RANK[letters] + 2 * occurrence) % PARTS


def signatures(words: list[bytes]) -> np.ndarray:
    """For each word (in Latin-1) one row of keys: each choice of parts with the head, then each with the tail."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((letters, row))
    row, sorted_ = row[order], letters[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (sorted_[1:] != sorted_[:-1])
    place = np.arange(len(row))
    occurrence = place - np.maximum.accumulate(np.where(new, place, 0))
    value = mix(sorted_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + occurrence.astype(np.uint64))
    parts = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(parts, (row, part_of(sorted_, occurrence)), value)
    out = np.empty((len(words), 2 * len(CHOICES)), np.uint64)
    ends = [np.array([int.from_bytes(w[:HEAD], "big") for w in words], np.uint64), np.array([int.from_bytes(w[-TAIL:], "big") for w in words], np.uint64)]
    for k, chosen in enumerate(CHOICES):
        own = np.full(len(words), k, np.uint64)
        for p in chosen:
            own = mix(own * np.uint64(0xD6E8FEB86659FD93) + parts[:, p])
        for side in (0, 1):
            out[:, side * len(CHOICES) + k] = mix(own + ends[side] * np.uint64(2) + np.uint64(side))
    return out


def one_edit(a: bytes, b: bytes) -> int:
    """The place of the only inserted, deleted or replaced letter between two words; -1 if there is no such place."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return -1
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return at if a[at + 1 :] == b[at + 1 :] and len(a) == len(b) or a[at:] == b[at + 1 :] and len(a) < len(b) else -1


class Group:
    """Rows of (key, table, word, n) in which those of a key stand together."""

    def __init__(self, keys: np.ndarray, tables: np.ndarray, words: list[bytes], counts: np.ndarray):
        self.keys, self.tables, self.words, self.counts = keys, tables, words, counts
        self.sizes = np.array([len(w) for w in words], np.int64)
        wide = int(min(max(self.sizes.max(initial=0), 1), WIDE)) + 1
        self.letters = np.frombuffer(b"".join(w[:wide].ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart and count under their key."""
        gap = self.sizes[i] - self.sizes[j]
        close = np.flatnonzero(np.abs(gap) <= 1)
        i, j = np.where(gap[close] > 0, j[close], i[close]), np.where(gap[close] > 0, i[close], j[close])  # j is the longer
        out = np.zeros(len(gap), bool)
        long_ = self.sizes[j] > WIDE
        for k in np.flatnonzero(long_).tolist():
            out[close[k]] = self._counts_long(int(i[k]), int(j[k]))
        close, i, j = close[~long_], i[~long_], j[~long_]
        same = self.sizes[i] == self.sizes[j]
        out[close[same]] = self._replaced(i[same], j[same])
        out[close[~same]] = self._inserted(i[~same], j[~same])
        return out

    def _replaced(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        unlike = self.letters[i] != self.letters[j]
        out = unlike.sum(axis=1) == 1
        hit = np.flatnonzero(out)
        if len(hit):
            at = unlike[hit].argmax(axis=1)
            i, j = i[hit], j[hit]
            a, b = self.letters[i, at], self.letters[j, at]
            touched = [part_of(a, (self.letters[i] == a[:, None]).sum(axis=1) - 1), part_of(b, (self.letters[j] == b[:, None]).sum(axis=1) - 1)]
            out[hit] = self._first(i, j, touched)
        return out

    def _inserted(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        short, long_ = self.letters[i], self.letters[j]
        before, after = short[:, :-1] != long_[:, :-1], short[:, :-1] != long_[:, 1:]
        wide = before.shape[1]
        first = np.where(before.any(axis=1), before.argmax(axis=1), wide)
        last = np.where(after.any(axis=1), wide - 1 - after[:, ::-1].argmax(axis=1), -1)
        out = first > last
        hit = np.flatnonzero(out)
        if len(hit):
            i, j = i[hit], j[hit]
            b = self.letters[j, np.minimum(first[hit], self.sizes[i])]
            out[hit] = self._first(i, j, [part_of(b, (self.letters[j] == b[:, None]).sum(axis=1) - 1)])
        return out

    def _first(self, i: np.ndarray, j: np.ndarray, touched: list[np.ndarray]) -> np.ndarray:
        """Whether the rows' table is the first under which the pair meets, given the parts that differ."""
        choice = np.full(len(i), len(CHOICES))
        for k in range(len(CHOICES) - 1, -1, -1):
            free = np.ones(len(i), bool)
            for parts in touched:
                free &= ~np.isin(parts, CHOICES[k])
            choice[free] = k
        heads = (self.letters[i, :HEAD] == self.letters[j, :HEAD]).all(axis=1)
        return self.tables[i] == np.where(heads, choice, choice + len(CHOICES))

    def _counts_long(self, i: int, j: int) -> bool:
        a, b = self.words[i], self.words[j]
        at = one_edit(a, b)
        if at < 0:
            return False
        changed = [(b, b[at])] + ([(a, a[at])] if len(a) == len(b) else [])
        touched = [part_of(np.array([x]), np.array([w.count(bytes([x])) - 1])) for w, x in changed]
        return bool(self._first(np.array([i]), np.array([j]), touched)[0])


def _met(group: Group, asks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs i, j of rows of one key; with ``asks`` only pairs of a row that asks and one that does not."""
    ends = np.searchsorted(group.keys, group.keys, side="right") if asks is None else None
    if ends is not None:
        alive, shift = np.flatnonzero(ends > np.arange(len(ends)) + 1), 1
        while len(alive):
            for low in range(0, len(alive), 1 << 17):
                i = alive[low : low + (1 << 17)]
                hit = group.near(i, i + shift)
                if hit.any():
                    yield i[hit], i[hit] + shift
            shift += 1
            alive = alive[ends[alive] > alive + shift]
        return
    rest = np.flatnonzero(~asks)
    for i in np.flatnonzero(asks):
        j = rest[group.keys[rest] == group.keys[i]]
        own = np.full(len(j), i)
        hit = group.near(own, j)
        if hit.any():
            yield own[hit], j[hit]


def _found(group: Group, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """word, near (how many), best_n, best (the most frequent near word, then the smallest) of each word with a pair."""
    both = list(pairs)
    i = np.concatenate([x for x, _ in both] or [np.empty(0, np.int64)])
    j = np.concatenate([x for _, x in both] or [np.empty(0, np.int64)])
    who, other = np.concatenate([i, j]), np.concatenate([j, i])
    used, place = np.unique(np.concatenate([who, other]), return_inverse=True)
    rank = np.empty(len(used), np.int64)
    rank[sorted(range(len(used)), key=lambda k: group.words[used[k]])] = np.arange(len(used))
    order = np.lexsort((rank[place[len(who) :]], -group.counts[other], who))
    who, other = who[order], other[order]
    firsts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, np.int64)
    text = [group.words[k].decode("latin-1") for k in who[firsts]]
    best = [group.words[k].decode("latin-1") for k in other[firsts]]
    near = np.diff(np.r_[firsts, len(who)])
    return pa.record_batch([pa.array(text, pa.string()), pa.array(near, pa.int64()), pa.array(group.counts[other[firsts]], pa.int64()), pa.array(best, pa.string())], ["word", "near", "best_n", "best"])


_KEYED = "key bigint, t int, word string, n bigint"
_FOUND = "word string, near bigint, best_n bigint, best string"


def _keyed(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        tables = 2 * len(CHOICES)
        for batch in batches:
            keys = signatures([w.encode("latin-1") for w in batch.column(0).to_pylist()])
            row = pa.array(np.repeat(np.arange(batch.num_rows), tables))
            table = np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(table), batch.column(0).take(row), batch.column(1).take(row)], ["key", "t", "word", "n"])

    return words.select("word", "n").mapInArrow(run, _KEYED)


def _group(batch: pa.RecordBatch) -> Group:
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    return Group(batch.column("key").to_numpy(), batch.column("t").to_numpy(), words, batch.column("n").to_numpy())


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, near, best_n, best: for each of the distinct ``words`` (word, n) with a near word."""
    spark = words.sparkSession
    folder = scratch(spark, "variants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. What was found, and the rows of large groups with their key."""
        workers.release()
        held, large = None, None
        for batch in batches:
            rows = pa.concat_batches([held, batch]) if held is not None and held.num_rows else batch
            keys = rows.column("key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            done, held = rows.slice(0, last), rows.slice(last)
            yield from results(done, large)
            if held.num_rows > group:
                large = held.column("key")[0].as_py()
                yield whole(held)
                held = held.slice(0, 0)
            elif held.num_rows and held.column("key")[0].as_py() == large:
                yield whole(held)
                held = held.slice(0, 0)
        if held is not None:
            yield from results(held, large)

    def results(rows: pa.RecordBatch, large: int | None) -> Iterator[pa.RecordBatch]:
        keys = rows.column("key").to_numpy()
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[start, len(keys)])
        big = np.repeat((sizes > group) | (keys[start] == large if large is not None else False), sizes)
        single = np.repeat(sizes == 1, sizes)
        if big.any():
            yield whole(rows.filter(pa.array(big)))
        some = rows.filter(pa.array(~big & ~single))
        if some.num_rows:
            own = _group(some)
            found = _found(own, _met(own))
            none = pa.nulls(found.num_rows)
            yield pa.record_batch([*found.columns, none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64())], [*found.schema.names, "key", "t", "n"])

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(rows.num_rows)
        return pa.record_batch([rows.column("word"), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string()), rows.column("key"), rows.column("t"), rows.column("n")], ["word", "near", "best_n", "best", "key", "t", "n"])

    met = _keyed(words).repartition("key").sortWithinPartitions("key").mapInArrow(run, f"{_FOUND}, key bigint, t int, n bigint")
    met.write.parquet(f"{folder}/met")
    met = spark.read.schema(met.schema).parquet(f"{folder}/met")
    out, large = met.where("key is null").select("word", "near", "best_n", "best"), met.where("key is not null").select("key", "t", "word", "n")
    if not large.isEmpty():
        out = out.union(_blocks(large, group))
    best = out.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("best"))
    return best.select("word", "near", (-F.col("best.n")).alias("best_n"), F.col("best.best").alias("best"))


def _blocks(large: DataFrame, group: int) -> DataFrame:
    """What the groups of more than ``group`` words find, from pairs of chunks, each a task's work."""
    counts = checkpointed(large.groupBy("key").agg(F.ceil(2 * F.count("*") / group).cast("int").alias("chunks")))
    rows = large.join(counts, "key").withColumn("chunk", F.pmod(F.hash("word"), F.col("chunks")))
    upto = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("chunk"))).alias("other")).withColumn("asks", F.lit(True))
    after = rows.select("*", F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("other")).withColumn("asks", F.lit(False))
    dealt = upto.select("key", "t", "word", "n", F.col("chunk").alias("a"), F.col("other").alias("b"), "asks").union(after.select("key", "t", "word", "n", F.col("other").alias("a"), F.col("chunk").alias("b"), "asks"))

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["key", "t", "word", "n"]).combine_chunks()
        own = _group(rows.to_batches()[0])
        asks = table.column("asks").to_numpy()
        inside = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        if inside:  # both copies of a chunk are here: one is enough
            own, asks = _group(rows.filter(pa.array(asks)).combine_chunks().to_batches()[0]), None
        return pa.Table.from_batches([_found(own, _met(own, asks))])

    return dealt.groupBy("key", "a", "b").applyInArrow(run, _FOUND)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 31, group: int = GROUP) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are near if one letter is inserted, deleted or replaced. A word's form is its near word of largest
    n (then the smallest) if that has TIMES the word's n or more; root is the last form of the chain.
    Repeated rows count again; rows without words and an empty table give nothing; no other column is read.
    """
    words = checkpointed(occurrences(docs, id_col, text_col, damage))
    near = near_words(words, group)
    found = words.join(near, "word", "left").withColumn("has", F.col("best_n") >= TIMES * F.col("n"))
    found = checkpointed(found.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n")))
    # a form has TIMES the occurrences, so a chain is short and halved five times at most
    up = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        after = checkpointed(up.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        up = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return found.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Alignment of two tokenizers over the same bytes.

A text is encoded by a byte-level vocabulary (A) and by one of pieces with byte fallback (B). Where
a token of each ends at the same byte both sequences are cut, which gives groups of tokens that
cover the same bytes, and a link between the two tokens that end there. Links are counted over the
whole corpus.

Long texts are dealt into byte ranges, and a range owns the tokens that end in it. What a range
yields is a fragment: an open prefix (the tokens up to the first common end, whose group may have
begun before the range), closed groups, and an open suffix. Fragments form a monoid: the suffix of one
and the prefix of the next make a group. So the ranges of a text are encoded by different tasks and
composed in a tree, FAN at a time. Both encoders can start afresh before a space that stands between
characters other than white space, so each range is encoded from the last such place before it.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm import tokens, workers
from riskledger.session import scratch

#: Bytes of a range.
RANGE = 1 << 18
#: Fragments that one step of the tree composes.
FAN = 16
#: Bytes of text whose distinct links are counted together.
HOME = 4 << 20

#: A space where both encoders can start afresh (some such places, found by bytes).
BORDER = re.compile(rb"[^ ] (?=[\x21-\x7e\x80-\xc1\xc3-\xe0\xe4-\xff])")


@dataclass(frozen=True)
class Fragment:
    """Groups as text: ids of a side joined by commas, sides by |, groups by ;. Without a common end all is in the head."""

    closed: bool = False
    head_a: str = ""
    head_b: str = ""
    body: str = ""
    tail_a: str = ""
    tail_b: str = ""

    def __add__(self, other: Fragment) -> Fragment:
        if not self.closed:
            return Fragment(other.closed, _join(self.head_a, other.head_a), _join(self.head_b, other.head_b), other.body, other.tail_a, other.tail_b)
        a, b = _join(self.tail_a, other.head_a), _join(self.tail_b, other.head_b)
        if not other.closed:
            return Fragment(True, self.head_a, self.head_b, self.body, a, b)
        return Fragment(True, self.head_a, self.head_b, _join(_join(self.body, f"{a}|{b}", ";"), other.body, ";"), other.tail_a, other.tail_b)

    def text(self) -> str:
        """The groups of a whole text."""
        return _join(f"{self.head_a}|{self.head_b}", self.body, ";") if self.closed else ""


def _join(a: str, b: str, by: str = ",") -> str:
    return f"{a}{by}{b}" if a and b else a or b


def composed(fragments: Iterable[Fragment]) -> Fragment:
    """The sum; bodies are joined once, so that a long row costs its length."""
    head, bodies, tail = None, [], Fragment()
    for f in fragments:
        if not f.closed:
            tail = tail + f
        elif head is None:
            head, tail = tail + Fragment(True, f.head_a, f.head_b), Fragment(False, f.tail_a, f.tail_b)
            bodies.append(f.body)
        else:
            bodies += [f"{_join(tail.head_a, f.head_a)}|{_join(tail.head_b, f.head_b)}", f.body]
            tail = Fragment(False, f.tail_a, f.tail_b)
    return tail if head is None else Fragment(True, head.head_a, head.head_b, ";".join(filter(None, bodies)), tail.head_a, tail.head_b)


class Aligner(tokens.Cache):
    """chunk without its leading space -> (A tokens, B tokens, links as 64-bit numbers, groups as text), or None if B loses bytes."""

    def __init__(self, names: tuple[str, str] = (tokens.BYTE_BPE, tokens.PIECES), most: int = tokens.CACHE):
        super().__init__(most)
        self.a = tokens.ByteBpe(names[0], 1).model
        self.b = tokens.sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{names[1]}.model"))
        self.a_size = [len(self.a.decode_single_token_bytes(i)) for i in range(self.a.n_vocab)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.b_size = list(map(len, self.b_bytes))
        self.names = list(map(str, range(max(len(self.a_size), len(self.b_size)))))
        if any(re.search(rb"[^ ] ", x) for x in self.b_bytes):
            raise ValueError("a piece goes on over a space: the borders do not hold")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, chunk: str) -> tuple[list[int], list[int]] | None:
        """Ids under A and B of a space and the chunk."""
        a, b = self.a.encode_ordinary(f" {chunk}"), self.b.encode(chunk)
        return (a, b) if b"".join(map(self.b_bytes.__getitem__, b)) == f" {chunk}".encode() else None

    def encoded(self, chunk: str):
        both = self.ids(chunk)
        if both is None:
            return None
        # what cut() gives for all tokens, written out since most of the time goes here
        (a, b), a_size, b_size, name = both, self.a_size, self.b_size, self.names
        links, groups, i, j, from_a, from_b, end_a, end_b = [], [], 0, 0, 0, 0, 0, 0
        while i < len(a):
            end_a += a_size[a[i]]
            end_b += b_size[b[j]]
            while end_a != end_b:
                if end_a < end_b:
                    i += 1
                    end_a += a_size[a[i]]
                else:
                    j += 1
                    end_b += b_size[b[j]]
            links.append(a[i] << 32 | b[j])
            i, j = i + 1, j + 1
            groups.append(f"{','.join([name[x] for x in a[from_a:i]])}|{','.join([name[x] for x in b[from_b:j]])}")
            from_a, from_b = i, j
        return len(a), len(b), array("q", links).tobytes(), ";".join(groups)

    def cut(self, a: list[int], b: list[int], at: int, low: int, high: int) -> tuple[list[int], Fragment]:
        """Links and fragment of the tokens that end after ``low`` and not after ``high``; the first ones begin at ``at``."""
        links, groups, own_a, own_b, j, end_b = [], [], [], [], 0, at
        end_a = at
        for x in a:
            end_a += self.a_size[x]
            if low < end_a <= high:
                own_a.append(x)
            while j < len(b) and end_b + self.b_size[b[j]] <= end_a:
                end_b += self.b_size[b[j]]
                if low < end_b <= high:
                    own_b.append(b[j])
                j += 1
            if end_a == end_b and low < end_a <= high:
                links.append(x << 32 | b[j - 1])
                groups.append((",".join(map(str, own_a)), ",".join(map(str, own_b))))
                own_a, own_b = [], []
        for x in b[j:]:
            end_b += self.b_size[x]
            if low < end_b <= high:
                own_b.append(x)
        tail = (",".join(map(str, own_a)), ",".join(map(str, own_b)))
        if not groups:
            return links, Fragment(False, *tail)
        return links, Fragment(True, *groups[0], ";".join(map("|".join, groups[1:])), *tail)


def chunks(text: str) -> list[str]:
    """The text cut before every space at which both encoders start afresh; the spaces go."""
    parts = text.split(" ")
    if "" not in parts and not any(map(str.isspace, {p[0] for p in parts})):
        return parts
    out, before = [parts[0]], parts[0]
    for part in parts[1:]:
        if not before or not part or part[0].isspace():
            out[-1] += f" {part}"
        else:
            out.append(part)
        before = part
    return out


def whole(aligner: Aligner, text: str) -> tuple[int, int, bytes, str] | None:
    """A tokens, B tokens, links and groups of a text; None if it is empty or B loses bytes."""
    found = list(map(aligner.__getitem__, chunks(text))) if text else [None]
    if None in found:
        return None
    return sum(x[0] for x in found), sum(x[1] for x in found), b"".join([x[2] for x in found]), ";".join([x[3] for x in found])


def ranges(text: str, size: int = RANGE) -> Iterator[tuple[int, int, int, str]]:
    """(first byte, last byte, place where its piece begins, piece) of the ranges of a space and the text.

    A piece reaches from a border at or before the range to one at or after its end. A stretch without a
    border meets one range's end at most, so no stretch is encoded more than twice.
    """
    full = b" " + text.encode()
    ends, at = [], size
    while at < len(full):
        if _border(full, at) > (ends[-1] if ends else 0):
            ends.append(at)
        at += size
    for low, high in zip([0, *ends], [*ends, len(full)], strict=True):
        begin = _border(full, low) if low else 0
        after = BORDER.search(full, high - 1) if high < len(full) else None
        end = after.start() + 1 if after else len(full)
        yield low, high, begin, full[begin + 1 : end].decode()


def _border(full: bytes, at: int) -> int:
    """The last known border at or before a place; 0 if there is none."""
    step = 1 << 10
    while True:
        low = max(at - step, 0)
        last = 0
        for m in BORDER.finditer(full, low, at + 2):
            if m.start() + 1 <= at:
                last = m.start() + 1
        if last or not low:
            return last
        step *= 8


def ranged(aligner: Aligner, low: int, high: int, begin: int, piece: str) -> tuple[int, int, bytes, Fragment] | None:
    """What one range owns of its piece."""
    at, n_a, n_b, links, parts = begin, 0, 0, [], []
    closed: list[str] = []
    for chunk in chunks(piece):
        end = at + 1 + len(chunk.encode())
        if at >= low and end <= high:  # all its tokens are in the range
            found = aligner[chunk]
            if found is None:
                return None
            n_a, n_b = n_a + found[0], n_b + found[1]
            links.append(found[2])
            closed.append(found[3])
        else:
            both = aligner.ids(chunk)
            if both is None:
                return None
            own, fragment = aligner.cut(*both, at, low, high)
            links.append(np.array(own, np.int64).tobytes())
            parts += [_closed(closed), fragment]
            closed = []
            n_a += _count(fragment, "a")
            n_b += _count(fragment, "b")
        at = end
    return n_a, n_b, b"".join(links), composed([*parts, _closed(closed)])


def _closed(groups: list[str]) -> Fragment:
    """Whole groups as a fragment."""
    first, _, body = ";".join(groups).partition(";")
    a, _, b = first.partition("|")
    return Fragment(True, a, b, body) if groups else Fragment()


def _count(f: Fragment, side: str) -> int:
    groups = [f.body.split(";")] if f.body else []
    sides = [getattr(f, f"head_{side}"), getattr(f, f"tail_{side}"), *(g.split("|")[side == "b"] for g in (groups[0] if groups else []))]
    return sum(x.count(",") + 1 for x in sides if x)


_FRAGMENT = "closed boolean, head_a string, head_b string, body string, tail_a string, tail_b string"
_UNIT = "doc bigint, k int, ok boolean, n_a bigint, n_b bigint, n_groups bigint, sha string"
#: codes: places of a unit's links in the sorted pairs of its home; pairs and times stand in the first row of a home.
_HOME = "home bigint, codes binary, pairs array<bigint>, times array<bigint>"


def _homes(rows: Iterator[tuple[list, bytes, int, bool]], names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches of homes from (columns, links, bytes of text, whether a home ends here)."""
    home = TaskContext.get().partitionId() << 32
    held, size = [], 0

    def done() -> pa.RecordBatch:
        links = np.frombuffer(b"".join([x for _, x in held]), np.int64)
        pairs, codes, times = np.unique(links, return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x) // 8 for _, x in held])
        own = [x.astype(np.uint32).tobytes() for x in np.split(codes, ends[:-1])]
        columns = [pa.array([c[i] for c, _ in held], t) for i, t in enumerate(_types(kind, len(held[0][0])))]
        rest = len(held) - 1
        columns += [pa.array([home] * len(held), pa.int64()), pa.array(own, pa.binary()), pa.array([pairs, *[None] * rest], pa.list_(pa.int64())), pa.array([times, *[None] * rest], pa.list_(pa.int64()))]
        return pa.record_batch(columns, names)

    for columns, links, n, last in rows:
        held.append((columns, links))
        size += n
        if last or size >= HOME:
            yield done()
            home, held, size = home + 1, [], 0
    if held:
        yield done()


def _types(kind: pa.DataType, n: int) -> list[pa.DataType]:
    unit = [kind, pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return [*unit, pa.bool_(), *[pa.string()] * 5][:n]


def _short(docs: DataFrame, kind: str) -> DataFrame:
    """One unit per text of at most a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = workers.keep(("align", tokens.BYTE_BPE, tokens.PIECES), Aligner)
        yield from _homes(rows(aligner, batches), [*"id doc k ok n_a n_b n_groups sha home codes pairs times".split()], types[0])

    def rows(aligner: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = whole(aligner, text)
                if found is None:
                    yield [own, None, None, False, 0, 0, 0, ""], b"", len(text), False
                else:
                    n_a, n_b, links, groups = found
                    yield [own, None, None, True, n_a, n_b, len(links) // 8, hashlib.sha256(groups.encode()).hexdigest()], links, len(text), False

    types = _arrow_of(docs)
    return docs.mapInArrow(run, f"id {kind}, {_UNIT}, {_HOME}")


def _arrow_of(docs: DataFrame) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in docs.schema.fields]


def _pieces(docs: DataFrame, kind: str, size: int) -> DataFrame:
    """id, doc (a number for the row), k, low, high, begin, piece: the ranges of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        doc = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                for k, (low, high, begin, piece) in enumerate(ranges(text.as_py(), size)):
                    own = [pa.array([x], t) for x, t in zip((doc, k, low, high, begin, piece), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.record_batch([batch.column(0).slice(i, 1), *own], ["id", "doc", "k", "low", "high", "begin", "piece"])
                doc += 1

    return docs.mapInArrow(run, f"id {kind}, doc bigint, k int, low bigint, high bigint, begin bigint, piece string")


def _long(pieces: DataFrame, kind: str) -> DataFrame:
    """One unit per range, with its fragment; each is a home of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = workers.keep(("align", tokens.BYTE_BPE, tokens.PIECES), Aligner)
        names = "id doc k ok n_a n_b n_groups sha closed head_a head_b body tail_a tail_b home codes pairs times".split()
        yield from _homes(rows(aligner, batches), names, types[0])

    def rows(aligner: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, doc, k, low, high, begin, piece = (batch.column(c)[i].as_py() for c in range(7))
                found = ranged(aligner, low, high, begin, piece)
                n_a, n_b, links, f = found or (0, 0, b"", Fragment())
                yield [own, doc, k, found is not None, n_a, n_b, len(links) // 8, None, f.closed, f.head_a, f.head_b, f.body, f.tail_a, f.tail_b], links, len(piece), True

    types = _arrow_of(pieces)
    # few rows of much work each: one task for some of them, whatever their bytes
    dealt = pieces.repartition(max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "doc", "k")
    return dealt.mapInArrow(run, f"id {kind}, {_UNIT}, {_FRAGMENT}, {_HOME}")


def _digests(fragments: DataFrame, fan: int = FAN) -> DataFrame:
    """doc, sha: the fragments of each text composed in a tree of ``fan`` branches."""
    names = [x.split()[0] for x in _FRAGMENT.split(", ")]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            for i in range(batch.num_rows):
                own = sorted(batch.column(2)[i].as_py(), key=lambda x: x["k"])
                f = composed(Fragment(*(x[n] for n in names)) for x in own)
                columns = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *[pa.array([getattr(f, n)]) for n in names]]
                yield pa.record_batch(columns, ["doc", "k", *names])

    now = fragments.select("doc", "k", *names)
    most = now.agg(F.max("k")).first()[0]
    while most:
        most //= fan
        branches = now.select("doc", F.floor(F.col("k") / fan).cast("int").alias("up"), F.struct("k", *names).alias("f")).groupBy("doc", "up").agg(F.collect_list("f").alias("fs"))
        now = branches.mapInArrow(compose, f"doc bigint, k int, {_FRAGMENT}")
    head = F.concat_ws("|", "head_a", "head_b")
    groups = F.when(F.col("body") == "", head).otherwise(F.concat_ws(";", head, "body"))
    return now.select("doc", F.sha2(groups, 256).alias("sha"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best are the links whose count over all texts is the highest of their B token's, ties included;
    count_sum is the sum of the counts over the links. A text that is null or empty, or whose B tokens do
    not give back its bytes, has no tokens: zeros and an empty digest. Repeated rows are rows of
    their own; an empty table gives an empty result; no other column is read.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "align")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    is_long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    short = stored(_short(rows.where(~is_long), kind), "short")
    pieces = stored(_pieces(rows.where(is_long), kind, size), "pieces")
    long_ = stored(_long(pieces, kind), "long")
    bad = long_.where(~F.col("ok")).select("doc").distinct()
    good = long_.join(bad, "doc", "left_anti")
    unit = [x.split()[0] for x in f"id {kind}, {_UNIT}".split(", ")]
    shared = "home", "pairs", "times"
    asks = short.select(F.lit(0).alias("part"), *shared).union(good.select(F.lit(1).alias("part"), *shared))
    asks = asks.where("pairs is not null").select("part", "home", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("part", "home", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = stored(asks.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    known = counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asks.join(known, "pair").select(F.col("part").alias("to_part"), F.col("home").alias("to_home"), "pair", "n", "best")
    units = short.select(F.lit(0).alias("part"), "home", *unit, "codes").union(good.select(F.lit(1).alias("part"), "home", *unit, "codes"))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        workers.release()
        order = np.argsort(right.column("pair").to_numpy())
        n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False).astype(bool)[order]
        sums, bests = [], []
        for codes in left.column("codes").to_pylist():
            at = np.frombuffer(codes, np.uint32)
            sums.append(int(n[at].sum()))
            bests.append(int(best[at].sum()))
        return left.select(unit).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    looked = units.groupBy("part", "home").cogroup(answers.groupBy("to_part", "to_home")).applyInArrow(look_up, f"id {kind}, {_UNIT}, n_best bigint, count_sum bigint")
    looked = stored(looked, "looked")
    out = ["id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", F.col("sha").alias("groups_sha256")]
    done = looked.where("doc is null").select(*out)
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")]
    whole_ = looked.where("doc is not null").groupBy("doc").agg(F.first("id").alias("id"), *sums).join(_digests(good, fan), "doc")
    without = long_.join(bad, "doc", "left_semi").where("k = 0").select("id", *[F.lit(0).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")], F.lit("").alias("sha"))
    return done.union(whole_.select(*out)).union(without.select(*out))

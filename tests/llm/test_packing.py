import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from riskledger.llm import packing, registry, tokens
from tests_llm_rows import ROWS


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


SPACES = [" ", "  ", "\n", "\t", " \n", " ", " ", "\x1c", "\x85", "\r\n", "   "]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    rng = random.Random(3)
    texts = [t or "" for _, t, _ in ROWS] + ["".join(rng.choice(["a", "the", "Don't", "12", "!?", "é", "漢", "\U0001f600", "<|endoftext|>", "<|end", *SPACES]) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    model = tokens.ByteBpe(most=50)
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(model.encode(text), "<u4").tolist() == want.ids, repr(text)
    assert len(model) <= 50


def check(rows, length):
    """Pieces in sequences without gaps, overlaps or overflow; the number of sequences."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_query(spark, sf, tokenizer):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = registry.QUERIES["op10_packing"](spark, sf).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for (i, _), e in zip(docs, tokenizer.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        ids = [*e.ids, 0]
        first = len(ids) % 2048 or 2048
        for k, start in enumerate([0, *range(first, len(ids), 2048)]):
            n = first if k == 0 else 2048
            want[i, k] = (start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))
    assert got == want and len(rows) == len(want)
    assert check(rows, 2048) <= math.ceil(sum(r.length for r in rows) / 2048) + 1


@pytest.mark.parametrize("group", [4, 30_000])
def test_edge_rows(edge_docs, no_docs, group):
    rows = packing.pack_documents(edge_docs, length=64, group=group).collect()
    check(rows, 64)
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert [r.length for r in rows if r.id == 5] == [1] and [r.length for r in rows if r.id == 4] == [1]
    assert packing.pack_documents(no_docs).count() == 0


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "on a mat " * 30), (3, None)], "doc_id bigint, text string")
    packed = packing.pack_documents(docs, length=32)
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs, packed, length=32).collect()}
    for i, text in ((1, "the cat sat"), (2, "on a mat " * 30), (3, "")):
        ids = []
        for r in sorted((r for r in packed.collect() if r.id == i), key=lambda r: r.piece):
            ids += whole[r.sequence_id][r.offset : r.offset + r.length]
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def optimum(sizes, length):
    """Least number of bins by exhaustive search."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= length:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_never_fewer_bins_than_the_optimum():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(20, 60) for _ in range(9)]
        bins = packing.pack_group(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(9)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert optimum(sizes, 100) <= len(bins) <= len(packing.best_fit(sizes, 100))


def test_search_empties_bins_that_best_fit_leaves():
    rng = random.Random(1)
    fitted = searched = 0
    for _ in range(20):
        sizes = [rng.randint(26, 50) for _ in range(200)]
        fitted += len(packing.best_fit(sizes, 100))
        bins = packing.pack_group(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(200)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        searched += len(bins)
    assert searched < fitted


def test_every_exchange_raises_the_squared_fill():
    rng = random.Random(2)
    sizes = [rng.randint(1, 70) for _ in range(60)]
    search = packing.Search(sizes, packing.best_fit(sizes, 100), 100)
    search_exchange, fills = search._exchange, []

    def watched(*a):
        before = sum(f * f for f in search.fill)
        search_exchange(*a)
        fills.append(sum(f * f for f in search.fill) - before)

    search._exchange = watched
    search.run()
    assert all(x > 0 for x in fills)


def test_exchanges_beyond_four_keys_and_24_pieces_are_found():
    sizes = [5] + [1] * 30 + [2] * 29
    search = packing.Search(sizes, [[0], list(range(1, 31)), list(range(31, 60))], 60)
    assert 2 in search._parts(1) and 4 in search._parts(2)

    def brute(s, a):
        """Least gap of any exchange that counts."""
        gaps = []
        for size, out in s._parts(a).items():
            for b in range(len(s.bins)):
                if b != a and out and s.bins[b]:
                    for part in s._parts(b):
                        fill = s.fill[b] + size - part
                        if size > part and fill <= s.length and fill > s.fill[a]:
                            gaps.append(s.length - fill)
        return min(gaps, default=None)

    rng = np.random.default_rng(7)
    for _ in range(60):
        bins, sizes = [], []
        for _ in range(6):
            own = rng.integers(1, 9, rng.integers(1, 30)).tolist()
            while sum(own) > 100:
                own.pop()
            bins.append(list(range(len(sizes), len(sizes) + len(own))))
            sizes += own
        s = packing.Search(sizes, bins, 100)
        for a in range(6):
            if a in s.own:
                want, before = brute(s, a), list(s.fill)
                assert s._improve(a) == (want is not None)
                if want is not None:
                    b = next(x for x in range(6) if x != a and s.fill[x] != before[x])
                    assert s.length - s.fill[b] == want

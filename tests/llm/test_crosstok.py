"""Alignment of two tokenizers against the tokenizers themselves."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from riskledger.llm import crosstok, registry
from riskledger.llm.crosstok import Fragment
from tests_llm_rows import ROWS, prose
from tokenizers import Tokenizer


def decoder():
    """Byte-level alphabet of the first vocabulary: character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + more)] = b
            more += 1
    return out


A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTES = decoder()


def tokens_of(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    x = [bytes(BYTES[c] for c in A.id_to_token(i)) for i in a]
    y = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    full = (" " + text).encode()
    return (a, x, b, y) if text and b"".join(x) == full == b"".join(y) else None


def brute(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each row."""
    found, total = [], Counter()
    for own, text in rows:
        both = tokens_of(text or "")
        if both is None:
            found.append((own, 0, 0, [], []))
            continue
        a, x, b, y = both
        ends_a, ends_b, at = {}, {}, 0
        for i, t in zip(a, x):
            at += len(t)
            ends_a[at] = i
        at = 0
        for i, t in zip(b, y):
            at += len(t)
            ends_b[at] = i
        common = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for end in common:
            groups.append(",".join(str(v) for k, v in ends_a.items() if low < k <= end) + "|" + ",".join(str(v) for k, v in ends_b.items() if low < k <= end))
            low = end
        links = [(ends_a[e], ends_b[e]) for e in common]
        total.update(links)
        found.append((own, len(a), len(b), groups, links))
    most = {}
    for (_, b), n in total.items():
        most[b] = max(n, most.get(b, 0))
    return Counter((own, n_a, n_b, len(g), len(k), sum(total[x] == most[x[1]] for x in k), sum(total[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "") for own, n_a, n_b, g, k in found)


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_query_against_the_tokenizers(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.QUERIES["op12_crosstok"](spark, sf)) == brute(rows)


def odd(rng, n):
    parts = [" ", "  ", "\n", "\t ", "a", "word", "don't", "漢字", "é", " ", "　", "<|endoftext|>", "12345", "\U0001f600", "...", "\r\n", "</s>", "ß", "\x00", "<0x41>"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize(("size", "fan"), [(crosstok.RANGE, 16), (40, 2), (97, 3)])
def test_ranges_of_long_texts(spark, size, fan):
    rng = random.Random(5)
    rows = [(i, odd(rng, rng.randint(1, 120))) for i in range(120)]
    rows += [(200, prose(3, 900)), (200, prose(3, 900)), (201, prose(4, 50) + " ▁ " + prose(5, 200)), (202, "x" * 3000 + " y"), (203, "no borders" + "\n" * 500), (None, prose(6, 300)), (204, None), (205, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(crosstok.align(docs, size=size, fan=fan)) == brute(rows)


def test_fragments_compose_in_any_order():
    rng = random.Random(7)
    aligner = crosstok.Aligner()
    for _ in range(60):
        text = odd(rng, rng.randint(20, 200)) + prose(rng.randint(1, 99), 30)
        parts = [crosstok.ranged(aligner, *r) for r in crosstok.ranges(text, rng.randint(3, 60))]
        fragments = [p[3] for p in parts]
        whole = crosstok.whole(aligner, text)
        assert sum((f for f in fragments), Fragment()).text() == whole[3] == crosstok.composed(fragments).text()
        while len(fragments) > 1:
            at = rng.randrange(len(fragments) - 1)
            fragments[at : at + 2] = [fragments[at] + fragments[at + 1]]
        assert fragments[0].text() == whole[3] and fragments[0].tail_a == fragments[0].tail_b == ""
        assert b"".join(p[2] for p in parts) == whole[2] and sum(p[0] for p in parts) == whole[0] and sum(p[1] for p in parts) == whole[1]


def test_a_text_without_borders_is_encoded_twice_at_most():
    for text in ("w" * 10_000, prose(2, 2000), "漢字" * 4000, "a" * 5000 + " b " + "c" * 5000):
        pieces = list(crosstok.ranges(text, 100))
        assert [p[0] for p in pieces[1:]] == [p[1] for p in pieces[:-1]] and pieces[-1][1] == len(text.encode()) + 1
        assert sum(len(p[3].encode()) for p in pieces) <= 3 * len(text.encode())


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(i, t) for i, t, _ in ROWS]
    assert got(crosstok.align(edge_docs)) == brute(rows)
    assert got(crosstok.align(edge_docs, size=1000)) == brute(rows)
    assert crosstok.align(no_docs).count() == 0

import random
import re

import pytest
import xxhash

from riskledger.llm import registry, simhash
from tests_llm_rows import ROWS


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, distance=3):
    """fingerprint -> set of all that can be reached, by brute force."""
    rest, out = set(values), {}
    while rest:
        todo, seen = [rest.pop()], set()
        while todo:
            x = todo.pop()
            seen.add(x)
            near = {y for y in rest if (x ^ y).bit_count() <= distance}
            rest -= near
            todo += near
        out.update(dict.fromkeys(seen, frozenset(seen)))
    return out


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    reach = classes(prints)
    ids = {c: [i for (i, _), p in zip(rows, prints, strict=True) if p in c and i is not None] for c in set(reach.values())}
    return sorted((str(i), p, min(ids[reach[p]], default=None)) for (i, _), p in zip(rows, prints, strict=True))


def found(frame):
    return sorted((str(r.id), r.fp % (1 << 64), r.component) for r in frame.collect())


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_query_against_all_pairs(spark, sf, bucket):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs, bucket=bucket)) == expected(rows)
    if bucket > 2:
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op4_simhash"](spark, sf).collect()}
        assert got == {int(i): (f"{p:016x}", c) for i, p, c in expected(rows)}


@pytest.mark.parametrize("bucket", [10_000, 3])
def test_links_of_close_fingerprints(spark, bucket):
    """Balls, chains and strays, with all bits in play, by walking and by the values in between."""
    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(12):
            values.add(x)
            y = x
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                y ^= 1 << b
            values.add(y)
            x = y if rng.random() < 0.5 else x
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), bucket=bucket)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links.collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in pairs)
    joined = {v: {v} for v in values}
    for a, b in pairs:
        if joined[a] is not joined[b]:
            joined[a] |= joined[b]
            for x in joined[b]:
                joined[x] = joined[a]
    assert {v: frozenset(s) for v, s in joined.items()} == classes(values)


def test_edge_rows(edge_docs, no_docs):
    got = found(simhash.near_duplicates(edge_docs))
    assert got == expected([(i, t) for i, t, _ in ROWS])
    assert simhash.near_duplicates(no_docs).count() == 0


def test_first_of_each_component_stays(edge_docs, no_docs):
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    prints = [fingerprint(t) for _, t, _ in ROWS]
    reach = classes(prints)
    want = {}
    for (i, t, _), p in zip(ROWS, prints, strict=True):
        want.setdefault(reach[p], []).append((i is not None, i or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == sorted(min(x) for x in want.values())
    assert simhash.keep_first(no_docs).count() == 0

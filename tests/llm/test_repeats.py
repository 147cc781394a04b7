import hashlib
import re

import pytest

from riskledger.llm import registry, repeats
from tests_llm_rows import ROWS

LAST = (1 << 63) - 1


def brute(rows, width):
    words = [(LAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            first[s] = min(first.get(s, i), i)
    out = []
    for (own, _), (i, w) in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((str(own), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in registry.QUERIES["op5_repeats"](spark, sf).collect())
    assert got == [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 50)]
    assert sum(m for _, _, m, _ in got) > 0


@pytest.mark.parametrize(("width", "home"), [(50, 1 << 20), (3, 500), (1, 100)])
def test_edge_rows(edge_docs, width, home):
    got = repeats.remove_repeats(edge_docs, width=width, home_bytes=home).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute([(i, t) for i, t, _ in ROWS], width)
    for r in got:  # intervals are maximal, apart and make up the count
        assert sum(s.last - s.first + 1 for s in r.spans) == r.n_removed
        assert all(a.last + 1 < b.first or a.last + 1 == b.first for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_nothing(no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0

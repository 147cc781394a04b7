"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from riskledger.llm import registry, variants
from tests_llm_rows import ROWS


def counts(rows):
    total = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def brute(rows):
    n = counts(rows)
    gaps = defaultdict(set)  # words by what is left without one place
    for w in n:
        for i in range(len(w)):
            gaps[w[:i] + "\0" + w[i + 1 :]].add(w)
        for i in range(len(w) + 1):
            gaps[w[:i] + "\1" + w[i:]].add(w)
            if i < len(w):
                gaps[w[:i] + "\1" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for key, same in gaps.items():
        for w in same:
            near[w] |= {x for x in same if x != w and (len(x) == len(w)) == ("\0" in key)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(rows)
    assert got(registry.QUERIES["op11_variants"](spark, sf)) == expected
    assert sum(x[1] is not None for x in expected) >= 10


def words_of(rng, n):
    """Words of few letters, so that signatures are shared by many, and their edits."""
    out = set()
    while len(out) < n:
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 10)))
        out.add(w)
        at = rng.randrange(len(w))
        out |= {w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdÿ") + w[at:], w[:at] + rng.choice("abcd") + w[at + 1 :]}
    return out


@pytest.mark.parametrize("group", [variants.GROUP, 30])
def test_large_groups_are_verified_in_blocks(spark, group):
    rng = random.Random(2)
    long_ = "z" * 70 + "abcdefg" * 3
    rows = [(i, " ".join([w] * rng.choice([2, 3, 40]))) for i, w in enumerate(sorted(words_of(rng, 1500)))]
    rows += [(5000 + i, f"{w} {w}") for i, w in enumerate([long_, long_[:40] + "q" + long_[41:], long_ + "x", long_[1:], "y" + long_[1:]])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(variants.variants(docs, group=group)) == brute(rows)


def test_chains_of_forms(spark):
    rows = [(None, f"{w} " * n) for w, n in [("abcdefgh", 2), ("abcdefg", 20), ("abcdefx", 200), ("abcdyfx", 2000), ("abcdyfz", 2000)]]
    expected = brute(rows)
    assert got(variants.variants(spark.createDataFrame(rows, "doc_id bigint, text string"), damage=0)) == {
        ("abcdefgh", "abcdefg", "abcdyfx", 2, 1, 20),
        ("abcdefg", "abcdefx", "abcdyfx", 20, 2, 200),
        ("abcdefx", "abcdyfx", "abcdyfx", 200, 2, 2000),
        ("abcdyfx", None, "abcdyfx", 2000, 2, None),
        ("abcdyfz", None, "abcdyfz", 2000, 1, None),
    }
    assert got(variants.variants(spark.createDataFrame(rows, "doc_id bigint, text string"))) == expected


def test_near_words_share_a_signature():
    rng = random.Random(6)
    for _ in range(3000):
        w = "".join(rng.choice("abcdé") for _ in range(rng.randint(7, 12)))
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        x = w[:at] + ("" if kind == 0 else rng.choice("abcdê")) + w[at + (kind < 2) :]
        if len(x) < 7 or x == w:
            continue
        a, b = variants.signatures([w.encode("latin-1"), x.encode("latin-1")])
        assert np.isin(a, b).any()
        assert variants.one_edit(w.encode("latin-1"), x.encode("latin-1")) >= 0


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(i, t) for i, t, _ in ROWS]
    out = variants.variants(edge_docs)
    assert got(out) == brute(rows) and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variants.variants(no_docs).count() == 0
    assert variants.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).count() == 0

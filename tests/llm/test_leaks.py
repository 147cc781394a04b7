import random

import numpy as np
import pytest

from riskledger.llm import leaks, registry
from tests_llm_rows import ROWS, prose


def nearest(pattern, text):
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for a in pattern:
        up, row[0] = row[0], row[0] + 1
        for j, b in enumerate(text, 1):
            up, row[j] = row[j], min(up + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "é", " "])
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_no_region_is_lost_and_none_invented(seed):
    rng = random.Random(seed)
    item = leaks.normalise(prose(seed, 60))[: rng.choice([33, 50, 80, 127, 128, 150, 260])]
    hidden = edited(rng, item, rng.randint(0, int(0.14 * len(item))))
    text = leaks.normalise(f"{prose(seed + 100, rng.choice([0, 3, 40]))} {hidden} {prose(seed + 200, rng.choice([0, 2, 30]))}")
    indexes = leaks.build([("item", item)])
    costs = [(nearest(w.tolist(), leaks.codes(text).tolist()), int(k)) for x in indexes for w, k in zip(x.windows, x.edits, strict=True)]
    found = leaks.search(["", text, "x" * 300], indexes)
    assert bool(found) == any(c <= k for c, k in costs)
    for row, name, first, end, edits in found:
        assert (row, name) == (1, "item") and edits == min(c for c, k in costs if c <= k) and 0 <= first < end <= len(text)


def test_texts_do_not_run_into_each_other():
    item = leaks.normalise(prose(1, 30))
    half = len(item) // 2
    assert leaks.search([item[:half], item[half:]], leaks.build([(1, item)])) == []


def test_many_candidates_are_looked_at_in_parts(monkeypatch):
    item = leaks.normalise(prose(1, 20))
    text = " ".join([item] * 400)
    monkeypatch.setattr(leaks, "SLICE", 5000)
    found = leaks.search([text, "none", text], leaks.build([(7, item)]))
    assert [(r[0], r[1], r[4]) for r in found] == [(0, 7, 0), (2, 7, 0)]


def test_query_finds_all_quoted_items(spark, sf):
    docs = {r.doc_id: leaks.normalise(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: leaks.normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in registry.QUERIES["op3_leaks"](spark, sf).collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert whole and whole <= set(got)
    for (d, i), r in got.items():
        windows = [w for x in leaks.build([(i, items[i])]) for w in x.windows]
        region = leaks.codes(docs[d][max(0, r.first - 30) : r.last + 31]).tolist()
        assert min(nearest(w.tolist(), region) for w in windows) == r.edits


def test_blocks_and_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, prose(2, 80), "x"), (2, None, "x"), (3, "short", "x"), (4, prose(1, 6000)[100:900], "x"), (4, prose(50, 50), "x"), (None, prose(5, 20), "x")], "item_id int, text string, id string")
    want = sorted([(1, 1), (2, 1), (3, 1), (None, 1), (7, 4), (8, 4), (2, None)], key=str)
    for size in (leaks.BLOCK, 1):
        assert len(list(leaks.blocks(items, "item_id", "text", size))) == (1 if size > 1 else 5)
        got = leaks.matches(edge_docs, items, block=size)
        assert sorted(((r.id, r.item) for r in got.collect()), key=str) == want
        clean = leaks.drop_leaks(edge_docs, items, block=size)
        assert clean.columns == edge_docs.columns
        dirty = {i for i, _ in want if i is not None}
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, t, _ in ROWS if i not in dirty and not (i is None and t == prose(2, 80)))
    assert leaks.matches(no_docs, items).count() == 0 and leaks.drop_leaks(no_docs, items).count() == 0
    assert leaks.matches(edge_docs, items.where("false")).count() == 0 and leaks.drop_leaks(edge_docs, items.where("false")).count() == len(ROWS)


def test_alignment_of_a_batch():
    rng = np.random.default_rng(0)
    patterns = [rng.integers(1, 4, n).astype(np.uint64) for n in (20, 33, 20)]
    regions = [np.concatenate([p[:9], p[10:]]) for p in patterns]
    cost, at = leaks.banded(patterns, np.array([2, 3, 2]), regions, np.array([-1, -1, -1]))
    assert cost.tolist() == [1, 1, 1] and at.tolist() == [19, 32, 19]


@pytest.mark.parametrize("length", [93, 100, 130, 170])
def test_quoted_parts_are_found_wherever_they_begin(length):
    item = leaks.normalise(prose(11, 90))
    indexes = leaks.build([("item", item)])
    starts = range(0, len(item) - length + 1, 3)
    texts = [f"{prose(300 + s, 12)} {item[s : s + length]} {prose(600 + s, 12)}" for s in starts]
    assert [row for row, *_ in sorted(leaks.search(texts, indexes))] == list(range(len(starts)))


def test_short_items_are_found_between_word_borders():
    indexes = leaks.build([(1, "Naïve  answer"), (2, "7"), (3, "Naïve answer"), (4, ""), (5, "(ok)")])
    texts = ["A naïve\nanswer.", "xnaïve answer", "naïve answers", "it is 7, or 77", "77", "n7", "x(ok)y", "", "naïve", "answer"]
    assert sorted(leaks.search(texts, indexes)) == [(0, 1, 2, 14, 0), (0, 3, 2, 14, 0), (3, 2, 6, 7, 0), (6, 5, 1, 5, 0)]

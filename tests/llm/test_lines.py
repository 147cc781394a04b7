import random
from collections import defaultdict

import pytest

from riskledger.llm import lines, registry
from tests_llm_rows import ROWS, prose


def brute_patience(a, b):
    """The recursive definition, with the longest chain by dynamic programming."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in brute_patience(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return [*brute_patience(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    anchors = [(a.index(x), j) for j, x in enumerate(b) if x and a.count(x) == 1 and b.count(x) == 1]
    chains = []

    def rank(c):  # of equally long chains the one that ends first
        return len(c), -c[-1][0]

    for i, j in anchors:
        chains.append(max((c for c in chains if c[-1][0] < i), key=rank, default=[]) + [(i, j)])
    chain = max(chains, key=rank, default=[])
    if not chain:
        return []
    out = list(chain)
    for (i1, j1), (i2, j2) in zip([(-1, -1), *chain], [*chain, (len(a), len(b))], strict=True):
        out += [(i + i1 + 1, j + j1 + 1) for i, j in brute_patience(a[i1 + 1 : i2], b[j1 + 1 : j2])]
    return sorted(out)


def test_patience():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:], strict=False))
        assert len(got) == len(brute_patience(a, b))


def brute(rows, rare, least):
    """(id, text) -> kept text, when no line is too frequent to be rare."""
    keys = sorted({(i is not None, i or 0, t or "", t) for i, t in rows}, key=lambda k: k[:3])
    split = {k: [x.strip() for x in k[2].split("\n")] for k in keys}
    docs = defaultdict(list)
    for k in keys:
        for x in set(split[k]) - {""}:
            docs[x].append(k)
    assert all(len(d) <= rare for d in docs.values())
    gone = defaultdict(set)
    for a, b in {(d[0], k) for d in docs.values() for k in d[1:]}:
        block = []
        for pair in [*brute_patience(split[a], split[b]), (-9, -9)]:
            if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
                if sum(len(split[b][j]) for _, j in block) >= least:
                    gone[b] |= {j for _, j in block}
                block = []
            block.append(pair)
    return {(k[1] if k[0] else None, k[3]): None if k[3] is None else "\n".join(x for j, x in enumerate(k[2].split("\n")) if j not in gone[k]) for k in keys}


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 10**9, lines.LEAST)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.text for r in lines.remove_lines(docs).collect()}
    assert got == {i: want[i, t] for i, t in rows} and sum(got[i] != t for i, t in rows) > 10
    assert registry.QUERIES["op7_lines"](spark, sf).count() == len(rows)


def test_edge_rows(edge_docs, no_docs):
    rows = [(i, t) for i, t, _ in ROWS]
    want = brute(rows, 10**9, lines.LEAST)
    got = lines.remove_lines(edge_docs, counts=False)
    assert got.columns == edge_docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(want[i, t])) for i, t in rows)
    assert lines.remove_lines(no_docs).count() == 0


@pytest.mark.parametrize("rare", [1, 2, 5])
def test_frequent_lines_stay_once(spark, rare):
    common, other = prose(1, 12), prose(2, 12)
    texts = [f"{prose(100 + i, 10)}\n{common}\n{prose(300 + i, 10)}" + f"\n{other}" * (i % 3 == 0) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text.split("\n") for r in lines.remove_lines(docs, rare=rare).collect()}
    for i, text in enumerate(texts):
        assert got[i] == [x for x in text.split("\n") if i == 0 or x not in (common, other)]


def test_short_blocks_stay(spark):
    docs = spark.createDataFrame([(1, "yes\nalpha"), (2, "yes\nbeta"), (3, "no\nyes\n\nmaybe so\ngamma"), (4, "no\nyes\n\nmaybe so\ndelta")], "doc_id int, text string")
    assert {r.doc_id: r.text for r in lines.remove_lines(docs, least=10).collect()} == {1: "yes\nalpha", 2: "yes\nbeta", 3: "no\nyes\n\nmaybe so\ngamma", 4: "delta"}


def every_pair(rows, least):
    """id -> places deleted when each document is aligned with all earlier ones."""
    split = [(i, [x.strip() for x in t.split("\n")]) for i, t in sorted(rows)]
    gone = {i: set() for i, _ in split}
    for k, (i, b) in enumerate(split):
        for _, a in split[:k]:
            if set(a) & set(b) - {""}:
                gone[i] |= set(lines.common_lines([hash(x) if x else 0 for x in a], [hash(x) if x else 0 for x in b], [len(x) for x in b], least))
    return gone


def test_runs_cover_every_block():
    rng = random.Random(2)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 5, 9, 30]) for _ in range(rng.randint(0, 12))]
        got = lines.run_places(sizes, 12)
        assert all(sum(sizes[a : b + 1]) >= 12 for a, b in got)
        for a in range(len(sizes)):
            for b in range(a, len(sizes)):
                if sum(sizes[a : b + 1]) >= 12:
                    assert {j for x, y in got if a <= x and y <= b for j in range(x, y + 1)} == set(range(a, b + 1))


def test_query_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = every_pair(rows, lines.LEAST)
    got = {r.doc_id: r.n_removed_lines for r in registry.QUERIES["op7_lines"](spark, sf).collect()}
    assert got == {i: len(x) for i, x in want.items()}


@pytest.mark.parametrize("rare", [500, 3])
def test_blocks_that_the_earliest_holder_does_not_align(spark, rare):
    rng = random.Random(8)
    short, long = [f"short {i}" for i in range(6)], [prose(40 + i, 9) for i in range(5)]
    texts = ["\n".join([x, prose(100 + i, 8)]) for i, x in enumerate(short)]  # each short line has another first document
    texts += ["\n".join([f"{a} {b}"] + short) for a, b in (("one", "text"), ("other", "words"))]
    texts += ["\n".join([long[0], "between", long[0], long[1], "more", long[2]]), "\n".join([long[2], "x", long[1], "y", long[0]])]
    texts += ["\n".join(rng.sample(long + short, rng.randint(2, 8)) + [f"own line {i}"] + rng.choices(long, k=2)) for i in range(30)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    want = every_pair(rows, lines.LEAST)
    got = {r.doc_id: r.text for r in lines.remove_lines(docs, rare=rare, whole=True).collect()}
    assert got == {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i]) for i, t in rows}


def test_whole_on_edge_rows(edge_docs, no_docs):
    assert sorted(str(r.doc_id) for r in lines.remove_lines(edge_docs, whole=True).collect()) == sorted(str(i) for i, _, _ in ROWS)
    assert lines.remove_lines(no_docs, whole=True).count() == 0


def test_no_frame_goes_through_the_driver(spark, monkeypatch):
    """Small frames too are joined by merge: a stored frame of many alike rows looks small at any size."""
    plans = []
    kept = lines.checkpointed
    monkeypatch.setattr(lines, "checkpointed", lambda df: plans.append(df) or kept(df))
    aligned = lines._aligned
    monkeypatch.setattr(lines, "_aligned", lambda *a: (plans.append(aligned(*a)), plans[-1])[1])
    rows = [(i, f"a line that all of them share, with characters\nown line {i} of some length\nanother line in pair {i // 2} of these") for i in range(12)]
    plans.append(lines.remove_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), rare=4, whole=True))
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert not any("Broadcast" in t for t in texts) and sum("SortMergeJoin" in t for t in texts) == 3
    assert plans[-1].agg({"n_removed_lines": "sum"}).first()[0] == 11 + 6

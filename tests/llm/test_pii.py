"""Personal data against plain Python, and what the trees add."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from riskledger.llm import pii, registry
from tests_llm_rows import ROWS, prose

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(kind, m.start(), m.end()) for kind, p in PATTERNS for m in re.finditer(p, text or "", re.A) if passes(kind, m.group())]


def brute(rows):
    """id, counts, digest of the base spans."""
    out = []
    for own, text in rows:
        found = base(text)
        counts = [sum(k == kind for k, _, _ in found) for kind, _ in PATTERNS]
        out.append((own, *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    return sorted(out, key=repr)


def spans(df):
    """id, base, added with kinds by name."""
    return {(r.id, tuple((pii.KINDS[k], a, b) for k, a, b in r.base), tuple((pii.KINDS[k], a, b) for k, a, b in r.added)) for r in df.collect()}


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = registry.QUERIES["op13_pii"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out), key=repr) == brute(rows)
    by_id = {i: set(base(t)) for i, t in rows}
    for r in out:
        own = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)}
        assert by_id[r.doc_id] <= own


def noisy(rng, n):
    parts = ["1", "22", "333", "4444", ".", ".", " ", "-", "+", "@", "a", "Bc", "_x", "%", "(", ")", "é", "漢", "\n", "10.0.0.1", "4111111111111111", "me@x.org", "+1 (555) 010-4477", "255", "256"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_base_spans_of_noise(spark):
    rng = random.Random(8)
    rows = [(i, noisy(rng, rng.randint(1, 60))) for i in range(1500)]
    rows += [(2000, "9" * 20_000), (2001, "1.2." * 5000), (2002, "a" * 50_000 + "@"), (2003, "+1" + " " * 20_000), (2004, "x@y.z%w@v.u " * 700), (2005, "a." * 20_000 + "@b" + ".c" * 20_000)]
    df = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    got = {r.id: [(pii.KINDS[k], a, b) for k, a, b in r.base] for r in df.collect()}
    for own, text in rows:
        assert got[own] == base(text), text[:200]


def made(rng, kind):
    if kind == 0:
        return f"{rng.choice(['ann', 'bob', 'li'])}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.org"
    if kind == 1:
        return ".".join(str(rng.randint(10, 255)) for _ in range(4))
    if kind == 2:
        while not luhn(x := "".join(rng.choice("0123456789") for _ in range(16))):
            pass
        return x
    return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"


def test_added_spans_are_what_the_base_misses(spark):
    rng = random.Random(4)
    rows, hidden, decoys = [], {}, set()
    for i in range(1200):
        words = prose(i, 60).split()
        for kind in range(4):
            words.insert(rng.randrange(len(words)), made(rng, kind))
        words.insert(rng.randrange(len(words)), rng.choice(["version 3.0.1", "in 1987", "page 12-14", "999.1.1.1", "1234567890123456"]))
        rows.append((i, " ".join(words)))
    for i in range(1200, 1260):  # data that a greedy base match swallows and drops
        card, phone, ip = made(rng, 2), made(rng, 3), made(rng, 1)
        before = prose(i, 10) + " "
        kind, text = rng.choice([("card", f"{card} 12 345"), ("phone", f"{phone} {ip}")])
        if not any(k == kind for k, _, _ in base(before + text)):
            hidden[i] = (kind, len(before), len(before) + len(card if kind == "card" else phone))
        rows.append((i, before + text + " " + prose(i + 1, 10)))
    for i in range(1260, 1400):
        rows.append((i, f"{prose(i, 30)} version {i}.0 of 300.{i}.2.1 and 99{i}88{i}77{i} at {prose(i + 5, 30)}"))
        decoys.add(i)
    found = spans(pii.find(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)))
    added = {i: set(a) for i, _, a in found}
    assert len(hidden) > 30 and sum(h in added[i] for i, h in hidden.items()) >= 0.9 * len(hidden)
    clean = [i for i in decoys if not base(dict(rows)[i])]
    assert len(clean) > 100 and sum(bool(added[i]) for i in clean) <= 0.02 * len(clean)


def test_thresholds_and_trees(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    for name, step in (("found", pii.proposals), ("labelled", pii._labelled)):
        step(rows).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
    model, limits = pii.fit(rows, str(tmp_path))
    assert limits and all(0.5 <= t < 1 for t in limits.values()) and set(limits) <= set(range(4))
    assert model.getNumTrees == pii.TREES


def test_redaction(spark):
    rows = [(1, "mail me@x.org or +1 (555) 010-4477, card 4111111111111111 from 10.0.0.1."), (2, None), (3, "nothing 12")]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {1: "mail [email] or [phone], card [card] from [ip].", 2: None, 3: "nothing 12"}


def test_no_python_in_the_plan(spark, sf):
    plan = registry.QUERIES["op13_pii"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("text", [None, "", "no data at all"])
def test_texts_without_data(spark, text):
    out = pii.find(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")).collect()
    assert len(out) == 3 and all(r.base == [] and r.added == [] for r in out)


def test_edge_rows(edge_docs, no_docs):
    rows = [(i, t) for i, t, _ in ROWS]
    got = sorted(((r.id, [(pii.KINDS[k], a, b) for k, a, b in r.base]) for r in pii.find(edge_docs).collect()), key=repr)
    assert got == sorted(((i, base(t)) for i, t in rows), key=repr)
    assert pii.find(no_docs).count() == 0


def test_every_distinct_example_is_fitted(spark, tmp_path):
    # 30,000 examples of a label, more than the fit once drew, and the label follows the size
    rows = spark.range(60_000).withColumn("label", (F.col("id") % 2).cast("double"))
    for c in pii.FEATURES:
        rows = rows.withColumn(c, F.lit(0.0))
    rows = rows.withColumns({"mark": F.xxhash64("id"), "size": F.col("label") * 10 + F.col("id") % 4, "hidden": F.lit(False)})
    model, limits = pii.fit(rows, str(tmp_path))
    seen = spark.read.parquet(f"{tmp_path}/examples")
    assert seen.agg(F.sum("weight")).first()[0] == 60_000 and seen.count() <= 16
    assert limits == {0: 0.5} and model.getNumTrees == pii.TREES

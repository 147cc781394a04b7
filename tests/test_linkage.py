import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from riskledger import views as v
from riskledger.functions import match_scores as ms
from riskledger.functions import text as tx
from riskledger.operators import linkage


def test_candidates_equal_brute_force(spark, sf):
    inbox = v.inbox(spark, sf).orderBy("inbox_id").limit(60)
    pay = v.payment(spark, sf).orderBy("transaction_id").limit(60)
    got = {(r.inbox_id, r.transaction_id) for r in linkage.candidates(inbox, pay, limit=1000).collect()}
    want = set()
    for i, p in product(inbox.collect(), pay.collect()):
        days = (p.date - i.date).days
        if i.team_id != p.team_id or not -90 <= days <= (123 if i.type == "invoice" else 30):
            continue
        a, b = abs(float(i.amount)), abs(float(p.amount))
        close = i.currency == p.currency and abs(a - b) < max(1, a * 0.25)
        base = abs(abs(float(p.base_amount)) - float(i.base_amount)) < max(50, float(i.base_amount) * 0.15)
        if close or base or tx._best_run(p.name, i.display_name) > 0.3:
            want.add((i.inbox_id, p.transaction_id))
    assert got == want and want


def test_reverse_candidates_equal_brute_force(spark, sf):
    from riskledger.plans.q_linkage import _waiting

    inbox = _waiting(spark, sf).orderBy("inbox_id").limit(80)
    pay = v.payment(spark, sf).orderBy("transaction_id").limit(50)
    got = {(r.transaction_id, r.inbox_id) for r in linkage.reverse_candidates(pay, inbox, limit=1000).collect()}
    want = set()
    for i, p in product(inbox.collect(), pay.collect()):
        days = (i.date - p.date).days
        if i.team_id != p.team_id or i.status == "done" or i.attached_to or not -(123 if i.type == "invoice" else 90) <= days <= 30:
            continue
        a, b = abs(float(i.amount)), abs(float(p.amount))
        close = i.currency == p.currency and abs(a - b) < max(1, b * 0.25)
        base = abs(abs(float(i.base_amount)) - abs(float(p.base_amount))) < max(50, abs(float(p.base_amount)) * 0.15)
        if close or base or tx._best_run(i.display_name, p.name) > 0.3:
            want.add((p.transaction_id, i.inbox_id))
    assert got == want and want


def test_reverse_candidates_rank_by_name_amount_and_date(spark, sf):
    from riskledger.plans.q_linkage import _waiting

    rows = linkage.reverse_candidates(v.payment(spark, sf).limit(40), _waiting(spark, sf), limit=3).collect()
    assert rows and max(r.rank for r in rows) <= 3
    by = {(r.transaction_id, r["rank"]): r.name_similarity for r in rows}
    assert all(by[t, k] <= by[t, k - 1] for t, k in by if k > 1)


def test_large_stored_frames_are_not_broadcast(spark, sf, monkeypatch):
    """By row count, since many rows may lie in few bytes; the rows stay the same."""
    from riskledger.plans.q_linkage import _waiting

    inbox, pay = _waiting(spark, sf).orderBy("inbox_id").limit(80), v.payment(spark, sf).orderBy("transaction_id").limit(50)
    found = {}
    for many in (0, 10**6):
        plans, kept = [], linkage.stored
        with monkeypatch.context() as m:
            m.setattr(linkage, "MANY", many)
            m.setattr(linkage, "stored", lambda df, name, plans=plans, kept=kept: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or kept(df, name))
            rows = linkage.reverse_candidates(pay, inbox, limit=3)
            found[many] = {(r.transaction_id, r.inbox_id, r["rank"]) for r in rows.collect()}
        best = [p for name, p in plans if name == "best"]
        assert best and all(("Broadcast" in p) == (many > 0) for p in best)
    assert found[0] == found[10**6] and found[0]


def test_similar_names_lose_nothing(spark):
    words = ["alpha beta", "alfa betta gmbh", "gamma", "delta alpha", "beta", "omega corp", "alphabet", "co-op market"]
    df = spark.createDataFrame([(1, w) for w in words], "team_id int, name string")
    got = {(r.needle, r.text) for r in linkage.similar_names(df, df).collect()}
    assert got == {(a, b) for a in words for b in words if tx._best_run(a, b) > 0.3}


@pytest.mark.parametrize("limit", [3, 12, 500])
def test_best_candidates_equal_brute_force_by_levels(spark, sf, limit):
    """Names of many likenesses: some items are done on a high level, some on a low one, some have too few similar names."""
    words = F.array(*[F.lit(x) for x in ("", " shop", " of the north", " 0001", "zz top")])
    other = F.when(F.col("_k") % 7 == 0, F.lit(None)).when(F.col("_k") % 5 == 4, F.lit("quite something else"))
    inbox = v.inbox(spark, sf).orderBy("inbox_id").limit(70).withColumn("_k", F.col("inbox_id").cast("long"))
    inbox = inbox.withColumn("display_name", F.when(F.col("_k") % 7 > 0, F.coalesce(other, F.concat(F.col("display_name"), F.element_at(words, (F.col("_k") % 5 + 1).cast("int")))))).drop("_k")
    pay = v.payment(spark, sf).orderBy("transaction_id").limit(90)
    rows = linkage.candidates(inbox, pay, limit=limit).collect()
    got = {(r.inbox_id, r["rank"]): (r.transaction_id, r.name_similarity) for r in rows}
    want = {}
    for i in inbox.collect():
        a, found = float(i.amount), []
        for p in pay.collect():
            days, b = (p.date - i.date).days, abs(float(p.amount))
            if i.team_id != p.team_id or not -90 <= days <= (123 if i.type == "invoice" else 30):
                continue
            near = (i.currency == p.currency and abs(a - b) < max(1, a * 0.25)) or abs(abs(float(p.base_amount)) - float(i.base_amount)) < max(50, float(i.base_amount) * 0.15)
            if near or tx._best_run(p.name, i.display_name) > 0.3:
                found.append((-round(tx._best_run(i.display_name, p.name), 6), abs(b - a) / max(1.0, a), abs(days), p.transaction_id))
        want |= {(i.inbox_id, k + 1): (f[3], -f[0]) for k, f in enumerate(sorted(found)[:limit])}
    assert got == want and want


@pytest.mark.parametrize(
    "days,kind,score",
    [(30, "invoice", 0.98), (60, "invoice", 0.96), (90, "invoice", 0.94), (15, "invoice", 0.95), (2, "invoice", 0.99), (-5, "invoice", 0.85), (-1, "expense", 0.99), (-5, "expense", 0.95), (0, "expense", 0.85), (45, "expense", 0.1)],
)
def test_date_score(spark, days, kind, score):
    d = F.lit("2024-03-01").cast("date")
    assert spark.range(1).select(ms.date_score(d, F.date_add(d, days), F.lit(kind))).first()[0] == score


def test_assignment_is_greedy_by_score(spark):
    pairs = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.1), ("c", "y", 0.7), ("c", "z", 0.7)]
    df = spark.createDataFrame(pairs, "l string, r string, s double")
    got = {(x.l, x.r) for x in linkage.assign_one_to_one(df, "l", "r", "s").collect()}
    assert got == {("a", "x"), ("c", "y")} | set() or got == {("a", "x"), ("c", "y")}


def test_word_similarity_is_asymmetric():
    assert tx._best_run("shop", "the shop online") == 1.0
    assert tx._best_run("the shop online", "shop") < 0.5


def test_best_run_over_equals_best_run():
    """Also where trigrams repeat. Names with the same places of shared trigrams share one search."""
    rng = random.Random(3)

    def name():
        return " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))

    for _ in range(2000):
        a, b = name(), name()
        best = tx._best_run(a, b)
        assert [tx._best_run_over(a, b, x) for x in (0.0, 0.3, 0.6)] == [best if best > x else 0.0 for x in (0.0, 0.3, 0.6)]
    before = tx._best_at.cache_info().misses
    tx._best_run_over("customer 17", "customer 18", 0.3)
    tx._best_run_over("customer 25", "customer 26", 0.3)
    assert tx._best_at.cache_info().misses <= before + 1


def test_names_are_cut_into_tokens_once(spark, sf):
    """Not once more for every pair and every mention of a score: no filter or join holds the work on names."""
    from riskledger.plans.q_linkage import _true_pairs

    best = linkage.best_matches(linkage.score_pairs(_true_pairs(spark, sf)), 0.6)
    plan = best._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut = [x for x in plan if "regexp_replace" in x]
    assert len(cut) == 2 and not any("confidence" in x or "Filter" in x or "Join" in x for x in cut)


def test_scores_of_pairs_without_a_name(spark, sf):
    from riskledger.plans.q_linkage import _true_pairs

    pairs = _true_pairs(spark, sf).limit(4).withColumn("display_name", F.lit(None).cast("string"))
    both = pairs.unionByName(_true_pairs(spark, sf).limit(4).withColumn("t_name", F.lit(None).cast("string")))
    rows = linkage.score_pairs(both).collect()
    assert len(rows) == 8 and {r.name_score for r in rows} == {0.0}


def test_first_level_follows_the_pairs_of_names(spark, sf, monkeypatch):
    """A level is skipped if the next one is cheap as well; whatever the first level, the rows are the same."""
    names = spark.range(30).selectExpr("1 team_id", "concat('customer ', id) name")
    assert linkage._levels_from(names, names, 0) == linkage.LEVELS
    assert linkage._levels_from(names, names, 1_000_000) == (linkage.NAME_THRESHOLD,)
    assert linkage._levels_from(names.limit(0), names, 10) == (linkage.NAME_THRESHOLD,)
    inbox, pay = v.inbox(spark, sf).orderBy("inbox_id").limit(70), v.payment(spark, sf).orderBy("transaction_id").limit(90)
    got = []
    for most in (0, 1_000_000):
        monkeypatch.setattr(linkage, "PAIRS", most)
        got.append({(r.inbox_id, r["rank"], r.transaction_id, r.name_similarity) for r in linkage.candidates(inbox, pay, limit=5).collect()})
    assert got[0] == got[1] and got[0]

import re

import pytest
from pyspark.sql import functions as F

from riskledger.operators import explain, graph, models


def test_path_of_three_nodes(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "source string, target string, community_id int")
    deg = {r.source: r.line_degree for r in explain.line_graph_degree(e).collect()}
    assert deg == {"a": 1.0, "b": 1.0}
    bet = {(r.u, r.v): r.betweenness for r in explain.edge_betweenness(e).collect()}
    assert bet == {("a", "b"): pytest.approx(2 / 3), ("b", "c"): pytest.approx(2 / 3)}


def test_betweenness_counts_all_shortest_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
    e = spark.createDataFrame([(s, t, 7) for s, t in edges], "source string, target string, community_id int")
    assert {round(r.betweenness, 6) for r in explain.edge_betweenness(e).collect()} == {round(2 / 6, 6)}


def test_hit_rate(spark):
    rows = [("a", "b", 1, 1.0, 0.9), ("c", "b", 1, 0.2, 0.1)]
    e = spark.createDataFrame(rows, "source string, target string, community_id int, human_importance double, edge_weight double")
    assert explain.hit_rate(e, (1,)).first().hit_rate == 1.0


@pytest.fixture(scope="module")
def star(spark):
    rows = [(f"tx:{i:03d}", "card:hot", i, 0, "transaction", "card", "uses_card", 1) for i in range(200)]
    rows += [(f"tx:{i:03d}", f"merchant:{i % 9}", i, 0, "transaction", "merchant", "paid_merchant", 1) for i in range(200)]
    return spark.createDataFrame(rows, "src string, dst string, ts long, src_label int, src_type string, dst_type string, edge_type string, seed int")


@pytest.mark.parametrize("method", ["uniform", "dw", "dw1-ntw0"])
def test_sampling_respects_width_and_never_revisits(spark, star, method):
    roots = star.select(F.col("src").alias("node")).distinct()
    s = graph.sample_context(roots, star, 4, 2, method)
    assert s.groupBy("root", "node").count().filter("count > 1").count() == 0
    assert s.filter("node = root").count() == 0
    per = s.filter("hop = 2").groupBy("root").count().agg(F.max("count")).first()[0]
    assert per <= 2 * 4
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, graph.sample_context(roots, star, 4, 2, method).collect()))


def test_every_root_draws_for_itself(spark):
    hub = spark.range(3000).select(F.lit("hub").alias("node"), F.format_string("n%04d", "id").alias("nbr"), F.lit(1.0).alias("w"), F.lit(3000).cast("long").alias("degree"))
    roots = spark.range(400).select(F.col("id").cast("string").alias("root"), F.lit("hub").alias("node"))
    out = graph.draw(roots, graph.lots(hub, 6), 6, 1, 1)
    assert {r["count"] for r in out.distinct().groupBy("root").count().collect()} == {6}
    seen = out.select("nbr").distinct().count()
    assert 1500 < seen < 1800  # 3000 * (1 - exp(-2400 / 3000)) = 1652


def test_a_draw_is_shuffled_as_four_numbers(spark):
    hub = spark.range(50).select(F.lit("hub").alias("node"), F.format_string("n%04d", "id").alias("nbr"), F.lit(1.0).alias("w"), F.lit(50).cast("long").alias("degree"))
    state = spark.createDataFrame([(1, "r", "hub", [])], "pair long, root string, node string, taken array<struct<pos: bigint, nbr: string>>")
    out = graph._draw_round(state, graph.lots(hub, 6), 6, 1, 1, 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Project \[pair#\d+L, j#\d+, \(\(.* AS pos#\d+L, .* AS y#\d+\]", plan)
    row = out.first()
    assert row.pair == 1 and len(row.taken) == 6 and len({t.pos for t in row.taken}) == 6


def test_draws_follow_the_weights_without_replacement(spark):
    from itertools import permutations

    weights = {"a": 1.0, "b": 2.0, "c": 3.0, "d": 10.0}
    chance = dict.fromkeys(weights, 0.0)
    for x, y in permutations(weights, 2):
        p = weights[x] / 16 * weights[y] / (16 - weights[x])
        chance[x] += p
        chance[y] += p
    nbrs = spark.createDataFrame([("n", k, w, 4) for k, w in weights.items()], "node string, nbr string, w double, degree long")
    roots = spark.range(6000).select(F.col("id").cast("string").alias("root"), F.lit("n").alias("node"))
    got = {r.nbr: r["count"] / 6000 for r in graph.draw(roots, graph.lots(nbrs, 2), 2, 1, 1).groupBy("nbr").count().collect()}
    assert all(abs(got[k] - chance[k]) < 0.025 for k in weights), (got, chance)


def test_one_heavy_neighbour_does_not_hold_up_the_rest(spark):
    rows = [("n", "heavy", 1e9, 9)] + [("n", f"l{i}", 1.0, 9) for i in range(8)] + [("m", "x", 1.0, 2), ("m", "y", 5.0, 2)]
    nbrs = spark.createDataFrame(rows, "node string, nbr string, w double, degree long")
    roots = spark.createDataFrame([(str(i), n) for i in range(50) for n in ("n", "m", "none")], "root string, node string")
    out = graph.draw(roots, graph.lots(nbrs, 6), 6, 1, 1).collect()
    assert sum(r.nbr == "heavy" for r in out) == 50 and sum(r.node == "n" for r in out) == 300 and sum(r.node == "m" for r in out) == 100
    assert len(set(out)) == len(out)


def test_budget_sample(spark, star):
    seeds = spark.createDataFrame([("tx:001",), ("tx:002",)], "node string")
    out = graph.sample_budget(seeds, star, 100, 5, 2).collect()
    assert {r.node for r in out if r.layer == 1} <= {"card:hot", "merchant:1", "merchant:2"}
    late = [r.node for r in out if r.layer == 2 and r.node.startswith("tx:") and int(r.node[3:]) > 100]
    assert late == [] and len([r for r in out if r.layer == 2]) <= 5


def test_metrics_on_perfect_ranks(spark):
    df = spark.createDataFrame([(i, int(i >= 6), i / 10) for i in range(10)], "node int, label int, probability double")
    m = models.binary_metrics(df).first()
    assert m.auc == 1.0 and m.average_precision == 1.0


def test_isolation_forest_ranks_outliers_high(spark):
    import random

    rnd = random.Random(3)
    rows = [(f"{i:04d}", rnd.gauss(50, 5), rnd.gauss(1, 0.1)) for i in range(600)] + [("x1", 500.0, 9.0), ("x2", 0.5, 7.0)]
    df = spark.createDataFrame(rows, "transaction_id string, amount double, amount_ratio_to_card_median double")
    out = models.isolation_consensus(df, "transaction_id", trees=40)
    assert all(r.model_consensus_score > 0.9 for r in out.filter(F.col("transaction_id").startswith("x")).collect())

"""Edge importance, centrality and top-k hit rate per community."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import round_half_up
from ..session import checkpointed

COMMUNITY = "community_id"
PAIR = ["u", "v"]


def canonical(e: DataFrame) -> DataFrame:
    """Add the undirected form (u, v) of every edge."""
    return e.withColumn("u", F.least("source", "target")).withColumn("v", F.greatest("source", "target"))


def node_importance(annotations: DataFrame) -> DataFrame:
    """Mean of the given annotations per node; 0 when there is none."""
    return annotations.groupBy(COMMUNITY, "node").agg(F.coalesce(F.avg("importance"), F.lit(0.0)).alias("importance"))


def edge_importance(e: DataFrame, importance: DataFrame, how: str = "avg") -> DataFrame:
    """Importance of an edge from its two nodes: min, avg or sum."""
    a = importance.select(COMMUNITY, F.col("node").alias("source"), F.col("importance").alias("_a"))
    b = importance.select(COMMUNITY, F.col("node").alias("target"), F.col("importance").alias("_b"))
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    value = {"min": F.least(x, y), "avg": (x + y) / 2, "sum": x + y}[how]
    return e.join(a, [COMMUNITY, "source"], "left").join(b, [COMMUNITY, "target"], "left").withColumn("human_importance", value).drop("_a", "_b")


def undirected_weight(e: DataFrame, weight: str) -> DataFrame:
    """One line per undirected edge with the larger of its two directions' weights."""
    return canonical(e).groupBy(COMMUNITY, *PAIR).agg(F.max(weight).alias(weight))


def combine_weight(explainer: Column, centrality: Column, w: Column | float) -> Column:
    return (1 - w) * explainer + w * centrality


def line_graph_degree(e: DataFrame) -> DataFrame:
    """Degree centrality of each edge in the line graph of its community."""
    ends = e.select(COMMUNITY, F.col("source").alias("n")).union(e.select(COMMUNITY, "target"))
    deg = ends.groupBy(COMMUNITY, "n").agg(F.count("*").alias("d"))
    size = e.groupBy(COMMUNITY).agg(F.greatest(F.lit(1), F.count("*") - 1).alias("_m"))
    a = deg.select(COMMUNITY, F.col("n").alias("source"), F.col("d").alias("_a"))
    b = deg.select(COMMUNITY, F.col("n").alias("target"), F.col("d").alias("_b"))
    out = e.join(a, [COMMUNITY, "source"]).join(b, [COMMUNITY, "target"]).join(size, COMMUNITY)
    return out.withColumn("line_degree", (F.col("_a") + F.col("_b") - 2) / F.col("_m")).drop("_a", "_b", "_m")


def edge_betweenness(e: DataFrame) -> DataFrame:
    """Normalised edge betweenness, all (community, source) searches side by side.

    Breadth-first levels are joins of the frontier (community, source, node, paths)
    with the adjacency; dependencies flow back level by level. No community is ever
    held in one task, and every level is checkpointed.
    """
    und = canonical(e).select(COMMUNITY, *PAIR).distinct().filter(F.col("u") != F.col("v"))
    adj = checkpointed(und.select(COMMUNITY, F.col("u").alias("node"), F.col("v").alias("nbr")).union(und.select(COMMUNITY, "v", "u")))
    key = [COMMUNITY, "s", "node"]
    start = adj.select(COMMUNITY, F.col("node").alias("s"), "node").distinct().withColumn("sigma", F.lit(1.0))
    levels = [checkpointed(start)]
    seen = levels[0].select(*key)
    while True:  # a level is at most one step from the last, so it ends with the longest shortest path
        reached = levels[-1].join(adj, [COMMUNITY, "node"]).select(COMMUNITY, "s", F.col("nbr").alias("node"), "sigma")
        nxt = checkpointed(reached.join(seen, key, "left_anti").groupBy(*key).agg(F.sum("sigma").alias("sigma")))
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select(*key))
    flows = []
    delta = levels[-1].select(*key, F.lit(0.0).alias("delta"))
    for depth in range(len(levels) - 1, 0, -1):
        lower = levels[depth].join(delta, key, "left").na.fill(0.0, ["delta"])
        upper = levels[depth - 1].select(COMMUNITY, "s", F.col("node").alias("nbr"), F.col("sigma").alias("_up"))
        flow = checkpointed(
            lower.join(adj, [COMMUNITY, "node"])
            .join(upper, [COMMUNITY, "s", "nbr"])
            .select(COMMUNITY, "s", "node", "nbr", (F.col("_up") / F.col("sigma") * (1 + F.col("delta"))).alias("flow"))
        )
        flows.append(flow)
        delta = flow.groupBy(COMMUNITY, "s", F.col("nbr").alias("node")).agg(F.sum("flow").alias("delta"))
    n = adj.select(COMMUNITY, "node").distinct().groupBy(COMMUNITY).agg(F.count("*").alias("_n"))
    total = flows[0]
    for f in flows[1:]:
        total = total.unionByName(f)
    per = total.groupBy(COMMUNITY, F.least("node", "nbr").alias("u"), F.greatest("node", "nbr").alias("v")).agg(F.sum("flow").alias("_f"))
    value = F.col("_f") / 2 * 2.0 / (F.col("_n") * (F.col("_n") - 1.0))
    return per.join(n, COMMUNITY).select(COMMUNITY, *PAIR, round_half_up(value, 9).alias("betweenness"))


def _rates(weighted: DataFrame, runs: list[str], ks: tuple[int, ...], weight: str) -> DataFrame:
    """(runs, community, k, rate): share of the k heaviest edges that are among the most important ones.

    If more than k edges tie at the top importance, each counts k / m, its chance to be among k drawn
    from the m of them, which is the mean over all draws. All runs (weightings) go through one plan.
    """
    best = weighted.groupBy(*runs, COMMUNITY).agg(F.max("human_importance").alias("_best"))
    e = canonical(weighted).join(best, [*runs, COMMUNITY]).withColumn("_top", F.col("human_importance") == F.col("_best")).drop("_best")
    m = e.filter("_top").groupBy(*runs, COMMUNITY).agg(F.countDistinct(*PAIR).alias("_m"))
    top_pairs = e.filter("_top").select(*runs, COMMUNITY, *PAIR).distinct().withColumn("_is", F.lit(1))
    order = Window.partitionBy(*runs, COMMUNITY).orderBy(F.desc(weight), "source", "target")
    heavy = e.withColumn("_rk", F.row_number().over(order)).filter(F.col("_rk") <= max(ks)).join(m, [*runs, COMMUNITY]).join(top_pairs, [*runs, COMMUNITY, *PAIR], "left")
    at_k = heavy.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("_rk") <= F.col("k"))
    share = F.when(F.col("_m") <= F.col("k"), F.lit(1.0)).otherwise(F.when(F.col("_is") == 1, F.col("k") / F.col("_m")).otherwise(0.0))
    return at_k.groupBy(*runs, COMMUNITY, "k").agg((F.sum(share.cast("decimal(28,14)")).cast("double") / F.first("k")).alias("rate"))


def _mean_rate(rates: DataFrame, runs: list[str]) -> DataFrame:
    return rates.groupBy(*runs, "k").agg(round_half_up(F.avg(F.col("rate").cast("decimal(28,14)")).cast("double"), 6).alias("hit_rate"), F.count("*").alias("communities"))


def hit_rate(weighted: DataFrame, ks=(5, 10, 15, 20, 25), weight: str = "edge_weight") -> DataFrame:
    """k, hit_rate, communities: mean over the communities of the expected share of hits."""
    return _mean_rate(_rates(weighted, [], tuple(ks), weight), [])


def random_baseline(weighted: DataFrame, runs: int = 10, ks=(5, 10, 15, 20, 25)) -> DataFrame:
    """Hit rate of hash-random weights over ``runs`` seeds, all in one plan, and its gap to the given weights."""
    random = weighted.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    digest = F.md5(F.concat_ws("|", "run", COMMUNITY, "source", "target"))
    random = random.withColumn("edge_weight", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52)))
    base = _mean_rate(_rates(random, ["run"], tuple(ks), "edge_weight"), ["run"]).groupBy("k").agg(round_half_up(F.avg(F.col("hit_rate").cast("decimal(18,6)")).cast("double"), 6).alias("random_rate"))
    return hit_rate(weighted, ks).join(base, "k").withColumn("gain", round_half_up(F.col("hit_rate") - F.col("random_rate"), 6))


def hybrid_search(train: DataFrame, grid=tuple(i / 10 for i in range(11)), k: int = 5) -> DataFrame:
    """Hit rate at ``k`` for every blend weight of explainer and centrality, all in one plan, best first."""
    blended = train.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in grid])))
    blended = blended.withColumn("edge_weight", combine_weight(F.col("explainer"), F.col("centrality"), F.col("w")))
    return _mean_rate(_rates(blended, ["w"], (k,), "edge_weight"), ["w"]).select("w", "hit_rate").orderBy(F.desc("hit_rate"), "w")


def ridge_weights(train: DataFrame, reg: float = 1.0) -> DataFrame:
    """Ridge fit of human importance on (explainer, centrality); one row of coefficients."""
    data = VectorAssembler(inputCols=["explainer", "centrality"], outputCol="features").transform(train)
    model = LinearRegression(labelCol="human_importance", regParam=reg, elasticNetParam=0.0).fit(data)
    a, b = (float(c) for c in model.coefficients)
    return train.sparkSession.range(1).select(F.lit(a).alias("explainer"), F.lit(b).alias("centrality"), F.lit(float(model.intercept)).alias("intercept"))


def kappa(ratings: DataFrame) -> DataFrame:
    """Cohen's kappa of every annotator pair and its mean (``item, annotator, label``).

    Item labels are pivoted to confusion counts per annotator pair, so only
    annotators squared times labels squared lines are kept.
    """
    a = ratings.select("item", F.col("annotator").alias("a"), F.col("label").alias("la"))
    b = ratings.select("item", F.col("annotator").alias("b"), F.col("label").alias("lb"))
    # ratings exploded from a small table are estimated as small as that table, so a broadcast is ruled out by name
    cells = a.join(b.hint("merge"), "item").filter(F.col("a") < F.col("b")).groupBy("a", "b", "la", "lb").agg(F.count("*").alias("n"))
    pair = Window.partitionBy("a", "b")
    total = F.sum("n").over(pair)
    row = F.sum("n").over(Window.partitionBy("a", "b", "la"))
    cells = cells.withColumn("_n", total).withColumn("_r", row)
    col = cells.groupBy("a", "b", F.col("lb").alias("la")).agg(F.sum("n").alias("_c"))
    rows = cells.groupBy("a", "b", "la").agg(F.first("_r").alias("_r"), F.first("_n").alias("_n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("_agree"))
    s = rows.join(col, ["a", "b", "la"], "left").groupBy("a", "b").agg(
        F.sum("_agree").alias("_agree"), F.first("_n").alias("_n"), F.sum(F.col("_r") * F.coalesce("_c", F.lit(0))).alias("_e")
    )
    po, pe = F.col("_agree") / F.col("_n"), F.col("_e") / (F.col("_n") * F.col("_n"))
    out = s.select("a", "b", F.when(pe == 1, 1.0).otherwise(round_half_up((po - pe) / (1 - pe), 6)).alias("kappa"))
    return out.withColumn("mean_kappa", round_half_up(F.avg("kappa").over(Window.partitionBy()), 6))


def ks_and_correlation(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """Largest gap of the two empirical distributions, and Pearson correlation; one row."""
    long = df.select(F.round(a, digits).alias("x"), F.lit(1).alias("na"), F.lit(0).alias("nb")).union(df.select(F.round(b, digits), F.lit(0), F.lit(1)))
    per = long.groupBy("x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    # running counts inside ranges of x, and over the ranges before: no task sees all values
    ranged = checkpointed(per.repartitionByRange("x").withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.sum("na").alias("_a"), F.sum("nb").alias("_b"))
    before, tot = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sizes = sizes.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_a", "_b")], *[F.sum(c).over(tot).alias(f"{c}n") for c in ("_a", "_b")])
    w = Window.partitionBy("_range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select("_range", F.sum("na").over(w).alias("_ia"), F.sum("nb").over(w).alias("_ib"))
    gap = F.abs((F.col("_ia") + F.col("_a0")) / F.col("_an") - (F.col("_ib") + F.col("_b0")) / F.col("_bn"))
    ks = inside.join(F.broadcast(sizes), "_range").agg(round_half_up(F.max(gap), 6).alias("ks"))  # one row per range
    return ks.join(F.broadcast(df.agg(round_half_up(F.corr(a, b), 6).alias("pearson"))))  # one row each

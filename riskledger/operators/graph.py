"""Transaction - entity graph: edges, encoding, sampling and context features."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cols import num
from ..session import checkpointed, scratch, stored
from .ranks import global_position

RELATION = {
    "card": "uses_card",
    "merchant": "paid_merchant",
    "category_country_cluster": "in_category_country_cluster",
    "device": "used_device",
    "ip": "used_ip",
}
FEATURES = 14


def edges(labeled: DataFrame, prediction: bool = False) -> DataFrame:
    """Edge rows (src, dst, ts, src_label, src_type, dst_type, edge_type, seed)."""

    def e(kind, prefix, ident):
        return F.struct(F.lit(kind).alias("t"), F.concat(F.lit(prefix + ":"), ident).alias("n"))

    ends = F.array_compact(
        F.array(
            e("card", "card", F.col("card_id")),
            e("merchant", "merchant", F.col("merchant_name")),
            e("category_country_cluster", "cluster", F.concat_ws("|", "merchant_category", "merchant_country")),
            F.when(F.col("device_id") != "", e("device", "device", F.col("device_id"))),
            F.when(F.col("ip_address") != "", e("ip", "ip", F.col("ip_address"))),
        )
    )
    relation = None
    for k, r in RELATION.items():
        relation = F.when(F.col("e.t") == k, r) if relation is None else relation.when(F.col("e.t") == k, r)
    seed = F.lit(1) if prediction else F.when(F.col("pseudo_label") >= 0, 1).otherwise(0)
    return labeled.withColumn("e", F.explode(ends)).select(
        F.concat(F.lit("tx:"), "transaction_id").alias("src"),
        F.col("e.n").alias("dst"),
        F.floor(F.col("us") / 1_000_000).cast("long").alias("ts"),
        F.greatest(F.lit(0), F.col("pseudo_label")).cast("long").alias("src_label"),
        F.lit("transaction").alias("src_type"),
        F.col("e.t").alias("dst_type"),
        relation.alias("edge_type"),
        seed.cast("long").alias("seed"),
    )


def with_edge_defaults(raw: DataFrame) -> DataFrame:
    """Edges read from a file: missing seed counts as 1, missing edge type as 'default'."""
    out = raw
    if "seed" not in out.columns:
        out = out.withColumn("seed", F.lit(1).cast("long"))
    if "edge_type" not in out.columns:
        out = out.withColumn("edge_type", F.lit("default"))
    return out


def nodes(e: DataFrame) -> DataFrame:
    """Distinct nodes with their type."""
    return e.select(F.col("src").alias("node"), F.col("src_type").alias("type")).union(e.select("dst", "dst_type")).distinct()


def with_reverse(e: DataFrame) -> DataFrame:
    """Edges in both directions, the second one of type ``rev_<type>``."""
    back = e.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "ts", F.lit(0).cast("long").alias("src_label"),
        F.col("dst_type").alias("src_type"), F.col("src_type").alias("dst_type"),
        F.concat(F.lit("rev_"), "edge_type").alias("edge_type"), F.lit(0).cast("long").alias("seed"),
    )
    return e.unionByName(back)


def stats(e: DataFrame) -> DataFrame:
    """Nodes, undirected edges, edge types and seeds of the graph, one row."""
    pair = F.struct(F.least("src", "dst"), F.greatest("src", "dst"))
    n = nodes(e).agg(F.count("*").alias("nodes"))
    m = e.select(pair.alias("p"), "edge_type").distinct().agg(F.count("*").alias("edges"))
    t = e.agg(F.countDistinct("edge_type").alias("edge_types"))
    s = e.filter(F.col("seed") == 1).select("src").distinct().agg(F.count("*").alias("seeds"))
    one = n.join(F.broadcast(m)).join(F.broadcast(t)).join(F.broadcast(s))  # one row each
    return one.withColumn("feature_dim", F.lit(FEATURES).cast("long"))


def type_codes(e: DataFrame) -> DataFrame:
    """Sorted edge-type codes over both directions; ``_self`` is 0 (a handful of types)."""
    kinds = with_reverse(e).select("edge_type").distinct()
    return kinds.select("edge_type", F.row_number().over(Window.orderBy("edge_type")).cast("long").alias("code")).union(
        e.sparkSession.range(1).select(F.lit("_self"), F.lit(0).cast("long"))
    )


def node_codes(e: DataFrame) -> DataFrame:
    """Every node with its position in node order and its inverse-frequency type weight."""
    n = nodes(e)
    freq = n.groupBy("type").agg(F.count("*").alias("_n"))
    weighted = n.join(F.broadcast(freq), "type").withColumn("type_weight", 1.0 / F.col("_n")).drop("_n")  # one row per type
    return global_position(weighted, [F.col("node").asc()], "code")


def seeds_at(e: DataFrame, timestamps: DataFrame) -> DataFrame:
    """Seed nodes whose timestamp is among the given ones."""
    return e.filter(F.col("seed") == 1).join(timestamps.select("ts"), "ts", "left_semi").select("src").distinct()


def _uniform(*key) -> Column:
    """Deterministic number in (0, 1): 52 bits of the MD5 of the key columns."""
    digest = F.md5(F.concat_ws("|", *[k if isinstance(k, Column) else F.col(k) for k in key]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def neighbors(e: DataFrame, method: str = "uniform") -> DataFrame:
    """node, nbr, w, degree: distinct undirected neighbours with their sampling weight."""
    und = e.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.col("dst_type").alias("t")).union(
        e.select("dst", "src", "src_type")
    ).distinct()
    und = stored(und, "neighbors")
    degree = und.groupBy("node").agg(F.count("*").alias("degree"))
    if method.startswith("dw"):
        und = und.join(degree.select(F.col("node").alias("nbr"), F.col("degree").cast("double").alias("_deg")), "nbr")
        tw = nodes(e).groupBy(F.col("type").alias("t")).agg((1.0 / F.count("*")).alias("_tw"))
        und = und.join(F.broadcast(tw), "t")  # one row per node type
        w = {"dw1-ntw0": F.col("_deg"), "dw0-ntw1": F.col("_tw")}.get(method, F.col("_deg") * F.col("_tw"))
        und = und.withColumn("w", w)
    else:
        und = und.withColumn("w", F.lit(1.0))
    return und.join(degree, "node").select("node", "nbr", "w", "degree")


class Lots(NamedTuple):
    """Neighbours of every node laid out for draws; see ``lots``."""

    few: DataFrame
    slots: DataFrame
    bands: DataFrame


def lots(nbrs: DataFrame, width: int) -> Lots:
    """Neighbours (node, nbr, w, degree) laid out so that a draw is one look-up by a number.

    ``few``: the neighbours of nodes that have at most ``width``; they are always taken. Of the other nodes, a band
    holds the neighbours whose weights share their power of two. ``slots``: pos, nbr, w, one after the other by node,
    band and nbr. ``bands``: node and its bands with count, greatest weight and the pos of the first neighbour. Positions are
    global, so a hub's neighbours lie in many tasks.
    """
    band = F.floor(F.log("w") / F.log(F.lit(2.0))).cast("int")
    many = nbrs.where(F.col("degree") > width).select("node", band.alias("band"), "nbr", "w")
    placed = stored(global_position(many, [F.col("node").asc(), F.col("band").asc(), F.col("nbr").asc()], "pos"), "slots")
    sizes = placed.groupBy("node", "band").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.max("w").alias("top"))
    bands = sizes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("band", "n", "top", "first"))).alias("bands"))
    return Lots(nbrs.where(F.col("degree") <= width).select("node", "nbr"), placed.select("pos", "nbr", "w"), stored(bands, "bands"))


def _part(digest: Column, start: int, n: int) -> Column:
    """Number in (0, 1) from ``n`` hexadecimal digits."""
    return (F.conv(F.substring(digest, start, n), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**n))


def _draw_round(state: DataFrame, table: Lots, width: int, seed: int, hop: int, turn: int) -> DataFrame:
    """``taken`` of every (root, node), longer by what ``2 * width`` draws from the neighbours not taken yet bring.

    A draw is shuffled as four numbers (id of the pair, number of the draw, position, height), a hit as three and the neighbour;
    names, bands and what is taken stay with the pair.
    """

    def inside(t, b):
        return (t["pos"] >= b["first"]) & (t["pos"] < b["first"] + b["n"])

    def mass(acc, b):
        n = b["n"] - F.size(F.filter("taken", lambda t: inside(t, b)))
        hi = F.coalesce(F.try_element_at(acc, F.lit(-1))["hi"], F.lit(0.0)) + n * b["top"]
        return F.concat(acc, F.array(F.struct(b["first"].alias("first"), b["n"].alias("all"), n.alias("n"), b["top"].alias("top"), hi.alias("hi"))))

    def keep(acc, x):
        again = F.exists(acc, lambda t: t["pos"] == x["pos"])
        one = F.struct(x["pos"].alias("pos"), x["nbr"].alias("nbr"))
        return F.when((F.size(acc) >= width) | again, acc).otherwise(F.concat(acc, F.array(one)))

    empty = F.array().cast("array<struct<first:bigint,all:bigint,n:bigint,top:double,hi:double>>")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit(hop), F.lit(turn), "j", "root", "node"))
    drawn = (
        state.join(table.bands, "node")
        .withColumn("left", F.aggregate("bands", empty, mass))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))))
        .withColumn("h", digest)
        .withColumn("x", _part(F.col("h"), 1, 10) * F.element_at("left", -1)["hi"])
        .withColumn("b", F.element_at(F.filter("left", lambda b: b["hi"] > F.col("x")), 1))
        .withColumn("k", F.floor(_part(F.col("h"), 11, 13) * F.col("b.n")))
        .withColumn("ranks", F.array_sort(F.transform(F.filter("taken", lambda t: (t["pos"] >= F.col("b.first")) & (t["pos"] < F.col("b.first") + F.col("b.all"))), lambda t: t["pos"] - F.col("b.first"))))
        # the k-th rank that is not taken
        .withColumn("pos", F.col("b.first") + F.col("k") + F.size(F.filter("ranks", lambda t, i: t - i <= F.col("k"))))
        .select("pair", "j", "pos", (_part(F.col("h"), 24, 9) * F.col("b.top")).alias("y"))
    )
    hits = drawn.join(table.slots, "pos").where(F.col("y") < F.col("w")).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("j", "pos", "nbr"))).alias("hits"))
    taken = F.when(F.col("hits").isNull(), F.col("taken")).otherwise(F.aggregate("hits", F.col("taken"), keep))
    return state.join(hits, "pair", "left").select("pair", "root", "node", taken.alias("taken"))


def draw(frontier: DataFrame, table: Lots, width: int, seed: int, hop: int) -> DataFrame:
    """``width`` distinct neighbours, or all if there are fewer, for each (root, node) of the frontier.

    Every (root, node) draws for itself, one neighbour after the other with a chance proportional to the weight
    among those not taken yet: a band by count times greatest weight, a rank in it, and the neighbour
    stands with the chance weight / greatest weight, at least one half. A draw is a look-up of one position, so
    a node's neighbours are never listed per root, and a hub's draws go to as many tasks as it has
    ranks. A round holds ``2 * width`` draws; a neighbour met again in the round is passed over, and pairs still short of ``width``
    go into another round; that a round brings a pair nothing has a chance of at most one in 4 ** ``width``.
    """
    out = [frontier.join(table.few, "node").select("root", "node", "nbr")]
    none = F.array().cast("array<struct<pos:bigint,nbr:string>>")
    # dealt anew: a pair is few bytes but 2 * width draws of work
    pairs = frontier.join(table.bands.select("node"), "node", "left_semi").repartition(int(frontier.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root", "node")
    state = stored(pairs.select(F.monotonically_increasing_id().alias("pair"), "root", "node", none.alias("taken")), "draws")
    turn = 0
    while not state.isEmpty():
        state = stored(_draw_round(state, table, width, seed, hop, turn), "draws")
        full = F.size("taken") >= width
        out.append(state.where(full).select("root", "node", F.explode("taken.nbr").alias("nbr")))
        state = state.where(~full)
        turn += 1
    return reduce(lambda a, b: a.unionByName(b), out)


def sample_context(roots: DataFrame, e: DataFrame, width: int = 6, depth: int = 2, method: str = "uniform", seed: int = 2020) -> DataFrame:
    """(root, node, hop): sampled neighbourhood of each root, each node once."""
    table = lots(stored(neighbors(e, method), "weighted"), width)
    frontier = stored(roots.select(F.col("node").alias("root"), "node"), "frontier")
    seen = frontier
    out = []
    for hop in range(1, depth + 1):
        found = draw(frontier, table, width, seed, hop).select("root", F.col("nbr").alias("node")).distinct()
        frontier = stored(found.join(seen, ["root", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
        out.append(frontier.withColumn("hop", F.lit(hop)))
    return reduce(lambda a, b: a.unionByName(b), out)


def sample_budget(seeds: DataFrame, e: DataFrame, ts_max: int, width: int = 6, depth: int = 2, seed: int = 2020) -> DataFrame:
    """Type-aware budget sampling for one seed set: (node, layer).

    Every frontier node offers up to ``width`` uniform neighbours per edge type; a
    neighbour's budget is the sum of 1/degree over its offers, and ``width`` nodes
    per layer are kept with probability proportional to the squared budget. Nodes
    later than ``ts_max`` are never offered.
    """
    both = with_reverse(e)
    node_ts = e.groupBy(F.col("src").alias("nbr")).agg(F.min("ts").alias("_ts"))
    # one line per (edge type, node): the draw then works per type
    typed = stored(both.select(F.concat_ws("\x01", "edge_type", "src").alias("node"), F.col("dst").alias("nbr")).distinct(), "typed")
    degree = stored(typed.groupBy("node").agg(F.count("*").alias("degree")), "degree")
    table = lots(typed.join(degree, "node").select("node", "nbr", F.lit(1.0).alias("w"), "degree"), width)
    kinds = both.select("edge_type").distinct()
    frontier = seeds.select("node").distinct()
    picked = frontier.withColumn("layer", F.lit(0))
    for layer in range(1, depth + 1):
        keyed = frontier.join(F.broadcast(kinds)).select(  # a handful of edge types
            F.lit("all").alias("root"), F.concat_ws("\x01", "edge_type", "node").alias("node")
        )
        offers = draw(keyed, table, width, seed, layer).join(degree, "node")
        budget = offers.groupBy("nbr").agg(F.sum(1.0 / F.col("degree")).alias("_w"))
        budget = budget.join(node_ts, "nbr", "left").filter(F.coalesce("_ts", F.lit(ts_max)) <= ts_max)
        fresh = budget.join(picked.select(F.col("node").alias("nbr")), "nbr", "left_anti")
        key = -F.log(_uniform(F.lit(seed), F.lit(layer), "nbr")) / (F.col("_w") * F.col("_w"))
        frontier = checkpointed(fresh.orderBy(key, "nbr").limit(width).select(F.col("nbr").alias("node")))
        picked = picked.unionByName(frontier.withColumn("layer", F.lit(layer)))
    return picked


def feature_columns(labeled: DataFrame, high_risk: tuple[str, ...]) -> DataFrame:
    """(node, f0..f13) of every transaction."""

    def flag(c):
        return F.when(F.coalesce(F.col(c), F.lit(False)), 1.0).otherwise(0.0)

    def capped(c, by, top=5.0):
        return F.least(num(c) / by, F.lit(top))

    consensus = num("model_consensus_score") if "model_consensus_score" in labeled.columns else F.lit(0.0)
    f = [
        capped("amount", 1000.0),
        capped("amount_ratio_to_card_median", 10.0),
        F.least(F.abs(num("robust_z_log_amount")) / 8.0, F.lit(5.0)),
        capped("card_tx_count_60m", 10.0),
        capped("merchant_unique_cards_60m", 10.0),
        num("merchant_burst_score"),
        capped("device_unique_cards_total", 8.0),
        capped("ip_unique_cards_total", 8.0),
        consensus,
        F.when(F.col("merchant_category").isin(*high_risk), 1.0).otherwise(0.0),
        flag("country_mismatch"),
        flag("shared_device_with_other_cards"),
        flag("shared_ip_with_other_cards"),
        capped("categorical_surprisal_raw", 4.0),
    ]
    return labeled.select(F.concat(F.lit("tx:"), "transaction_id").alias("node"), *[c.alias(f"f{i}") for i, c in enumerate(f)])


def entity_features(e: DataFrame, tx_features: DataFrame) -> DataFrame:
    """Mean transaction vector of every entity node."""
    cols = [f"f{i}" for i in range(FEATURES)]
    joined = e.select("src", F.col("dst").alias("entity")).join(tx_features, F.col("src") == F.col("node")).drop("node")
    return joined.groupBy(F.col("entity").alias("node")).agg(*[F.avg(c).alias(c) for c in cols])


def context_vectors(roots: DataFrame, e: DataFrame, feats: DataFrame, width=6, depth=2, method="uniform", seed=2020) -> DataFrame:
    """Own features, mean of the sampled context, log degree, log context size, type scale."""
    cols = [f"f{i}" for i in range(FEATURES)]
    ctx = sample_context(roots, e, width, depth, method, seed)
    # dealt by root before the means: a partial sum per row would be twice as wide as the row
    met = ctx.select("root", "node").join(feats, "node", "left").drop("node").repartition("root")
    mean = met.groupBy("root").agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"c{i}") for i, c in enumerate(cols)])
    deg = e.select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_deg"))
    types = nodes(e).select("type").distinct().withColumn("_code", F.row_number().over(Window.orderBy("type")) - 1)
    scale = types.crossJoin(F.broadcast(types.agg(F.greatest(F.lit(1), F.max("_code")).alias("_max")))).select(  # a handful of types
        "type", (F.col("_code") / F.col("_max")).alias("type_scale")
    )
    base = roots.join(feats, "node").join(nodes(e), "node").join(F.broadcast(scale), "type")
    out = base.join(mean.withColumnRenamed("root", "node"), "node", "left").join(deg, "node", "left")
    out = out.na.fill(0.0, [f"c{i}" for i in range(FEATURES)]).na.fill(0, ["_n", "_deg"])
    return out.select(
        "node",
        *cols,
        *[f"c{i}" for i in range(FEATURES)],
        F.log(F.col("_deg") + 1.0).alias("log_degree"),
        F.log(F.col("_n") + 1.0).alias("log_context"),
        "type_scale",
    )


# ---- feature store


class FeatureStore:
    """Feature vectors by node in bucketed tables, one per version.

    A version is whole: the one before it with the new vectors put in. Both lie in the same buckets, so
    neither putting nor reading shuffles what is stored. ``buckets`` is the number of shuffle partitions
    unless it is named; it stays the same for all versions. The files go with the application.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.path, self.version = spark, scratch(spark, name), 0
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _table(self, version: int) -> str:
        return f"{self.name}_v{version}"

    def read(self, version: int | None = None) -> DataFrame:
        """All vectors of a version, the newest unless it is named."""
        return self.spark.table(self._table(version or self.version))

    def keys(self) -> DataFrame:
        return self.read().select("node")

    def put(self, feats: DataFrame) -> int:
        """A new version with ``feats`` (node and value columns) in it; returns its number.

        A vector takes the place of the node's earlier one. Of several vectors of a node in ``feats`` the greatest
        stays, rows without a node are left out.
        """
        values = [c for c in feats.columns if c != "node"]
        fresh = feats.where("node IS NOT NULL").groupBy("node").agg(F.max(F.struct(*values)).alias("v")).select("node", "v.*")
        if self.version:
            old = self.read()
            # one shuffle, of the new vectors alone; the joined partitions are the buckets
            both = old.join(fresh.withColumn("_new", F.lit(True)).select("node", "_new", F.struct(*values).alias("_v")), "node", "full")
            fresh = both.select("node", *[F.when(F.col("_new"), F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) for c in values])
        else:
            fresh = fresh.repartition(self.buckets, "node")
        fresh.write.bucketBy(self.buckets, "node").sortBy("node").option("path", f"{self.path}/{self.version + 1}").saveAsTable(self._table(self.version + 1))
        self.version += 1
        return self.version


def get_features(store: DataFrame, wanted: DataFrame, default: float = -1.0) -> DataFrame:
    """Vectors of the wanted nodes; a node or value that is missing reads as ``default``."""
    value_cols = [c for c in store.columns if c != "node"]
    return wanted.select("node").distinct().join(store, "node", "left").na.fill(default, value_cols)

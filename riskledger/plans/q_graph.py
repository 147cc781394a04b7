"""Graph, models and explanation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..functions.cols import round_half_up
from ..operators import explain, graph, models, ranks, scoring
from ..session import checkpointed
from .q_reports import rnd
from .q_risk import PARAMS
from .q_scoring import _RISKY, labeled
from .registry import query
from .views_sql import view

view(
    "v_gedges",
    "v_labeled",
    """SELECT 'tx:' || l.transaction_id AS src, CASE entity_type WHEN 'category_country_cluster' THEN 'cluster' ELSE entity_type END || ':' || entity_id AS dst, l.us // 1000000 AS ts, greatest(0, pseudo_label) AS src_label,
  'transaction' AS src_type, entity_type AS dst_type, CASE entity_type WHEN 'card' THEN 'uses_card' WHEN 'merchant' THEN 'paid_merchant' WHEN 'device' THEN 'used_device' WHEN 'ip' THEN 'used_ip' ELSE 'in_category_country_cluster' END AS edge_type,
  CASE WHEN pseudo_label >= 0 THEN 1 ELSE 0 END AS seed FROM v_labeled l JOIN (SELECT transaction_id, 'card' AS entity_type, card_id AS entity_id FROM v_txn UNION ALL SELECT transaction_id, 'merchant', merchant_name FROM v_txn
  UNION ALL SELECT transaction_id, 'category_country_cluster', merchant_category || '|' || merchant_country FROM v_txn UNION ALL SELECT transaction_id, 'device', device_id FROM v_txn WHERE device_id <> ''
  UNION ALL SELECT transaction_id, 'ip', ip_address FROM v_txn WHERE ip_address <> '') e USING (transaction_id)""",
)


def _edges(spark, sf, prediction=False):
    return graph.edges(labeled(spark, sf), prediction)


@query("graph_edges", "GRF-01 SRC-07", "SELECT * FROM v_gedges", "v_gedges")
def graph_edges(spark, sf):
    return graph.with_edge_defaults(_edges(spark, sf))


@query(
    "graph_stats",
    "GRF-02",
    """SELECT (SELECT count(*) FROM (SELECT src FROM v_gedges UNION SELECT dst FROM v_gedges)) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst, edge_type FROM v_gedges)) AS edges,
    (SELECT count(DISTINCT edge_type) FROM v_gedges) AS edge_types, (SELECT count(DISTINCT src) FROM v_gedges WHERE seed = 1) AS seeds, 14 AS feature_dim""",
    "v_gedges",
)
def graph_stats(spark, sf):
    return graph.stats(_edges(spark, sf))


@query(
    "graph_node_codes",
    "GRF-03 SET-02",
    """SELECT node, type, row_number() OVER (ORDER BY node) - 1 AS code, round(1.0::DOUBLE / count(*) OVER (PARTITION BY type), 9) AS type_weight FROM (SELECT src AS node, src_type AS type FROM v_gedges UNION SELECT dst, dst_type FROM v_gedges)""",
    "v_gedges",
)
def graph_node_codes(spark, sf):
    return graph.node_codes(_edges(spark, sf)).withColumn("type_weight", F.round("type_weight", 9))


@query(
    "graph_type_codes",
    "GRF-03",
    "SELECT '_self' AS edge_type, 0 AS code UNION ALL SELECT edge_type, row_number() OVER (ORDER BY edge_type) FROM (SELECT DISTINCT edge_type FROM v_gedges UNION SELECT DISTINCT 'rev_' || edge_type FROM v_gedges)",
    "v_gedges",
)
def graph_type_codes(spark, sf):
    return graph.type_codes(_edges(spark, sf))


@query(
    "graph_seeds_at",
    "GRF-04",
    "SELECT DISTINCT src FROM v_gedges WHERE seed = 1 AND ts IN (SELECT us // 1000000 FROM v_txn WHERE merchant_category = 'click')",
    "v_gedges v_txn",
)
def graph_seeds_at(spark, sf):
    ts = v.txn(spark, sf).filter(F.col("merchant_category") == "click").select(F.floor(F.col("us") / 1_000_000).cast("long").alias("ts"))
    return graph.seeds_at(_edges(spark, sf), ts)


_FEAT = """SELECT 'tx:' || transaction_id AS node, least(amount::DOUBLE / 1000, 5) AS f0, least(amount_ratio_to_card_median / 10, 5) AS f1, least(abs(robust_z_log_amount) / 8, 5) AS f2, least(card_tx_count_60m::DOUBLE / 10, 5) AS f3,
  least(merchant_unique_cards_60m::DOUBLE / 10, 5) AS f4, merchant_burst_score AS f5, least(device_unique_cards_total::DOUBLE / 8, 5) AS f6, least(ip_unique_cards_total::DOUBLE / 8, 5) AS f7, CASE WHEN country_mismatch THEN 1 ELSE 0 END AS f10,
  CASE WHEN shared_device_with_other_cards THEN 1 ELSE 0 END AS f11, least(categorical_surprisal_raw / 4, 5) AS f13 FROM v_feat"""
_FC = ("f0", "f1", "f2", "f3", "f4", "f5", "f6", "f7", "f10", "f11", "f13")


@query(
    "graph_entity_features",
    "AGG-47",
    f"SELECT dst AS node, {', '.join(f'{rnd(f"avg({c})", 6)} AS {c}' for c in _FC)} FROM v_gedges JOIN ({_FEAT}) ON src = node GROUP BY dst",
    "v_gedges v_feat",
)
def graph_entity_features(spark, sf):
    e = _edges(spark, sf)
    feats = graph.feature_columns(labeled(spark, sf), PARAMS.high_risk)
    store = graph.entity_features(e, feats)
    got = graph.get_features(store, e.select(F.col("dst").alias("node")))
    return got.select("node", *[round_half_up(F.col(c), 6).alias(c) for c in _FC])


@query(
    "feature_store_round_trip",
    "SRC-08",
    f"""SELECT dst AS node, {', '.join(f'{rnd(f"avg({c})", 6)} AS {c}' for c in _FC)} FROM v_gedges JOIN ({_FEAT}) ON src = node GROUP BY dst
    UNION ALL SELECT DISTINCT src, {', '.join(['0'] * len(_FC))} FROM v_gedges UNION ALL SELECT DISTINCT 'gone:' || dst, {', '.join(['-1'] * len(_FC))} FROM v_gedges""",
    "v_gedges v_feat",
)
def feature_store_round_trip(spark, sf):
    """Zero vectors of all nodes, then those of the entities put over them, read back with nodes that were never put."""
    e = _edges(spark, sf)
    entities = graph.entity_features(e, graph.feature_columns(labeled(spark, sf), PARAMS.high_risk))
    cols = [c for c in entities.columns if c != "node"]
    store = graph.FeatureStore(spark, "features")
    store.put(graph.nodes(e).select("node", *[F.lit(0.0).alias(c) for c in cols]))
    store.put(entities)
    wanted = store.keys().union(e.select(F.concat(F.lit("gone:"), "dst")))
    return graph.get_features(store.read(), wanted).select("node", *[round_half_up(F.col(c), 6).alias(c) for c in _FC])


def _roots(spark, sf):
    return labeled(spark, sf).filter(F.col("pseudo_label") >= 0).select(F.concat(F.lit("tx:"), "transaction_id").alias("node"))


view("v_und", "v_gedges", "SELECT src AS node, dst AS nbr, dst_type AS t FROM v_gedges UNION SELECT dst, src, src_type FROM v_gedges")
view("v_degree", "v_und", "SELECT node, count(*) AS degree FROM v_und GROUP BY 1")
view("v_groot", "v_labeled", "SELECT 'tx:' || transaction_id AS root FROM v_labeled WHERE pseudo_label >= 0")
_HEX = "(('0x' || substr(md5({key}), 1, {n}))::BIGINT)"
_WEIGHT = {"uniform": "1.0", "dw": "e.degree * y.tw", "dw0-ntw1": "y.tw", "dw1-ntw0": "e.degree"}


_TURNS = 6


def _lots(method, width, und="v_und"):
    """SQL tables few (node, nbr), slots (node, band, rank, nbr, w) and bands (node, band, n, top)."""
    extra = "" if method == "uniform" else " JOIN v_degree e ON e.node = u.nbr JOIN (SELECT type, 1.0::DOUBLE / count(*) AS tw FROM (SELECT src AS node, src_type AS type FROM v_gedges UNION SELECT dst, dst_type FROM v_gedges) GROUP BY 1) y ON y.type = u.t"
    return f"""weighted AS MATERIALIZED (SELECT u.node, u.nbr, ({_WEIGHT[method]})::DOUBLE AS w, count(*) OVER (PARTITION BY u.node) AS degree FROM {und} u{extra}),
    few AS (SELECT node, nbr FROM weighted WHERE degree <= {width}),
    slots AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY node, band ORDER BY nbr) - 1 AS rank FROM (SELECT node, nbr, w, floor(ln(w) / ln(2.0::DOUBLE))::INT AS band FROM weighted WHERE degree > {width})),
    bands AS MATERIALIZED (SELECT node, band, count(*) AS n, max(w) AS top FROM slots GROUP BY 1, 2)"""


def _drawn(name, frontier, width, hop, seed=2020):
    """SQL tables that end in ``name`` (root, node, nbr): what each (root, node) of ``frontier`` draws for itself."""

    def part(start, n):
        return f"((('0x' || substr(h, {start}, {n}))::BIGINT + 0.5::DOUBLE) / {16**n}::DOUBLE)"

    out = [f"{name}_t0 AS (SELECT root, node, band, rank, nbr FROM {frontier} JOIN slots USING (node) WHERE false)"]
    for i in range(_TURNS):
        n = f"{name}_{{}}{i}".format
        out.append(f"""{n('p')} AS MATERIALIZED (SELECT root, node, coalesce(got, 0) AS got FROM (SELECT root, node FROM {frontier} WHERE node IN (SELECT node FROM bands)) LEFT JOIN (SELECT root, node, count(*) AS got FROM {n('t')} GROUP BY 1, 2) USING (root, node) WHERE coalesce(got, 0) < {width}),
        {n('l')} AS MATERIALIZED (SELECT *, max(hi) OVER (PARTITION BY root, node) AS total FROM (SELECT *, sum(n * top) OVER (PARTITION BY root, node ORDER BY band) AS hi FROM (SELECT p.root, p.node, b.band, b.n - coalesce(len(ranks), 0) AS n, b.top, coalesce(ranks, []) AS ranks
          FROM {n('p')} p JOIN bands b USING (node) LEFT JOIN (SELECT root, node, band, list_sort(list(rank)) AS ranks FROM {n('t')} GROUP BY 1, 2, 3) t ON t.root = p.root AND t.node = p.node AND t.band = b.band))),
        {n('d')} AS MATERIALIZED (SELECT root, node, j, md5(concat_ws('|', {seed}, {hop}, {i}, j, root, node)) AS h FROM {n('p')}, range({2 * width}) r(j)),
        {n('b')} AS MATERIALIZED (SELECT root, node, j, h, arg_min(l, band) AS l FROM {n('d')} JOIN {n('l')} l USING (root, node) WHERE l.hi > {part(1, 10)} * l.total GROUP BY 1, 2, 3, 4),
        {n('k')} AS MATERIALIZED (SELECT root, node, j, l.band AS band, floor({part(11, 13)} * l.n)::BIGINT AS k, l.ranks AS ranks, {part(24, 9)} * l.top AS y FROM {n('b')}),
        {n('h')} AS (SELECT k.root, k.node, s.band, s.rank, s.nbr, min(j) AS j FROM (SELECT *, k + len(list_filter(ranks, lambda x, i: x - (i - 1) <= k)) AS rank FROM {n('k')}) k JOIN slots s ON s.node = k.node AND s.band = k.band AND s.rank = k.rank WHERE y < w GROUP BY 1, 2, 3, 4, 5),
        {name}_t{i + 1} AS MATERIALIZED (SELECT * FROM {n('t')} UNION ALL SELECT root, node, band, rank, nbr FROM (SELECT h.*, row_number() OVER (PARTITION BY h.root, h.node ORDER BY j) + got AS place FROM {n('h')} h JOIN {n('p')} p ON p.root = h.root AND p.node = h.node) WHERE place <= {width})""")
    out.append(f"{name} AS MATERIALIZED (SELECT root, node, nbr FROM {frontier} JOIN few USING (node) UNION ALL SELECT root, node, nbr FROM {name}_t{_TURNS})")
    return ",\n".join(out)


for _m in ("uniform", "dw", "dw0-ntw1", "dw1-ntw0"):

    @query(
        f"graph_sample_{_m.replace('-', '_')}",
        "GRF-05" if _m == "uniform" else "GRF-06",
        f"""WITH {_lots(_m, 6)}, start AS (SELECT root, root AS node FROM v_groot), {_drawn('d1', 'start', 6, 1)},
        h1 AS MATERIALIZED (SELECT DISTINCT root, nbr AS node FROM d1 WHERE nbr <> root), {_drawn('d2', 'h1', 6, 2)}, h2 AS (SELECT DISTINCT root, nbr AS node FROM d2)
        SELECT root, node, 1 AS hop FROM h1 UNION ALL SELECT root, node, 2 FROM h2 WHERE node <> root AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.root = h2.root AND h1.node = h2.node)""",
        "v_groot v_und v_degree v_gedges",
    )
    def graph_sample(spark, sf, _m=_m):
        return graph.sample_context(_roots(spark, sf), _edges(spark, sf, True), 6, 2, _m)


_TS_MAX = 1_706_000_000


def _layer(i):
    """SQL tables of one layer of the budget sample, from all nodes picked before it."""
    u = _HEX.format(key=f"concat_ws('|', 2020, {i}, nbr)", n=13)
    return f"""f{i} AS (SELECT 'all' AS root, edge_type || chr(1) || node AS node FROM p{i - 1}, kinds WHERE layer = {i - 1}), {_drawn(f'd{i}', f'f{i}', 8, i)},
    n{i} AS MATERIALIZED (SELECT nbr AS node, {i} AS layer FROM (SELECT nbr, sum(1.0::DOUBLE / degree) AS w FROM d{i} JOIN weighted USING (node, nbr) GROUP BY 1) LEFT JOIN born USING (nbr)
      WHERE coalesce(ts, {_TS_MAX}) <= {_TS_MAX} AND nbr NOT IN (SELECT node FROM p{i - 1}) ORDER BY -ln(({u} + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (w * w), nbr LIMIT 8),
    p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT * FROM n{i})"""


@query(
    "graph_sample_budget",
    "GRF-07",
    f"""WITH both_ways AS (SELECT src, dst, edge_type FROM v_gedges UNION ALL SELECT dst, src, 'rev_' || edge_type FROM v_gedges), kinds AS (SELECT DISTINCT edge_type FROM both_ways),
    typed AS (SELECT DISTINCT edge_type || chr(1) || src AS node, dst AS nbr FROM both_ways), {_lots('uniform', 8, 'typed')}, born AS (SELECT src AS nbr, min(ts) AS ts FROM v_gedges GROUP BY 1),
    p0 AS (SELECT root AS node, 0 AS layer FROM v_groot), {_layer(1)}, {_layer(2)} SELECT * FROM p2""",
    "v_groot v_gedges",
)
def graph_sample_budget(spark, sf):
    e = _edges(spark, sf, True)
    return graph.sample_budget(_roots(spark, sf), e, _TS_MAX, 8, 2)


def _vectors(spark, sf):
    lab = labeled(spark, sf)
    e = _edges(spark, sf, True)
    tx = graph.feature_columns(lab, PARAMS.high_risk)
    feats = checkpointed(tx.unionByName(graph.entity_features(e, tx)))
    return graph.context_vectors(tx.select("node"), e, feats)


_ALL = [f"f{i}" for i in range(graph.FEATURES)]
_FEAT_ALL = _FEAT.replace(" FROM v_feat", f", 0.0::DOUBLE AS f8, CASE WHEN {_RISKY} THEN 1.0 ELSE 0.0 END AS f9, CASE WHEN shared_ip_with_other_cards THEN 1.0 ELSE 0.0 END AS f12 FROM v_feat")


@query(
    "graph_context_vectors",
    "GRF-08",
    f"""WITH {_lots('uniform', 6)}, start AS (SELECT 'tx:' || transaction_id AS root, 'tx:' || transaction_id AS node FROM v_feat), {_drawn('d1', 'start', 6, 1)},
    h1 AS MATERIALIZED (SELECT DISTINCT root, nbr AS node FROM d1 WHERE nbr <> root), {_drawn('d2', 'h1', 6, 2)},
    ctx AS (SELECT * FROM h1 UNION ALL SELECT DISTINCT root, nbr FROM d2 WHERE nbr <> root AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.root = d2.root AND h1.node = d2.nbr)),
    tx AS (SELECT node, {', '.join(_ALL)} FROM ({_FEAT_ALL})), feats AS (SELECT * FROM tx UNION ALL SELECT dst, {', '.join(f'avg({c})' for c in _ALL)} FROM v_gedges JOIN tx ON src = tx.node GROUP BY dst),
    mean AS (SELECT root AS node, count(*) AS n, {', '.join(f'avg({c}) AS c{c[1:]}' for c in _ALL)} FROM ctx JOIN feats USING (node) GROUP BY 1), deg AS (SELECT src AS node, count(DISTINCT dst) AS d FROM v_gedges GROUP BY 1),
    scale AS (SELECT count(*) FILTER (WHERE type < 'transaction')::DOUBLE / greatest(1, count(*) - 1) AS s FROM (SELECT src_type AS type FROM v_gedges UNION SELECT dst_type FROM v_gedges))
    SELECT tx.node, {', '.join(f"{rnd(f'tx.{c}', 6)} AS {c}" for c in _ALL)}, {', '.join(f"{rnd(f'coalesce(c{c[1:]}, 0)', 6)} AS c{c[1:]}" for c in _ALL)},
      round(ln(coalesce(d, 0) + 1.0::DOUBLE), 6) AS log_degree, round(ln(coalesce(n, 0) + 1.0::DOUBLE), 6) AS log_context, round(s, 6) AS type_scale FROM tx LEFT JOIN mean USING (node) LEFT JOIN deg USING (node), scale""",
    "v_und v_gedges v_feat",
)
def graph_context_vectors(spark, sf):
    out = _vectors(spark, sf)
    rounded = [round_half_up(F.col(c), 6).alias(c) for c in out.columns if c[0] in "fc"]
    return out.select("node", *rounded, *[F.round(c, 6).alias(c) for c in ("log_degree", "log_context", "type_scale")])


def _model(spark, sf):
    lab = labeled(spark, sf)
    vectors = checkpointed(_vectors(spark, sf))
    labels = lab.filter(F.col("pseudo_label") >= 0).select(F.concat(F.lit("tx:"), "transaction_id").alias("node"), "us", F.col("pseudo_label").alias("label"))
    if not models.enough_labels(labels):
        return lab, vectors, None, lambda _: None
    scored, predict = models.train_graph_model(vectors, labels)
    return lab, vectors, scored, predict


@query("graph_score_fallback", "GRF-10", "SELECT transaction_id, graph_score FROM v_comp", "v_comp")
def graph_score_fallback(spark, sf):
    """With negative labels only there is nothing to train on, and the prior stands."""
    lab = labeled(spark, sf)
    labels = lab.filter(F.col("pseudo_label") == 0).select(F.concat(F.lit("tx:"), "transaction_id").alias("node"), "us", F.col("pseudo_label").alias("label"))
    if models.enough_labels(labels):
        raise ValueError("one class must not be enough")
    return models.graph_score(lab, None).select("transaction_id", "graph_score")


@query("graph_model_scores", "GRF-09 GRF-10")
def graph_model_scores(spark, sf):
    lab, vectors, _, predict = _model(spark, sf)
    return models.graph_score(lab, predict(vectors)).select("transaction_id", "pseudo_label", "graph_score")


@query("graph_model_metrics", "GRF-09 AGG-50")
def graph_model_metrics(spark, sf):
    _, _, scored, _ = _model(spark, sf)
    if scored is None:
        return spark.createDataFrame([], "n long, loss double, accuracy double, auc double, average_precision double, split string")
    scored = checkpointed(scored)
    out = None
    for part in ("train", "valid", "test"):
        one = models.binary_metrics(scored.filter(F.col("split") == part)).withColumn("split", F.lit(part))
        out = one if out is None else out.unionByName(one)
    return out


@query("model_consensus", "GRF-11 WIN-12")
def model_consensus(spark, sf):
    lab = labeled(spark, sf).drop("model_consensus_score")
    return models.isolation_consensus(lab, "transaction_id").select("transaction_id", "model_consensus_score")


@query("risk_queue_with_models", "GRF-10 GRF-11 SRT-01")
def risk_queue_with_models(spark, sf):
    lab, vectors, _, predict = _model(spark, sf)
    feats = checkpointed(models.isolation_consensus(models.graph_score(lab, predict(vectors)), "transaction_id"))
    q = scoring.review_queue(scoring.score_frame(feats, PARAMS))
    return q.select("transaction_id", "risk_score", "risk_level", "primary_pattern", "graph_score", "model_consensus_score")


@query("model_pca_anomaly", "GRF-12 AGG-54")
def model_pca_anomaly(spark, sf):
    li = v.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_returnflag") == "R").alias("truth"))
    cols = ["l_quantity", "price_k", "discount_p", "tax_p"]
    data = li.withColumn("price_k", F.col("l_extendedprice") / 1000).withColumn("discount_p", F.col("l_discount") * 100).withColumn("tax_p", F.col("l_tax") * 100)
    out = models.pca_anomaly(data, cols, "NOT truth", 2, 40.0)
    return models.confusion(out, "truth", "is_anomaly")


_PREDS = "SELECT event_id AS node, CAST(value > 60 AS INT) AS label, round((k + 1) / 101.0::DOUBLE, 4) AS probability FROM v_ev"
view("v_preds", "v_ev", _PREDS)


def _preds(spark, sf):
    return v._events(spark, sf).select(
        F.col("event_id").alias("node"), (F.col("value") > 60).cast("int").alias("label"), F.round((F.col("k") + 1) / 101.0, 4).alias("probability")
    )


@query(
    "metrics_binary",
    "AGG-50",
    f"""SELECT n, {rnd('loss', 6)} AS loss, {rnd('accuracy', 6)} AS accuracy, {rnd('w / tp / tn', 6)} AS auc, {rnd('ap', 6)} AS average_precision FROM (SELECT count(*) AS n, avg(-label * ln(probability) - (1 - label) * ln(1 - probability)) AS loss,
    avg(CASE WHEN (probability >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM v_preds), (SELECT sum(p * (below + q * 0.5::DOUBLE)) AS w, sum(p)::DOUBLE AS tp, sum(q)::DOUBLE AS tn FROM (SELECT p, q, coalesce(sum(q) OVER (ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM (SELECT probability, sum(label) AS p, sum(1 - label) AS q FROM v_preds GROUP BY 1))), (SELECT avg(CASE WHEN label = 1 THEN hits / pos END) AS ap FROM (SELECT label, sum(label) OVER (ORDER BY probability DESC, node ROWS UNBOUNDED PRECEDING) AS hits, row_number() OVER (ORDER BY probability DESC, node) AS pos FROM v_preds))""",
    "v_preds",
)
def metrics_binary(spark, sf):
    return models.binary_metrics(_preds(spark, sf))


@query(
    "metrics_confusion",
    "AGG-54",
    "SELECT label AS truth, probability >= 0.5 AS predicted, count(*) AS n FROM v_preds GROUP BY 1, 2",
    "v_preds",
)
def metrics_confusion(spark, sf):
    return models.confusion(_preds(spark, sf).withColumn("hit", F.col("probability") >= 0.5), "label", "hit")


@query(
    "rank_percentile",
    "WIN-12",
    "SELECT transaction_id, round((row_number() OVER (ORDER BY amount, transaction_id) - 1) / (count(*) OVER () - 1), 6) AS pct FROM v_txn",
    "v_txn",
)
def rank_percentile(spark, sf):
    out = ranks.percentile_rank(v.txn(spark, sf).select("transaction_id", "amount"), "amount", "transaction_id", "pct")
    return out.select("transaction_id", F.round("pct", 6).alias("pct"))


@query(
    "rank_time_split",
    "WIN-19",
    """SELECT transaction_id, CASE WHEN rn < round(n * 0.72) THEN 'train' WHEN rn < round(n * 0.9) THEN 'valid' ELSE 'test' END AS split FROM (SELECT transaction_id, row_number() OVER (ORDER BY us, transaction_id) - 1 AS rn, count(*) OVER () AS n FROM v_txn)""",
    "v_txn",
)
def rank_time_split(spark, sf):
    return ranks.time_split(v.txn(spark, sf).select("transaction_id", "us"), "us", "transaction_id", 0.72, 0.9).select("transaction_id", "split")


# ---- explanation metrics: part / supplier pairs as community edges

view(
    "v_comm",
    "",
    """SELECT 'p' || (l_partkey % 30) AS source, 's' || (l_suppkey % 20) AS target, l_orderkey % 41 AS community_id, max(l_discount) AS edge_weight, CAST(max(l_partkey % 7) AS DOUBLE) AS human_importance FROM lineitem GROUP BY 1, 2, 3""",
)


def _community(spark, sf):
    li = v.table(spark, sf, "lineitem")
    return li.groupBy(
        F.concat(F.lit("p"), (F.col("l_partkey") % 30).cast("string")).alias("source"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("target"),
        (F.col("l_orderkey") % 41).alias("community_id"),
    ).agg(F.max("l_discount").alias("edge_weight"), F.max(F.col("l_partkey") % 7).cast("double").alias("human_importance"))


@query(
    "explain_line_degree",
    "GRF-13",
    """SELECT source, target, e.community_id, round((a.d + b.d - 2) / greatest(1, n - 1), 9) AS line_degree FROM v_comm e JOIN (SELECT community_id, x, count(*) AS d FROM (SELECT community_id, source AS x FROM v_comm UNION ALL SELECT community_id, target FROM v_comm) GROUP BY 1, 2) a
    ON a.community_id = e.community_id AND a.x = source JOIN (SELECT community_id, x, count(*) AS d FROM (SELECT community_id, source AS x FROM v_comm UNION ALL SELECT community_id, target FROM v_comm) GROUP BY 1, 2) b ON b.community_id = e.community_id AND b.x = target
    JOIN (SELECT community_id, count(*) AS n FROM v_comm GROUP BY 1) c ON c.community_id = e.community_id""",
    "v_comm",
)
def explain_line_degree(spark, sf):
    return explain.line_graph_degree(_community(spark, sf)).select("source", "target", "community_id", F.round("line_degree", 9).alias("line_degree"))


@query("explain_betweenness", "GRF-14")
def explain_betweenness(spark, sf):
    return explain.edge_betweenness(_community(spark, sf))


def _rates_sql(frame, runs, ks):
    """SQL of (runs, community, k, rate) of a frame with runs, source, target, community_id, edge_weight, human_importance."""
    g = "".join(f"{r}, " for r in runs)
    pair = "least(source, target) AS u, greatest(source, target) AS v"
    return f"""(SELECT {g}community_id, k, sum(CASE WHEN m <= k THEN 1 WHEN top THEN CAST(k::DOUBLE / m AS DECIMAL(28,14)) ELSE 0 END)::DOUBLE / k AS rate
      FROM (SELECT *, row_number() OVER (PARTITION BY {g}community_id ORDER BY edge_weight DESC, source, target) AS rk FROM (SELECT *, {pair} FROM {frame}))
      JOIN (SELECT {g}community_id, count(DISTINCT (u, v)) AS m FROM (SELECT *, {pair}, max(human_importance) OVER (PARTITION BY {g}community_id) AS best FROM {frame}) WHERE human_importance = best GROUP BY ALL) USING ({g}community_id)
      JOIN (SELECT {g}community_id, u, v, bool_or(human_importance = best) AS top FROM (SELECT *, {pair}, max(human_importance) OVER (PARTITION BY {g}community_id) AS best FROM {frame}) GROUP BY ALL) USING ({g}community_id, u, v)
      JOIN (VALUES {', '.join(f'({k})' for k in ks)}) t(k) ON rk <= k GROUP BY {g}community_id, k)"""


_MEAN = rnd("avg(rate::DECIMAL(28,14))", 6)


@query("explain_hit_rate", "GRF-15", f"SELECT k, {_MEAN} AS hit_rate, count(*) AS communities FROM {_rates_sql('v_comm', [], (5, 10, 15, 20, 25))} GROUP BY k", "v_comm")
def explain_hit_rate(spark, sf):
    return explain.hit_rate(_community(spark, sf))


_RUN_WEIGHT = _HEX.format(key="concat_ws('|', run, community_id, source, target)", n=13) + " / 4503599627370496::DOUBLE"
view("v_runs", "v_comm", f"SELECT run, source, target, community_id, human_importance, {_RUN_WEIGHT} AS edge_weight FROM v_comm, range(10) t(run)")


@query(
    "explain_random_baseline",
    "GRF-16",
    f"""SELECT k, hit_rate, communities, random_rate, {rnd('hit_rate - random_rate', 6)} AS gain FROM (SELECT k, {_MEAN} AS hit_rate, count(*) AS communities FROM {_rates_sql('v_comm', [], (5, 10, 15, 20, 25))} GROUP BY k)
    JOIN (SELECT k, {rnd('avg(hit_rate::DECIMAL(18,6))', 6)} AS random_rate FROM (SELECT run, k, {_MEAN} AS hit_rate FROM {_rates_sql('v_runs', ['run'], (5, 10, 15, 20, 25))} GROUP BY run, k) GROUP BY k) USING (k)""",
    "v_comm v_runs",
)
def explain_random_baseline(spark, sf):
    return explain.random_baseline(checkpointed(_community(spark, sf)))


def _hybrid(spark, sf):
    d = explain.line_graph_degree(_community(spark, sf))
    return d.withColumn("explainer", F.col("edge_weight") * 10).withColumn("centrality", F.col("line_degree"))


view("v_ends", "v_comm", "SELECT community_id, x, count(*) AS d FROM (SELECT community_id, source AS x FROM v_comm UNION ALL SELECT community_id, target FROM v_comm) GROUP BY 1, 2")
view(
    "v_hybrid",
    "v_comm v_ends",
    """SELECT source, target, c.community_id, human_importance, edge_weight * 10 AS explainer, (a.d + b.d - 2) / greatest(1, n - 1) AS centrality FROM v_comm c JOIN v_ends a ON a.community_id = c.community_id AND a.x = source
  JOIN v_ends b ON b.community_id = c.community_id AND b.x = target JOIN (SELECT community_id, count(*) AS n FROM v_comm GROUP BY 1) t ON t.community_id = c.community_id""",
)
view("v_blend", "v_hybrid", "SELECT i * 0.1::DOUBLE AS w0, i, source, target, community_id, human_importance, (1 - i / 10.0::DOUBLE) * explainer + i / 10.0::DOUBLE * centrality AS edge_weight FROM v_hybrid, range(11) t(i)")


@query("explain_hybrid_search", "GRF-17 FN-36", f"SELECT i / 10.0::DOUBLE AS w, {_MEAN} AS hit_rate FROM {_rates_sql('v_blend', ['i'], (5,))} GROUP BY i", "v_blend")
def explain_hybrid_search(spark, sf):
    return explain.hybrid_search(checkpointed(_hybrid(spark, sf)))


@query("explain_ridge", "GRF-17")
def explain_ridge(spark, sf):
    return explain.ridge_weights(_hybrid(spark, sf))


@query(
    "explain_combined_weight",
    "FN-36 AGG-53",
    "SELECT least(source, target) AS u, greatest(source, target) AS v, community_id, round(max(0.7::DOUBLE * edge_weight + 0.3::DOUBLE * human_importance), 6) AS weight FROM v_comm GROUP BY 1, 2, 3",
    "v_comm",
)
def explain_combined_weight(spark, sf):
    e = _community(spark, sf).withColumn("weight", explain.combine_weight(F.col("edge_weight"), F.col("human_importance"), 0.3))
    return explain.undirected_weight(e, "weight").withColumn("weight", F.round("weight", 6))


view("v_node_imp", "v_comm", "SELECT community_id, node, avg(h) AS importance FROM (SELECT community_id, source AS node, human_importance AS h FROM v_comm UNION ALL SELECT community_id, target, human_importance FROM v_comm) GROUP BY 1, 2")
for _h, _sql in (("min", "least(a.importance, b.importance)"), ("avg", "(a.importance + b.importance) / 2"), ("sum", "a.importance + b.importance")):

    @query(
        f"explain_importance_{_h}",
        "AGG-53",
        f"SELECT source, target, e.community_id, round({_sql}, 6) AS human_importance FROM v_comm e JOIN v_node_imp a ON a.community_id = e.community_id AND a.node = source JOIN v_node_imp b ON b.community_id = e.community_id AND b.node = target",
        "v_node_imp",
    )
    def explain_importance(spark, sf, _h=_h):
        e = _community(spark, sf)
        notes = e.select("community_id", F.col("source").alias("node"), F.col("human_importance").alias("importance")).union(e.select("community_id", "target", "human_importance"))
        out = explain.edge_importance(e.drop("human_importance"), explain.node_importance(notes), _h)
        return out.select("source", "target", "community_id", F.round("human_importance", 6).alias("human_importance"))


@query(
    "explain_ks_correlation",
    "AGG-55",
    f"""SELECT {rnd('max(abs(fa - fb))', 6)} AS ks, (SELECT {rnd('corr(l_discount, l_tax)', 6)} FROM lineitem) AS pearson FROM (SELECT sum(na) OVER (ORDER BY x) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY x) / sum(nb) OVER () AS fb FROM (SELECT x, sum(a) AS na, sum(b) AS nb FROM
    (SELECT round(l_discount, 6) AS x, 1 AS a, 0 AS b FROM lineitem UNION ALL SELECT round(l_tax, 6), 0, 1 FROM lineitem) GROUP BY x))""",
)
def explain_ks_correlation(spark, sf):
    return explain.ks_and_correlation(v.table(spark, sf, "lineitem"), "l_discount", "l_tax")


@query(
    "explain_kappa",
    "AGG-52",
    f"""SELECT a, b, kappa, {rnd('avg(kappa) OVER ()', 6)} AS mean_kappa FROM (SELECT a, b, {rnd('(agree / n - e / (n * n)) / (1 - e / (n * n))', 6)} AS kappa FROM (SELECT x.annotator AS a, y.annotator AS b, count(*) AS n, sum(CASE WHEN x.label = y.label THEN 1 ELSE 0 END) AS agree FROM r x JOIN r y ON x.item = y.item AND x.annotator < y.annotator GROUP BY 1, 2)
    JOIN (SELECT p.annotator AS a, q.annotator AS b, sum(p.c * q.c) AS e FROM (SELECT annotator, label, count(*) AS c FROM r GROUP BY 1, 2) p JOIN (SELECT annotator, label, count(*) AS c FROM r GROUP BY 1, 2) q ON p.label = q.label AND p.annotator < q.annotator GROUP BY 1, 2) USING (a, b))""".replace(
        "SELECT a, b, kappa,", "WITH r AS (SELECT o_orderkey AS item, g AS annotator, (o_orderkey * (g + 3) // 7 + g) % 3 AS label FROM orders, range(5) t(g)) SELECT a, b, kappa,", 1
    ),
)
def explain_kappa(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("annotator"))
    k = F.col("item") * (F.col("annotator") + 3)
    return explain.kappa(o.withColumn("label", ((k - F.pmod(k, F.lit(7))) / 7 + F.col("annotator")).cast("long") % 3))

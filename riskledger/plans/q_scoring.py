"""Scores, reasons, queue, feedback and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import context, ranks, review, scoring
from ..sources import export
from . import risk
from .q_risk import PARAMS
from .registry import query
from .views_sql import view

_RISKY = "merchant_category IN ('" + "','".join(PARAMS.high_risk) + "')"


def _clip(e):
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {e}))"


def _mean(parts):
    terms = []
    for p in parts:
        if len(p) == 4:
            ramp = _clip(f"(CAST({p[0]} AS DOUBLE) - {p[1]}) / {p[2] - p[1]}::DOUBLE")
            terms.append(f"{ramp} * {p[3]}::DOUBLE")
        else:
            terms.append(f"(CASE WHEN {p[0]} THEN 1.0 ELSE 0.0 END)::DOUBLE * {p[1]}::DOUBLE")
    return _clip("(" + " + ".join(terms) + f") / {sum(p[-1] for p in parts)}::DOUBLE")


_TESTING = f"channel = 'online' AND amount <= {PARAMS.small_amount} AND card_small_tx_count_60m >= 6 AND card_online_tx_count_60m >= 6"
view(
    "v_feat",
    "v_txn v_amount v_novelty v_surprisal v_velocity v_near_dup v_collective",
    "SELECT * FROM v_txn JOIN v_amount USING (transaction_id) JOIN v_novelty USING (transaction_id) JOIN v_surprisal USING (transaction_id) "
    "JOIN v_velocity USING (transaction_id) JOIN v_near_dup USING (transaction_id) JOIN v_collective USING (transaction_id)",
)
_CALM = f"""NOT ({_RISKY}) AND amount <= 180 AND abs(robust_z_log_amount) < 1.5 AND amount_ratio_to_card_median < 2.2 AND card_tx_count_60m <= 2
  AND merchant_unique_cards_60m <= 2 AND NOT category_is_new_for_card AND NOT device_is_new_for_card AND NOT ip_is_new_for_card
  AND NOT country_mismatch AND NOT shared_device_with_other_cards"""
_STATUS = "CASE action WHEN 'approve' THEN 'approved' WHEN 'dismiss' THEN 'dismissed' WHEN 'escalate' THEN 'escalated' WHEN 'decline' THEN 'declined' ELSE 'blocked' END"
view("v_state", "v_review", f"SELECT transaction_id, arg_max({_STATUS}, seq) AS status, count(*) AS n_events FROM v_review GROUP BY transaction_id")
view(
    "v_labeled",
    "v_feat v_state",
    f"""SELECT *, CASE WHEN starts_with(src, 'reviewer_d') AND src <> 'reviewer_dismissed' THEN 1 WHEN src IN ('reviewer_blocked','reviewer_escalated_weak') THEN 1
   WHEN src IN ('reviewer_approved','reviewer_dismissed','heuristic_stable_low_anomaly') THEN 0 WHEN src = 'unlabeled_scored' THEN -1 ELSE 1 END AS pseudo_label,
   src AS pseudo_label_source FROM (SELECT f.*, CASE WHEN status IN ('declined','blocked','approved','dismissed') THEN 'reviewer_' || status
   WHEN status = 'escalated' THEN 'reviewer_escalated_weak' WHEN {_TESTING} THEN 'heuristic_card_testing_velocity'
   WHEN {_RISKY} AND amount >= {PARAMS.high_amount} THEN 'heuristic_high_risk_category_amount'
   WHEN unusual_merchant_hit_by_many_cards AND merchant_unique_cards_60m >= 4 THEN 'heuristic_merchant_burst'
   WHEN device_unique_cards_total >= 4 AND shared_device_with_other_cards THEN 'heuristic_shared_device_across_cards'
   WHEN {_CALM} THEN 'heuristic_stable_low_anomaly' ELSE 'unlabeled_scored' END AS src FROM v_feat f LEFT JOIN v_state s USING (transaction_id))""",
)
view(
    "v_comp",
    "v_labeled",
    f"""SELECT *, round({_mean(scoring.CARD_PARTS)}, 4) AS card_baseline, round({_mean(scoring.SURPRISAL_PARTS)}, 4) AS categorical_surprisal,
  round(CASE WHEN {_TESTING} THEN greatest({_mean(scoring.VELOCITY_PARTS)}, 0.95::DOUBLE) ELSE {_mean(scoring.VELOCITY_PARTS)} END, 4) AS temporal_velocity,
  round({_mean(scoring.GRAPH_PARTS)}, 4) AS graph_collective, 0.0::DOUBLE AS model_consensus FROM (SELECT *, abs(robust_z_log_amount) AS abs_robust_z,
  {_RISKY} AND amount >= {PARAMS.high_amount} AS high_risk_high_amount, {_RISKY} AND merchant_category_country_cluster_rarity AS rare_high_risk_cluster,
  CASE pseudo_label WHEN 1 THEN 0.92::DOUBLE WHEN 0 THEN 0.08::DOUBLE ELSE CAST(round(CAST((least(abs(robust_z_log_amount) / 6.0::DOUBLE, 1.0::DOUBLE)
   + least(amount_ratio_to_card_median / 8.0::DOUBLE, 1.0::DOUBLE) + merchant_burst_score + 0.0::DOUBLE + CASE WHEN shared_device_with_other_cards THEN 1 ELSE 0 END
   + CASE WHEN unusual_merchant_hit_by_many_cards THEN 1 ELSE 0 END) / 6.0::DOUBLE AS DECIMAL(22,12)), 4) AS DOUBLE) END AS graph_score FROM v_labeled)""",
)
_CODES = "list_filter([" + ", ".join(f"CASE WHEN {r.when} THEN '{r.code}' END" for r in scoring.reason_rules(PARAMS)) + "], lambda x: x IS NOT NULL)[1:5]"
_SEV = "list_filter([" + ", ".join(f"CASE WHEN {r.when} THEN ({r.severity}) END" for r in scoring.reason_rules(PARAMS)) + "], lambda x: x IS NOT NULL)[1:5]"
view(
    "v_base_score",
    "v_comp",
    """SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.3::DOUBLE * card_baseline + 0.25::DOUBLE * graph_collective + 0.2::DOUBLE * temporal_velocity
  + 0.15::DOUBLE * categorical_surprisal + 0.1::DOUBLE * model_consensus) / 0.55::DOUBLE)), 4) AS risk_score FROM v_comp""",
)


def _scored(where: str) -> str:
    return f"""SELECT *, CASE WHEN risk_score >= 0.82 THEN 'critical' WHEN risk_score >= 0.66 THEN 'high' WHEN risk_score >= 0.42 THEN 'medium' ELSE 'low' END AS risk_level,
   risk_score >= threshold AS is_flagged FROM v_base_score, ({where})"""


_RANKED = "SELECT risk_score AS threshold FROM (SELECT risk_score, row_number() OVER (ORDER BY risk_score DESC) AS rn, count(*) OVER () AS n FROM v_base_score) WHERE rn = greatest(1, CAST(round_even(n * {rate}, 0) AS BIGINT))"
view("v_scored0", "v_base_score", _scored(_RANKED.format(rate="0.08::DOUBLE")))
_HAS = "list_contains(codes, '{}')"
view(
    "v_scored",
    "v_scored0",
    f"""SELECT *, CASE WHEN risk_level IN ('critical','high') THEN 'escalate' WHEN is_flagged THEN 'review' ELSE 'monitor' END AS recommended_action,
  CASE WHEN {_HAS.format('CARD_TESTING_VELOCITY')} THEN 'card_testing' WHEN {_HAS.format('MERCHANT_BURST')} THEN 'merchant_burst'
   WHEN {_HAS.format('HIGH_RISK_CATEGORY_AMOUNT')} OR {_HAS.format('REPEATED_HIGH_RISK_CARD_ACTIVITY')} THEN 'account_takeover_purchase'
   WHEN {_HAS.format('SHARED_DEVICE_ACROSS_CARDS')} OR {_HAS.format('SHARED_IP_ACROSS_CARDS')} THEN 'shared_instrument'
   WHEN {_HAS.format('GRAPH_MODEL_SCORE')} THEN 'graph_anomaly' WHEN {_HAS.format('AMOUNT_SPIKE_FOR_CARD')} THEN 'card_baseline_anomaly' ELSE 'elevated_risk' END AS primary_pattern
  FROM (SELECT *, CASE WHEN len(hits) = 0 AND (risk_score >= 0.42 OR is_flagged) THEN ['ELEVATED_COMPOSITE_RISK'] ELSE hits END AS codes,
   CASE WHEN len(hits) = 0 AND (risk_score >= 0.42 OR is_flagged) THEN ['medium'] ELSE sev END AS severities
   FROM (SELECT *, {_CODES} AS hits, {_SEV} AS sev FROM v_scored0))""",
)



def _state(spark, sf):
    return review.review_state(review.decisions_to_events(v.review(spark, sf)))


_RUNS: dict[tuple[str, str], object] = {}


def labeled(spark, sf):
    """The labelled feature frame of a data folder, written once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = risk.labeled_features(v.txn(spark, sf), PARAMS, _state(spark, sf))
    return _RUNS[key]


def scored(spark, sf, **rate):
    return scoring.score_frame(labeled(spark, sf), PARAMS, **rate)


@query(
    "risk_components",
    "FN-01 FN-03",
    "SELECT transaction_id, card_baseline, categorical_surprisal, temporal_velocity, graph_collective, model_consensus FROM v_comp",
    "v_comp",
)
def risk_components(spark, sf):
    out = scoring.component_scores(labeled(spark, sf), PARAMS)
    return out.select("transaction_id", *[n for n, _ in sorted(scoring.BLEND)])


_RISK_COLS = "transaction_id, risk_score, risk_level, is_flagged, recommended_action, primary_pattern"


@query(
    "risk_scores",
    "FN-03 FN-05 FLT-19 SRT-02 JON-01",
    f"SELECT {_RISK_COLS} FROM v_scored",
    "v_scored",
)
def risk_scores(spark, sf):
    return scored(spark, sf).select(*_RISK_COLS.split(", "))


@query(
    "risk_queue",
    "SRT-01 SRT-03 FN-04 FN-05",
    f"SELECT {_RISK_COLS}, array_to_string(codes, ';') AS reason_codes, array_to_string(severities, ';') AS severities FROM v_scored WHERE is_flagged",
    "v_scored",
)
def risk_queue(spark, sf):
    q = scoring.review_queue(scored(spark, sf))
    return q.select(
        *_RISK_COLS.split(", "),
        F.concat_ws(";", scoring.reason_codes()).alias("reason_codes"),
        F.concat_ws(";", F.transform("reasons", lambda r: r["severity"])).alias("severities"),
    )


def _half_up(c, digits):
    return f"CAST(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,18)) AS DECIMAL(28,{digits}))"


# priority, message and evidence of every reason, as the rules state them
_SAID = {
    "CARD_TESTING_VELOCITY": (5, "card_small_tx_count_60m || ' small online transactions on this card within 60 minutes.'", "card_id card_small_tx_count_60m card_online_tx_count_60m amount"),
    "MERCHANT_BURST": (8, "merchant_name || ' saw ' || merchant_unique_cards_60m || ' unique cards in a 60-minute window.'", "merchant_name merchant_unique_cards_60m merchant_tx_count_60m"),
    "HIGH_RISK_CATEGORY_AMOUNT": (10, f"'High-value ' || replace(merchant_category, '_', ' ') || ' transaction for CAD ' || format('{{:,}}', CAST(floor({_half_up('amount', 2)}) AS BIGINT)) || right(CAST({_half_up('amount', 2)} AS VARCHAR), 3) || '.'", "merchant_category amount merchant_name"),
    "REPEATED_HIGH_RISK_CARD_ACTIVITY": (12, "card_high_risk_tx_count_24h || ' high-risk category transactions on this card within 24 hours.'", "card_id card_high_risk_tx_count_24h same_card_same_device_count_24h"),
    "SPLIT_PURCHASE_PATTERN": (15, "same_card_same_merchant_count_60m || ' same-card merchant transactions clustered within 60 minutes.'", "card_id merchant_name same_card_same_merchant_count_60m same_card_same_merchant_sum_60m"),
    "NEAR_DUPLICATE_TRANSACTION": (18, "'Similar amount at the same merchant appeared on this card within 24 hours.'", "card_id merchant_name amount"),
    "AMOUNT_SPIKE_FOR_CARD": (20, f"'Amount is ' || {_half_up('amount_ratio_to_card_median', 1)} || 'x this card''s median transaction.'", "amount card_median_amount amount_ratio_to_card_median robust_z_log_amount"),
    "NEW_DEVICE_FOR_CARD": (25, "'First observed use of this device for the card.'", "card_id device_id"),
    "NEW_IP_FOR_CARD": (28, "'First observed use of this IP address for the card.'", "card_id ip_address"),
    "NEW_CATEGORY_FOR_CARD": (30, "'First observed ' || replace(merchant_category, '_', ' ') || ' transaction category for this card.'", "card_id merchant_category"),
    "NEW_MERCHANT_FOR_CARD": (32, "'First observed merchant for this card.'", "card_id merchant_name"),
    "COUNTRY_MISMATCH": (35, "'Merchant country differs from the cardholder country.'", "cardholder_country merchant_country"),
    "UNUSUAL_COUNTRY_FOR_CARD": (38, "'Merchant country is unusual for this card''s history.'", "card_id merchant_country"),
    "IP_PREFIX_BURST": (40, "'IP network ' || ip_prefix || ' touched ' || ip_prefix_unique_cards_60m || ' cards within 60 minutes.'", "ip_prefix ip_prefix_unique_cards_60m ip_prefix_tx_count_60m"),
    "SHARED_DEVICE_ACROSS_CARDS": (42, "'Device used by ' || device_unique_cards_total || ' different cards.'", "device_id device_unique_cards_total"),
    "SHARED_IP_ACROSS_CARDS": (44, "'IP address used by ' || ip_unique_cards_total || ' different cards.'", "ip_address ip_unique_cards_total"),
    "RARE_MERCHANT_CATEGORY_COUNTRY": (48, "'Rare merchant/category/country combination in this dataset.'", "merchant_name merchant_category merchant_country merchant_category_country_cluster_count"),
    "GRAPH_MODEL_SCORE": (50, f"'The graph model scored this transaction at ' || {_half_up('graph_score', 2)} || '.'", "graph_score pseudo_label pseudo_label_source"),
    "ELEVATED_COMPOSITE_RISK": (80, "'Multiple weak anomaly signals combine into an elevated risk score.'", "risk_score model_consensus"),
}


def _said() -> str:
    """SQL of one row per reason and piece of evidence."""

    def pieces(names):
        return "[" + ", ".join(f"{{'name': '{n if n != 'model_consensus' else 'model_consensus_score'}', 'value': coalesce(CAST({n} AS VARCHAR), '')}}" for n in names.split()) + "]"

    cases = [(f"WHEN '{c}' THEN {prio}", f"WHEN '{c}' THEN {text}", f"WHEN '{c}' THEN {pieces(names)}") for c, (prio, text, names) in _SAID.items()]
    priority, message, evidence = (f"CASE code {' '.join(x)} END" for x in zip(*cases))
    return f"""SELECT transaction_id, code, severity, priority, message, e.name AS name, round(TRY_CAST(e.value AS DOUBLE), 4) AS number, CASE WHEN TRY_CAST(e.value AS DOUBLE) IS NULL THEN e.value END AS text
    FROM (SELECT transaction_id, code, severity, {priority} AS priority, {message} AS message, unnest({evidence}) AS e
      FROM (SELECT *, unnest(codes) AS code, unnest(severities) AS severity FROM v_scored))"""


@query("risk_reasons", "FN-04", _said(), "v_scored")
def risk_reasons(spark, sf):
    """Every reason of every transaction with its message, a row per piece of evidence."""
    r = scoring.build_reasons(scored(spark, sf), PARAMS).select("transaction_id", F.explode("reasons").alias("r"))
    rows = r.select("transaction_id", "r.code", "r.severity", "r.priority", "r.message", F.explode("r.evidence").alias("name", "value"))
    number = F.expr("try_cast(value AS DOUBLE)")
    return rows.withColumn("number", F.round(number, 4)).withColumn("text", F.when(number.isNull(), F.col("value"))).drop("value")


@query(
    "risk_thresholds",
    "SRT-02",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, threshold FROM ({_RANKED.format(rate=f'{rate!r}::DOUBLE')})"
        for name, rate in (
            ("conservative", 0.05),
            ("balanced", 0.08),
            ("aggressive", 0.12),
            ("custom", 0.01),
            ("cost_aware", 0.03 + 0.17 * 5 / 6),
        )
    )
    + ")",
    "v_base_score",
)
def risk_thresholds(spark, sf):
    s = scoring.risk_score(scoring.component_scores(labeled(spark, sf), PARAMS)).select("risk_score")
    out = None
    for args in (
        {"profile": "conservative"},
        {"profile": "balanced"},
        {"profile": "aggressive"},
        {"rate": 0.01},
        {"false_positive_cost": 1.0, "false_negative_cost": 5.0},
    ):
        name, rate = ranks.review_rate(**args)
        one = ranks.score_threshold(s, "risk_score", rate).select(F.lit(name).alias("rule"), "threshold")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "risk_summary",
    "AGG-03",
    """SELECT 'total' AS kind, 'processed' AS name, count(*) AS n FROM v_scored UNION ALL SELECT 'total', 'flagged', count(*) FROM v_scored WHERE is_flagged
    UNION ALL SELECT 'level', risk_level, count(*) FROM v_scored GROUP BY 2 UNION ALL SELECT 'pattern', primary_pattern, count(*) FROM v_scored WHERE is_flagged GROUP BY 2""",
    "v_scored",
)
def risk_summary(spark, sf):
    return scoring.run_summary(scored(spark, sf))


@query(
    "risk_pseudo_labels",
    "FLT-20",
    "SELECT transaction_id, pseudo_label, pseudo_label_source FROM v_labeled",
    "v_labeled",
)
def risk_pseudo_labels(spark, sf):
    return labeled(spark, sf).select("transaction_id", "pseudo_label", "pseudo_label_source")


@query(
    "risk_label_counts",
    "AGG-48",
    "SELECT pseudo_label, pseudo_label_source, count(*) AS n FROM v_labeled WHERE pseudo_label >= 0 GROUP BY 1, 2",
    "v_labeled",
)
def risk_label_counts(spark, sf):
    return scoring.label_counts(risk_pseudo_labels(spark, sf))


@query("review_state", "WIN-17 STR-10", "SELECT * FROM v_state", "v_state")
def review_state(spark, sf):
    return _state(spark, sf)


_DEPTH = "SELECT *, CASE WHEN undo THEN 'undo' ELSE act END AS kind, sum(CASE WHEN undo THEN -1 ELSE 1 END) OVER (ORDER BY event_id) AS depth FROM (SELECT *, (event_id % 3 = 2) AS undo, event_type AS act FROM v_ev)"


@query(
    "review_undo_stack",
    "WIN-17",
    f"""SELECT event_id AS seq, CAST(depth AS BIGINT) AS depth FROM (SELECT *, min(depth) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low
    FROM ({_DEPTH})) WHERE NOT undo AND (low IS NULL OR low >= depth)""",
    "v_ev",
)
def review_undo_stack(spark, sf):
    e = v._events(spark, sf).select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("undo:"), "event_type")).otherwise(F.col("event_type")).alias("action"),
    )
    return review.undo_stack(e, block=500).select("seq", "depth")


view(
    "v_feedback",
    "v_scored v_state",
    f"""SELECT *, CASE WHEN pos THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(risk_score + delta, 4))) ELSE risk_score END AS new_score FROM (
   SELECT s.*, coalesce(st.status, 'pending') AS review_status, st.status IS NULL AND vote IS NOT NULL AS pos,
    CASE vote WHEN 3 THEN 0.12::DOUBLE WHEN 2 THEN 0.06::DOUBLE ELSE -0.08::DOUBLE END AS delta,
    CASE vote WHEN 3 THEN 'SESSION_FEEDBACK_POSITIVE_BOOST' WHEN 2 THEN 'SESSION_FEEDBACK_WEAK_POSITIVE_BOOST' ELSE 'SESSION_FEEDBACK_SUPPRESSION' END AS new_code
   FROM v_scored s LEFT JOIN v_state st USING (transaction_id) LEFT JOIN (SELECT merchant_name, merchant_category,
     max(CASE WHEN status IN ('declined','blocked') THEN 3 WHEN status = 'escalated' THEN 2 ELSE 1 END) AS vote
     FROM v_txn JOIN v_state USING (transaction_id) GROUP BY 1, 2) p USING (merchant_name, merchant_category))""",
)
_FB = """SELECT transaction_id, new_score AS risk_score, CASE WHEN new_score >= 0.82 THEN 'critical' WHEN new_score >= 0.66 THEN 'high' WHEN new_score >= 0.42 THEN 'medium' ELSE 'low' END AS risk_level,
  new_score >= threshold AS is_flagged, review_status, array_to_string(CASE WHEN pos THEN list_append(codes, new_code) ELSE codes END, ';') AS reason_codes FROM v_feedback"""


def _feedback(spark, sf):
    return review.apply_feedback(scored(spark, sf), _state(spark, sf))


@query("review_feedback", "JON-22 FN-34", _FB, "v_feedback")
def review_feedback(spark, sf):
    return _feedback(spark, sf).select(
        "transaction_id", "risk_score", "risk_level", "is_flagged", "review_status", F.concat_ws(";", scoring.reason_codes()).alias("reason_codes")
    )


@query(
    "review_dismissals",
    "JON-22",
    """SELECT s.transaction_id, CASE WHEN st.status IS NULL AND p.merchant_name IS NOT NULL THEN greatest(0.0::DOUBLE, round(risk_score - 0.08::DOUBLE, 4)) ELSE risk_score END AS risk_score
    FROM v_scored s LEFT JOIN v_state st USING (transaction_id) LEFT JOIN (SELECT DISTINCT merchant_name, merchant_category FROM v_txn JOIN v_state USING (transaction_id)
    WHERE status = 'dismissed') p ON s.merchant_name = p.merchant_name AND s.merchant_category = p.merchant_category""",
    "v_scored v_state",
)
def review_dismissals(spark, sf):
    return review.apply_dismissals(scored(spark, sf), _state(spark, sf)).select("transaction_id", "risk_score")


@query(
    "review_queue_pending",
    "FLT-09",
    f"SELECT transaction_id, risk_score, risk_level FROM ({_FB}) WHERE is_flagged AND review_status = 'pending'",
    "v_feedback",
)
def review_queue_pending(spark, sf):
    return review.by_status(_feedback(spark, sf), "pending").select("transaction_id", "risk_score", "risk_level")


@query(
    "review_next_item",
    "FLT-09",
    f"SELECT transaction_id, risk_score FROM ({_FB}) WHERE is_flagged AND review_status = 'pending' ORDER BY risk_score DESC, transaction_id LIMIT 1",
    "v_feedback",
)
def review_next_item(spark, sf):
    return review.next_item(_feedback(spark, sf)).select("transaction_id", "risk_score")


@query(
    "review_training_status",
    "AGG-49",
    """SELECT count(*) AS decision_count, count(CASE WHEN status IN ('declined','blocked') THEN 1 END) AS positive,
    count(CASE WHEN status IN ('approved','dismissed') THEN 1 END) AS negative, count(CASE WHEN status = 'escalated' THEN 1 END) AS weak_positive,
    (SELECT max(created_us) FROM v_review) AS last_feedback_us, count(CASE WHEN status <> 'escalated' THEN 1 END) AS eligible_decision_count,
    'pending_validation' AS candidate_status, 'riskledger-v1-candidate-' || count(CASE WHEN status <> 'escalated' THEN 1 END) AS candidate_version FROM v_state""",
    "v_state",
)
def review_training_status(spark, sf):
    events = review.decisions_to_events(v.review(spark, sf))
    return review.training_status(review.review_state(events), events, scoring.MODEL_VERSION)


# ---- context

view(
    "v_entity",
    "v_txn",
    """SELECT transaction_id, us, 'card' AS entity_type, card_id AS entity_id FROM v_txn UNION ALL SELECT transaction_id, us, 'merchant', merchant_name FROM v_txn
  UNION ALL SELECT transaction_id, us, 'category_country_cluster', merchant_category || '|' || merchant_country FROM v_txn
  UNION ALL SELECT transaction_id, us, 'device', device_id FROM v_txn WHERE device_id <> '' UNION ALL SELECT transaction_id, us, 'ip', ip_address FROM v_txn WHERE ip_address <> ''""",
)


@query(
    "context_entity_links",
    "FN-35 FLT-10",
    """SELECT transaction_id AS source_id, entity_type AS target_type, entity_id AS target_id, CASE entity_type WHEN 'card' THEN 'uses_card' WHEN 'merchant' THEN 'paid_merchant'
    WHEN 'device' THEN 'used_device' WHEN 'ip' THEN 'used_ip' ELSE 'in_category_country_cluster' END AS relation, CASE entity_type WHEN 'card' THEN 'card ' || entity_id
    WHEN 'device' THEN 'device ' || entity_id WHEN 'ip' THEN 'IP ' || entity_id ELSE replace(entity_id, '|', '/') END AS label FROM v_entity""",
    "v_entity",
)
def context_entity_links(spark, sf):
    return (
        scoring.with_entity_links(v.txn(spark, sf))
        .select(F.explode("entity_links").alias("l"))
        .select("l.source_id", "l.target_type", "l.target_id", "l.relation", "l.label")
    )


@query(
    "context_matching_cluster",
    "FLT-10",
    "SELECT transaction_id, us, amount FROM v_txn WHERE merchant_category = 'purchase' AND merchant_country = '2'",
    "v_txn",
)
def context_matching_cluster(spark, sf):
    return context.matching(v.txn(spark, sf), "Cluster", "purchase|2").select("transaction_id", "us", "amount")


@query(
    "context_card_timeline",
    "SRT-06",
    "SELECT card_id, transaction_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY us, transaction_id) AS rank FROM v_txn) WHERE rank <= 20",
    "v_txn",
)
def context_card_timeline(spark, sf):
    return context.timelines(v.txn(spark, sf), "card_id", 20).select("card_id", "transaction_id", "rank")


@query(
    "context_related",
    "JON-17 SRT-06",
    """SELECT root_id, entity_type, entity_id, related_id, rank FROM (SELECT a.transaction_id AS root_id, a.entity_type, a.entity_id, b.transaction_id AS related_id,
    row_number() OVER (PARTITION BY a.transaction_id, a.entity_type ORDER BY b.us, b.transaction_id) AS rank FROM v_entity a
    JOIN v_entity b ON a.entity_type = b.entity_type AND a.entity_id = b.entity_id AND a.transaction_id <> b.transaction_id
    WHERE a.transaction_id IN (SELECT transaction_id FROM v_review)) WHERE rank <= 20""",
    "v_entity v_review",
)
def context_related(spark, sf):
    t = v.txn(spark, sf)
    roots = t.join(v.review(spark, sf).select("transaction_id"), "transaction_id", "left_semi")
    return context.related(t, roots)


view("v_root", "v_scored", "SELECT transaction_id, risk_score FROM v_scored WHERE is_flagged ORDER BY risk_score DESC, transaction_id LIMIT 1")
view(
    "v_around",
    "v_root v_entity",
    """SELECT s.* FROM v_scored s WHERE s.transaction_id IN (SELECT transaction_id FROM v_root UNION SELECT e.transaction_id FROM v_entity e
  JOIN v_entity r ON e.entity_type = r.entity_type AND e.entity_id = r.entity_id JOIN v_root o ON r.transaction_id = o.transaction_id
  JOIN v_scored x ON x.transaction_id = e.transaction_id WHERE x.is_flagged OR x.risk_score >= greatest(0.55::DOUBLE, o.risk_score - 0.12::DOUBLE))""",
)
view(
    "v_around_entity",
    "v_around",
    "SELECT e.*, count(*) OVER (PARTITION BY e.entity_type, e.entity_id) AS n FROM v_entity e WHERE e.transaction_id IN (SELECT transaction_id FROM v_around)",
)


def _around(spark, sf):
    risks = scored(spark, sf).select(
        "transaction_id", "us", "card_id", "merchant_name", "merchant_category", "merchant_country", "device_id", "ip_address", "risk_score", "is_flagged"
    )
    root = scoring.review_queue(risks, 1)
    return context.around(risks, root), root


@query(
    "context_graph_nodes",
    "JON-18 SRT-07",
    """SELECT 'transaction:' || a.transaction_id AS id, 'transaction' AS type, a.transaction_id AS label, r.transaction_id IS NOT NULL AS selected,
    r.transaction_id IS NOT NULL OR is_flagged AS highlighted, a.risk_score FROM v_around a LEFT JOIN v_root r ON a.transaction_id = r.transaction_id
    UNION ALL SELECT DISTINCT entity_type || ':' || entity_id, entity_type, CASE WHEN entity_type = 'category_country_cluster' THEN replace(entity_id, '|', ' / ') ELSE entity_id END,
    FALSE, n > 1, CAST(NULL AS DOUBLE) FROM v_around_entity""",
    "v_around_entity",
)
def context_graph_nodes(spark, sf):
    rows, root = _around(spark, sf)
    return context.graph_nodes(rows, root)


@query(
    "context_graph_edges",
    "JON-18",
    """SELECT 'transaction:' || e.transaction_id AS source, entity_type || ':' || entity_id AS target, entity_type AS relation,
    r.transaction_id IS NOT NULL OR n > 1 AS highlighted FROM v_around_entity e LEFT JOIN v_root r ON e.transaction_id = r.transaction_id""",
    "v_around_entity",
)
def context_graph_edges(spark, sf):
    rows, root = _around(spark, sf)
    return context.graph_edges(rows, root)


@query(
    "context_compact",
    "SRT-07",
    "SELECT transaction_id, risk_score FROM v_scored ORDER BY is_flagged DESC, risk_score DESC, us, transaction_id LIMIT 80",
    "v_scored",
)
def context_compact(spark, sf):
    return context.compact(scored(spark, sf)).select("transaction_id", "risk_score")


@query(
    "export_scored_rows",
    "SRC-03",
    """SELECT transaction_id, card_id, amount, is_flagged AS identified_fraud, CASE WHEN is_flagged THEN primary_pattern ELSE '' END AS fraud_pattern,
    CASE WHEN is_flagged THEN array_to_string(codes, ';') ELSE '' END AS fraud_reason_codes, risk_score, risk_level, is_flagged, graph_score, recommended_action,
    primary_pattern, array_to_string(codes, ';') AS reason_codes, review_status FROM v_feedback""",
    "v_feedback",
)
def export_scored_rows(spark, sf):
    t = v.txn(spark, sf).select("transaction_id", "card_id", "amount")
    st = _state(spark, sf).select("transaction_id", F.col("status").alias("review_status"))
    risks = scored(spark, sf).join(st, "transaction_id", "left").fillna("pending", ["review_status"])
    return export.scored_rows(t, risks)


@query(
    "export_flagged_rows",
    "SRC-04",
    """SELECT transaction_id, card_id, amount, TRUE AS identified_fraud, primary_pattern AS fraud_pattern, risk_score, risk_level, recommended_action, graph_score,
    array_to_string(codes, ';') AS reason_codes, review_status FROM v_feedback WHERE is_flagged""",
    "v_feedback",
)
def export_flagged_rows(spark, sf):
    t = v.txn(spark, sf).select("transaction_id", "card_id", "amount")
    st = _state(spark, sf).select("transaction_id", F.col("status").alias("review_status"))
    risks = scored(spark, sf).join(st, "transaction_id", "left").fillna("pending", ["review_status"])
    return export.flagged_rows(t, risks)

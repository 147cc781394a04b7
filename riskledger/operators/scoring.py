"""Component scores, final score, reasons, patterns and the review queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import bounded, clip01, flag, num, round_half_up, scale_above, weighted_mean
from . import ranks
from .velocity import RiskParams

MODEL_VERSION = "riskledger-v1"

# Weights of the blend and the parts of each component.
BLEND = (
    ("card_baseline", 0.30),
    ("graph_collective", 0.25),
    ("temporal_velocity", 0.20),
    ("categorical_surprisal", 0.15),
    ("model_consensus", 0.10),
)
CALIBRATION = 0.55
LEVELS = (("critical", 0.82), ("high", 0.66), ("medium", 0.42))

# (feature, start, full, weight) is a ramp; (feature, weight) a 0/1 flag.
CARD_PARTS = (
    ("abs_robust_z", 2.5, 9.0, 1.4),
    ("amount_ratio_to_card_median", 3.0, 14.0, 1.5),
    ("category_is_new_for_card", 1.0),
    ("merchant_is_new_for_card", 0.7),
    ("device_is_new_for_card", 1.1),
    ("ip_is_new_for_card", 0.6),
    ("channel_is_unusual_for_card", 0.8),
    ("merchant_country_is_unusual_for_card", 0.8),
    ("country_mismatch", 0.5),
    ("high_risk_high_amount", 1.4),
)
SURPRISAL_PARTS = (
    ("merchant_category_card_surprisal", 1.1, 3.0, 1.1),
    ("merchant_name_card_surprisal", 1.4, 3.2, 1.0),
    ("device_id_card_surprisal", 1.0, 2.8, 0.7),
    ("ip_address_card_surprisal", 1.0, 2.8, 0.6),
    ("category_channel_country_combo_surprisal", 1.2, 3.1, 1.2),
    ("categorical_surprisal_raw", 1.2, 2.8, 1.0),
)
VELOCITY_PARTS = (
    ("card_tx_count_10m", 2.0, 7.0, 1.2),
    ("card_tx_count_60m", 3.0, 11.0, 1.3),
    ("card_online_tx_count_60m", 2.0, 9.0, 1.2),
    ("card_small_tx_count_60m", 2.0, 9.0, 1.4),
    ("merchant_unique_cards_60m", 3.0, 8.0, 1.0),
    ("merchant_tx_count_60m", 3.0, 12.0, 0.8),
    ("same_card_same_merchant_count_60m", 2.0, 5.0, 0.8),
    ("same_card_same_amount_near_duplicate_24h", 0.8),
    ("split_purchase_suspect", 1.0),
    ("card_high_risk_tx_count_24h", 1.0, 4.0, 1.2),
    ("card_high_amount_tx_count_24h", 1.0, 4.0, 1.2),
    ("same_card_same_device_count_24h", 1.0, 4.0, 0.7),
)
GRAPH_PARTS = (
    ("merchant_burst_score", 0.0, 1.0, 1.4),
    ("unusual_merchant_hit_by_many_cards", 1.4),
    ("merchant_unique_cards_24h", 6.0, 18.0, 0.7),
    ("shared_device_with_other_cards", 1.2),
    ("shared_ip_with_other_cards", 0.7),
    ("device_unique_cards_total", 1.0, 4.0, 0.8),
    ("ip_unique_cards_total", 1.0, 4.0, 0.7),
    ("ip_prefix_unique_cards_60m", 4.0, 10.0, 0.8),
    ("rare_high_risk_cluster", 0.9),
    ("graph_score", 0.0, 1.0, 1.6),
)
TESTING_FLOOR = 0.95


def _mean(parts) -> Column:
    return weighted_mean([(scale_above(p[0], p[1], p[2]), p[3]) if len(p) == 4 else (flag(p[0]), p[1]) for p in parts])


def is_card_testing(p: RiskParams) -> Column:
    return (
        (F.col("channel") == "online")
        & (F.col("amount") <= p.small_amount)
        & (num("card_small_tx_count_60m") >= 6)
        & (num("card_online_tx_count_60m") >= 6)
    )


def component_scores(features: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """Add the five component columns, each rounded to four decimals."""
    risky = F.col("merchant_category").isin(*p.high_risk)
    df = features
    for c in ("model_consensus_score", "graph_score"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    df = (
        df.withColumn("abs_robust_z", F.abs(num("robust_z_log_amount")))
        .withColumn("high_risk_high_amount", risky & (F.col("amount") >= p.high_amount))
        .withColumn("rare_high_risk_cluster", risky & F.col("merchant_category_country_cluster_rarity"))
    )
    velocity = _mean(VELOCITY_PARTS)
    velocity = F.when(is_card_testing(p), F.greatest(velocity, F.lit(TESTING_FLOOR))).otherwise(velocity)
    return (
        df.withColumn("card_baseline", F.round(_mean(CARD_PARTS), 4))
        .withColumn("categorical_surprisal", F.round(_mean(SURPRISAL_PARTS), 4))
        .withColumn("temporal_velocity", F.round(velocity, 4))
        .withColumn("graph_collective", F.round(_mean(GRAPH_PARTS), 4))
        .withColumn("model_consensus", F.round(clip01(num("model_consensus_score")), 4))
        .drop("abs_robust_z", "high_risk_high_amount", "rare_high_risk_cluster")
    )


def risk_score(components: DataFrame) -> DataFrame:
    """Blend, calibrate, then damp small stable subscription and utility payments."""
    raw = None
    for name, w in BLEND:
        term = F.lit(w) * F.col(name)
        raw = term if raw is None else raw + term
    score = F.round(bounded(raw / CALIBRATION), 4)
    benign = (
        F.col("merchant_category").isin("subscription", "utilities")
        & (F.col("amount") <= 30)
        & (F.col("temporal_velocity") < 0.15)
        & (F.col("graph_collective") < 0.15)
        & (num("amount_ratio_to_card_median") < 3.0)
    )
    return components.withColumn("risk_score", F.when(benign, F.round(score * 0.65, 4)).otherwise(score))


def risk_level(score: Column) -> Column:
    out = None
    for name, at in LEVELS:
        out = F.when(score >= at, name) if out is None else out.when(score >= at, name)
    return out.otherwise("low")


def recommended_action(level: Column, flagged: Column) -> Column:
    return F.when(level.isin("critical", "high"), "escalate").when(flagged, "review").otherwise("monitor")


@dataclass(frozen=True)
class Rule:
    """One coded reason: SQL predicate and severity over the feature columns."""

    code: str
    when: str
    severity: str
    priority: int
    message: tuple[str, ...]
    evidence: tuple[str, ...]


def reason_rules(p: RiskParams = RiskParams()) -> list[Rule]:
    """The coded reasons in priority order (fixed rules, limits from ``p``)."""
    risky = "merchant_category IN (" + ", ".join(f"'{c}'" for c in p.high_risk) + ")"
    high = f"amount >= {p.high_amount:g}"
    return [
        Rule(
            "CARD_TESTING_VELOCITY",
            f"channel = 'online' AND amount <= {p.small_amount:g} AND card_small_tx_count_60m >= 6 AND card_online_tx_count_60m >= 6",
            "'critical'",
            5,
            ("%d small online transactions on this card within 60 minutes.", "card_small_tx_count_60m"),
            ("card_id", "card_small_tx_count_60m", "card_online_tx_count_60m", "amount"),
        ),
        Rule(
            "MERCHANT_BURST",
            "unusual_merchant_hit_by_many_cards",
            f"CASE WHEN {high} THEN 'critical' ELSE 'high' END",
            8,
            ("%s saw %d unique cards in a 60-minute window.", "merchant_name", "merchant_unique_cards_60m"),
            ("merchant_name", "merchant_unique_cards_60m", "merchant_tx_count_60m"),
        ),
        Rule(
            "HIGH_RISK_CATEGORY_AMOUNT",
            f"{risky} AND {high}",
            "CASE WHEN merchant_category = 'gift_card' THEN 'critical' ELSE 'high' END",
            10,
            ("High-value %s transaction for CAD %,.2f.", "replace(merchant_category, '_', ' ')", "CAST(amount AS DOUBLE)"),
            ("merchant_category", "amount", "merchant_name"),
        ),
        Rule(
            "REPEATED_HIGH_RISK_CARD_ACTIVITY",
            f"card_high_risk_tx_count_24h >= 2 AND {risky}",
            "'high'",
            12,
            ("%d high-risk category transactions on this card within 24 hours.", "card_high_risk_tx_count_24h"),
            ("card_id", "card_high_risk_tx_count_24h", "same_card_same_device_count_24h"),
        ),
        Rule(
            "SPLIT_PURCHASE_PATTERN",
            "split_purchase_suspect",
            "'high'",
            15,
            ("%d same-card merchant transactions clustered within 60 minutes.", "same_card_same_merchant_count_60m"),
            ("card_id", "merchant_name", "same_card_same_merchant_count_60m", "same_card_same_merchant_sum_60m"),
        ),
        Rule(
            "NEAR_DUPLICATE_TRANSACTION",
            "same_card_same_amount_near_duplicate_24h",
            "'medium'",
            18,
            ("Similar amount at the same merchant appeared on this card within 24 hours.",),
            ("card_id", "merchant_name", "amount"),
        ),
        Rule(
            "AMOUNT_SPIKE_FOR_CARD",
            "abs(robust_z_log_amount) >= 3.5 OR amount_ratio_to_card_median >= 5",
            f"CASE WHEN {high} THEN 'high' ELSE 'medium' END",
            20,
            ("Amount is %.1fx this card's median transaction.", "amount_ratio_to_card_median"),
            ("amount", "card_median_amount", "amount_ratio_to_card_median", "robust_z_log_amount"),
        ),
        Rule(
            "NEW_DEVICE_FOR_CARD",
            "device_is_new_for_card",
            f"CASE WHEN {high} OR {risky} THEN 'high' ELSE 'medium' END",
            25,
            ("First observed use of this device for the card.",),
            ("card_id", "device_id"),
        ),
        Rule(
            "NEW_IP_FOR_CARD",
            "ip_is_new_for_card",
            "'medium'",
            28,
            ("First observed use of this IP address for the card.",),
            ("card_id", "ip_address"),
        ),
        Rule(
            "NEW_CATEGORY_FOR_CARD",
            "category_is_new_for_card",
            f"CASE WHEN {risky} THEN 'high' ELSE 'medium' END",
            30,
            ("First observed %s transaction category for this card.", "replace(merchant_category, '_', ' ')"),
            ("card_id", "merchant_category"),
        ),
        Rule(
            "NEW_MERCHANT_FOR_CARD",
            "merchant_is_new_for_card",
            "'medium'",
            32,
            ("First observed merchant for this card.",),
            ("card_id", "merchant_name"),
        ),
        Rule(
            "COUNTRY_MISMATCH",
            "country_mismatch",
            "'medium'",
            35,
            ("Merchant country differs from the cardholder country.",),
            ("cardholder_country", "merchant_country"),
        ),
        Rule(
            "UNUSUAL_COUNTRY_FOR_CARD",
            "merchant_country_is_unusual_for_card",
            "'medium'",
            38,
            ("Merchant country is unusual for this card's history.",),
            ("card_id", "merchant_country"),
        ),
        Rule(
            "IP_PREFIX_BURST",
            "ip_prefix_unique_cards_60m >= 5",
            "'medium'",
            40,
            ("IP network %s touched %d cards within 60 minutes.", "ip_prefix", "ip_prefix_unique_cards_60m"),
            ("ip_prefix", "ip_prefix_unique_cards_60m", "ip_prefix_tx_count_60m"),
        ),
        Rule(
            "SHARED_DEVICE_ACROSS_CARDS",
            "shared_device_with_other_cards",
            "'critical'",
            42,
            ("Device used by %d different cards.", "device_unique_cards_total"),
            ("device_id", "device_unique_cards_total"),
        ),
        Rule(
            "SHARED_IP_ACROSS_CARDS",
            "shared_ip_with_other_cards",
            "'medium'",
            44,
            ("IP address used by %d different cards.", "ip_unique_cards_total"),
            ("ip_address", "ip_unique_cards_total"),
        ),
        Rule(
            "RARE_MERCHANT_CATEGORY_COUNTRY",
            f"merchant_category_country_cluster_rarity AND {risky}",
            "'medium'",
            48,
            ("Rare merchant/category/country combination in this dataset.",),
            ("merchant_name", "merchant_category", "merchant_country", "merchant_category_country_cluster_count"),
        ),
        Rule(
            "GRAPH_MODEL_SCORE",
            "graph_score >= 0.72",
            "CASE WHEN graph_score >= 0.85 THEN 'high' ELSE 'medium' END",
            50,
            ("The graph model scored this transaction at %.2f.", "graph_score"),
            ("graph_score", "pseudo_label", "pseudo_label_source"),
        ),
    ]


COMPOSITE = "ELEVATED_COMPOSITE_RISK"


def _reason(code, severity: Column, priority: int, message: Column, evidence: list[Column]) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        severity.alias("severity"),
        message.alias("message"),
        F.create_map(*evidence).alias("evidence"),
        F.lit(priority).alias("priority"),
    )


def build_reasons(scored: DataFrame, p: RiskParams = RiskParams(), limit: int = 5) -> DataFrame:
    """Add ``reasons``: the five first matching rules, or one composite fallback."""
    df = scored
    for c, default in (("pseudo_label", F.lit(-1)), ("pseudo_label_source", F.lit("unlabeled_scored"))):
        if c not in df.columns:
            df = df.withColumn(c, default)
    found = []
    for r in reason_rules(p):
        fmt, args = r.message[0], r.message[1:]
        text = F.format_string(fmt, *[F.expr(a) for a in args]) if args else F.lit(fmt)
        pairs = [x for c in r.evidence for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
        found.append(F.when(F.expr(r.when), _reason(r.code, F.expr(r.severity), r.priority, text, pairs)))
    hits = F.slice(F.array_compact(F.array(*found)), 1, limit)
    fallback = _reason(
        COMPOSITE,
        F.lit("medium"),
        80,
        F.lit("Multiple weak anomaly signals combine into an elevated risk score."),
        [
            F.lit("risk_score"),
            F.col("risk_score").cast("string"),
            F.lit("model_consensus_score"),
            num("model_consensus_score").cast("string"),
        ],
    )
    needs = (F.size("_hits") == 0) & ((F.col("risk_score") >= 0.42) | F.col("is_flagged"))
    return (
        df.withColumn("_hits", hits)
        .withColumn("reasons", F.when(needs, F.array(fallback)).otherwise(F.col("_hits")))
        .drop("_hits")
    )


def reason_codes(col: str = "reasons") -> Column:
    return F.transform(col, lambda r: r["code"])


def primary_pattern(codes: Column) -> Column:
    def has(c):
        return F.array_contains(codes, c)

    return (
        F.when(has("CARD_TESTING_VELOCITY"), "card_testing")
        .when(has("MERCHANT_BURST"), "merchant_burst")
        .when(has("HIGH_RISK_CATEGORY_AMOUNT") | has("REPEATED_HIGH_RISK_CARD_ACTIVITY"), "account_takeover_purchase")
        .when(has("SHARED_DEVICE_ACROSS_CARDS") | has("SHARED_IP_ACROSS_CARDS"), "shared_instrument")
        .when(has("GRAPH_MODEL_SCORE"), "graph_anomaly")
        .when(has("AMOUNT_SPIKE_FOR_CARD"), "card_baseline_anomaly")
        .when(num("model_consensus_score") >= 0.90, "model_consensus")
        .otherwise("elevated_risk")
    )


def score_frame(
    features: DataFrame,
    p: RiskParams = RiskParams(),
    profile: str = "balanced",
    rate: float | None = None,
    false_positive_cost: float | None = None,
    false_negative_cost: float | None = None,
) -> DataFrame:
    """Features to risk records: score, level, flag, action, reasons and pattern."""
    scored = risk_score(component_scores(features, p))
    _, review = ranks.review_rate(profile, rate, false_positive_cost, false_negative_cost)
    threshold = ranks.score_threshold(scored, "risk_score", review)
    df = scored.join(F.broadcast(threshold))  # one row
    df = df.withColumn("is_flagged", F.col("risk_score") >= F.col("threshold"))
    df = df.withColumn("risk_level", risk_level(F.col("risk_score")))
    df = build_reasons(df, p)
    return df.withColumn("recommended_action", recommended_action(F.col("risk_level"), F.col("is_flagged"))).withColumn(
        "primary_pattern", primary_pattern(reason_codes())
    ).withColumn("model_version", F.lit(MODEL_VERSION))


def review_queue(risks: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged rows, riskiest first, ids breaking ties."""
    out = risks.filter("is_flagged").orderBy(F.desc("risk_score"), "transaction_id")
    return out.limit(limit) if limit else out


def run_summary(risks: DataFrame) -> DataFrame:
    """Counts of the run as (kind, name, n): rows, flagged, levels, flagged patterns."""
    per = risks.groupBy("risk_level", "is_flagged", "primary_pattern").agg(F.count("*").alias("n"))
    kinds = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("processed").alias("name")),
        F.struct(F.lit("level").alias("kind"), F.col("risk_level").alias("name")),
        F.when(F.col("is_flagged"), F.struct(F.lit("total").alias("kind"), F.lit("flagged").alias("name"))),
        F.when(F.col("is_flagged"), F.struct(F.lit("pattern").alias("kind"), F.col("primary_pattern").alias("name"))),
    )
    return (
        per.withColumn("e", F.explode(F.array_compact(kinds)))
        .groupBy(F.col("e.kind").alias("kind"), F.col("e.name").alias("name"))
        .agg(F.sum("n").cast("long").alias("n"))
    )


def with_entity_links(risks: DataFrame) -> DataFrame:
    """Add ``entity_links``: card, merchant, cluster, and device / ip where present."""

    def link(kind, ident, relation, label):
        return F.struct(
            F.lit("transaction").alias("source_type"),
            F.col("transaction_id").alias("source_id"),
            F.lit(kind).alias("target_type"),
            ident.alias("target_id"),
            F.lit(relation).alias("relation"),
            label.alias("label"),
        )

    card, merchant, device, ip = (F.col(c) for c in ("card_id", "merchant_name", "device_id", "ip_address"))
    cat, country = F.col("merchant_category"), F.col("merchant_country")
    links = [
        link("card", card, "uses_card", F.concat(F.lit("card "), card)),
        link("merchant", merchant, "paid_merchant", merchant),
        link(
            "category_country_cluster",
            F.concat_ws("|", cat, country),
            "in_category_country_cluster",
            F.concat_ws("/", cat, country),
        ),
        F.when(device != "", link("device", device, "used_device", F.concat(F.lit("device "), device))),
        F.when(ip != "", link("ip", ip, "used_ip", F.concat(F.lit("IP "), ip))),
    ]
    return risks.withColumn("entity_links", F.array_compact(F.array(*links)))


def pseudo_labels(features: DataFrame, reviews: DataFrame | None = None, p: RiskParams = RiskParams()) -> DataFrame:
    """Add ``pseudo_label`` (1, 0, -1 for none) and its source: reviews, then rules."""
    df = features
    if reviews is not None:
        df = df.join(reviews.select("transaction_id", F.col("status").alias("_status")), "transaction_id", "left")
    else:
        df = df.withColumn("_status", F.lit(None).cast("string"))
    status = F.col("_status")
    risky = F.col("merchant_category").isin(*p.high_risk)
    calm = (
        ~risky
        & (F.col("amount") <= 180)
        & (F.abs(num("robust_z_log_amount")) < 1.5)
        & (num("amount_ratio_to_card_median") < 2.2)
        & (num("card_tx_count_60m") <= 2)
        & (num("merchant_unique_cards_60m") <= 2)
        & ~F.col("category_is_new_for_card")
        & ~F.col("device_is_new_for_card")
        & ~F.col("ip_is_new_for_card")
        & ~F.col("country_mismatch")
        & ~F.col("shared_device_with_other_cards")
    )
    rules = [
        (status.isin("declined", "blocked"), 1, F.concat(F.lit("reviewer_"), status)),
        (status == "escalated", 1, F.lit("reviewer_escalated_weak")),
        (status.isin("approved", "dismissed"), 0, F.concat(F.lit("reviewer_"), status)),
        (is_card_testing(p), 1, F.lit("heuristic_card_testing_velocity")),
        (risky & (F.col("amount") >= p.high_amount), 1, F.lit("heuristic_high_risk_category_amount")),
        (F.col("unusual_merchant_hit_by_many_cards") & (F.col("merchant_unique_cards_60m") >= 4), 1, F.lit("heuristic_merchant_burst")),
        ((F.col("device_unique_cards_total") >= 4) & F.col("shared_device_with_other_cards"), 1, F.lit("heuristic_shared_device_across_cards")),
        (calm, 0, F.lit("heuristic_stable_low_anomaly")),
    ]
    picked = None
    for cond, label, source in rules:
        s = F.struct(F.lit(label).alias("label"), source.alias("source"))
        picked = F.when(cond, s) if picked is None else picked.when(cond, s)
    picked = picked.otherwise(F.struct(F.lit(-1).alias("label"), F.lit("unlabeled_scored").alias("source")))
    return (
        df.withColumn("_p", picked)
        .withColumn("pseudo_label", F.col("_p.label"))
        .withColumn("pseudo_label_source", F.col("_p.source"))
        .drop("_p", "_status")
    )


def label_counts(labeled: DataFrame) -> DataFrame:
    return (
        labeled.filter(F.col("pseudo_label") >= 0)
        .groupBy("pseudo_label", "pseudo_label_source")
        .agg(F.count("*").alias("n"))
    )


def prior_graph_score(labeled: DataFrame, name: str = "graph_score") -> DataFrame:
    """Prior of the graph model: from the label, else the mean of six signals."""
    consensus = num("model_consensus_score") if "model_consensus_score" in labeled.columns else F.lit(0.0)
    signals = [
        F.least(F.abs(num("robust_z_log_amount")) / 6.0, F.lit(1.0)),
        F.least(num("amount_ratio_to_card_median") / 8.0, F.lit(1.0)),
        num("merchant_burst_score"),
        F.least(consensus, F.lit(1.0)),
        flag("shared_device_with_other_cards"),
        flag("unusual_merchant_hit_by_many_cards"),
    ]
    total = signals[0]
    for s in signals[1:]:
        total = total + s
    score = (
        F.when(F.col("pseudo_label") == 1, 0.92)
        .when(F.col("pseudo_label") == 0, 0.08)
        .otherwise(round_half_up(bounded(total / 6.0), 4))
    )
    return labeled.withColumn(name, score)

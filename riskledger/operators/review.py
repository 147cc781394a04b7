"""Reviewer decisions: state fold, feedback on scores, training status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import recommended_action, risk_level

# Fixed values.
ACTION_STATUS = {"approve": "approved", "dismiss": "dismissed", "escalate": "escalated", "decline": "declined", "block": "blocked"}
STATUS_LABEL = {"approved": "negative", "dismissed": "negative", "escalated": "weak_positive", "declined": "positive", "blocked": "positive"}
MIN_DECISIONS = 5


def _lookup(col, table: dict):
    out = None
    for k, val in table.items():
        out = F.when(col == k, val) if out is None else out.when(col == k, val)
    return out


def decisions_to_events(decisions: DataFrame) -> DataFrame:
    """(transaction_id, action, seq, ...) to audit events with from / to status.

    The status before an action is the one the transaction's previous event left.
    """
    to = _lookup(F.col("action"), ACTION_STATUS)
    before = F.lag("to_status").over(Window.partitionBy("transaction_id").orderBy("seq"))
    return (
        decisions.withColumn("to_status", to)
        .withColumn("from_status", F.coalesce(before, F.lit("pending")))
        .withColumn("training_label", _lookup(F.col("to_status"), STATUS_LABEL))
    )


def review_state(events: DataFrame) -> DataFrame:
    """Current status per transaction: the ``to_status`` of its last event.

    Undo events carry their own ``to_status``, so the fold is one max_by.
    """
    return events.groupBy("transaction_id").agg(
        F.max_by("to_status", "seq").alias("status"), F.count("*").alias("n_events")
    )


def undo_stack(events: DataFrame, block: int = 100_000) -> DataFrame:
    """Actions that no later undo has taken back (one last-in-first-out stack).

    Depth is the running +1 / -1 sum over all events; an action at depth d is open
    when the depth never falls below d afterwards. Both the running sum and the
    suffix minimum are made per block of ``seq`` and then corrected with one line
    per block, so the global order needs no single task over all events.
    """
    step = F.when(F.col("action").startswith("undo:"), -1).otherwise(1)
    e = events.withColumn("_b", F.floor(F.col("seq") / F.lit(block)).cast("long")).withColumn("_d", step)
    blocks = e.groupBy("_b").agg(F.sum("_d").alias("_sum"))
    starts = blocks.select(
        "_b", F.coalesce(F.sum("_sum").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at")
    )
    inside = Window.partitionBy("_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    deep = e.join(starts, "_b").withColumn("_depth", F.col("_at") + F.sum("_d").over(inside))
    lows = deep.groupBy("_b").agg(F.min("_depth").alias("_low"))
    later = lows.select("_b", F.min("_low").over(Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    rest = Window.partitionBy("_b").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return (
        deep.join(later, "_b")
        .withColumn("_min", F.least(F.min("_depth").over(rest), F.col("_later")))
        .filter((F.col("_d") == 1) & (F.col("_min").isNull() | (F.col("_min") >= F.col("_depth"))))
        .withColumn("depth", F.col("_depth").cast("long"))
        .drop("_b", "_d", "_at", "_depth", "_later", "_min")
    )


def apply_feedback(risks: DataFrame, state: DataFrame) -> DataFrame:
    """Move pending scores by decisions on the same (merchant, category) pair.

    positive +0.12 before weak positive +0.06 before negative -0.08; levels, flags
    and actions follow, and the reason is appended once.
    """
    label = _lookup(F.col("status"), STATUS_LABEL)
    rows = risks.join(state.select("transaction_id", "status"), "transaction_id", "left")
    pair = ["merchant_name", "merchant_category"]
    votes = rows.filter(label.isNotNull()).groupBy(*pair).agg(
        F.max(F.when(label == "positive", 3).when(label == "weak_positive", 2).otherwise(1)).alias("_vote")
    )
    df = rows.join(votes, pair, "left")
    pending = F.col("status").isNull() | (F.col("status") == "pending")
    vote = F.when(pending, F.coalesce("_vote", F.lit(0))).otherwise(0)
    delta = F.when(vote == 3, 0.12).when(vote == 2, 0.06).when(vote == 1, -0.08)
    code = (
        F.when(vote == 3, "SESSION_FEEDBACK_POSITIVE_BOOST")
        .when(vote == 2, "SESSION_FEEDBACK_WEAK_POSITIVE_BOOST")
        .when(vote == 1, "SESSION_FEEDBACK_SUPPRESSION")
    )
    what = F.when(vote == 3, "declined or blocked").when(vote == 2, "escalated").otherwise("approved or dismissed")
    reason = F.struct(
        code.alias("code"),
        F.when(vote == 1, "low").otherwise("medium").alias("severity"),
        F.concat(F.lit("Score changed because similar transactions were "), what, F.lit(" in this review session.")).alias("message"),
        F.create_map(
            F.lit("merchant_name"), F.col("merchant_name"), F.lit("merchant_category"), F.col("merchant_category")
        ).alias("evidence"),
        F.when(vote == 3, 18).when(vote == 2, 24).otherwise(90).alias("priority"),
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("risk_score") + delta, 4)))
    has = F.exists("reasons", lambda r: r["code"] == code)
    return (
        df.withColumn("_hit", vote > 0)
        .withColumn("reasons", F.when((vote > 0) & ~has, F.concat("reasons", F.array(reason))).otherwise(F.col("reasons")))
        .withColumn("risk_score", F.when(F.col("_hit"), score).otherwise(F.col("risk_score")))
        .withColumn("risk_level", F.when(F.col("_hit"), risk_level(F.col("risk_score"))).otherwise(F.col("risk_level")))
        .withColumn("is_flagged", F.when(F.col("_hit"), F.col("risk_score") >= F.col("threshold")).otherwise(F.col("is_flagged")))
        .withColumn(
            "recommended_action",
            F.when(F.col("_hit"), recommended_action(F.col("risk_level"), F.col("is_flagged"))).otherwise(F.col("recommended_action")),
        )
        .withColumn("review_status", F.coalesce("status", F.lit("pending")))
        .drop("_vote", "_hit", "status")
    )


def apply_dismissals(risks: DataFrame, state: DataFrame) -> DataFrame:
    """Older form: only dismissals count, the score falls by 0.08, level and flag stay."""
    rows = risks.join(state.select("transaction_id", "status"), "transaction_id", "left")
    pair = ["merchant_name", "merchant_category"]
    pairs = rows.filter(F.col("status") == "dismissed").select(*pair).distinct().withColumn("_hit", F.lit(True))
    df = rows.join(pairs, pair, "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("status").isNull() | (F.col("status") == "pending"))
    lower = F.greatest(F.lit(0.0), F.round(F.col("risk_score") - 0.08, 4))
    return df.withColumn("risk_score", F.when(hit, lower).otherwise(F.col("risk_score"))).drop("_hit", "status")


def training_status(state: DataFrame, events: DataFrame, version: str) -> DataFrame:
    """One row: label counts, candidate state and the time of the last real decision."""
    label = _lookup(F.col("status"), STATUS_LABEL)
    counts = state.agg(
        F.count(label).alias("decision_count"),
        F.count(F.when(label == "positive", 1)).alias("positive"),
        F.count(F.when(label == "negative", 1)).alias("negative"),
        F.count(F.when(label == "weak_positive", 1)).alias("weak_positive"),
    )
    last = events.filter(~F.col("action").startswith("undo:")).agg(F.max("created_us").alias("last_feedback_us"))
    final = F.col("positive") + F.col("negative")
    status = (
        F.when(final < MIN_DECISIONS, "collecting_feedback")
        .when((F.col("positive") == 0) | (F.col("negative") == 0), "needs_label_balance")
        .otherwise("pending_validation")
    )
    return (
        counts.join(F.broadcast(last))  # one row each
        .withColumn("eligible_decision_count", final)
        .withColumn("candidate_status", status)
        .withColumn("candidate_version", F.concat(F.lit(f"{version}-candidate-"), F.greatest(final, F.lit(1)).cast("string")))
    )


def by_status(risks: DataFrame, status: str) -> DataFrame:
    """The queue restricted to one review status."""
    return risks.filter(F.col("is_flagged") & (F.col("review_status") == status)).orderBy(F.desc("risk_score"), "transaction_id")


def next_item(risks: DataFrame) -> DataFrame:
    """The riskiest flagged row still pending."""
    return by_status(risks, "pending").limit(1)

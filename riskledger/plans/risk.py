"""The full scoring plan: features, labels, scores, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import baselines, review, scoring, velocity
from ..operators.frames import merged
from ..operators.velocity import RiskParams
from ..session import stored


def feature_frame(txns: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """All rule features on one row per transaction.

    Every block reads the base rows and is joined back on the id, so no block's
    plan is nested in another's. The columns of a step are written out before the next
    step runs, so the shuffle files of all steps never lie on the disks together.
    """
    steps = {
        "own": [baselines.amount_features(txns, baselines.card_stats(txns)), baselines.novelty_features(txns), baselines.surprisal_features(txns)],
        "velocity": [velocity.velocity_features(txns, p)],
        "near": [velocity.near_duplicates(txns)],
        "collective": [velocity.collective_features(txns)],
    }
    out = txns
    for name, blocks in steps.items():
        first, *rest = [b.select("transaction_id", *[c for c in b.columns if c not in txns.columns]) for b in blocks]
        for b in rest:
            first = first.join(b, "transaction_id")
        out = merged(out, stored(first, f"features-{name}"), "transaction_id")
    return out


def labeled_features(txns: DataFrame, p: RiskParams = RiskParams(), state: DataFrame | None = None) -> DataFrame:
    """Features with pseudo-labels and the prior graph score, written out once.

    The threshold, the scores and the feedback all read this frame, some columns each, so it is
    stored by column instead of being computed for each of them.
    """
    return stored(scoring.prior_graph_score(scoring.pseudo_labels(feature_frame(txns, p), state, p)), "labeled")


def score_transactions(
    txns: DataFrame,
    p: RiskParams = RiskParams(),
    state: DataFrame | None = None,
    **rate,
) -> DataFrame:
    """Risk records with the prior graph score; models may replace the two model columns."""
    return scoring.score_frame(labeled_features(txns, p, state), p, **rate)


def score_with_feedback(txns: DataFrame, decisions: DataFrame, p: RiskParams = RiskParams(), **rate) -> DataFrame:
    state = review.review_state(review.decisions_to_events(decisions))
    return review.apply_feedback(score_transactions(txns, p, state, **rate), state)

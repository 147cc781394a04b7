"""Per-card baselines, novelty flags and categorical surprisal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import EPSILON, robust_z, smoothed_nll
from .frames import by_kind, from_kind, running_totals

SURPRISAL_FIELDS = (
    "merchant_category",
    "merchant_name",
    "channel",
    "merchant_country",
    "device_id",
    "ip_address",
)
COMBO = ("merchant_category", "channel", "merchant_country")


def card_stats(txns: DataFrame) -> DataFrame:
    """Per card: rows, median amount, median and MAD of log1p(amount).

    Amounts are counted per (card, amount) first, so a card with most of the rows
    sends only its distinct amounts to the exact percentile.
    """
    per_amount = txns.groupBy("card_id", F.col("amount").cast("double").alias("a")).agg(F.count("*").alias("n"))
    meds = per_amount.groupBy("card_id").agg(
        F.sum("n").alias("card_tx_count"),
        F.percentile("a", F.lit(0.5), F.col("n")).alias("card_median_amount"),
        F.percentile(F.log1p("a"), F.lit(0.5), F.col("n")).alias("card_median_log_amount"),
    )
    mads = (
        per_amount.join(meds.select("card_id", "card_median_log_amount"), "card_id")
        .groupBy("card_id")
        .agg(F.percentile(F.abs(F.log1p("a") - F.col("card_median_log_amount")), F.lit(0.5), F.col("n")).alias("card_mad_log_amount"))
    )
    return meds.join(mads, "card_id")


def amount_features(txns: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the card's stats and the robust position of the amount among them."""
    amount = F.col("amount").cast("double")
    z = robust_z(F.log1p(amount), F.col("card_median_log_amount"), F.col("card_mad_log_amount"))
    return (
        txns.join(stats, "card_id")
        .withColumn("amount_ratio_to_card_median", F.round(amount / (F.col("card_median_amount") + EPSILON), 4))
        .withColumn("robust_z_log_amount", F.round(z, 4))
        .withColumn("card_median_amount", F.round("card_median_amount", 4))
        .withColumn("card_mad_log_amount", F.round("card_mad_log_amount", 6))
        .drop("card_median_log_amount")
    )


def novelty_features(txns: DataFrame) -> DataFrame:
    """Flags from the card's earlier rows only, in (us, transaction_id) order."""
    fields = ("merchant_category", "merchant_name", "device_id", "ip_address", "channel", "merchant_country")
    long = by_kind(txns, ["transaction_id", "us", "card_id"], {"card": F.lit("*"), **{f: F.col(f) for f in fields}})
    keys = ["card_id", "kind", "key"]
    runs = running_totals(long, keys, "us", "transaction_id", {"_n": F.lit(1).cast("long")}, keep=("kind",))
    names = {"_n_card": ("card", "_n"), **{f"_n_{f}": (f, "_n") for f in fields}}
    out = txns.join(from_kind(runs, "transaction_id", names), "transaction_id")
    prior = F.col("_n_card") - 1

    def new(f):
        return (prior >= 3) & F.coalesce(F.col(f"_n_{f}") == 1, F.lit(False))

    def unusual(f):
        return (prior >= 8) & ((F.col(f"_n_{f}") - 1) * 10 <= prior)

    return (
        out.withColumn("prior_card_tx_count", prior)
        .withColumn("category_is_new_for_card", (prior >= 3) & (F.col("_n_merchant_category") == 1))
        .withColumn("merchant_is_new_for_card", (prior >= 3) & (F.col("_n_merchant_name") == 1))
        .withColumn("device_is_new_for_card", new("device_id"))
        .withColumn("ip_is_new_for_card", new("ip_address"))
        .withColumn("channel_is_unusual_for_card", unusual("channel"))
        .withColumn("merchant_country_is_unusual_for_card", unusual("merchant_country"))
        .withColumn("country_mismatch", F.col("cardholder_country") != F.col("merchant_country"))
        .drop(*[c for c in out.columns if c.startswith("_n_")])
    )


def surprisal_features(txns: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Smoothed negative log likelihood of each field value given the card.

    One grouped count over (card, field, value) in long form yields counts,
    cardinalities and totals; the rows then pick up their own values' counts.
    """
    combo = F.concat_ws("|", *COMBO)
    rows = txns.withColumn("combo", combo)
    fields = [*SURPRISAL_FIELDS, "combo"]
    long = rows.select(
        "card_id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields])).alias("e"),
    ).select("card_id", "e.f", "e.v")
    counts = long.filter(F.col("v") != "").groupBy("card_id", "f", "v").agg(F.count("*").alias("n"))
    # per card: number of distinct values of each field, and its row count
    card = counts.groupBy("card_id").agg(
        F.sum(F.when(F.col("f") == "combo", F.col("n"))).alias("_total"),
        *[F.sum(F.when(F.col("f") == f, 1).otherwise(0)).alias(f"_card_{f}") for f in fields],
    )
    own = by_kind(rows, ["transaction_id", "card_id"], {f: F.col(f) for f in fields}).join(
        counts.select("card_id", F.col("f").alias("kind"), F.col("v").alias("key"), "n"), ["card_id", "kind", "key"]
    )
    found = from_kind(own, "transaction_id", {f"_n_{f}": (f, "n") for f in fields})
    out = rows.join(found, "transaction_id").join(card, "card_id")
    nll = {
        f: F.when(F.col(f) == "", 0.0).otherwise(smoothed_nll(F.col(f"_n_{f}"), F.col("_total"), F.col(f"_card_{f}"), alpha))
        for f in fields
    }
    present = sum((F.when(F.col(f) == "", 0).otherwise(1) for f in SURPRISAL_FIELDS), F.lit(1))
    total = nll["combo"]
    for f in reversed(SURPRISAL_FIELDS):
        total = nll[f] + total
    out = out.withColumn("categorical_surprisal_raw", F.round(total / present, 4))
    for f in SURPRISAL_FIELDS:
        out = out.withColumn(f"{f}_card_surprisal", F.round(nll[f], 4))
    out = out.withColumn("category_channel_country_combo_surprisal", F.round(nll["combo"], 4))
    return out.drop("combo", "_total", *[f"_n_{f}" for f in fields], *[f"_card_{f}" for f in fields])

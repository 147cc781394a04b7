"""Velocity windows, near duplicates and cross-card collective features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import ip_prefix
from .frames import DAY, HOUR, MINUTE, arrival_frames, by_kind, frame_distinct, frame_sums, from_kind, running_distinct, running_totals

FIRST_LOG_BUCKET = 50


@dataclass(frozen=True)
class RiskParams:
    """Category and amount limits of the scoring rules (fixed values)."""

    high_risk: tuple[str, ...] = ("gift_card", "electronics", "travel")
    small_amount: float = 25.0
    high_amount: float = 300.0
    split_sum: float = 300.0


def velocity_features(txns: DataFrame, p: RiskParams = RiskParams(), past_only: bool = False) -> DataFrame:
    """Two-sided windows around each row (``past_only`` drops the later half)."""
    one = F.lit(1).cast("long")
    ahead = (lambda w: 0) if past_only else (lambda w: w)

    def frame(e, w):
        return (e, w, ahead(w))

    def count_if(c, w):
        return frame(F.when(c, 1).otherwise(0).cast("long"), w)

    device, ip = F.nullif("device_id", F.lit("")), F.nullif("ip_address", F.lit(""))
    join = lambda *c: F.concat_ws("\x01", *c)
    keys = {
        "card": F.col("card_id"),
        "pair": join("card_id", "merchant_name"),
        "triple": join("card_id", "merchant_name", "merchant_category"),
        "own_device": F.when(device.isNotNull(), join("card_id", "device_id")),
    }
    base = ["transaction_id", "us", "amount", "channel", "merchant_category"]
    rows = by_kind(txns, base, keys)
    sums = frame_sums(
        rows,
        ["kind", "key"],
        "us",
        {
            "n10": frame(one, 10 * MINUTE),
            "n60": frame(one, HOUR),
            "n24": frame(one, DAY),
            "cents60": frame((F.col("amount") * 100).cast("long"), HOUR),  # whole cents: long sums in the frames
            "online": count_if(F.col("channel") == "online", HOUR),
            "small": count_if(F.col("amount") <= p.small_amount, HOUR),
            "risky": count_if(F.col("merchant_category").isin(*p.high_risk), DAY),
            "high": count_if(F.col("amount") >= p.high_amount, DAY),
        },
    )
    per_row = rows.select("transaction_id", "us", "kind", "key").join(sums, ["kind", "key", "us"])
    own = from_kind(
        per_row,
        "transaction_id",
        {
            "card_tx_count_10m": ("card", "n10"),
            "card_tx_count_60m": ("card", "n60"),
            "card_online_tx_count_60m": ("card", "online"),
            "card_small_tx_count_60m": ("card", "small"),
            "card_high_risk_tx_count_24h": ("card", "risky"),
            "card_high_amount_tx_count_24h": ("card", "high"),
            "same_card_same_merchant_count_60m": ("pair", "n60"),
            "same_card_same_merchant_sum_60m": ("pair", "cents60"),
            "_split_n": ("triple", "n60"),
            "_split_sum": ("triple", "cents60"),
            "same_card_same_device_count_24h": ("own_device", "n24"),
        },
    )
    crowd = by_kind(txns, ["transaction_id", "us", "card_id"], {"merchant": F.col("merchant_name"), "device": device, "ip": ip})
    if past_only:
        seen = arrival_frames(crowd, ["kind", "key"], "us", "transaction_id", "card_id", {"d": HOUR}, {"n": HOUR}, keep=("kind",))
    else:
        near = frame_distinct(crowd, ["kind", "key"], "us", "card_id", {"d": HOUR}, {"n": HOUR})
        seen = crowd.select("transaction_id", "us", "kind", "key").join(near, ["kind", "key", "us"])
    shared = from_kind(
        seen,
        "transaction_id",
        {
            "merchant_unique_cards_60m": ("merchant", "d"),
            "merchant_tx_count_60m": ("merchant", "n"),
            "device_unique_cards_60m": ("device", "d"),
            "ip_unique_cards_60m": ("ip", "d"),
        },
    )
    out = txns.join(own, "transaction_id").join(shared, "transaction_id")
    split = (F.col("_split_n") >= 3) & ((F.col("_split_sum") >= p.split_sum * 100) | (F.col("_split_n") >= 8))
    total = (F.col("same_card_same_merchant_sum_60m").cast("decimal(26,0)") / 100).cast("decimal(28,2)")
    out = out.withColumn("split_purchase_suspect", split).withColumn("same_card_same_merchant_sum_60m", total)
    for c in ("same_card_same_device_count_24h", "device_unique_cards_60m", "ip_unique_cards_60m"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("long")))
    return out.drop("_split_n", "_split_sum")


def near_duplicates(txns: DataFrame, name: str = "same_card_same_amount_near_duplicate_24h") -> DataFrame:
    """Flag rows with another row of the same card and merchant within 24 h whose
    amount differs by at most max(1, 2 % of the own amount).

    Rows are put into cells of one day by a little less than one tolerance, so two
    rows of one cell always match and need no comparison. Only a row alone in its
    cell is compared with the neighbour cells, which hold one line per distinct
    amount with its first and last time; no pair list is ever built inside a group.
    """
    a = F.col("amount").cast("double")
    ab = F.when(a < FIRST_LOG_BUCKET, F.floor(a)).otherwise(
        FIRST_LOG_BUCKET + F.floor(F.log(a / FIRST_LOG_BUCKET) / F.log(F.lit(1.019)))
    )
    rows = txns.withColumn("_tb", F.floor(F.col("us") / F.lit(DAY)).cast("long")).withColumn("_ab", ab.cast("long"))
    cell = ["card_id", "merchant_name", "_tb", "_ab"]
    lines = rows.groupBy(*cell, "amount").agg(
        F.count("*").alias("_n"), F.min("us").alias("_lo"), F.max("us").alias("_hi"), F.min("transaction_id").alias("transaction_id")
    )
    cells = lines.groupBy(*cell).agg(
        F.sum("_n").alias("_cell_n"),
        F.first("amount").alias("_a"),
        F.first("_lo").alias("_us"),
        F.first("transaction_id").alias("_id"),
    )
    shifts = F.array(*[F.struct(F.lit(i).alias("dt"), F.lit(j).alias("da")) for i in (-1, 0, 1) for j in range(-2, 3) if (i, j) != (0, 0)])
    probes = (
        cells.filter(F.col("_cell_n") == 1)
        .withColumn("_s", F.explode(shifts))
        .select(
            "card_id",
            "merchant_name",
            (F.col("_tb") + F.col("_s.dt")).alias("_tb"),
            (F.col("_ab") + F.col("_s.da")).alias("_ab"),
            "_a",
            "_us",
            "_id",
        )
    )
    tolerance = F.greatest(F.lit(1).cast("decimal(20,4)"), (F.col("_a") * F.lit(0.02).cast("decimal(4,2)")).cast("decimal(20,4)"))
    near = (
        probes.join(lines.select(*cell, "amount", "_lo", "_hi"), cell)
        .filter(F.abs(F.col("amount") - F.col("_a")) <= tolerance)
        # a line in an earlier day is nearest at its end, in a later day at its start
        .filter(F.least(F.abs(F.col("_lo") - F.col("_us")), F.abs(F.col("_hi") - F.col("_us"))) <= DAY)
        .select(F.col("_id").alias("transaction_id"))
        .distinct()
        .withColumn("_near", F.lit(True))
    )
    crowded = cells.filter(F.col("_cell_n") > 1).select(*cell, F.lit(True).alias("_crowd"))
    return (
        rows.join(crowded, cell, "left")
        .join(near, "transaction_id", "left")
        .withColumn(name, F.coalesce("_crowd", F.lit(False)) | F.coalesce("_near", F.lit(False)))
        .drop("_tb", "_ab", "_crowd", "_near")
    )


def collective_features(txns: DataFrame) -> DataFrame:
    """Arrival-ordered cross-card features: each row sees only rows up to itself."""
    prefix = ip_prefix(F.col("ip_address"))
    t = txns.withColumn("ip_prefix", prefix)
    base, keys = ["transaction_id", "us", "card_id"], ["kind", "key"]
    by_key = {"merchant": F.col("merchant_name"), "device": F.col("device_id"), "ip": F.col("ip_address")}
    args = ("us", "transaction_id", "card_id")
    crowd = by_kind(t, base, {**by_key, "prefix": prefix})
    moving = arrival_frames(crowd, keys, *args, {"d60": HOUR, "d24": DAY}, {"n60": HOUR}, keep=("kind",))
    moved = from_kind(
        moving,
        "transaction_id",
        {
            "_m60": ("merchant", "d60"),
            "_mn60": ("merchant", "n60"),
            "merchant_unique_cards_24h": ("merchant", "d24"),
            "device_unique_cards_24h": ("device", "d24"),
            "ip_unique_cards_24h": ("ip", "d24"),
            "ip_prefix_unique_cards_60m": ("prefix", "d60"),
            "ip_prefix_tx_count_60m": ("prefix", "n60"),
        },
    )
    totals = running_distinct(by_kind(t, base, by_key), keys, *args, "total", keep=("kind",))
    ever = from_kind(totals, "transaction_id", {f"{k}_unique_cards_total": (k, "total") for k in by_key})
    out = t
    for feats in (moved, ever, cluster_counts(t)):
        out = out.join(feats, "transaction_id", "left")
    for c in (
        "device_unique_cards_24h",
        "ip_unique_cards_24h",
        "ip_prefix_unique_cards_60m",
        "ip_prefix_tx_count_60m",
        "device_unique_cards_total",
        "ip_unique_cards_total",
    ):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("long")))
    return burst_flags(out).drop("_m60", "_mn60")


def cluster_counts(txns: DataFrame, rare_at: int = 4) -> DataFrame:
    """Per row: running size of its (merchant, category, country) cluster, rare while small."""
    n = "merchant_category_country_cluster_count"
    keys = ["merchant_name", "merchant_category", "merchant_country"]
    out = running_totals(txns, keys, "us", "transaction_id", {n: F.lit(1).cast("long")})
    return out.withColumn("merchant_category_country_cluster_rarity", F.col(n) <= rare_at)


def burst_flags(df: DataFrame) -> DataFrame:
    """Merchant burst score and sharing flags from the moving and running counts."""
    raw = (F.col("_m60") - 2.0) / 6.0 + (F.col("_mn60") - 3.0) / 18.0
    return (
        df.withColumn("merchant_burst_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4))
        .withColumn("shared_device_with_other_cards", F.col("device_unique_cards_total") > 1)
        .withColumn("shared_ip_with_other_cards", F.col("ip_unique_cards_total") > 1)
        .withColumn("unusual_merchant_hit_by_many_cards", (F.col("_m60") >= 5) & (F.col("_mn60") >= 5))
    )

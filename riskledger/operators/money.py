"""Currency resolution, tax arithmetic and category lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value lists of the category model.
REVENUE_SLUGS = (
    "revenue",
    "income",
    "product-sales",
    "service-revenue",
    "consulting-revenue",
    "subscription-revenue",
    "interest-income",
    "other-income",
)
CONTRA_REVENUE_SLUGS = ("customer-refunds", "chargebacks-disputes")
COGS_PARENT = "cost-of-goods-sold"


def latest_rates(fx: DataFrame) -> DataFrame:
    """Newest rate per (base, target)."""
    return fx.groupBy("base", "target").agg(F.max_by("rate", F.coalesce("updated_at", F.lit("0001-01-01").cast("date"))).alias("rate"))


def with_rate(df: DataFrame, fx: DataFrame, target: str, currency: str = "currency", name: str = "_rate") -> DataFrame:
    """Attach the latest rate from the row's currency to ``target`` (null when none)."""
    # one row per currency code (ISO 4217 has under 200), so a broadcast is bounded
    rates = latest_rates(fx).filter(F.col("target") == target).select(F.col("base").alias("_base"), F.col("rate").alias(name))
    return df.join(F.broadcast(rates), F.col(currency) == F.col("_base"), "left").drop("_base")


def resolve_amount(df: DataFrame, fx: DataFrame, target: str, name: str = "amt") -> DataFrame:
    """Amount in ``target``: base amount, own amount, or amount x latest rate; else null."""
    wide = "decimal(28,10)"
    amt = (
        F.when((F.col("base_currency") == target) & F.col("base_amount").isNotNull(), F.col("base_amount").cast(wide))
        .when(F.col("currency") == target, F.col("amount").cast(wide))
        .otherwise((F.col("amount") * F.col("_rate")).cast(wide))
    )
    return with_rate(df, fx, target).withColumn(name, amt).drop("_rate")


def net_of_tax(gross: Column, rate: Column) -> Column:
    """Gross minus the tax inside it, two decimals."""
    return F.round(gross - (gross * rate / (F.lit(100) + rate)).cast("decimal(28,10)"), 2).cast("decimal(18,2)")


def tax_from_gross(gross: Column, rate: Column) -> Column:
    return F.round(gross * rate / (F.lit(100) + rate), 2).cast("decimal(18,2)")


def gross_from_net(net: Column, rate: Column) -> Column:
    return F.round(net * (F.lit(100) + rate) / F.lit(100), 2).cast("decimal(18,2)")


def rate_from_gross(gross: Column, tax: Column) -> Column:
    """Tax rate in percent implied by a gross amount and its tax part."""
    net = gross - tax
    return F.when(net == 0, F.lit(0)).otherwise(F.round(tax / net * 100, 2)).cast("decimal(18,2)")


def resolve_tax(amount: Column, tax_amount: Column, own_rate: Column, category_rate: Column) -> Column:
    """Tax of a row: given amount, else from its rate, else from the category's rate."""
    return F.coalesce(
        F.abs(tax_amount).cast("decimal(18,2)"),
        tax_from_gross(F.abs(amount), own_rate),
        tax_from_gross(F.abs(amount), category_rate),
    )


def to_base(amount: Column, rate: Column, same: Column) -> Column:
    """Amount in base currency to two decimals; a missing rate counts as 1."""
    return F.round(amount * F.when(same, F.lit(1)).otherwise(F.coalesce(rate, F.lit(1))), 2).cast("decimal(18,2)")


def join_categories(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Left join on slug (and team, when categories carry one); excluded ones drop out.

    A slug missing from the categories keeps its rows.
    """
    keep = [c for c in ("parent_slug", "excluded", "tax_rate", "tax_type") if c in categories.columns]
    cat = categories.select(
        F.col("slug").alias("category_slug"),
        F.lit(True).alias("category_known"),
        *[F.col(c).alias(f"category_{c}") for c in keep],
        *(["team_id"] if "team_id" in categories.columns else []),
    )
    keys = ["category_slug", *(["team_id"] if "team_id" in categories.columns else [])]
    out = rows.join(cat, keys, "left")
    return out.filter(~F.coalesce(F.col("category_excluded"), F.lit(False)))


def uncategorized(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows without a slug or with a slug no category has."""
    known = categories.select(F.col("slug").alias("category_slug"))
    return rows.join(known, "category_slug", "left_anti")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str = "weighted_median") -> DataFrame:
    """Per key: smallest value whose cumulative weight reaches half of the total."""
    lines = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    cum = F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return (
        lines.withColumn("_cum", cum)
        .withColumn("_tot", F.sum("_w").over(w))
        .filter(F.col("_cum") * 2 >= F.col("_tot"))
        .groupBy(*keys)
        .agg(F.min(value).alias(name))
    )

"""The team overview, period activity and what a team's history says about its latest weeks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import round_half_up

D2 = "decimal(28,2)"


def _together(frames: list[DataFrame]) -> DataFrame:
    """Frames of one row per team side by side; absent figures are 0."""
    out = reduce(lambda a, b: a.join(b, "team_id", "full"), frames)
    return out.na.fill(0)


def summary(open_invoices: DataFrame, unbilled: DataFrame, inbox: DataFrame, ready: DataFrame, cash: DataFrame, runway: DataFrame) -> DataFrame:
    """One row per team: open invoices, billable time, pending inbox, rows to export, cash and runway.

    open_invoices: team_id, converted_amount, invoices (per currency); unbilled: team_id, project_id, duration,
    amount; inbox: team_id, status; ready: team_id, ready; cash: team_id, cash (per account); runway: team_id, months.
    """
    return _together(
        [
            open_invoices.groupBy("team_id").agg(F.sum("invoices").alias("open_count"), F.sum("converted_amount").cast(D2).alias("open_amount")),
            unbilled.groupBy("team_id").agg(F.sum("duration").alias("duration"), F.sum("amount").cast(D2).alias("time_amount"), F.count("*").alias("projects")),
            inbox.filter("status = 'pending'").groupBy("team_id").agg(F.count("*").alias("inbox_pending")),
            ready.select("team_id", F.col("ready").alias("to_review")),
            cash.groupBy("team_id").agg(F.sum("cash").cast(D2).alias("cash"), F.count("*").alias("accounts")),
            runway.select("team_id", F.col("months").alias("runway")),
        ]
    )


def activity(invoices: DataFrame, entries: DataFrame, customers: DataFrame, inbox: DataFrame, ledger: DataFrame, start: str, end: str) -> DataFrame:
    """What each team did in a period: invoices, hours, customers, matched inbox items and categorised rows.

    entries: team_id, date, duration, billed, rate. Hours and their value are rounded to one and two decimals.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    within = lambda c: F.col(c).between(lo, hi)
    paid = within("paid_at") & (F.col("status") == "paid")
    open_ = ~F.coalesce("billed", F.lit(False))
    worth = F.when(open_, F.col("duration") * F.coalesce("rate", F.lit(0)) / 3600)
    return _together(
        [
            invoices.groupBy("team_id").agg(
                F.count(F.when(within("issue_date") & (F.col("status") != "draft"), 1)).alias("sent"), F.count(F.when(paid, 1)).alias("paid"), F.max(F.when(paid, F.col("amount"))).alias("largest_payment")
            ),
            entries.filter(within("date")).groupBy("team_id").agg(
                F.round(F.sum("duration") / F.lit(3600).cast("decimal(10,0)"), 1).cast("decimal(18,1)").alias("hours"),
                F.round(F.coalesce(F.sum(F.when(open_, F.col("duration"))), F.lit(0)) / F.lit(3600).cast("decimal(10,0)"), 1).cast("decimal(18,1)").alias("unbilled_hours"),
                F.round(F.sum(worth), 2).cast(D2).alias("billable_amount"),
            ),
            customers.filter(within("created_at")).groupBy("team_id").agg(F.count("*").alias("new_customers")),
            inbox.filter((F.col("status") == "done") & within("created_day")).groupBy("team_id").agg(F.count("*").alias("inbox_matched")),
            ledger.filter(within("date")).groupBy("team_id").agg(F.count("category_slug").alias("categorized"), F.count(F.when(F.col("category_slug").isNull(), 1)).alias("uncategorized")),
        ]
    )


# ---- history: team_id, period (week start), revenue, profit


def _by_week():
    return Window.partitionBy("team_id").orderBy("period")


def paid_on_time(weeks: DataFrame) -> DataFrame:
    """Run of weeks with payments and none late (``paid``, ``late`` counts); weeks without payments do not break it."""
    bad, good = (F.col("paid") > 0) & (F.col("late") > 0), (F.col("paid") > 0) & (F.col("late") == 0)
    island = F.sum(bad.cast("int")).over(_by_week().rowsBetween(Window.unboundedPreceding, 0))
    run = Window.partitionBy("team_id", "_i").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return weeks.withColumn("_i", island).withColumn("paid_on_time", F.sum(good.cast("long")).over(run)).drop("_i")


def recovery(history: DataFrame) -> DataFrame:
    """Growth after falling weeks: how many fell before, by how much it grew, and how strong that is.

    Only weeks with revenue count; the week before must have fallen against the one before it.
    """
    pos = history.filter("revenue > 0")
    before = F.lag("revenue").over(_by_week())
    pos = pos.withColumn("_down", F.coalesce(F.col("revenue") < before, F.lit(False)))
    pos = pos.withColumn("_i", F.sum((~F.col("_down")).cast("int")).over(_by_week().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("team_id", "_i").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    pos = pos.withColumn("_run", F.sum(F.col("_down").cast("long")).over(run))
    pos = pos.withColumns({"_p": F.lag("revenue").over(_by_week()), "down_weeks": F.coalesce(F.lag("_run").over(_by_week()), F.lit(0))})
    back = (F.col("revenue") > F.col("_p")) & (F.col("down_weeks") > 0)
    percent = ((F.col("revenue") - F.col("_p")) / F.col("_p") * 100).cast("double")
    strength = F.when(percent >= 20, "strong").when(percent >= 10, "moderate").otherwise("mild")
    pos = pos.select("team_id", "period", F.coalesce(back, F.lit(False)).alias("is_recovery"), F.when(back, F.col("down_weeks")).otherwise(0).alias("down_weeks"), F.when(back, strength).alias("strength"))
    out = history.join(pos, ["team_id", "period"], "left")
    return out.withColumns({"is_recovery": F.coalesce("is_recovery", F.lit(False)), "down_weeks": F.coalesce("down_weeks", F.lit(0))})


def quarter_pace(history: DataFrame, as_of: str) -> DataFrame:
    """Revenue of the quarter so far, its projection to the quarter's end, and the same quarter of the year before.

    Nothing is projected within the first seven days or without revenue.
    """
    day = F.lit(as_of).cast("date")
    start = F.trunc(day, "QUARTER")
    end = F.date_sub(F.add_months(start, 3), 1)
    elapsed, total = F.datediff(day, start) + 1, F.datediff(end, start) + 1
    iso_year = F.year(F.date_add(F.trunc("period", "WEEK"), 3))
    now_year = F.year(F.date_add(F.trunc(day, "WEEK"), 3))
    this = F.col("period").between(start, day) & (iso_year == now_year)
    last = (F.quarter("period") == F.quarter(day)) & (iso_year == now_year - 1)
    sums = history.groupBy("team_id").agg(F.coalesce(F.sum(F.when(this, F.col("revenue"))), F.lit(0)).cast(D2).alias("qtd_revenue"), F.coalesce(F.sum(F.when(last, F.col("revenue"))), F.lit(0)).cast(D2).alias("last_year_revenue"))
    out = sums.filter((F.col("qtd_revenue") > 0) & (elapsed > 7))
    out = out.withColumn("projected", round_half_up(F.col("qtd_revenue").cast("double") / elapsed * total, 0))
    change = round_half_up((F.col("projected") - F.col("last_year_revenue").cast("double")) / F.col("last_year_revenue").cast("double") * 100, 0)
    return out.withColumn("vs_last_year", F.when(F.col("last_year_revenue") > 0, change).otherwise(0.0))

"""Recurrence dates, projections and the revenue forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import round_half_up
from . import money, reports

D2 = "decimal(28,2)"


def _clamped(month: Column, day: Column) -> Column:
    """The given day of ``month``'s month, or its last day when shorter."""
    return F.date_add(F.trunc(month, "MM"), (F.least(day, F.dayofmonth(F.last_day(month))) - 1).cast("int"))


def next_date(cur: Column, frequency: Column, day: Column, week: Column, interval: Column) -> Column:
    """The scheduled date after ``cur``. Days of the week count from Sunday = 0."""
    dow = F.greatest(F.lit(0), F.least(F.lit(6), F.coalesce(day, F.lit(0))))
    ahead = F.pmod(dow - (F.dayofweek(cur) - 1), F.lit(7))
    weekly = F.date_add(cur, F.when(ahead == 0, 7).otherwise(ahead).cast("int"))
    nxt = F.add_months(cur, 1)
    first = F.trunc(nxt, "MM")
    nth = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(week, F.lit(1))))
    weekday = F.date_add(first, (F.pmod(dow - (F.dayofweek(first) - 1), F.lit(7)) + (nth - 1) * 7).cast("int"))

    def months(n):
        return _clamped(F.add_months(cur, n), F.coalesce(day, F.dayofmonth(cur)))

    return (
        F.when(frequency == "weekly", weekly)
        .when(frequency == "biweekly", F.date_add(cur, 14))
        .when(frequency == "monthly_date", _clamped(nxt, F.coalesce(day, F.lit(1))))
        .when(frequency == "monthly_weekday", weekday)
        .when(frequency == "monthly_last_day", F.last_day(nxt))
        .when(frequency == "quarterly", months(3))
        .when(frequency == "semi_annual", months(6))
        .when(frequency == "annual", months(12))
        .otherwise(F.date_add(cur, F.greatest(F.lit(1), F.coalesce(interval, F.lit(1))).cast("int")))
    )


def upcoming(series: DataFrame, n: int = 12) -> DataFrame:
    """Next ``n`` dates of every series (``start`` is the first), cut by its end rule.

    Dates depend on the date before, so they are folded along the array in the row.
    """
    c = F.col
    day, week, gap = c("frequency_day").cast("int"), c("frequency_week").cast("int"), c("frequency_interval").cast("int")

    def step(dates, _):
        return F.concat(dates, F.array(next_date(F.element_at(dates, -1), c("frequency"), day, week, gap)))

    dates = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.array(c("start")), step)
    out = series.select("*", F.posexplode(dates).alias("k", "date"))
    keep = (
        F.when(c("end_type") == "on_date", c("date") <= c("end_date"))
        .when(c("end_type") == "after_count", F.coalesce("generated", F.lit(0)) + c("k") + 1 <= c("end_count"))
        .otherwise(True)
    )
    return out.filter(keep)


def upcoming_at(series: DataFrame, n: int = 12) -> DataFrame:
    """``upcoming`` for series with ``start_at`` (an instant) and ``timezone``: adds ``at``, the instant of every date.

    Days, month ends and weekdays are those of the series' timezone, and the local time of day of the start is kept over
    changes of the clock; the first date is the start itself, and of a later local time that occurs twice the first counts. The weekday of a month and the last day of a month begin at local midnight after the first date.
    """
    local = F.from_utc_timestamp("start_at", F.col("timezone"))
    timed = series.withColumn("start", F.to_date(local)).withColumn("_tod", F.unix_micros(local) - F.unix_micros(F.to_date(local).cast("timestamp")))
    midnight = F.col("frequency").isin("monthly_weekday", "monthly_last_day") & (F.col("k") > 0)
    day = F.unix_micros(F.col("date").cast("timestamp"))
    at = F.timestamp_micros(day + F.when(midnight, 0).otherwise(F.col("_tod")))
    # a local time that the clock passes twice does not tell which of the two the start was
    instant = F.when(F.col("k") == 0, F.col("start_at")).otherwise(F.to_utc_timestamp(at, F.col("timezone")))
    return upcoming(timed, n).withColumn("at", instant).drop("_tod")


def series_completed(end_type: Column, end_date: Column, end_count: Column, generated: Column, next_at: Column) -> Column:
    return F.when(end_type == "on_date", next_at > end_date).when(end_type == "after_count", generated >= end_count).otherwise(False)


def recurring_invoice_projection(series: DataFrame, as_of: str, months: int) -> DataFrame:
    """Expected recurring invoices per team and coming month."""
    lo = F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), 1)
    dates = upcoming(series, 31 * (months + 1) // 7 + 2).withColumn("month", F.trunc("date", "MM"))
    return dates.filter((F.col("month") >= lo) & (F.col("month") < F.add_months(lo, months))).groupBy("team_id", "month").agg(
        F.sum("amount").cast(D2).alias("amount"), F.count("*").alias("invoices")
    )


def recurring_income(ledger: DataFrame, categories: DataFrame, fx: DataFrame, target: str, as_of: str, months: int) -> DataFrame:
    """Latest recurring income per name in six months, as a monthly amount for each coming month."""
    day = F.lit(as_of).cast("date")
    rows = ledger.filter(
        F.coalesce("recurring", F.lit(False))
        & (F.col("amount") > 0)
        & ~F.col("internal")
        & (F.col("status") != "excluded")
        & F.col("date").between(F.add_months(day, -6), day)
        & ((F.col("currency") == target) | F.coalesce(F.col("base_currency") == target, F.lit(False)))
    )
    rows = money.join_categories(money.resolve_amount(rows, fx, target), categories).filter(F.col("amt").isNotNull())
    last = rows.groupBy("team_id", "name").agg(F.max(F.struct("date", "id", "amt", "frequency")).alias("_l"))
    a, f = F.col("_l.amt"), F.col("_l.frequency")
    factor = F.when(f == "weekly", F.lit("4.33")).when(f == "biweekly", F.lit("2.17")).when(f == "semi_monthly", F.lit("2")).otherwise(F.lit("1")).cast("decimal(4,2)")
    monthly = F.when(f == "annually", (a / 12).cast("decimal(28,8)")).otherwise((a * factor).cast("decimal(28,8)"))
    total = last.groupBy("team_id").agg(F.round(F.sum(monthly), 2).cast(D2).alias("amount"), F.count("*").alias("names"))
    ahead = F.explode(F.sequence(F.lit(1), F.lit(months))).alias("i")
    return total.select("team_id", "amount", "names", ahead).withColumn("month", F.add_months(F.trunc(day, "MM"), F.col("i"))).drop("i")


def new_business(net: DataFrame, recurring_avg: DataFrame) -> DataFrame:
    """Weighted median of six months' income beyond the recurring average; later months weigh more.

    ``net``: team_id, month, value; ``recurring_avg``: team_id, average.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("team_id").orderBy("month")
    x = net.join(recurring_avg, "team_id", "left").withColumn("_v", F.greatest(F.lit(0), F.col("value") - F.coalesce("average", F.lit(0))).cast(D2))
    x = x.withColumn("_w", (F.lit(5) + F.row_number().over(w) - 1).cast("long"))
    return money.weighted_median(x, ["team_id"], "_v", "_w", "baseline")


# Optimistic, pessimistic and confidence factor of every source.
SOURCES = {
    "recurring_invoices": ("1.05", "0.95", 95),
    "recurring_transactions": ("1.10", "0.85", 85),
    "scheduled": ("1.05", "0.90", 90),
    "collections": ("1.20", "0.60", 70),
    "billable_hours": ("1.15", "0.70", 75),
    "new_business": ("1.50", "0.40", 35),
}


def revenue_forecast(teams: DataFrame, as_of: str, months: int, sources: dict[str, DataFrame], baseline: DataFrame) -> DataFrame:
    """Forecast per team and coming month from six sources, with bounds and confidence.

    ``sources[name]``: team_id, month, amount; the new-business baseline decays from
    0.8 to 0.5 over the months.
    """
    day = F.lit(as_of).cast("date")
    grid = teams.select("team_id", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("i")).withColumn("month", F.add_months(F.trunc(day, "MM"), F.col("i")))
    out = grid.join(baseline, "team_id", "left")
    for name in SOURCES:
        if name == "new_business":
            decay = F.greatest(F.lit(50), F.lit(90) - F.col("i") * 10).cast("decimal(4,0)") / 100
            out = out.withColumn(name, F.round(F.coalesce("baseline", F.lit(0)) * decay, 4).cast("decimal(28,4)"))
        elif name in sources:
            part = sources[name].select("team_id", "month", F.col("amount").cast("decimal(28,4)").alias(name))
            out = out.join(part, ["team_id", "month"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("decimal(28,4)"))
        else:
            out = out.withColumn(name, F.lit(0).cast("decimal(28,4)"))

    def total(i):
        s = F.lit(0).cast("decimal(4,2)")
        for name, f in SOURCES.items():
            s = s + F.col(name) * (F.lit(f[i]).cast("decimal(4,2)") if i is not None else F.lit(1))
        return s

    value = total(None)
    conf = F.lit(0.0)
    for name, f in SOURCES.items():
        conf = conf + F.col(name).cast("double") * f[2]
    out = out.withColumn("value", F.round(value, 2).cast(D2)).withColumn("optimistic", F.round(total(0), 2).cast(D2)).withColumn("pessimistic", F.round(total(1), 2).cast(D2))
    out = out.withColumn("confidence", F.when(value > 0, round_half_up(conf / value.cast("double"), 0)).otherwise(0.0).cast("long"))
    overlap = (F.col("recurring_invoices") > 500) & (F.col("recurring_transactions") > 500)
    return out.withColumn("overlap_warning", overlap).drop("i", "baseline")


def combined_series(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actual and forecast months in one series with a type tag."""
    a = actual.select("team_id", "month", "value", F.lit("actual").alias("type"))
    return a.unionByName(forecast.select("team_id", "month", "value", F.lit("forecast").alias("type")))

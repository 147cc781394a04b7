"""Periods, metric changes, anomalies, history and streaks of the weekly insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import round_half_up

# Fixed values.
PERIODIC_CATEGORIES = (
    "payroll", "payroll_tax", "payroll-tax", "payroll_tax_remittances", "payroll-tax-remittances", "taxes", "tax", "income_tax", "sales_tax",
    "insurance", "capital_insurance", "capital-insurance", "health_insurance", "liability_insurance", "subscriptions", "memberships", "software",
    "saas", "telephone", "phone", "internet", "internet-and-telephone", "communications", "fees", "bank_fees", "bank-fees", "transaction_fees",
    "payment_processing", "rent", "utilities", "uncategorized",
)
CORE_METRICS = ("revenue", "expenses", "net_profit", "cash_flow")
PERCENT_METRICS = ("profit_margin",)


def previous_period(day: Column, kind: str) -> tuple[Column, Column]:
    """First and last day of the last complete week (ISO, Monday), month, quarter or year."""
    unit = {"weekly": "WEEK", "monthly": "MONTH", "quarterly": "QUARTER", "yearly": "YEAR"}[kind]
    end = F.date_sub(F.trunc(day, unit), 1)
    return F.trunc(end, unit), end


def period_label(start: Column, kind: str) -> Column:
    if kind == "weekly":
        return F.concat(F.lit("Week "), F.weekofyear(start).cast("string"), F.lit(", "), F.year(F.date_add(start, 3)).cast("string"))
    if kind == "monthly":
        return F.date_format(start, "MMMM yyyy")
    if kind == "quarterly":
        return F.concat(F.lit("Q"), F.quarter(start).cast("string"), F.lit(" "), F.year(start).cast("string"))
    return F.year(start).cast("string")


def metric_bundle(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value, previous) from one-row-per-key figures of two periods.

    Figures: revenue, expenses, net_profit, cash_flow. Expenses of 0 are repaired to
    revenue - profit, and when the two differ by more than 1 the larger one stands.
    """

    def long(df, name):
        implied = F.col("revenue") - F.col("net_profit")
        fixed = F.when(F.col("expenses") == 0, F.greatest(F.lit(0), implied)).when(
            F.abs(F.col("expenses") - implied) > 1, F.greatest("expenses", implied)
        ).otherwise(F.col("expenses"))
        df = df.withColumn("expenses", fixed)
        margin = F.when(F.col("revenue") > 0, F.col("net_profit").cast("double") / F.col("revenue").cast("double") * 100).otherwise(0.0)
        pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in CORE_METRICS]
        pairs.append(F.struct(F.lit("profit_margin").alias("metric"), round_half_up(margin, 2).alias("v")))
        return df.select(*keys, F.explode(F.array(*pairs)).alias("e")).select(*keys, "e.metric", F.col("e.v").alias(name))

    out = long(current, "value").join(long(previous, "previous"), [*keys, "metric"], "full")
    return out.na.fill(0.0, ["value", "previous"])


def with_change(metrics: DataFrame) -> DataFrame:
    """Change in percent (points for percentages), direction and a short description."""
    points = F.col("metric").isin(*PERCENT_METRICS)
    v, p = F.col("value"), F.col("previous")
    raw = F.when(points, v - p).when(p == 0, F.when(v == 0, 0.0).otherwise(100.0)).otherwise((v - p) / F.abs(p) * 100)
    df = metrics.withColumn("_raw", raw).withColumn("change", round_half_up(F.col("_raw"), 1))
    c, size = F.col("change"), F.abs("change")
    flip = ((p > 0) & (v < 0)) | ((p < 0) & (v > 0))
    capped = F.least(round_half_up(size, 0), F.lit(999.0)).cast("long").cast("string")
    sign = F.when(c > 0, "+").otherwise("-")
    text = (
        F.when(points & (size < 1), "flat")
        .when(points, F.concat(F.when(c > 0, "+").otherwise(""), c.cast("decimal(18,1)").cast("string"), F.lit("pp")))
        .when(size < 5, "flat")
        .when((v == 0) & (p != 0), "no activity")
        .when((p == 0) & (v != 0), "new activity")
        .when(flip & (size > 200), F.when(c > 0, "turned positive").otherwise("turned negative"))
        .otherwise(F.concat(sign, capped, F.lit("%")))
    )
    direction = F.when(F.col("_raw") > 0.5, "up").when(F.col("_raw") < -0.5, "down").otherwise("flat")
    return df.withColumn("direction", direction).withColumn("description", text).drop("_raw")


# Labels of the metrics in messages.
LABELS = {
    "revenue": "Revenue", "expenses": "Expenses", "cash_flow": "Cash Flow", "net_profit": "Profit", "profit_margin": "Profit Margin", "runway_months": "Runway", "cash_balance": "Cash Balance",
    "overdue_amount": "Overdue", "invoices_overdue": "Overdue Invoices", "outstanding_ar": "Outstanding", "invoices_sent": "Invoices Sent", "invoices_paid": "Invoices Paid",
    "active_customers": "Active Customers", "new_customers": "New Customers", "hours_tracked": "Hours Tracked", "receipts_matched": "Receipts Matched", "transactions_categorized": "Categorized",
}


def anomalies(metrics: DataFrame) -> DataFrame:
    """Large moves, short runway (three levels), losses, negative cash flow and overdue invoices, with a message."""
    m, v, c = F.col("metric"), F.col("value"), F.col("change")
    cost = m.isin("expenses", "burn_rate")
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), m), m)
    size = round_half_up(F.abs(c), 0).cast("long").cast("string")
    months = v.cast("decimal(18,1)").cast("string")

    def hit(cond, kind, severity, message):
        return F.when(cond, F.struct(kind.alias("anomaly"), severity.alias("severity"), message.alias("message")))

    lit = F.lit
    runway = (
        F.when(v < 2, F.concat(lit("URGENT: Only "), months, lit(" months of runway remaining — prioritize collecting receivables and securing new revenue")))
        .when(v < 3, F.concat(lit("Runway is "), months, lit(" months — focus on cash collection and revenue")))
        .otherwise(F.concat(lit("Runway is "), months, lit(" months")))
    )
    overdue = F.concat(v.cast("long").cast("string"), lit(" overdue invoice"), F.when(v > 1, "s").otherwise(""), lit(" need attention"))
    found = F.array_compact(
        F.array(
            hit(c > 20, F.when(cost, "significant_expense_increase").otherwise("significant_increase"), F.when(cost, "warning").otherwise("info"), F.concat(label, lit(" increased by "), size, lit("%"))),
            hit(c < -20, F.when(cost, "significant_expense_decrease").otherwise("significant_decrease"), F.when(cost, "info").otherwise("warning"), F.concat(label, lit(" decreased by "), size, lit("%"))),
            hit((m == "runway_months") & (v < 6), lit("low_runway"), F.when(v < 3, "alert").otherwise("warning"), runway),
            hit((m == "net_profit") & (v < 0), lit("negative_profit"), lit("warning"), lit("Business is currently unprofitable")),
            hit((m == "cash_flow") & (v < 0), lit("negative_cash_flow"), lit("warning"), lit("Negative cash flow this period")),
            hit((m == "invoices_overdue") & (v > 0), lit("overdue_invoices"), F.when(v > 5, "alert").otherwise("warning"), overdue),
        )
    )
    return metrics.withColumn("_a", F.explode(found)).select(*metrics.columns, "_a.anomaly", "_a.severity", "_a.message")


def _periodic(slug: Column) -> Column:
    s = F.regexp_replace(F.lower(slug), "[-_\\s]", "_")
    out = s.isin(*PERIODIC_CATEGORIES)
    for x in PERIODIC_CATEGORIES:
        out = out | F.contains(s, F.lit(x)) | F.contains(F.lit(x), s)
    return out


def spend_anomalies(current: DataFrame, previous: DataFrame, major=500, minor=50, large=(50, 100), moderate=(30, 50), top: int = 3) -> DataFrame:
    """Largest category changes per team (``team_id, slug, amount``); periodic ones are skipped."""
    p = previous.select("team_id", "slug", F.col("amount").alias("_p"))
    df = current.filter(~_periodic(F.col("slug"))).join(p, ["team_id", "slug"], "left")
    diff = F.col("amount") - F.coalesce("_p", F.lit(0))
    change = F.when(F.col("_p").isNull(), 100.0).when(F.col("_p") > 0, (diff / F.col("_p") * 100).cast("double")).otherwise(F.when(F.col("amount") > 0, 100.0).otherwise(0.0))
    new = F.col("_p").isNull()
    kind = (
        F.when(new & (F.col("amount") >= minor), "new_category")
        .when(~new & (change >= moderate[0]) & (diff >= moderate[1]), "category_spike")
        .when(~new & (change <= -large[0] + 0.0) & (F.abs(diff) >= large[1]), "category_decrease")
    )
    warn = (new & (F.col("amount") >= major)) | (~new & (change >= large[0]) & (diff >= large[1]))
    df = df.withColumn("anomaly", kind).filter(F.col("anomaly").isNotNull()).withColumn("severity", F.when(warn, "warning").otherwise("info"))
    df = df.withColumn("change", round_half_up(change, 0)).withColumn("_d", F.abs(diff))
    w = Window.partitionBy("team_id").orderBy(F.when(F.col("severity") == "warning", 1).otherwise(2), F.desc("_d"), "slug")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("team_id", "slug", "anomaly", "severity", "change", "rank")


# Metric, category, priority, in order.
METRICS = (
    ("revenue", "financial", 1), ("expenses", "financial", 1), ("cash_flow", "financial", 2), ("net_profit", "profitability", 1), ("profit_margin", "profitability", 2), ("runway_months", "runway", 1),
    ("cash_balance", "financial", 2), ("overdue_amount", "receivables", 2), ("invoices_overdue", "invoicing", 5), ("outstanding_ar", "invoicing", 1), ("invoices_sent", "invoicing", 3), ("invoices_paid", "invoicing", 3),
    ("active_customers", "customers", 2), ("new_customers", "customers", 2), ("hours_tracked", "time", 2), ("receipts_matched", "operations", 5), ("transactions_categorized", "operations", 5),
)
# Metrics of a point in time, in the order in which they fill free places.
STATE_METRICS = ("cash_balance", "overdue_amount", "runway_months")


def _by_metric(column: Column, values: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column), F.lit(default))


def metric_score(m: Column, value: Column, previous: Column, change: Column) -> Column:
    """Priority, data, size of the change, alarm and core points of a metric."""
    priority = _by_metric(m, {k: p for k, _, p in METRICS}, 3)
    size = F.abs(change)
    alarm = ((m == "runway_months") & (value < 6)) | ((m == "net_profit") & (value < 0)) | ((m == "cash_flow") & (value < 0))
    return (
        F.greatest(F.lit(10), F.lit(25) - priority * 5)
        + F.when((value != 0) | (previous != 0), 25).otherwise(0)
        + F.when(size > 20, 20).when(size > 10, 12).when(size > 5, 6).otherwise(0)
        + F.when(alarm, 15).otherwise(0)
        + F.when(m.isin(*CORE_METRICS), 10).otherwise(0)
    ).cast("double")


def top_metrics(metrics: DataFrame, per_category: int = 2, n: int = 4) -> DataFrame:
    """The ``n`` most telling metrics per team, at most two of a category.

    Bookkeeping metrics, overdue counts and metrics without data stay out (point-in-time ones may be
    zero). Without a core metric among them the first core one takes the last one's place, at the front;
    free places are filled with point-in-time metrics. A team has some twenty metrics at most.
    """
    m, v = F.col("metric"), F.col("value")
    place = _by_metric(m, {k: i for i, (k, _, _) in enumerate(METRICS)}, len(METRICS))
    df = metrics.withColumns({"category": _by_metric(m, {k: c for k, c, _ in METRICS}, "other"), "_place": place, "_core": m.isin(*CORE_METRICS).cast("int"), "_fill": _by_metric(m, {k: i for i, k in enumerate(STATE_METRICS)}, 99)})
    df = df.withColumn("score", metric_score(m, v, F.col("previous"), F.col("change")))
    state = F.col("_fill") < 99
    df = df.withColumn("_in", (m != "invoices_overdue") & (F.col("category") != "operations") & ((v != 0) | (F.coalesce("previous", F.lit(0.0)) != 0) | state))
    in_category = F.row_number().over(Window.partitionBy("team_id", "category").orderBy(F.desc("_in"), F.desc("score"), "_place"))
    df = df.withColumn("_ok", F.col("_in") & (in_category <= per_category))
    team = Window.partitionBy("team_id")
    df = df.withColumn("_pos", F.when(F.col("_ok"), F.row_number().over(team.orderBy(F.desc("_ok"), F.desc("score"), "_place"))))
    df = df.withColumn("_sel", F.coalesce(F.col("_pos") <= n, F.lit(False)))
    df = df.withColumns({"_has": F.max(F.when(F.col("_sel"), F.col("_core"))).over(team), "_n": F.sum(F.col("_sel").cast("int")).over(team), "_first": F.min(F.when(F.col("_in") & (F.col("_core") == 1), F.col("_place"))).over(team)})
    swap = (F.coalesce("_has", F.lit(0)) == 0) & F.col("_first").isNotNull() & (F.col("_n") > 0)
    df = df.withColumn("_pos", F.when(swap & (F.col("_place") == F.col("_first")), 0).when(swap & (F.col("_pos") == F.col("_n")), None).when(F.col("_sel"), F.col("_pos")))
    filler = F.when(F.col("_pos").isNull() & state, F.lit(100) + F.col("_fill"))
    df = df.withColumn("_pos", F.coalesce("_pos", filler)).filter(F.col("_pos").isNotNull())
    return df.withColumn("rank", F.row_number().over(team.orderBy("_pos"))).filter(F.col("rank") <= n).select(*metrics.columns, "category", "score", "rank")


# ---- history (team_id, period (week start), revenue, profit)


def _by_week():
    return Window.partitionBy("team_id").orderBy("period")


def rolling_mean(history: DataFrame, periods: int = 4) -> DataFrame:
    """Mean revenue of the preceding periods."""
    w = _by_week().rowsBetween(-periods, -1)
    return history.withColumn("rolling", F.round(F.avg("revenue").over(w), 2).cast("decimal(28,2)"))


def streaks(history: DataFrame) -> DataFrame:
    """Current run of growth, decline and profit at every period, with the one to report."""
    w = _by_week()
    prev = F.lag("revenue").over(w)
    df = history.withColumns({"_up": F.coalesce(F.col("revenue") > prev, F.lit(False)), "_down": F.coalesce(F.col("revenue") < prev, F.lit(False)), "_pos": F.col("profit") > 0})
    for name, c in (("growth", "_up"), ("decline", "_down"), ("profitable", "_pos")):
        island = F.sum(F.when(F.col(c), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("_i", island)
        run = Window.partitionBy("team_id", "_i").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(name, F.sum(F.col(c).cast("long")).over(run))
    kind = F.when(F.col("growth") >= 2, "revenue_growth").when(F.col("profitable") >= 3, "profitable").when(F.col("decline") >= 2, "revenue_decline")
    return df.withColumn("streak", kind).drop("_up", "_down", "_pos", "_i")


def momentum(history: DataFrame) -> DataFrame:
    """Growth and its change against the period before: accelerating, decelerating, steady."""
    w = _by_week()
    prev = F.lag("revenue").over(w)
    growth = F.when(prev > 0, round_half_up((F.col("revenue") - prev).cast("double") / prev.cast("double") * 100, 2))
    df = history.withColumn("growth_rate", growth)
    before = F.lag("growth_rate").over(w)
    delta = F.col("growth_rate") - before
    state = F.when(delta.isNull(), None).when(delta > 5, "accelerating").when(delta < -5, "decelerating").otherwise("steady")
    return df.withColumn("momentum", state)


def rank_in_history(history: DataFrame) -> DataFrame:
    """Rank of each period's revenue among itself and the periods before it."""
    a = history.select("team_id", F.col("period").alias("p"), F.col("revenue").alias("r"))
    # a team has at most 53 periods a year, so this self-join stays small per team
    higher = history.join(a, "team_id").filter((F.col("p") < F.col("period")) & (F.col("r") > F.col("revenue"))).groupBy("team_id", "period").agg(
        F.count("*").alias("_n"), F.max("p").alias("highest_since")
    )
    return history.join(higher, ["team_id", "period"], "left").withColumn("revenue_rank", F.coalesce("_n", F.lit(0)) + 1).drop("_n")


def year_ago(history: DataFrame) -> DataFrame:
    """Revenue of the same ISO week of the year before and the change in percent."""
    y, n = F.year(F.date_add("period", 3)), F.weekofyear("period")
    h = history.withColumn("_y", y).withColumn("_n", n)
    old = h.select("team_id", (F.col("_y") + 1).alias("_y"), "_n", F.col("revenue").alias("year_ago"))
    out = h.join(old, ["team_id", "_y", "_n"], "left")
    change = F.when(F.col("year_ago") > 0, round_half_up((F.col("revenue") - F.col("year_ago")).cast("double") / F.col("year_ago").cast("double") * 100, 1))
    return out.withColumn("change", change).drop("_y", "_n")


def data_sufficiency(teams: DataFrame, txns: DataFrame, invoices: DataFrame, synced: DataFrame, start: str, end: str) -> DataFrame:
    """Whether a team has enough rows in the period and a fresh bank sync, with the reason to skip."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    t = txns.filter(F.col("date").between(lo, hi)).groupBy("team_id").agg(F.count("*").alias("transactions"))
    i = invoices.filter(F.col("issue_date").between(lo, hi)).groupBy("team_id").agg(F.count("*").alias("invoices"))
    s = synced.groupBy("team_id").agg(F.max("synced_at").alias("_s"))
    df = teams.join(t, "team_id", "left").join(i, "team_id", "left").join(s, "team_id", "left").na.fill(0, ["transactions", "invoices"])
    stale = F.col("_s").isNotNull() & (F.datediff(hi, "_s") > 7)
    reason = F.when(F.col("transactions") + F.col("invoices") < 3, "insufficient_data").when(stale, "stale_sync")
    return df.withColumn("skip_reason", reason).drop("_s")


def months_held(start: Column, as_of: Column, cap: int) -> Column:
    """Whole months between month starts, capped (depreciation and loan ageing)."""
    n = F.floor(F.months_between(F.trunc(as_of, "MM"), F.trunc(start, "MM")))
    return F.greatest(F.lit(0), F.least(F.lit(cap), n)).cast("int")

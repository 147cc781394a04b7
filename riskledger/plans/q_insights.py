"""Forecasts, insights and extraction checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import extraction, forecast, insights, money, reports
from ..operators import invoices as inv
from .q_billing import invoices as billed
from .q_reports import _posted, _totals, rnd
from .registry import query
from .views_sql import view

AS_OF = "1999-06-15"
view("v_week", "v_posted", "SELECT team_id, date_trunc('week', date)::DATE AS period, CAST(round(sum(CASE WHEN amt > 0 THEN amt ELSE 0 END), 2) AS DECIMAL(28,2)) AS revenue, CAST(round(sum(amt), 2) AS DECIMAL(28,2)) AS profit FROM v_posted WHERE amt IS NOT NULL GROUP BY 1, 2")


def _weeks(spark, sf):
    rows = _posted(spark, sf).filter(F.col("amt").isNotNull())
    return rows.groupBy("team_id", F.trunc("date", "week").alias("period")).agg(
        F.round(F.sum(F.when(F.col("amt") > 0, F.col("amt")).otherwise(0)), 2).cast("decimal(28,2)").alias("revenue"), F.round(F.sum("amt"), 2).cast("decimal(28,2)").alias("profit")
    )


@query(
    "insight_rolling_mean",
    "WIN-13",
    "SELECT team_id, period, CAST(round(CAST(sum(revenue) OVER w / count(*) OVER w AS DECIMAL(28,8)), 2) AS DECIMAL(28,2)) AS rolling FROM v_week WINDOW w AS (PARTITION BY team_id ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)",
    "v_week",
)
def insight_rolling_mean(spark, sf):
    return insights.rolling_mean(_weeks(spark, sf)).select("team_id", "period", "rolling")


def _run(flag, name):
    return f"(SELECT team_id, period, sum(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER (PARTITION BY team_id, isl ORDER BY period) AS {name} FROM (SELECT *, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY team_id ORDER BY period) AS isl FROM f))"


@query(
    "insight_streaks",
    "WIN-14",
    f"""WITH f AS (SELECT *, coalesce(revenue > lag(revenue) OVER w, FALSE) AS up, coalesce(revenue < lag(revenue) OVER w, FALSE) AS down, profit > 0 AS pos FROM v_week WINDOW w AS (PARTITION BY team_id ORDER BY period))
    SELECT team_id, period, growth, decline, profitable, CASE WHEN growth >= 2 THEN 'revenue_growth' WHEN profitable >= 3 THEN 'profitable' WHEN decline >= 2 THEN 'revenue_decline' END AS streak
    FROM {_run('up', 'growth')} JOIN {_run('down', 'decline')} USING (team_id, period) JOIN {_run('pos', 'profitable')} USING (team_id, period)""",
    "v_week",
)
def insight_streaks(spark, sf):
    return insights.streaks(_weeks(spark, sf)).select("team_id", "period", "growth", "decline", "profitable", "streak")


@query(
    "insight_momentum",
    "WIN-15",
    f"""SELECT team_id, period, g AS growth_rate, CASE WHEN g - lag(g) OVER w > 5 THEN 'accelerating' WHEN g - lag(g) OVER w < -5 THEN 'decelerating' WHEN g - lag(g) OVER w IS NOT NULL THEN 'steady' END AS momentum
    FROM (SELECT *, CASE WHEN lag(revenue) OVER w > 0 THEN {rnd('(revenue - lag(revenue) OVER w)::DOUBLE / (lag(revenue) OVER w)::DOUBLE * 100', 2)} END AS g FROM v_week WINDOW w AS (PARTITION BY team_id ORDER BY period)) WINDOW w AS (PARTITION BY team_id ORDER BY period)""",
    "v_week",
)
def insight_momentum(spark, sf):
    return insights.momentum(_weeks(spark, sf)).select("team_id", "period", "growth_rate", "momentum")


@query(
    "insight_history_rank",
    "WIN-15",
    "SELECT team_id, period, (SELECT count(*) + 1 FROM v_week b WHERE b.team_id = a.team_id AND b.period < a.period AND b.revenue > a.revenue) AS revenue_rank, (SELECT max(b.period) FROM v_week b WHERE b.team_id = a.team_id AND b.period < a.period AND b.revenue > a.revenue) AS highest_since FROM v_week a",
    "v_week",
)
def insight_history_rank(spark, sf):
    return insights.rank_in_history(_weeks(spark, sf)).select("team_id", "period", "revenue_rank", "highest_since")


@query(
    "insight_year_ago",
    "JON-15 FN-22",
    f"""SELECT a.team_id, a.period, b.revenue AS year_ago, CASE WHEN b.revenue > 0 THEN {rnd('(a.revenue - b.revenue)::DOUBLE / b.revenue::DOUBLE * 100', 1)} END AS change FROM v_week a LEFT JOIN v_week b ON a.team_id = b.team_id
    AND isoyear(b.period) = isoyear(a.period) - 1 AND week(b.period) = week(a.period)""",
    "v_week",
)
def insight_year_ago(spark, sf):
    return insights.year_ago(_weeks(spark, sf)).select("team_id", "period", "year_ago", "change")


view(
    "v_metric",
    "v_monthly",
    f"""SELECT team_id, month, m.metric, CASE m.metric WHEN 'revenue' THEN net_revenue::DOUBLE WHEN 'expenses' THEN ex::DOUBLE WHEN 'net_profit' THEN p::DOUBLE WHEN 'cash_flow' THEN (income - expenses)::DOUBLE ELSE CASE WHEN net_revenue > 0 THEN {rnd('p::DOUBLE / net_revenue::DOUBLE * 100', 2)} ELSE 0 END END AS value
  FROM (SELECT *, CASE WHEN expenses = 0 THEN greatest(0, net_revenue - p) WHEN abs(expenses - (net_revenue - p)) > 1 THEN greatest(expenses, net_revenue - p) ELSE expenses END AS ex FROM (SELECT *, net_revenue - cogs - operating_expenses AS p FROM v_monthly)),
  (VALUES ('revenue'), ('expenses'), ('net_profit'), ('cash_flow'), ('profit_margin')) m(metric)""",
)
_CH = rnd("CASE WHEN metric = 'profit_margin' THEN value - previous WHEN previous = 0 THEN CASE WHEN value = 0 THEN 0 ELSE 100 END ELSE (value - previous) / abs(previous) * 100 END", 1)
view(
    "v_change",
    "v_metric",
    f"""SELECT *, CASE WHEN metric = 'profit_margin' THEN CASE WHEN abs(change) < 1 THEN 'flat' ELSE CASE WHEN change > 0 THEN '+' ELSE '' END || CAST(CAST(change AS DECIMAL(18,1)) AS VARCHAR) || 'pp' END WHEN abs(change) < 5 THEN 'flat' WHEN value = 0 AND previous <> 0 THEN 'no activity' WHEN previous = 0 AND value <> 0 THEN 'new activity'
   WHEN ((previous > 0 AND value < 0) OR (previous < 0 AND value > 0)) AND abs(change) > 200 THEN CASE WHEN change > 0 THEN 'turned positive' ELSE 'turned negative' END ELSE CASE WHEN change > 0 THEN '+' ELSE '-' END || CAST(least(999, CAST({rnd('abs(change)', 0)} AS BIGINT)) AS VARCHAR) || '%' END AS description
   FROM (SELECT *, {_CH} AS change FROM (SELECT a.team_id, a.metric, a.value, b.value AS previous FROM v_metric a JOIN v_metric b USING (team_id, metric) WHERE a.month = DATE '1999-05-01' AND b.month = DATE '1999-04-01'))""",
)


def _metrics(spark, sf):
    t = _totals(spark, sf)
    p = F.col("net_revenue") - F.col("cogs") - F.col("operating_expenses")
    f = t.select("team_id", "month", F.col("net_revenue").alias("revenue"), F.col("expenses"), p.alias("net_profit"), (F.col("income") - F.col("expenses")).alias("cash_flow"))
    one = lambda m: f.filter(F.col("month") == F.lit(m).cast("date")).drop("month")
    return insights.with_change(insights.metric_bundle(one("1999-05-01"), one("1999-04-01"), ["team_id"]))


@query("insight_metrics", "AGG-56 FN-23", "SELECT team_id, metric, round(value, 4) AS value, round(previous, 4) AS previous, change, description FROM v_change", "v_change")
def insight_metrics(spark, sf):
    return _metrics(spark, sf).select("team_id", "metric", F.round("value", 4).alias("value"), F.round("previous", 4).alias("previous"), "change", "description")


view(
    "v_alarm",
    "v_change v_cash v_monthly v_inv",
    """SELECT team_id, metric, value, change FROM v_change UNION ALL SELECT c.team_id, 'runway_months', (coalesce(floor(cash::DOUBLE / med + 0.5), 0) - c.team_id * 7)::DOUBLE, 0
  FROM (SELECT team_id, sum(cash) AS cash FROM v_cash WHERE type IN ('depository','other_asset') GROUP BY 1) c LEFT JOIN (SELECT team_id, median(expenses::DOUBLE) AS med FROM v_monthly WHERE month BETWEEN DATE '1999-03-01' AND DATE '1999-05-31' AND expenses > 0 GROUP BY 1) b USING (team_id)
  UNION ALL SELECT team_id, 'invoices_overdue', count(*)::DOUBLE, 0 FROM v_inv WHERE status = 'overdue' GROUP BY 1""",
)


@query(
    "insight_anomalies",
    "FN-24",
    """WITH n AS (SELECT *, CASE metric WHEN 'revenue' THEN 'Revenue' WHEN 'expenses' THEN 'Expenses' WHEN 'cash_flow' THEN 'Cash Flow' WHEN 'net_profit' THEN 'Profit' ELSE 'Profit Margin' END AS label, CAST(CAST(floor(abs(change) + 0.5) AS BIGINT) AS VARCHAR) AS size, CAST(CAST(value AS DECIMAL(18,1)) AS VARCHAR) AS x FROM v_alarm)
    SELECT team_id, metric, CASE WHEN metric = 'expenses' THEN 'significant_expense_increase' ELSE 'significant_increase' END AS anomaly, CASE WHEN metric = 'expenses' THEN 'warning' ELSE 'info' END AS severity, label || ' increased by ' || size || '%' AS message FROM n WHERE change > 20
    UNION ALL SELECT team_id, metric, CASE WHEN metric = 'expenses' THEN 'significant_expense_decrease' ELSE 'significant_decrease' END, CASE WHEN metric = 'expenses' THEN 'info' ELSE 'warning' END, label || ' decreased by ' || size || '%' FROM n WHERE change < -20
    UNION ALL SELECT team_id, metric, 'low_runway', CASE WHEN value < 3 THEN 'alert' ELSE 'warning' END, CASE WHEN value < 2 THEN 'URGENT: Only ' || x || ' months of runway remaining — prioritize collecting receivables and securing new revenue' WHEN value < 3 THEN 'Runway is ' || x || ' months — focus on cash collection and revenue' ELSE 'Runway is ' || x || ' months' END FROM n WHERE metric = 'runway_months' AND value < 6
    UNION ALL SELECT team_id, metric, 'negative_profit', 'warning', 'Business is currently unprofitable' FROM n WHERE metric = 'net_profit' AND value < 0 UNION ALL SELECT team_id, metric, 'negative_cash_flow', 'warning', 'Negative cash flow this period' FROM n WHERE metric = 'cash_flow' AND value < 0
    UNION ALL SELECT team_id, metric, 'overdue_invoices', CASE WHEN value > 5 THEN 'alert' ELSE 'warning' END, CAST(CAST(value AS BIGINT) AS VARCHAR) || ' overdue invoice' || CASE WHEN value > 1 THEN 's' ELSE '' END || ' need attention' FROM n WHERE metric = 'invoices_overdue' AND value > 0""",
    "v_alarm",
)
def insight_anomalies(spark, sf):
    cash = reports.cash_balance(v.account(spark, sf), "USD", v.fx(spark))
    months = reports.runway(reports.burn_rate(_totals(spark, sf)), cash, AS_OF)
    # teams lie seven months apart, so that every level of the runway is met
    runway = months.select("team_id", F.lit("runway_months").alias("metric"), (F.col("months") - F.col("team_id") * 7).cast("double").alias("value"), F.lit(0.0).alias("change"))
    overdue = billed(spark, sf).filter("status = 'overdue'").groupBy("team_id").agg(F.count("*").cast("double").alias("value")).select("team_id", F.lit("invoices_overdue").alias("metric"), "value", F.lit(0.0).alias("change"))
    rows = _metrics(spark, sf).select("team_id", "metric", "value", "change").unionByName(runway).unionByName(overdue)
    return insights.anomalies(rows).select("team_id", "metric", "anomaly", "severity", "message")


_SCORED = """SELECT *, row_number() OVER (PARTITION BY team_id, category ORDER BY score DESC, place) AS rc FROM (SELECT *, greatest(10, 25 - 5 * priority) + CASE WHEN value <> 0 OR previous <> 0 THEN 25 ELSE 0 END
  + CASE WHEN abs(change) > 20 THEN 20 WHEN abs(change) > 10 THEN 12 WHEN abs(change) > 5 THEN 6 ELSE 0 END + CASE WHEN metric IN ('net_profit', 'cash_flow') AND value < 0 THEN 15 ELSE 0 END + CASE WHEN metric <> 'profit_margin' THEN 10 ELSE 0 END AS score
  FROM v_change JOIN (VALUES ('revenue', 'financial', 1, 1), ('expenses', 'financial', 1, 2), ('cash_flow', 'financial', 2, 3), ('net_profit', 'profitability', 1, 4), ('profit_margin', 'profitability', 2, 5)) d(m, category, priority, place) ON metric = m
  WHERE value <> 0 OR previous <> 0)"""


@query("insight_top_metrics", "SRT-09", f"SELECT team_id, metric, score::DOUBLE AS score, row_number() OVER (PARTITION BY team_id ORDER BY score DESC, place) AS rank FROM ({_SCORED}) WHERE rc <= 2 QUALIFY rank <= 4", "v_change")
def insight_top_metrics(spark, sf):
    return insights.top_metrics(_metrics(spark, sf)).select("team_id", "metric", "score", "rank")


def _spent(lo, hi):
    return f"(SELECT team_id, CASE WHEN known THEN category_slug ELSE 'uncategorized' END AS slug, CAST(round(sum(-amt), 2) AS DECIMAL(28,2)) AS amount FROM v_posted WHERE amt < 0 AND date BETWEEN DATE '{lo}' AND DATE '{hi}' GROUP BY 1, 2)"


@query(
    "insight_spend_anomalies",
    "FN-25",
    f"""SELECT team_id, slug, anomaly, severity, change, rank FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY severity <> 'warning', d DESC, slug) AS rank FROM (SELECT team_id, slug, abs(diff) AS d, {rnd('pct', 0)} AS change,
      CASE WHEN p IS NULL THEN CASE WHEN amount >= 50 THEN 'new_category' END WHEN pct >= 30 AND diff >= 50 THEN 'category_spike' WHEN pct <= -50 AND abs(diff) >= 100 THEN 'category_decrease' END AS anomaly,
      CASE WHEN p IS NULL AND amount >= 500 OR p IS NOT NULL AND pct >= 50 AND diff >= 100 THEN 'warning' ELSE 'info' END AS severity
      FROM (SELECT a.team_id, a.slug, a.amount, b.amount AS p, a.amount - coalesce(b.amount, 0) AS diff, CASE WHEN b.amount IS NULL THEN 100 WHEN b.amount > 0 THEN CAST((a.amount - b.amount) / b.amount * 100 AS DOUBLE) WHEN a.amount > 0 THEN 100 ELSE 0 END AS pct
        FROM {_spent('1999-05-01', '1999-05-31')} a LEFT JOIN {_spent('1999-04-01', '1999-04-30')} b ON a.team_id = b.team_id AND a.slug = b.slug WHERE a.slug <> 'uncategorized')) WHERE anomaly IS NOT NULL) WHERE rank <= 3""",
    "v_posted",
)
def insight_spend_anomalies(spark, sf):
    now = reports.spending(_posted(spark, sf, "1999-05-01", "1999-05-31"))
    old = reports.spending(_posted(spark, sf, "1999-04-01", "1999-04-30"))
    return insights.spend_anomalies(now, old)


@query(
    "insight_data_gate",
    "FLT-15",
    """SELECT t.team_id, coalesce(n, 0) AS transactions, coalesce(m, 0) AS invoices, CASE WHEN coalesce(n, 0) + coalesce(m, 0) < 3 THEN 'insufficient_data' END AS skip_reason FROM (SELECT DISTINCT team_id FROM v_account) t
    LEFT JOIN (SELECT team_id, count(*) AS n FROM v_ledger WHERE date BETWEEN DATE '1999-05-01' AND DATE '1999-05-07' GROUP BY 1) a ON a.team_id = t.team_id LEFT JOIN (SELECT team_id, count(*) AS m FROM v_inv WHERE issue_date BETWEEN DATE '1999-05-01' AND DATE '1999-05-07' GROUP BY 1) b ON b.team_id = t.team_id""",
    "v_account v_ledger v_inv",
)
def insight_data_gate(spark, sf):
    teams = v.account(spark, sf).select("team_id").distinct()
    synced = teams.withColumn("synced_at", F.lit("1999-05-05").cast("date"))
    return insights.data_sufficiency(teams, v.ledger(spark, sf), billed(spark, sf), synced, "1999-05-01", "1999-05-07")


@query(
    "period_activity",
    "AGG-40 AGG-43",
    """SELECT team_id, count(CASE WHEN issue_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' AND status <> 'draft' THEN 1 END) AS sent, count(CASE WHEN paid_at BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' THEN 1 END) AS paid,
    max(CASE WHEN paid_at BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' THEN amount END) AS largest_payment FROM v_inv GROUP BY 1""",
    "v_inv",
)
def period_activity(spark, sf):
    lo, hi = F.lit("1996-01-01").cast("date"), F.lit("1996-03-31").cast("date")
    paid = F.col("paid_at").between(lo, hi)
    return billed(spark, sf).groupBy("team_id").agg(
        F.count(F.when(F.col("issue_date").between(lo, hi) & (F.col("status") != "draft"), 1)).alias("sent"), F.count(F.when(paid, 1)).alias("paid"), F.max(F.when(paid, F.col("amount"))).alias("largest_payment")
    )


@query(
    "months_held",
    "WIN-18",
    "SELECT id, least(60, greatest(0, datediff('month', date_trunc('month', date), DATE '1999-06-01'))) AS months FROM v_ledger",
    "v_ledger",
)
def months_held(spark, sf):
    return v.ledger(spark, sf).select("id", insights.months_held(F.col("date"), F.lit(AS_OF).cast("date"), 60).alias("months"))


# ---- forecast

view(
    "v_income",
    "v_resolved v_category",
    """SELECT team_id, CAST(round(sum(m), 2) AS DECIMAL(28,2)) AS amount, count(*) AS names FROM (SELECT team_id, CAST(CASE f WHEN 'weekly' THEN a * 4.33 WHEN 'annually' THEN CAST(a / 12 AS DECIMAL(28,8)) ELSE a END AS DECIMAL(28,8)) AS m FROM (SELECT team_id, name, arg_max(amt, (date, r.id)) AS a, arg_max(frequency, (date, r.id)) AS f
  FROM v_resolved r LEFT JOIN v_category c ON r.category_slug = c.slug WHERE recurring AND amount > 0 AND NOT internal AND status <> 'excluded' AND date BETWEEN DATE '1995-12-30' AND DATE '1996-06-30' AND (currency = 'USD' OR base_currency = 'USD') AND NOT coalesce(c.excluded, FALSE) AND amt IS NOT NULL GROUP BY 1, 2)) GROUP BY 1""",
)


def _income(spark, sf):
    return forecast.recurring_income(v.ledger(spark, sf), v.category(spark), v.fx(spark), "USD", "1996-06-30", 3)


@query("forecast_recurring_income", "AGG-18", "SELECT team_id, amount, names, (DATE '1996-06-01' + to_months(CAST(i AS INT)))::DATE AS month FROM v_income, range(1, 4) t(i)", "v_income")
def forecast_recurring_income(spark, sf):
    return _income(spark, sf)


_MB = "(SELECT team_id, CAST(sum(net_revenue) / 36 AS DECIMAL(28,2)) AS average FROM v_monthly GROUP BY 1)"
view(
    "v_baseline",
    "v_monthly",
    """SELECT team_id, min(x) AS baseline FROM (SELECT *, sum(w) OVER (PARTITION BY team_id ORDER BY x, month) AS cum, sum(w) OVER (PARTITION BY team_id) AS tot FROM (SELECT team_id, month, CAST(greatest(0, net_revenue - 1000) AS DECIMAL(28,2)) AS x, 4 + row_number() OVER (PARTITION BY team_id ORDER BY month) AS w
  FROM v_monthly WHERE month BETWEEN DATE '1999-01-01' AND DATE '1999-06-01')) WHERE cum * 2 >= tot GROUP BY 1""",
)


def _baseline(spark, sf):
    net = reports.revenue(_totals(spark, sf), "net").filter(F.col("month").between(F.lit("1999-01-01").cast("date"), F.lit("1999-06-01").cast("date")))
    avg = net.select("team_id").distinct().withColumn("average", F.lit(1000).cast("decimal(28,2)"))
    return forecast.new_business(net, avg)


@query("forecast_new_business", "AGG-21 AGG-22", "SELECT * FROM v_baseline", "v_baseline")
def forecast_new_business(spark, sf):
    return _baseline(spark, sf)


view(
    "v_forecast",
    "v_baseline v_expected",
    """SELECT team_id, (DATE '2000-09-01' + to_months(CAST(i AS INT)))::DATE AS month, CASE i WHEN 1 THEN coalesce(month1, 0) WHEN 2 THEN coalesce(month2, 0) ELSE 0 END AS col, CAST(round(baseline * (greatest(50, 90 - i * 10) * 0.01), 4) AS DECIMAL(28,4)) AS nb FROM v_baseline LEFT JOIN v_expected USING (team_id), range(1, 5) t(i)""",
)


def _forecast(spark, sf):
    as_of = "2000-09-15"
    from .q_billing import AS_OF as day, invoice_collection_metrics

    exp = inv.expected_collections(billed(spark, sf), invoice_collection_metrics(spark, sf), day)
    first = F.trunc(F.lit(as_of).cast("date"), "MM")
    col = exp.select("team_id", F.add_months(first, 1).alias("month"), F.col("month1").alias("amount")).unionByName(exp.select("team_id", F.add_months(first, 2).alias("month"), F.col("month2").alias("amount")))
    base = _baseline(spark, sf)
    return forecast.revenue_forecast(base.select("team_id"), as_of, 4, {"collections": col}, base)


@query(
    "forecast_revenue",
    "AGG-23",
    f"""SELECT team_id, month, CAST(round(col + nb, 2) AS DECIMAL(28,2)) AS value, CAST(round(col * 1.2 + nb * 1.5, 2) AS DECIMAL(28,2)) AS optimistic, CAST(round(col * 0.6 + nb * 0.4, 2) AS DECIMAL(28,2)) AS pessimistic, CAST(CASE WHEN col + nb > 0 THEN {rnd('(col::DOUBLE * 70 + nb::DOUBLE * 35) / (col + nb)::DOUBLE', 0)} ELSE 0 END AS BIGINT) AS confidence FROM v_forecast""",
    "v_forecast",
)
def forecast_revenue(spark, sf):
    return _forecast(spark, sf).select("team_id", "month", "value", "optimistic", "pessimistic", "confidence")


@query(
    "forecast_combined",
    "SET-01",
    "SELECT team_id, month, net_revenue AS value, 'actual' AS type FROM v_monthly UNION ALL SELECT team_id, month, CAST(round(col + nb, 2) AS DECIMAL(28,2)), 'forecast' FROM v_forecast",
    "v_monthly v_forecast",
)
def forecast_combined(spark, sf):
    return forecast.combined_series(reports.revenue(_totals(spark, sf), "net"), _forecast(spark, sf))


def _series(spark, sf):
    i = v.invoice(spark, sf).filter(F.col("invoice_recurring_id").isNotNull())
    team = v.customer(spark, sf).select(F.col("id").alias("customer_id"), "team_id")
    k = F.col("id")
    return i.join(team, "customer_id").select(
        "id", "team_id", "amount", F.col("issue_date").alias("start"), F.when(k % 2 == 0, "monthly_date").otherwise("weekly").alias("frequency"), F.when(k % 2 == 0, 31).otherwise((k % 7).cast("int")).alias("frequency_day"),
        F.lit(None).cast("int").alias("frequency_week"), F.lit(None).cast("int").alias("frequency_interval"), F.when(k % 3 == 0, "after_count").otherwise("never").alias("end_type"), F.lit(None).cast("date").alias("end_date"), F.lit(5).alias("end_count"), F.lit(2).alias("generated"),
    )


view(
    "v_dates",
    "v_inv0",
    """SELECT id, team_id, amount, k, CASE WHEN k = 0 THEN issue_date WHEN id % 2 = 0 THEN last_day(date_trunc('month', issue_date)::DATE + to_months(CAST(k AS INT))) ELSE CAST(issue_date + CAST(CASE WHEN (id % 7 - dayofweek(issue_date) + 7) % 7 = 0 THEN 7 ELSE (id % 7 - dayofweek(issue_date) + 7) % 7 END + 7 * (k - 1) AS INT) AS DATE) END::DATE AS date
  FROM v_inv0, range(6) t(k) WHERE invoice_recurring_id IS NOT NULL AND (id % 3 <> 0 OR k < 3)""",
)


@query("forecast_recurrence_dates", "FN-18", "SELECT id, k, date FROM v_dates", "v_dates")
def forecast_recurrence_dates(spark, sf):
    return forecast.upcoming(_series(spark, sf), 6).select("id", "k", "date")


_ZONES = ("America/New_York", "Europe/Berlin", "Asia/Tokyo", "UTC")


@query(
    "forecast_recurrence_instants",
    "FN-18",
    f"""WITH s AS (SELECT *, timezone(zone, timezone('UTC', issue_date + to_hours(CAST(id % 24 AS INT)))) AS t FROM (SELECT *, {list(_ZONES)}[CAST(id % 4 + 1 AS INT)] AS zone FROM v_inv0 WHERE invoice_recurring_id IS NOT NULL)),
    d AS (SELECT *, t::DATE AS d, t - date_trunc('day', t) AS tod, (id % 7 - dayofweek(t::DATE) + 7) % 7 AS ahead FROM s)
    SELECT id, k, timezone('UTC', timezone(zone, CASE WHEN k = 0 THEN d WHEN id % 2 = 0 THEN last_day(date_trunc('month', d)::DATE + to_months(CAST(k AS INT))) ELSE CAST(d + CAST(CASE WHEN ahead = 0 THEN 7 ELSE ahead END + 7 * (k - 1) AS INT) AS DATE) END::DATE + tod)) AS at
    FROM d, range(6) r(k) WHERE id % 3 <> 0 OR k < 3""",
    "v_inv0",
)
def forecast_recurrence_instants(spark, sf):
    """The series start at some hour of UTC and follow the calendar of their own zone."""
    k = F.col("id")
    start = F.timestamp_micros(F.unix_micros(F.col("start").cast("timestamp")) + (k % 24) * 3_600_000_000)
    zone = F.element_at(F.array(*[F.lit(z) for z in _ZONES]), (k % 4 + 1).cast("int"))
    return forecast.upcoming_at(_series(spark, sf).withColumn("start_at", start).withColumn("timezone", zone), 6).select("id", "k", "at")


@query(
    "forecast_recurring_invoices",
    "AGG-24 FN-18",
    """SELECT team_id, date_trunc('month', date)::DATE AS month, CAST(sum(amount) AS DECIMAL(28,2)) AS amount, count(*) AS invoices FROM (SELECT id, team_id, amount, CASE WHEN k = 0 THEN issue_date WHEN id % 2 = 0 THEN last_day(date_trunc('month', issue_date)::DATE + to_months(CAST(k AS INT)))
      ELSE CAST(issue_date + CAST(CASE WHEN (id % 7 - dayofweek(issue_date) + 7) % 7 = 0 THEN 7 ELSE (id % 7 - dayofweek(issue_date) + 7) % 7 END + 7 * (k - 1) AS INT) AS DATE) END::DATE AS date FROM v_inv0, range(19) t(k) WHERE invoice_recurring_id IS NOT NULL AND (id % 3 <> 0 OR k < 3))
    WHERE date >= DATE '1999-07-01' AND date < DATE '1999-10-01' GROUP BY 1, 2""",
    "v_inv0",
)
def forecast_recurring_invoices(spark, sf):
    return forecast.recurring_invoice_projection(_series(spark, sf), "1999-06-15", 3)


# ---- extracted documents: invoices with their lines

TODAY = "2000-01-01"


def _docs(spark, sf):
    """Invoices as an extraction may have read them: some totals, rates, dates and names are off or missing."""
    sums = v.line_item(spark, sf).groupBy("invoice_id").agg(F.collect_list(F.struct(F.round(F.col("price") * F.col("quantity"), 2).cast("decimal(18,2)").alias("total_price"))).alias("items"), F.sum(F.round(F.col("price") * F.col("quantity"), 2).cast("decimal(18,2)")).cast("decimal(18,2)").alias("s"))
    k = F.col("id")
    tax = F.round(F.col("s") * F.lit("0.2").cast("decimal(2,1)"), 2).cast("decimal(18,2)")
    wrong = F.when(k % 7 == 0, 3).when(k % 11 == 0, F.col("s")).otherwise(0).cast("decimal(18,2)")
    return v.invoice(spark, sf).join(sums, F.col("id") == F.col("invoice_id")).select(
        "id", "items", F.when(k % 17 != 0, F.col("s") + tax + wrong).cast("decimal(18,2)").alias("total_amount"), F.when(k % 3 != 0, tax).alias("tax_amount"), F.when(k % 5 == 0, 10).when(k % 19 == 0, 120).otherwise(20).cast("decimal(10,2)").alias("tax_rate"),
        F.when(k % 23 == 0, "eur").when(k % 29 != 0, F.col("currency")).alias("currency"), F.when(k % 4 != 0, F.col("priority")).alias("vendor_name"), F.when(k % 6 != 0, F.col("invoice_number")).alias("invoice_number"),
        F.when(k % 31 == 0, "1988-13-01").when(k % 37 != 0, F.col("issue_date").cast("string")).alias("invoice_date"), F.when(k % 13 == 0, F.date_sub("issue_date", 1).cast("string")).when(k % 37 != 0, F.col("due_date").cast("string")).alias("due_date"),
    )


view(
    "v_extract",
    "v_invoice v_line_item",
    """SELECT id, s, CAST(CASE WHEN id % 17 <> 0 THEN s + t + CASE WHEN id % 7 = 0 THEN 3 WHEN id % 11 = 0 THEN s ELSE 0 END END AS DECIMAL(18,2)) AS total, CASE WHEN id % 3 <> 0 THEN t END AS tax, CASE WHEN id % 5 = 0 THEN 10 WHEN id % 19 = 0 THEN 120 ELSE 20 END AS rate,
  CASE WHEN id % 23 = 0 THEN 'eur' WHEN id % 29 <> 0 THEN currency END AS currency, CASE WHEN id % 4 <> 0 THEN priority END AS vendor, id % 6 <> 0 AS has_number, id % 31 = 0 AS odd_date, CASE WHEN id % 31 <> 0 AND id % 37 <> 0 THEN issue_date END AS issued,
  CASE WHEN id % 13 = 0 THEN issue_date - 1 WHEN id % 37 <> 0 THEN due_date END AS due
  FROM (SELECT i.*, s, CAST(round(s * 0.2, 2) AS DECIMAL(18,2)) AS t FROM v_invoice i JOIN (SELECT invoice_id, CAST(sum(CAST(round(price * quantity, 2) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS s FROM v_line_item GROUP BY 1) l ON i.id = l.invoice_id)""",
)
view(
    "v_points",
    "v_extract",
    """SELECT *, CASE WHEN total IS NULL THEN 30 ELSE 0 END + CASE WHEN currency IS NULL THEN 25 WHEN currency = 'eur' THEN 10 ELSE 0 END + CASE WHEN vendor IS NULL THEN 20 ELSE 0 END
  + CASE WHEN issued IS NULL AND due IS NULL AND NOT odd_date THEN 15 ELSE CASE WHEN odd_date OR issued NOT BETWEEN DATE '1990-01-01' AND DATE '2002-01-01' THEN 5 ELSE 0 END + CASE WHEN due NOT BETWEEN DATE '1990-01-01' AND DATE '2002-01-01' THEN 5 ELSE 0 END END
  + CASE WHEN rate > 100 THEN 5 ELSE 0 END + CASE WHEN total IS NOT NULL AND tax IS NOT NULL AND s > 0 AND abs(total - s - tax) > 0.01 THEN 10 ELSE 0 END + CASE WHEN has_number THEN 0 ELSE 5 END AS lost,
  (total IS NULL)::INT + (currency IS NULL)::INT + (vendor IS NULL)::INT + (issued IS NULL AND due IS NULL AND NOT odd_date)::INT AS missing FROM v_extract""",
)


@query(
    "extract_consistency",
    "FN-26",
    """SELECT id, a::INT + b::INT + c::INT AS n_issues, NOT (a OR b) AS is_valid, CASE WHEN a AND abs(s + tax - total) < total * 0.05 THEN CAST(s + tax AS DECIMAL(18,2)) END AS fixed_total,
    CASE WHEN total IS NOT NULL AND tax IS NULL AND s > 0 AND rate <= 100 AND (abs(s + s * rate / 100 - total) < 0.01 OR abs(s + s * rate / 100 - total) < total * 0.01) THEN CAST(round(s * rate / 100.0, 2) AS DECIMAL(18,2)) END AS fixed_tax,
    CASE WHEN c THEN CAST(round(tax::DOUBLE / s::DOUBLE * 100, 2) AS DECIMAL(18,2)) END AS fixed_rate
    FROM (SELECT *, coalesce(total IS NOT NULL AND s > 0 AND abs(s + tax - total) > 0.01, FALSE) AS a, coalesce(due < issued, FALSE) AS b, coalesce(s > 0 AND abs(tax::DOUBLE / s::DOUBLE * 100 - rate) > 0.1, FALSE) AS c FROM v_extract)""",
    "v_extract",
)
def extract_consistency(spark, sf):
    out = extraction.consistency(_docs(spark, sf))
    fixed = lambda name: F.element_at(F.map_from_entries("fixes"), name)
    return out.select("id", F.size("issues").alias("n_issues"), "is_valid", fixed("total_amount").alias("fixed_total"), fixed("tax_amount").alias("fixed_tax"), fixed("tax_rate").alias("fixed_rate"))


_SURE = "greatest(0, least(1, CASE WHEN has_number THEN least(1, y + 0.05::DOUBLE) ELSE y END))"


@query(
    "extract_quality",
    "FN-27",
    f"""SELECT id, quality, missing, quality < 70 OR missing > 0 AS is_poor, round({_SURE}, 4) AS confidence FROM (SELECT *, CASE WHEN length(vendor) > 5 THEN least(1, x + 0.05::DOUBLE) ELSE x END AS y
    FROM (SELECT *, CASE WHEN missing = 0 THEN least(1, quality / 100::DOUBLE + 0.1::DOUBLE) ELSE quality / 100::DOUBLE END - missing * 0.05::DOUBLE AS x FROM (SELECT *, greatest(0, 100 - lost) AS quality FROM v_points)))""",
    "v_points",
)
def extract_quality(spark, sf):
    return extraction.quality(_docs(spark, sf), TODAY).select("id", "quality", "missing", "is_poor", "confidence")


@query(
    "extract_merge",
    "FN-28",
    """SELECT id, CASE WHEN va IS NULL THEN 'Somebody' WHEN sure THEN va WHEN length(va) >= 8 THEN va ELSE 'Somebody' END AS vendor_name, CASE WHEN sure THEN currency WHEN currency <> 'USD' THEN currency ELSE 'SEK' END AS currency,
    CASE WHEN sure OR issue_date >= DATE '1996-01-01' THEN CAST(issue_date AS VARCHAR) ELSE '1996-01-01' END AS invoice_date, CASE WHEN sure THEN 'info' ELSE 'a@b.c' END AS email, CASE WHEN sure OR id % 2 = 0 THEN w ELSE 'shop.example' END AS website, amount AS total_amount
    FROM (SELECT *, id % 3 = 0 AS sure, CASE WHEN id % 4 <> 0 THEN priority END AS va, CASE WHEN id % 2 = 0 THEN 'www.a.example' ELSE 'long.shop.example' END AS w FROM v_invoice)""",
    "v_invoice",
)
def extract_merge(spark, sf):
    k = F.col("id")
    i = v.invoice(spark, sf)
    a = i.select(
        "id", F.when(k % 4 != 0, F.col("priority")).alias("vendor_name"), "currency", F.col("issue_date").cast("string").alias("invoice_date"), F.lit("info").alias("email"),
        F.when(k % 2 == 0, "www.a.example").otherwise("long.shop.example").alias("website"), F.col("amount").alias("total_amount"), F.when(k % 3 == 0, 0.9).otherwise(0.55).alias("confidence"),
    )
    b = i.select("id", F.lit("Somebody").alias("vendor_name"), F.lit("SEK").alias("currency"), F.lit("1996-01-01").alias("invoice_date"), F.lit("a@b.c").alias("email"), F.lit("shop.example").alias("website"), F.lit(0).cast("decimal(18,2)").alias("total_amount"), F.lit(0.5).alias("confidence"))
    fields = ["vendor_name", "currency", "invoice_date", "email", "website", "total_amount"]
    return extraction.merge(a, b, "id", fields).select("id", *fields)

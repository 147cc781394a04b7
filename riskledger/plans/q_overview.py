"""Team overview, period activity and history of weeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import customers as cu
from ..operators import forecast, insights, lists, overview, reports
from ..operators import invoices as inv
from ..sources import tables
from .q_billing import invoices as billed
from .q_insights import _baseline, _weeks
from .q_lists import _flagged, _items
from .q_reports import AS_OF, _totals, rnd
from .registry import query
from .views_sql import view

_OPEN = ("draft", "scheduled", "unpaid")


def _entries(spark, sf):
    """Time entries of teams: a project belongs to the team its number names."""
    rate = v.project(spark, sf).select(F.col("id").alias("project_id"), "rate")
    return v.time_entry(spark, sf).join(rate, "project_id").withColumn("team_id", F.col("project_id") % 5)


@query(
    "overview_summary",
    "AGG-43",
    """SELECT team_id, coalesce(open_count, 0) AS open_count, coalesce(open_amount, 0) AS open_amount, coalesce(duration, 0) AS duration, coalesce(time_amount, 0) AS time_amount, coalesce(projects, 0) AS projects, coalesce(inbox_pending, 0) AS inbox_pending,
    coalesce(to_review, 0) AS to_review, coalesce(cash, 0) AS cash, coalesce(accounts, 0) AS accounts, coalesce(runway, 0) AS runway
    FROM (SELECT team_id, sum(n) AS open_count, CAST(sum(a) AS DECIMAL(28,2)) AS open_amount FROM (SELECT team_id, currency, count(*) AS n, CAST(round(sum(amount) * any_value(rate), 2) AS DECIMAL(28,2)) AS a FROM v_inv_rate WHERE rate IS NOT NULL AND status IN ('draft', 'scheduled', 'unpaid') GROUP BY 1, 2) GROUP BY 1) o
    FULL JOIN (SELECT project_id % 5 AS team_id, sum(duration) AS duration, CAST(sum(amount) AS DECIMAL(28,2)) AS time_amount, count(*) AS projects FROM v_billable GROUP BY 1) t USING (team_id)
    FULL JOIN (SELECT team_id, count(*) AS inbox_pending FROM v_items WHERE status = 'pending' GROUP BY 1) i USING (team_id)
    FULL JOIN (SELECT team_id, count(*) AS to_review FROM v_flagged WHERE status <> 'excluded' AND NOT is_synced AND is_fulfilled GROUP BY 1) f USING (team_id)
    FULL JOIN (SELECT team_id, CAST(sum(cash) AS DECIMAL(28,2)) AS cash, count(*) AS accounts FROM v_cash WHERE type IN ('depository','other_asset') GROUP BY 1) c USING (team_id)
    FULL JOIN (SELECT c.team_id, coalesce(CAST(floor(cash::DOUBLE / med + 0.5) AS BIGINT), 0) AS runway FROM (SELECT team_id, sum(cash) AS cash FROM v_cash WHERE type IN ('depository','other_asset') GROUP BY 1) c
      LEFT JOIN (SELECT team_id, median(expenses::DOUBLE) AS med FROM v_monthly WHERE month BETWEEN DATE '1999-03-01' AND DATE '1999-05-31' AND expenses > 0 GROUP BY 1) b USING (team_id)) r USING (team_id)""",
    "v_inv_rate v_billable v_items v_flagged v_cash v_monthly",
)
def overview_summary(spark, sf):
    cash = reports.cash_balance(v.account(spark, sf), "USD", v.fx(spark))
    time = cu.billable_hours(v.time_entry(spark, sf), v.project(spark, sf), "2024-01-05", "2024-01-20").withColumn("team_id", F.col("project_id") % 5)
    return overview.summary(
        inv.summary_by_currency(billed(spark, sf), v.fx(spark), "USD", _OPEN), time, _items(spark, sf), lists.ready_for_export(_flagged(spark, sf)), cash, reports.runway(reports.burn_rate(_totals(spark, sf)), cash, AS_OF)
    )


@query(
    "overview_activity",
    "AGG-40",
    """SELECT team_id, coalesce(sent, 0) AS sent, coalesce(paid, 0) AS paid, coalesce(largest_payment, 0) AS largest_payment, coalesce(hours, 0) AS hours, coalesce(unbilled_hours, 0) AS unbilled_hours, coalesce(billable_amount, 0) AS billable_amount, coalesce(new_customers, 0) AS new_customers,
    coalesce(inbox_matched, 0) AS inbox_matched, coalesce(categorized, 0) AS categorized, coalesce(uncategorized, 0) AS uncategorized
    FROM (SELECT team_id, count(CASE WHEN issue_date BETWEEN DATE '1996-01-01' AND DATE '2024-01-20' AND status <> 'draft' THEN 1 END) AS sent, count(CASE WHEN paid_at BETWEEN DATE '1996-01-01' AND DATE '2024-01-20' AND status = 'paid' THEN 1 END) AS paid, max(CASE WHEN paid_at BETWEEN DATE '1996-01-01' AND DATE '2024-01-20' AND status = 'paid' THEN amount END) AS largest_payment FROM v_inv GROUP BY 1) a
    FULL JOIN (SELECT project_id % 5 AS team_id, CAST((2 * sum(duration) + 360) // 720 AS DECIMAL(18,1)) / 10 AS h, CAST(h AS DECIMAL(18,1)) AS hours, CAST(CAST((2 * coalesce(sum(CASE WHEN NOT billed THEN duration END), 0) + 360) // 720 AS DECIMAL(18,1)) / 10 AS DECIMAL(18,1)) AS unbilled_hours,
      CAST(round(sum(CASE WHEN NOT billed THEN CAST(CAST(duration * CAST(rate AS BIGINT) AS DECIMAL(28,0)) / 3600 AS DECIMAL(34,12)) END), 2) AS DECIMAL(28,2)) AS billable_amount FROM v_time_entry e JOIN v_project p ON e.project_id = p.id WHERE date BETWEEN DATE '1996-01-01' AND DATE '2024-01-20' GROUP BY 1) b USING (team_id)
    FULL JOIN (SELECT team_id, count(*) AS new_customers FROM v_customer WHERE created_at BETWEEN DATE '1996-01-01' AND DATE '2024-01-20' GROUP BY 1) c USING (team_id)
    FULL JOIN (SELECT team_id, count(*) AS inbox_matched FROM v_items WHERE status = 'done' AND created_at::DATE BETWEEN DATE '1996-01-01' AND DATE '2024-01-20' GROUP BY 1) d USING (team_id)
    FULL JOIN (SELECT team_id, count(category_slug) AS categorized, count(CASE WHEN category_slug IS NULL THEN 1 END) AS uncategorized FROM v_ledger WHERE date BETWEEN DATE '1996-01-01' AND DATE '2024-01-20' GROUP BY 1) e USING (team_id)""",
    "v_inv v_time_entry v_project v_customer v_items v_ledger",
)
def overview_activity(spark, sf):
    items = _items(spark, sf).withColumn("created_day", F.to_date("created_at"))
    return overview.activity(billed(spark, sf), _entries(spark, sf), v.customer(spark, sf), items, v.ledger(spark, sf), "1996-01-01", "2024-01-20")


view(
    "v_paid_week",
    "v_inv",
    "SELECT team_id, date_trunc('week', paid_at)::DATE AS period, count(CASE WHEN amount > 50000 THEN 1 END) AS paid, count(CASE WHEN amount > 50000 AND paid_at > due_date + 45 THEN 1 END) AS late FROM v_inv WHERE paid_at IS NOT NULL GROUP BY 1, 2",
)


@query(
    "insight_paid_on_time",
    "WIN-14",
    """SELECT team_id, period, paid, late, sum(CASE WHEN paid > 0 AND late = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY team_id, i ORDER BY period) AS paid_on_time FROM (SELECT *, sum(CASE WHEN paid > 0 AND late > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY team_id ORDER BY period) AS i FROM v_paid_week)""",
    "v_paid_week",
)
def insight_paid_on_time(spark, sf):
    big = F.col("amount") > 50000
    rows = billed(spark, sf).filter(F.col("paid_at").isNotNull()).groupBy("team_id", F.trunc("paid_at", "week").alias("period"))
    weeks = rows.agg(F.count(F.when(big, 1)).alias("paid"), F.count(F.when(big & (F.col("paid_at") > F.date_add("due_date", 45)), 1)).alias("late"))
    return overview.paid_on_time(weeks)


@query(
    "insight_recovery",
    "WIN-15",
    """WITH p AS (SELECT *, lag(revenue) OVER w AS p FROM v_week WHERE revenue > 0 WINDOW w AS (PARTITION BY team_id ORDER BY period)),
    d AS (SELECT *, coalesce(revenue < p, FALSE) AS down, sum(CASE WHEN coalesce(revenue < p, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY team_id ORDER BY period) AS i FROM p),
    r AS (SELECT *, sum(down::INT) OVER (PARTITION BY team_id, i ORDER BY period) AS run FROM d),
    l AS (SELECT *, coalesce(lag(run) OVER (PARTITION BY team_id ORDER BY period), 0) AS before FROM r)
    SELECT a.team_id, a.period, coalesce(l.revenue > p AND before > 0, FALSE) AS is_recovery, CASE WHEN l.revenue > p AND before > 0 THEN before ELSE 0 END AS down_weeks,
    CASE WHEN l.revenue > p AND before > 0 THEN CASE WHEN (l.revenue - p)::DOUBLE / p::DOUBLE * 100 >= 20 THEN 'strong' WHEN (l.revenue - p)::DOUBLE / p::DOUBLE * 100 >= 10 THEN 'moderate' ELSE 'mild' END END AS strength FROM v_week a LEFT JOIN l USING (team_id, period)""",
    "v_week",
)
def insight_recovery(spark, sf):
    return overview.recovery(_weeks(spark, sf)).select("team_id", "period", "is_recovery", "down_weeks", "strength")


@query(
    "insight_quarter_pace",
    "WIN-15 JON-15",
    f"""SELECT *, CASE WHEN last_year_revenue > 0 THEN {rnd('(projected - last_year_revenue::DOUBLE) / last_year_revenue::DOUBLE * 100', 0)} ELSE 0 END AS vs_last_year FROM (SELECT team_id, q AS qtd_revenue, l AS last_year_revenue, {rnd('q::DOUBLE / 76 * 91', 0)} AS projected
    FROM (SELECT team_id, CAST(coalesce(sum(CASE WHEN period BETWEEN DATE '1999-04-01' AND DATE '1999-06-15' AND isoyear(period) = 1999 THEN revenue END), 0) AS DECIMAL(28,2)) AS q, CAST(coalesce(sum(CASE WHEN quarter(period) = 2 AND isoyear(period) = 1998 THEN revenue END), 0) AS DECIMAL(28,2)) AS l FROM v_week GROUP BY 1) WHERE q > 0)""",
    "v_week",
)
def insight_quarter_pace(spark, sf):
    return overview.quarter_pace(_weeks(spark, sf), "1999-06-15")


@query(
    "period_labels",
    "FN-22",
    """SELECT id, CAST(date_trunc('week', issue_date)::DATE - 7 AS DATE) AS week_start, CAST(date_trunc('week', issue_date)::DATE - 1 AS DATE) AS week_end, (date_trunc('quarter', issue_date) - INTERVAL 3 MONTH)::DATE AS quarter_start, (date_trunc('quarter', issue_date)::DATE - 1) AS quarter_end,
    'Week ' || week(issue_date - 7) || ', ' || isoyear(issue_date - 7) AS week_label, strftime((date_trunc('month', issue_date) - INTERVAL 1 MONTH)::DATE, '%B %Y') AS month_label,
    'Q' || quarter((date_trunc('quarter', issue_date) - INTERVAL 3 MONTH)::DATE) || ' ' || year((date_trunc('quarter', issue_date) - INTERVAL 3 MONTH)::DATE) AS quarter_label, CAST(year(issue_date) - 1 AS VARCHAR) AS year_label FROM v_invoice""",
    "v_invoice",
)
def period_labels(spark, sf):
    day = F.col("issue_date")
    week, quarter = insights.previous_period(day, "weekly"), insights.previous_period(day, "quarterly")
    label = lambda kind: insights.period_label(insights.previous_period(day, kind)[0], kind)
    return v.invoice(spark, sf).select(
        "id", week[0].alias("week_start"), week[1].alias("week_end"), quarter[0].alias("quarter_start"), quarter[1].alias("quarter_end"), label("weekly").alias("week_label"), label("monthly").alias("month_label"), label("quarterly").alias("quarter_label"), label("yearly").alias("year_label")
    )


@query(
    "balance_normalized",
    "SRC-17",
    "SELECT id, CASE WHEN type = 'credit' THEN abs(balance) ELSE coalesce(base_balance, balance, 0) END AS shown FROM v_account",
    "v_account",
)
def balance_normalized(spark, sf):
    return v.account(spark, sf).select("id", tables.normalize_balance(F.col("type"), F.col("balance"), F.col("base_balance")).alias("shown"))


_FREQUENCIES = ("weekly", "biweekly", "monthly_date", "monthly_weekday", "monthly_last_day", "quarterly", "semi_annual", "annual", "custom")


def _clamp(n):
    """SQL of the month ``n`` months on, on the day of the date or the month's last."""
    m = f"date_trunc('month', issue_date + INTERVAL {n} MONTH)::DATE"
    return f"{m} + CAST(least(day(issue_date), day(last_day({m}))) - 1 AS INT)"


_NEXT = "date_trunc('month', issue_date + INTERVAL 1 MONTH)::DATE"


@query(
    "forecast_next_dates",
    "FN-18",
    f"""SELECT id, frequency, next AS date, CASE id % 4 WHEN 0 THEN next > issue_date + 40 WHEN 1 THEN id % 3 >= 2 ELSE FALSE END AS completed FROM (SELECT *, CAST(CASE frequency
      WHEN 'weekly' THEN issue_date + CAST(CASE WHEN (id % 7 - dayofweek(issue_date) + 7) % 7 = 0 THEN 7 ELSE (id % 7 - dayofweek(issue_date) + 7) % 7 END AS INT) WHEN 'biweekly' THEN issue_date + 14
      WHEN 'monthly_date' THEN {_NEXT} + CAST(least(id % 31 + 1, day(last_day({_NEXT}))) - 1 AS INT) WHEN 'monthly_weekday' THEN {_NEXT} + CAST((id % 7 - dayofweek({_NEXT}) + 7) % 7 + (id % 5) * 7 AS INT)
      WHEN 'monthly_last_day' THEN last_day({_NEXT}) WHEN 'quarterly' THEN {_clamp(3)} WHEN 'semi_annual' THEN {_clamp(6)} WHEN 'annual' THEN {_clamp(12)} ELSE issue_date + CAST(greatest(1, id % 20) AS INT) END AS DATE) AS next
      FROM (SELECT *, CASE id % 9 {' '.join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FREQUENCIES))} END AS frequency FROM v_invoice))
    WHERE CASE id % 4 WHEN 0 THEN next <= issue_date + 40 WHEN 1 THEN id % 3 + 2 <= 2 ELSE TRUE END""",
    "v_invoice",
)
def forecast_next_dates(spark, sf):
    """The date after the first of each series, for all nine frequencies and the three end rules."""
    k = F.col("id")
    kind = F.element_at(F.array(*[F.lit(f) for f in _FREQUENCIES]), (k % 9 + 1).cast("int"))
    day = F.when(F.col("frequency").isin("weekly", "monthly_weekday"), k % 7).when(F.col("frequency") == "monthly_date", k % 31 + 1)
    series = v.invoice(spark, sf).withColumn("frequency", kind).select(
        "id", "frequency", F.col("issue_date").alias("start"), day.cast("int").alias("frequency_day"), (k % 5 + 1).cast("int").alias("frequency_week"), (k % 20).cast("int").alias("frequency_interval"),
        F.when(k % 4 == 0, "on_date").when(k % 4 == 1, "after_count").otherwise("never").alias("end_type"), F.date_add("issue_date", 40).alias("end_date"), F.lit(2).alias("end_count"), (k % 3).cast("int").alias("generated"),
    )
    out = forecast.upcoming(series, 2).filter("k = 1")
    done = forecast.series_completed(F.col("end_type"), F.col("end_date"), F.col("end_count"), F.col("generated"), F.col("date"))
    return out.select("id", "frequency", "date", done.alias("completed"))


# ---- forecast from all six sources: invoices of 1997, moved on, by kind

_KINDS = {"recurring_invoices": 0, "recurring_transactions": 1, "scheduled": 2, "collections": 3, "billable_hours": 4}
_MOVED = "date_trunc('month', issue_date + INTERVAL 36 MONTH)::DATE"
view(
    "v_sources",
    "v_baseline v_inv",
    f"""SELECT b.team_id, g.i, (DATE '2000-09-01' + to_months(CAST(g.i AS INT)))::DATE AS month, {', '.join(f"CAST(coalesce(s.{name}, 0) AS DECIMAL(28,4)) AS {name}" for name in _KINDS)}, CAST(round(baseline * (greatest(50, 90 - g.i * 10) * 0.01), 4) AS DECIMAL(28,4)) AS new_business
  FROM v_baseline b CROSS JOIN range(1, 5) g(i) LEFT JOIN (SELECT team_id, {_MOVED} AS m, {', '.join(f"sum(CASE WHEN id % 5 = {i} THEN CAST(amount * 0.01 AS DECIMAL(18,2)) END) AS {name}" for name, i in _KINDS.items())} FROM v_inv GROUP BY 1, 2) s
  ON s.team_id = b.team_id AND s.m = (DATE '2000-09-01' + to_months(CAST(g.i AS INT)))::DATE""",
)


@query(
    "forecast_revenue_sources",
    "AGG-23",
    f"""SELECT team_id, month, CAST(round(v, 2) AS DECIMAL(28,2)) AS value, CAST(round(recurring_invoices * 1.05 + recurring_transactions * 1.10 + scheduled * 1.05 + collections * 1.20 + billable_hours * 1.15 + new_business * 1.50, 2) AS DECIMAL(28,2)) AS optimistic,
    CAST(round(recurring_invoices * 0.95 + recurring_transactions * 0.85 + scheduled * 0.90 + collections * 0.60 + billable_hours * 0.70 + new_business * 0.40, 2) AS DECIMAL(28,2)) AS pessimistic,
    CAST(CASE WHEN v > 0 THEN {rnd('(recurring_invoices::DOUBLE * 95 + recurring_transactions::DOUBLE * 85 + scheduled::DOUBLE * 90 + collections::DOUBLE * 70 + billable_hours::DOUBLE * 75 + new_business::DOUBLE * 35) / v::DOUBLE', 0)} ELSE 0 END AS BIGINT) AS confidence,
    recurring_invoices > 500 AND recurring_transactions > 500 AS overlap_warning FROM (SELECT *, recurring_invoices + recurring_transactions + scheduled + collections + billable_hours + new_business AS v FROM v_sources)""",
    "v_sources",
)
def forecast_revenue_sources(spark, sf):
    moved = F.trunc(F.add_months("issue_date", 36), "MM")
    cents = (F.col("amount") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")
    rows = billed(spark, sf).select("team_id", moved.alias("month"), (F.col("id") % 5).alias("kind"), cents.alias("amount"))
    sums = rows.groupBy("team_id", "month", "kind").agg(F.sum("amount").alias("amount"))
    sources = {name: sums.filter(F.col("kind") == i) for name, i in _KINDS.items()}
    base = _baseline(spark, sf)
    out = forecast.revenue_forecast(base.select("team_id"), "2000-09-15", 4, sources, base)
    return out.select("team_id", "month", "value", "optimistic", "pessimistic", "confidence", "overlap_warning")

"""Invoices, customers and tracked time."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import customers as cu
from ..operators import invoices as inv
from .q_reports import rnd
from .registry import query
from .views_sql import view

AS_OF = "2000-09-15"
START, END = "1999-01-01", "2000-08-31"

view("v_inv0", "v_invoice v_customer", "SELECT i.*, c.team_id FROM v_invoice i JOIN v_customer c ON i.customer_id = c.id")
view("v_inv", "v_inv0", f"SELECT * REPLACE (CASE WHEN status = 'unpaid' AND due_date < DATE '{AS_OF}' THEN 'overdue' ELSE status END AS status) FROM v_inv0")
view("v_inv_rate", "v_inv v_fx", "SELECT i.*, CASE WHEN currency = 'USD' THEN 1 ELSE rate END AS rate FROM v_inv i LEFT JOIN (SELECT base, rate FROM v_fx WHERE target = 'USD') ON currency = base")


def raw(spark, sf):
    team = v.customer(spark, sf).select(F.col("id").alias("customer_id"), "team_id")
    return v.invoice(spark, sf).join(team, "customer_id")


def invoices(spark, sf):
    return inv.with_overdue(raw(spark, sf), AS_OF)


@query(
    "invoice_totals_line_tax",
    "AGG-36",
    """SELECT invoice_id, count(*) AS lines, CAST(sum(price * quantity) AS DECIMAL(28,6)) AS subtotal, CAST(0 AS DECIMAL(28,6)) AS vat, CAST(round(sum(price * quantity * tax_rate * 0.01), 6) AS DECIMAL(28,6)) AS tax,
    CAST(round(sum(price * quantity * tax_rate * 0.01), 6) + sum(price * quantity) AS DECIMAL(28,6)) AS total FROM v_line_item GROUP BY 1""",
    "v_line_item",
)
def invoice_totals_line_tax(spark, sf):
    return inv.invoice_totals(v.line_item(spark, sf), line_tax=True)


@query(
    "invoice_totals_rates",
    "AGG-36",
    """SELECT invoice_id, lines, s AS subtotal, CAST(round(s * 0.2, 6) AS DECIMAL(28,6)) AS vat, CAST(round(s * 0.05, 6) AS DECIMAL(28,6)) AS tax,
    CAST(s + round(s * 0.2, 6) + round(s * 0.05, 6) - 10 AS DECIMAL(28,6)) AS total FROM (SELECT invoice_id, count(*) AS lines, CAST(sum(price * quantity) AS DECIMAL(28,6)) AS s FROM v_line_item GROUP BY 1)""",
    "v_line_item",
)
def invoice_totals_rates(spark, sf):
    rates = v.invoice(spark, sf).select(F.col("id").alias("invoice_id"), F.lit(20).alias("vat_rate"), F.lit(5).alias("tax_rate"), F.lit(10).alias("discount"))
    return inv.invoice_totals(v.line_item(spark, sf), rates)


@query(
    "invoice_check_status",
    "FLT-13",
    f"""SELECT i.id, i.team_id, CASE WHEN status IN ('unpaid','overdue') AND coalesce(n, 0) = 1 THEN 'paid' WHEN status = 'unpaid' AND due_date < DATE '{AS_OF}' THEN 'overdue' ELSE status END AS status,
    CASE WHEN status IN ('unpaid','overdue') AND coalesce(n, 0) = 1 THEN tx END AS matched_transaction FROM v_inv0 i LEFT JOIN (SELECT team_id, abs(amount) AS amount, currency, count(*) AS n, min(transaction_id) AS tx
    FROM v_payment WHERE date >= DATE '{AS_OF}' - 400 GROUP BY 1, 2, 3) p ON i.team_id = p.team_id AND i.amount = p.amount AND i.currency = p.currency""",
    "v_inv0 v_payment",
)
def invoice_check_status(spark, sf):
    pay = v.payment(spark, sf).withColumn("amount", F.abs("amount"))
    return inv.check_status(raw(spark, sf), pay, AS_OF, 400)


def _open(statuses):
    return f"""SELECT team_id, count(*) AS invoices, CAST(round(sum(CAST(amount * rate AS DECIMAL(28,10))), 2) AS DECIMAL(28,2)) AS total_amount, min(due_date) AS oldest_due,
    greatest(0, DATE '{AS_OF}' - min(due_date)) AS days_overdue FROM v_inv_rate WHERE status IN {statuses} AND rate IS NOT NULL GROUP BY 1"""


@query("invoice_overdue_alert", "AGG-16", _open("('overdue')"), "v_inv_rate")
def invoice_overdue_alert(spark, sf):
    return inv.open_summary(invoices(spark, sf), v.fx(spark), "USD", AS_OF, ("overdue",))


@query("invoice_outstanding", "AGG-16", _open("('unpaid','overdue','draft','scheduled')"), "v_inv_rate")
def invoice_outstanding(spark, sf):
    return inv.open_summary(invoices(spark, sf), v.fx(spark), "USD", AS_OF)


@query(
    "invoice_summary_currency",
    "AGG-27",
    """SELECT team_id, currency, count(*) AS invoices, CAST(sum(amount) AS DECIMAL(28,2)) AS original_amount, CAST(round(sum(amount) * any_value(rate), 2) AS DECIMAL(28,2)) AS converted_amount
    FROM v_inv_rate WHERE rate IS NOT NULL GROUP BY 1, 2""",
    "v_inv_rate",
)
def invoice_summary_currency(spark, sf):
    return inv.summary_by_currency(invoices(spark, sf), v.fx(spark), "USD")


@query(
    "invoice_payer_score",
    "AGG-28",
    f"""SELECT team_id, invoices, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'average' ELSE 'bad' END AS payment_status FROM (SELECT team_id, invoices,
    CAST(greatest(0, least(100, CASE WHEN d <= 3 THEN 100 WHEN d <= 7 THEN floor(100 - (d - 3) / 4 * 15 + 0.5) WHEN d <= 14 THEN floor(85 - (d - 7) / 7 * 20 + 0.5) WHEN d <= 30 THEN floor(65 - (d - 14) / 16 * 25 + 0.5)
      ELSE floor(greatest(0, 40 - (d - 30) / 30 * 40) + 0.5) END + floor((r - 0.5) * 20 + 0.5))) AS BIGINT) AS score
    FROM (SELECT team_id, count(*) AS invoices, (sum(late * w) / sum(w))::DOUBLE AS d, count(CASE WHEN late <= 3 THEN 1 END) / count(*) AS r FROM (
      SELECT *, coalesce(paid_at, DATE '{AS_OF}') - due_date AS late, CASE WHEN abs(DATE '{AS_OF}' - due_date) <= 90 THEN 1.5 ELSE 1.0 END AS w, row_number() OVER (PARTITION BY team_id ORDER BY due_date DESC, id) AS rn
      FROM v_inv WHERE (status = 'paid' AND paid_at IS NOT NULL) OR (status IN ('unpaid','overdue') AND paid_at IS NULL AND due_date < DATE '{AS_OF}')) WHERE rn <= 50 GROUP BY 1))""",
    "v_inv",
)
def invoice_payer_score(spark, sf):
    return inv.payer_score(invoices(spark, sf), AS_OF)


view("v_inv_days", "v_inv", "SELECT *, CASE WHEN status = 'paid' AND paid_at - issue_date >= 0 THEN paid_at - issue_date END AS pay_days FROM v_inv")
_OVER = f"((status = 'overdue' OR (status = 'unpaid' AND due_date < DATE '{AS_OF}')) AND paid_at IS NULL)"


@query(
    "invoice_payment_analysis",
    "AGG-29",
    f"""SELECT *, CAST(floor(greatest(0, least(100, CASE WHEN d > 30 THEN greatest(0.0, 100.0 - (d - 30) * 2) WHEN d > 14 THEN 85 - (d - 14) / 16 * 25 WHEN d > 7 THEN 100 - (d - 7) / 7 * 15 ELSE 100.0 END - overdue_rate * 0.5)) + 0.5) AS BIGINT) AS payment_score
    FROM (SELECT team_id, count(*) AS total_invoices, count(CASE WHEN status = 'paid' THEN 1 END) AS paid_invoices, count(CASE WHEN status IN ('unpaid','overdue') THEN 1 END) AS unpaid_invoices,
    count(CASE WHEN {_OVER} THEN 1 END) AS overdue_invoices, CAST(coalesce(sum(CASE WHEN {_OVER} THEN amount END), 0) AS DECIMAL(28,2)) AS overdue_amount,
    coalesce(max(CASE WHEN {_OVER} THEN DATE '{AS_OF}' - due_date END), 0) AS oldest_days, CAST(coalesce(floor(avg(pay_days) + 0.5), 0) AS BIGINT) AS average_days_to_pay,
    CAST(floor(count(CASE WHEN status = 'paid' THEN 1 END) / count(*) * 100 + 0.5) AS BIGINT) AS payment_rate, CAST(floor(count(CASE WHEN {_OVER} THEN 1 END) / count(*) * 100 + 0.5) AS BIGINT) AS overdue_rate
    FROM v_inv_days WHERE issue_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY team_id) t, LATERAL (SELECT average_days_to_pay AS d)""".replace("SELECT *, CAST(floor(greatest", "SELECT t.*, CAST(floor(greatest", 1),
    "v_inv_days",
)
def invoice_payment_analysis(spark, sf):
    return inv.payment_analysis(invoices(spark, sf), START, END, AS_OF)


@query(
    "invoice_payment_trend",
    "AGG-29",
    f"""SELECT team_id, date_trunc('month', issue_date)::DATE AS month, count(*) AS invoices, CAST(coalesce(floor(avg(pay_days) + 0.5), 0) AS BIGINT) AS average_days_to_pay,
    CAST(floor(count(CASE WHEN status = 'paid' THEN 1 END) / count(*) * 100 + 0.5) AS BIGINT) AS payment_rate FROM v_inv_days WHERE issue_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 2""",
    "v_inv_days",
)
def invoice_payment_trend(spark, sf):
    return inv.payment_trend(invoices(spark, sf), START, END)


@query(
    "invoice_days_to_payment",
    "AGG-30",
    f"SELECT team_id, CAST({rnd('avg(paid_at - issue_date)', 0)} AS BIGINT) AS average_days FROM v_inv WHERE status = 'paid' AND paid_at >= DATE '{AS_OF}' - 300 GROUP BY 1",
    "v_inv",
)
def invoice_days_to_payment(spark, sf):
    return inv.average_days_to_payment(invoices(spark, sf), AS_OF, 300)


@query(
    "invoice_average_size",
    "AGG-30",
    f"SELECT team_id, currency, CAST(round(CAST(sum(amount) / count(*) AS DECIMAL(28,8)), 2) AS DECIMAL(28,2)) AS average_amount, count(*) AS invoices FROM v_inv WHERE status <> 'draft' AND issue_date >= DATE '{AS_OF}' - 30 GROUP BY 1, 2",
    "v_inv",
)
def invoice_average_size(spark, sf):
    return inv.average_invoice_size(invoices(spark, sf), AS_OF)


AS_OF_COLLECT = "1996-06-30"  # paid orders of the driver data end here
view(
    "v_collect",
    "v_inv0",
    f"""SELECT team_id, count(CASE WHEN ok THEN 1 END) AS sample_size, CASE WHEN count(CASE WHEN ok THEN 1 END) > 0 THEN {rnd('count(CASE WHEN ok AND paid_at <= due_date THEN 1 END) / count(CASE WHEN ok THEN 1 END)', 6)} ELSE 0.7 END AS on_time_rate,
  CASE WHEN count(CASE WHEN ok THEN 1 END) > 0 THEN {rnd('sum(CASE WHEN ok THEN paid_at - issue_date END) / count(CASE WHEN ok THEN 1 END)', 6)} ELSE 30 END AS avg_days_to_pay
  FROM (SELECT *, paid_at - issue_date BETWEEN 0 AND 365 AS ok FROM v_inv0 WHERE status = 'paid' AND paid_at >= DATE '{AS_OF_COLLECT}' - INTERVAL 12 MONTH) GROUP BY 1""",
)


@query("invoice_collection_metrics", "AGG-19", "SELECT * FROM v_collect", "v_collect")
def invoice_collection_metrics(spark, sf):
    return inv.collection_metrics(raw(spark, sf), AS_OF_COLLECT)


view(
    "v_expected",
    "v_inv v_collect",
    f"""SELECT team_id, CAST(round(sum(CAST(e * CASE WHEN age < 45 THEN 1 ELSE 0.6 END AS DECIMAL(28,9))), 2) AS DECIMAL(28,2)) AS month1, CAST(round(sum(CAST(e * CASE WHEN age < 45 THEN 0 ELSE 0.4 END AS DECIMAL(28,9))), 2) AS DECIMAL(28,2)) AS month2, count(*) AS invoices
  FROM (SELECT team_id, age, CAST(amount * CAST(least(0.95::DOUBLE, greatest(0.05::DOUBLE, p * rate / 0.7::DOUBLE)) AS DECIMAL(12,8)) AS DECIMAL(28,8)) AS e FROM (
   SELECT i.*, coalesce(on_time_rate, 0.7)::DOUBLE AS rate, DATE '{AS_OF}' - issue_date AS age, CASE WHEN DATE '{AS_OF}' - issue_date < 30 THEN 0.85::DOUBLE WHEN due_date >= DATE '{AS_OF}' THEN 0.75::DOUBLE WHEN DATE '{AS_OF}' - due_date <= 30 THEN 0.5::DOUBLE
     WHEN DATE '{AS_OF}' - due_date <= 60 THEN 0.3::DOUBLE WHEN DATE '{AS_OF}' - due_date <= 90 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END AS p FROM v_inv i LEFT JOIN v_collect USING (team_id) WHERE status IN ('unpaid','overdue'))) GROUP BY 1""",
)


@query("invoice_expected_collections", "AGG-20", "SELECT * FROM v_expected", "v_expected")
def invoice_expected_collections(spark, sf):
    return inv.expected_collections(invoices(spark, sf), invoice_collection_metrics(spark, sf), AS_OF)


view(
    "v_recurring_avg",
    "v_inv0",
    f"""SELECT team_id, CAST(round(CAST(sum(s) / count(*) AS DECIMAL(28,8)), 2) AS DECIMAL(28,2)) AS monthly_average, count(*) AS months FROM (SELECT team_id, date_trunc('month', paid_at) AS m, sum(amount) AS s
  FROM v_inv0 WHERE status = 'paid' AND invoice_recurring_id IS NOT NULL AND paid_at >= DATE '{AS_OF_COLLECT}' - INTERVAL 6 MONTH GROUP BY 1, 2) GROUP BY 1""",
)


@query("invoice_recurring_average", "AGG-22", "SELECT * FROM v_recurring_avg", "v_recurring_avg")
def invoice_recurring_average(spark, sf):
    return inv.recurring_invoice_average(raw(spark, sf), AS_OF_COLLECT)


@query(
    "invoice_overdue_behavior",
    "JON-14",
    f"""SELECT id, i.team_id, i.customer_id, DATE '{AS_OF}' - due_date AS days_overdue, t AS typical_pay_days, coalesce(DATE '{AS_OF}' - due_date > greatest(t * 1.5, t + 7), FALSE) AS is_unusual
    FROM v_inv i LEFT JOIN (SELECT team_id, customer_id, CAST(greatest(0, floor(avg(paid_at - due_date) + 0.5) + 14) AS BIGINT) AS t FROM v_inv WHERE status = 'paid' AND paid_at IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2) h
    ON i.team_id = h.team_id AND i.customer_id = h.customer_id WHERE status = 'overdue'""",
    "v_inv",
)
def invoice_overdue_behavior(spark, sf):
    return inv.overdue_with_behavior(invoices(spark, sf), AS_OF)


@query(
    "invoice_next_number",
    "SRT-11",
    "SELECT team_id, 'INV-' || CASE WHEN length(n) < 4 THEN lpad(n, 4, '0') ELSE n END AS next_number FROM (SELECT team_id, CAST(max(CAST(regexp_extract(invoice_number, '([0-9]+)$', 1) AS BIGINT)) + 1 AS VARCHAR) AS n FROM v_inv GROUP BY 1)",
    "v_inv",
)
def invoice_next_number(spark, sf):
    return inv.next_number(invoices(spark, sf))


@query(
    "invoice_list",
    "FLT-08 FLT-05",
    """SELECT id, status, due_date, amount FROM v_inv WHERE status IN ('overdue','unpaid') AND due_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND invoice_recurring_id IS NOT NULL
    AND invoice_number ILIKE '%inv-0%' AND customer_id IN (SELECT id FROM v_customer WHERE segment = 'BUILDING')""",
    "v_inv v_customer",
)
def invoice_list(spark, sf):
    who = v.customer(spark, sf).filter(F.col("segment") == "BUILDING").select(F.col("id").alias("customer_id"))
    return inv.list_invoices(invoices(spark, sf), ("overdue", "unpaid"), "2000-01-01", "2000-12-31", True, who, "inv-0").select("id", "status", "due_date", "amount")


_SERIES = """SELECT id, CASE WHEN id % 4 = 0 THEN 'paused' ELSE 'active' END AS status, CAST(issue_date AS TIMESTAMP) + to_hours(id % 24) AS next_scheduled_at,
  CASE WHEN id % 3 = 0 THEN CAST(issue_date AS TIMESTAMP) - to_hours(470 + id % 24) END AS notified_at FROM v_invoice WHERE invoice_recurring_id IS NOT NULL"""
view("v_series", "v_invoice", _SERIES)


def _series(spark, sf):
    i = v.invoice(spark, sf).filter(F.col("invoice_recurring_id").isNotNull())
    ts = F.col("issue_date").cast("timestamp")
    return i.select(
        "id",
        F.when(F.col("id") % 4 == 0, "paused").otherwise("active").alias("status"),
        (ts + F.make_dt_interval(hours=(F.col("id") % 24).cast("int"))).alias("next_scheduled_at"),
        F.when(F.col("id") % 3 == 0, ts - F.make_dt_interval(hours=(F.col("id") % 24 + 470).cast("int"))).alias("notified_at"),
    )


@query(
    "invoice_series_due",
    "FLT-14",
    "SELECT id, next_scheduled_at FROM v_series WHERE status = 'active' AND next_scheduled_at <= TIMESTAMP '1999-01-01' ORDER BY next_scheduled_at, id LIMIT 51",
    "v_series",
)
def invoice_series_due(spark, sf):
    return inv.due_series(_series(spark, sf), "1999-01-01 00:00:00").select("id", "next_scheduled_at")


@query(
    "invoice_series_upcoming",
    "FLT-14",
    """SELECT id, next_scheduled_at FROM v_series WHERE status = 'active' AND next_scheduled_at > TIMESTAMP '1999-01-01' AND next_scheduled_at <= TIMESTAMP '1999-01-21'
    AND (notified_at IS NULL OR notified_at <= next_scheduled_at - INTERVAL 481 HOUR)""",
    "v_series",
)
def invoice_series_upcoming(spark, sf):
    return inv.upcoming_series(_series(spark, sf), "1999-01-01 00:00:00", 480).select("id", "next_scheduled_at")


# ---- customers


def _tags(spark, sf):
    return v.invoice(spark, sf).select("customer_id", F.col("priority").alias("tag"))


@query(
    "customer_list",
    "JON-07 JON-06",
    """SELECT c.id AS customer_id, c.name, coalesce(invoice_count, 0) AS invoice_count, coalesce(total_revenue, 0) AS total_revenue, coalesce(outstanding, 0) AS outstanding, last_invoice_date, coalesce(project_count, 0) AS project_count, coalesce(tags, '') AS tags
    FROM v_customer c LEFT JOIN (SELECT customer_id, count(*) AS invoice_count, CAST(coalesce(sum(CASE WHEN status = 'paid' THEN amount END), 0) AS DECIMAL(28,2)) AS total_revenue,
    CAST(coalesce(sum(CASE WHEN status IN ('unpaid','overdue') THEN amount END), 0) AS DECIMAL(28,2)) AS outstanding, max(issue_date) AS last_invoice_date, string_agg(DISTINCT priority, ',' ORDER BY priority) AS tags FROM v_invoice GROUP BY 1) i ON c.id = i.customer_id
    LEFT JOIN (SELECT customer_id, count(*) AS project_count FROM v_project GROUP BY 1) p ON c.id = p.customer_id""",
    "v_customer v_invoice v_project",
)
def customer_list(spark, sf):
    out = cu.customer_list(v.customer(spark, sf), v.invoice(spark, sf), v.project(spark, sf), _tags(spark, sf))
    return out.select("customer_id", "name", "invoice_count", "total_revenue", "outstanding", "last_invoice_date", "project_count", "tags")


@query(
    "customer_concentration",
    "AGG-32",
    f"""SELECT team_id, CAST(sum(r) AS DECIMAL(28,2)) AS total_revenue, count(*) AS customer_count, arg_max(customer_id, (r, customer_id)) AS top_customer, CAST(max(r) AS DECIMAL(28,2)) AS top_revenue,
    {rnd('max(r)::DOUBLE / sum(r)::DOUBLE * 100', 0)} AS top_percentage, max(r)::DOUBLE / sum(r)::DOUBLE * 100 > 50 AS is_concentrated
    FROM (SELECT team_id, customer_id, sum(amount) AS r FROM v_inv WHERE status = 'paid' AND currency = 'USD' AND paid_at BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1, 2) GROUP BY 1""",
    "v_inv",
)
def customer_concentration(spark, sf):
    return cu.revenue_concentration(v.customer(spark, sf), invoices(spark, sf), "1995-01-01", "1996-12-31", "USD")


@query(
    "customer_top_client",
    "AGG-33",
    f"""SELECT team_id, customer_id, currency, total_revenue, invoice_count FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY total_revenue DESC, customer_id) AS rn FROM (SELECT team_id, customer_id, currency,
    CAST(sum(amount) AS DECIMAL(28,2)) AS total_revenue, count(*) AS invoice_count FROM v_inv WHERE status IN ('paid','unpaid','overdue') AND issue_date >= DATE '{AS_OF}' - 30 GROUP BY 1, 2, 3)) WHERE rn = 1""",
    "v_inv",
)
def customer_top_client(spark, sf):
    return cu.top_client(invoices(spark, sf), AS_OF)


@query("customer_new", "AGG-33", f"SELECT team_id, count(*) AS new_customers FROM v_customer WHERE created_at >= DATE '1998-06-01' - 30 GROUP BY 1", "v_customer")
def customer_new(spark, sf):
    return cu.new_customers(v.customer(spark, sf), "1998-06-01")


view(
    "v_clv",
    "v_inv",
    f"""SELECT team_id, customer_id, currency, CAST(sum(amount) AS DECIMAL(28,2)) AS total_revenue, count(*) AS invoice_count, greatest(1, max(issue_date) - min(issue_date)) AS lifespan_days, max(issue_date) >= DATE '{AS_OF}' - 30 AS is_active
  FROM v_inv WHERE status IN ('paid','unpaid','overdue') GROUP BY 1, 2, 3""",
)


@query(
    "customer_lifetime_summary",
    "AGG-34",
    f"""SELECT team_id, CAST(round(CAST(sum(total_revenue) / count(*) AS DECIMAL(28,8)), 2) AS DECIMAL(28,2)) AS average_clv, count(*) AS total_customers, count(CASE WHEN is_active THEN 1 END) AS active_customers,
    CAST({rnd('avg(lifespan_days)', 0)} AS BIGINT) AS average_lifespan_days, {rnd('median(total_revenue::DOUBLE)', 2)} AS median_clv FROM v_clv GROUP BY 1""",
    "v_clv",
)
def customer_lifetime_summary(spark, sf):
    return cu.lifetime_summary(cu.lifetime_values(invoices(spark, sf), AS_OF))


@query(
    "customer_lifetime_top",
    "AGG-34",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY total_revenue DESC, customer_id, currency) AS rank FROM v_clv) WHERE rank <= 5",
    "v_clv",
)
def customer_lifetime_top(spark, sf):
    return cu.lifetime_top(cu.lifetime_values(invoices(spark, sf), AS_OF))


@query(
    "customer_invoice_summary",
    "AGG-35",
    """SELECT customer_id, CAST(round(sum(a), 2) AS DECIMAL(28,2)) AS total_amount, CAST(round(coalesce(sum(CASE WHEN status = 'paid' THEN a END), 0), 2) AS DECIMAL(28,2)) AS paid_amount,
    CAST(round(coalesce(sum(CASE WHEN status <> 'paid' THEN a END), 0), 2) AS DECIMAL(28,2)) AS outstanding_amount, count(*) AS invoice_count
    FROM (SELECT *, CAST(amount * rate AS DECIMAL(28,10)) AS a FROM v_inv_rate WHERE rate IS NOT NULL AND status IN ('paid','unpaid','overdue')) GROUP BY 1""",
    "v_inv_rate",
)
def customer_invoice_summary(spark, sf):
    return cu.invoice_summary(invoices(spark, sf), v.fx(spark), "USD")


view(
    "v_activity",
    "v_customer v_inv v_project v_time_entry",
    f"""SELECT c.id AS customer_id, c.team_id, c.created_at, coalesce(n, 0) AS invoice_count, coalesce(d, 0) AS tracked FROM v_customer c
  LEFT JOIN (SELECT customer_id, count(*) AS n FROM v_inv WHERE issue_date >= DATE '{AS_OF}' - 30 GROUP BY 1) i ON c.id = i.customer_id
  LEFT JOIN (SELECT p.customer_id, sum(duration) AS d FROM v_project p JOIN v_time_entry e ON e.project_id = p.id WHERE e.date >= DATE '{AS_OF}' - 30 GROUP BY 1) t ON c.id = t.customer_id""",
)


def _activity(spark, sf):
    return cu.activity(v.customer(spark, sf), invoices(spark, sf), v.project(spark, sf), v.time_entry(spark, sf), AS_OF)


@query(
    "customer_most_active",
    "AGG-31",
    """SELECT team_id, customer_id, invoice_count, tracked FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY invoice_count + tracked // 3600 DESC, customer_id) AS rn FROM v_activity WHERE invoice_count > 0 OR tracked > 0) WHERE rn = 1""",
    "v_activity",
)
def customer_most_active(spark, sf):
    return cu.most_active(_activity(spark, sf))


@query(
    "customer_inactive",
    "AGG-31",
    f"SELECT team_id, count(*) AS inactive FROM v_activity WHERE created_at < DATE '{AS_OF}' - 30 AND invoice_count = 0 AND tracked = 0 GROUP BY 1",
    "v_activity",
)
def customer_inactive(spark, sf):
    return cu.inactive_count(_activity(spark, sf), AS_OF)


# ---- time


@query(
    "time_by_day",
    "AGG-37",
    "SELECT date, sum(duration) AS duration, count(*) AS entries, count(DISTINCT assigned_id) AS people FROM v_time_entry WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1",
    "v_time_entry",
)
def time_by_day(spark, sf):
    return cu.tracked_by_day(v.time_entry(spark, sf), "2024-01-05", "2024-01-20")


_H = "CAST((2 * CAST(rate * 100 AS BIGINT) * CAST(sum(duration) AS BIGINT) + 3600) // 7200 AS DECIMAL(28,2)) / 100"
view(
    "v_billable",
    "v_project v_time_entry",
    f"""SELECT p.id AS project_id, p.name, p.currency, sum(duration) AS duration, CAST({_H} AS DECIMAL(28,2)) AS amount FROM v_time_entry e JOIN v_project p ON e.project_id = p.id
  WHERE p.billable AND e.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY p.id, p.name, p.currency, p.rate""",
)


def _billable(spark, sf):
    return cu.billable_hours(v.time_entry(spark, sf), v.project(spark, sf), "2024-01-05", "2024-01-20")


@query("time_billable", "AGG-37", "SELECT * FROM v_billable", "v_billable")
def time_billable(spark, sf):
    return _billable(spark, sf)


@query("time_earnings", "AGG-37", "SELECT currency, sum(amount) AS amount, sum(duration) AS duration FROM v_billable GROUP BY 1", "v_billable")
def time_earnings(spark, sf):
    return cu.earnings_by_currency(_billable(spark, sf))


@query(
    "time_unbilled",
    "AGG-38",
    """SELECT project_id, name, currency, hours, CAST(round(hours * rate, 2) AS DECIMAL(28,2)) AS billable_amount FROM (SELECT p.id AS project_id, p.name, p.currency, p.rate,
    CAST((2 * sum(duration) + 360) // 720 AS DECIMAL(18,1)) / 10 AS h, CAST(h AS DECIMAL(18,1)) AS hours FROM v_time_entry e JOIN v_project p ON e.project_id = p.id WHERE NOT billed GROUP BY ALL) WHERE hours > 0""",
    "v_project v_time_entry",
)
def time_unbilled(spark, sf):
    return cu.unbilled_hours(v.time_entry(spark, sf), v.project(spark, sf))


@query(
    "time_projects",
    "AGG-39",
    f"""SELECT id, name, status, total_duration, users, coalesce(tags, 0) AS tags, total_amount FROM (SELECT p.id, p.name, p.status, sum(duration) AS total_duration, count(DISTINCT assigned_id) AS users, CAST({_H} AS DECIMAL(28,2)) AS total_amount
    FROM v_project p JOIN v_time_entry e ON e.project_id = p.id GROUP BY p.id, p.name, p.status, p.rate) LEFT JOIN (SELECT project_id AS id, count(DISTINCT assigned_id % 11) AS tags FROM v_time_entry WHERE assigned_id % 13 = 0 GROUP BY 1) USING (id)""",
    "v_project v_time_entry",
)
def time_projects(spark, sf):
    entries = v.time_entry(spark, sf)
    tags = entries.where(F.col("assigned_id") % 13 == 0).select("project_id", (F.col("assigned_id") % 11).alias("tag_id")).distinct()
    return cu.project_list(v.project(spark, sf), entries, tags)


_LISTS = {
    "invoice_drafts": ("SELECT id, team_id, amount, currency FROM v_inv WHERE status = 'draft'", lambda i: i.filter(F.col("status") == "draft").orderBy(F.desc("amount"), "id").select("id", "team_id", "amount", "currency")),
    "invoice_upcoming": (
        f"SELECT id, team_id, amount, due_date FROM v_inv WHERE status = 'unpaid' AND due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 7",
        lambda i: i.filter((F.col("status") == "unpaid") & F.col("due_date").between(F.lit(AS_OF).cast("date"), F.date_add(F.lit(AS_OF).cast("date"), 7))).select("id", "team_id", "amount", "due_date"),
    ),
    "invoice_overdue_totals": (
        f"SELECT team_id, currency, count(*) AS invoices, CAST(sum(amount) AS DECIMAL(28,2)) AS amount, max(DATE '{AS_OF}' - due_date) AS oldest_days FROM v_inv WHERE status = 'overdue' GROUP BY 1, 2",
        lambda i: i.filter(F.col("status") == "overdue")
        .groupBy("team_id", "currency")
        .agg(F.count("*").alias("invoices"), F.sum("amount").cast("decimal(28,2)").alias("amount"), F.max(F.datediff(F.lit(AS_OF).cast("date"), "due_date")).cast("long").alias("oldest_days")),
    ),
}
for _n, (_sql, _fn) in _LISTS.items():

    @query(_n, "AGG-38", _sql, "v_inv")
    def _listed(spark, sf, _fn=_fn):
        return _fn(invoices(spark, sf))

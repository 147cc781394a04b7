"""Invoice totals, status, payer behaviour and overdue reports (all teams at once)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import round_half_up
from . import money

D2 = "decimal(28,2)"


def _day(s: str) -> Column:
    return F.lit(s).cast("date")


def _js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def invoice_totals(items: DataFrame, rates: DataFrame | None = None, line_tax: bool = False, include_vat: bool = True) -> DataFrame:
    """Subtotal, VAT, tax and total per invoice.

    ``rates`` has one row per invoice: vat_rate, tax_rate, discount. Tax is per line
    with ``line_tax``, else the invoice rate on the subtotal.
    """
    line = F.coalesce("price", F.lit(0)) * F.coalesce("quantity", F.lit(0))
    s = items.groupBy("invoice_id").agg(
        F.sum(line).cast("decimal(28,6)").alias("subtotal"),
        F.sum((line * F.coalesce("tax_rate", F.lit(0)) / 100).cast("decimal(28,8)")).alias("_line_tax"),
        F.count("*").alias("lines"),
    )
    if rates is not None:
        s = s.join(rates, "invoice_id", "left")
    else:
        s = s.withColumns({c: F.lit(0) for c in ("vat_rate", "tax_rate", "discount")})
    vat = F.col("subtotal") * F.coalesce("vat_rate", F.lit(0)) / 100 if include_vat else F.lit(0)
    tax = F.col("_line_tax") if line_tax else F.col("subtotal") * F.coalesce("tax_rate", F.lit(0)) / 100
    s = s.withColumn("vat", vat.cast("decimal(28,6)")).withColumn("tax", tax.cast("decimal(28,6)"))
    total = F.col("subtotal") + F.col("vat") + F.col("tax") - F.coalesce("discount", F.lit(0))
    return s.select("invoice_id", "lines", "subtotal", "vat", "tax", total.cast("decimal(28,6)").alias("total"))


def with_overdue(invoices: DataFrame, as_of: str) -> DataFrame:
    """Unpaid invoices past their due date become overdue."""
    late = (F.col("status") == "unpaid") & (F.col("due_date") < _day(as_of))
    return invoices.withColumn("status", F.when(late, "overdue").otherwise(F.col("status")))


def check_status(invoices: DataFrame, payments: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """Paid when exactly one open recent payment has the amount and currency; else overdue when late.

    Payments are counted per (team, amount, currency) before the join, so a common
    amount adds one line, not one per pair.
    """
    recent = payments.filter(F.col("date") >= F.date_sub(_day(as_of), days)).groupBy("team_id", "amount", F.upper("currency").alias("currency")).agg(
        F.count("*").alias("_n"), F.min("transaction_id").alias("_tx")
    )
    df = invoices.withColumn("currency", F.upper("currency")).join(recent, ["team_id", "amount", "currency"], "left")
    paid = F.col("status").isin("unpaid", "overdue") & (F.coalesce("_n", F.lit(0)) == 1)
    late = (F.col("status") == "unpaid") & (F.col("due_date") < _day(as_of))
    return df.select(
        "id",
        "team_id",
        F.when(paid, "paid").when(late, "overdue").otherwise(F.col("status")).alias("status"),
        F.when(paid, F.col("_tx")).alias("matched_transaction"),
    )


def open_summary(invoices: DataFrame, fx: DataFrame, target: str, as_of: str, statuses=("unpaid", "overdue", "draft", "scheduled")) -> DataFrame:
    """Count, converted total and oldest due date of invoices in the given states."""
    rows = money.with_rate(invoices.filter(F.col("status").isin(*statuses)), fx, target)
    amt = F.when(F.col("currency") == target, F.col("amount").cast("decimal(28,10)")).otherwise((F.col("amount") * F.col("_rate")).cast("decimal(28,10)"))
    s = rows.withColumn("_a", amt).filter(F.col("_a").isNotNull()).groupBy("team_id")
    return s.agg(
        F.count("*").alias("invoices"),
        F.round(F.sum("_a"), 2).cast(D2).alias("total_amount"),
        F.min("due_date").alias("oldest_due"),
    ).withColumn("days_overdue", F.greatest(F.lit(0), F.datediff(_day(as_of), "oldest_due")).cast("long"))


def summary_by_currency(invoices: DataFrame, fx: DataFrame, target: str, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Totals per currency and converted; currencies without a rate are left out."""
    rows = invoices.filter(F.col("status").isin(*statuses)) if statuses else invoices
    by = rows.groupBy("team_id", "currency").agg(F.sum("amount").alias("_s"), F.count("*").alias("invoices"))
    by = money.with_rate(by, fx, target)
    rate = F.when(F.col("currency") == target, F.lit(1)).otherwise(F.col("_rate"))
    return by.filter(rate.isNotNull()).select(
        "team_id",
        "currency",
        "invoices",
        F.col("_s").cast(D2).alias("original_amount"),
        F.round(F.col("_s") * rate, 2).cast(D2).alias("converted_amount"),
    )


def payer_score(invoices: DataFrame, as_of: str, last: int = 50) -> DataFrame:
    """Score 0..100 per team over its last ``last`` due invoices."""
    today = _day(as_of)
    due = invoices.filter(
        F.col("due_date").isNotNull()
        & (
            ((F.col("status") == "paid") & F.col("paid_at").isNotNull())
            | (F.col("status").isin("unpaid", "overdue") & F.col("paid_at").isNull() & (F.col("due_date") < today))
        )
    )
    w = Window.partitionBy("team_id").orderBy(F.desc("due_date"), "id")
    picked = due.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last)
    late = F.datediff(F.coalesce("paid_at", today), "due_date")
    weight = F.when(F.abs(F.datediff(today, "due_date")) <= 90, F.lit(1.5)).otherwise(1.0).cast("decimal(4,1)")
    s = picked.groupBy("team_id").agg(
        (F.sum(late * weight) / F.sum(weight)).cast("double").alias("avg_days"),
        (F.count(F.when(late <= 3, 1)) / F.count("*")).alias("on_time_rate"),
        F.count("*").alias("invoices"),
    )
    d = F.col("avg_days")
    base = (
        F.when(d <= 3, F.lit(100.0))
        .when(d <= 7, _js_round(100 - (d - 3) / 4 * 15))
        .when(d <= 14, _js_round(85 - (d - 7) / 7 * 20))
        .when(d <= 30, _js_round(65 - (d - 14) / 16 * 25))
        .otherwise(_js_round(F.greatest(F.lit(0.0), 40 - (d - 30) / 30 * 40)))
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), base + _js_round((F.col("on_time_rate") - 0.5) * 20))).cast("long")
    s = s.withColumn("score", score)
    status = F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "average").otherwise("bad")
    return s.select("team_id", "invoices", "score", status.alias("payment_status"))


def _pay_days() -> Column:
    days = F.datediff("paid_at", F.coalesce("issue_date", "due_date"))
    return F.when((F.col("status") == "paid") & (days >= 0), days)


def payment_analysis(invoices: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """Days to pay, payment and overdue rate, score and overdue totals per team."""
    today = _day(as_of)
    rows = invoices.filter(F.col("issue_date").between(_day(start), _day(end)))
    overdue = ((F.col("status") == "overdue") | ((F.col("status") == "unpaid") & (F.col("due_date") < today))) & F.col("paid_at").isNull()
    s = rows.groupBy("team_id").agg(
        F.count("*").alias("total_invoices"),
        F.count(F.when(F.col("status") == "paid", 1)).alias("paid_invoices"),
        F.count(F.when(F.col("status").isin("unpaid", "overdue"), 1)).alias("unpaid_invoices"),
        F.count(F.when(overdue, 1)).alias("overdue_invoices"),
        F.coalesce(F.sum(F.when(overdue, F.col("amount"))), F.lit(0)).cast(D2).alias("overdue_amount"),
        F.coalesce(F.max(F.when(overdue, F.datediff(today, "due_date"))), F.lit(0)).cast("long").alias("oldest_days"),
        F.coalesce(_js_round(F.avg(_pay_days())), F.lit(0)).cast("long").alias("average_days_to_pay"),
    )
    n = F.col("total_invoices")
    s = s.withColumn("payment_rate", _js_round(F.col("paid_invoices") / n * 100).cast("long")).withColumn(
        "overdue_rate", _js_round(F.col("overdue_invoices") / n * 100).cast("long")
    )
    d = F.col("average_days_to_pay")
    base = (
        F.when(d > 30, F.greatest(F.lit(0.0), 100.0 - (d - 30) * 2))
        .when(d > 14, 85 - (d - 14) / 16 * 25)
        .when(d > 7, 100 - (d - 7) / 7 * 15)
        .otherwise(100.0)
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - F.col("overdue_rate") * 0.5))
    return s.withColumn("payment_score", _js_round(score).cast("long"))


def payment_trend(invoices: DataFrame, start: str, end: str) -> DataFrame:
    """Average days to pay and payment rate by month of issue."""
    rows = invoices.filter(F.col("issue_date").between(_day(start), _day(end)))
    return rows.groupBy("team_id", F.trunc("issue_date", "MM").alias("month")).agg(
        F.count("*").alias("invoices"),
        F.coalesce(_js_round(F.avg(_pay_days())), F.lit(0)).cast("long").alias("average_days_to_pay"),
        _js_round(F.count(F.when(F.col("status") == "paid", 1)) / F.count("*") * 100).cast("long").alias("payment_rate"),
    )


def average_days_to_payment(invoices: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    paid = invoices.filter((F.col("status") == "paid") & (F.col("paid_at") >= F.date_sub(_day(as_of), days)))
    return paid.groupBy("team_id").agg(round_half_up(F.avg(F.datediff("paid_at", "issue_date")), 0).cast("long").alias("average_days"))


def average_invoice_size(invoices: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    sent = invoices.filter((F.col("status") != "draft") & (F.col("issue_date") >= F.date_sub(_day(as_of), days)))
    return sent.groupBy("team_id", "currency").agg(
        F.round(F.avg("amount"), 2).cast(D2).alias("average_amount"), F.count("*").alias("invoices")
    )


def collection_metrics(invoices: DataFrame, as_of: str) -> DataFrame:
    """On-time rate and average days to pay of the last twelve months, with defaults."""
    paid = invoices.filter(
        (F.col("status") == "paid") & F.col("issue_date").isNotNull() & (F.col("paid_at") >= F.add_months(_day(as_of), -12))
    )
    days = F.datediff("paid_at", "issue_date")
    ok = (days >= 0) & (days <= 365)
    s = paid.groupBy("team_id").agg(
        F.count(F.when(ok, 1)).alias("sample_size"),
        F.count(F.when(ok & (F.col("paid_at") <= F.col("due_date")), 1)).alias("_on"),
        F.sum(F.when(ok, days)).alias("_days"),
    )
    n = F.col("sample_size")
    return s.select(
        "team_id",
        "sample_size",
        F.when(n > 0, round_half_up(F.col("_on") / n, 6)).otherwise(0.7).alias("on_time_rate"),
        F.when(n > 0, round_half_up(F.col("_days") / n, 6)).otherwise(30.0).alias("avg_days_to_pay"),
    )


def expected_collections(invoices: DataFrame, metrics: DataFrame, as_of: str) -> DataFrame:
    """Expected income from open invoices in the next two months."""
    today = _day(as_of)
    open_ = invoices.filter(F.col("status").isin("unpaid", "overdue")).join(metrics.select("team_id", "on_time_rate"), "team_id", "left")
    age, late = F.coalesce(F.datediff(today, "issue_date"), F.lit(0)), F.coalesce(F.datediff(today, "due_date"), F.lit(0))
    base = (
        F.when(age < 30, 0.85).when(late <= 0, 0.75).when(late <= 30, 0.5).when(late <= 60, 0.3).when(late <= 90, 0.15).otherwise(0.05)
    )
    p = F.least(F.lit(0.95), F.greatest(F.lit(0.05), base * F.coalesce("on_time_rate", F.lit(0.7)) / 0.7))
    amount = F.coalesce("amount", F.lit(0))
    # the probability as a decimal keeps the sums independent of the row order
    expected = (amount * p.cast("decimal(12,8)")).cast("decimal(28,8)")
    first = F.when(age < 45, F.lit(1)).otherwise(F.lit("0.6").cast("decimal(2,1)"))
    second = F.when(age < 45, F.lit(0)).otherwise(F.lit("0.4").cast("decimal(2,1)"))
    return open_.groupBy("team_id").agg(
        F.round(F.sum(expected * first), 2).cast(D2).alias("month1"),
        F.round(F.sum(expected * second), 2).cast(D2).alias("month2"),
        F.count("*").alias("invoices"),
    )


def recurring_invoice_average(invoices: DataFrame, as_of: str) -> DataFrame:
    """Average monthly income of paid recurring invoices over six months."""
    rows = invoices.filter(
        (F.col("status") == "paid") & F.col("invoice_recurring_id").isNotNull() & (F.col("paid_at") >= F.add_months(_day(as_of), -6))
    )
    by = rows.groupBy("team_id", F.trunc("paid_at", "MM").alias("_m")).agg(F.sum("amount").alias("_s"))
    return by.groupBy("team_id").agg(F.round(F.avg("_s"), 2).cast(D2).alias("monthly_average"), F.count("*").alias("months"))


def overdue_with_behavior(invoices: DataFrame, as_of: str) -> DataFrame:
    """Overdue invoices beside how late their customer usually pays."""
    today = _day(as_of)
    habit = (
        invoices.filter((F.col("status") == "paid") & F.col("paid_at").isNotNull() & F.col("due_date").isNotNull())
        .groupBy("team_id", "customer_id")
        .agg(F.avg(F.datediff("paid_at", "due_date")).alias("_avg"), F.count("*").alias("_n"))
        .filter(F.col("_n") >= 2)
        .select("team_id", "customer_id", F.greatest(F.lit(0), _js_round(F.col("_avg")) + 14).cast("long").alias("typical_pay_days"))
    )
    late = invoices.filter((F.col("status") == "overdue")).withColumn("days_overdue", F.datediff(today, "due_date").cast("long"))
    t = F.col("typical_pay_days")
    unusual = F.coalesce(F.col("days_overdue") > F.greatest(t * 1.5, (t + 7).cast("double")), F.lit(False))
    return late.join(habit, ["team_id", "customer_id"], "left").select(
        "id", "team_id", "customer_id", "days_overdue", "typical_pay_days", unusual.alias("is_unusual")
    )


def next_number(invoices: DataFrame, prefix: str = "INV-", pad: int = 4) -> DataFrame:
    """Next document number per team: largest numeric suffix + 1, else count + 1."""
    digits = F.nullif(F.regexp_extract("invoice_number", "([0-9]+)$", 1), F.lit("")).cast("long")
    s = invoices.groupBy("team_id").agg(F.max(digits).alias("_max"), F.count("*").alias("_n"))
    nxt = (F.coalesce("_max", "_n") + 1).cast("string")
    return s.select("team_id", F.concat(F.lit(prefix), F.when(F.length(nxt) < pad, F.lpad(nxt, pad, "0")).otherwise(nxt)).alias("next_number"))


def list_invoices(invoices: DataFrame, statuses=None, due_from=None, due_to=None, recurring: bool | None = None, customers: DataFrame | None = None, q: str | None = None) -> DataFrame:
    """Invoice list filters; ``q`` is an amount when numeric, else part of the number."""
    out = invoices
    if statuses:
        out = out.filter(F.col("status").isin(*statuses))
    if due_from:
        out = out.filter(F.col("due_date") >= _day(due_from))
    if due_to:
        out = out.filter(F.col("due_date") <= _day(due_to))
    if recurring is not None:
        out = out.filter(F.col("invoice_recurring_id").isNotNull() == F.lit(recurring))
    if customers is not None:
        out = out.join(customers.select("customer_id"), "customer_id", "left_semi")
    if q:
        try:
            out = out.filter(F.col("amount") == F.lit(str(float(q))).cast("decimal(18,2)"))
        except ValueError:
            out = out.filter(F.col("invoice_number").ilike(f"%{q}%"))
    return out


def due_series(series: DataFrame, now: str, limit: int = 50) -> DataFrame:
    """Active series whose next run is due, oldest first; one extra row tells there is more."""
    due = series.filter((F.col("status") == "active") & (F.col("next_scheduled_at") <= F.lit(now).cast("timestamp")))
    return due.orderBy("next_scheduled_at", "id").limit(limit + 1)


def upcoming_series(series: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Active series due within ``hours`` that have no notice for this cycle yet."""
    t = F.lit(now).cast("timestamp")
    nxt = F.col("next_scheduled_at")
    gap = F.expr(f"INTERVAL {hours + 1} HOURS")
    fresh = F.col("notified_at").isNull() | (F.col("notified_at") <= nxt - gap)
    return series.filter((F.col("status") == "active") & (nxt > t) & (nxt <= t + F.expr(f"INTERVAL {hours} HOURS")) & fresh)

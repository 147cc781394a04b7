"""Customer metrics: each side is aggregated before the joins, so nothing fans out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import round_half_up
from . import money

D2 = "decimal(28,2)"
BILLED = ("paid", "unpaid", "overdue")


def customer_list(customers: DataFrame, invoices: DataFrame, projects: DataFrame, tags: DataFrame) -> DataFrame:
    """Customers with invoice, project and tag figures."""
    inv = invoices.groupBy("customer_id").agg(
        F.count("*").alias("invoice_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "paid", F.col("amount"))), F.lit(0)).cast(D2).alias("total_revenue"),
        F.coalesce(F.sum(F.when(F.col("status").isin("unpaid", "overdue"), F.col("amount"))), F.lit(0)).cast(D2).alias("outstanding"),
        F.max("issue_date").alias("last_invoice_date"),
    )
    prj = projects.groupBy("customer_id").agg(F.count("*").alias("project_count"))
    tag = tags.groupBy("customer_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return (
        customers.withColumnRenamed("id", "customer_id")
        .join(inv, "customer_id", "left")
        .join(prj, "customer_id", "left")
        .join(tag, "customer_id", "left")
        .na.fill(0, ["invoice_count", "total_revenue", "outstanding", "project_count"])
        .na.fill("", ["tags"])
    )


def revenue_concentration(customers: DataFrame, invoices: DataFrame, start: str, end: str, currency: str) -> DataFrame:
    """Share of the largest customer in paid revenue, per team."""
    paid = invoices.filter(
        (F.col("status") == "paid") & (F.col("currency") == currency) & F.col("paid_at").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    by = paid.groupBy("team_id", "customer_id").agg(F.sum("amount").alias("_r"))
    s = by.groupBy("team_id").agg(
        F.sum("_r").cast(D2).alias("total_revenue"),
        F.count("*").alias("customer_count"),
        F.max(F.struct("_r", "customer_id")).alias("_top"),
    )
    share = F.col("_top._r").cast("double") / F.col("total_revenue").cast("double") * 100
    return s.select(
        "team_id",
        "total_revenue",
        "customer_count",
        F.col("_top.customer_id").alias("top_customer"),
        F.col("_top._r").cast(D2).alias("top_revenue"),
        round_half_up(share, 0).alias("top_percentage"),
        (share > 50).alias("is_concentrated"),
    )


def top_client(invoices: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Largest (customer, currency) by invoiced amount in the last days, per team."""
    rows = invoices.filter(F.col("status").isin(*BILLED) & (F.col("issue_date") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    by = rows.groupBy("team_id", "customer_id", "currency").agg(F.sum("amount").cast(D2).alias("total_revenue"), F.count("*").alias("invoice_count"))
    w = Window.partitionBy("team_id").orderBy(F.desc("total_revenue"), "customer_id")
    return by.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def new_customers(customers: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    return customers.filter(F.col("created_at") >= since).groupBy("team_id").agg(F.count("*").alias("new_customers"))


def lifetime_values(invoices: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per customer and currency: revenue, invoices, lifespan and activity."""
    by = invoices.filter(F.col("status").isin(*BILLED)).groupBy("team_id", "customer_id", "currency").agg(
        F.sum("amount").cast(D2).alias("total_revenue"),
        F.count("*").alias("invoice_count"),
        F.min("issue_date").alias("_first"),
        F.max("issue_date").alias("_last"),
    )
    return by.select(
        "team_id",
        "customer_id",
        "currency",
        "total_revenue",
        "invoice_count",
        F.greatest(F.lit(1), F.datediff("_last", "_first")).cast("long").alias("lifespan_days"),
        (F.col("_last") >= F.date_sub(F.lit(as_of).cast("date"), days)).alias("is_active"),
    )


def lifetime_summary(values: DataFrame) -> DataFrame:
    per_value = values.groupBy("team_id", "total_revenue").agg(F.count("*").alias("_n"))
    med = per_value.groupBy("team_id").agg(F.percentile(F.col("total_revenue").cast("double"), F.lit(0.5), F.col("_n")).alias("_m"))
    s = values.groupBy("team_id").agg(
        F.round(F.avg("total_revenue"), 2).cast(D2).alias("average_clv"),
        F.count("*").alias("total_customers"),
        F.count(F.when(F.col("is_active"), 1)).alias("active_customers"),
        round_half_up(F.avg("lifespan_days"), 0).cast("long").alias("average_lifespan_days"),
    )
    return s.join(med, "team_id").withColumn("median_clv", round_half_up(F.col("_m"), 2)).drop("_m")


def lifetime_top(values: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("team_id").orderBy(F.desc("total_revenue"), "customer_id", "currency")
    return values.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def invoice_summary(invoices: DataFrame, fx: DataFrame, target: str) -> DataFrame:
    """Paid and outstanding per customer in the target currency; unconvertible left out."""
    rows = money.with_rate(invoices.filter(F.col("status").isin(*BILLED)), fx, target)
    amt = F.when(F.col("currency") == target, F.col("amount").cast("decimal(28,10)")).otherwise((F.col("amount") * F.col("_rate")).cast("decimal(28,10)"))
    rows = rows.withColumn("_a", amt).filter(F.col("_a").isNotNull())
    zero = F.lit(0)
    return rows.groupBy("customer_id").agg(
        F.round(F.sum("_a"), 2).cast(D2).alias("total_amount"),
        F.round(F.coalesce(F.sum(F.when(F.col("status") == "paid", F.col("_a"))), zero), 2).cast(D2).alias("paid_amount"),
        F.round(F.coalesce(F.sum(F.when(F.col("status") != "paid", F.col("_a"))), zero), 2).cast(D2).alias("outstanding_amount"),
        F.count("*").alias("invoice_count"),
    )


def activity(customers: DataFrame, invoices: DataFrame, projects: DataFrame, entries: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per customer: invoices and tracked seconds of the last days."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    inv = invoices.filter(F.col("issue_date") >= since).groupBy("customer_id").agg(F.count("*").alias("invoice_count"))
    per_project = entries.filter(F.col("date") >= since).groupBy("project_id").agg(F.sum("duration").alias("_d"))
    time = (
        projects.select(F.col("id").alias("project_id"), "customer_id")
        .join(per_project, "project_id")
        .groupBy("customer_id")
        .agg(F.sum("_d").alias("tracked"))
    )
    return (
        customers.select(F.col("id").alias("customer_id"), "team_id", "created_at")
        .join(inv, "customer_id", "left")
        .join(time, "customer_id", "left")
        .na.fill(0, ["invoice_count", "tracked"])
    )


def most_active(act: DataFrame) -> DataFrame:
    hours = F.col("invoice_count") + F.floor(F.col("tracked") / 3600)
    w = Window.partitionBy("team_id").orderBy(hours.desc(), "customer_id")
    busy = act.filter((F.col("invoice_count") > 0) | (F.col("tracked") > 0))
    return busy.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).select("team_id", "customer_id", "invoice_count", "tracked")


def inactive_count(act: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    idle = act.filter((F.col("created_at") < since) & (F.col("invoice_count") == 0) & (F.col("tracked") == 0))
    return idle.groupBy("team_id").agg(F.count("*").alias("inactive"))


# ---- time tracking


def tracked_by_day(entries: DataFrame, start: str, end: str) -> DataFrame:
    rows = entries.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.groupBy("date").agg(F.sum("duration").alias("duration"), F.count("*").alias("entries"), F.countDistinct("assigned_id").alias("people"))


def billable_hours(entries: DataFrame, projects: DataFrame, start: str, end: str) -> DataFrame:
    """Seconds and earnings per billable project in the range."""
    rows = entries.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    per = rows.groupBy("project_id").agg(F.sum("duration").alias("duration"))
    p = projects.filter("billable").select(F.col("id").alias("project_id"), "name", "rate", "currency")
    return per.join(p, "project_id").select(
        "project_id", "name", "currency", "duration", F.round(F.col("rate") * F.col("duration") / 3600, 2).cast(D2).alias("amount")
    )


def earnings_by_currency(billable: DataFrame) -> DataFrame:
    return billable.groupBy("currency").agg(F.sum("amount").cast(D2).alias("amount"), F.sum("duration").alias("duration"))


def unbilled_hours(entries: DataFrame, projects: DataFrame) -> DataFrame:
    """Hours not yet billed per project, one decimal, with their value."""
    per = entries.filter(~F.col("billed")).groupBy("project_id").agg(F.sum("duration").alias("_s")).filter(F.col("_s") > 0)
    hours = F.round((F.col("_s") / 3600).cast("decimal(18,6)"), 1).cast("decimal(18,1)")
    p = projects.select(F.col("id").alias("project_id"), "name", "rate", "currency")
    return (
        per.join(p, "project_id")
        .withColumn("hours", hours)
        .filter(F.col("hours") > 0)
        .select("project_id", "name", "currency", "hours", F.round(F.col("hours") * F.coalesce("rate", F.lit(0)), 2).cast(D2).alias("billable_amount"))
    )


def project_list(projects: DataFrame, entries: DataFrame, tags: DataFrame) -> DataFrame:
    """Projects with time, value, users and number of tags; ``tags`` holds a row per project_id and tag."""
    per = entries.groupBy("project_id").agg(F.sum("duration").alias("total_duration"), F.countDistinct("assigned_id").alias("users"))
    amount = F.round(F.coalesce("rate", F.lit(0)) * F.col("total_duration") / 3600, 2).cast(D2)
    tagged = tags.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("tags"))
    return (
        projects.join(per, projects.id == per.project_id, "left")
        .join(tagged, "id", "left")
        .na.fill(0, ["total_duration", "users", "tags"])
        .select("id", "name", "status", "total_duration", "users", "tags", amount.alias("total_amount"))
    )

"""Monthly finance reports for all teams at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import round_half_up
from . import money

CASH_TYPES = ("depository", "other_asset")
D2 = "decimal(28,2)"


def posted(
    ledger: DataFrame,
    categories: DataFrame,
    fx: DataFrame,
    target: str,
    start: str,
    end: str,
    exact_dates: bool = False,
    same_currency_only: bool = True,
) -> DataFrame:
    """Rows a report may count, with ``amt`` in the target currency and ``month``.

    Internal, excluded-status and excluded-category rows are out. By default only
    rows whose own or base currency is the target are kept.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    if not exact_dates:
        lo, hi = F.trunc(lo, "MM"), F.last_day(hi)
    rows = ledger.filter(~F.col("internal") & (F.col("status") != "excluded") & F.col("date").between(lo, hi))
    if same_currency_only:
        rows = rows.filter((F.col("currency") == target) | F.coalesce(F.col("base_currency") == target, F.lit(False)))
    rows = money.resolve_amount(rows, fx, target)
    return money.join_categories(rows, categories).withColumn("month", F.trunc("date", "MM"))


def _sum_if(cond: Column, value: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast(D2).alias(name)


def month_grid(teams: DataFrame, start: str, end: str) -> DataFrame:
    months = F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.trunc(F.lit(end).cast("date"), "MM"), F.expr("INTERVAL 1 MONTH"))
    return teams.select("team_id", F.explode(months).alias("month"))


def monthly_totals(rows: DataFrame, start: str, end: str, is_revenue: Column | None = None) -> DataFrame:
    """One scan, one grouped pass: every monthly figure per team, zero-filled.

    gross / net revenue, COGS, operating expenses, recurring and other expenses,
    income and expenses of the cash flow.
    """
    revenue = is_revenue if is_revenue is not None else F.col("category_slug").isin(*money.REVENUE_SLUGS)
    revenue = F.coalesce(revenue, F.lit(False)) & ~F.col("category_slug").isin(*money.CONTRA_REVENUE_SLUGS)
    amt = F.col("amt")
    spent = amt < 0
    cogs = F.coalesce(F.col("category_parent_slug") == money.COGS_PARENT, F.lit(False))
    rate = F.coalesce("tax_rate", "category_tax_rate", F.lit(0))
    recurring = F.coalesce("recurring", F.lit(False))
    sums = rows.groupBy("team_id", "month").agg(
        _sum_if(revenue & (amt > 0), amt, "gross_revenue"),
        _sum_if(revenue & (amt > 0), money.net_of_tax(amt, rate), "net_revenue"),
        _sum_if(spent & cogs, -amt, "cogs"),
        _sum_if(spent & ~cogs, -amt, "operating_expenses"),
        _sum_if(spent & ~recurring, -amt, "other_expenses"),
        _sum_if(spent & recurring, -amt, "recurring_expenses"),
        _sum_if(amt > 0, amt, "income"),
        _sum_if(spent, -amt, "expenses"),
    )
    grid = month_grid(sums.select("team_id").distinct(), start, end)  # reads the grouped pass again, not the rows
    return grid.join(sums, ["team_id", "month"], "left").na.fill(0)


def revenue(totals: DataFrame, kind: str = "gross") -> DataFrame:
    return totals.select("team_id", "month", F.col(f"{kind}_revenue").alias("value"))


def profit(totals: DataFrame, kind: str = "net") -> DataFrame:
    value = F.col("net_revenue") - F.col("cogs")
    if kind == "net":
        value = value - F.col("operating_expenses")
    return totals.select("team_id", "month", value.cast(D2).alias("value"))


def burn_rate(totals: DataFrame) -> DataFrame:
    return totals.select("team_id", "month", F.col("expenses").alias("value"))


def expenses(totals: DataFrame) -> DataFrame:
    """Per month: other, recurring and total expense, with the team's monthly average."""
    average = F.avg("other_expenses").over(Window.partitionBy("team_id"))
    return totals.select(
        "team_id",
        "month",
        F.col("other_expenses").alias("value"),
        F.col("recurring_expenses").alias("recurring"),
        F.col("expenses").alias("total"),
        F.round(average, 2).cast(D2).alias("average_expense"),
    )


def cash_flow(totals: DataFrame) -> DataFrame:
    return totals.select("team_id", "month", "income", "expenses", (F.col("income") - F.col("expenses")).cast(D2).alias("net"))


def cash_flow_summary(totals: DataFrame) -> DataFrame:
    s = totals.groupBy("team_id").agg(
        F.sum("income").cast(D2).alias("total_income"),
        F.sum("expenses").cast(D2).alias("total_expenses"),
        F.count("*").alias("_n"),
    )
    net = F.col("total_income") - F.col("total_expenses")
    return s.select(
        "team_id",
        "total_income",
        "total_expenses",
        net.cast(D2).alias("net"),
        F.round(net / F.col("_n"), 2).cast(D2).alias("average_monthly"),
    )


def pct(new: Column, old: Column) -> Column:
    """Growth of ``new`` over ``old`` in percent, 0 when there is nothing to compare."""
    ratio = (new.cast("double") - old.cast("double")) / F.abs(old.cast("double")) * 100
    return F.when(old == 0, 0.0).otherwise(round_half_up(ratio, 2))


def year_over_year(series: DataFrame, start: str, end: str) -> DataFrame:
    """Each month of [start, end] next to the same month a year before.

    ``series`` must cover both ranges.
    """
    lo, hi = F.trunc(F.lit(start).cast("date"), "MM"), F.trunc(F.lit(end).cast("date"), "MM")
    now = series.filter(F.col("month").between(lo, hi))
    before = series.select("team_id", F.add_months("month", 12).alias("month"), F.col("value").alias("previous"))
    joined = now.join(before, ["team_id", "month"], "left").withColumn("previous", F.coalesce("previous", F.lit(0)).cast(D2))
    a, b = F.abs(F.col("value").cast("double")), F.abs(F.col("previous").cast("double"))
    change = F.when(b == 0, 0.0).otherwise(round_half_up(F.abs((a - b) / b * 100), 0))
    w = Window.partitionBy("team_id")
    return joined.select(
        "team_id",
        "month",
        F.col("value").alias("current"),
        "previous",
        change.cast("long").alias("percentage"),
        F.when(F.col("value") > F.col("previous"), "positive").otherwise("negative").alias("status"),
        F.sum("value").over(w).cast(D2).alias("current_total"),
        F.sum("previous").over(w).cast(D2).alias("previous_total"),
    )


def growth_rate(series: DataFrame, start: str, end: str, period: str = "quarterly") -> DataFrame:
    """Total of [start, end] against the range one period earlier, and of its last months."""
    back = {"monthly": 1, "quarterly": 3, "yearly": 12}[period]
    lo, hi = F.trunc(F.lit(start).cast("date"), "MM"), F.trunc(F.lit(end).cast("date"), "MM")
    plo, phi = F.add_months(lo, -back), F.add_months(hi, -back)
    span = F.floor(F.months_between(hi, lo)) + 1
    recent = F.least(F.lit(3), span)

    def total(cond, name):
        return F.coalesce(F.sum(F.when(cond, F.col("value"))), F.lit(0)).cast(D2).alias(name)

    m = F.col("month")
    s = series.groupBy("team_id").agg(
        total(m.between(lo, hi), "current_total"),
        total(m.between(plo, phi), "previous_total"),
        total(m.between(lo, hi) & (m > F.add_months(hi, -recent.cast("int"))), "_rc"),
        total(m.between(plo, phi) & (m > F.add_months(phi, -recent.cast("int"))), "_rp"),
    )
    growth = pct(F.col("current_total"), F.col("previous_total"))
    recent_growth = growth if period == "quarterly" else pct(F.col("_rc"), F.col("_rp"))
    s = s.withColumn("growth_rate", growth).withColumn("period_growth_rate", recent_growth)
    g = F.col("period_growth_rate")
    return s.withColumn("trend", F.when(g > 0, "positive").when(g < 0, "negative").otherwise("neutral")).drop("_rc", "_rp")


def margin_series(totals: DataFrame, kind: str = "net") -> DataFrame:
    rev = F.col("net_revenue" if kind == "net" else "gross_revenue")
    prof = F.col("net_revenue") - F.col("cogs") - (F.col("operating_expenses") if kind == "net" else F.lit(0))
    m = F.when(rev > 0, round_half_up(prof.cast("double") / rev.cast("double") * 100, 2)).otherwise(0.0)
    return totals.select("team_id", "month", rev.alias("revenue"), prof.cast(D2).alias("profit"), m.alias("margin"))


def profit_margin(totals: DataFrame, kind: str = "net") -> DataFrame:
    s = margin_series(totals, kind).groupBy("team_id").agg(
        F.sum("revenue").cast(D2).alias("total_revenue"),
        F.sum("profit").cast(D2).alias("total_profit"),
        F.avg(F.col("margin").cast("decimal(18,2)")).alias("_avg"),
        F.min_by("margin", "month").alias("_first"),
        F.max_by("margin", "month").alias("_last"),
        F.count("*").alias("month_count"),
    )
    overall = F.col("total_profit").cast("double") / F.col("total_revenue").cast("double") * 100
    last, first = F.col("_last"), F.col("_first")
    return s.select(
        "team_id",
        "total_revenue",
        "total_profit",
        F.when(F.col("total_revenue") > 0, round_half_up(overall, 2)).otherwise(0.0).alias("profit_margin"),
        F.round("_avg", 2).cast("decimal(18,2)").alias("average_margin"),
        F.when(last > first, "positive").when(last < first, "negative").otherwise("neutral").alias("trend"),
        "month_count",
    )


def spending(rows: DataFrame) -> DataFrame:
    """Spend per known category and for uncategorised rows, with its share of the total."""
    spent = rows.filter(F.col("amt") < 0)
    slug = F.when(F.col("category_known"), F.col("category_slug")).otherwise("uncategorized")
    by = spent.groupBy("team_id", slug.alias("slug")).agg(F.sum(-F.col("amt")).alias("_a"))
    total = F.sum("_a").over(Window.partitionBy("team_id"))
    share = F.col("_a").cast("double") / F.col("_t").cast("double") * 100
    return by.withColumn("_t", total).select(
        "team_id",
        "slug",
        F.round("_a", 2).cast(D2).alias("amount"),
        F.when(share > 1, round_half_up(share, 0)).otherwise(round_half_up(share, 2)).alias("percentage"),
    )


def period_spending(totals: DataFrame, spend: DataFrame) -> DataFrame:
    """Total expense of the period with the largest category."""
    total = totals.groupBy("team_id").agg(F.sum("expenses").cast(D2).alias("total_spending"))
    top = spend.groupBy("team_id").agg(F.max(F.struct("amount", "slug", "percentage")).alias("_t"))
    return total.join(top, "team_id", "left").select(
        "team_id",
        "total_spending",
        F.col("_t.slug").alias("top_category"),
        F.col("_t.amount").alias("top_amount"),
        F.col("_t.percentage").alias("top_percentage"),
    )


def tax_summary(rows: DataFrame, kind: str = "paid") -> DataFrame:
    """Tax paid (spend) or collected (income) per category and tax type."""
    side = F.col("amt") < 0 if kind == "paid" else F.col("amt") > 0
    rate = F.coalesce("tax_rate", "category_tax_rate")
    r = F.coalesce(rate, F.lit(0))
    taxed = rows.filter(side & rate.isNotNull())
    tax = (F.col("amt") * r / (F.lit(100) + r)).cast("decimal(28,12)")
    slug = F.when(F.col("category_known"), F.col("category_slug")).otherwise("uncategorized")
    return taxed.groupBy("team_id", slug.alias("category_slug"), F.coalesce("tax_type", "category_tax_type").alias("tax_type")).agg(
        F.round(F.abs(F.sum(tax)), 2).cast(D2).alias("total_tax"),
        F.round(F.abs(F.sum("amt")), 2).cast(D2).alias("total_amount"),
        F.count("*").alias("transactions"),
        F.round(F.avg(rate), 2).cast("decimal(10,2)").alias("average_rate"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def cash_balance(accounts: DataFrame, target: str, fx: DataFrame, unconvertible: str = "zero") -> DataFrame:
    """Cash of enabled cash accounts; ``unconvertible`` balances count as zero or raw."""
    a = money.with_rate(accounts.filter(F.col("enabled") & F.col("type").isin(*CASH_TYPES)), fx, target)
    other = F.lit(0).cast("decimal(18,2)")
    if unconvertible == "raw":
        other = F.coalesce(F.round(F.col("balance") * F.col("_rate"), 2), F.col("balance")).cast("decimal(18,2)")
    value = (
        F.when(F.col("currency") == target, F.coalesce("balance", F.lit(0)))
        .when(F.col("base_currency") == target, F.coalesce("base_balance", F.lit(0)))
        .otherwise(other)
    ).cast("decimal(18,2)")
    return a.withColumn("cash", value)


def runway(burn: DataFrame, cash: DataFrame, as_of: str) -> DataFrame:
    """Whole months the cash lasts at the median burn of the last three full months."""
    hi = F.trunc(F.lit(as_of).cast("date"), "MM")
    last = burn.filter((F.col("month") < hi) & (F.col("month") >= F.add_months(hi, -3)) & (F.col("value") > 0))
    med = last.groupBy("team_id").agg(F.median("value").alias("median_burn"))
    return (
        cash.groupBy("team_id")
        .agg(F.sum("cash").cast(D2).alias("cash"))
        .join(med, "team_id", "left")
        .select(
            "team_id",
            "cash",
            F.coalesce(F.col("median_burn").cast("double"), F.lit(0.0)).alias("median_burn"),
            F.coalesce(F.floor(F.col("cash").cast("double") / F.col("median_burn").cast("double") + 0.5), F.lit(0)).cast("long").alias("months"),
        )
    )


def net_position(accounts: DataFrame, target: str, fx: DataFrame) -> DataFrame:
    """Cash minus what is owed on credit accounts, per team."""
    cash = cash_balance(accounts, target, fx, "raw").groupBy("team_id").agg(F.sum("cash").cast(D2).alias("cash"), F.count("*").alias("cash_accounts"))
    c = money.with_rate(accounts.filter(F.col("enabled") & (F.col("type") == "credit")), fx, target)
    owed = (
        F.when(F.col("currency") == target, F.abs("balance"))
        .when(F.col("base_currency") == target, F.abs(F.coalesce("base_balance", F.lit(0))))
        .otherwise(F.abs(F.coalesce(F.round(F.col("balance") * F.col("_rate"), 2), F.col("balance"))))
    ).cast("decimal(18,2)")
    credit = c.groupBy("team_id").agg(F.sum(owed).cast(D2).alias("credit_debt"), F.count("*").alias("credit_accounts"))
    out = cash.join(credit, "team_id", "full").na.fill(0)
    return out.withColumn("net_position", (F.col("cash") - F.col("credit_debt")).cast(D2))


def recurring_expenses(rows: DataFrame) -> DataFrame:
    """Average spend of each recurring (name, frequency, category) and its monthly equivalent."""
    freq = F.coalesce("frequency", F.lit("irregular"))
    rec = rows.filter((F.col("amt") < 0) & F.coalesce("recurring", F.lit(False)))
    by = rec.groupBy(
        "team_id", "name", freq.alias("frequency"), F.when(F.col("category_known"), F.col("category_slug")).alias("category_slug")
    ).agg(F.sum(-F.col("amt")).alias("_s"), F.count("*").alias("transactions"), F.max("date").alias("last_date"))
    avg = (F.col("_s") / F.col("transactions")).cast("decimal(28,6)")
    monthly = F.when(F.col("frequency") == "weekly", avg * F.lit("4.33").cast("decimal(4,2)")).when(
        F.col("frequency") == "annually", avg / 12
    ).otherwise(avg)
    return by.select(
        "team_id",
        "name",
        "frequency",
        "category_slug",
        F.round(avg, 2).cast(D2).alias("amount"),
        F.round(monthly, 2).cast(D2).alias("monthly_equivalent"),
        "transactions",
        "last_date",
    )


def recurring_summary(items: DataFrame, top: int = 10) -> DataFrame:
    """Totals by frequency and the monthly equivalent, with the ``top`` largest names."""
    w = Window.partitionBy("team_id").orderBy(F.desc("amount"), "name", "frequency", "category_slug")
    ranked = items.withColumn("_rn", F.row_number().over(w))

    def total(f):
        return F.coalesce(F.sum(F.when(F.col("frequency") == f, F.col("amount"))), F.lit(0)).cast(D2).alias(f)

    return ranked.groupBy("team_id").agg(
        F.sum("monthly_equivalent").cast(D2).alias("total_monthly_equivalent"),
        F.count("*").alias("total_expenses"),
        *[total(f) for f in ("weekly", "monthly", "annually", "irregular")],
        F.concat_ws(
            ",",
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_rn") <= top, F.struct("_rn", "name")))), lambda x: x["name"]
            ),
        ).alias("top_names"),
    )

"""Balance sheet of every team at a date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import money, reports

D2 = "decimal(28,2)"
ASSET_SLUGS = ("prepaid-expenses", "fixed-assets", "software", "inventory", "equipment")
LIFE_MONTHS = {"fixed-assets": 60, "equipment": 60, "software": 36}
ACCOUNT_KINDS = {"credit": "credit_card_debt", "loan": "loan_account_debt", "other_asset": "other_assets", "other_liability": "other_liabilities"}


def _total(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))


def ledger_lines(rows: DataFrame, as_of: str, is_revenue: Column | None = None) -> DataFrame:
    """Every ledger figure of the sheet in one grouped pass over ``reports.posted`` rows."""
    slug, amt = F.col("category_slug"), F.col("amt")
    day = F.lit(as_of).cast("date")
    revenue = is_revenue if is_revenue is not None else slug.isin(*money.REVENUE_SLUGS)
    held = F.months_between(F.trunc(day, "MM"), F.trunc("date", "MM")).cast("int")
    life = F.when(slug == "software", LIFE_MONTHS["software"]).otherwise(LIFE_MONTHS["equipment"])
    worn = (F.abs(amt) * F.least(held, life) / life).cast("decimal(28,8)")
    is_asset = slug.isin("fixed-assets", "equipment", "software")
    s = rows.groupBy("team_id").agg(
        *[F.abs(_total(slug == a, amt)).alias(a.replace("-", "_")) for a in ASSET_SLUGS],
        _total(is_asset & (held > 0), worn).alias("accumulated_depreciation"),
        _total(slug == "loan-proceeds", amt).alias("_loans"),
        F.abs(_total(slug == "loan-principal-repayment", amt)).alias("_repaid"),
        _total((slug == "loan-proceeds") & (F.col("date") >= F.add_months(day, -12)), F.abs(amt)).alias("_short"),
        _total((slug == "loan-proceeds") & (F.col("date") < F.add_months(day, -12)), F.abs(amt)).alias("_long"),
        _total(slug == "deferred-revenue", amt).alias("deferred_revenue"),
        _total(slug == "leases", amt).alias("leases"),
        _total(slug == "capital-investment", amt).alias("capital_investment"),
        F.abs(_total(slug == "owner-draws", amt)).alias("owner_draws"),
        _total(F.coalesce(revenue, F.lit(False)) & ~slug.isin(*money.CONTRA_REVENUE_SLUGS) & (amt > 0), amt).alias("_revenue"),
        _total((amt < 0) & F.coalesce(~slug.isin(*ASSET_SLUGS), F.lit(True)), -amt).alias("_expenses"),
    )

    def share(part):
        # repayments reduce both ages in proportion to the proceeds
        cut = F.when(F.col("_loans") > 0, F.col("_repaid") * F.col(part) / F.col("_loans")).otherwise(0)
        return F.greatest(F.lit(0), F.col(part) - cut).cast("decimal(28,8)")

    return (
        s.withColumn("short_term_debt", share("_short"))
        .withColumn("long_term_debt", share("_long"))
        .withColumn("retained_earnings", F.col("_revenue") - F.col("_expenses"))
        .drop("_loans", "_repaid", "_short", "_long", "_revenue", "_expenses")
    )


def _converted(rows: DataFrame, fx: DataFrame, target: str, amount: str, base: str | None, name: str) -> DataFrame:
    """Own, base or rate-converted value; rows without a rate drop out of the sums."""
    out = money.with_rate(rows, fx, target)
    value = F.when(F.col("currency") == target, F.col(amount).cast("decimal(28,10)"))
    if base:
        value = value.when((F.col("base_currency") == target) & F.col(base).isNotNull(), F.col(base).cast("decimal(28,10)"))
    return out.withColumn(name, value.otherwise((F.col(amount) * F.col("_rate")).cast("decimal(28,10)")))


def balance_sheet(
    rows: DataFrame, accounts: DataFrame, invoices: DataFrame, bills: DataFrame, fx: DataFrame, target: str, as_of: str, is_revenue: Column | None = None
) -> DataFrame:
    """One line per team. Assets equal liabilities plus equity: a difference beyond 0.01
    moves into retained earnings and is shown as ``plug``."""
    led = ledger_lines(rows, as_of, is_revenue)
    cash = reports.cash_balance(accounts, target, fx, "raw").groupBy("team_id").agg(F.sum("cash").alias("cash"))
    acc = _converted(accounts.filter("enabled"), fx, target, "balance", "base_balance", "_v")
    kinds = acc.groupBy("team_id").agg(*[_total(F.col("type") == t, F.abs("_v")).alias(n) for t, n in ACCOUNT_KINDS.items()])
    due = invoices.filter(F.col("status").isin("unpaid", "overdue") | ((F.col("status") == "scheduled") & (F.col("issue_date") <= F.lit(as_of).cast("date"))))
    ar = _converted(due, fx, target, "amount", None, "_v").groupBy("team_id").agg(F.sum("_v").alias("accounts_receivable"))
    ap = _converted(bills, fx, target, "amount", "base_amount", "_v").groupBy("team_id").agg(F.sum(F.abs("_v")).alias("accounts_payable"))
    out = reduce(lambda a, b: a.join(b, "team_id", "full"), [led, cash, kinds, ar, ap])
    figures = [c for c in out.columns if c != "team_id"]
    out = out.select("team_id", *[F.round(F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,10)"), 2).cast(D2).alias(c) for c in figures])
    c = F.col
    out = (
        out.withColumn("long_term_debt", (c("long_term_debt") + c("loan_account_debt")).cast(D2))
        .withColumn("fixed_assets", (c("fixed_assets") + c("equipment")).cast(D2))
        .drop("equipment", "loan_account_debt")
    )
    current = c("cash") + c("accounts_receivable") + c("inventory") + c("prepaid_expenses")
    fixed = c("fixed_assets") - c("accumulated_depreciation") + c("software") + c("other_assets")
    owed = c("accounts_payable") + c("short_term_debt") + c("credit_card_debt") + c("long_term_debt") + c("deferred_revenue") + c("leases") + c("other_liabilities")
    out = out.withColumn("total_assets", (current + fixed).cast(D2)).withColumn("total_liabilities", owed.cast(D2))
    equity = c("capital_investment") - c("owner_draws") + c("retained_earnings")
    gap = c("total_assets") - c("total_liabilities") - equity
    out = out.withColumn("plug", F.when(F.abs(gap) > 0.01, gap).otherwise(0).cast(D2))
    out = out.withColumn("retained_earnings", (c("retained_earnings") + c("plug")).cast(D2))
    return out.withColumn("total_equity", (c("capital_investment") - c("owner_draws") + c("retained_earnings")).cast(D2))

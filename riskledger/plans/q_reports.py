"""Finance reports over the ledger view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import money, reports
from .registry import query
from .views_sql import view

START, END, AS_OF = "1997-01-01", "1999-12-31", "1999-06-15"


def rnd(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(22,12)), {n}) AS DOUBLE)"


view(
    "v_resolved",
    "v_ledger v_fx",
    """SELECT l.*, CAST(CASE WHEN base_currency = 'USD' AND base_amount IS NOT NULL THEN base_amount WHEN currency = 'USD' THEN amount
  ELSE amount * rate END AS DECIMAL(28,10)) AS amt FROM v_ledger l LEFT JOIN (SELECT base, rate FROM v_fx WHERE target = 'USD') f ON l.currency = f.base""",
)
view(
    "v_posted",
    "v_resolved v_category",
    f"""SELECT r.*, date_trunc('month', date)::DATE AS month, c.slug IS NOT NULL AS known, c.parent_slug, c.tax_rate AS cat_rate, c.tax_type AS cat_type
  FROM v_resolved r LEFT JOIN v_category c ON r.category_slug = c.slug WHERE NOT internal AND status <> 'excluded' AND date BETWEEN DATE '{START}' AND DATE '{END}'
  AND (currency = 'USD' OR base_currency = 'USD') AND NOT coalesce(c.excluded, FALSE)""",
)
_NET = """CAST((2 * CAST(amt * 10000000000 AS HUGEINT) * 10000 + CAST((100 + r) * 100 AS HUGEINT) * 100000000)
   // (2 * CAST((100 + r) * 100 AS HUGEINT) * 100000000) AS DECIMAL(28,2)) / 100"""


def _sum(cond, val, name):
    return f"CAST(coalesce(round(sum(CASE WHEN {cond} THEN {val} END), 2), 0) AS DECIMAL(28,2)) AS {name}"


view(
    "v_monthly",
    "v_posted",
    f"""SELECT team_id, g.month, {', '.join(f'CAST(coalesce({c}, 0) AS DECIMAL(28,2)) AS {c}' for c in ('gross_revenue', 'net_revenue', 'cogs', 'operating_expenses', 'other_expenses', 'recurring_expenses', 'income', 'expenses'))}
  FROM (SELECT team_id, m::DATE AS month FROM (SELECT DISTINCT team_id FROM v_posted), generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH) t(m)) g
  LEFT JOIN (SELECT team_id, month, {_sum("rev AND amt > 0", "amt", "gross_revenue")}, {_sum("rev AND amt > 0", "CAST(net AS DECIMAL(28,2))", "net_revenue")},
   {_sum("amt < 0 AND cogs", "-amt", "cogs")}, {_sum("amt < 0 AND NOT cogs", "-amt", "operating_expenses")},
   {_sum("amt < 0 AND NOT coalesce(recurring, FALSE)", "-amt", "other_expenses")}, {_sum("amt < 0 AND recurring", "-amt", "recurring_expenses")},
   {_sum("amt > 0", "amt", "income")}, {_sum("amt < 0", "-amt", "expenses")}
   FROM (SELECT *, {_NET} AS net FROM (SELECT *, coalesce(category_slug IN ('cat-0','cat-1','cat-2','cat-3','cat-4'), FALSE) AS rev,
     coalesce(parent_slug = 'cost-of-goods-sold', FALSE) AS cogs, coalesce(tax_rate, cat_rate, 0) AS r FROM v_posted)) GROUP BY 1, 2) s USING (team_id, month)""",
)


def _posted(spark, sf, start=START, end=END):
    return reports.posted(v.ledger(spark, sf), v.category(spark), v.fx(spark), "USD", start, end)


def _totals(spark, sf):
    rows = _posted(spark, sf)
    return reports.monthly_totals(rows, START, END, F.col("category_slug").isin(*[f"cat-{i}" for i in range(5)]))


@query("report_revenue_gross", "AGG-04 JON-02 JON-03", "SELECT team_id, month, gross_revenue AS value FROM v_monthly", "v_monthly")
def report_revenue_gross(spark, sf):
    return reports.revenue(_totals(spark, sf), "gross")


@query("report_revenue_net", "AGG-04 FN-19", "SELECT team_id, month, net_revenue AS value FROM v_monthly", "v_monthly")
def report_revenue_net(spark, sf):
    return reports.revenue(_totals(spark, sf), "net")


@query("report_profit_net", "AGG-05", "SELECT team_id, month, net_revenue - cogs - operating_expenses AS value FROM v_monthly", "v_monthly")
def report_profit_net(spark, sf):
    return reports.profit(_totals(spark, sf), "net")


@query("report_profit_gross", "AGG-05", "SELECT team_id, month, net_revenue - cogs AS value FROM v_monthly", "v_monthly")
def report_profit_gross(spark, sf):
    return reports.profit(_totals(spark, sf), "gross")


@query(
    "report_year_over_year",
    "AGG-06",
    f"""SELECT team_id, month, current, previous, CAST(CASE WHEN previous = 0 THEN 0 ELSE {rnd('abs((abs(current::DOUBLE) - abs(previous::DOUBLE)) / abs(previous::DOUBLE) * 100)', 0)} END AS BIGINT) AS percentage,
    CASE WHEN current > previous THEN 'positive' ELSE 'negative' END AS status, sum(current) OVER (PARTITION BY team_id) AS current_total, sum(previous) OVER (PARTITION BY team_id) AS previous_total
    FROM (SELECT a.team_id, a.month, a.p AS current, coalesce(b.p, 0) AS previous FROM (SELECT *, net_revenue - cogs - operating_expenses AS p FROM v_monthly) a
    LEFT JOIN (SELECT *, net_revenue - cogs - operating_expenses AS p FROM v_monthly) b ON a.team_id = b.team_id AND b.month = a.month - INTERVAL 1 YEAR
    WHERE a.month BETWEEN DATE '1998-04-01' AND DATE '1999-03-01')""",
    "v_monthly",
)
def report_year_over_year(spark, sf):
    return reports.year_over_year(reports.profit(_totals(spark, sf)), "1998-04-01", "1999-03-31")


def _growth_sql(back: int, quarterly: bool) -> str:
    g = "CASE WHEN {1} = 0 THEN 0 ELSE " + rnd("({0}::DOUBLE - {1}::DOUBLE) / abs({1}::DOUBLE) * 100", 2) + " END"
    main, rec = g.format("c", "p"), g.format("rc", "rp")
    return f"""SELECT team_id, c AS current_total, p AS previous_total, {main} AS growth_rate, {main if quarterly else rec} AS period_growth_rate,
    CASE WHEN {main if quarterly else rec} > 0 THEN 'positive' WHEN {main if quarterly else rec} < 0 THEN 'negative' ELSE 'neutral' END AS trend
    FROM (SELECT team_id, sum(CASE WHEN month BETWEEN DATE '1998-07-01' AND DATE '1998-12-01' THEN v ELSE 0 END) AS c,
     sum(CASE WHEN month BETWEEN DATE '1998-07-01' - INTERVAL {back} MONTH AND DATE '1998-12-01' - INTERVAL {back} MONTH THEN v ELSE 0 END) AS p,
     sum(CASE WHEN month BETWEEN DATE '1998-10-01' AND DATE '1998-12-01' THEN v ELSE 0 END) AS rc,
     sum(CASE WHEN month BETWEEN DATE '1998-10-01' - INTERVAL {back} MONTH AND DATE '1998-12-01' - INTERVAL {back} MONTH THEN v ELSE 0 END) AS rp
     FROM (SELECT team_id, month, net_revenue AS v FROM v_monthly) GROUP BY team_id)"""


for _p, _back in (("monthly", 1), ("quarterly", 3), ("yearly", 12)):

    @query(f"report_growth_{_p}", "AGG-13", _growth_sql(_back, _p == "quarterly"), "v_monthly")
    def report_growth(spark, sf, _p=_p):
        return reports.growth_rate(reports.revenue(_totals(spark, sf), "net"), "1998-07-01", "1998-12-31", _p)


@query("report_burn_rate", "AGG-07", "SELECT team_id, month, expenses AS value FROM v_monthly", "v_monthly")
def report_burn_rate(spark, sf):
    return reports.burn_rate(_totals(spark, sf))


@query(
    "report_expenses",
    "AGG-08",
    """SELECT team_id, month, other_expenses AS value, recurring_expenses AS recurring, expenses AS total,
    CAST(round(CAST(sum(other_expenses) OVER (PARTITION BY team_id) / 36 AS DECIMAL(28,8)), 2) AS DECIMAL(28,2)) AS average_expense FROM v_monthly""",
    "v_monthly",
)
def report_expenses(spark, sf):
    return reports.expenses(_totals(spark, sf))


@query("report_cash_flow", "AGG-15", "SELECT team_id, month, income, expenses, income - expenses AS net FROM v_monthly", "v_monthly")
def report_cash_flow(spark, sf):
    return reports.cash_flow(_totals(spark, sf))


@query(
    "report_cash_flow_summary",
    "AGG-15",
    """SELECT team_id, sum(income) AS total_income, sum(expenses) AS total_expenses, sum(income) - sum(expenses) AS net,
    CAST(round(CAST((sum(income) - sum(expenses)) / 36 AS DECIMAL(28,8)), 2) AS DECIMAL(28,2)) AS average_monthly FROM v_monthly GROUP BY team_id""",
    "v_monthly",
)
def report_cash_flow_summary(spark, sf):
    return reports.cash_flow_summary(_totals(spark, sf))


view(
    "v_margin",
    "v_monthly",
    f"""SELECT team_id, month, net_revenue AS revenue, net_revenue - cogs - operating_expenses AS profit, CASE WHEN net_revenue > 0 THEN
  {rnd('(net_revenue - cogs - operating_expenses)::DOUBLE / net_revenue::DOUBLE * 100', 2)} ELSE 0 END AS margin FROM v_monthly""",
)


@query("report_margin_series", "AGG-14", "SELECT * FROM v_margin", "v_margin")
def report_margin_series(spark, sf):
    return reports.margin_series(_totals(spark, sf))


@query(
    "report_profit_margin",
    "AGG-14",
    f"""SELECT team_id, sum(revenue) AS total_revenue, sum(profit) AS total_profit, CASE WHEN sum(revenue) > 0 THEN {rnd('sum(profit)::DOUBLE / sum(revenue)::DOUBLE * 100', 2)} ELSE 0 END AS profit_margin,
    CAST(round(CAST(sum(CAST(margin AS DECIMAL(18,2))) / 36 AS DECIMAL(28,8)), 2) AS DECIMAL(18,2)) AS average_margin,
    CASE WHEN arg_max(margin, month) > arg_min(margin, month) THEN 'positive' WHEN arg_max(margin, month) < arg_min(margin, month) THEN 'negative' ELSE 'neutral' END AS trend,
    count(*) AS month_count FROM v_margin GROUP BY team_id""",
    "v_margin",
)
def report_profit_margin(spark, sf):
    return reports.profit_margin(_totals(spark, sf))


view(
    "v_spending",
    "v_posted",
    f"""SELECT team_id, slug, CAST(round(a, 2) AS DECIMAL(28,2)) AS amount, CASE WHEN p > 1 THEN {rnd('p', 0)} ELSE {rnd('p', 2)} END AS percentage
  FROM (SELECT *, a::DOUBLE / (sum(a) OVER (PARTITION BY team_id))::DOUBLE * 100 AS p FROM (SELECT team_id, CASE WHEN known THEN category_slug ELSE 'uncategorized' END AS slug, sum(-amt) AS a
  FROM v_posted WHERE amt < 0 GROUP BY 1, 2))""",
)


@query("report_spending", "AGG-09 JON-04", "SELECT * FROM v_spending", "v_spending")
def report_spending(spark, sf):
    return reports.spending(_posted(spark, sf))


@query(
    "report_uncategorized",
    "JON-04",
    """SELECT team_id, count(*) AS n, CAST(sum(amount) AS DECIMAL(28,2)) AS amount FROM v_ledger l
    WHERE NOT EXISTS (SELECT 1 FROM v_category c WHERE c.slug = l.category_slug) GROUP BY team_id""",
    "v_ledger v_category",
)
def report_uncategorized(spark, sf):
    out = money.uncategorized(v.ledger(spark, sf), v.category(spark))
    return out.groupBy("team_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query(
    "report_period_spending",
    "AGG-11",
    """SELECT team_id, total_spending, slug AS top_category, amount AS top_amount, percentage AS top_percentage FROM
    (SELECT team_id, sum(expenses) AS total_spending FROM v_monthly GROUP BY 1) JOIN (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY amount DESC, slug DESC) AS rn FROM v_spending) USING (team_id) WHERE rn = 1""",
    "v_monthly v_spending",
)
def report_period_spending(spark, sf):
    return reports.period_spending(_totals(spark, sf), reports.spending(_posted(spark, sf)))


for _k, _op in (("paid", "<"), ("collected", ">")):

    @query(
        f"report_tax_{_k}",
        "AGG-12",
        f"""SELECT team_id, CASE WHEN known THEN category_slug ELSE 'uncategorized' END AS category_slug, coalesce(tax_type, cat_type) AS tax_type,
    CAST(round(abs(sum(CAST(amt::DOUBLE * r::DOUBLE / (100 + r::DOUBLE) AS DECIMAL(28,12)))), 2) AS DECIMAL(28,2)) AS total_tax, CAST(round(abs(sum(amt)), 2) AS DECIMAL(28,2)) AS total_amount,
    count(*) AS transactions, CAST(round(CAST(sum(r) / count(*) AS DECIMAL(18,8)), 2) AS DECIMAL(10,2)) AS average_rate, min(date) AS first_date, max(date) AS last_date
    FROM (SELECT *, coalesce(tax_rate, cat_rate) AS r FROM v_posted) WHERE r IS NOT NULL AND amt {_op} 0 GROUP BY 1, 2, 3""",
        "v_posted",
    )
    def report_tax(spark, sf, _k=_k):
        return reports.tax_summary(_posted(spark, sf), _k)


view(
    "v_cash",
    "v_account v_fx",
    """SELECT a.*, rate, CAST(CASE WHEN currency = 'USD' THEN coalesce(balance, 0) WHEN base_currency = 'USD' THEN coalesce(base_balance, 0) ELSE 0 END AS DECIMAL(18,2)) AS cash,
  CAST(CASE WHEN currency = 'USD' THEN balance WHEN base_currency = 'USD' THEN coalesce(base_balance, 0) ELSE coalesce(round(balance * rate, 2), balance) END AS DECIMAL(18,2)) AS raw
  FROM v_account a LEFT JOIN (SELECT base, rate FROM v_fx WHERE target = 'USD') ON currency = base WHERE enabled""",
)


@query(
    "report_runway",
    "AGG-10",
    """SELECT c.team_id, cash, coalesce(med, 0) AS median_burn, coalesce(CAST(floor(cash::DOUBLE / med + 0.5) AS BIGINT), 0) AS months
    FROM (SELECT team_id, sum(cash) AS cash FROM v_cash WHERE type IN ('depository','other_asset') GROUP BY 1) c
    LEFT JOIN (SELECT team_id, median(expenses::DOUBLE) AS med FROM v_monthly WHERE month BETWEEN DATE '1999-03-01' AND DATE '1999-05-31' AND expenses > 0 GROUP BY 1) b USING (team_id)""",
    "v_cash v_monthly",
)
def report_runway(spark, sf):
    cash = reports.cash_balance(v.account(spark, sf), "USD", v.fx(spark))
    return reports.runway(reports.burn_rate(_totals(spark, sf)), cash, AS_OF)


@query(
    "report_cash_accounts",
    "AGG-26",
    "SELECT id, team_id, raw AS cash FROM v_cash WHERE type IN ('depository','other_asset')",
    "v_cash",
)
def report_cash_accounts(spark, sf):
    return reports.cash_balance(v.account(spark, sf), "USD", v.fx(spark), "raw").select("id", "team_id", "cash")


@query(
    "report_net_position",
    "AGG-26",
    """SELECT team_id, coalesce(cash, 0) AS cash, coalesce(cash_accounts, 0) AS cash_accounts, coalesce(debt, 0) AS credit_debt, coalesce(credit_accounts, 0) AS credit_accounts,
    coalesce(cash, 0) - coalesce(debt, 0) AS net_position FROM (SELECT team_id, sum(raw) AS cash, count(*) AS cash_accounts FROM v_cash WHERE type IN ('depository','other_asset') GROUP BY 1)
    FULL JOIN (SELECT team_id, sum(abs(raw)) AS debt, count(*) AS credit_accounts FROM v_cash WHERE type = 'credit' GROUP BY 1) USING (team_id)""",
    "v_cash",
)
def report_net_position(spark, sf):
    return reports.net_position(v.account(spark, sf), "USD", v.fx(spark))


view(
    "v_recurring",
    "v_posted",
    """SELECT team_id, name, frequency, category_slug, CAST(round(a, 2) AS DECIMAL(28,2)) AS amount, CAST(round(CASE frequency WHEN 'weekly' THEN a * 4.33 WHEN 'annually' THEN CAST(a / 12 AS DECIMAL(28,8)) ELSE a END, 2) AS DECIMAL(28,2)) AS monthly_equivalent,
  transactions, last_date FROM (SELECT team_id, name, coalesce(frequency, 'irregular') AS frequency, CASE WHEN known THEN category_slug END AS category_slug, CAST(sum(-amt) / count(*) AS DECIMAL(28,6)) AS a, count(*) AS transactions, max(date) AS last_date
  FROM v_posted WHERE amt < 0 AND recurring GROUP BY 1, 2, 3, 4)""",
)


@query("report_recurring_expenses", "AGG-17", "SELECT * FROM v_recurring", "v_recurring")
def report_recurring_expenses(spark, sf):
    return reports.recurring_expenses(_posted(spark, sf))


@query(
    "report_recurring_summary",
    "AGG-17",
    """SELECT team_id, sum(monthly_equivalent) AS total_monthly_equivalent, count(*) AS total_expenses,
    coalesce(sum(CASE WHEN frequency = 'weekly' THEN amount END), 0) AS weekly, coalesce(sum(CASE WHEN frequency = 'monthly' THEN amount END), 0) AS monthly,
    coalesce(sum(CASE WHEN frequency = 'annually' THEN amount END), 0) AS annually, coalesce(sum(CASE WHEN frequency = 'irregular' THEN amount END), 0) AS irregular,
    string_agg(CASE WHEN rn <= 10 THEN name END, ',' ORDER BY rn) AS top_names
    FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY amount DESC, name, frequency, category_slug NULLS FIRST) AS rn FROM v_recurring) GROUP BY team_id""",
    "v_recurring",
)
def report_recurring_summary(spark, sf):
    return reports.recurring_summary(reports.recurring_expenses(_posted(spark, sf)))

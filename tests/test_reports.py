"""Hand-worked figures of the monthly reports."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskledger.functions import text as tx
from riskledger.operators import forecast, money, reports
from riskledger.sources import tables

SCHEMA = "id string, team_id int, date date, amount decimal(18,2), currency string, base_currency string, base_amount decimal(18,2), category_slug string, tax_rate decimal(10,2), tax_type string, recurring boolean, frequency string, name string, status string, internal boolean"


def row(i, day, amount, cur="USD", bc=None, ba=None, slug=None, rate=None, rec=None, status="posted", internal=False):
    d = Decimal
    return (str(i), 1, dt.date.fromisoformat(day), d(amount), cur, bc, d(ba) if ba else None, slug, d(rate) if rate else None, None, rec, None, "n", status, internal)


@pytest.fixture(scope="module")
def totals(spark):
    rows = [
        row(1, "2024-01-05", "1000", slug="income", rate="20"),
        row(2, "2024-01-09", "500", "EUR", "USD", "550", "income"),
        row(3, "2024-01-10", "100", "EUR", "USD", None, "income"),  # converted at the latest rate
        row(4, "2024-01-11", "100", "EUR", None, None, "income"),  # other currency: not counted
        row(5, "2024-01-12", "70", slug="secret"),  # excluded category
        row(6, "2024-01-15", "-300", slug="materials"),  # child of cost of goods
        row(7, "2024-01-16", "-200", slug="cost-of-goods-sold"),  # the parent itself is operating
        row(8, "2024-01-17", "-50", rec=True),
        row(9, "2024-01-18", "-40", internal=True),
        row(10, "2024-01-19", "-30", status="excluded"),
        row(11, "2024-03-01", "-10", slug="unknown-slug"),
    ]
    cats = spark.createDataFrame(
        [("income", "revenue", None, None, None), ("materials", "cost-of-goods-sold", False, None, None), ("cost-of-goods-sold", None, None, None, None), ("secret", None, True, None, None)],
        "slug string, parent_slug string, excluded boolean, tax_rate decimal(10,2), tax_type string",
    )
    fx = spark.createDataFrame([("EUR", "USD", Decimal("1.3"), dt.date(2023, 1, 1)), ("EUR", "USD", Decimal("1.1"), dt.date(2024, 1, 1))], "base string, target string, rate decimal(18,8), updated_at date")
    p = reports.posted(spark.createDataFrame(rows, SCHEMA), cats, fx, "USD", "2024-01-01", "2024-03-31")
    return reports.monthly_totals(p, "2024-01-01", "2024-03-31")


def test_months(totals):
    m = {r.month.month: r for r in totals.collect()}
    assert set(m) == {1, 2, 3}
    assert m[1].gross_revenue == Decimal("1660.00")  # 1000 + 550 + 110
    assert m[1].net_revenue == Decimal("1493.33")  # 833.33 + 550 + 110
    assert (m[1].cogs, m[1].operating_expenses) == (Decimal("300.00"), Decimal("250.00"))
    assert (m[1].recurring_expenses, m[1].other_expenses) == (Decimal("50.00"), Decimal("500.00"))
    assert m[2].expenses == 0 and m[3].expenses == Decimal("10.00")


def test_identities(totals):
    for r in reports.cash_flow(totals).collect():
        assert r.net == r.income - r.expenses
    assert {r.month.month: r.value for r in reports.profit(totals).collect()}[1] == Decimal("943.33")


def test_growth_uses_calendar_months(totals):
    g = reports.growth_rate(reports.revenue(totals), "2024-03-01", "2024-03-31", "monthly").first()
    assert (g.current_total, g.previous_total, g.trend) == (0, 0, "neutral")


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 10.0, 0.5), (1, 20.0, 0.6), (1, 30.0, 0.7)], "team_id int, v double, w double")
    assert money.weighted_median(df, ["team_id"], "v", "w").first().weighted_median == 20.0


@pytest.mark.parametrize("text,value", [("1.234,56", "1234.56"), ("1.234.56", "1234.56"), ("−12.50", "-12.50"), ("99", "99.00"), ("x", None)])
def test_amount_text(spark, text, value):
    got = spark.range(1).select(tables.parse_amount(F.lit(text))).first()[0]
    assert got == (Decimal(value) if value else None)


@pytest.mark.parametrize("text,value", [("2024-02-30", None), ("2024-02-29T10:00", "2024-02-29"), ("3/4/2024", "2024-04-03"), ("nonsense", None)])
def test_date_text(spark, text, value):
    got = spark.range(1).select(tables.parse_date(F.lit(text))).first()[0]
    assert (str(got) if got else None) == value


@pytest.mark.parametrize("a,b,score", [("Acme Inc", "ACME", 1.0), ("Café Noir", "Cafe Noir Ltd", 1.0), ("Blue Ocean", "Blue Sky", 0.6), ("GitHub", "Git Hub", 0.95), ("x", "y", 0.0)])
def test_name_score(spark, a, b, score):
    assert spark.range(1).select(tx.name_score(F.lit(a), F.lit(b))).first()[0] == score


def test_a_start_in_the_hour_that_occurs_twice_stays_itself(spark):
    rows = [(i, f"1992-10-25 0{i}:30:00") for i in (4, 5, 6, 7)]  # 00:30, 01:30 twice and 02:30 in New York
    s = spark.createDataFrame(rows, "id long, at0 string").select(
        "id", F.col("at0").cast("timestamp").alias("start_at"), F.lit("America/New_York").alias("timezone"), F.lit("weekly").alias("frequency"), F.lit(0).alias("frequency_day"),
        F.lit(None).cast("int").alias("frequency_week"), F.lit(None).cast("int").alias("frequency_interval"), F.lit("never").alias("end_type"), F.lit(None).cast("date").alias("end_date"),
        F.lit(5).alias("end_count"), F.lit(0).alias("generated"),
    )
    out = forecast.upcoming_at(s, 2)
    assert out.filter((F.col("k") == 0) & (F.col("at") != F.col("start_at"))).count() == 0 and out.count() == 8

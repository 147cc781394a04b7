"""Category tree, tax rates and fiscal years as fixed values and the lookups on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category tree, parent slug to child slugs.
CATEGORY_TREE = {
    "revenue": ("income", "product-sales", "service-revenue", "consulting-revenue", "subscription-revenue", "interest-income", "other-income", "customer-refunds", "chargebacks-disputes"),
    "cost-of-goods-sold": ("inventory", "manufacturing", "shipping-inbound", "duties-customs"),
    "sales-marketing": ("marketing", "advertising", "website", "events", "promotional-materials"),
    "operations": ("office-supplies", "rent", "utilities", "facilities-expenses", "equipment", "internet-and-telephone", "shipping"),
    "professional-services": ("professional-services-fees", "contractors", "insurance"),
    "human-resources": ("salary", "training", "benefits"),
    "travel-entertainment": ("travel", "meals", "activity"),
    "technology": ("software", "non-software-subscriptions"),
    "banking-finance": ("transfer", "credit-card-payment", "banking-fees", "loan-proceeds", "loan-principal-repayment", "interest-expense", "payouts", "processor-fees", "fees"),
    "assets-capex": ("fixed-assets", "prepaid-expenses"),
    "liabilities-debt": ("leases", "deferred-revenue"),
    "taxes": ("vat-gst-pst-qst-payments", "sales-use-tax-payments", "income-tax-payments", "payroll-tax-remittances", "employer-taxes", "government-fees"),
    "owner-equity": ("owner-draws", "capital-investment", "charitable-donations"),
    "system": ("uncategorized", "other", "internal-transfer"),
}
EXCLUDED_SLUGS = ("internal-transfer",)

# Country, tax type, default rate.
COUNTRY_TAX = (
    ("SE", "vat", 25.0), ("FI", "vat", 25.5), ("NO", "vat", 25.0), ("DK", "vat", 25.0), ("DE", "vat", 19.0), ("FR", "vat", 20.0), ("NL", "vat", 21.0), ("BE", "vat", 21.0),
    ("AT", "vat", 20.0), ("IT", "vat", 22.0), ("ES", "vat", 21.0), ("US", "sales_tax", 0.0), ("GB", "vat", 20.0), ("CA", "gst", 5.0), ("AU", "gst", 10.0), ("NZ", "gst", 15.0),
    ("CH", "vat", 7.7), ("IE", "vat", 23.0), ("PL", "vat", 23.0), ("CZ", "vat", 21.0), ("PT", "vat", 23.0), ("LU", "vat", 17.0), ("EE", "vat", 20.0), ("LV", "vat", 21.0),
    ("LT", "vat", 21.0), ("SK", "vat", 23.0), ("SI", "vat", 22.0), ("RO", "vat", 19.0), ("HU", "vat", 27.0), ("TR", "vat", 18.0),
)
# Rates of single categories that are neither the default nor zero.
CATEGORY_RATES = {
    "SE": {"meals": 12.0}, "FI": {"meals": 14.0}, "NO": {"meals": 15.0}, "DE": {"meals": 7.0}, "FR": {"meals": 10.0}, "NL": {"meals": 9.0}, "BE": {"meals": 12.0},
    "AT": {"meals": 10.0}, "IT": {"meals": 10.0}, "ES": {"meals": 10.0},
    "US": {
        "office-supplies": 5.0, "equipment": 5.0, "software": 4.0, "meals": 6.0, "non-software-subscriptions": 4.0, "promotional-materials": 5.0, "facilities-expenses": 4.0,
        "internet-and-telephone": 3.0, "fixed-assets": 5.0,
    },
    "GB": {"meals": 5.0, "utilities": 5.0}, "CH": {"meals": 7.7, "utilities": 7.7}, "IE": {"meals": 13.5}, "PL": {"meals": 8.0}, "CZ": {"meals": 12.0}, "PT": {"meals": 13.0},
    "LU": {"meals": 8.0}, "EE": {"meals": 9.0}, "LV": {"meals": 12.0}, "LT": {"meals": 9.0}, "SK": {"meals": 10.0}, "SI": {"meals": 9.5}, "RO": {"meals": 9.0},
    "HU": {"meals": 18.0}, "TR": {"meals": 8.0},
}
# Countries that do not list these two categories as exempt.
NOT_EXEMPT = {"US": ("revenue", "salary"), "CA": ("revenue", "salary"), "AU": ("revenue", "salary"), "NZ": ("revenue", "salary")}
# Categories without tax.
EXEMPT = (
    "revenue", "income", "product-sales", "service-revenue", "consulting-revenue", "subscription-revenue", "interest-income", "other-income",
    "customer-refunds", "chargebacks-disputes", "insurance", "benefits", "salary", "employer-taxes", "taxes", "vat-gst-pst-qst-payments",
    "sales-use-tax-payments", "income-tax-payments", "payroll-tax-remittances", "government-fees", "credit-card-payment", "loan-proceeds",
    "loan-principal-repayment", "interest-expense", "payment-platform-payouts", "banking-finance", "banking-fees", "transfer", "internal-transfer",
    "payouts", "processor-fees", "fees", "assets-capex", "fixed-assets", "prepaid-expenses", "owner-equity", "owner-draws", "capital-investment",
    "charitable-donations", "uncategorized",
)
# First month of the fiscal year where it is not January.
FISCAL_START = {"GB": 4, "IN": 4, "SG": 4, "HK": 4, "NZ": 4, "AU": 7, "PK": 7, "EG": 7, "ZA": 3}


def categories(spark: SparkSession) -> DataFrame:
    """Flat tree: slug, parent_slug (null for parents), excluded."""
    rows = [(p, None, False) for p in CATEGORY_TREE] + [(c, p, c in EXCLUDED_SLUGS) for p, cs in CATEGORY_TREE.items() for c in cs]
    return spark.createDataFrame(rows, "slug string, parent_slug string, excluded boolean")


def tax_rates(spark: SparkSession) -> DataFrame:
    """country_code, slug, rate of every category whose rate is not the country's default: at most countries x categories rows."""
    rows = []
    for country, _, _ in COUNTRY_TAX:
        own = {slug: 0.0 for slug in EXEMPT if slug not in NOT_EXEMPT.get(country, ())} | CATEGORY_RATES.get(country, {})
        rows += [(country, slug, rate) for slug, rate in own.items()]
    return spark.createDataFrame(rows, "country_code string, rate_slug string, slug_rate double")


def with_tax_rate(rows: DataFrame, country: str, slug: str) -> DataFrame:
    """Add tax_rate and tax_type by country and category; unknown countries have rate 0 and no type."""
    spark = rows.sparkSession
    defaults = spark.createDataFrame(list(COUNTRY_TAX), "default_country string, country_tax_type string, default_rate double")
    joined = rows.join(F.broadcast(defaults), F.col(country) == F.col("default_country"), "left")  # thirty rows
    joined = joined.join(F.broadcast(tax_rates(spark)), (F.col(country) == F.col("country_code")) & (F.col(slug) == F.col("rate_slug")), "left")  # fixed table
    out = joined.withColumn("tax_rate", F.coalesce("slug_rate", "default_rate", F.lit(0.0))).withColumn("tax_type", F.col("country_tax_type"))
    return out.select(*rows.columns, "tax_rate", "tax_type")


def fiscal_start_month(country: Column) -> Column:
    code = F.upper(country)
    out = None
    for c, m in FISCAL_START.items():
        out = F.when(code == c, m) if out is None else out.when(code == c, m)
    return out.otherwise(1)


def fiscal_year_start(day: Column, country: Column) -> Column:
    """First day of the fiscal year that holds ``day``."""
    m = fiscal_start_month(country)
    year = F.year(day) - F.when(F.month(day) < m, 1).otherwise(0)
    return F.make_date(year, m, F.lit(1))

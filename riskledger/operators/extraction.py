"""Checks, quality score, confidence and merge of extracted invoice fields.

Columns: total_amount, tax_amount, tax_rate, currency, vendor_name, invoice_number, invoice_date and
due_date (texts), items (array of struct with total_price). Amounts are decimals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bound of an amount, and the points lost.
AMOUNT_MOST = 1_000_000_000_000
LOST = {"total_missing": 30, "total_invalid": 15, "currency_missing": 25, "currency_invalid": 10, "vendor_missing": 20, "dates_missing": 15, "date_invalid": 5, "tax_invalid": 5, "inconsistent": 10, "number_missing": 5}
POOR = 70


def _amount_ok(c: Column) -> Column:
    return c.isNotNull() & (c >= 0) & (c <= AMOUNT_MOST)


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _date(c: Column) -> Column:
    """The day a text of the form YYYY-MM-DD names, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def items_sum(items: Column) -> Column:
    """Sum of the valid prices of the lines."""
    prices = F.filter(F.transform(items, lambda x: x["total_price"]), _amount_ok)
    return F.coalesce(F.aggregate(prices, F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + x).cast("decimal(28,4)")), F.lit(0).cast("decimal(28,4)"))


def consistency(docs: DataFrame) -> DataFrame:
    """Add ``issues`` (field, severity) and ``fixes`` (field, value) from cross-field checks.

    A total off by more than 0.01 is an error, with a fix below 5 %; a missing tax that the rate explains
    within 0.01 or 1 % of the total gets a fix; a rate off by more than 0.1 is a warning, with a fix.
    """
    total, tax, rate, sub = F.col("total_amount"), F.col("tax_amount"), F.col("tax_rate"), F.col("_sub")
    docs = docs.withColumn("_sub", items_sum(F.col("items")))
    known = total.isNotNull() & _amount_ok(total)
    diff = F.abs(sub + tax - total)
    off = known & tax.isNotNull() & (sub > 0) & (diff > 0.01)
    from_rate = F.round(sub * rate / 100, 2)
    explained = F.abs(sub + sub * rate / 100 - total)
    fix_tax = known & tax.isNull() & (sub > 0) & (rate > 0) & (rate <= 100) & ((explained < 0.01) | (explained < total * 0.01))
    real = (tax / F.when(sub > 0, sub) * 100).cast("double")
    rate_off = tax.isNotNull() & (sub > 0) & rate.isNotNull() & (F.abs(real - rate.cast("double")) > 0.1)
    late = _date(F.col("due_date")) < _date(F.col("invoice_date"))

    def issue(cond, field, severity):
        return F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity")))

    def fix(cond, field, value):
        return F.when(cond, F.struct(F.lit(field).alias("field"), value.cast("decimal(18,2)").alias("value")))

    issues = F.array(issue(off, "total_amount", "error"), issue(late, "due_date", "error"), issue(rate_off, "tax_rate", "warning"))
    fixes = F.array(fix(off & (diff < total * 0.05), "total_amount", F.round(sub + tax, 2)), fix(fix_tax, "tax_amount", from_rate), fix(rate_off & real.between(0, 100), "tax_rate", F.round(real, 2)))
    out = docs.withColumns({"issues": F.array_compact(issues), "fixes": F.array_compact(fixes)})
    return out.withColumn("is_valid", ~F.exists("issues", lambda x: x["severity"] == "error")).drop("_sub")


def quality(docs: DataFrame, today: str) -> DataFrame:
    """Score 0..100 from missing and invalid fields, missing critical fields, poor flag and confidence."""
    total, tax, rate = F.col("total_amount"), F.col("tax_amount"), F.col("tax_rate")
    no_total = total.isNull() | (total == 0)
    no_currency, no_vendor = _blank(F.col("currency")), _blank(F.col("vendor_name"))
    no_dates = _blank(F.col("invoice_date")) & _blank(F.col("due_date"))
    now = F.lit(today).cast("date")

    def bad_date(name: str) -> Column:
        day = _date(F.col(name))
        return ~_blank(F.col(name)) & ~F.coalesce(day.between(F.add_months(now, -120), F.add_months(now, 24)), F.lit(False))

    sub = items_sum(F.col("items"))
    tax_ok = _amount_ok(tax)
    consistent = F.when(tax_ok & (sub > 0), F.abs(total - (sub + tax)) <= 0.01).when(tax_ok, tax <= total).otherwise(F.lit(True))
    lost = (
        (no_total, "total_missing"),
        (~no_total & ~_amount_ok(total), "total_invalid"),
        (no_currency, "currency_missing"),
        (~no_currency & ~F.col("currency").rlike("^[A-Z]{3}$"), "currency_invalid"),
        (no_vendor, "vendor_missing"),
        (no_dates, "dates_missing"),
        (bad_date("invoice_date"), "date_invalid"),
        (bad_date("due_date"), "date_invalid"),
        (tax.isNotNull() & ~tax_ok, "tax_invalid"),
        (rate.isNotNull() & ~rate.between(0, 100), "tax_invalid"),
        (~no_total & _amount_ok(total) & ~consistent, "inconsistent"),
        (_blank(F.col("invoice_number")), "number_missing"),
    )
    points = reduce(lambda a, b: a + b, [F.when(cond, LOST[name]).otherwise(0) for cond, name in lost])
    missing = reduce(lambda a, b: a + b, [c.cast("int") for c in (no_total, no_currency, no_vendor, no_dates)])
    out = docs.withColumns({"quality": F.greatest(F.lit(0), F.lit(100) - points).cast("long"), "missing": missing})
    out = out.withColumn("is_poor", (F.col("quality") < POOR) | (F.col("missing") > 0))
    base = F.col("quality") / F.lit(100.0)
    base = F.when(F.col("missing") == 0, F.least(F.lit(1.0), base + 0.1)).otherwise(base) - F.col("missing") * 0.05
    base = F.when(F.length("vendor_name") > 5, F.least(F.lit(1.0), base + 0.05)).otherwise(base)
    base = F.when(~_blank(F.col("invoice_number")), F.least(F.lit(1.0), base + 0.05)).otherwise(base)
    return out.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 4))


def _longer(p: Column, q: Column) -> Column:
    return F.when(F.length(p) >= F.length(q), p).otherwise(q)


def _host(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"^www\.", ""))


#: What to take of two values of a field when both extractions are about equally sure.
RULES = {
    "vendor_name": _longer,
    "store_name": _longer,
    "invoice_number": _longer,
    "currency": lambda p, q: F.when(p != "USD", p).when(q != "USD", q).otherwise(p),
    "invoice_date": lambda p, q: F.when(_date(p) >= _date(q), p).otherwise(q),
    "date": lambda p, q: F.when(_date(p) >= _date(q), p).otherwise(q),
    "email": lambda p, q: F.when(F.contains(q, F.lit("@")) & ~F.contains(p, F.lit("@")), q).otherwise(p),
    "website": lambda p, q: F.when(_host(p) <= _host(q), p).otherwise(q),
}


def merge(a: DataFrame, b: DataFrame, key: str, fields: list[str], gap: float = 0.1) -> DataFrame:
    """Merge two extractions field by field (``confidence`` on both sides).

    A missing value is taken from the other side; confidences less than ``gap`` apart leave the choice to
    the field's rule, else the first side; otherwise the surer side wins.
    """
    x = a.select(key, *[F.col(c).alias(f"a_{c}") for c in fields], F.col("confidence").alias("_ca"))
    y = b.select(key, *[F.col(c).alias(f"b_{c}") for c in fields], F.col("confidence").alias("_cb"))
    j = x.join(y, key, "full")
    close = F.abs(F.col("_ca") - F.col("_cb")) < gap

    def pick(c: str) -> Column:
        p, q = F.col(f"a_{c}"), F.col(f"b_{c}")
        rule = RULES.get(c, lambda p, q: p)
        return F.when(p.isNull(), q).when(q.isNull(), p).when(close, rule(p, q)).when(F.col("_ca") >= F.col("_cb"), p).otherwise(q).alias(c)

    return j.select(key, *[pick(c) for c in fields], F.greatest("_ca", "_cb").alias("confidence"))

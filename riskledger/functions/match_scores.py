"""Amount, currency, date and overall scores of a document / payment pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common VAT rates an amount may differ by.
VAT_RATES = (0.05, 0.06, 0.07, 0.075, 0.08, 0.1, 0.12, 0.19, 0.2, 0.21, 0.22, 0.25)


def _ladder(x: Column, steps, last: float) -> Column:
    out = None
    for at, score in steps:
        out = F.when(x <= at, score) if out is None else out.when(x <= at, score)
    return out.otherwise(last)


def _d(c: Column) -> Column:
    return F.abs(c.cast("double"))


def amount_score(a1, c1, b1, bc1, a2, c2, b2, bc2) -> Column:
    """Closeness of two amounts; base amounts are used across currencies."""
    x, y = _d(a1), _d(a2)
    hi, lo = F.greatest(x, y), F.least(x, y)
    diff = F.abs(x - y) / hi
    ratio = hi / F.greatest(lo, F.lit(1e-9))
    vat = F.lit(False)
    for r in VAT_RATES:
        vat = vat | (F.abs(ratio - 1 - r) <= 0.015)
    steps = ((0.0, 1.0), (0.01, 0.98), (0.02, 0.95), (0.05, 0.85), (0.1, 0.6), (0.2, 0.3))
    same = F.when(diff > 0.2, F.when(vat, 0.88).otherwise(0.0)).otherwise(_ladder(diff, steps, 0.0))
    p, q = _d(b1), _d(b2)
    bdiff = F.abs(p - q) / F.greatest(p, q)
    big = (p + q) / 2 >= 5000
    base = (
        F.when(bdiff == 0, 1.0)
        .when(big, _ladder(bdiff, ((0.015, 0.95), (0.03, 0.75), (0.05, 0.5), (0.1, 0.3)), 0.0))
        .otherwise(_ladder(bdiff, ((0.02, 0.9), (0.05, 0.8), (0.1, 0.65), (0.15, 0.45), (0.25, 0.25)), 0.0))
    )
    has_base = (F.coalesce(p, F.lit(0.0)) > 0) & (F.coalesce(q, F.lit(0.0)) > 0) & (bc1 == bc2)
    other = F.when(ratio > 5, 0.1).otherwise(_ladder(diff, ((0.05, 0.7), (0.2, 0.4)), 0.1))
    missing = (F.coalesce(x, F.lit(0.0)) == 0) | (F.coalesce(y, F.lit(0.0)) == 0)
    return F.when(missing, 0.5).when(c1 == c2, same).when(F.coalesce(has_base, F.lit(False)), base).otherwise(other)


def currency_score(c1, c2, bc1, bc2) -> Column:
    return F.when(c1.isNull() | c2.isNull(), 0.5).when(c1 == c2, 1.0).when(F.coalesce(bc1 == bc2, F.lit(False)), 0.7).otherwise(0.3)


def cross_currency_match(c1, b1, bc1, c2, b2, bc2) -> Column:
    """Different currencies whose base amounts agree within a size-dependent tolerance."""
    p, q = _d(b1), _d(b2)
    avg = (p + q) / 2
    tol = (
        F.when(avg < 100, F.greatest(F.lit(10.0), avg * 0.04))
        .when(avg < 1000, F.greatest(F.lit(15.0), avg * 0.02))
        .otherwise(F.greatest(F.lit(25.0), avg * 0.015))
    )
    ok = (c1 != c2) & (bc1 == bc2) & (p > 0) & (q > 0) & (F.abs(p - q) < tol)
    return F.coalesce(ok, F.lit(False))


def date_score(inbox_date, txn_date, kind) -> Column:
    """Payment terms for invoices, receipt timing for expenses, else plain closeness."""
    s = F.datediff(txn_date, inbox_date)
    d = F.abs(s)
    inv = F.coalesce(kind, F.lit("expense")) == "invoice"
    near = (
        F.when(d == 0, 1.0)
        .when(d <= 1, 0.95)
        .when(d <= 3, 0.85)
        .when(d <= 7, 0.75)
        .when(d <= 14, 0.6)
        .when(d <= 30, F.greatest(F.lit(0.3), 1 - d / 30 * 0.7))
        .otherwise(0.1)
    )
    early = d + 3
    return (
        F.when(inv & s.between(24, 38), 0.98)
        .when(inv & s.between(55, 68), 0.96)
        .when(inv & s.between(85, 98), 0.94)
        .when(inv & s.between(10, 20), 0.95)
        .when(inv & s.between(3, 11), 0.93)
        .when(inv & s.between(1, 6), 0.99)
        .when(inv & s.between(1, 123), F.greatest(F.lit(0.7), 0.9 - (s - 33) * 0.002))
        .when(inv & s.between(-10, 0), 0.85)
        .when(inv, near)
        .when((s < 0) & (early <= 4), 0.99)
        .when((s < 0) & (early <= 10), 0.95)
        .when((s < 0) & (early <= 33), 0.9)
        .when((s < 0) & (early <= 63), 0.8)
        .when((s < 0) & (early <= 93), 0.7)
        .when(s.between(0, 10), 0.85)
        .otherwise(near)
    )


def confidence(name, amount, date, currency, same_currency, exact_amount, penalty=None) -> Column:
    """Weighted blend with floors for exact amounts and damping for weak names or dates."""
    known = ~same_currency & (name >= 0.8)
    wa, wd = F.when(known, 20.0).otherwise(30.0), F.when(known, 25.0).otherwise(15.0)
    base = (name * 10 + amount * wa + date * wd + currency * 5) / (wa + wd + 15)
    floor = (
        F.when(exact_amount & (name >= 0.5) & (date >= 0.7), 0.92)
        .when(exact_amount & (name >= 0.3) & (date >= 0.5), 0.85)
        .when(exact_amount & same_currency & (date >= 0.6), 0.78)
        .otherwise(0.0)
    )
    c = F.greatest(base, floor)
    c = c + F.when(~same_currency & (name >= 0.5) & (amount >= 0.6) & (date >= 0.3), 0.05).otherwise(0.0)
    c = c * F.when(name == 0, 0.55).otherwise(1.0) * F.when(date < 0.2, 0.65).otherwise(1.0)
    if penalty is not None:
        c = c - F.coalesce(penalty, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def match_type(conf, name, can_auto, auto_threshold, auto_enabled: bool = False) -> Column:
    auto = F.lit(auto_enabled) & (conf >= auto_threshold) & can_auto & (name >= 0.4)
    return F.when(auto, "auto_matched").when(conf >= 0.72, "high_confidence").otherwise("suggested")

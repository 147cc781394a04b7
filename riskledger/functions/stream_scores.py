"""Point scores and decision of the streaming pipeline, 0 (safe) to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HIGH_RISK_COUNTRIES = ("RO", "NG", "CN", "RU", "UA")
EARTH_KM = 6371.0
WEIGHTS = (("velocity_score", 0.25), ("geo_score", 0.30), ("amount_score", 0.25), ("category_score", 0.10), ("country_score", 0.10))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def velocity_score(n: Column) -> Column:
    return F.when(n.isNull() | (n <= 1), 0).when(n == 2, 20).when(n == 3, 40).when(n == 4, 60).otherwise(85)


def geo_score(km: Column, seconds: Column) -> Column:
    speed = km / seconds * 3600
    still = km.isNull() | seconds.isNull() | (seconds == 0) | (km == 0)
    return F.when(still, 0).when(speed > 900, 100).when(speed > 500, 85).when(speed > 200, 50).otherwise(0)


def amount_score(amount: Column, average: Column) -> Column:
    r = amount / average
    unknown = amount.isNull() | average.isNull() | (average == 0)
    return F.when(unknown, 0).when(r > 20, 100).when(r > 10, 80).when(r > 5, 60).when(r > 3, 40).when(r > 2, 20).otherwise(0)


def category_score(tier: Column) -> Column:
    return F.when(tier == "VERY_HIGH", 80).when(tier == "HIGH", 50).when(tier == "MEDIUM", 20).when(tier == "LOW", 0).otherwise(10)


def country_score(ip: Column, home: Column, merchant: Column) -> Column:
    away = ~ip.eqNullSafe(home)
    return F.when(away & ip.isin(*HIGH_RISK_COUNTRIES), 70).when(away, 30).when(merchant.isin(*HIGH_RISK_COUNTRIES), 40).otherwise(0)


def fraud_score() -> Column:
    total = None
    for name, w in WEIGHTS:
        term = F.col(name) * F.lit(str(w)).cast("decimal(4,2)")
        total = term if total is None else total + term
    return F.floor(total).cast("int")


def decision(score: Column) -> Column:
    return F.when(score.isNull() | (score <= 30), "APPROVED").when(score <= 60, "FLAGGED").otherwise("BLOCKED")

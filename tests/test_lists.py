"""Upserts, institutions and instants of recurrences on worked cases."""

import datetime as dt
from zoneinfo import ZoneInfo

from riskledger.operators import forecast, lists
from riskledger.sources import tables


def test_decided_suggestions_stay(spark):
    schema = "inbox_id string, transaction_id string, confidence double, status string, updated_at int"
    old = spark.createDataFrame([("a", "1", 0.5, "confirmed", 1), ("b", "1", 0.5, "pending", 1), ("c", "1", 0.5, "declined", 1), ("d", "1", 0.5, None, 1)], schema)
    new = spark.createDataFrame([(i, "1", 0.7, None, 2) for i in "abcd"] + [("b", "1", 0.9, "unmatched", 3), ("e", "1", 0.1, None, 2)], schema)
    got = {r.inbox_id: (r.confidence, r.status) for r in tables.upsert_suggestions(old, new).collect()}
    assert got == {"a": (0.5, "confirmed"), "b": (0.9, "unmatched"), "c": (0.5, "declined"), "d": (0.7, "pending"), "e": (0.1, "pending")}


def test_rates_take_the_newest_of_a_feed(spark):
    schema = "base string, target string, rate double, updated_at int"
    old = spark.createDataFrame([("USD", "EUR", 0.9, 1), ("USD", "SEK", 10.0, 1)], schema)
    new = spark.createDataFrame([("USD", "EUR", 0.8, 3), ("USD", "EUR", 0.7, 2), ("GBP", "EUR", 1.1, 2)], schema)
    got = sorted(tuple(r) for r in tables.upsert_rates(old, new).collect())
    assert got == [("GBP", "EUR", 1.1, 2), ("USD", "EUR", 0.8, 3), ("USD", "SEK", 10.0, 1)]


def test_institutions(spark):
    rows = [("1", "First Bank", 5, "p", "active", ["SE"]), ("2", "Bank of the North", 9, "p", "active", ["SE", "NO"]), ("3", "Second Bank", 7, "q", "active", ["SE"]), ("4", "Bank", 99, "p", "removed", ["SE"]), ("5", "Bank", 99, "p", "active", ["NO"])]
    df = spark.createDataFrame(rows, "id string, name string, popularity int, provider string, status string, countries array<string>")

    def ids(*a, **k):
        return [r.id for r in lists.institutions(df, "SE", *a, **k).collect()]

    assert ids() == ids("*") == ["2", "3", "1"]
    assert ids("first bank") == ["1", "2", "3"]  # the others share "bank", five trigrams of eleven, and go by popularity
    assert ids(without_providers=("q",), without_ids=("1",)) == ["2"]
    assert ids("zzz") == [] and ids(limit=1) == ["2"]


def test_instants_keep_the_local_time_of_day(spark):
    zone = ZoneInfo("America/New_York")
    first = dt.datetime(2024, 2, 29, 22, 30, tzinfo=zone)  # already March in UTC
    schema = "frequency string, frequency_day int, frequency_week int, frequency_interval int, start_at timestamp, timezone string, end_type string, end_date date, end_count int, generated int"
    rows = [(f, d, w, None, first, "America/New_York", "never", None, None, 0) for f, d, w in (("monthly_date", 31, None), ("monthly_last_day", None, None), ("monthly_weekday", 0, 2), ("biweekly", None, None))]
    got = {}
    for r in forecast.upcoming_at(spark.createDataFrame(rows, schema), 3).selectExpr("frequency", "k", "date_format(at, 'yyyy-MM-dd HH:mm') AS at").collect():
        got.setdefault(r.frequency, {})[r.k] = r.at

    def utc(*local):
        return [dt.datetime(*x, tzinfo=zone).astimezone(dt.UTC).strftime("%Y-%m-%d %H:%M") for x in ((2024, 2, 29, 22, 30), *local)]

    want = {
        "monthly_date": utc((2024, 3, 31, 22, 30), (2024, 4, 30, 22, 30)),
        "monthly_last_day": utc((2024, 3, 31), (2024, 4, 30)),
        "monthly_weekday": utc((2024, 3, 10), (2024, 4, 14)),
        "biweekly": utc((2024, 3, 14, 22, 30), (2024, 3, 28, 22, 30)),
    }
    assert {f: [v[k] for k in sorted(v)] for f, v in got.items()} == want


def test_similar_vendors_by_four_pairs_of_fields(spark):
    rows = [
        ("1", 1, "Acme Store 12", "Acme"), ("2", 1, "CARD PAYMENT 99", "ACME"), ("3", 1, "Acme Store 12", None), ("4", 1, "Globex", "Acme Store 12"),
        ("5", 1, "Initech", "Initech"), ("6", 2, "Acme Store 12", "Acme"), ("7", 1, None, None),
    ]
    t = spark.createDataFrame([(*r, 5) for r in rows], "id string, team_id int, name string, merchant_name string, date int")
    got = {r.id: r.score for r in lists.similar_vendors(t, t.where("id = '1'")).collect()}
    assert set(got) == {"2", "3", "4"} and got["2"] == 0.95 and got["3"] == got["4"] >= 0.95
    (best,) = lists.similar_vendors(t, t.where("id = '1'"), limit=1).collect()
    assert best.rank == 1 and lists.similar_vendors(t, t.where("id IN ('5', '7')")).isEmpty()

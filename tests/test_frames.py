"""Moving and running aggregates against naive loops, with ties and one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from riskledger.operators import frames

W = 3_600_000_000


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for i in range(260):
        key = "hot" if rnd.random() < 0.6 else rnd.choice("abc")
        us = rnd.randrange(0, 40) * 1_800_000_000  # half hours, so ties are common
        out.append((key, us, f"{i:04d}", f"c{rnd.randrange(12)}", rnd.randrange(1, 9)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, us long, id string, card string, x long")


def test_frame_sums(df, rows):
    got = frames.frame_sums(df, ["k"], "us", {"n": (F.lit(1).cast("long"), W, W), "past": (F.col("x"), W, 0)}, span=W)
    got = {(r.k, r.us): (r.n, r.past) for r in got.collect()}
    for k, us, *_ in rows:
        same = [r for r in rows if r[0] == k]
        n = sum(1 for r in same if abs(r[1] - us) <= W)
        past = sum(r[4] for r in same if us - W <= r[1] <= us)
        assert got[k, us] == (n, past)


def test_frame_distinct(df, rows):
    got = frames.frame_distinct(df, ["k"], "us", "card", {"d": W, "wide": 5 * W}, {"n": W}, span=5 * W)
    got = {(r.k, r.us): (r.d, r.wide, r.n) for r in got.collect()}
    for k, us, *_ in rows:
        near = [r for r in rows if r[0] == k and abs(r[1] - us) <= W]
        wide = {r[3] for r in rows if r[0] == k and abs(r[1] - us) <= 5 * W}
        assert got[k, us] == (len({r[3] for r in near}), len(wide), len(near))


def test_arrival_frames(df, rows):
    got = frames.arrival_frames(df, ["k"], "us", "id", "card", {"d": W, "day": 24 * W}, {"n": W}, span=24 * W)
    got = {r.id: (r.d, r.day, r.n) for r in got.collect()}
    for k, us, ident, *_ in rows:
        seen = [r for r in rows if r[0] == k and (r[1], r[2]) <= (us, ident)]
        hour = [r for r in seen if r[1] >= us - W]
        assert got[ident] == (len({r[3] for r in hour}), len({r[3] for r in seen if r[1] >= us - 24 * W}), len(hour))


def test_running(df, rows):
    tot = {r.id: r.s for r in frames.running_totals(df, ["k"], "us", "id", {"s": F.col("x")}, span=2 * W).collect()}
    dis = {r.id: r.d for r in frames.running_distinct(df, ["k"], "us", "id", "card", "d").collect()}
    for k, us, ident, *_ in rows:
        seen = [r for r in rows if r[0] == k and (r[1], r[2]) <= (us, ident)]
        assert tot[ident] == sum(r[4] for r in seen)
        assert dis[ident] == len({r[3] for r in seen})

"""The collective state by itself: batches, late rows, what is kept."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from riskledger.operators.frames import DAY, HOUR
from riskledger.streaming import pipeline as p
from riskledger.streaming.pipeline import CollectiveProcessor


class Held:
    """List or value state in memory."""

    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        return self.rows

    def put(self, rows):
        self.rows = list(rows)

    def update(self, value):
        self.rows = value

    def clear(self):
        self.rows = None


class HeldMap(dict):
    """Map state in memory."""

    def __init__(self):
        self.asked = 0

    def containsKey(self, key):
        self.asked += 1
        return key in self

    updateValue = dict.__setitem__


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, HeldMap())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)

    def getListState(self, name, *_):
        return self.states.setdefault(name, Held())

    getValueState = getListState


def run(batches):
    handle, out = Handle(), []
    processor = CollectiveProcessor()
    processor.init(handle)
    for batch in batches:
        out += list(processor.handleInputRows(("merchant", "m"), iter(Row(transaction_id=t, card_id=c, us=us) for t, c, us in batch), None))
    return out, handle


def brute(batches):
    seen, out = [], []
    for batch in batches:
        for t, c, us in sorted(batch, key=lambda x: (x[2], x[0])):
            seen.append((t, c, us))
            day = [x for x in seen if us - DAY <= x[2] <= us]
            hour = [x for x in day if x[2] >= us - HOUR]
            out.append((t, len({x[1] for x in hour}), len({x[1] for x in day}), len({x[1] for x in seen}), len(hour), len(seen)))
    return out


def test_batches_and_late_rows():
    rng = random.Random(3)
    batches, now = [], 10 * DAY
    for b in range(8):
        now += rng.choice([HOUR // 3, HOUR, DAY // 2, 2 * DAY])
        # a third of the rows come late, but within the day that is kept
        batches.append([(f"{b:02d}-{i:03d}", f"c{rng.randint(0, 6)}", now + rng.randint(0, HOUR // 2) - rng.choice([0, 0, HOUR // 4])) for i in range(12)])
    got, _ = run(batches)
    assert [(r.transaction_id, r.unique_60m, r.unique_24h, r.unique_total, r.count_60m, r.count_total) for r in got] == brute(batches)


def test_only_the_last_day_is_kept():
    batches = [[(f"{d}-{i}", f"c{d}-{i}", d * DAY + i) for i in range(50)] for d in range(1, 20, 2)]
    _, handle = run(batches)
    idle = (19 * DAY + 49 + DAY) // 1000 + 1
    assert len(handle.states["recent"].rows) == 50 and len(handle.states["ever"]) == 500 and handle.states["total"].rows == (500, 500, idle)
    assert handle.timers == {idle}
    assert handle.states["ever"].asked == 500  # a batch looks up its own cards alone


def test_an_idle_key_keeps_no_rows():
    handle, processor = Handle(), CollectiveProcessor()
    processor.init(handle)
    rows = [Row(transaction_id=f"t{i}", card_id=f"c{i % 3}", us=DAY + i) for i in range(9)]
    list(processor.handleInputRows(("ip", "x"), iter(rows), None))
    assert list(processor.handleExpiredTimer(("ip", "x"), None, None)) == [] and not handle.states["recent"].exists()
    (again,) = processor.handleInputRows(("ip", "x"), iter([Row(transaction_id="u", card_id="c0", us=5 * DAY)]), None)
    assert (again.unique_60m, again.unique_24h, again.unique_total, again.count_60m, again.count_total) == (1, 1, 3, 1, 10)


def _events(spark, path, rows):
    """One more file of parsed events: transaction, card, seconds."""
    made = spark.createDataFrame([(t, c, float(s)) for t, c, s in rows], "transaction_id string, card_id string, s double")
    cols = [F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in p.EVENT_ROW if f.name != "event_time"]
    place = {"latitude": F.lit(1.0), "longitude": F.lit(2.0)}
    made.select(*cols, F.timestamp_seconds("s").alias("event_time")).withColumns(place).coalesce(1).write.mode("append").parquet(path)


def test_idle_cards_leave_the_store(spark, tmp_path):
    def velocity(ttl_ms):
        path = str(tmp_path / f"ttl{ttl_ms}")
        _events(spark, path, [("a1", "a", 0), ("b1", "b", 0)])
        _events(spark, path, [("a2", "a", 10)])
        stream = spark.readStream.schema(p.EVENT_ROW).option("maxFilesPerTrigger", 1).parquet(path)
        return {r.transaction_id: r.velocity for r in p.run_until_read(p.track(stream, 60, ttl_ms), 3, 120).collect()}

    assert velocity(3_600_000) == {"a1": 1, "b1": 1, "a2": 2}
    assert velocity(1) == {"a1": 1, "b1": 1, "a2": 1}  # gone before the second file is read


def test_collective_over_files_and_past_a_day(spark, tmp_path):
    """Three files, the last one days later: timers fire between them, the counts are those of one pass."""
    batches = [[(f"{b}-{i}", f"c{i % 4}", (10 + d) * DAY + i * 1_000_000) for i in range(12)] for b, d in enumerate((0, 0.1, 5))]
    batches = [[(t, c, int(us)) for t, c, us in x] for x in batches]
    path = str(tmp_path / "in")
    schema = "transaction_id string, card_id string, us long, merchant_name string, merchant_category string, merchant_country string, device_id string, ip_address string"
    for x in batches:
        spark.createDataFrame([(t, c, us, "m", "k", "US", "", "") for t, c, us in x], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = p.run_to_files(p.collective(stream)).where("kind = 'merchant'").collect()
    cols = ("transaction_id", "unique_60m", "unique_24h", "unique_total", "count_60m", "count_total")
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(brute(batches))

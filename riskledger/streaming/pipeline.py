"""Parse, track, enrich, score, decide and route a stream of transactions."""

from __future__ import annotations

import json
import time
from bisect import insort
from collections import Counter, deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import stream_scores as sc
from ..operators.frames import DAY, HOUR, SECOND, running_totals
from ..session import scratch

EVENT = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("amount_usd", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("ip_country", T.StringType()),
        T.StructField("device_fingerprint", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("event_time", T.StringType()),
    ]
)
DECISIONS = ("APPROVED", "FLAGGED", "BLOCKED")


def kafka_source(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for k, val in options.items():
        reader = reader.option(k, val)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def parse(raw: DataFrame) -> DataFrame:
    """JSON lines (column ``value``) to typed events."""
    out = raw.select(F.from_json("value", EVENT).alias("d")).select("d.*")
    return out.withColumn("event_time", F.to_timestamp("event_time"))


def enrich(events: DataFrame, merchants: DataFrame, cards: DataFrame) -> DataFrame:
    """Static merchant and card profiles, with defaults for unknown ones.

    Plain left joins: Spark broadcasts a profile table while it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it beyond that.
    """
    m = merchants.select("merchant_id", "merchant_name", F.col("risk_tier").alias("merchant_risk_tier"), "merchant_country")
    c = cards.select("card_id", "home_country", "avg_txn_amount", "max_txn_30d", F.col("risk_segment").alias("card_risk_segment"))
    out = events.join(m, "merchant_id", "left").join(c, "card_id", "left")
    defaults = {
        "merchant_name": "UNKNOWN", "merchant_risk_tier": "MEDIUM", "merchant_country": "US",
        "home_country": "US", "avg_txn_amount": 100.0, "max_txn_30d": 500.0, "card_risk_segment": "LOW",
    }
    return out.na.fill(defaults)


def score(tracked: DataFrame) -> DataFrame:
    """Five point scores, their weighted integer score and the decision."""
    c = F.col
    return (
        tracked.withColumn("velocity_score", sc.velocity_score(c("velocity")))
        .withColumn("geo_score", sc.geo_score(c("geo_distance_km"), c("time_diff_seconds")))
        .withColumn("amount_score", sc.amount_score(c("amount_usd"), c("avg_txn_amount")))
        .withColumn("category_score", sc.category_score(c("merchant_risk_tier")))
        .withColumn("country_score", sc.country_score(c("ip_country"), c("home_country"), c("merchant_country")))
        .withColumn("fraud_score", sc.fraud_score())
        .withColumn("decision", sc.decision(c("fraud_score")))
    )


# ---- velocity state: the stateful operator and its batch twin

TRACKED = T.StructType(
    [f if f.name != "event_time" else T.StructField("event_time", T.TimestampType()) for f in EVENT.fields]
    + [
        T.StructField("velocity", T.LongType()),
        T.StructField("last_latitude", T.DoubleType()),
        T.StructField("last_longitude", T.DoubleType()),
        T.StructField("time_diff_seconds", T.LongType()),
    ]
)
#: A parsed event.
EVENT_ROW = T.StructType(TRACKED.fields[: len(EVENT.fields)])
_STATE = T.StructType(
    [
        T.StructField("count", T.LongType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("us", T.LongType()),
    ]
)


class VelocityProcessor(StatefulProcessor):
    """Per card: rows since the last gap longer than ``gap_seconds``, last place and time.

    Each row refreshes the life of the state, so the count grows while gaps stay
    short. With ``ttl_ms`` the state store also drops idle cards by processing time.
    """

    def __init__(self, gap_seconds: int = 60, ttl_ms: int | None = None):
        self.gap_seconds = gap_seconds
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("velocity", _STATE, self.ttl_ms) if self.ttl_ms else handle.getValueState("velocity", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        for r in sorted(rows, key=lambda x: (x["us"], x["transaction_id"])):
            row = r.asDict()
            us = row.pop("us")
            fresh = held is None or us - held[3] > self.gap_seconds * SECOND
            count = 1 if fresh else held[0] + 1
            lat, lon = (r["latitude"], r["longitude"]) if fresh else (held[1], held[2])
            diff = 0 if fresh else int((us - held[3]) / SECOND)
            held = (count, r["latitude"], r["longitude"], us)
            yield Row(**row, velocity=count, last_latitude=lat, last_longitude=lon, time_diff_seconds=diff)
        if held is not None:
            self.state.update(held)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def track(events: DataFrame, gap_seconds: int = 60, ttl_ms: int | None = None) -> DataFrame:
    """Stateful velocity and movement of each card."""
    use_rocksdb(events.sparkSession)
    mode = "ProcessingTime" if ttl_ms else "None"
    out = (
        events.select(*EVENT.fieldNames(), F.unix_micros("event_time").alias("us"))
        .groupBy("card_id")
        .transformWithState(VelocityProcessor(gap_seconds, ttl_ms), TRACKED, "Append", mode)
    )
    return with_distance(out)


def with_distance(df: DataFrame) -> DataFrame:
    km = sc.haversine_km(F.col("last_latitude"), F.col("last_longitude"), F.col("latitude"), F.col("longitude"))
    return df.withColumn("geo_distance_km", F.when(F.col("velocity") > 1, km).otherwise(0.0))


def track_batch(events: DataFrame, gap_seconds: int = 60, span: int = DAY) -> DataFrame:
    """Batch twin of ``track``: gap sessions with count, previous place and time.

    The previous row of a bucket's first row comes from the last line of the card's
    earlier buckets; counts are two-level running sums, so a card is never one task.
    """
    us = F.unix_micros("event_time")
    e = events.withColumn("us", us).withColumn("_tb", F.floor(us / F.lit(span)).cast("long"))
    place = F.struct("us", "transaction_id", "latitude", "longitude")
    ends = e.groupBy("card_id", "_tb").agg(F.max(place).alias("_end"))
    carry = ends.select("card_id", "_tb", F.lag("_end").over(Window.partitionBy("card_id").orderBy("_tb")).alias("_carry"))
    w = Window.partitionBy("card_id", "_tb").orderBy("us", "transaction_id")
    e = e.join(carry, ["card_id", "_tb"]).withColumn("_prev", F.coalesce(F.lag(place).over(w), F.col("_carry")))
    gap = F.col("us") - F.col("_prev.us")
    start = F.coalesce(gap > gap_seconds * SECOND, F.lit(True))
    e = e.withColumn("_start", start)
    one = F.lit(1).cast("long")
    runs = running_totals(e, ["card_id"], "us", "transaction_id", {"_r": one, "_s": F.col("_start").cast("long")}, span)
    first = runs.join(e.select("transaction_id", "card_id", "_start"), "transaction_id").filter("_start").select("card_id", "_s", F.col("_r").alias("_first"))
    out = e.join(runs, "transaction_id").join(first, ["card_id", "_s"])
    out = (
        out.withColumn("velocity", F.col("_r") - F.col("_first") + 1)
        .withColumn("last_latitude", F.when(F.col("_start"), F.col("latitude")).otherwise(F.col("_prev.latitude")))
        .withColumn("last_longitude", F.when(F.col("_start"), F.col("longitude")).otherwise(F.col("_prev.longitude")))
        .withColumn("time_diff_seconds", F.when(F.col("_start"), 0).otherwise(F.floor(gap / SECOND)).cast("long"))
    )
    return with_distance(out.select(*TRACKED.fieldNames()))


# ---- collective features as keyed state

COLLECTIVE = T.StructType(
    [T.StructField("transaction_id", T.StringType()), T.StructField("kind", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("unique_60m", "unique_24h", "unique_total", "count_60m", "count_total")]
)


class CollectiveProcessor(StatefulProcessor):
    """Per (kind, key): cards and rows of the last hour, cards of the last day and ever, rows ever.

    Kept are the rows of the last day, which are read once per batch, a map entry per card ever seen, of which
    a batch looks up its own cards only, and the number of rows and cards. Older rows go as newer ones come; once the
    watermark is a day past the newest, a timer drops what an idle key still holds. The counts are those of rows that arrived so far.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", T.StructType([T.StructField("us", T.LongType()), T.StructField("card_id", T.StringType())]))
        self.ever = handle.getMapState("ever", T.StructType([T.StructField("card_id", T.StringType())]), T.StructType([T.StructField("us", T.LongType())]))
        self.total = handle.getValueState("total", T.StructType([T.StructField(c, T.LongType()) for c in ("rows", "cards", "timer_ms")]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = sorted((r[0], r[1]) for r in self.recent.get()) if self.recent.exists() else []
        newest = held[-1][0] if held else None
        total, cards, timer = self.total.get() if self.total.exists() else (0, 0, None)
        met = set()
        day, hour = None, None
        for r in sorted(rows, key=lambda x: (x["us"], x["transaction_id"])):
            card, us = r["card_id"], r["us"]
            total += 1
            if card not in met:
                met.add(card)
                if not self.ever.containsKey((card,)):
                    self.ever.updateValue((card,), (us,))
                    cards += 1
            if newest is not None and us < newest:  # late: counted among the rows up to its own time
                insort(held, (us, card))
                own = [x for x in held if us - DAY <= x[0] <= us]
                last = [c for u, c in own if u >= us - HOUR]
                counts = len(set(last)), len({c for _, c in own}), len(last)
            else:
                if day is None:
                    day, hour = _Seen(held, us - DAY), _Seen(held, us - HOUR)
                day.add(us, card, DAY)
                hour.add(us, card, HOUR)
                counts = len(hour.cards), len(day.cards), len(hour.rows)
            yield Row(transaction_id=r["transaction_id"], kind=key[0], unique_60m=counts[0], unique_24h=counts[1], unique_total=cards, count_60m=counts[2], count_total=total)
        kept = list(day.rows) if day else held
        self.recent.put(kept)
        idle = (kept[-1][0] + DAY) // 1000 + 1
        if idle != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(idle)
        self.total.update((total, cards, idle))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.recent.clear()
        total, cards, _ = self.total.get()
        self.total.update((total, cards, None))
        return iter(())

    def close(self) -> None:
        pass


class _Seen:
    """Rows of a moving window in order of time, and how often each card is among them."""

    def __init__(self, rows: list, since: int):
        self.rows = deque(x for x in rows if x[0] >= since)
        self.cards = Counter(c for _, c in self.rows)

    def add(self, us: int, card: str, span: int) -> None:
        while self.rows and self.rows[0][0] < us - span:
            gone = self.rows.popleft()[1]
            self.cards[gone] -= 1
            if not self.cards[gone]:
                del self.cards[gone]
        self.rows.append((us, card))
        self.cards[card] += 1


def collective(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Collective counts of every row for its merchant, device, address, address prefix and cluster.

    ``events``: transaction_id, card_id, us, merchant_name, merchant_category, merchant_country, device_id,
    ip_address. One row per row and kind; absent devices and addresses have none. Rows more than ``late``
    behind the newest time of an earlier batch are dropped.
    """
    use_rocksdb(events.sparkSession)
    c = F.col

    def one(kind, key):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    kinds = F.array_compact(
        F.array(
            one("merchant", c("merchant_name")),
            F.when(c("device_id") != "", one("device", c("device_id"))),
            F.when(c("ip_address") != "", one("ip", c("ip_address"))),
            F.when(c("ip_address") != "", one("prefix", F.substring_index("ip_address", ".", 3))),
            one("cluster", F.concat_ws("|", "merchant_name", "merchant_category", "merchant_country")),
        )
    )
    timed = events.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", late)
    rows = timed.select(F.explode(kinds).alias("k"), "transaction_id", "card_id", "us", "event_time").select("k.kind", "k.key", "transaction_id", "card_id", "us", "event_time")
    return rows.groupBy("kind", "key").transformWithState(CollectiveProcessor(), COLLECTIVE, "Append", "EventTime")


def burst_score(unique_60m: Column, count_60m: Column) -> Column:
    """How much a merchant's last hour looks like a burst of cards, 0 to 1."""
    raw = (unique_60m - 2.0) / 6.0 + (count_60m - 3.0) / 18.0
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


# ---- windows, late data, duplicates

def windowed_counts(events: DataFrame, key: str, size: str = "60 minutes", slide: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """Sliding counts and sums per key; rows later than ``late`` are dropped."""
    return (
        events.withWatermark("event_time", late)
        .groupBy(F.window("event_time", size, slide).alias("w"), key)
        .agg(F.count("*").alias("n"), F.sum(F.col("amount_usd").cast("decimal(18,2)")).alias("total"))
        .select(key, F.col("w.start").alias("start"), "n", "total")
    )


def sessions(events: DataFrame, gap: str = "60 seconds", late: str = "1 day") -> DataFrame:
    return (
        events.withWatermark("event_time", late)
        .groupBy(F.session_window("event_time", gap).alias("w"), "card_id")
        .agg(F.count("*").alias("n"))
        .select("card_id", F.col("w.start").alias("start"), "n")
    )


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["transaction_id"])


# ---- sinks

def route(scored: DataFrame, path: str, trigger: dict | None = None) -> list:
    """One query per decision, each with its own files and checkpoint: key and JSON value."""
    out = []
    for d in DECISIONS:
        rows = scored.filter(F.col("decision") == d).select(F.col("transaction_id").alias("key"), F.to_json(F.struct("*")).alias("value"))
        writer = rows.writeStream.format("parquet").option("path", f"{path}/{d.lower()}").option("checkpointLocation", f"{path}/_checkpoint_{d.lower()}")
        out.append(writer.outputMode("append").trigger(**(trigger or {"processingTime": "30 seconds"})).start())
    return out


def monitor(scored: DataFrame, name: str):
    """In-memory table of a bounded summary: count and mean score per decision."""
    agg = scored.groupBy("decision").agg(F.count("*").alias("n"), F.avg("fraud_score").alias("mean_score"))
    return agg.writeStream.format("memory").queryName(name).outputMode("complete")


def progress(query) -> DataFrame:
    """Input rows, rate and trigger time of the query's recent progress reports."""
    rows = [
        (p["batchId"], int(p["numInputRows"]), float(p.get("processedRowsPerSecond") or 0.0), int(p["durationMs"].get("triggerExecution", 0)))
        for p in (r if isinstance(r, dict) else json.loads(r.json) for r in query.recentProgress)
    ]
    schema = "batch_id long, input_rows long, rows_per_second double, trigger_ms long"
    return SparkSession.getActiveSession().createDataFrame(rows, schema)


def run_to_files(stream: DataFrame, mode: str = "append", transform: Callable | None = None) -> DataFrame:
    """Run a stream over what its source holds now and read back what it wrote.

    Every batch replaces its own folder, so a repeated batch is written once;
    in complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def write(df: DataFrame, batch: int) -> None:
        out = transform(df, batch) if transform else df
        folder = "all" if mode == "complete" else f"batch_id={batch}"
        out.write.mode("overwrite").parquet(f"{base}/out/{folder}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "complete":
        return spark.read.parquet(f"{base}/out/all")
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("batch_id")


def score_window(batch: DataFrame, history: DataFrame, pipeline: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score new rows against history: run the plan on both, keep the new rows."""
    both = history.join(batch.select("transaction_id"), "transaction_id", "left_anti").unionByName(batch)
    return pipeline(both).join(batch.select("transaction_id"), "transaction_id", "left_semi")


def merge_review_state(current: DataFrame, events: DataFrame) -> DataFrame:
    """New snapshot of (transaction_id, status, seq): the later event wins."""
    new = events.select("transaction_id", F.col("to_status").alias("status"), "seq")
    return current.select("transaction_id", "status", "seq").unionByName(new).groupBy("transaction_id").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq")
    )


def run_until_read(stream: DataFrame, rows: int, seconds: float = 600) -> DataFrame:
    """Run a stream whose clock goes on, as one with ``ttl_ms`` does, until it has read ``rows``; then read back what it wrote.

    A ``TimeoutError`` tells that it has not read them in ``seconds``.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/ck").outputMode("append").trigger(processingTime="1 second").start()
    end = time.monotonic() + seconds
    read: dict[int, int] = {}
    try:
        while sum(read.values()) < rows:
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > end:
                raise TimeoutError(f"{sum(read.values())} of {rows} rows read in {seconds} s")
            time.sleep(0.2)
            # a batch reports when it has been written
            for r in query.recentProgress:
                report = r if isinstance(r, dict) else json.loads(r.json)
                read[report["batchId"]] = int(report["numInputRows"])
    finally:
        query.stop()
    return spark.read.schema(stream.schema).option("basePath", f"{base}/out").parquet(f"{base}/out").drop("batch_id")

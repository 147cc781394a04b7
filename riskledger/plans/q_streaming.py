"""Streaming jobs over the events table, run to the end of what it holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import review
from ..operators.frames import DAY
from ..session import scratch
from ..streaming import pipeline as p
from ..streaming import stores
from .q_reports import rnd
from .registry import query
from .views_sql import view

GAP = 21_600

view(
    "v_stream",
    "v_ev",
    """SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS card_id, 'm' || (k % 20) AS merchant_id, event_type AS merchant_category, value AS amount_usd,
  CASE k % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'RO' WHEN 2 THEN 'GB' WHEN 3 THEN 'NG' ELSE 'CA' END AS ip_country, (k - 50) * 0.5::DOUBLE AS latitude, k * 1.5::DOUBLE AS longitude, ts AS event_time, us FROM v_ev""",
)


def _shape(e):
    k = F.col("k")
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("card_id"),
        F.concat(F.lit("m"), (k % 20).cast("string")).alias("merchant_id"),
        F.col("event_type").alias("merchant_category"),
        F.col("value").alias("amount_usd"),
        F.lit("USD").alias("currency"),
        F.lit("online").alias("channel"),
        F.element_at(F.array(*[F.lit(c) for c in ("US", "RO", "GB", "NG", "CA")]), (k % 5 + 1).cast("int")).alias("ip_country"),
        F.concat(F.lit("d"), k.cast("string")).alias("device_fingerprint"),
        ((k - 50) * 0.5).alias("latitude"),
        (k * 1.5).alias("longitude"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return _shape(raw.withColumn("k", F.get_json_object("props", "$.k").cast("int")))


def _batch(spark, sf):
    return _shape(v._events(spark, sf))


def _merchants(spark, sf):
    s = v.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("m"), k.cast("string")).alias("merchant_id"),
        F.col("s_name").alias("merchant_name"),
        F.element_at(F.array(*[F.lit(t) for t in ("LOW", "MEDIUM", "HIGH", "VERY_HIGH")]), (k % 4 + 1).cast("int")).alias("risk_tier"),
        F.when(k % 3 == 0, "RU").otherwise("US").alias("merchant_country"),
    )


def _cards(spark, sf):
    c = v.table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("card_id"),
        F.when(k % 2 == 0, "US").otherwise("GB").alias("home_country"),
        (k % 50 + 5.0).alias("avg_txn_amount"),
        F.lit(500.0).alias("max_txn_30d"),
        F.lit("LOW").alias("risk_segment"),
    )


view(
    "v_tracked",
    "v_stream",
    f"""SELECT *, CASE WHEN velocity > 1 THEN 6371.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)) ELSE 0 END AS geo_distance_km FROM (SELECT *, pow(sin(radians(latitude - last_latitude) / 2), 2) + cos(radians(last_latitude)) * cos(radians(latitude)) * pow(sin(radians(longitude - last_longitude) / 2), 2) AS h
   FROM (SELECT *, row_number() OVER (PARTITION BY card_id, sess ORDER BY us, transaction_id) AS velocity, CASE WHEN st THEN latitude ELSE pla END AS last_latitude, CASE WHEN st THEN longitude ELSE plo END AS last_longitude, CASE WHEN st THEN 0 ELSE (us - pus) // 1000000 END AS time_diff_seconds
   FROM (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY card_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING) AS sess FROM (SELECT *, coalesce(us - pus > {GAP}000000, TRUE) AS st FROM (SELECT *, lag(us) OVER w AS pus, lag(latitude) OVER w AS pla, lag(longitude) OVER w AS plo
   FROM v_stream WINDOW w AS (PARTITION BY card_id ORDER BY us, transaction_id))))))""",
)
_TRACK_SQL = "SELECT transaction_id, velocity, time_diff_seconds, round(geo_distance_km, 4) AS geo_distance_km FROM v_tracked"


def _tracked(df):
    return df.select("transaction_id", "velocity", "time_diff_seconds", F.round("geo_distance_km", 4).alias("geo_distance_km"))


@query("stream_gap_sessions_batch", "WIN-16 FN-32", _TRACK_SQL, "v_tracked")
def stream_gap_sessions_batch(spark, sf):
    return _tracked(p.track_batch(_batch(spark, sf), GAP))


@query("stream_velocity_state", "STR-01 FN-32", _TRACK_SQL, "v_tracked")
def stream_velocity_state(spark, sf):
    return _tracked(p.run_to_files(p.track(_stream(spark, sf), GAP)))


@query("stream_velocity_expiring", "STR-01", _TRACK_SQL, "v_tracked")
def stream_velocity_expiring(spark, sf):
    """The state leaves the store when a card has been idle for an hour of the store's clock."""
    rows = spark.read.parquet(f"{sf}/events.parquet").count()
    return _tracked(p.run_until_read(p.track(_stream(spark, sf), GAP, ttl_ms=3_600_000), rows))


view(
    "v_stream_scored",
    "v_tracked",
    """SELECT *, CASE WHEN fraud_score <= 30 THEN 'APPROVED' WHEN fraud_score <= 60 THEN 'FLAGGED' ELSE 'BLOCKED' END AS decision FROM (SELECT *, CAST(floor(velocity_score * 0.25 + geo_score * 0.30 + amount_score * 0.25 + category_score * 0.10 + country_score * 0.10) AS INT) AS fraud_score
  FROM (SELECT t.*, CASE WHEN velocity <= 1 THEN 0 WHEN velocity = 2 THEN 20 WHEN velocity = 3 THEN 40 WHEN velocity = 4 THEN 60 ELSE 85 END AS velocity_score,
   CASE WHEN time_diff_seconds = 0 OR geo_distance_km = 0 THEN 0 WHEN geo_distance_km / time_diff_seconds * 3600 > 900 THEN 100 WHEN geo_distance_km / time_diff_seconds * 3600 > 500 THEN 85 WHEN geo_distance_km / time_diff_seconds * 3600 > 200 THEN 50 ELSE 0 END AS geo_score,
   CASE WHEN amount_usd / av > 20 THEN 100 WHEN amount_usd / av > 10 THEN 80 WHEN amount_usd / av > 5 THEN 60 WHEN amount_usd / av > 3 THEN 40 WHEN amount_usd / av > 2 THEN 20 ELSE 0 END AS amount_score,
   CASE tier WHEN 'VERY_HIGH' THEN 80 WHEN 'HIGH' THEN 50 WHEN 'MEDIUM' THEN 20 ELSE 0 END AS category_score,
   CASE WHEN ip_country <> home AND ip_country IN ('RO','NG','CN','RU','UA') THEN 70 WHEN ip_country <> home THEN 30 WHEN mc IN ('RO','NG','CN','RU','UA') THEN 40 ELSE 0 END AS country_score, merchant_name
   FROM (SELECT t.*, coalesce(m.s_name, 'UNKNOWN') AS merchant_name, coalesce(tier, 'MEDIUM') AS tier, coalesce(mc, 'US') AS mc, coalesce(home, 'US') AS home, coalesce(av, 100) AS av FROM v_tracked t
    LEFT JOIN (SELECT 'm' || s_suppkey AS mid, s_name, CASE s_suppkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'VERY_HIGH' END AS tier, CASE WHEN s_suppkey % 3 = 0 THEN 'RU' ELSE 'US' END AS mc FROM supplier) m ON merchant_id = mid
    LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS cid, CASE WHEN c_custkey % 2 = 0 THEN 'US' ELSE 'GB' END AS home, c_custkey % 50 + 5.0::DOUBLE AS av FROM customer) c ON card_id = cid) t))""",
)
_SCORED = "transaction_id, merchant_name, velocity_score, geo_score, amount_score, category_score, country_score, fraud_score, decision"


def _scored_stream(spark, sf):
    return p.score(p.enrich(p.track(_stream(spark, sf), GAP), _merchants(spark, sf), _cards(spark, sf)))


@query("stream_scored", "STR-02 JON-21 FN-33", f"SELECT {_SCORED} FROM v_stream_scored", "v_stream_scored")
def stream_scored(spark, sf):
    return p.run_to_files(_scored_stream(spark, sf).select(*_SCORED.split(", ")))


@query("stream_scored_batch", "FN-33 JON-21 AGG-54", "SELECT decision, count(*) AS n, round(avg(fraud_score), 4) AS mean_score FROM v_stream_scored GROUP BY 1", "v_stream_scored")
def stream_scored_batch(spark, sf):
    s = p.score(p.enrich(p.track_batch(_batch(spark, sf), GAP), _merchants(spark, sf), _cards(spark, sf)))
    return s.groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg("fraud_score"), 4).alias("mean_score"))


@query("stream_json_parsed", "SRC-21", "SELECT transaction_id, card_id, merchant_id, amount_usd, event_time FROM v_stream", "v_stream")
def stream_json_parsed(spark, sf):
    lines = _stream(spark, sf).withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    raw = lines.select(F.to_json(F.struct(*p.EVENT.fieldNames())).alias("value"))
    return p.run_to_files(p.parse(raw).select("transaction_id", "card_id", "merchant_id", "amount_usd", "event_time"))


@query("stream_routed", "SRC-22 STR-03", "SELECT decision, count(*) AS n FROM v_stream_scored GROUP BY 1", "v_stream_scored")
def stream_routed(spark, sf):
    base = scratch(spark, "routes")
    for q in p.route(_scored_stream(spark, sf), base, {"availableNow": True}):
        q.awaitTermination()
    out = None
    for d in p.DECISIONS:
        one = spark.read.schema("key string, value string").parquet(f"{base}/{d.lower()}").select(F.get_json_object("value", "$.decision").alias("decision"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("decision").agg(F.count("*").alias("n"))


def _txn_stream(spark, sf):
    """The transactions as a stream, with device and address."""
    raw = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")
    k, online = F.col("k"), F.col("event_type").isin("click", "view", "purchase")
    e = raw.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("card_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.concat(F.lit("m"), (k % 20).cast("string")).alias("merchant_name"),
        F.col("event_type").alias("merchant_category"), (k % 5).cast("string").alias("merchant_country"), F.when(online, F.concat(F.lit("d"), k.cast("string"))).otherwise("").alias("device_id"),
        F.when(online, F.concat(F.lit("10."), (k % 8).cast("string"), F.lit("."), k.cast("string"), F.lit(".1"))).otherwise("").alias("ip_address"),
    )


view(
    "v_kind",
    "v_txn",
    """SELECT transaction_id, card_id, us, 'merchant' AS kind, merchant_name AS key FROM v_txn UNION ALL SELECT transaction_id, card_id, us, 'device', device_id FROM v_txn WHERE device_id <> '' UNION ALL SELECT transaction_id, card_id, us, 'ip', ip_address FROM v_txn WHERE ip_address <> ''
  UNION ALL SELECT transaction_id, card_id, us, 'prefix', regexp_extract(ip_address, '^[0-9]+[.][0-9]+[.][0-9]+') FROM v_txn WHERE ip_address <> '' UNION ALL SELECT transaction_id, card_id, us, 'cluster', merchant_name || '|' || merchant_category || '|' || merchant_country FROM v_txn""",
)
view(
    "v_collective_stream",
    "v_kind",
    """SELECT a.transaction_id, a.kind, count(DISTINCT CASE WHEN b.us >= a.us - 3600000000 THEN b.card_id END) AS unique_60m, count(DISTINCT CASE WHEN b.us >= a.us - 86400000000 THEN b.card_id END) AS unique_24h, count(DISTINCT b.card_id) AS unique_total, count(CASE WHEN b.us >= a.us - 3600000000 THEN 1 END) AS count_60m,
  count(*) AS count_total FROM v_kind a JOIN v_kind b ON a.kind = b.kind AND a.key = b.key AND (b.us < a.us OR (b.us = a.us AND b.transaction_id <= a.transaction_id)) GROUP BY 1, 2""",
)


@query("stream_collective", "STR-04", "SELECT * FROM v_collective_stream", "v_collective_stream")
def stream_collective(spark, sf):
    return p.run_to_files(p.collective(_txn_stream(spark, sf)))


@query(
    "stream_collective_merchant",
    "STR-04",
    f"""SELECT transaction_id, unique_60m, unique_24h, unique_total, {rnd('greatest(0, least(1, (unique_60m - 2.0::DOUBLE) / 6 + (count_60m - 3.0::DOUBLE) / 18))', 4)} AS merchant_burst_score, unique_60m >= 5 AND count_60m >= 5 AS hit_by_many_cards FROM v_collective_stream WHERE kind = 'merchant'""",
    "v_collective_stream",
)
def stream_collective_merchant(spark, sf):
    out = p.run_to_files(p.collective(_txn_stream(spark, sf))).filter("kind = 'merchant'")
    return out.select(
        "transaction_id", "unique_60m", "unique_24h", "unique_total", p.burst_score(F.col("unique_60m"), F.col("count_60m")).alias("merchant_burst_score"), ((F.col("unique_60m") >= 5) & (F.col("count_60m") >= 5)).alias("hit_by_many_cards")
    )


@query(
    "stream_sliding_counts",
    "STR-05 STR-07",
    """SELECT merchant_id, start, count(*) AS n, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, event_time) - to_minutes(10 * g) AS start FROM v_stream, range(6) t(g)) GROUP BY 1, 2""",
    "v_stream",
)
def stream_sliding_counts(spark, sf):
    return p.run_to_files(p.windowed_counts(_stream(spark, sf), "merchant_id"), "complete")


@query(
    "stream_session_windows",
    "STR-06",
    """SELECT card_id, min(event_time) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY card_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sess FROM (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY card_id ORDER BY us) > 21600000000, TRUE) AS st FROM v_stream)) GROUP BY card_id, sess""",
    "v_stream",
)
def stream_session_windows(spark, sf):
    return p.run_to_files(p.sessions(_stream(spark, sf), "6 hours"), "complete")


@query("stream_deduplicated", "STR-08 STR-07", "SELECT transaction_id, card_id FROM v_stream", "v_stream")
def stream_deduplicated(spark, sf):
    twice = _stream(spark, sf).unionByName(_stream(spark, sf))
    return p.run_to_files(p.deduplicated(twice, "60 days").select("transaction_id", "card_id"))


@query("stream_monitoring", "SRC-23 STR-09")
def stream_monitoring(spark, sf):
    import uuid

    w = p.monitor(_scored_stream(spark, sf), "monitor_" + uuid.uuid4().hex)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return p.progress(q)


def _parts(spark, sf, n=3):
    """The events as ``n`` files that arrive one after another, a folder for a stream, and what follows the first file."""
    base = scratch(spark, "arrivals")
    events = spark.read.parquet(f"{sf}/events.parquet")
    # by time, so that later files hold later events
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(DAY))
    low, high = events.agg(F.min(day), F.max(day)).first()
    part = F.least(F.floor((day - low) * n / (high - low + 1)), F.lit(n - 1)).cast("int")
    for i in range(n):
        events.where(part == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


@query("stream_review_state", "STR-10", "SELECT transaction_id, status FROM v_state", "v_state")
def stream_review_state(spark, sf):
    """Decisions in three batches; a versioned snapshot is replaced after each."""
    n = F.col("event_id")
    action = F.element_at(F.array(*[F.lit(a) for a in ("approve", "dismiss", "escalate", "decline", "block", None)]), (n % 6 + 1).cast("int"))
    decisions = _parts(spark, sf).select(n.cast("string").alias("transaction_id"), action.alias("action"), n.alias("seq")).filter(F.col("action").isNotNull())
    store = stores.SnapshotStore(spark, scratch(spark, "review"), "transaction_id string, status string, seq bigint")
    stores.run_batches(decisions, lambda df, batch: store.update(batch, lambda now: p.merge_review_state(now, review.decisions_to_events(df))))
    return store.read().select("transaction_id", "status")


@query(
    "stream_window_vs_history",
    "STR-11",
    "SELECT transaction_id, velocity, time_diff_seconds, round(geo_distance_km, 4) AS geo_distance_km FROM v_tracked",
    "v_tracked",
)
def stream_window_vs_history(spark, sf):
    """Three batches, each scored against the rows that were scored before it."""
    history = stores.HistoryStore(spark, scratch(spark, "history"), p.EVENT_ROW, "card_id", "event_time")
    out = scratch(spark, "scored")

    def step(df, batch):
        scored = p.score_window(df, history.before(df, batch), lambda x: p.track_batch(x, GAP))
        scored.write.mode("overwrite").parquet(f"{out}/batch_id={batch}")
        history.add(df, batch)

    stores.run_batches(_shape(_parts(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("int"))), step)
    return _tracked(spark.read.option("basePath", out).parquet(out).drop("batch_id"))

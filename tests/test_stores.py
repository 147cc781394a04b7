"""Snapshots and history over batches that arrive one after another, also repeated ones."""

import random

from pyspark.sql import functions as F

from riskledger.operators import review
from riskledger.streaming import pipeline, stores

ACTIONS = ("approve", "dismiss", "escalate", "decline", "block")
STATE = "transaction_id string, status string, seq bigint"


def decisions(spark, rng, first, n):
    rows = [(f"t{rng.randint(0, 30)}", rng.choice(ACTIONS), first + i) for i in range(n)]
    return spark.createDataFrame(rows, "transaction_id string, action string, seq bigint")


def state(df):
    return sorted(tuple(r) for r in df.select("transaction_id", "status", "seq").collect())


def test_three_files_give_the_fold_of_all_events(spark, tmp_path):
    rng = random.Random(2)
    batches = [decisions(spark, rng, 100 * i, 40) for i in range(3)]
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    store = stores.SnapshotStore(spark, f"{tmp_path}/state", STATE)

    def step(df, batch):
        seen.append(batch)
        for _ in range(2 if batch == 1 else 1):  # the second batch runs twice
            store.update(batch, lambda now: pipeline.merge_review_state(now, review.decisions_to_events(df)))

    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stores.run_batches(stream, step)
    every = batches[0].union(batches[1]).union(batches[2])
    whole = pipeline.merge_review_state(spark.createDataFrame([], STATE), review.decisions_to_events(every))
    assert seen == [0, 1, 2] and state(store.read()) == state(whole)
    assert store.folders.committed() == [1, 2]


def test_a_version_that_was_not_committed_does_not_count(spark, tmp_path):
    store = stores.SnapshotStore(spark, str(tmp_path), STATE)
    assert state(store.read()) == []
    first = spark.createDataFrame([("a", "approved", 1)], STATE)
    store.update(0, lambda now: now.unionByName(first))
    (tmp_path / "version=1").mkdir()
    assert state(store.read()) == [("a", "approved", 1)]
    store.update(1, lambda now: now.unionByName(first.withColumn("seq", F.lit(2).cast("long"))))
    assert len(state(store.read())) == 2


def test_history_by_key_and_time(spark, tmp_path):
    schema = pipeline.EVENT_ROW

    def rows(card, days):
        base = spark.createDataFrame([(f"{card}-{d}", card, d) for d in days], "transaction_id string, card_id string, d int")
        at = F.timestamp_seconds(F.col("d") * 86_400)
        return base.select(*[(at if f.name == "event_time" else F.col(f.name) if f.name in base.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    store = stores.HistoryStore(spark, str(tmp_path), schema, "card_id", "event_time")
    assert store.before(rows("a", [9]), 0).count() == 0
    store.add(rows("a", [1, 5]).union(rows("b", [5])), 0)
    store.add(rows("a", [8]), 1)
    store.add(rows("a", [8]), 1)  # repeated
    ids = lambda df: sorted(r.transaction_id for r in df.collect())
    assert ids(store.before(rows("a", [9]), 2)) == ["a-1", "a-5", "a-8"]
    assert ids(store.before(rows("a", [9]), 2, days=4)) == ["a-5", "a-8"]
    assert ids(store.before(rows("a", [9]), 1)) == ["a-1", "a-5"]
    plan = store.before(rows("a", [9]), 2, days=4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan

"""The team export and the feature store, written and read back."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from riskledger.operators import graph
from riskledger.sources import tables

ROWS = [
    (1, 'a "quoted", text', ["x", None], dt.date(2024, 1, 2), 7),
    (2, "  two\nlines  ", [], dt.date(2024, 1, 3), 7),
    (3, None, None, None, 7),
    (4, "back\\slash", ["y,z"], dt.date(2024, 1, 1), None),
    (5, "żółć", ['"'], dt.date(2023, 1, 1), 8),
]
SCHEMA = "id int, name string, tags array<string>, date date, team_id long"


def test_export_keeps_values(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    tables.export_tables({"notes": df, "none": df.limit(0)}, str(tmp_path), {"notes": [F.desc("date")]})
    back = tables.read_export(spark, str(tmp_path), "notes", df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert glob.glob(f"{tmp_path}/notes/team_id=7") and glob.glob(f"{tmp_path}/notes/team_id=__HIVE*")
    assert tables.read_export(spark, str(tmp_path), "none", df.schema).count() == 0


def test_a_large_team_is_written_by_many_tasks_in_order(spark, tmp_path):
    df = spark.range(20_000).select("id", F.col("id").cast("string").alias("name"), F.when(F.col("id") % 10 == 0, 2).otherwise(1).alias("team_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.export_tables({"rows": df}, str(tmp_path), {"rows": [F.desc("id")]}, rows_per_file=3_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(f"{tmp_path}/rows/team_id=1/*.csv"))
    parts = [[int(x.split(",")[0]) for x in open(f).read().split("\n")[1:] if x] for f in files]
    assert len({f.rsplit("/part-", 1)[1][:5] for f in files}) > 2 and max(map(len, parts)) <= 3_000
    assert [x for p in parts for x in p] == sorted((i for i in range(20_000) if i % 10), reverse=True)


def test_feature_store(spark):
    store = graph.FeatureStore(spark, "test_features", 4)
    store.put(spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, None), (None, 9.0, 9.0), ("a", 0.5, 9.0)], "node string, f0 double, f1 double"))
    first = sorted(map(tuple, store.read().collect()))
    assert first == [("a", 1.0, 2.0), ("b", 3.0, None)]
    assert store.put(spark.createDataFrame([("b", None, 5.0), ("c", 6.0, 7.0)], "node string, f0 double, f1 double")) == 2
    assert sorted(map(tuple, store.read(1).collect())) == first
    assert sorted(r.node for r in store.keys().collect()) == ["a", "b", "c"]
    wanted = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "node string")
    got = sorted(map(tuple, graph.get_features(store.read(), wanted).collect()))
    assert got == [("a", 1.0, 2.0), ("b", -1.0, 5.0), ("z", -1.0, -1.0)]


def test_reading_does_not_shuffle_the_store(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = graph.FeatureStore(spark, "plan_features")
        feats = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("node"), F.rand(1).alias("f0"))
        store.put(feats)
        store.put(feats.where("f0 > 0.5").withColumn("f0", F.lit(0.0)))
        assert store.read().where("f0 > 0.5").count() == 0 and store.read().count() == 1000
        files = {r.f.rsplit("/", 1)[1] for r in store.read().select(F.input_file_name().alias("f")).distinct().collect()}
        assert len(files) <= store.buckets  # a file a bucket after an update too
        got = graph.get_features(store.read(), spark.range(50).select(F.concat(F.lit("n"), "id").alias("node")))
        plan = got._jdf.queryExecution().executedPlan().toString()
        scan = plan.index("FileScan")
        side = plan[plan.rindex("Exchange", 0, scan) if "Exchange" in plan[:scan] else 0 : scan]
        assert plan.count("Exchange hashpartitioning") == 1 and "Range" in side, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

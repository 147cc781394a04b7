from riskledger.operators import components


def test_few_edges_are_written_by_few_tasks_in_every_round(spark, monkeypatch):
    rounds, held = [], {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    real = components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: (out := real(df), rounds.append(out.rdd.getNumPartitions()))[0])
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(90, 80)], "a long, b long")
        got = {r.node: r.component for r in components.connected(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 1 for i in range(1, 41)} | {80: 80, 90: 80}
    assert len(rounds) > 2 and max(rounds[1:]) <= spark.sparkContext.defaultParallelism

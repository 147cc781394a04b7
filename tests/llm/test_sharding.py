import zlib

from pyspark.sql import functions as F

from riskledger.llm import registry, sharding


def jump(key: int, n: int) -> int:
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 256, 10**15, *range(1000, 1200)]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 8, 9, 100):
        got = {r.k: r.s for r in rows.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_one_more_shard_takes_rows_only_into_itself(spark, sf):
    rows = registry.QUERIES["op2_sharding"](spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == set(docs)
    slots = {}
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.shard == jump(r.doc_id, 8) and r.grown_shard == jump(r.doc_id, 9) and r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_edge_rows(edge_docs, no_docs):
    placed = sharding.number_slots(sharding.assign_shards(edge_docs, ["doc_id"], 3), ["doc_id"], ["doc_id", "text"], parts=2)
    rows = placed.collect()
    assert len(rows) == edge_docs.count() and set(placed.columns) == set(edge_docs.columns)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.shard == jump(r.doc_id or 0, 3) for r in rows)
    assert sharding.number_slots(sharding.assign_shards(no_docs, ["doc_id"], 3), ["doc_id"], ["doc_id"]).count() == 0


def test_other_keys_are_hashed(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), (None, None)], "s string, t int")
    got = sharding.assign_shards(rows, ["s", "t"], 1000).collect()
    assert got[0].shard == got[1].shard and all(0 <= r.shard < 1000 for r in got)


def test_shards_are_written(spark, tmp_path):
    rows = sharding.assign_shards(spark.range(100).withColumnRenamed("id", "k"), ["k"], 4)
    sharding.write_shards(rows, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 100

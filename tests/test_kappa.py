from itertools import combinations

import pytest
from pyspark.sql import functions as F

from riskledger.operators import explain
from riskledger.session import stored


def test_ratings_are_never_broadcast(spark):
    ratings = stored(spark.range(300).withColumnRenamed("id", "item"), "ratings").withColumn("annotator", F.explode(F.sequence(F.lit(0), F.lit(4))))
    out = explain.kappa(ratings.withColumn("label", (F.col("item") * (F.col("annotator") + 3)) % 3))
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().replace("#", " ")
    assert "SortMergeJoin [item" in plan and "BroadcastHashJoin [item" not in plan
    label = {g: [i * (g + 3) % 3 for i in range(300)] for g in range(5)}
    assert len(rows) == 10
    for a, b in combinations(range(5), 2):
        po = sum(x == y for x, y in zip(label[a], label[b])) / 300
        pe = sum(label[a].count(v) * label[b].count(v) for v in range(3)) / 300**2
        want = 1.0 if pe == 1 else (po - pe) / (1 - pe)
        assert next(r.kappa for r in rows if (r.a, r.b) == (a, b)) == pytest.approx(want, abs=1e-6)

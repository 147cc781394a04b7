import json

import pytest
from pyspark.sql import functions as F

from riskledger.operators import ranks, review, scoring
from riskledger.plans import catalog, risk
from riskledger.sources import export, tables


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "t.csv"
    head = ",".join(tables.TRANSACTION_COLUMNS)
    lines = [head]
    n = 0
    for card in range(6):
        for d in range(12):
            n += 1
            lines.append(f"t{n:04d},2024-01-{d + 1:02d}T12:0{card}:00,c{card},{18 + d % 4}.50,Cafe {card % 3},restaurant,in_person,CA,CA,,")
    lines.append("t9001,2024-01-20T03:00:00,c1,950.00,Gift Hub,gift_card,online,CA,US,dev9,8.8.8.8")
    lines.append("t9002,2024-01-20T03:20:00,c1,940.00,Gift Hub,gift_card,online,CA,US,dev9,8.8.8.8")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_gift_card_is_flagged_and_exported(spark, csv, tmp_path):
    raw = tables.read_raw_transactions(spark, csv)
    assert tables.violations(raw).count() == 0
    txns = tables.normalize_transactions(raw)
    risks = risk.score_transactions(txns).withColumn("review_status", F.lit("pending"))
    rows = {r.transaction_id: r for r in risks.collect()}
    assert rows["t9002"].is_flagged and rows["t9002"].primary_pattern == "account_takeover_purchase"
    assert "HIGH_RISK_CATEGORY_AMOUNT" in [x.code for x in rows["t9002"].reasons]
    assert rows["t0005"].risk_level == "low" and rows["t0005"].recommended_action != "escalate"
    export.write_csv(export.flagged_rows(txns, risks), str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).count() == sum(r.is_flagged for r in rows.values())
    export.write_risk_json(risks, scoring.run_summary(risks), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j/transactions")).count() == len(rows)


def test_feature_steps_are_written_one_after_another(spark, csv):
    """The frame joins stored columns: no step's windows and shuffles are left in its plan."""
    txns = tables.normalize_transactions(tables.read_raw_transactions(spark, csv))
    frame = risk.feature_frame(txns)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Broadcast" not in plan
    for name in ("own", "velocity", "near", "collective"):
        assert f"features-{name}-" in plan
    assert frame.count() == txns.count() == frame.select("transaction_id").distinct().count()


def test_bad_files_are_reported(spark):
    rows = [("1", "2024-01-01T00:00:00", "-3"), ("1", "nope", "5"), ("2", "2024-01-01T00:00:00", None)]
    df = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], ",".join(f"{c} string" for c in ("transaction_id", "timestamp", "amount", "card_id", *tables.TRANSACTION_COLUMNS[4:])))
    got = {r.rule: r.n for r in tables.violations(df).collect()}
    assert got == {"bad_amount": 2, "bad_timestamp": 1, "duplicate_id": 1}


@pytest.mark.parametrize("rate,want", [(0.5, 0.3), (0.0, 1.0), (1.0, 0.1), (0.01, 0.5)])
def test_threshold(spark, rate, want):
    df = spark.createDataFrame([(x / 10,) for x in (1, 2, 3, 3, 5)], "s double")
    assert ranks.score_threshold(df, "s", rate).first().threshold == want


def test_cost_beats_rate_beats_profile():
    assert ranks.review_rate("balanced", 0.5, 1, 1)[0] == "cost_aware"
    assert ranks.review_rate("balanced", 0.5) == ("custom", 0.5)
    assert ranks.review_rate("unknown")[1] == 0.08


def test_undo_stack(spark):
    seq = ["approve", "block", "undo:block", "dismiss", "decline", "undo:decline", "undo:dismiss", "escalate"]
    df = spark.createDataFrame(list(enumerate(seq)), "seq long, action string")
    open_ = {r.action for r in review.undo_stack(df, block=3).collect()}
    assert open_ == {"approve", "escalate"}


def test_scoring_plan_has_no_python(spark, sf):
    from riskledger.plans.q_scoring import scored

    plan = scored(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_every_query_states_what_it_covers():
    assert set(catalog.QUERIES) == set(catalog.COVERS) and all(catalog.COVERS.values())
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_audit_round_trip(spark, tmp_path):
    line = {"transaction_id": "a", "action": "approve", "from_status": "pending", "to_status": "approved", "reviewer": "r", "created_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "log.jsonl").write_text(json.dumps(line) + "\n\n" + json.dumps({**line, "transaction_id": "b"}) + "\n")
    assert tables.read_audit(spark, str(tmp_path / "log.jsonl")).filter("transaction_id is not null").count() == 2

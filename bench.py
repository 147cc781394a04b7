"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "risk_card_amount",
    "risk_card_novelty",
    "risk_surprisal",
    "risk_velocity",
    "risk_near_duplicates",
    "risk_collective",
    "risk_queue",
    "review_feedback",
    "report_revenue_net",
    "report_profit_net",
    "report_spending",
    "report_tax_paid",
    "report_recurring_expenses",
    "invoice_totals_line_tax",
    "invoice_payment_analysis",
    "customer_list",
    "link_pair_scores",
    "graph_stats",
    "explain_line_degree",
    "list_workflow_status",
    "rank_percentile",
    "stream_gap_sessions_batch",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
    from riskledger.plans import catalog
    from riskledger.session import get_session

    spark = get_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()  # start-up is not part of the first query
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

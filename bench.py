"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch import registry  # noqa: E402
from tidewatch.session import session  # noqa: E402

HEADLINE = (
    "log_overview", "overview_windows24", "rule_presence", "rule_count", "rule_count_distinct", "rule_anchored_count", "rule_not_seen_before", "rule_speed", "rule_signals_suppressed", "burst_user_6h", "burst_src_ip_300s", "burst_supplier_month",
    "beaconing", "rarity", "seasonal_fallback", "seasonal_residuals", "url_path_entropy", "entity_window_features", "entity_window_z", "navigation_hops", "outliers_eif", "outliers_kth_nn", "outliers_lof", "entity_nodes", "graph_edges", "graph_degrees",
    "fused_incidents", "baseline_profiles", "contact_history", "indicator_overlap", "ip_range_join", "redaction_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["log_overview"](spark, sf_dir).collect()  # the first query pays for starting up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

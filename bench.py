"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tagweave.catalog import QUERIES
from tagweave.session import build_session

HEADLINE = [
    "e02_pick_max_entropy", "b11_apply_label_events", "d05_auc_all", "f02_stratified_sample_class", "c02_knn_graph",
    "h01_propagate_labels", "f09_kpp_sample", "d16_uniformity", "d21_contrastive_report_standard", "g05_encode_corpus",
    "j01_label_event_stream",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, spark__driver__memory="12g",
                          spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the Python workers and the code generator before the clock runs.
    QUERIES["a06_read_embeddings"](spark, sf).count()
    QUERIES["b16_random_projection"](spark, sf).count()
    times, rows = {}, {}
    for name in names:
        start = time.perf_counter()
        rows[name] = QUERIES[name](spark, sf).toArrow().num_rows
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "rows": rows, "cores": cpus, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the registered queries of the library and print one JSON line.

``value`` sums the business reports; ``queries`` holds these and, after them, measures, derived
figures, and the reports from the warehouse and from layers, whose times include storing.

Each query runs once unmeasured on the smallest data (class loading, code generation) and
is then timed over a full evaluation at $BENCH_SF_DIR on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from stallworks.operators.ranking import remove_written
from stallworks.registry import DERIVED, REPORTS, registered_queries

OTHERS = DERIVED + [
    n for n in registered_queries() if n.startswith(("metric_", "warehouse_", "layer_"))
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stallworks-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered_queries()
    names = sys.argv[1:] or REPORTS + OTHERS
    warm_dir = Path(sf_dir).parent / "sf0.001"
    seconds: dict[str, float] = {}
    for name in names:
        if warm_dir.exists():
            queries[name](spark, str(warm_dir)).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        remove_written(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_report_seconds",
                "value": round(sum(s for n, s in seconds.items() if n in REPORTS or sys.argv[1:]), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

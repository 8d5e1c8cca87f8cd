"""Time the headline jobs and print one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import analytics, files, structure  # noqa: E402
from revtables.session import local_session  # noqa: E402

HEADLINE = {
    "snapshot_changes": files.snapshot_changes,
    "revision_file_changes": files.revision_file_changes,
    "multiset_line_diff": files.multiset_line_diff,
    "line_diff": files.line_diff_counts,
    "symbol_log": analytics.symbol_log,
    "inspect_every_symbol": analytics.inspect_every_symbol,
    "companions_of_symbol": analytics.companions_of_symbol,
    "companions_of_every_symbol": analytics.companions_of_every_symbol,
    "commit_chain": analytics.commit_chain,
    "line_regions": structure.line_regions,
    "page_regions": structure.page_regions,
    "novel_lines_per_region": structure.novel_lines_per_region,
    "diff_symbols": files.diff_symbols,
    "build_history": files.build_history,
}
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in HEADLINE.items():
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    result = {
        "metric": "median seconds of the headline jobs, summed",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

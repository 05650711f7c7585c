"""Bench: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the `noop` sink (no collect to the
driver), `BENCH_REPEAT` times after one warm-up pass; the per-query figure is
the median. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from larder import get_session  # noqa: E402
from larder.plans.queries import REGISTRY  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                        **{"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})

    def run(name: str) -> float:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    names = only or list(REGISTRY)
    errors: dict[str, str] = {}
    for n in names:  # warm-up: JIT, file listing, broadcast probes
        try:
            run(n)
        except Exception as e:  # one failing query must not lose the others' timings
            errors[n] = str(e).splitlines()[0][:300]
    timings = {n: statistics.median(run(n) for _ in range(repeat)) for n in names if n not in errors}
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": {k: (round(timings[k], 3) if k in timings else None) for k in names},
        "errors": errors,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeat": repeat,
        "spark": pyspark.__version__,
    }))


if __name__ == "__main__":
    main()

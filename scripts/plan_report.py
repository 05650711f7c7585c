"""Summarise the executed physical plan of each registered batch query.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
Per query: join strategies, exchanges, aggregates and windows (counts), and the
filters and column sets pushed into each Parquet scan. Streaming queries are
left out: what they return is a read of their sink.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from larder import get_session  # noqa: E402
from larder.plans.queries import REGISTRY  # noqa: E402

NODES = r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|" \
        r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin|" \
        r"BroadcastExchange|TakeOrderedAndProject|HashAggregate|ObjectHashAggregate|SortAggregate|Window|" \
        r"Generate|Expand|InMemoryTableScan|PythonUDF|ArrowEvalPython|FlatMapGroupsInPandas)"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=16)
    print(f"# Physical plans at {sf_dir}\n")
    print("Generated by `scripts/plan_report.py` after running each query once (AQE final plans).\n")
    for name, q in REGISTRY.items():
        if name.startswith("stream_"):
            continue
        df = q(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = Counter(re.findall(NODES, plan))
        print(f"## {name}\n")
        print("- nodes: " + ", ".join(f"{k} ×{v}" for k, v in sorted(counts.items())))
        scans = re.findall(r"FileScan parquet [^\n]*?\[([^\]]*)\][^\n]*?PushedFilters: \[([^\]]*)\][^\n]*?"
                           r"ReadSchema: (struct<[^>]*>)", plan)
        for cols, pushed, schema in scans:
            table = re.search(r"/(\w+)\.parquet", plan[plan.find(schema) - 400:plan.find(schema)])
            print(f"- scan{'' if not table else ' ' + table.group(1)}: pushed [{pushed}] read {schema}")
        print()


if __name__ == "__main__":
    main()

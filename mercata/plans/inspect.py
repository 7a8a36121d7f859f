"""Physical-plan summaries from ``DataFrame.explain('formatted')``.

``python -m mercata.plans.inspect [sf_dir] > PLANS.md`` writes one table row
per registered query: shuffles, broadcasts, join strategies, windows,
Python evaluation and whether filters reached the Parquet scans.
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

from pyspark.sql import DataFrame

COUNTED = (
    "shuffles",
    "single_partition",
    "broadcasts",
    "smj",
    "bhj",
    "shj",
    "bnlj",
    "cartesian",
    "windows",
    "aggregates",
    "scans",
    "subqueries",
    "python",
)
NODE = {
    "BroadcastExchange": "broadcasts",
    "SortMergeJoin": "smj",
    "BroadcastHashJoin": "bhj",
    "ShuffledHashJoin": "shj",
    "BroadcastNestedLoopJoin": "bnlj",
    "CartesianProduct": "cartesian",
    "Window": "windows",
    "HashAggregate": "aggregates",
    "ObjectHashAggregate": "aggregates",
    "SortAggregate": "aggregates",
    "ArrowEvalPython": "python",
    "BatchEvalPython": "python",
}


def formatted_plan(df: DataFrame) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def plan_summary(df: DataFrame) -> dict[str, int]:
    """Operator counts of the (initial, pre-AQE) physical plan, subqueries
    included, from the per-node detail blocks of the formatted explain."""
    text = formatted_plan(df)
    out = dict.fromkeys(COUNTED, 0)
    out["pushed_filter_scans"] = 0
    seen = set()
    for m in re.finditer(r"^\((\d+)\) ([A-Za-z]+)[^\n]*\n(.*?)(?=^\(\d+\) |\Z)", text, re.S | re.M):
        node_id, name, body = m.group(1), m.group(2), m.group(3)
        if node_id in seen:
            continue
        seen.add(node_id)
        if name == "Exchange":
            out["single_partition" if "SinglePartition" in body else "shuffles"] += 1
        elif name == "Scan":
            out["scans"] += 1
            if re.search(r"PushedFilters: \[[^\]]+\]", body):
                out["pushed_filter_scans"] += 1
        elif name in NODE:
            out[NODE[name]] += 1
    out["subqueries"] = len(set(re.findall(r"^Subquery:(\d+)", text, re.M)))
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from mercata.plans.oracle import SQL
    from mercata.plans.registry import QUERIES
    from mercata.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    eager = {"kmeans_elbow"}
    cols = [*COUNTED, "pushed_filter_scans"]
    print("# Physical plans of the registered queries\n")
    print(
        "Generated by `python -m mercata.plans.inspect`: operator counts of each query's\n"
        "initial physical plan (AQE may still turn a sort-merge join into a broadcast join\n"
        "or coalesce partitions at run time). `oracle`: SQL oracle exists.\n"
    )
    print("| query | oracle | " + " | ".join(cols) + " |")
    print("| --- | --- | " + " | ".join("---" for _ in cols) + " |")
    for name in sorted(QUERIES):
        if name in eager:
            print(f"| `{name}` | no | " + " | ".join("-" for _ in cols) + " |")
            continue
        s = plan_summary(QUERIES[name](spark, sf_dir))
        print(f"| `{name}` | {'yes' if name in SQL else 'no'} | " + " | ".join(str(s[c]) for c in cols) + " |")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Summarise the final (adaptive) physical plan of every registered query.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md

Each query is executed once so that the adaptive plan is final, then its plan
tree (subqueries included) is walked node by node and shuffles, broadcasts, reused
exchanges and join strategies are counted.
"""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfscope.plans import registry  # noqa: E402
from shelfscope.session import get_session  # noqa: E402

SKIP = {"rating_model", "sales_model", "rating_model_bounds"}  # model fits: MLlib jobs, not a single plan


def _parts(node) -> list:
    """What runs below a plan node: final plans of adaptive parts, not their initial ones."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    if kind == "InMemoryTableScanExec":
        return [node.relation().cachedPlan()]
    return _items(node.children()) + _items(node.subqueries())


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def walk(node, found: Counter) -> Counter:
    kind = node.getClass().getSimpleName()
    found[kind] += 1
    if kind == "ShuffleExchangeExec" and node.outputPartitioning().getClass().getSimpleName().startswith("SinglePartition"):
        found["single"] += 1
    if not kind.startswith("Reused"):
        for part in _parts(node):
            walk(part, found)
    return found


def summarise(plan) -> dict[str, int | str]:
    found = walk(plan, Counter())
    joins = {k.removesuffix("Exec"): n for k, n in found.items() if "Join" in k or "Cartesian" in k}
    return {"shuffles": found["ShuffleExchangeExec"], "single": found["single"],
            "broadcasts": found["BroadcastExchangeExec"],
            "reused": found["ReusedExchangeExec"] + found["ReusedSubqueryExec"],
            "joins": ", ".join(f"{k} x{v}" for k, v in sorted(joins.items())) or "-"}


def main(argv: list[str]) -> None:
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    print("# Final plan shapes of the registered queries\n")
    print(f"Generated by `scripts/plan_report.py` on `{sf}` (`local[8]`, AQE on, 8 shuffle "
          "partitions). Counts cover the whole executed plan, subqueries included; "
          "`single` counts the exchanges into one partition, which here are always the "
          "final merge of a global aggregate or a window over a bounded table.\n")
    print("| query | shuffles | single | broadcasts | reused | joins |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, fn in registry.QUERIES.items():
        if name in SKIP:
            continue
        df = fn(spark, sf)
        df.collect()
        s = summarise(df._jdf.queryExecution().executedPlan())
        print(f"| {name} | {s['shuffles']} | {s['single']} | {s['broadcasts']} | {s['reused']} | {s['joins']} |")


if __name__ == "__main__":
    main(sys.argv)

"""What a plan has read, from the metrics of its scans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def scanned_rows(df: DataFrame) -> int:
    """Run df and give the rows that its scans put out (after pruning of files and row groups, before other filters)."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return _scanned(execution.executedPlan())


def _scanned(plan) -> int:
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _scanned(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _scanned(plan.plan())
    children = plan.children()
    if not children.size():
        found = plan.metrics().get("numOutputRows")
        return found.get().value() if found.isDefined() else 0
    return sum(_scanned(children.apply(k)) for k in range(children.size()))

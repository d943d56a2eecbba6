"""What a plan did: rows at scans, filters and joins, read from its executed nodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class NodeRows:
    """A node of an executed plan and the rows it put out (None: not counted)."""

    name: str
    detail: str
    rows: int | None
    depth: int


@dataclass(frozen=True)
class RunReport:
    """The rows of a run, and of its nodes from the top down."""

    rows: int
    nodes: tuple[NodeRows, ...]

    def _of(self, *kinds: str) -> list[NodeRows]:
        return [n for n in self.nodes if any(k in n.name for k in kinds)]

    @property
    def rows_scanned(self) -> int:
        """Rows of the row groups that survived pruning, over all scans."""
        return sum(n.rows or 0 for n in self._of("Scan"))

    @property
    def filter_rows_out(self) -> int:
        return sum(n.rows or 0 for n in self._of("Filter"))

    @property
    def join_rows_out(self) -> int:
        return sum(n.rows or 0 for n in self._of("Join"))


def run(df: DataFrame) -> RunReport:
    """Runs a plan without collecting its rows and reports on it."""
    execution = df._jdf.queryExecution()
    rows = execution.toRdd().count()
    return RunReport(rows, tuple(_walk(execution.executedPlan(), 0)))


def _walk(node, depth: int) -> Iterator[NodeRows]:
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _walk(node.executedPlan(), depth)
        return
    if name.endswith("QueryStageExec"):
        yield from _walk(node.plan(), depth)
        return
    if name not in ("WholeStageCodegenExec", "InputAdapter"):
        metric = node.metrics().get("numOutputRows")
        yield NodeRows(node.nodeName(), node.simpleString(200), int(metric.get().value()) if metric.isDefined() else None, depth)
        depth += 1
    children = node.children()
    for i in range(children.size()):
        yield from _walk(children.apply(i), depth)

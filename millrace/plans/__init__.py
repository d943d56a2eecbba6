"""Plans as chains of operators, and what they did when they ran."""

from millrace.plans.metrics import RunReport, run
from millrace.plans.query import Query, table

__all__ = ["Query", "RunReport", "run", "table"]

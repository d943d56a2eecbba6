"""Types, expressions and aggregates."""

from millrace.functions.aggregates import Aggregate, avg, count, count_rows, max_, min_, sum_
from millrace.functions.expressions import Expr, col, lit

__all__ = ["Aggregate", "Expr", "avg", "col", "count", "count_rows", "lit", "max_", "min_", "sum_"]

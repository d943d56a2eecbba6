"""Tables on storage: writing, reading, reporting, generating."""

from millrace.sources.inspect import PruningEstimate, can_contain, prune_estimate, row_groups, table_report
from millrace.sources.tables import TableWriter, read_table, write_table

__all__ = ["PruningEstimate", "TableWriter", "can_contain", "prune_estimate", "read_table", "row_groups", "table_report", "write_table"]

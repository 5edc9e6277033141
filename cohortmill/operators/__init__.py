"""DataFrame operators: joins, first-row selection, aggregation, tables, curves."""

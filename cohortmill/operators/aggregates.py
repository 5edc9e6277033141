"""Aggregate expressions with an explicit missing-value policy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortmill.functions.missing import ColumnLike, as_column


def n_distinct(*columns: ColumnLike, na_rm: bool = False) -> Column:
    """Distinct values; unless ``na_rm``, a missing value counts as one value.

    Of one column the missing value is added to the count of the others, so that both
    policies share one distinct set. Several columns are wrapped: a struct is never NULL.
    """
    if na_rm:
        return F.count_distinct(*[as_column(c) for c in columns])
    if len(columns) == 1:
        missing = F.max(as_column(columns[0]).isNull().cast("long"))
        return F.count_distinct(as_column(columns[0])) + F.coalesce(missing, F.lit(0).cast("long"))
    return F.count_distinct(F.struct(*[as_column(c) for c in columns]))


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_missing(column: ColumnLike) -> Column:
    return F.count_if(as_column(column).isNull())


def count_true(condition: Column) -> Column:
    """Rows where the condition holds; missing conditions do not count, none gives 0."""
    return F.count_if(condition)


def strict(aggregate: Column, *inputs: ColumnLike) -> Column:
    """The aggregate, or NULL when any input value in the group is missing."""
    complete = None
    for c in inputs:
        test = F.count_if(as_column(c).isNull()) == 0
        complete = test if complete is None else complete & test
    return F.when(complete, aggregate)


def strict_count_true(condition: Column) -> Column:
    """Like ``count_true``, but one missing condition makes the count missing."""
    return strict(F.count_if(condition), condition)


def sum_present(column: ColumnLike) -> Column:
    """Sum of the present values; 0 when there are none."""
    return F.coalesce(F.sum(as_column(column)), F.lit(0))


def mean_present(column: ColumnLike) -> Column:
    """Mean of the present values; NULL when there are none."""
    return F.avg(as_column(column))

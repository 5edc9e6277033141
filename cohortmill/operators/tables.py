"""Frequency tables, pivots, totals and percentages.

Everything here first reduces the data to counted cells, so the wide steps only see as
many rows as the table shown. Column categories are read to the driver to name columns;
their number is checked, not assumed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from cohortmill.functions.factors import levels_of, may_be_missing
from cohortmill.functions.missing import ColumnLike, as_column, round_half_even
from cohortmill.sources.files import stage


def categories(df: DataFrame, column: str, limit: int | None = None) -> list:
    """Distinct values of a column, sorted, a missing value last.

    For categories that become columns. Beyond ``limit``, by default Spark's own
    ``spark.sql.pivotMaxValues``, this fails; open-ended categories stay rows.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues")) if limit is None else limit
    found = [r[0] for r in df.select(column).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories and cannot become columns")
    return sorted(v for v in found if v is not None) + [None for v in found if v is None]


def _numeric(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def frequency(df: DataFrame, column: str) -> DataFrame:
    """One-way table: n, share of all rows, share of the rows with a value. A factor lists all its levels."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if levels_of(df, column) is not None:
        counts = _every_level(counts, column)
    totals = counts.agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col(column).isNotNull(), F.col("n"))).alias("valid")
    )
    packed = totals.select(F.struct("all", "valid").alias("t")).scalar()
    return counts.withColumn("__t", packed).select(
        column,
        "n",
        F.try_divide(F.col("n"), F.col("__t.all")).alias("percent"),
        F.when(F.col(column).isNotNull(), F.try_divide(F.col("n"), F.col("__t.valid"))).alias("valid_percent"),
    )


def _every_level(counts: DataFrame, column: str) -> DataFrame:
    return with_empty_rows(counts.withColumn("__all", F.lit(True)), ["__all"], [column]).drop("__all")


def pivot_wider(
    cells: DataFrame,
    id_cols: Sequence[str],
    names_from: str,
    values_from: ColumnLike,
    values: Sequence | None = None,
    aggregate=F.sum,
    fill=None,
    na_name: str = "NA",
    other: str | None = None,
) -> DataFrame:
    """Spread a category over columns, in one shuffle.

    Each new column aggregates the cells of its category, so several cells of one id are
    combined by ``aggregate`` and never dropped. ``values`` fixes the column order; a factor brings
    its levels, and a column for missing values if it may have any. Without either
    the cells are written once, read for their categories, and spread from there. Cells of
    a category that ``values`` leaves out are gathered in the column ``other``; without
    that name the table fails when it meets one.
    """
    if values is None and levels_of(cells, names_from) is not None:
        values = [*levels_of(cells, names_from), *[None] * may_be_missing(cells, names_from)]
    if values is None:
        cells = stage(cells)
    known = categories(cells, names_from) if values is None else list(values)
    value = as_column(values_from)
    columns = []
    for v in known:
        match = _q(names_from).isNull() if v is None else _q(names_from) == F.lit(v)
        cell = aggregate(F.when(match, value))
        if fill is not None:
            cell = F.coalesce(cell, F.lit(fill))
        columns.append((cell, na_name if v is None else str(v)))
    if values is not None:
        listed = F.coalesce(_q(names_from).isin([v for v in known if v is not None]), F.lit(None in known))
        if other is not None:
            rest = aggregate(F.when(~listed, value))
            columns.append((rest if fill is None else F.coalesce(rest, F.lit(fill)), other))
        else:
            stray = F.max(F.when(~listed, F.coalesce(_q(names_from).cast("string"), F.lit("a missing value"))))
            message = F.concat(F.lit(f"{names_from} has a category without a column: "), stray)
            columns = [(F.when(stray.isNotNull(), F.raise_error(message)).otherwise(c), n) for c, n in columns]
    columns = [c.alias(n) for c, n in columns]
    return cells.groupBy(*[_q(c) for c in id_cols]).agg(*columns)


def count_table(
    df: DataFrame,
    rows: Sequence[str],
    column: str,
    count: Column,
    values: Sequence | None = None,
    fill: int | None = 0,
    na_name: str = "NA",
    other: str | None = None,
) -> DataFrame:
    """Aggregate per (rows, column) cell, then spread the column."""
    cells = df.groupBy(*rows, column).agg(count.alias("__cell"))
    return pivot_wider(cells, rows, column, "__cell", values, fill=fill, na_name=na_name, other=other)


def cross_frequency(df: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Two-way table of row counts; a missing column category is called ``NA_``."""
    return count_table(df, [row], column, F.count(F.lit(1)), values, na_name="NA_")


def layered_frequency(df: DataFrame, row: str, column: str, layer: str, values: Sequence | None = None) -> DataFrame:
    """Three-way table: a two-way table for every layer, stacked.

    Every layer lists every row value, with zeros where it has none.
    """
    table = count_table(df, [layer, row], column, F.count(F.lit(1)), values, na_name="NA_")
    return with_empty_rows(table, [layer], [row])


def with_empty_rows(table: DataFrame, groups: Sequence[str], levels: Sequence[str], fill=0, limit: int | None = None) -> DataFrame:
    """Complete a counted table: every group lists every level, and a missing one if any group has it.

    Added rows hold ``fill`` in numeric columns and are missing elsewhere. The levels of a factor are those declared. Others are
    looked up in the table, which is written once for that; beyond ``limit``, by default Spark's
    ``spark.sql.pivotMaxValues``, this fails: open-ended categories have no complete table.
    """
    declared = levels_of(table, levels[0]) if len(levels) == 1 else None
    table = stage(table)
    kinds = [table.schema[c].dataType for c in levels]
    if declared is None:
        limit = int(table.sparkSession.conf.get("spark.sql.pivotMaxValues")) if limit is None else limit
        found = table.select(*[_q(c) for c in levels]).distinct().limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"{', '.join(levels)} has more than {limit} levels, too many for every group to list")
    else:
        found = [(v,) for v in declared]
    if not found:
        return table
    known = F.array(*[F.struct(*[F.lit(v).cast(k).alias(f"l{i}") for i, (v, k) in enumerate(zip(row, kinds))]) for row in found])
    if declared is not None:
        lacking = table.agg(F.coalesce(F.bool_or(_q(levels[0]).isNull()), F.lit(False)).alias("x")).scalar()
        none = F.array(F.struct(F.lit(None).cast(kinds[0]).alias("l0")))
        known = F.when(lacking, F.concat(known, none)).otherwise(known)
    grid = table.select(*[_q(c) for c in groups]).distinct().withColumn("__level", F.explode(known))
    keys = [*groups, *levels]
    grid = grid.select(*[_q(c).alias(f"__g{i}") for i, c in enumerate(groups)], *[F.col("__level").getField(f"l{i}").alias(f"__g{i + len(groups)}") for i in range(len(levels))])
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & _q(c).eqNullSafe(F.col(f"__g{i}"))
    met = grid.join(table, same, "left")
    numeric = _numeric(table, skip=keys)
    columns = [
        F.col(f"__g{keys.index(c)}").alias(c, metadata=table.schema[c].metadata)
        if c in keys
        else F.coalesce(_q(c), F.lit(fill)).alias(c)
        if c in numeric
        else _q(c)
        for c in table.columns
    ]
    return met.select(*columns)


def fill_missing(df: DataFrame, value=0, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace missing cells, by default in numeric columns only."""
    return df.fillna(value, subset=list(columns) if columns is not None else _numeric(df))


def totals_column(df: DataFrame, columns: Sequence[str] | None = None, name: str = "Total") -> DataFrame:
    """Row sums over numeric columns other than the first; missing cells count as nothing."""
    cols = list(columns) if columns is not None else _numeric(df, skip=df.columns[:1])
    total = sum((F.coalesce(_q(c), F.lit(0)) for c in cols[1:]), F.coalesce(_q(cols[0]), F.lit(0)))
    return df.withColumn(name, total)


def totals_row(df: DataFrame, columns: Sequence[str] | None = None, name: str = "Total") -> DataFrame:
    """Append one row of column sums, labelled in the first column.

    The sums add the cells shown: an id counted in two cells counts twice here.
    """
    first = df.columns[0]
    cols = list(columns) if columns is not None else _numeric(df, skip=[first])
    body = df.withColumn(first, _q(first).cast("string"))
    sums = body.agg(*[F.coalesce(F.sum(_q(c)), F.lit(0)).alias(c) for c in cols])
    return body.unionByName(sums.withColumn(first, F.lit(name)), allowMissingColumns=True)


def totals(df: DataFrame, where: str = "row", columns: Sequence[str] | None = None) -> DataFrame:
    """Totals as a "row", a "col", or "both"."""
    cols = list(columns) if columns is not None else _numeric(df, skip=df.columns[:1])
    if where in ("col", "both"):
        df = totals_column(df, cols)
        cols = [*cols, "Total"]
    return totals_row(df, cols) if where in ("row", "both") else df


def column_percentages(
    df: DataFrame, columns: Sequence[str], suffix: str = "_pct", text_suffix: str | None = "_text", digits: int = 2
) -> DataFrame:
    """Totals row, share of the column total, and the text ``n (p%)`` for a table of counts.

    Shares are taken of the column sum without the totals row, whose own share is 1.
    """
    first = df.columns[0]
    body = df.withColumn(first, _q(first).cast("string"))
    sums = body.agg(*[F.coalesce(F.sum(_q(c)), F.lit(0)).alias(c) for c in columns])
    packed = F.struct(*[_q(c).alias(f"s{i}") for i, c in enumerate(columns)])
    last = sums.withColumn("__sum", packed).withColumn(first, F.lit("Total"))
    body = body.withColumn("__sum", sums.select(packed.alias("p")).scalar())
    out = body.unionByName(last, allowMissingColumns=True)
    added = {}
    for i, c in enumerate(columns):
        share = F.try_divide(_q(c), F.col(f"__sum.s{i}"))
        added[c + suffix] = share
        if text_suffix is not None:
            text = F.format_string(f"%d (%.{digits}f%%)", _q(c), round_half_even(share * 100, digits))
            added[c + text_suffix] = F.when(share.isNotNull(), text)
    return out.withColumns(added).drop("__sum")


def threshold_table(df: DataFrame, value: ColumnLike, limit: float, name: str = "above") -> DataFrame:
    """Rows above and not above a limit; missing values are left out."""
    return (
        df.filter(as_column(value).isNotNull())
        .groupBy((as_column(value) > limit).alias(name))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sorted_report(df: DataFrame, by: Sequence[str], tie_break: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Sort descending with missing values last, then optionally show the first rows only."""
    out = df.orderBy(*[_q(c).desc_nulls_last() for c in by], *[_q(c).asc_nulls_last() for c in tie_break])
    return out if limit is None else out.limit(limit)

"""Numeric bands as a label plus a rank, the rank standing in for an ordered factor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from cohortmill.functions.missing import ColumnLike, as_column


@dataclass(frozen=True)
class Band:
    """Values from ``low`` up to ``high``; ``high`` itself belongs when ``closed``."""

    label: str | int
    low: float | None = None
    high: float | None = None
    closed: bool = True
    open_low: bool = False

    def holds(self, x: Column) -> Column:
        tests = []
        if self.low is not None:
            tests.append(x > self.low if self.open_low else x >= self.low)
        if self.high is not None:
            tests.append(x <= self.high if self.closed else x < self.high)
        condition = tests[0]
        for test in tests[1:]:
            condition = condition & test
        return condition


def _chain(column: ColumnLike, bands: Sequence[Band], values: Sequence) -> Column:
    x = as_column(column)
    chain = None
    for band, value in zip(bands, values):
        chain = (F if chain is None else chain).when(band.holds(x), F.lit(value))
    return chain


def band_label(column: ColumnLike, bands: Sequence[Band]) -> Column:
    """Label of the band that holds the value; a value in a gap, or NULL, gives NULL."""
    return _chain(column, bands, [b.label for b in bands])


def band_rank(column: ColumnLike, bands: Sequence[Band]) -> Column:
    return _chain(column, bands, list(range(1, len(bands) + 1)))


def labels(bands: Sequence[Band]) -> list:
    return [b.label for b in bands]


# Band edges and labels of the reports.
AGE_BANDS = [
    Band("0-1", 0, 1, closed=False),
    Band("1-4", 1, 5, closed=False),
    Band("5-10", 5, 10, closed=False),
    Band("11-15", 10, 16, closed=False),
    Band("16-45", 16, 46, closed=False),
    Band(">46", 46),
]

# Week 5 does not exist: days 23-30 count as week 4 and days 31-37 as week 6.
WEEK_BANDS = [
    Band(1, 1, 8),
    Band(2, 9, 15),
    Band(3, 16, 22),
    Band(4, 23, 30),
    Band(6, 31, 37),
    Band(7, 38, 44),
    Band(8, 45, 51),
    Band(9, 52, 58),
    Band(10, 59, 65),
]

DENSITY_BANDS = [
    Band("0", 0, 0),
    Band("1-99", 1, 99),
    Band("100-999", 100, 999),
    Band("1,000-9,999", 1000, 9999),
    Band("10,000-49,999", 10000, 49999),
    Band("50,000-99,999", 50000, 99999),
    Band("100,000-499,999", 100000, 499999),
    Band("500,000-499,999", 500000, 999999),
    Band("> 1,000,000", 1000000),
]

FOLLOW_UP_BANDS = [
    Band("<28", None, 28, closed=False),
    Band("28", 28, 28),
    Band(">28", 28, open_low=True),
]

# The published label of the eighth density band has a slip of the pen; this is the text it meant.
CORRECTED_DENSITY_LABEL = {"500,000-499,999": "500,000-999,999"}


def nominal_week(day: ColumnLike) -> Column:
    return band_label(day, WEEK_BANDS).cast("int")


def density_band(density: ColumnLike, corrected: bool = False) -> Column:
    label = band_label(density, DENSITY_BANDS)
    if not corrected:
        return label
    old, new = next(iter(CORRECTED_DENSITY_LABEL.items()))
    return F.when(label == old, F.lit(new)).otherwise(label)


def detection_status(density: ColumnLike) -> Column:
    x = as_column(density)
    return (
        F.when(x == 0, F.lit("0 ~ Negative"))
        .when(x > 0, F.lit("≥1 ~ Positive"))
        .when(x.isNull(), F.lit("No data/Not measured"))
    )

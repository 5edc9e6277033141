"""Every operator as a runnable query over the shared tables, next to its SQL twin.

``query`` registers a function from ``Tables`` to a DataFrame together with the SQL that
must give the same rows; ``None`` marks a query that SQL cannot express.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Tables:
    """Lazy access to the parquet tables of one folder: ``tables.orders``.

    The columns of a table are looked up once, as each look is a job.
    """

    spark: SparkSession
    folder: str
    schemas: dict[str, StructType] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[name]).parquet(path)


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Entry] = {}


def query(name: str, sql: str | None):
    def register(run):
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = Entry(run, sql)
        return run

    return register


def load() -> dict[str, Entry]:
    for part in ("columns", "filters", "joins", "counts", "crosstabs", "curves", "clinical", "files"):
        importlib.import_module(f"{__name__}.{part}")
    return CATALOGUE

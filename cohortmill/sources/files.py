"""Delimited, lookup and staged tables.

Text tables are read with every column as text under the names of their header; the
declared columns are then taken by name and cast, so a stray word in a number column becomes a
missing value and never a failed job. Quotes within quoted text are doubled, as other tools write
and read them; a backslash is an ordinary character.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from cohortmill.functions.missing import as_number
from cohortmill.functions.text import clean_names

ROW = "_row"
#: Where a line stands: its file, the start of its split, and its place in the order of reading.
LINE_PLACE = ("_metadata.file_path", "_metadata.file_block_start", "increasing")
MALFORMED, LOST, ROWS = "__malformed", "__lost", "__rows"


def _null_text(column: str, keep_empty: bool) -> Column:
    """Spark reads an empty field as NULL; the word NA is text to it until told otherwise."""
    text = F.coalesce(F.col(column), F.lit("")) if keep_empty else F.nullif(F.col(column), F.lit(""))
    return F.nullif(text, F.lit("NA"))


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str,
    encoding: str = "UTF-8",
    na_policy: str = "na_only",
    row_order: bool = False,
    multiline: bool = False,
    rejected: Observation | None = None,
) -> DataFrame:
    """Read the declared columns of CSV files with a header row, by name.

    Each path may have its own column order and further columns, which are ignored; a
    declared column that a header lacks is an error. The files of one path share a layout: one whose
    header differs from the first fails the read. ``multiline`` allows line breaks within
    quotes; a file is still read by several tasks, see ``csv_records``.

    ``na_policy``: "na_only" makes the word NA missing and keeps empty text as empty text;
    "na_and_empty" makes both missing. ``row_order`` adds ``_row``, which sorts rows as
    they stand in the files whatever the partitioning: file, start of the split, and the
    reading order within the split.

    ``rejected`` takes account, in the pass that reads the files anyway, of what was lost: rows, rows with another
    number of fields than the header, and per number column the text that is no number. ``coercion_report`` shows
    it after the first action on the table.
    """
    if na_policy not in ("na_only", "na_and_empty"):
        raise ValueError(f"unknown na_policy {na_policy!r}")
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    paths = [path] if isinstance(path, str) else list(path)
    columns = []
    for f in declared:
        name = f"`{f.name}`"
        if isinstance(f.dataType, NumericType):
            columns.append(as_number(name).cast(f.dataType).alias(f.name))
        else:
            columns.append(_null_text(name, na_policy == "na_only").cast(f.dataType).alias(f.name))
    if row_order:
        place = ("__file", "__split", "__line") if multiline else LINE_PLACE
        columns.append(F.struct(*[_place(p).alias(n) for p, n in zip(place, ("file", "block", "line"))]).alias(ROW))
    if rejected is not None:
        numbers = [f.name for f in declared if isinstance(f.dataType, NumericType)]
        columns.append(F.struct(F.col(MALFORMED).isNotNull().alias(MALFORMED), *[_is_lost(f"`{n}`").alias(n) for n in numbers]).alias(LOST))
    read = [_as_text(spark, p, declared, encoding, multiline, rejected is not None).select(*columns) for p in paths]
    out = reduce(DataFrame.unionByName, read)
    return out if rejected is None else _observed(out, rejected, [MALFORMED, *numbers])


def _is_lost(column: str) -> Column:
    text = F.nullif(F.nullif(F.trim(column), F.lit("")), F.lit("NA"))
    return text.isNotNull() & as_number(column).isNull()


def _observed(df: DataFrame, rejected: Observation, names: Sequence[str]) -> DataFrame:
    counts = [F.coalesce(F.count_if(F.col(LOST).getField(n)), F.lit(0)).alias(n) for n in names]
    return df.observe(rejected, F.count(F.lit(1)).alias(ROWS), *counts).drop(LOST)


def with_numbers(df: DataFrame, columns: Sequence[str], rejected: Observation | None = None) -> DataFrame:
    """Text columns as numbers; text that is no number becomes missing, and ``rejected`` counts it in the same pass."""
    numbers = {c: as_number(f"`{c}`") for c in columns}
    if rejected is None:
        return df.withColumns(numbers)
    told = df.withColumn(LOST, F.struct(*[_is_lost(f"`{c}`").alias(c) for c in columns]))
    return _observed(told.withColumns(numbers), rejected, columns)


def coercion_report(spark: SparkSession, rejected: Observation) -> DataFrame:
    """(field, n_rows, n_rejected) of an observed table, after an action on it; rows with a wrong number of fields are told under no field."""
    found = rejected.get
    rows = [(None if n == MALFORMED else n, found[ROWS], k) for n, k in found.items() if n != ROWS]
    return spark.createDataFrame(rows, "field string, n_rows long, n_rejected long")


def _as_text(
    spark: SparkSession, path: str, declared: StructType, encoding: str, multiline: bool, malformed: bool = False
) -> DataFrame:
    """The files of one path under the names of their header, every column as text."""
    options = {"header": True, "encoding": encoding, "emptyValue": "", "escape": '"', "multiLine": multiline}
    names = spark.read.options(**options).csv(path).columns
    missing = [f.name for f in declared if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header names {', '.join(names)}")
    as_text = StructType([StructField(n, StringType()) for n in [*names, *[MALFORMED] * malformed]])
    options["columnNameOfCorruptRecord"] = MALFORMED
    if not multiline:
        return spark.read.schema(as_text).options(**options, enforceSchema=False).csv(path)
    records = csv_records(spark, path, encoding)
    parsed = F.from_csv("__record", as_text.simpleString(), {k: str(v) for k, v in options.items() if k not in ("header", "encoding")})
    header = F.from_csv("__record", StructType(as_text.fields[: len(names)]).simpleString(), {"escape": '"', "multiLine": "true"})
    other = reduce(lambda a, b: a | b, [~header.getField(n).eqNullSafe(F.lit(n)) for n in names])
    fails = F.raise_error(F.concat(F.lit(f"a file of {path} has another header: "), "__record")).cast("boolean")
    kept = F.when(F.col("__first") & other, fails).otherwise(~F.col("__first"))
    rows = records.filter(kept & (F.col("__record") != ""))
    return rows.select(parsed.alias("__row"), "__file", "__split", "__line").select("__row.*", "__file", "__split", "__line")


def _place(name: str) -> Column:
    return F.monotonically_increasing_id() if name == "increasing" else F.col(name)


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The records of CSV files in which quoted text holds line breaks: (__record, __file, __split, __line, __first).

    Files are read line by line, in as many tasks as they have splits. A line break stands within quotes if an odd number of
    quotes comes before it in the file: quotes are counted per split, summed over the splits before, and then along the lines of the
    split. So each line knows whether a record begins with it, and which line began the record it goes on with; the lines of a
    record are then put together. Nothing larger than a split or a record meets in one task. ``__first`` marks the first record of a file.
    """
    file, block, line = LINE_PLACE
    raw = spark.read.option("lineSep", "\n").text(path)
    text = F.decode(F.col("value").cast("binary"), encoding)
    lines = raw.select(F.col(file).alias("__file"), F.col(block).alias("__split"), _place(line).alias("__line"), text.alias("__text"))
    # the place of a line must not be given anew when a later step reads the lines again
    lines = stage(lines.withColumn("__quotes", F.length("__text") - F.length(F.replace("__text", F.lit('"'), F.lit("")))))
    within, order = Window.partitionBy("__file", "__split"), [F.col("__line")]
    so_far = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    splits = Window.partitionBy("__file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = lines.groupBy("__file", "__split").agg(F.sum("__quotes").alias("n"))
    before = totals.select("__file", "__split", F.coalesce(F.sum("n").over(splits), zero).alias("__before"))
    opened = lines.join(before, ["__file", "__split"]).withColumn("__before", F.col("__before") + F.coalesce(F.sum("__quotes").over(so_far), zero))
    place = F.struct("__split", "__line")
    begins = opened.withColumn("__begin", F.when(F.col("__before") % 2 == 0, place))
    # the last beginning at or before the line, in its split or in one before
    last = begins.groupBy("__file", "__split").agg(F.max("__begin").alias("b"))
    earlier = last.select("__file", "__split", F.max("b").over(splits).alias("__earlier"))
    own = F.max("__begin").over(within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    known = begins.withColumn("__own", own).join(earlier, ["__file", "__split"]).withColumn("__at", F.coalesce("__own", "__earlier"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("__split", "__line", "__text"))), lambda x: x["__text"])
    records = known.groupBy("__file", "__at").agg(F.array_join(parts, "\n").alias("__record"))
    first = records.groupBy("__file").agg(F.min("__at").alias("__head"))
    met = records.join(first, "__file")
    return met.select(F.regexp_replace("__record", "\r$", "").alias("__record"), "__file", F.col("__at.__split").alias("__split"), F.col("__at.__line").alias("__line"), (F.col("__at") == F.col("__head")).alias("__first"))


def read_latin1(spark, path, schema, na_policy="na_and_empty", row_order=False) -> DataFrame:
    return read_table(spark, path, schema, "ISO-8859-1", na_policy, row_order)


def read_lookup(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A registry or code list, kept as CSV or Parquet, with clean names."""
    if path.rstrip("/").endswith(".parquet"):
        return clean_names(spark.read.parquet(path))
    return clean_names(read_table(spark, path, schema, na_policy="na_and_empty"))


def normalise_domain(df: DataFrame, code: str | None = None) -> DataFrame:
    """Lower-case a study domain, call its sequence number ``seq``, drop the domain column."""
    out = clean_names(df.drop("DOMAIN", "domain"), keep=(ROW,))
    return out.withColumnRenamed(f"{code.lower()}seq", "seq") if code else out


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's ``spark.checkpoint.dir``.

    A local session without that setting is given one folder, which goes when the program ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="cohortmill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage(df: DataFrame, path: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table as Parquet and read it back with its own types, which ends its lineage there.

    Empty text in a partition column would come back as missing, so it is refused.
    """
    spark = df.sparkSession
    for c in partition_by:
        if isinstance(df.schema[c].dataType, StringType):
            refused = F.raise_error(F.lit(f"partition column {c} has empty text")).cast("string")
            df = df.withColumn(c, F.when(F.col(c) == "", refused).otherwise(F.col(c)))
    target = path or f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.mode("errorifexists" if path is None else "overwrite").partitionBy(*partition_by).parquet(target)
    return spark.read.schema(df.schema).parquet(target).select(*[f"`{c}`" for c in df.columns])


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Write a table as CSV with a header; missing values become the word NA, quotes are doubled."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("encoding", encoding)
        .option("nullValue", "NA")
        .option("emptyValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Save a result table as Parquet or CSV."""
    if kind == "csv":
        write_csv(df, path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")

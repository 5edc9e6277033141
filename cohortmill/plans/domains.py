"""Study domains: long findings to one wide row per subject and time.

All frames use the lower-case names of ``sources.files.normalise_domain``. ``order`` is the
row order column; where two findings fall into one cell, the earlier row is shown.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.functions.missing import as_number, na_if
from cohortmill.functions.text import snake_name
from cohortmill.operators.dedup import first_per_key
from cohortmill.operators.joins import full_merge, left_join, natural_left_join, stacked_merge
from cohortmill.operators.tables import categories
from cohortmill.sources.files import ROW, stage

SUBJECT = ["studyid", "usubjid"]
KEYS = [*SUBJECT, "time"]

# Test codes of the parasite table and its timing variables, best first.
PARASITE_TESTS = ["PFALCIPA", "PFALCIPS", "PFALCIP", "PVIVAXA", "PVIVAXS", "PVIVAX"]
PARASITE_TIMING = ["mbhr", "mbdy", "mbstdy", "visitdy", "visitnum", "visit", "epoch", "mbevlint", "mbevintx"]

# Units of age, by how they begin, in parts of a year.
AGE_UNITS = {"YEAR": 1.0, "MONTH": 12.0, "WEEK": 365.25 / 7, "DAY": 365.25, "HOUR": 365.25 * 24, "MINUTE": 365.25 * 24 * 60, "DECADE": 0.1}


def timing(variables: Sequence[str]) -> tuple[Column, Column]:
    """First timing variable that is present, as text, and the name of that variable."""
    value = F.coalesce(*[F.col(v).cast("string") for v in variables])
    source = F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(v.upper())) for v in variables])
    return value, source


def _first_present(df: DataFrame, names: Sequence[str]) -> Column:
    known = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*known) if known else F.lit(None).cast("string")


def first_value_pivot(
    df: DataFrame,
    keys: Sequence[str],
    names_from: str,
    value: str,
    order: Column,
    names: Sequence[str] | None = None,
    extra: Sequence[Column] = (),
    other: str | None = None,
) -> DataFrame:
    """One column per name holding the first value in row order.

    The first value is a mergeable aggregate, so map tasks send one row per key. With ``names``, values under another
    name are listed as ``name=value`` in the column ``other``, in row order; without that column the query fails when it
    meets one. A key has few of them, as many as it has findings that nobody declared.
    """
    known = [n for n in categories(df, names_from) if n is not None] if names is None else list(names)
    cells = [F.min_by(value, F.when(F.col(names_from) == n, order)).alias(snake_name(str(n))) for n in known]
    if names is None:
        return df.groupBy(*keys).agg(*cells, *extra)
    stray = ~F.col(names_from).isin(known) & F.col(value).isNotNull()
    if other is None:
        met = F.max(F.when(stray, F.col(names_from)))
        message = F.concat(F.lit(f"{names_from.strip('_')} has a value without a column: "), met)
        out = df.groupBy(*keys).agg(*cells, *extra, F.when(met.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)).alias("__listed"))
        return out.filter("__listed").drop("__listed")
    entry = F.struct(order.alias("o"), F.concat_ws("=", names_from, value).alias("text"))
    found = F.sort_array(F.collect_list(F.when(stray, entry)))
    return df.groupBy(*keys).agg(*cells, *extra, F.nullif(F.array_join(F.transform(found, lambda x: x["text"]), "; "), F.lit("")).alias(other))


def prepare_domain(
    df: DataFrame,
    code: str,
    timing_variables: Sequence[str] = ("visitdy",),
    tests: Sequence[str] | None = None,
    order: str = ROW,
    by_method: bool = False,
    other: str | None = None,
) -> DataFrame:
    """Findings domain to one row per subject and time, one column per test and unit.

    The value is the standardised result, or the original where there is none. A test
    without unit ends in ``_na``. ``tests`` lists the ``CODE_unit`` names when known, which
    saves the job that finds them; any other name fails, or is gathered in the column ``other``.
    """
    dd = code.lower()
    value = _first_present(df, [f"{dd}stresn", f"{dd}stresc", f"{dd}orres"])
    unit = F.coalesce(_first_present(df, [f"{dd}stresu", f"{dd}orresu"]), F.lit("NA"))
    parts = [F.col(f"{dd}testcd"), unit]
    if by_method:
        parts.append(F.coalesce(F.col(f"{dd}method"), F.lit("NA")))
    time, source = timing(timing_variables)
    long = df.select(
        *SUBJECT,
        time.alias("time"),
        source.alias("time_source"),
        F.concat_ws("_", *parts).alias("__name"),
        value.alias("__value"),
        F.col(order).alias("__order"),
    )
    first_row = F.min("__order").alias(order)
    return first_value_pivot(long, [*KEYS, "time_source"], "__name", "__value", F.col("__order"), tests, [first_row], other)


def numeric_time(df: DataFrame) -> DataFrame:
    return df.withColumn("time", as_number("time"))


def units_per_year(unit: str) -> Column:
    """How many of the unit make a year; an age without unit is in years, and one in another unit has none."""
    text = F.coalesce(F.upper(F.trim(unit)), F.lit("YEARS"))
    return F.coalesce(*[F.when(text.startswith(name), F.lit(n)) for name, n in AGE_UNITS.items()])


def unknown_age_units(df: DataFrame) -> DataFrame:
    """Rows with an age whose unit is not listed, by unit: these ages are lost."""
    lost = df.filter(F.col("age").isNotNull() & units_per_year("ageu").isNull())
    return lost.groupBy("ageu").agg(F.count(F.lit(1)).alias("n"))


def prepare_demographics(df: DataFrame) -> DataFrame:
    """One row per subject: age in years, sex with U as missing, arm, country.

    An age in a unit that is not listed is missing, and ``unknown_age_units`` counts such rows.
    """
    return df.select(
        *SUBJECT,
        (F.col("age") / units_per_year("ageu")).alias("age_years"),
        na_if("sex", "U").alias("sex"),
        "arm",
        "country",
    )


def prepare_disposition(
    df: DataFrame, name: str = "disposition", prefer_decoded: bool = True, order: str = ROW
) -> DataFrame:
    """One disposition text per subject and time; the decoded term first, unless left out."""
    sources = (["dsdecod"] if prefer_decoded else []) + ["dsmodify", "dsterm"]
    time, source = timing(["visitdy"])
    rows = df.select(
        *SUBJECT, time.alias("time"), source.alias("time_source"), _first_present(df, sources).alias(name), order
    )
    return numeric_time(first_per_key(rows, KEYS, [F.col(order)]).drop(order))


def prepare_interventions(df: DataFrame, order: str = ROW) -> DataFrame:
    """First intervention per subject, day and class."""
    kept = [*SUBJECT, "intrt", "indecod", "inclas", "indosu", "visitdy", "visitnum"]
    firsts = first_per_key(df.select(*kept, order), [*SUBJECT, "visitdy", "inclas"], [F.col(order)])
    return firsts.withColumn("visitdy", F.col("visitdy").cast("double"))


def parasite_table(mb: DataFrame, tests: Sequence[str] = PARASITE_TESTS, names=None, order: str = ROW) -> DataFrame:
    """Parasite counts per subject and best available time, by test, unit and method."""
    kept = mb.filter(F.col("mbtestcd").isin(list(tests)))
    return prepare_domain(kept, "mb", PARASITE_TIMING, names, order, by_method=True)


def participant_table(dm: DataFrame, vs: DataFrame, tests=("WEIGHT_kg", "HEIGHT_cm", "TEMP_C"), order: str = ROW, other: str | None = "vital_signs_other") -> DataFrame:
    """Demographics with the first measurement of each vital sign.

    Signs or units that are not listed, such as a height in metres, are kept as text in ``other``; with None they fail.
    """
    unit = F.coalesce(_first_present(vs, ["vsstresu", "vsorresu"]), F.lit("NA"))
    long = vs.select(
        *SUBJECT,
        F.concat_ws("_", "vstestcd", unit).alias("__name"),
        _first_present(vs, ["vsstresn", "vsstresc", "vsorres"]).alias("__value"),
        F.col(order).alias("__order"),
    )
    signs = first_value_pivot(long, SUBJECT, "__name", "__value", F.col("__order"), list(tests), other=other)
    return left_join(prepare_demographics(dm), signs, SUBJECT)


def merge_subject_days(
    mb: DataFrame,
    dm: DataFrame,
    interventions: DataFrame,
    pf: DataFrame,
    rs: DataFrame,
    vs: DataFrame,
    disposition: DataFrame,
    order: str = ROW,
) -> DataFrame:
    """The prepared domains of a trial as one table per subject and day, see ``merge_days``."""
    return merge_days(mb, [pf, rs, vs], dm, interventions, disposition, order)


def merge_days(
    base: DataFrame,
    findings: Sequence[DataFrame],
    attributes: DataFrame | None = None,
    interventions: DataFrame | None = None,
    disposition: DataFrame | None = None,
    order: str = ROW,
) -> DataFrame:
    """Any number of prepared domains as one table per subject and day.

    Rows of ``base`` carry the attributes of their subject and its treatments on their day, findings of other
    domains join in full, and the disposition comes last. Rows that only a finding
    domain has keep no attributes, as they are filled from the subject later on. A subject has few rows for a day in any
    prepared domain, so all domains are stacked and grouped by day, in one shuffle.
    The row order columns come back as ``_order_0``, ``_order_1``, ..., for the base and each finding domain.
    """
    first = numeric_time(base if attributes is None else natural_left_join(base, attributes))
    frames, needs = [first.withColumnRenamed(order, "_order_0")], {}
    if interventions is not None:
        given = interventions.withColumnsRenamed({"visitdy": "time", order: "__given"})
        needs[len(frames)] = [0]
        frames.append(given)
    own = [0]
    for i, domain in enumerate(findings):
        own.append(len(frames))
        frames.append(domain.withColumnRenamed(order, f"_order_{i + 1}"))
    if disposition is not None:
        needs[len(frames)] = own
        frames.append(disposition.drop("time_source"))
    merged = stacked_merge(frames, KEYS, needs=needs)
    if interventions is None:
        return merged
    return merged.withColumn("_order_0", F.when(F.col("_order_0").isNotNull(), F.struct(F.col("_order_0").alias(order), "__given"))).drop("__given")


def merge_raw_domains(
    frames: Mapping[str, DataFrame], demographics: DataFrame, extra_keys: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """All raw domains in full on subject, sequence and visit, with attributes per subject.

    Raw domains can hold a key often, so each step can be split, and is written before the next one.
    ``extra_keys`` names, by domain, columns that its step compares as well, such as an indicator that the
    domains merged before bring along. Subjects known only from the demographics keep one row.
    """
    keys = [*SUBJECT, "seq", "visit", "visitnum", "visitdy", "epoch"]
    first, *rest = frames
    merged = full_merge([frames[first], demographics], SUBJECT)
    for domain in rest:
        merged = full_merge([stage(merged), frames[domain]], [*keys, *(extra_keys or {}).get(domain, ())])
    return merged

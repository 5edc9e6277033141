"""The pooled cohort: trial domains and observation tables brought to one shape.

Row order matters where the first row of a subject or of a subject-day decides. It is
carried in explicit columns (``_order_*``) through every merge and never taken from the
physical order of a partition.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.functions.bands import AGE_BANDS, band_label, band_rank, nominal_week
from cohortmill.functions.missing import as_number, if_else, paste, str_c
from cohortmill.functions.recode import lookup
from cohortmill.functions.text import contains
from cohortmill.operators.dedup import distinct_rows, first_per_key
from cohortmill.operators.joins import (
    fill_from_first_row,
    left_join,
    lookup_with_fallback,
    merge_first_rows,
)
from cohortmill.plans.domains import KEYS, SUBJECT
from cohortmill.plans.outcomes import adjudicate, outcome_class
from cohortmill.plans.regimens import (
    ACT_ARM_TEXTS,
    MAIN_ACTS,
    class_by_components,
    components,
    regimen_name,
    with_act_columns,
)
from cohortmill.sources.files import ROW

# Country codes of the trials, and the two origins.
COUNTRIES = {
    "AGO": "Angola",
    "BEN": "Benin",
    "BFA": "Burkina Faso",
    "CIV": "Côte d’Ivoire",
    "CMR": "Cameroon",
    "GAB": "Gabon",
    "KEN": "Kenya",
    "MOZ": "Mozambique",
    "NER": "Niger",
    "NGA": "Nigeria",
    "RWA": "Rwanda",
    "SEN": "Senegal",
    "UGA": "Uganda",
    "ZMB": "Zambia",
}
TRIALS = "SDTM"
OBSERVED = "MAPPER"
EXCLUDED_STUDIES = [(OBSERVED, "YYDSM")]

ASEXUAL = "pfalcipa_10_6_l"
SEXUAL = "pfalcips_10_6_l"
OBSERVATION_KEYS = ["pid", "sid", "site", "dayofobs", "hourofobs"]
OBSERVED_SUBJECT = ["sid", "pid"]

# One shape for both origins; ``intp`` is missing for the observation tables.
COHORT_TYPES = {
    "studyid": "string",
    "usubjid": "string",
    "country_name_2": "string",
    "time": "double",
    "age_years": "double",
    "sex": "string",
    "pfmicl": "double",
    "gfmicl": "double",
    "arm_2": "string",
    "weight_kg": "double",
    "height_cm": "double",
    "temp_c": "double",
    "origin": "string",
    "outcome": "string",
    "intp": "string",
}


def country_name(code: str) -> Column:
    return lookup(code, COUNTRIES)


def counted_at_baseline(time: str, density: str) -> Column:
    """False only for a baseline row (day 1) without a count."""
    return ~((F.col(time) == 1) & F.col(density).isNull())


def select_subjects(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """All rows of every subject with at least one row that meets the condition.

    A subject has few rows, so they are looked over together, in one read and one shuffle.
    """
    met = F.bool_or(F.coalesce(condition, F.lit(False))).over(Window.partitionBy(*keys))
    return df.withColumn("__met", met).filter("__met").drop("__met")


def select_act_subjects(days: DataFrame, arm: str = "arm", density: str = ASEXUAL) -> DataFrame:
    treated = contains(arm, *ACT_ARM_TEXTS, ignore_case=True)
    return select_subjects(days, SUBJECT, treated).filter(counted_at_baseline("time", density))


def _order_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_order_")]


def _to_cohort(df: DataFrame) -> DataFrame:
    """Number columns read as text become numbers, and the columns get their agreed type."""
    columns = []
    for name, kind in COHORT_TYPES.items():
        column = F.col(name) if name in df.columns else F.lit(None)
        columns.append((as_number(column) if kind == "double" else column.cast(kind)).alias(name))
    return df.select(*columns, *_order_columns(df))


def curate_trials(days: DataFrame, second_disposition: DataFrame) -> DataFrame:
    """Merged trial days to the cohort shape, with the outcome adjudicated.

    Arm and country of a subject are those of its first row, missing ones included. All steps look at a subject's rows
    together, so the merged days are read once and shuffled by subject once.
    """
    known = days.withColumn("country_name", country_name("country"))
    order = [F.col(c).asc_nulls_last() for c in _order_columns(known)]
    named = fill_from_first_row(known, SUBJECT, order, {"arm": "arm_2", "country_name": "country_name_2"}, few_rows=True)
    second = second_disposition.withColumnRenamed("disposition", "disposition_2").drop("time_source")
    merged = left_join(select_act_subjects(named), second, KEYS)
    return _to_cohort(
        adjudicate(merged)
        .withColumn("origin", F.lit(TRIALS))
        .withColumnsRenamed({ASEXUAL: "pfmicl", SEXUAL: "gfmicl", "intp_na": "intp"})
    )


def merge_observations(tables: Sequence[DataFrame], order: str = ROW) -> DataFrame:
    """Subject, clinical, parasite, PCR and treatment tables as one row per observation.

    The treatment table's own timing columns take the common names first. Of repeated
    observations the first is kept, and days before inclusion are removed.
    """
    aligned = [
        t.withColumnsRenamed({"dayoftreat": "dayofobs", "houroftreat": "hourofobs"}) for t in tables
    ]
    firsts = merge_first_rows(aligned, OBSERVATION_KEYS, order)
    # copies of these two that the other tables bring; columns of the tables themselves are never among them
    own = {c for t in aligned for c in t.columns} - {"id", "disease"}
    extra = [c for c in firsts.columns if re.fullmatch(r"(id|disease)(|(_y)+|(_x){2,})", c) and c not in own]
    return firsts.drop(*extra).withColumnsRenamed({"id_x": "id", "disease_x": "disease"}).filter(~(F.col("dayofobs") < 0))


def attach_outcome(observations: DataFrame, patients: DataFrame, columns: Sequence[str] = ("outcome",)) -> DataFrame:
    """Patient-level columns on the row of the patient's last day only; then day 0 becomes 1.

    The observations keep their own site; one that the patient set brings is called ``site_y``.
    """
    payload = patients.select(*OBSERVED_SUBJECT, "lastday", *columns)
    joined = left_join(observations, payload, [*OBSERVED_SUBJECT, ("dayofobs", "lastday")])
    if "site" in columns:
        joined = joined.withColumnRenamed("site_x", "site")
    return joined.withColumn("dayofobs", F.col("dayofobs") + 1)


def classify_observations(df: DataFrame) -> DataFrame:
    """Regimen, components and ACT class."""
    return (
        df.withColumn("treat_2", regimen_name("treat"))
        .withColumn("components", components("treat_2"))
        .withColumn("act_category", class_by_components("components"))
    )


def curate_observations(observations: DataFrame) -> DataFrame:
    """Classified observations to the cohort shape: ACT patients under five years.

    Arm, site and age of a patient are those of its first row.
    """
    chosen = select_subjects(observations, OBSERVED_SUBJECT, F.col("act_category") == "ACT")
    order = [F.col(c).asc_nulls_last() for c in _order_columns(chosen)]
    filled = fill_from_first_row(
        chosen,
        OBSERVED_SUBJECT,
        order,
        {"treat_2": "arm_2", "site": "country_name_2", "ageyears": "age_years"},
        few_rows=True,
    )
    return _to_cohort(
        filled.filter(F.col("age_years") < 5)
        .withColumn("origin", F.lit(OBSERVED))
        .withColumnsRenamed(
            {
                "sid": "studyid",
                "pid": "usubjid",
                "dayofobs": "time",
                "gender": "sex",
                "weight": "weight_kg",
                "height": "height_cm",
                "temp": "temp_c",
            }
        )
    )


def pool(trials: DataFrame, observed: DataFrame) -> DataFrame:
    """Both origins in one table, trials first; the first row per subject, country and day."""
    sides = []
    for i, side in enumerate((trials, observed)):
        names = {c: f"_order_{i}{c.removeprefix('_order')}" for c in _order_columns(side)}
        sides.append(side.withColumnsRenamed(names).withColumn("_order_side", F.lit(i)))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    ordered = ["_order_side"] + [c for c in _order_columns(both) if c != "_order_side"]
    keys = ["usubjid", "studyid", "country_name_2", "time"]
    return first_per_key(both, keys, [F.col(c).asc_nulls_last() for c in ordered])


def enrich(pooled: DataFrame) -> DataFrame:
    """Subject attributes, outcome class, age and week bands, and the named combination."""
    ordered = ["_order_side"] + [c for c in _order_columns(pooled) if c != "_order_side"]
    order = [F.col(c).asc_nulls_last() for c in ordered]
    known = fill_from_first_row(pooled, SUBJECT, order, {"age_years": "age", "sex": "gender"}, few_rows=True)
    banded = (
        known.drop(*ordered)
        .withColumn("code_p", paste("studyid", "usubjid"))
        .withColumn("outcome_2", outcome_class("outcome"))
        .withColumn("age_5", if_else(F.col("age") < 5, "< 5", "≥ 5"))
        .withColumn("age_group", band_label("age", AGE_BANDS))
        .withColumn("age_group_rank", band_rank("age", AGE_BANDS))
        .withColumn("week", nominal_week("time"))
    )
    return with_act_columns(banded)


def eligible(df: DataFrame) -> DataFrame:
    """Children under five with a baseline count, on one of the four main combinations."""
    rare = contains("act_name", "Chlorpheniramine", "Naphthoquine")
    out = df.filter(F.col("age").isNotNull() & counted_at_baseline("time", "pfmicl"))
    out = out.filter((F.col("age_years") < 5) & ~rare & F.col("act_name").isin(MAIN_ACTS))
    for origin, study in EXCLUDED_STUDIES:
        out = out.filter(~((F.col("origin") == origin) & (F.col("studyid") == study)))
    return out


def fill_country(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Country of the lookup, else the one known; several countries multiply the rows."""
    table = distinct_rows(
        countries.withColumnRenamed("country_name", "country_name_1"), *SUBJECT, "country_name_1"
    )
    return lookup_with_fallback(df, table, SUBJECT, "country_name_1", "country_name_2", "country_name")


def subject_code(study: str, subject: str) -> Column:
    """Readable subject code without separator; for output, as different subjects can share it."""
    return str_c(study, subject)


def final_cohort(trials: DataFrame, observed: DataFrame, countries: DataFrame) -> DataFrame:
    return fill_country(eligible(enrich(pool(trials, observed))), countries)


def selection_counts(steps: Mapping[str, DataFrame], subject: Sequence[str]) -> DataFrame:
    """Rows and subjects after every selection step, for checking that none got lost."""
    parts = [
        df.groupBy(*subject)
        .agg(F.count(F.lit(1)).alias("k"))
        .agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_subjects"))
        .select(F.lit(name).alias("step"), "n_rows", "n_subjects")
        for name, df in steps.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

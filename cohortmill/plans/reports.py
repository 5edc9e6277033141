"""Report tables over the final cohort, the observation tables and the patient set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.functions.bands import (
    DENSITY_BANDS,
    FOLLOW_UP_BANDS,
    band_label,
    band_rank,
    density_band,
    detection_status,
)
from cohortmill.functions.missing import as_number, if_else, na_if
from cohortmill.functions.text import squish, title_case
from cohortmill.operators.aggregates import mean_present, n_distinct, n_rows, sum_present
from cohortmill.operators.dedup import distinct_rows
from cohortmill.operators.distributions import box_summary, histogram
from cohortmill.operators.joins import anti_join, left_join, presence, semi_join, with_payload
from cohortmill.operators.quantiles import exact_median
from cohortmill.operators.summaries import (
    baseline_summary,
    missing_by_subject,
    share_within,
    study_characteristics,
    subjects_where,
)
from cohortmill.operators.survival import kaplan_meier, survival_input
from cohortmill.operators.tables import (
    column_percentages,
    count_table,
    layered_frequency,
    sorted_report,
    threshold_table,
    totals,
    totals_column,
    totals_row,
)
from cohortmill.plans.domains import SUBJECT
from cohortmill.plans.regimens import AL, AS_AQ, AS_MQ, DHA_PPQ, MAIN_ACTS, class_by_code, detailed_name
from cohortmill.sources.files import stage

# The outcomes shown as shares. "LFT" stands as published; it matches nothing,
# so the class LTF is left out of the shares unless a list is passed.
SHOWN_OUTCOMES = ["RECRUDESCENCE", "REINFECTION", "INDETERMINATE", "ACPR", "LFT", "OTHERS"]
HYPER_DENSITY = 250_000
HIGH_DENSITY = 100_000
BASELINE_DAY, DAY_28, DAY_42 = 1, 29, 43
BOX_DAYS = [1, 2, 3, 7, 14, 29, 43]


def analysis_table(data: DataFrame) -> DataFrame:
    """The final cohort with density bands, and blank outcomes as missing."""
    return (
        data.withColumn("parasitaemia_categories", density_band("pfmicl"))
        .withColumn("parasitaemia_rank", band_rank("pfmicl", DENSITY_BANDS))
        .withColumn("outcome_2", na_if(squish("outcome_2"), ""))
    )


def with_condition(data: DataFrame) -> DataFrame:
    """Every row with the outcome of its subject; several outcomes multiply the rows."""
    return left_join(data, subject_conditions(data), SUBJECT)


def subject_conditions(data: DataFrame) -> DataFrame:
    known = data.filter(F.col("outcome_2").isNotNull())
    return distinct_rows(known.withColumnRenamed("outcome_2", "condition"), *SUBJECT, "condition")


def density_by_arm(data: DataFrame, day: int, arms: Sequence[str] = MAIN_ACTS) -> DataFrame:
    """Subjects per density band and arm on one day, with totals row and column shares, for the arms named."""
    on_day = data.filter((F.col("time") == day) & F.col("pfmicl").isNotNull() & F.col("act_name").isin(list(arms)))
    rows = ["parasitaemia_categories", "parasitaemia_rank"]
    counts = count_table(on_day, rows, "act_name", n_distinct(*SUBJECT), arms)
    return column_percentages(counts, list(arms))


def subjects_by(
    df: DataFrame, row: str, column: str, subject: str = "usubjid", where: str = "both", values: Sequence | None = None,
    other: str | None = None,
) -> DataFrame:
    """Subjects per row and column category with totals, for looking a merge or a domain over."""
    return totals(count_table(df, [row], column, n_distinct(subject), values, fill=None, other=other), where)


def arms_by_age(data: DataFrame) -> DataFrame:
    """Subjects per combination and age condition, most subjects first."""
    table = data.groupBy("act_name", "age_5").agg(n_distinct(*SUBJECT).alias("participants"))
    return sorted_report(table, ["participants"], ["act_name", "age_5"])


def outcome_by_study(data: DataFrame, outcome: str = "outcome_2", where: str = "col") -> DataFrame:
    """Subjects per study and outcome, with totals, largest study first."""
    known = data.filter(F.col(outcome).isNotNull())
    counts = totals(count_table(known, ["studyid"], outcome, n_distinct("usubjid"), fill=None), "col")
    return _largest_first(counts, "Total", where)


def _largest_first(counts: DataFrame, by: str, where: str) -> DataFrame:
    """Studies by a column, largest first; a totals row, if asked for, stands last."""
    body = counts.withColumn("__last", F.lit(False))
    if where == "both":
        columns = [c for c in counts.columns if c != "studyid"]
        body = totals_row(body, columns).withColumn("__last", F.coalesce("__last", F.lit(True)))
    order = [F.col("__last"), F.col(f"`{by}`").desc_nulls_last(), F.col("studyid").asc_nulls_last()]
    return body.orderBy(*order).drop("__last")


def genotype_by_study(data: DataFrame, genotype: str = "intp", by: str = "RECRUDESCENCE") -> DataFrame:
    """Subjects per study and genotype, missing ones in their own column and zeros shown, with totals on both sides.

    The genotype to sort by has a column, of zeros where it does not occur.
    """
    counts = count_table(data, ["studyid"], genotype, n_distinct("usubjid"))
    if by not in counts.columns:
        counts = counts.withColumn(by, F.lit(0).cast("long"))
    return _largest_first(totals_column(counts), by, "both")


def outcome_shares(data: DataFrame, outcomes: Sequence[str] = SHOWN_OUTCOMES) -> DataFrame:
    shown = data.filter(F.col("outcome_2").isin(list(outcomes)))
    counts = shown.groupBy("studyid", "outcome_2").agg(n_distinct("usubjid").alias("n"))
    return share_within(counts, ["studyid"])


def baseline_median(data: DataFrame) -> DataFrame:
    return exact_median(data.filter(F.col("time") == BASELINE_DAY), "pfmicl", "median", ["act_name"])


def study_table(data: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    arm = F.col("act_name")
    return study_characteristics(
        data,
        "studyid",
        "usubjid",
        order,
        {"age": "age_years"},
        {
            "sex_F": F.col("sex") == "F",
            "sex_M": F.col("sex") == "M",
            "act_name_AL": arm == AL,
            "act_name_AS_AQ": arm == AS_AQ,
            "act_name_DHA_PPQ": arm == DHA_PPQ,
            "act_name_AS_MQ": arm == AS_MQ,
        },
        ["sex_F", "sex_M"],
    )


def baseline_table(data: DataFrame) -> DataFrame:
    """Median and quartiles, n and share at baseline per arm; the joined rows are written once."""
    rows = (
        with_condition(data)
        .filter(F.col("time") == BASELINE_DAY)
        .withColumn("condition", F.coalesce(title_case("condition"), F.lit("NPI")))
        .withColumn("parasitaemia", detection_status("pfmicl"))
        .withColumn("gender", F.coalesce(na_if("gender", ""), F.lit("No data")))
    )
    rows = stage(rows.select("act_name", "age", "pfmicl", "gender", "parasitaemia", "condition"))
    return baseline_summary(rows, "act_name", ["age", "pfmicl"], ["gender", "parasitaemia", "condition"])


def detection_by_genotype(data: DataFrame, day: int = DAY_28) -> DataFrame:
    """Genotype by detection on one day, one table per arm."""
    rows = data.filter(F.col("time") == day).withColumn("parasitaemia", detection_status("pfmicl"))
    return layered_frequency(rows, "intp", "parasitaemia", "act_name")


def density_histogram(data: DataFrame, facets: Sequence[str] = ("act_name", "intp"), bins: int = 30) -> DataFrame:
    rows = data.filter((F.col("time") == BASELINE_DAY) & F.col("pfmicl").isNotNull() & F.col("intp").isNotNull())
    return histogram(rows, "pfmicl", bins, facets, log10=True)


def high_density_boxes(data: DataFrame) -> DataFrame:
    rows = data.filter(F.col("time").isin(BOX_DAYS) & (F.col("pfmicl") > HIGH_DENSITY))
    return box_summary(rows.withColumn("time", F.col("time").cast("string")), "pfmicl", ["time", "act_name"])


def recurrence_curve(data: DataFrame, by: Sequence[str] = (), before: float = 50) -> DataFrame:
    rows = survival_input(data, SUBJECT, "time", "outcome_2", "RECRUDESCENCE", ["act_name"])
    return kaplan_meier(rows.filter(F.col("time") < before), "time", "event", by)


def final_extract(data: DataFrame) -> DataFrame:
    return data.filter(F.col("outcome_2").isNotNull()).select(
        *SUBJECT, "age_years", "sex", "time", "pfmicl", "origin", "outcome_2", "act_name"
    )


def recrudescence_by_study(
    observations: DataFrame, study: str = "sid", patient: str = "pid", result: str = "pcr", code: str = "RC",
    show: int | None = None,
) -> DataFrame:
    """Patients and recrudescences per study, most recrudescences first."""
    failure = if_else(F.col(result) == code, 1, 0)
    table = observations.groupBy(study).agg(
        n_distinct(patient).alias("n"), sum_present(failure).alias("failure")
    )
    return sorted_report(table, ["failure"], [study], show)


def recrudescence_in_patient_set(patients: DataFrame, code: str = "LTFRC") -> DataFrame:
    """Rows and recrudescences per study among children under five of the patient set."""
    failure = if_else(F.col("outcome") == code, 1, 0)
    young = patients.filter(F.col("ageyears") < 5)
    table = young.groupBy("sid").agg(n_rows().alias("n"), sum_present(failure).alias("failure"))
    return sorted_report(table, ["failure"], ["sid"])


def recrudescence_by_age(observations: DataFrame) -> DataFrame:
    """Recrudescences under five and above. The published labels stood the wrong way round."""
    rows = observations.withColumn("age_5", if_else(as_number("ageyears") < 5, "<5", "5 and >"))
    failure = if_else(F.col("pcr") == "RC", 1, 0)
    return sorted_report(rows.groupBy("age_5").agg(sum_present(failure).alias("failures")), ["failures"], ["age_5"])


def quality_profile(observations: DataFrame) -> dict[str, DataFrame]:
    """Last follow-up days, missing values per patient, and patients seen long or young enough.

    The observations are read by every part, so they are written once.
    """
    observations = stage(observations)
    baseline = observations.filter(F.col("dayofobs") == 0)
    return {
        "last_days": observations.groupBy(as_number("lastdayfup").alias("lastdayfup")).agg(n_rows().alias("n")),
        "missing_last_day": missing_by_subject(observations, ["pid"], "lastdayfup"),
        "missing_baseline": missing_by_subject(baseline, ["pid"], "pfmicl", numeric=True),
        "followed_28": subjects_where(observations, ["pid"], F.col("dayofobs") > 27),
        "under_five": subjects_where(observations, ["pid"], as_number("ageyears") < 5),
    }


def mean_density_by_day(observations: DataFrame) -> DataFrame:
    return observations.groupBy("dayofobs").agg(mean_present(as_number("pfmicl")).alias("mean_pfmicl"))


def in_registry(
    df: DataFrame, registry: DataFrame, payload: str, study: str = "sid", also: Sequence[str] = ()
) -> DataFrame:
    """Rows of studies whose registry entry has the payload, with it and the columns of ``also``. A study may be listed once."""
    return with_payload(df, registry.select("sid", payload, *also), [(study, "sid")], payload, expect="m:1")


def patients_by_publication(patients: DataFrame, registry: DataFrame, payload: str = "sid_inv") -> DataFrame:
    """Patients per registered study and publication, largest first; studies without one are listed too."""
    known = in_registry(patients, registry, payload, also=["pubmed"])
    return sorted_report(known.groupBy("sid", "pubmed").agg(n_rows().alias("n")), ["n"], ["sid"])


def in_format(df: DataFrame, registry: DataFrame, data_format: str) -> DataFrame:
    return semi_join(df, registry.filter(F.col("data_format") == data_format), ["sid"])


def study_coverage(registry: DataFrame, patients: DataFrame, trials: DataFrame) -> DataFrame:
    """Which of the three sources knows a study."""
    frames = {
        "in_registry": registry.select("sid"),
        "in_patient_set": patients.select("sid"),
        "in_trials": trials.select(F.col("studyid").alias("sid")),
    }
    return presence(frames, ["sid"])


def studies_not_in(left: DataFrame, right: DataFrame, on=("sid",)) -> DataFrame:
    pair = [k if isinstance(k, str) else k[0] for k in on]
    return distinct_rows(anti_join(left, right, list(on)), *pair)


def registry_without_source(registry: DataFrame, patients: DataFrame, trials: DataFrame) -> DataFrame:
    """Registered studies that neither the patient set nor the trials hold."""
    return studies_not_in(anti_join(registry, patients, ["sid"]), trials.select(F.col("studyid").alias("sid")))


def describe_patients(patients: DataFrame) -> DataFrame:
    """Detailed regimen, ACT class by code, age and follow-up classes, numeric density."""
    return (
        patients.withColumn("treat_2", detailed_name("treat"))
        .withColumn("act_category", class_by_code("treat"))
        .withColumn("age_5", if_else(F.col("ageyears") < 5, "<5y", "5y >"))
        .withColumn("day_28", band_label("lastday", FOLLOW_UP_BANDS))
        .withColumn("day_28_rank", band_rank("lastday", FOLLOW_UP_BANDS))
        .withColumn("pfmicl0", as_number("pfmicl0"))
    )


def eligible_patients(described: DataFrame, above: float | None = None) -> DataFrame:
    """Under five, last seen on day 28, on an ACT; optionally above a density."""
    out = described.filter(
        (F.col("age_5") == "<5y") & (F.col("day_28") == "28") & (F.col("act_category") == "ACT")
    )
    return out if above is None else out.filter(F.col("pfmicl0") > above)


def above_density(described: DataFrame, limit: float = HIGH_DENSITY) -> DataFrame:
    return threshold_table(described, "pfmicl0", limit)

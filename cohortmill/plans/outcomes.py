"""Treatment outcome: adjudication from several findings, and analysis classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.functions.missing import ColumnLike
from cohortmill.functions.recode import Rule, first_match, first_match_name, invert_groups, lookup_or_keep
from cohortmill.functions.text import contains

# Reported outcomes gathered into one analysis class.
OUTCOME_CLASSES = {
    "LTF": ["LTFNoPcr", "ELTF"],
    "RECRUDESCENCE": ["LTFRC"],
    "REINFECTION": ["LTFRI"],
    "LOST TO FOLLOW-UP": ["MissedD28", "MissedD42", "MissedD63"],
    "Non-PF-BASELINE": ["NoParaAtInc", "NoPfAtInc"],
    "OTHERS": ["LowHb", "LowHt", "BSGap", "NonPfMonoInf", "UNKNOWN"],
}

# Phrases looked for in findings and dispositions.
EARLY = "EARLY TREATMENT FAILURE"
LATE_CLINICAL = "LATE CLINICAL FAILURE"
LATE_PARASITE = "LATE PARASITOLOGICAL FAILURE"
LATE_TREATMENT = "LATE TREATMENT FAILURE"
ADEQUATE = "ADEQUATE PARASITOLOGICAL AND CLINICAL RESPONSE"


def adjudication_rules(pcr: Column, who: Column, disposition: Column, second: Column, arm: Column) -> list[Rule]:
    """Which finding decides, in order.

    ``pcr`` is the genotyping result, ``who`` the protocol classification, ``second`` the
    decoded disposition. Three published rules are left out because an earlier one always
    decides first: clinical failure under a late disposition and late clinical failure with
    a genotype (both covered by "late, genotyped"), and the bare code ETF ("early").
    A rule may name a value that is missing; it still decides.
    """
    genotyped = pcr.isNotNull()
    return [
        Rule("late, genotyped", genotyped & contains(disposition, "LATE"), pcr),
        Rule(
            "late parasitological twice",
            contains(disposition, "LATE PARASITOLOGICAL") & contains(who, "LATE PARASITOLOGICAL"),
            who,
        ),
        Rule("adequate twice", (who == "ACPR") & (disposition == "ACPR"), "ACPR"),
        Rule("adequate in words", contains(disposition, ADEQUATE), "ACPR"),
        Rule("early", contains(disposition, "EARLY TREATMENT", "ETF"), who),
        Rule("late by classification", contains(who, LATE_TREATMENT), pcr),
        Rule("adverse event", contains(disposition, "ADVERSE"), second),
        Rule("other antimalarial", contains(disposition, "ANTI-MALARIAL"), second),
        Rule("excluded", contains(disposition, "EXCLUDED"), second),
        Rule(
            "late clinical, no genotype",
            ~genotyped & arm.isNotNull() & contains(disposition, LATE_CLINICAL),
            "INDETERMINATE",
        ),
        Rule("completed", (disposition == "COMPLETED") & (who == "ACPR"), who),
        Rule("code LCF", disposition == "LCF", pcr),
        Rule("code LPF", disposition == "LPF", pcr),
        Rule("lost", contains(disposition, "LOST TO FOLLOW", "LOST TO F/UP", "LOSS"), second),
        Rule("late parasitological, no genotype", ~genotyped & contains(who, LATE_PARASITE), "LTF"),
    ]


def correction_rules(outcome: Column, pcr: Column) -> list[Rule]:
    """Spellings left over after adjudication; no corrected value meets a later rule."""
    genotyped = pcr.isNotNull()
    return [
        Rule("withdrawn", contains(outcome, "WITHDRAW", "WITHDRE"), "WITHDRAWAL"),
        Rule("late parasitological", contains(outcome, LATE_PARASITE) & ~genotyped, "LTF"),
        Rule("early", contains(outcome, EARLY) & ~genotyped, "ELTF"),
        Rule("late", contains(outcome, LATE_TREATMENT) & ~genotyped, "LTF"),
        Rule("late, genotyped", contains(outcome, LATE_TREATMENT) & genotyped, pcr),
    ]


def adjudicate(
    df: DataFrame,
    pcr: str = "intp_na",
    who: str = "whomal01_na",
    disposition: str = "disposition",
    second: str = "disposition_2",
    arm: str = "arm_2",
    explain: bool = False,
) -> DataFrame:
    """Add ``outcome``; with ``explain`` also the names of the rules that decided."""
    rules = adjudication_rules(*[F.col(c) for c in (pcr, who, disposition, second, arm)])
    out = df.withColumn("outcome", first_match(rules, default=F.col(disposition)))
    corrections = correction_rules(F.col("outcome"), F.col(pcr))
    if explain:
        out = out.withColumn("outcome_rule", first_match_name(rules))
        out = out.withColumn("outcome_correction", first_match_name(corrections, "none"))
    return out.withColumn("outcome", first_match(corrections, default=F.col("outcome")))


def outcome_class(outcome: ColumnLike) -> Column:
    return lookup_or_keep(outcome, invert_groups(OUTCOME_CLASSES))

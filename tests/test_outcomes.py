"""One row per reachable branch of the adjudication, and the analysis classes."""

import pytest

from cohortmill.plans.outcomes import adjudicate, outcome_class

SCHEMA = "intp_na string, whomal01_na string, disposition string, disposition_2 string, arm_2 string"
R, LPF, LTF, LCF = "RECRUDESCENCE", "LATE PARASITOLOGICAL FAILURE", "LATE TREATMENT FAILURE", "LATE CLINICAL FAILURE"

CASES = [
    ((R, None, LCF, None, "AL"), "late, genotyped", "none", R),
    ((R, None, LTF, None, "AL"), "late, genotyped", "none", R),
    ((None, LPF, LPF, None, "AL"), "late parasitological twice", "late parasitological", "LTF"),
    ((None, "ACPR", "ACPR", None, "AL"), "adequate twice", "none", "ACPR"),
    ((None, None, "ADEQUATE PARASITOLOGICAL AND CLINICAL RESPONSE", None, None), "adequate in words", "none", "ACPR"),
    ((None, "EARLY TREATMENT FAILURE", "ETF", None, "AL"), "early", "early", "ELTF"),
    ((R, "EARLY TREATMENT FAILURE", "ETF", None, "AL"), "early", "none", "EARLY TREATMENT FAILURE"),
    ((None, None, "EARLY TREATMENT FAILURE", None, "AL"), "early", "none", None),
    ((R, LTF, "COMPLETED", None, "AL"), "late by classification", "none", R),
    ((None, LTF, "COMPLETED", None, "AL"), "late by classification", "none", None),
    ((None, None, "ADVERSE EVENT", "WITHDRAWAL BY SUBJECT", "AL"), "adverse event", "withdrawn", "WITHDRAWAL"),
    ((None, None, "OTHER ANTI-MALARIAL", "D2", "AL"), "other antimalarial", "none", "D2"),
    ((None, None, "EXCLUDED", None, "AL"), "excluded", "none", None),
    ((None, None, LCF, None, "AL"), "late clinical, no genotype", "none", "INDETERMINATE"),
    ((None, None, LCF + " - DAY 28", None, "AL"), "late clinical, no genotype", "none", "INDETERMINATE"),
    ((None, None, LCF, None, None), "default", "none", LCF),
    ((None, "ACPR", "COMPLETED", None, "AL"), "completed", "none", "ACPR"),
    ((R, None, "LCF", None, "AL"), "code LCF", "none", R),
    ((None, None, "LCF", None, "AL"), "code LCF", "none", None),
    ((R, None, "LPF", None, "AL"), "code LPF", "none", R),
    ((None, None, "LOST TO FOLLOW-UP", "MissedD28", "AL"), "lost", "none", "MissedD28"),
    ((None, None, "LOST TO F/UP", "D2", "AL"), "lost", "none", "D2"),
    ((None, LPF, None, None, "AL"), "late parasitological, no genotype", "none", "LTF"),
    ((None, None, "WITHDREW CONSENT", None, "AL"), "default", "withdrawn", "WITHDRAWAL"),
    ((None, None, LPF, None, "AL"), "default", "late parasitological", "LTF"),
    ((None, None, LTF, None, "AL"), "default", "late", "LTF"),
    ((R, "EARLY", "X", "D2", "AL"), "default", "none", "X"),
    ((R, LTF, "ADVERSE", LTF, "AL"), "late by classification", "none", R),
    ((R, None, "ADVERSE", LTF, "AL"), "adverse event", "late, genotyped", R),
    ((None, None, None, None, None), "default", "none", None),
]


@pytest.fixture(scope="module")
def decided(spark):
    df = spark.createDataFrame([(i, *case[0]) for i, case in enumerate(CASES)], "i int, " + SCHEMA)
    return {r["i"]: r for r in adjudicate(df, explain=True).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_branch(decided, i):
    _, rule, correction, outcome = CASES[i]
    row = decided[i]
    assert (row["outcome_rule"], row["outcome_correction"], row["outcome"]) == (rule, correction, outcome)


def test_every_rule_is_reached(decided):
    assert len({r["outcome_rule"] for r in decided.values()}) == 16


@pytest.mark.parametrize(
    "outcome, group",
    [
        ("LTFNoPcr", "LTF"), ("ELTF", "LTF"), ("LTFRC", "RECRUDESCENCE"), ("LTFRI", "REINFECTION"), ("MissedD63", "LOST TO FOLLOW-UP"),
        ("NoPfAtInc", "Non-PF-BASELINE"), ("BSGap", "OTHERS"), ("UNKNOWN", "OTHERS"), ("ACPR", "ACPR"), (None, None),
    ],
)
def test_outcome_class(frame, outcome, group):
    assert frame("o string", (outcome,)).select(outcome_class("o").alias("v")).first()["v"] == group

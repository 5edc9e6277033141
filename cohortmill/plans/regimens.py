"""Treatment codes and arm texts to regimen names and classes.

Two published classifications disagree and both are kept: by components, artesunate with
sulfadoxine-pyrimethamine is no ACT and artesunate alone is Non-ACT; by code list, the
former is an ACT and the latter Unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.functions.missing import ColumnLike, as_column, is_in
from cohortmill.functions.recode import (
    Rule,
    all_missing,
    any_in,
    array_lookup,
    first_match,
    invert_groups,
    lookup,
    lookup_or_keep,
)
from cohortmill.functions.text import contains, normalise_label

# Treatment codes of one regimen, whatever the dose or formulation.
REGIMEN_CODES = {
    "Artemether–Lumefantrine": [
        "AL", "AL3", "AL_6", "AL_supervised", "AL_adult", "AL_4_child", "AL_4_adult", "AL_child", "AL_unsupervised",
    ],
    "Artemether–Lumefantrine + Primaquine": ["AL_PQ", "AL3+PQh0"],
    "Artesunate": ["AS"],
    "Amodiaquine": ["AQ"],
    "Artesunate + Amodiaquine": [
        "AS+AQ", "ASAQ", "AS+AQ-FDC", "AS+AQ(1)FDC", "AS+AQ(2)FDC", "AS+AQ(1)-FDC", "AS+AQ(2)-FDC", "AS+AQ-nFDC",
        "AS3+AQ-FDC", "AS3+AQ-nFDC",
    ],
    "Artesunate + Sulfadoxine–Pyrimethamine": ["AS+SP", "AS3+SP"],
    "Artesunate + Sulfamethoxypyrazine–Pyrimethamine": ["AS+SMP"],
    "Artesunate + Mefloquine": ["ASMQ", "ASMQ_adult", "ASMQ_child"],
    "Amodiaquine + Sulfadoxine–Pyrimethamine": ["AQ+SP"],
    "Chloroquine": ["CQ", "CQ_double_dose", "CQ - double dose"],
    "Artemisinin + Naphthoquine": ["ART+NQ"],
    "Dihydroartemisinin–Piperaquine": [
        "DHA-PPQ", "DHA+PQP", "DHA+PQPa", "DHA+PQPb", "DHAPPQ", "DHAPQP", "DHAPQPa", "DHAPPQb", "DP",
    ],
    "Sulfadoxine–Pyrimethamine": ["SP"],
}

# Components of each regimen.
COMPONENTS = {
    "Artemether–Lumefantrine": ["artemether", "lumefantrine"],
    "Artemether–Lumefantrine + Primaquine": ["artemether", "lumefantrine", "primaquine"],
    "Artesunate": ["artesunate"],
    "Amodiaquine": ["amodiaquine"],
    "Artesunate + Amodiaquine": ["artesunate", "amodiaquine"],
    "Artesunate + Sulfadoxine–Pyrimethamine": ["artesunate", "sulfadoxine", "pyrimethamine"],
    "Artesunate + Sulfamethoxypyrazine–Pyrimethamine": ["artesunate", "sulfamethoxypyrazine", "pyrimethamine"],
    "Artesunate + Mefloquine": ["artesunate", "mefloquine"],
    "Amodiaquine + Sulfadoxine–Pyrimethamine": ["amodiaquine", "sulfadoxine", "pyrimethamine"],
    "Chloroquine": ["chloroquine"],
    "Artemisinin + Naphthoquine": ["artemisinin", "naphthoquine"],
    "Dihydroartemisinin–Piperaquine": ["dihydroartemisinin", "piperaquine"],
    "Sulfadoxine–Pyrimethamine": ["sulfadoxine", "pyrimethamine"],
}
# The drugs that make a combination an ACT.
CORE_DRUGS = ["artemether", "artesunate", "dihydroartemisinin", "artemisinin"]
PARTNER_DRUGS = ["lumefantrine", "amodiaquine", "piperaquine", "mefloquine", "naphthoquine"]

# One name per treatment code, dose and formulation kept.
DETAILED_NAMES = {
    "AL": "Artemether–Lumefantrine",
    "AL_adult": "Artemether–Lumefantrine (adult dose)",
    "AL_child": "Artemether–Lumefantrine (child dose)",
    "AL_PQ": "Artemether–Lumefantrine + Primaquine",
    "AL_unsupervised": "Artemether–Lumefantrine (unsupervised)",
    "AS": "Artesunate",
    "AS+AQ": "Artesunate + Amodiaquine",
    "AS+AQ-FDC": "Artesunate–Amodiaquine (fixed-dose combination)",
    "AS+AQ(1)FDC": "Artesunate–Amodiaquine FDC (formulation 1)",
    "AS+AQ(2)FDC": "Artesunate–Amodiaquine FDC (formulation 2)",
    "AS+SP": "Artesunate + Sulfadoxine–Pyrimethamine",
    "AS3+AQ-FDC": "Artesunate–Amodiaquine (3-day FDC)",
    "AS3+SP": "Artesunate + Sulfadoxine–Pyrimethamine (3-day)",
    "ASAQ": "Artesunate + Amodiaquine (alternate code)",
    "ASMQ": "Artesunate + Mefloquine",
    "ASMQ_adult": "Artesunate + Mefloquine (adult dose)",
    "ASMQ_child": "Artesunate + Mefloquine (child dose)",
    "AQ+SP": "Amodiaquine + Sulfadoxine–Pyrimethamine",
    "CQ": "Chloroquine",
    "CQ_double_dose": "Chloroquine (double dose)",
    "ART+NQ": "Artemisinin + Naphthoquine",
    "DHA-PPQ": "Dihydroartemisinin–Piperaquine",
    "DHAPQP": "Dihydroartemisinin–Piperaquine (variant)",
    "DHAPQPa": "Dihydroartemisinin–Piperaquine (formulation a)",
    "DHAPPQb": "Dihydroartemisinin–Piperaquine (formulation b)",
    "DP": "Dihydroartemisinin–Piperaquine (DP)",
    "SP": "Sulfadoxine–Pyrimethamine",
}
UNCLASSIFIED = "Other / Unclassified"

# Classes of the codes, as published. A code in neither list is unknown.
ACT_CODES = [
    "AL", "AL_adult", "AL_child", "AL_PQ", "AL_unsupervised",
    "AS+AQ", "AS+AQ-FDC", "AS+AQ(1)FDC", "AS+AQ(2)FDC",
    "AS+SP", "AS3+AQ-FDC", "AS3+SP", "ASAQ",
    "ASMQ", "ASMQ_adult", "ASMQ_child",
    "ART+NQ", "DHA-PPQ", "DHAPQP", "DHAPQPa", "DHAPPQb", "DP",
]
NON_ACT_CODES = ["CQ", "CQ_double_dose", "SP", "AQ+SP"]

# Arm texts of the combinations looked for, any letter case.
ACT_ARM_TEXTS = [
    "ARTEMETHER LUMEFANTRINE",
    "AMODIAQUINE ARTESUNATE",
    "ARTHEMETER LUMEFANTRINE",
    "ARTHEMETHER",
    "ARTESUNATE AMODIAQUINE",
    "DIHYDROARTEMISININ PIPERAQUINE",
    "DIHYDROARTEMISININ-PIPERAQUINE",
    "ARTENIMOL PIPERAQUINE",
    "Artemether-Lumefantrine",
    "Artesunate-Amodiaquine",
    "Dihydroartemisinin-Piperaquine",
]

# Names and short codes of the combinations told apart by arm text.
AL = "Artemether–Lumefantrine (AL)"
AL_PQ = "Artemether–Lumefantrine + Primaquine (AL+PQ)"
AS_AQ = "Artesunate–Amodiaquine (AS–AQ)"
AS_AQ_CP = "Artesunate–Amodiaquine + Chlorpheniramine (AS–AQ+CP)"
DHA_PPQ = "Dihydroartemisinin–Piperaquine (DHA–PPQ)"
AS_MQ = "Artesunate–Mefloquine (AS–MQ)"
ART_NQ = "Artemisinin + Naphthoquine (ART+NQ)"
SHORT_CODES = {
    AL: "AL",
    AL_PQ: "AL+PQ",
    AS_AQ: "AS-AQ",
    AS_AQ_CP: "AS-AQ+CP",
    DHA_PPQ: "DHA-PPQ",
    AS_MQ: "AS-MQ",
    ART_NQ: "ART+NQ",
}
MAIN_ACTS = [AL, AS_AQ, DHA_PPQ, AS_MQ]

# Patterns on normalised arm text. Either word order occurs for AS-AQ.
AL_TEXT = r"ARTEMETHER\s*-?\s*LUMEFANTRINE"
AL_MISSPELT = r"ARTHEMETHER\s*-?\s*LUMEFANTRINE"
AS_AQ_TEXT = r"ARTESUNATE\s*-?\s*AMODIAQUINE"
AQ_AS_TEXT = r"AMODIAQUINE\s+ARTESUNATE"
DHA_PPQ_TEXT = r"DIHYDROARTEMISININ\s*-?\s*PIPERAQUINE"
ARTENIMOL_TEXT = "ARTENIMOL PIPERAQUINE"
AS_MQ_TEXT = r"ARTESUNATE\s*-?\s*MEFLOQUINE"
ART_NQ_TEXT = r"ARTEMISININ\s*\+\s*NAPHTHOQUINE"


def regimen_name(code: ColumnLike) -> Column:
    """Regimen without dose or formulation; an unknown code stays as it is, NA is missing."""
    known = F.nullif(as_column(code), F.lit("NA"))
    return lookup_or_keep(known, invert_groups(REGIMEN_CODES))


def detailed_name(code: ColumnLike) -> Column:
    """Regimen with dose and formulation. The word NA is missing; no code is unclassified."""
    named = lookup(code, DETAILED_NAMES, default=UNCLASSIFIED)
    return F.when(~F.coalesce(as_column(code) == "NA", F.lit(False)), named)


def components(regimen: ColumnLike) -> Column:
    return array_lookup(regimen, COMPONENTS)


def class_by_components(parts: ColumnLike) -> Column:
    return first_match(
        [
            Rule("no component", all_missing(parts), "Unknown"),
            Rule("core and partner", any_in(parts, CORE_DRUGS) & any_in(parts, PARTNER_DRUGS), "ACT"),
        ],
        default="Non-ACT",
    )


def class_by_code(code: ColumnLike) -> Column:
    return first_match(
        [Rule("act", is_in(code, ACT_CODES), "ACT"), Rule("other", is_in(code, NON_ACT_CODES), "Non-ACT")],
        default="Unknown",
    )


def act_rules(arm: Column) -> list[Rule]:
    """Combination by normalised arm text; the special cases stand before their plain form."""
    as_aq = contains(arm, AS_AQ_TEXT, AQ_AS_TEXT)
    return [
        Rule("exact AS-AQ", arm == "ARTESUNATE + AMODIAQUINE", AS_AQ),
        Rule("exact AS-MQ", arm == "ARTESUNATE + MEFLOQUINE", AS_MQ),
        Rule("AL with primaquine", contains(arm, AL_TEXT) & contains(arm, "PRIMAQUINE"), AL_PQ),
        Rule("AL", contains(arm, AL_TEXT, AL_MISSPELT), AL),
        Rule("AS-AQ with chlorpheniramine", as_aq & contains(arm, "CHLORPHENIRAMINE"), AS_AQ_CP),
        Rule("AS-AQ", as_aq, AS_AQ),
        Rule("DHA-PPQ", contains(arm, DHA_PPQ_TEXT, ARTENIMOL_TEXT), DHA_PPQ),
        Rule("AS-MQ", contains(arm, AS_MQ_TEXT), AS_MQ),
        Rule("ART-NQ", contains(arm, ART_NQ_TEXT), ART_NQ),
    ]


def act_name(arm_norm: ColumnLike) -> Column:
    return first_match(act_rules(as_column(arm_norm)))


def act_category(name: ColumnLike) -> Column:
    """Every name known here is an ACT, so a missing name decides alone."""
    x = as_column(name)
    return F.when(x.isNull(), "Non-ACT / Unknown").when(x.isin(list(SHORT_CODES)), "ACT").otherwise("Other")


def act_code(name: ColumnLike) -> Column:
    return lookup(name, SHORT_CODES)


def with_act_columns(df: DataFrame, arm: str = "arm_2") -> DataFrame:
    """Add normalised arm text, combination name, category and short code."""
    return (
        df.withColumn("arm_norm", normalise_label(arm))
        .withColumn("act_name", act_name("arm_norm"))
        .withColumn("act_category", act_category("act_name"))
        .withColumn("act_code", act_code("act_name"))
    )

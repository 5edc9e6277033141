"""Text cleaning, ladders, lookups, bands, regimens, arms."""

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import bands as B
from cohortmill.functions import recode as R
from cohortmill.functions import text as T
from cohortmill.plans import regimens as G
from cohortmill.plans.cohort import country_name


def one(frame, text, column):
    return frame("x string", (text,)).select(column.alias("v")).first()["v"]


def test_squish_takes_unicode_spaces(frame):
    assert one(frame, "  a  \t b ", T.squish("x")) == "a b"


def test_dashes_become_hyphens(frame):
    assert one(frame, "a–b—c−d‐e‑f‒g", T.plain_dashes("x")) == "a-b-c-d-e-f-g"


@pytest.mark.parametrize(
    "text, title",
    [("LOST TO FOLLOW-UP", "Lost To Follow-Up"), ("PATIENT'S visit", "Patient's Visit"), ("3rd DAY", "3rd Day"), ("", ""), (None, None)],
)
def test_title_case(frame, text, title):
    assert one(frame, text, T.title_case("x")) == title


@pytest.mark.parametrize(
    "name, clean",
    [
        ("STUDYID", "studyid"), ("PFALCIPA_10^6/L", "pfalcipa_10_6_l"), ("INTP_NA", "intp_na"), ("WEIGHT_kg", "weight_kg"),
        ("ageYears", "age_years"), ("FlgDV1", "flg_dv1"), ("Total %", "total_percent"), ("2nd", "x2nd"), ("site.x", "site_x"),
    ],
)
def test_snake_names(name, clean):
    assert T.snake_name(name) == clean


def test_clean_names_numbers_repeats(frame):
    assert T.clean_names(frame("`A b` int, `a.B` int", (1, 2))).columns == ["a_b", "a_b_2"]


def test_ladder_value_may_be_missing_and_still_win(frame, rows):
    x = F.col("x")
    rules = [R.Rule("none", x == "a", F.lit(None).cast("string")), R.Rule("any", x.isin("a", "b"), "B")]
    df = frame("x string", ("a",), ("b",), ("c",), (None,))
    out = df.select("x", R.first_match(rules, default=x).alias("v"), R.first_match_name(rules).alias("r"))
    assert rows(out) == [("a", None, "none"), ("b", "B", "any"), ("c", "c", "default"), (None, None, "default")]


def test_lookup_defaults(frame, rows):
    df = frame("x string", ("a",), ("z",), (None,))
    out = df.select("x", R.lookup("x", {"a": "A"}).alias("l"), R.lookup("x", {"a": "A"}, "?").alias("d"), R.lookup_or_keep("x", {"a": "A"}).alias("k"))
    assert rows(out) == [("a", "A", "A", "A"), ("z", None, "?", "z"), (None, None, "?", None)]


def test_array_tests_with_missing_elements(frame, rows):
    df = frame("k string, a array<string>", ("x", [None]), ("y", ["p", None]), ("z", ["q"]), ("n", None))
    out = df.select("k", R.any_in("a", ["p"]).alias("i"), R.all_missing("a").alias("m"))
    assert rows(out) == [("n", False, None), ("x", False, True), ("y", True, False), ("z", False, False)]


AGES = [(0, "0-1"), (0.99, "0-1"), (1, "1-4"), (4.9, "1-4"), (5, "5-10"), (10, "11-15"), (16, "16-45"), (46, ">46"), (-1, None), (None, None)]
WEEKS = [(1, 1), (8, 1), (8.5, None), (9, 2), (22, 3), (23, 4), (30, 4), (31, 6), (37, 6), (65, 10), (66, None), (0, None)]
DENSITIES = [
    (0, "0"), (0.5, None), (1, "1-99"), (99, "1-99"), (99.5, None), (100, "100-999"), (9999, "1,000-9,999"), (10000, "10,000-49,999"),
    (99999, "50,000-99,999"), (499999, "100,000-499,999"), (500000, "500,000-499,999"), (999999, "500,000-499,999"), (1000000, "> 1,000,000"),
]


@pytest.mark.parametrize("bands, cases", [(B.AGE_BANDS, AGES), (B.WEEK_BANDS, WEEKS), (B.DENSITY_BANDS, DENSITIES)])
def test_band_edges(spark, bands, cases):
    df = spark.createDataFrame([(None if x is None else float(x),) for x, _ in cases], "x double")
    got = {r["x"]: r["b"] for r in df.select("x", B.band_label("x", bands).alias("b")).collect()}
    assert got == {None if x is None else float(x): label for x, label in cases}


def test_follow_up_and_ranks(frame, rows):
    df = frame("x double", (27.0,), (28.0,), (29.0,), (None,))
    out = df.select("x", B.band_label("x", B.FOLLOW_UP_BANDS).alias("l"), B.band_rank("x", B.FOLLOW_UP_BANDS).alias("r"))
    assert rows(out) == [(27.0, "<28", 1), (28.0, "28", 2), (29.0, ">28", 3), (None, None, None)]


def test_corrected_density_label(frame):
    df = frame("x double", (600000.0,))
    assert df.select(B.density_band("x", corrected=True).alias("v")).first()["v"] == "500,000-999,999"


@pytest.mark.parametrize("x, status", [(0.0, "0 ~ Negative"), (0.2, "≥1 ~ Positive"), (None, "No data/Not measured")])
def test_detection(frame, x, status):
    assert frame("x double", (x,)).select(B.detection_status("x").alias("v")).first()["v"] == status


@pytest.mark.parametrize(
    "code, regimen, by_parts, detailed, by_code",
    [
        ("AL_4_adult", "Artemether–Lumefantrine", "ACT", "Other / Unclassified", "Unknown"),
        ("AL_child", "Artemether–Lumefantrine", "ACT", "Artemether–Lumefantrine (child dose)", "ACT"),
        ("AL3+PQh0", "Artemether–Lumefantrine + Primaquine", "ACT", "Other / Unclassified", "Unknown"),
        ("AS", "Artesunate", "Non-ACT", "Artesunate", "Unknown"),
        ("AS+SP", "Artesunate + Sulfadoxine–Pyrimethamine", "Non-ACT", "Artesunate + Sulfadoxine–Pyrimethamine", "ACT"),
        ("CQ - double dose", "Chloroquine", "Non-ACT", "Other / Unclassified", "Unknown"),
        ("SP", "Sulfadoxine–Pyrimethamine", "Non-ACT", "Sulfadoxine–Pyrimethamine", "Non-ACT"),
        ("DHAPPQb", "Dihydroartemisinin–Piperaquine", "ACT", "Dihydroartemisinin–Piperaquine (formulation b)", "ACT"),
        ("NEW", "NEW", "Unknown", "Other / Unclassified", "Unknown"),
        ("NA", None, "Unknown", None, "Unknown"),
        (None, None, "Unknown", "Other / Unclassified", "Unknown"),
    ],
)
def test_regimens(frame, code, regimen, by_parts, detailed, by_code):
    df = frame("x string", (code,)).withColumn("r", G.regimen_name("x"))
    row = df.select(
        "r", G.class_by_components(G.components("r")).alias("p"), G.detailed_name("x").alias("d"), G.class_by_code("x").alias("c")
    ).first()
    assert tuple(row) == (regimen, by_parts, detailed, by_code)


def test_every_code_has_one_regimen():
    codes = [c for group in G.REGIMEN_CODES.values() for c in group]
    assert len(codes) == len(set(codes)) == 44
    assert set(G.REGIMEN_CODES) == set(G.COMPONENTS)
    assert len(G.DETAILED_NAMES) == 27 and len(G.ACT_CODES) == 22


@pytest.mark.parametrize(
    "arm, code",
    [
        ("ARTEMETHER LUMEFANTRINE", "AL"), ("artemether–lumefantrine tab", "AL"), ("ARTHEMETHER  LUMEFANTRINE", "AL"),
        ("Artemether-Lumefantrine + Primaquine", "AL+PQ"), ("ARTHEMETHER LUMEFANTRINE PRIMAQUINE", "AL"),
        ("AMODIAQUINE ARTESUNATE", "AS-AQ"), ("ARTESUNATE+AMODIAQUINE", None), (" Artesunate  +  Amodiaquine ", "AS-AQ"),
        ("ARTESUNATE - AMODIAQUINE CHLORPHENIRAMINE", "AS-AQ+CP"), ("ARTENIMOL PIPERAQUINE", "DHA-PPQ"),
        ("Dihydroartemisinin Piperaquine", "DHA-PPQ"), ("ARTESUNATE + MEFLOQUINE", "AS-MQ"), ("Artesunate Mefloquine", "AS-MQ"),
        ("Artemisinin+Naphthoquine", "ART+NQ"), ("CHLOROQUINE", None), (None, None),
    ],
)
def test_arm_names(frame, arm, code):
    row = G.with_act_columns(frame("arm_2 string", (arm,))).first()
    assert row["act_code"] == code
    assert row["act_category"] == ("ACT" if code else "Non-ACT / Unknown")


@pytest.mark.parametrize("code, name", [("CIV", "Côte d’Ivoire"), ("ZMB", "Zambia"), ("XXX", None), (None, None)])
def test_countries(frame, code, name):
    assert frame("c string", (code,)).select(country_name("c").alias("v")).first()["v"] == name


# Published classes, written out here so that a changed list in the package cannot agree with itself.
CLASS_OF_CODE = {
    "AL": "ACT", "AL_adult": "ACT", "AL_child": "ACT", "AL_PQ": "ACT", "AL_unsupervised": "ACT", "AS": "Unknown",
    "AS+AQ": "ACT", "AS+AQ-FDC": "ACT", "AS+AQ(1)FDC": "ACT", "AS+AQ(2)FDC": "ACT", "AS+SP": "ACT", "AS3+AQ-FDC": "ACT",
    "AS3+SP": "ACT", "ASAQ": "ACT", "ASMQ": "ACT", "ASMQ_adult": "ACT", "ASMQ_child": "ACT", "AQ+SP": "Non-ACT",
    "CQ": "Non-ACT", "CQ_double_dose": "Non-ACT", "ART+NQ": "ACT", "DHA-PPQ": "ACT", "DHAPQP": "ACT", "DHAPQPa": "ACT",
    "DHAPPQb": "ACT", "DP": "ACT", "SP": "Non-ACT", "something else": "Unknown",
}
COUNTRY_OF_CODE = {
    "AGO": "Angola", "BEN": "Benin", "BFA": "Burkina Faso", "CIV": "Côte d’Ivoire", "CMR": "Cameroon", "GAB": "Gabon", "KEN": "Kenya",
    "MOZ": "Mozambique", "NER": "Niger", "NGA": "Nigeria", "RWA": "Rwanda", "SEN": "Senegal", "UGA": "Uganda", "ZMB": "Zambia", "XXX": None,
}
BAND_OF_DENSITY = [
    (0.0, "0"), (1.0, "1-99"), (99.0, "1-99"), (100.0, "100-999"), (999.0, "100-999"), (1000.0, "1,000-9,999"), (9999.0, "1,000-9,999"),
    (10000.0, "10,000-49,999"), (49999.0, "10,000-49,999"), (50000.0, "50,000-99,999"), (99999.0, "50,000-99,999"),
    (100000.0, "100,000-499,999"), (499999.0, "100,000-499,999"), (500000.0, "500,000-499,999"), (999999.0, "500,000-499,999"),
    (1000000.0, "> 1,000,000"), (2e7, "> 1,000,000"), (None, None),
]


def test_fixed_values_stand_as_published(frame):
    codes = frame("k string", *[(k,) for k in CLASS_OF_CODE]).select("k", G.class_by_code("k"))
    assert dict(map(tuple, codes.collect())) == CLASS_OF_CODE
    countries = frame("k string", *[(k,) for k in COUNTRY_OF_CODE]).select("k", country_name("k"))
    assert dict(map(tuple, countries.collect())) == COUNTRY_OF_CODE
    bands = frame("x double", *[(x,) for x, _ in BAND_OF_DENSITY]).select("x", B.density_band("x"))
    assert [tuple(r) for r in bands.collect()] == BAND_OF_DENSITY

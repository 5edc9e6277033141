"""The study analyses over the derived study tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortmill.catalogue import Tables, query
from cohortmill.catalogue import derived as X
from cohortmill.catalogue import sqltext as S
from cohortmill.functions import bands, recode, text
from cohortmill.functions.missing import as_number, if_else
from cohortmill.operators.aggregates import n_distinct, n_rows
from cohortmill.operators.tables import cross_frequency, frequency
from cohortmill.plans import cohort as C
from cohortmill.plans import domains as D
from cohortmill.plans import outcomes as O
from cohortmill.plans import regimens as R
from cohortmill.plans import reports as P
from cohortmill.sources.files import stage

SUBJECT = "studyid, usubjid"
VITALS = ["WEIGHT_kg", "HEIGHT_cm", "TEMP_C"]
COUNTS = ["PFALCIPA_10^6/L", "PFALCIPS_10^6/L"]


def _numbers(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: as_number(c) for c in columns})


# --- domains ---------------------------------------------------------------------------

TIMING_SQL = """coalesce(CASE WHEN event_id % 13 = 0 THEN CAST(event_id % 24 AS DOUBLE) END,
    CASE WHEN event_id % 17 <> 0 THEN CAST(day AS DOUBLE) END, CASE WHEN event_id % 19 <> 0 THEN CAST(day AS DOUBLE) END)"""
SOURCE_SQL = """CASE WHEN event_id % 13 = 0 THEN 'MBHR' WHEN event_id % 17 <> 0 THEN 'MBDY' WHEN event_id % 19 <> 0 THEN 'VISITDY' END"""


@query(
    "sdtm_timing_coalesce",
    f"""
WITH {X.D_SQL}, {X.DM_SQL},
w AS (SELECT {SUBJECT}, {TIMING_SQL} AS time, {SOURCE_SQL} AS time_source,
             {X.first_sql(X.COUNT_SQL, X.IS_VIEW)} AS pfalcipa_10_6_l, {X.first_sql(X.COUNT_SQL, X.IS_CLICK)} AS pfalcips_10_6_l, min(event_id) AS _row
      FROM d WHERE event_type IN ('view', 'click') GROUP BY ALL)
SELECT w.*, round(age_years, 8) AS age_years, sex, arm, country FROM w LEFT JOIN dm USING (studyid, usubjid)""",
)
def sdtm_timing_coalesce(t: Tables):
    wide = D.prepare_domain(X.microbiology(t), "mb", ["mbhr", "mbdy", "visitdy"], COUNTS)
    wide = _numbers(D.numeric_time(wide), "pfalcipa_10_6_l", "pfalcips_10_6_l")
    people = D.prepare_demographics(X.demographics(t)).withColumn("age_years", F.round("age_years", 8))
    return D.natural_left_join(wide, people)


@query(
    "sdtm_discovered_tests",
    f"""
WITH {X.D_SQL}
SELECT {SUBJECT}, {X.VISIT_DAY_SQL} AS time, CASE WHEN event_id % 19 <> 0 THEN 'VISITDY' END AS time_source,
       {", ".join(f"{X.first_sql('value', f'event_id % 3 = {i}')} AS {n.lower()}" for i, n in enumerate(VITALS))}, min(event_id) AS _row
FROM d WHERE event_type = 'purchase' GROUP BY ALL""",
)
def sdtm_discovered_tests(t: Tables):
    wide = D.numeric_time(D.prepare_domain(X.vital_signs(t), "vs"))
    return _numbers(wide, *[v.lower() for v in VITALS])


PARASITE_NAMES = [f"{test}_10^6/L_{method}" for test in ("PFALCIPA", "PFALCIPS") for method in ("MICROSCOPY", "PCR", "NA")]


@query(
    "parasite_table",
    f"""
WITH {X.D_SQL}
SELECT {SUBJECT}, coalesce({TIMING_SQL}, CAST(event_id % 6 AS DOUBLE)) AS time, coalesce({SOURCE_SQL}, 'VISITNUM') AS time_source,
       {", ".join(
           f"{X.first_sql(X.COUNT_SQL, f'{kind} AND event_id % 3 = {i}')} AS {test}_10_6_l_{m}"
           for test, kind in (("pfalcipa", X.IS_VIEW), ("pfalcips", X.IS_CLICK)) for i, m in enumerate(("microscopy", "pcr", "na")))},
       min(event_id) AS _row
FROM d WHERE event_type IN ('view', 'click') GROUP BY ALL""",
)
def parasite_table(t: Tables):
    wide = D.numeric_time(D.parasite_table(X.microbiology(t), names=PARASITE_NAMES))
    return _numbers(wide, *[text.snake_name(n) for n in PARASITE_NAMES])


@query(
    "participant_table",
    f"""
WITH {X.D_SQL}, {X.DM_SQL},
v AS (SELECT {SUBJECT}, {", ".join(f"{X.first_sql('value', f'event_id % 3 = {i}')} AS {n.lower()}" for i, n in enumerate(VITALS))}
      FROM d WHERE event_type = 'purchase' GROUP BY ALL)
SELECT {SUBJECT}, round(age_years, 8) AS age_years, sex, arm, country, weight_kg, height_cm, temp_c FROM dm LEFT JOIN v USING (studyid, usubjid)""",
)
def participant_table(t: Tables):
    table = D.participant_table(X.demographics(t), X.vital_signs(t), other=None)
    return _numbers(table, *[v.lower() for v in VITALS]).withColumn("age_years", F.round("age_years", 8))


ODD_UNITS = ["YEARS", "MONTHS", "HOURS", "DECADES", None, "FORTNIGHTS"]


@query(
    "participant_units",
    f"""
WITH {X.D_SQL}, dm AS (SELECT DISTINCT studyid, usubjid, user_id FROM d),
v AS (SELECT {SUBJECT}, {X.first_sql('value', 'event_id % 3 = 0')} AS weight_kg,
             string_agg(CASE event_id % 3 WHEN 1 THEN 'HEIGHT_m=' WHEN 2 THEN 'TEMP_NA=' END || (event_id % 50), '; ' ORDER BY event_id) FILTER (WHERE event_id % 3 > 0) AS vital_signs_other
      FROM d WHERE event_type = 'purchase' GROUP BY ALL)
SELECT {SUBJECT}, round((user_id % 90) * CASE user_id % 6 WHEN 1 THEN 1 / 12.0::DOUBLE WHEN 2 THEN 1 / (365.25 * 24)::DOUBLE WHEN 3 THEN 10 WHEN 5 THEN NULL ELSE 1 END, 8) AS age_years,
       weight_kg, vital_signs_other FROM dm LEFT JOIN v USING (studyid, usubjid)""",
)
def participant_units(t: Tables):
    """Ages in odd units, and measurements in units without a column of their own, which are kept as text."""
    user = F.col("usubjid").substr(2, 20).cast("long")
    people = X.demographics(t).withColumn("ageu", X.pick(ODD_UNITS, user))
    signs = X.vital_signs(t).withColumn("vsstresu", X.pick(["kg", "m", None], F.col("_row")))
    signs = signs.withColumn("vsstresn", F.when(F.col("_row") % 3 == 0, F.col("vsstresn").cast("string")).otherwise((F.col("_row") % 50).cast("string")))
    table = D.participant_table(people, signs, tests=["WEIGHT_kg"])
    return _numbers(table.select("studyid", "usubjid", F.round("age_years", 8).alias("age_years"), "weight_kg", "vital_signs_other"), "weight_kg")


@query(
    "unknown_age_units",
    f"""
WITH {X.D_SQL}, dm AS (SELECT DISTINCT studyid, usubjid, user_id FROM d)
SELECT 'FORTNIGHTS' AS ageu, count(*) AS n FROM dm WHERE user_id % 6 = 5""",
)
def unknown_age_units(t: Tables):
    user = F.col("usubjid").substr(2, 20).cast("long")
    return D.unknown_age_units(X.demographics(t).withColumn("ageu", X.pick(ODD_UNITS, user)))


@query(
    "dispositions_and_interventions",
    f"""
WITH {X.D_SQL}, {X.WIDE_SQL}
SELECT 'first' AS kind, {SUBJECT}, time, disposition AS value FROM ds
UNION ALL SELECT 'decoded', {SUBJECT}, time, disposition_2 FROM ds
UNION ALL SELECT inclas, {SUBJECT}, visitdy, intrt FROM ints""",
)
def dispositions_and_interventions(t: Tables):
    def part(df, kind, value):
        return df.select(kind.alias("kind"), "studyid", "usubjid", "time", F.col(value).alias("value"))

    first = D.prepare_disposition(X.dispositions(t), prefer_decoded=False)
    decoded = D.prepare_disposition(X.dispositions(t))
    given = D.prepare_interventions(X.interventions(t)).withColumnRenamed("visitdy", "time")
    return (
        part(first, F.lit("first"), "disposition")
        .unionByName(part(decoded, F.lit("decoded"), "disposition"))
        .unionByName(part(given, F.col("inclas"), "intrt"))
    )


def merged_days(t: Tables) -> DataFrame:
    """All derived domains as one table per subject and day."""
    numeric = {"pf": (X.genotyping(t), ["INTP_NA"]), "rs": (X.responses(t), ["WHOMAL01_NA"]), "vs": (X.vital_signs(t), VITALS)}
    pf, rs, vs = (
        D.numeric_time(D.prepare_domain(df, code, tests=tests)).drop("time_source") for code, (df, tests) in numeric.items()
    )
    return D.merge_subject_days(
        D.prepare_domain(X.microbiology(t), "mb", ["mbdy"], COUNTS),
        D.prepare_demographics(X.demographics(t)),
        D.prepare_interventions(X.interventions(t)),
        pf,
        rs,
        vs,
        D.prepare_disposition(X.dispositions(t), prefer_decoded=False),
    )


@query(
    "subject_day_merge",
    X.MERGED_SQL
    + f"""
SELECT {SUBJECT}, time, pfmicl AS pfalcipa_10_6_l, gfmicl AS pfalcips_10_6_l, sex, arm, country, intrt, inclas, visitnum, intp AS intp_na, who AS whomal01_na,
       weight_kg, height_cm, temp_c, disposition FROM m4""",
)
def subject_day_merge(t: Tables):
    numbers = [C.ASEXUAL, C.SEXUAL, *[v.lower() for v in VITALS]]
    return _numbers(merged_days(t), *numbers).select(
        "studyid", "usubjid", "time", C.ASEXUAL, C.SEXUAL, "sex", "arm", "country", "intrt", "inclas", "visitnum", "intp_na",
        "whomal01_na", "weight_kg", "height_cm", "temp_c", "disposition",
    )


RAW_KINDS = {"ds": "signup", "mb": "view", "vs": "purchase", "pf": "click", "rs": "error"}


def _raw_domain(t: Tables, code: str, kind: str) -> DataFrame:
    event = F.col("event_id")
    return X.days(t).filter(F.col("event_type") == kind).select(
        "studyid", "usubjid", (event % 2).cast("int").alias("seq"), F.when(event % 7 != 0, X._text("V", event % 3)).alias("visit"),
        (event % 3).cast("double").alias("visitnum"), F.col("day").cast("double").alias("visitdy"), F.lit("TREATMENT").alias("epoch"),
        F.col("value").alias(f"{code}_value"),
    )


def _raw_sql(code: str, kind: str) -> str:
    return (
        f"{code} AS (SELECT studyid, usubjid, CAST(event_id % 2 AS INTEGER) AS seq, CASE WHEN event_id % 7 <> 0 THEN 'V' || (event_id % 3) END AS visit, "
        f"CAST(event_id % 3 AS DOUBLE) AS visitnum, CAST(day AS DOUBLE) AS visitdy, 'TREATMENT' AS epoch, value AS {code}_value FROM d WHERE event_type = '{kind}')"
    )


RAW_KEYS = ("studyid", "usubjid", "seq", "visit", "visitnum", "visitdy", "epoch")


def _raw_step(i: int, code: str, keys=RAW_KEYS) -> str:
    skip = f"EXCLUDE ({', '.join(keys)})"
    return (
        f"w{i} AS (SELECT {X._keys('m', 'x', keys)}, m.* {skip}, x.* {skip} "
        f"FROM w{i - 1} m FULL JOIN {code} x ON {X._same('m', 'x', keys)})"
    )


def _supervised(df: DataFrame, every: int) -> DataFrame:
    return df.withColumn("dotind", F.when(F.col("visitdy") % every == 0, "Y").otherwise("N"))


@query(
    "raw_domain_merge_extra_key",
    f"""
WITH {X.D_SQL}, {X.DM_SQL}, {_raw_sql("ds", "signup")}, {_raw_sql("pt0", "click")}, {_raw_sql("in0", "purchase")},
pt AS (SELECT *, CASE WHEN visitdy % 2 = 0 THEN 'Y' ELSE 'N' END AS dotind FROM pt0),
ix AS (SELECT *, CASE WHEN visitdy % 3 = 0 THEN 'Y' ELSE 'N' END AS dotind FROM in0),
w0 AS (SELECT coalesce(ds.studyid, dm.studyid) AS studyid, coalesce(ds.usubjid, dm.usubjid) AS usubjid, seq, visit, visitnum, visitdy, epoch, ds_value, sex, arm
       FROM ds FULL JOIN dm ON ds.studyid = dm.studyid AND ds.usubjid = dm.usubjid),
{_raw_step(1, "pt")}, {_raw_step(2, "ix", (*RAW_KEYS, "dotind"))}
SELECT * FROM w2""",
)
def raw_domain_merge_extra_key(t: Tables):
    """Treatments and interventions of one visit that differ in supervision stay two rows."""
    frames = {
        "ds": _raw_domain(t, "ds", "signup"),
        "pt": _supervised(_raw_domain(t, "pt0", "click"), 2),
        "in": _supervised(_raw_domain(t, "in0", "purchase"), 3),
    }
    people = D.prepare_demographics(X.demographics(t)).select("studyid", "usubjid", "sex", "arm")
    return D.merge_raw_domains(frames, people, {"in": ["dotind"]})


@query(
    "raw_domain_merge",
    f"""
WITH {X.D_SQL}, {X.DM_SQL}, {", ".join(_raw_sql(c, k) for c, k in RAW_KINDS.items())},
w0 AS (SELECT coalesce(ds.studyid, dm.studyid) AS studyid, coalesce(ds.usubjid, dm.usubjid) AS usubjid, seq, visit, visitnum, visitdy, epoch, ds_value, sex, arm
       FROM ds FULL JOIN dm ON ds.studyid = dm.studyid AND ds.usubjid = dm.usubjid),
{", ".join(_raw_step(i + 1, c) for i, c in enumerate(list(RAW_KINDS)[1:]))}
SELECT * FROM w{len(RAW_KINDS) - 1}""",
)
def raw_domain_merge(t: Tables):
    frames = {code: _raw_domain(t, code, kind) for code, kind in RAW_KINDS.items()}
    people = D.prepare_demographics(X.demographics(t)).select("studyid", "usubjid", "sex", "arm")
    return D.merge_raw_domains(frames, people)


# --- outcomes and regimens ---------------------------------------------------------------


def ladder_sql(pcr: str, who: str, term: str, second: str, arm: str) -> str:
    """The adjudication with all published rules, dead ones included, then the corrections."""
    first = f"""CASE
      WHEN {pcr} IS NOT NULL AND {term} LIKE '%LATE%' THEN {pcr}
      WHEN {term} LIKE '%LATE PARASITOLOGICAL%' AND {who} LIKE '%LATE PARASITOLOGICAL%' THEN {who}
      WHEN {who} = 'ACPR' AND {term} = 'ACPR' THEN 'ACPR'
      WHEN {pcr} LIKE '%CLINICAL FAILURE%' AND {term} LIKE '%LATE TREATMENT%' THEN {pcr}
      WHEN {term} LIKE '%ADEQUATE PARASITOLOGICAL AND CLINICAL RESPONSE%' THEN 'ACPR'
      WHEN {term} LIKE '%EARLY TREATMENT%' OR {term} LIKE '%ETF%' THEN {who}
      WHEN {who} LIKE '%LATE TREATMENT FAILURE%' THEN {pcr}
      WHEN {term} LIKE '%ADVERSE%' OR {term} LIKE '%ANTI-MALARIAL%' OR {term} LIKE '%EXCLUDED%' THEN {second}
      WHEN {term} LIKE '%LATE CLINICAL FAILURE%' AND {pcr} IS NOT NULL THEN {pcr}
      WHEN {pcr} IS NULL AND {arm} IS NOT NULL AND {term} LIKE '%LATE CLINICAL FAILURE%' THEN 'INDETERMINATE'
      WHEN {term} = 'COMPLETED' AND {who} = 'ACPR' THEN {who}
      WHEN {term} = 'ETF' THEN 'LTF'
      WHEN {term} IN ('LCF', 'LPF') THEN {pcr}
      WHEN {term} LIKE '%LOST TO FOLLOW%' OR {term} LIKE '%LOST TO F/UP%' OR {term} LIKE '%LOSS%' THEN {second}
      WHEN {pcr} IS NULL AND {who} LIKE '%LATE PARASITOLOGICAL FAILURE%' THEN 'LTF'
      ELSE {term} END"""
    steps = [
        ("({o} LIKE '%WITHDRAW%' OR {o} LIKE '%WITHDRE%')", "'WITHDRAWAL'"),
        ("{o} LIKE '%LATE PARASITOLOGICAL FAILURE%' AND {p} IS NULL", "'LTF'"),
        ("{o} LIKE '%EARLY TREATMENT FAILURE%' AND {p} IS NULL", "'ELTF'"),
        ("{o} LIKE '%LATE TREATMENT FAILURE%' AND {p} IS NULL", "'LTF'"),
        ("{o} LIKE '%LATE TREATMENT FAILURE%' AND {p} IS NOT NULL", "{p}"),
    ]
    # The corrections run one after the other, each on the result of the one before.
    return reduce(
        lambda inner, step: f"(SELECT CASE WHEN {step[0]} THEN {step[1]} ELSE o END FROM (SELECT {inner} AS o))".format(o="o", p=pcr),
        steps,
        f"({first})",
    )


OUTCOME_CODES = recode.invert_groups(O.OUTCOME_CLASSES)
LADDER_INPUT = [
    ("pcr", [*X.GENOTYPES, None, None], "o_orderkey", "% 5"),
    ("who", [*X.CLASSIFIED, None], "o_custkey", "% 6"),
    ("term", [*X.TERMS, "LOST TO F/UP", "LATE CLINICAL FAILURE - DAY 28", "STUDY LOSS"], "o_orderkey // 5", "% 19"),
    ("second", ["WITHDRAWAL BY SUBJECT", "OTHERS", "LTFRC", "MissedD28", None], "o_custkey // 6", "% 5"),
    ("arm", ["AL", None], "o_custkey // 3", "% 2"),
]


@query(
    "outcome_ladder",
    f"""
WITH x AS (SELECT o_orderkey, {", ".join(f"{S.pick(v, f'({i}) {m}')} AS {n}" for n, v, i, m in LADDER_INPUT)} FROM orders),
y AS (SELECT *, {ladder_sql("pcr", "who", "term", "second", "arm")} AS outcome FROM x)
SELECT o_orderkey, outcome, {S.case_map("outcome", OUTCOME_CODES, "outcome")} AS outcome_2 FROM y""",
)
def outcome_ladder(t: Tables):
    index = {"o_orderkey": F.col("o_orderkey"), "o_custkey": F.col("o_custkey"), "o_orderkey // 5": F.floor(F.col("o_orderkey") / 5)}
    index |= {"o_custkey // 6": F.floor(F.col("o_custkey") / 6), "o_custkey // 3": F.floor(F.col("o_custkey") / 3)}
    x = t.orders.select("o_orderkey", *[X.pick(v, index[i]).alias(n) for n, v, i, _ in LADDER_INPUT])
    decided = O.adjudicate(x, "pcr", "who", "term", "second", "arm")
    return decided.select("o_orderkey", "outcome", O.outcome_class("outcome").alias("outcome_2"))


REGIMENS = recode.invert_groups(R.REGIMEN_CODES)
CORE_REGIMENS = [r for r, parts in R.COMPONENTS.items() if set(parts) & set(R.CORE_DRUGS) and set(parts) & set(R.PARTNER_DRUGS)]


def regimen_sql(code: str) -> str:
    return S.case_map(f"nullif({code}, 'NA')", REGIMENS, f"nullif({code}, 'NA')")


def component_class_sql(regimen: str) -> str:
    return (
        f"CASE WHEN NOT {S.in_list(regimen, list(R.COMPONENTS))} THEN 'Unknown' "
        f"WHEN {S.in_list(regimen, CORE_REGIMENS)} THEN 'ACT' ELSE 'Non-ACT' END"
    )


def code_class_sql(code: str) -> str:
    return f"CASE WHEN {S.in_list(code, R.ACT_CODES)} THEN 'ACT' WHEN {S.in_list(code, R.NON_ACT_CODES)} THEN 'Non-ACT' ELSE 'Unknown' END"


def detailed_sql(code: str) -> str:
    return f"CASE WHEN coalesce({code} = 'NA', false) THEN NULL ELSE {S.case_map(code, R.DETAILED_NAMES, S.quote(R.UNCLASSIFIED))} END"


@query(
    "regimen_names",
    f"""
WITH x AS (SELECT p_partkey, {S.pick(X.CODES, f"p_partkey % {len(X.CODES)}")} AS treat FROM part), y AS (SELECT *, {regimen_sql("treat")} AS treat_2 FROM x)
SELECT p_partkey, treat, treat_2, {component_class_sql("treat_2")} AS class_by_components, {detailed_sql("treat")} AS detailed, {code_class_sql("treat")} AS class_by_code,
       CASE treat_2 {" ".join(f"WHEN {S.quote(r)} THEN {S.quote('|'.join(c))}" for r, c in R.COMPONENTS.items())} END AS parts
FROM y""",
)
def regimen_names(t: Tables):
    x = t.part.select("p_partkey", X.pick(X.CODES, F.col("p_partkey")).alias("treat"))
    parts = R.components("treat_2")
    return x.withColumn("treat_2", R.regimen_name("treat")).select(
        "*",
        R.class_by_components(parts).alias("class_by_components"),
        R.detailed_name("treat").alias("detailed"),
        R.class_by_code("treat").alias("class_by_code"),
        F.when(~recode.all_missing(parts), F.array_join(parts, "|")).alias("parts"),
    )


def act_name_sql(label: str) -> str:
    def has(*patterns):
        return "(" + " OR ".join(f"regexp_matches({label}, {S.quote(p)})" for p in patterns) + ")"

    as_aq = has(R.AS_AQ_TEXT, R.AQ_AS_TEXT, "ARTESUNATE + AMODIAQUINE")
    cases = [
        (f"{label} = 'ARTESUNATE + AMODIAQUINE'", R.AS_AQ),
        (f"{label} = 'ARTESUNATE + MEFLOQUINE'", R.AS_MQ),
        (f"{has(R.AL_TEXT)} AND {has('PRIMAQUINE')}", R.AL_PQ),
        (has(R.AL_TEXT, R.AL_MISSPELT), R.AL),
        (f"{as_aq} AND {has('CHLORPHENIRAMINE')}", R.AS_AQ_CP),
        (as_aq, R.AS_AQ),
        (has(R.DHA_PPQ_TEXT, R.ARTENIMOL_TEXT), R.DHA_PPQ),
        (has(R.AS_MQ_TEXT), R.AS_MQ),
        (has(R.ART_NQ_TEXT), R.ART_NQ),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {S.quote(v)}" for c, v in cases) + " END"


@query(
    "arm_names",
    f"""
WITH x AS (SELECT c_custkey, {S.pick(X.ARMS, f"c_custkey % {len(X.ARMS)}")} AS arm_2 FROM customer),
y AS (SELECT *, {S.normal_label("arm_2")} AS arm_norm FROM x), z AS (SELECT *, {act_name_sql("arm_norm")} AS act_name FROM y)
SELECT *, CASE WHEN act_name IS NULL THEN 'Non-ACT / Unknown' ELSE 'ACT' END AS act_category, {S.case_map("act_name", R.SHORT_CODES)} AS act_code FROM z""",
)
def arm_names(t: Tables):
    return R.with_act_columns(t.customer.select("c_custkey", X.pick(X.ARMS, F.col("c_custkey")).alias("arm_2")))


# --- cohorts -----------------------------------------------------------------------------

ARM_PATTERN = "|".join(R.ACT_ARM_TEXTS)
TRIALS_SQL = (
    X.MERGED_SQL
    + f""",
f AS (SELECT {SUBJECT}, arm AS arm_2, {S.case_map("country", C.COUNTRIES)} AS country_name_2 FROM m4
      QUALIFY row_number() OVER (PARTITION BY studyid, usubjid ORDER BY {X.MERGED_ORDER}) = 1),
a AS (SELECT m4.* EXCLUDE (disposition_2), m4.disposition_2, arm_2, country_name_2 FROM m4 LEFT JOIN f USING (studyid, usubjid)
      WHERE (studyid, usubjid) IN (SELECT (studyid, usubjid) FROM m4 WHERE regexp_matches(arm, {S.quote(ARM_PATTERN)}, 'i'))
        AND NOT (coalesce(time = 1, false) AND pfmicl IS NULL) AND NOT (time IS NULL AND pfmicl IS NULL)),
tc AS (SELECT {SUBJECT}, country_name_2, time, age_years, sex, pfmicl, gfmicl, arm_2, weight_kg, height_cm, temp_c, 'SDTM' AS origin,
              {ladder_sql("intp", "who", "disposition", "disposition_2", "arm_2")} AS outcome, intp, r_mb, r_in, r_pf, r_rs, r_vs FROM a)"""
)
COHORT_COLUMNS = "studyid, usubjid, country_name_2, time, round(age_years, 8) AS age_years, sex, pfmicl, gfmicl, arm_2, weight_kg, height_cm, temp_c, origin, outcome, intp"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*C.COHORT_TYPES).withColumn("age_years", F.round("age_years", 8))


def _trials(t: Tables) -> DataFrame:
    return C.curate_trials(merged_days(t), D.prepare_disposition(X.dispositions(t)))


LIVE_RULES = [
    ("late, genotyped", "{p} IS NOT NULL AND {t} LIKE '%LATE%'"),
    ("late parasitological twice", "{t} LIKE '%LATE PARASITOLOGICAL%' AND {w} LIKE '%LATE PARASITOLOGICAL%'"),
    ("adequate twice", "{w} = 'ACPR' AND {t} = 'ACPR'"),
    ("adequate in words", "{t} LIKE '%ADEQUATE PARASITOLOGICAL AND CLINICAL RESPONSE%'"),
    ("early", "({t} LIKE '%EARLY TREATMENT%' OR {t} LIKE '%ETF%')"),
    ("late by classification", "{w} LIKE '%LATE TREATMENT FAILURE%'"),
    ("adverse event", "{t} LIKE '%ADVERSE%'"),
    ("other antimalarial", "{t} LIKE '%ANTI-MALARIAL%'"),
    ("excluded", "{t} LIKE '%EXCLUDED%'"),
    ("late clinical, no genotype", "{p} IS NULL AND {a} IS NOT NULL AND {t} LIKE '%LATE CLINICAL FAILURE%'"),
    ("completed", "{t} = 'COMPLETED' AND {w} = 'ACPR'"),
    ("code LCF", "{t} = 'LCF'"),
    ("code LPF", "{t} = 'LPF'"),
    ("lost", "({t} LIKE '%LOST TO FOLLOW%' OR {t} LIKE '%LOST TO F/UP%' OR {t} LIKE '%LOSS%')"),
    ("late parasitological, no genotype", "{p} IS NULL AND {w} LIKE '%LATE PARASITOLOGICAL FAILURE%'"),
]
RULE_SQL = "CASE " + " ".join(
    f"WHEN {c.format(p='intp', w='who', t='disposition', a='arm_2')} THEN {S.quote(n)}" for n, c in LIVE_RULES
) + " ELSE 'default' END"


@query("outcome_rules_used", TRIALS_SQL + f" SELECT {RULE_SQL} AS outcome_rule, count(*) AS n FROM a GROUP BY 1")
def outcome_rules_used(t: Tables):
    days = stage(merged_days(t))
    first = {"arm": "arm_2"}
    order = [F.col(c).asc_nulls_last() for c in days.columns if c.startswith("_order_")]
    named = C.fill_from_first_row(days, D.SUBJECT, order, first)
    second = F.lit(None).cast("string").alias("disposition_2")
    explained = O.adjudicate(C.select_act_subjects(named).select("*", second), explain=True)
    return explained.groupBy("outcome_rule").agg(n_rows().alias("n"))


@query("trial_cohort", TRIALS_SQL + f" SELECT {COHORT_COLUMNS} FROM tc")
def trial_cohort(t: Tables):
    return _shown(_trials(t))


@query(
    "patient_set_payload",
    X.OBSERVED_SQL
    + f""", q AS (SELECT sid, pid, max(day) - 3 AS lastday, max(value) AS pfmicl0, min(day) AS recurparday, {S.pick(X.SITES, "(user_id + 1) % 3")} AS site
  FROM d WHERE event_type = 'purchase' GROUP BY sid, pid, user_id)
SELECT ob.pid, ob.sid, ob.site, ob.dayofobs + 1 AS dayofobs, ob.hourofobs, q.site AS site_y, pfmicl0, recurparday
FROM ob LEFT JOIN q ON ob.sid = q.sid AND ob.pid = q.pid AND ob.dayofobs = q.lastday""",
)
def patient_set_payload(t: Tables):
    merged = C.merge_observations(_observations(t))
    joined = C.attach_outcome(merged, X.patient_set_measures(t), ["site", "pfmicl0", "recurparday"])
    return joined.select(*C.OBSERVATION_KEYS, "site_y", "pfmicl0", "recurparday")


@query(
    "observation_merge",
    X.OBSERVED_SQL
    + """ SELECT pid, sid, site, dayofobs, hourofobs, id, disease, ageyears, gender, temp, weight, height, lastdayfup, pfmicl, gfmicl, pcr, treat, outcome FROM oc""",
)
def observation_merge(t: Tables):
    merged = C.attach_outcome(C.merge_observations(_observations(t)), X.patient_set(t))
    return merged.select(
        *C.OBSERVATION_KEYS, "id", "disease", "ageyears", "gender", "temp", "weight", "height", "lastdayfup", "pfmicl", "gfmicl",
        "pcr", "treat", "outcome",
    )


def _observations(t: Tables) -> list[DataFrame]:
    # The clinical and parasite tables repeat the id; their copies are dropped by the merge.
    return X.observation_tables(t)


OBSERVED_COHORT_SQL = (
    X.OBSERVED_SQL
    + f""",
oa AS (SELECT *, {regimen_sql("treat")} AS treat_2 FROM oc),
ok AS (SELECT * FROM oa WHERE (sid, pid) IN (SELECT (sid, pid) FROM oa WHERE {component_class_sql("treat_2")} = 'ACT')),
fo AS (SELECT sid, pid, treat_2 AS arm_2, site AS country_name_2, ageyears AS age_years FROM ok
       QUALIFY row_number() OVER (PARTITION BY sid, pid ORDER BY {X.OBSERVED_ORDER}) = 1),
obc AS (SELECT sid AS studyid, pid AS usubjid, country_name_2, CAST(dayofobs AS DOUBLE) AS time, age_years, gender AS sex, {S.number("pfmicl")} AS pfmicl,
        {S.number("gfmicl")} AS gfmicl, arm_2, weight AS weight_kg, height AS height_cm, temp AS temp_c, 'MAPPER' AS origin, outcome, NULL::VARCHAR AS intp,
        r_su, r_cl, r_pa, r_pc, r_tr FROM ok JOIN fo USING (sid, pid) WHERE age_years < 5)"""
)


def _observed_cohort(t: Tables) -> DataFrame:
    merged = C.attach_outcome(C.merge_observations(_observations(t)), X.patient_set(t))
    return C.curate_observations(C.classify_observations(merged))


@query("observation_cohort", OBSERVED_COHORT_SQL + f" SELECT {COHORT_COLUMNS} FROM obc")
def observation_cohort(t: Tables):
    return _shown(_observed_cohort(t))


POOL_SQL = (
    TRIALS_SQL
    + ","
    + OBSERVED_COHORT_SQL.split(X.D_SQL + ",", 1)[1]
    + f""",
bo AS (SELECT tc.*, 0 AS side FROM tc UNION ALL BY NAME SELECT obc.*, 1 AS side FROM obc),
po AS (SELECT * FROM bo QUALIFY row_number() OVER (PARTITION BY usubjid, studyid, country_name_2, time
         ORDER BY side, {X.MERGED_ORDER}, {X.OBSERVED_ORDER}) = 1)"""
)


def _pooled(t: Tables) -> DataFrame:
    return C.pool(_trials(t), _observed_cohort(t))


@query("pooled_cohort", POOL_SQL + f" SELECT {COHORT_COLUMNS} FROM po")
def pooled_cohort(t: Tables):
    return _shown(_pooled(t))


def country_lookup(t: Tables) -> DataFrame:
    """Countries of the subjects with a high value; some subjects have two."""
    user = F.col("user_id")
    listed = X.days(t).filter("value > 200").select("studyid", "usubjid", "user_id").distinct()
    first = F.struct(F.lit("Ghana").alias("c"))
    both = F.array(first, F.struct(F.lit("Togo").alias("c")))
    names = F.when(user % 4 == 1, both).otherwise(F.array(first))
    return listed.select("studyid", "usubjid", F.explode(names).alias("n")).select("studyid", "usubjid", F.col("n.c").alias("country_name"))


FINAL_SQL = (
    POOL_SQL
    + f""",
ch AS (SELECT studyid, usubjid, age_years AS age, sex AS gender FROM po
       QUALIFY row_number() OVER (PARTITION BY studyid, usubjid ORDER BY side, {X.MERGED_ORDER}, {X.OBSERVED_ORDER}) = 1),
en AS (SELECT po.*, age, gender, {S.case_map("outcome", OUTCOME_CODES, "outcome")} AS outcome_2,
              CASE WHEN age < 5 THEN '< 5' WHEN age >= 5 THEN '≥ 5' END AS age_5, {S.case_bands("age", bands.AGE_BANDS)} AS age_group,
              CAST({S.case_bands("time", bands.WEEK_BANDS)} AS INTEGER) AS week, {S.normal_label("arm_2")} AS arm_norm
       FROM po JOIN ch USING (studyid, usubjid)),
na AS (SELECT *, {act_name_sql("arm_norm")} AS act_name FROM en),
co AS (SELECT DISTINCT studyid, usubjid, unnest(CASE WHEN user_id % 4 = 1 THEN ['Ghana', 'Togo'] ELSE ['Ghana'] END) AS country_name_1 FROM d WHERE value > 200),
fi AS (SELECT na.*, coalesce(country_name_1, country_name_2) AS country_name FROM na LEFT JOIN co USING (studyid, usubjid)
       WHERE age IS NOT NULL AND NOT (time = 1 AND pfmicl IS NULL) AND age_years < 5 AND act_name IN ({", ".join(map(S.quote, R.MAIN_ACTS))}))"""
)


@query(
    "final_cohort",
    FINAL_SQL
    + """
SELECT studyid, usubjid, time, round(age, 8) AS age, gender, pfmicl, origin, outcome_2, age_5, age_group, week, act_name, country_name FROM fi""",
)
def final_cohort(t: Tables):
    table = C.final_cohort(_trials(t), _observed_cohort(t), country_lookup(t))
    return table.select(
        "studyid", "usubjid", "time", F.round("age", 8).alias("age"), "gender", "pfmicl", "origin", "outcome_2", "age_5", "age_group", "week",
        "act_name", "country_name",
    )


# --- reports -----------------------------------------------------------------------------


def _analysis(t: Tables) -> DataFrame:
    return P.analysis_table(X.cohort(t))


ANALYSIS_SQL = f"""
WITH {X.COHORT_SQL}, x AS (SELECT *, {S.case_bands("pfmicl", bands.DENSITY_BANDS)} AS parasitaemia_categories,
     {S.band_rank("pfmicl", bands.DENSITY_BANDS)} AS parasitaemia_rank FROM x0)"""


def _density_sql(day: int) -> str:
    arms = R.MAIN_ACTS
    cells = ", ".join(f"count(DISTINCT usubjid) FILTER (WHERE act_name = {S.quote(a)}) AS c{i}" for i, a in enumerate(arms))
    shown = ", ".join(
        f'c{i} AS "{a}", round(p{i}, 10) AS "{a}_pct", CASE WHEN p{i} IS NOT NULL THEN printf(\'%d (%.2f%%)\', c{i}, {S.half_even(f"p{i} * 100", 2)}) END AS "{a}_text"'
        for i, a in enumerate(arms)
    )
    return f"""{ANALYSIS_SQL},
b AS (SELECT parasitaemia_categories, parasitaemia_rank, {cells} FROM x WHERE time = {day} AND pfmicl IS NOT NULL GROUP BY ALL),
w AS (SELECT * FROM b UNION ALL SELECT 'Total', NULL, {", ".join(f"CAST(sum(c{i}) AS BIGINT)" for i in range(len(arms)))} FROM b),
s AS (SELECT *, {", ".join(f"c{i} / (SELECT nullif(sum(c{i}), 0) FROM b) AS p{i}" for i in range(len(arms)))} FROM w)
SELECT parasitaemia_categories, parasitaemia_rank, {shown} FROM s"""


def _density(t: Tables, day: int) -> DataFrame:
    table = P.density_by_arm(_analysis(t), day)
    return table.withColumns({f"{a}_pct": F.round(f"`{a}_pct`", 10) for a in R.MAIN_ACTS})


@query("density_by_arm_baseline", _density_sql(P.BASELINE_DAY))
def density_by_arm_baseline(t: Tables):
    return _density(t, P.BASELINE_DAY)


@query("density_by_arm_day_28", _density_sql(P.DAY_28))
def density_by_arm_day_28(t: Tables):
    return _density(t, P.DAY_28)


@query("density_by_arm_day_42", _density_sql(P.DAY_42))
def density_by_arm_day_42(t: Tables):
    return _density(t, P.DAY_42)


DAYS = [*range(1, 15), 21, 28]


def _subjects_sql(
    columns, table: str, row: str, column: str, keep: str, other: str | None = None, start: str = f"WITH {X.D_SQL}, {X.WIDE_SQL}"
) -> str:
    """Distinct subjects per cell; ``other`` adds the cells whose category has no column, each counted for itself."""
    cells = [f'CAST(sum(n) FILTER (WHERE {column} IS NOT DISTINCT FROM {S.quote(v)}) AS BIGINT) AS "{n}"' for n, v in columns.items()]
    if other:
        cells.append(f'CAST(sum(n) FILTER (WHERE {column} IS NULL OR {column} NOT IN ({", ".join(map(S.quote, columns.values()))})) AS BIGINT) AS "{other}"')
    names = [*columns, *([other] if other else [])]
    return f"""
{start}, k AS (SELECT {row}, {column}, count(DISTINCT usubjid) AS n FROM {table} WHERE {keep} GROUP BY ALL),
w AS (SELECT {row}, {", ".join(cells)} FROM k GROUP BY {row}),
z AS (SELECT {row}, {", ".join(f'"{n}"' for n in names)}, {" + ".join(f'coalesce("{n}", 0)' for n in names)} AS "Total" FROM w)
SELECT * FROM z UNION ALL SELECT 'Total', {", ".join(f'CAST(coalesce(sum("{n}"), 0) AS BIGINT)' for n in [*names, "Total"])} FROM z"""


@query(
    "dispositions_by_day",
    _subjects_sql({f"{d}.0": d for d in DAYS}, "ds", "disposition", "time", "studyid = 'S1'", "other days"),
)
def dispositions_by_day(t: Tables):
    table = D.prepare_disposition(X.dispositions(t), prefer_decoded=False)
    return P.subjects_by(table.filter("studyid = 'S1'"), "disposition", "time", values=[float(d) for d in DAYS], other="other days")


@query(
    "responses_by_study",
    _subjects_sql({c: c for c in sorted(X.CLASSIFIED)}, "rs", "studyid", "who", "true"),
)
def responses_by_study(t: Tables):
    wide = D.numeric_time(D.prepare_domain(X.responses(t), "rs", tests=["WHOMAL01_NA"]))
    return P.subjects_by(wide, "studyid", "whomal01_na", values=sorted(X.CLASSIFIED))


@query(
    "responses_by_day",
    _subjects_sql({f"{d}.0": d for d in DAYS}, "rs", "who", "time", "true", "other days"),
)
def responses_by_day(t: Tables):
    wide = D.numeric_time(D.prepare_domain(X.responses(t), "rs", tests=["WHOMAL01_NA"])).withColumnRenamed("whomal01_na", "who")
    return P.subjects_by(wide, "who", "time", values=[float(d) for d in DAYS], other="other days")


CLASSIFIED = {**{c: c for c in sorted(X.CLASSIFIED)}, "NA": None}


@query("merged_study_by_response", _subjects_sql(CLASSIFIED, "m4", "studyid", "who", "true", start=X.MERGED_SQL))
def merged_study_by_response(t: Tables):
    return P.subjects_by(merged_days(t), "studyid", "whomal01_na", values=list(CLASSIFIED.values()))


FOUND = {**{g: g for g in sorted(X.GENOTYPES)}, "NA": None}


@query("merged_response_by_genotype", _subjects_sql(FOUND, "m4", "who", "intp", "true", start=X.MERGED_SQL))
def merged_response_by_genotype(t: Tables):
    days = merged_days(t).withColumnRenamed("whomal01_na", "who")
    return P.subjects_by(days, "who", "intp_na", values=list(FOUND.values()))


STUDIES = {f"S{k}": f"S{k}" for k in range(5)}


@query(
    "decoded_disposition_by_study",
    _subjects_sql(STUDIES, "(SELECT usubjid, studyid, disposition_2 AS disposition FROM ds)", "disposition", "studyid", "true"),
)
def decoded_disposition_by_study(t: Tables):
    table = D.prepare_disposition(X.dispositions(t))
    return P.subjects_by(table, "disposition", "studyid", values=list(STUDIES.values()))


GENOTYPED = {"RECRUDESCENCE": "= 'RECRUDESCENCE'", "REINFECTION": "= 'REINFECTION'", "NA": "IS NULL"}


@query(
    "genotype_by_study",
    f"""{ANALYSIS_SQL}, w AS (SELECT studyid, {", ".join(f'count(DISTINCT usubjid) FILTER (WHERE intp {c}) AS "{n}"' for n, c in GENOTYPED.items())} FROM x GROUP BY studyid),
z AS (SELECT *, {" + ".join(f'"{n}"' for n in GENOTYPED)} AS "Total" FROM w)
SELECT * FROM z UNION ALL SELECT 'Total', {", ".join(f'CAST(sum("{n}") AS BIGINT)' for n in [*GENOTYPED, "Total"])} FROM z""",
)
def genotype_by_study(t: Tables):
    return P.genotype_by_study(_analysis(t))


@query(
    "recrudescence_in_patient_set",
    f"""WITH {X.PATIENTS_SQL} SELECT sid, count(*) AS n, CAST(coalesce(sum(CASE WHEN outcome = 'LTFRC' THEN 1 WHEN outcome <> 'LTFRC' THEN 0 END), 0) AS BIGINT) AS failure
FROM p WHERE ageyears < 5 GROUP BY sid""",
)
def recrudescence_in_patient_set(t: Tables):
    return P.recrudescence_in_patient_set(X.patients(t))


@query(
    "registry_without_source",
    f"WITH {X.PATIENTS_SQL}, {X.REGISTRY_SQL}, {X.D_SQL} SELECT DISTINCT sid FROM g WHERE sid NOT IN (SELECT sid FROM p) AND sid NOT IN (SELECT studyid FROM d)",
)
def registry_without_source(t: Tables):
    return P.registry_without_source(X.registry(t), X.patients(t), X.days(t).select("studyid"))


@query(
    "patients_by_publication",
    f"WITH {X.PATIENTS_SQL}, {X.REGISTRY_SQL} SELECT sid, pubmed, count(*) AS n FROM p JOIN g USING (sid) WHERE sid_inv IS NOT NULL GROUP BY sid, pubmed",
)
def patients_by_publication(t: Tables):
    return P.patients_by_publication(X.patients(t), X.registry(t))


@query(
    "arms_by_age",
    f"""{ANALYSIS_SQL} SELECT act_name, CASE WHEN age < 2 THEN '< 2' WHEN age >= 2 THEN '≥ 2' END AS age_5, count(DISTINCT (studyid, usubjid)) AS participants
FROM x GROUP BY 1, 2""",
)
def arms_by_age(t: Tables):
    return P.arms_by_age(_analysis(t).withColumn("age_5", if_else(F.col("age") < 2, "< 2", "≥ 2")))


SHOWN = ["ACPR", "INDETERMINATE", "LOST TO FOLLOW-UP", "LTF", "OTHERS", "RECRUDESCENCE", "REINFECTION"]


@query(
    "outcome_by_study",
    f"""{ANALYSIS_SQL}, c AS (SELECT studyid, outcome_2, count(DISTINCT usubjid) AS n FROM x WHERE outcome_2 IS NOT NULL GROUP BY ALL)
SELECT studyid, {", ".join(f"CAST(sum(n) FILTER (WHERE outcome_2 = '{o}') AS BIGINT) AS \"{o}\"" for o in SHOWN)}, CAST(sum(n) AS BIGINT) AS "Total"
FROM c GROUP BY studyid""",
)
def outcome_by_study(t: Tables):
    return P.outcome_by_study(_analysis(t))


@query(
    "outcome_shares",
    f"""{ANALYSIS_SQL}, c AS (SELECT studyid, outcome_2, count(DISTINCT usubjid) AS n FROM x WHERE outcome_2 IN ({", ".join(map(S.quote, P.SHOWN_OUTCOMES))}) GROUP BY ALL),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY studyid) AS BIGINT) AS total_n FROM c),
r AS (SELECT studyid, CAST(row_number() OVER (ORDER BY total_n, studyid) AS INTEGER) AS group_rank FROM (SELECT DISTINCT studyid, total_n FROM s))
SELECT s.studyid, outcome_2, n, total_n, round(n / total_n, 10) AS prop, group_rank FROM s JOIN r USING (studyid)""",
)
def outcome_shares(t: Tables):
    return P.outcome_shares(_analysis(t)).withColumn("prop", F.round("prop", 10))


@query("baseline_median_by_arm", f"{ANALYSIS_SQL} SELECT act_name, median(pfmicl) AS median FROM x WHERE time = 1 GROUP BY act_name")
def baseline_median_by_arm(t: Tables):
    return P.baseline_median(_analysis(t))


STUDY_ARMS = {"act_name_AL": R.AL, "act_name_AS_AQ": R.AS_AQ, "act_name_DHA_PPQ": R.DHA_PPQ, "act_name_AS_MQ": R.AS_MQ}


@query(
    "study_table",
    f"""{ANALYSIS_SQL}, p AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY studyid, usubjid ORDER BY _row) = 1),
g AS (SELECT studyid, count(DISTINCT usubjid) AS n, CASE WHEN count(*) = count(age_years) THEN median(age_years) END AS middle,
  {", ".join(f"CASE WHEN count(*) = count(sex) THEN count(*) FILTER (WHERE sex = '{s}') END AS n_{s}" for s in "FM")},
  {", ".join(f"count(*) FILTER (WHERE act_name = {S.quote(a)}) AS {n}" for n, a in STUDY_ARMS.items())} FROM p GROUP BY studyid)
SELECT studyid, n, {", ".join(STUDY_ARMS)}, {S.half_even("middle", 1)} AS age,
  {", ".join(f"CASE WHEN n_{s} = 0 THEN '' ELSE CAST(n_{s} AS VARCHAR) END AS sex_{s}" for s in "FM")},
  CAST(row_number() OVER (ORDER BY n DESC, studyid) AS INTEGER) AS num FROM g""",
)
def study_table(t: Tables):
    return P.study_table(_analysis(t), ["_row"])


@query("subject_conditions", f"{ANALYSIS_SQL} SELECT DISTINCT studyid, usubjid, outcome_2 AS condition FROM x WHERE outcome_2 IS NOT NULL")
def subject_conditions(t: Tables):
    return P.subject_conditions(_analysis(t))


@query(
    "baseline_table",
    f"""{ANALYSIS_SQL}, k AS (SELECT DISTINCT studyid, usubjid, outcome_2 AS condition FROM x WHERE outcome_2 IS NOT NULL),
y AS (SELECT act_name, age, pfmicl, CASE WHEN gender IS NULL OR gender = '' THEN 'No data' ELSE gender END AS gender,
        CASE WHEN pfmicl = 0 THEN '0 ~ Negative' WHEN pfmicl > 0 THEN '≥1 ~ Positive' ELSE 'No data/Not measured' END AS parasitaemia,
        coalesce({S.case_map("condition", {"ACPR": "Acpr", "RECRUDESCENCE": "Recrudescence", "REINFECTION": "Reinfection", "LTF": "Ltf", "LOST TO FOLLOW-UP": "Lost To Follow-Up", "OTHERS": "Others", "INDETERMINATE": "Indeterminate"})}, 'NPI') AS condition
      FROM x LEFT JOIN k USING (studyid, usubjid) WHERE time = 1),
c AS (SELECT unnest([{{variable: 'gender', level: gender}}, {{variable: 'parasitaemia', level: parasitaemia}}, {{variable: 'condition', level: condition}}], recursive := true), act_name FROM y),
n AS (SELECT l.variable, l.level, a.act_name, count(c.variable) AS n FROM (SELECT DISTINCT variable, level FROM c WHERE level IS NOT NULL) l
      CROSS JOIN (SELECT DISTINCT act_name FROM c) a LEFT JOIN c ON c.variable = l.variable AND c.level = l.level AND c.act_name IS NOT DISTINCT FROM a.act_name GROUP BY ALL),
v AS (SELECT 'age' AS variable, act_name, age AS v FROM y WHERE age IS NOT NULL UNION ALL SELECT 'pfmicl', act_name, pfmicl FROM y WHERE pfmicl IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY variable, act_name ORDER BY v) AS rn, count(*) OVER (PARTITION BY variable, act_name) AS n FROM v)
SELECT variable, level, act_name, n, round(n / nullif(sum(n) OVER (PARTITION BY variable, act_name), 0), 10) AS share, NULL::DOUBLE AS median FROM n
UNION ALL SELECT variable, NULL, act_name, max(n), NULL, round(median(v), 8) FROM r GROUP BY variable, act_name""",
)
def baseline_table(t: Tables):
    table = P.baseline_table(_analysis(t))
    return table.select("variable", "level", "act_name", "n", F.round("share", 10).alias("share"), F.round("median", 8).alias("median"))


DETECTED = {"0 ~ Negative": "= 0", "≥1 ~ Positive": "> 0", "No data/Not measured": "IS NULL"}


@query(
    "detection_by_genotype",
    f"""{ANALYSIS_SQL}, y AS (SELECT true AS met, * FROM x WHERE time = 29), a AS (SELECT DISTINCT act_name FROM y), i AS (SELECT DISTINCT intp FROM y)
SELECT a.act_name, i.intp, {", ".join(f'count(*) FILTER (WHERE met AND pfmicl {c}) AS "{n}"' for n, c in DETECTED.items())}
FROM a CROSS JOIN i LEFT JOIN y ON a.act_name IS NOT DISTINCT FROM y.act_name AND i.intp IS NOT DISTINCT FROM y.intp GROUP BY a.act_name, i.intp""",
)
def detection_by_genotype(t: Tables):
    return P.detection_by_genotype(_analysis(t))


@query(
    "density_histogram",
    f"""{ANALYSIS_SQL}, h AS (SELECT act_name, intp, log10(pfmicl) AS v FROM x WHERE time = 1 AND pfmicl > 0 AND intp IS NOT NULL),
s AS (SELECT min(v) AS lo, (max(v) - min(v)) / 29.0::DOUBLE AS w FROM h),
b AS (SELECT act_name, intp, CAST(greatest(0, least(29, ceil((v - lo) / w - 0.5::DOUBLE))) AS INTEGER) AS bin FROM h, s),
f AS (SELECT DISTINCT act_name, intp FROM b), g AS (SELECT CAST(unnest(range(30)) AS INTEGER) AS bin)
SELECT f.act_name, f.intp, g.bin, (SELECT count(*) FROM b WHERE b.bin = g.bin AND b.act_name IS NOT DISTINCT FROM f.act_name AND b.intp = f.intp) AS n FROM f, g""",
)
def density_histogram(t: Tables):
    return P.density_histogram(_analysis(t)).select("act_name", "intp", "bin", "n")


@query(
    "high_density_boxes",
    f"""{ANALYSIS_SQL}, y AS (SELECT CAST(time AS VARCHAR) AS time, act_name, pfmicl AS v FROM x WHERE pfmicl > 100000 AND time IN (1, 2, 3, 7, 14, 29, 43)),
q AS (SELECT time, act_name, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3, count(*) AS n FROM y GROUP BY ALL)
SELECT time, act_name, n, min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS whisker_low, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM y JOIN q USING (time, act_name) GROUP BY time, act_name, n, q1, median, q3""",
)
def high_density_boxes(t: Tables):
    return P.high_density_boxes(_analysis(t)).withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    "recurrence_curve_by_arm",
    f"""{ANALYSIS_SQL}, i AS (SELECT DISTINCT studyid, usubjid, time, CASE WHEN outcome_2 = 'RECRUDESCENCE' THEN 1 ELSE 0 END AS e, act_name
       FROM x WHERE outcome_2 IS NOT NULL AND time < 50),
c AS (SELECT act_name, time, CAST(sum(e) AS BIGINT) AS n_event, count(*) AS n FROM i GROUP BY ALL),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY act_name ORDER BY time DESC) AS BIGINT) AS n_risk FROM c)
SELECT act_name, time, n_risk, n_event, round(product(1 - n_event / n_risk) OVER (PARTITION BY act_name ORDER BY time), 9) AS surv FROM r""",
)
def recurrence_curve_by_arm(t: Tables):
    curve = P.recurrence_curve(_analysis(t), ["act_name"])
    return curve.select("act_name", "time", "n_risk", "n_event", F.round("surv", 9).alias("surv"))


@query(
    "final_extract",
    f"{ANALYSIS_SQL} SELECT studyid, usubjid, age_years, sex, time, pfmicl, origin, outcome_2, act_name FROM x WHERE outcome_2 IS NOT NULL",
)
def final_extract(t: Tables):
    return P.final_extract(_analysis(t))


@query(
    "recrudescence_by_age",
    X.OBSERVED_SQL
    + """ SELECT CASE WHEN ageyears < 5 THEN '<5' WHEN ageyears >= 5 THEN '5 and >' END AS age_5, count(*) FILTER (WHERE pcr = 'RC') AS failures FROM ob GROUP BY 1""",
)
def recrudescence_by_age(t: Tables):
    table = P.recrudescence_by_age(C.merge_observations(_observations(t)))
    return table.withColumn("failures", F.col("failures").cast("bigint"))


@query(
    "quality_profile",
    X.OBSERVED_SQL
    + f"""
SELECT 'last day ' || coalesce(CAST(CAST(lastdayfup AS INTEGER) AS VARCHAR), 'NA') AS item, count(*) AS n FROM ob GROUP BY 1
UNION ALL SELECT 'missing last day', CAST(count(*) FILTER (WHERE lastdayfup IS NULL) AS BIGINT) FROM ob
UNION ALL SELECT 'missing baseline', count(*) FILTER (WHERE {S.number("pfmicl")} IS NULL) FROM ob WHERE dayofobs = 0
UNION ALL SELECT 'followed 28', count(DISTINCT pid) FROM ob WHERE dayofobs > 27
UNION ALL SELECT 'under five', count(DISTINCT pid) FROM ob WHERE ageyears < 5""",
)
def quality_profile(t: Tables):
    parts = P.quality_profile(C.merge_observations(_observations(t)))
    day = F.coalesce(F.col("lastdayfup").cast("int").cast("string"), F.lit("NA"))
    last = parts["last_days"].select(F.concat(F.lit("last day "), day).alias("item"), "n")

    def total(name, label):
        return parts[name].agg(F.sum("n_missing").alias("n")).select(F.lit(label).alias("item"), "n")

    def subjects(name, label):
        return parts[name].select(F.lit(label).alias("item"), "n")

    rest = [
        total("missing_last_day", "missing last day"),
        total("missing_baseline", "missing baseline"),
        subjects("followed_28", "followed 28"),
        subjects("under_five", "under five"),
    ]
    return reduce(DataFrame.unionByName, rest, last)


DESCRIBED_SQL = f"""
WITH {X.PATIENTS_SQL}, {X.REGISTRY_SQL}, q AS (SELECT *, {detailed_sql("treat")} AS treat_2, {code_class_sql("treat")} AS act_category,
       CASE WHEN ageyears < 5 THEN '<5y' WHEN ageyears >= 5 THEN '5y >' END AS age_5, {S.case_bands("lastday", bands.FOLLOW_UP_BANDS)} AS day_28 FROM p)"""


def _described(t: Tables) -> DataFrame:
    return P.describe_patients(P.in_registry(X.patients(t), X.registry(t), "sid_inv"))


@query(
    "patient_age_by_follow_up",
    DESCRIBED_SQL
    + """ SELECT age_5, count(*) FILTER (WHERE day_28 = '<28') AS "<28", count(*) FILTER (WHERE day_28 = '28') AS "28", count(*) FILTER (WHERE day_28 = '>28') AS ">28",
       count(*) FILTER (WHERE day_28 IS NULL) AS "NA_" FROM q JOIN g USING (sid) WHERE sid_inv IS NOT NULL GROUP BY age_5""",
)
def patient_age_by_follow_up(t: Tables):
    return cross_frequency(_described(t), "age_5", "day_28", [*bands.labels(bands.FOLLOW_UP_BANDS), None])


@query(
    "eligible_patients",
    DESCRIBED_SQL
    + """ SELECT treat, treat_2, count(*) AS n, count(*) FILTER (WHERE pfmicl0 > 250000) AS n_hyper, count(DISTINCT sid) AS n_studies FROM q JOIN g USING (sid)
  WHERE sid_inv IS NOT NULL AND age_5 = '<5y' AND day_28 = '28' AND act_category = 'ACT' GROUP BY treat, treat_2""",
)
def eligible_patients(t: Tables):
    kept = P.eligible_patients(_described(t))
    return kept.groupBy("treat", "treat_2").agg(
        n_rows().alias("n"),
        F.count_if(F.col("pfmicl0") > P.HYPER_DENSITY).alias("n_hyper"),
        n_distinct("sid").alias("n_studies"),
    )


@query(
    "patients_above_density",
    DESCRIBED_SQL + " SELECT pfmicl0 > 100000 AS above, count(*) AS n FROM q JOIN g USING (sid) WHERE sid_inv IS NOT NULL AND pfmicl0 IS NOT NULL GROUP BY 1",
)
def patients_above_density(t: Tables):
    return P.above_density(_described(t))


@query(
    "studies_by_size",
    f"""WITH {X.PATIENTS_SQL}, {X.REGISTRY_SQL}, c AS (SELECT sid, count(*) AS n FROM p JOIN g USING (sid) WHERE data_format = 'Mapped' GROUP BY sid)
SELECT sid, n, round(n / (SELECT sum(n) FROM c), 10) AS percent, round(n / (SELECT sum(n) FROM c), 10) AS valid_percent FROM c""",
)
def studies_by_size(t: Tables):
    table = frequency(P.in_format(X.patients(t), X.registry(t), "Mapped"), "sid")
    return table.withColumns({c: F.round(c, 10) for c in ("percent", "valid_percent")})


@query(
    "study_coverage",
    f"""WITH {X.PATIENTS_SQL}, {X.REGISTRY_SQL}, {X.D_SQL}, s AS (SELECT sid, true AS a, false AS b, false AS c FROM g
  UNION ALL SELECT sid, false, true, false FROM p UNION ALL SELECT studyid, false, false, true FROM d)
SELECT sid, bool_or(a) AS in_registry, bool_or(b) AS in_patient_set, bool_or(c) AS in_trials FROM s GROUP BY sid""",
)
def study_coverage(t: Tables):
    return P.study_coverage(X.registry(t), X.patients(t), X.days(t).select("studyid"))


@query(
    "studies_without_patients",
    f"WITH {X.PATIENTS_SQL}, {X.REGISTRY_SQL} SELECT DISTINCT sid FROM g WHERE sid NOT IN (SELECT sid FROM p)",
)
def studies_without_patients(t: Tables):
    return P.studies_not_in(X.registry(t), X.patients(t))

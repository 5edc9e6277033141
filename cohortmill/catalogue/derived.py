"""Study-like tables derived from the shared tables, in Spark and in SQL.

Events stand in for findings, event users for subjects, orders for observations of the
final cohort. Everything grows with the shared tables. Missing values are injected by
rules on the ids, the same in both dialects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.catalogue import Tables
from cohortmill.catalogue import sqltext as S
from cohortmill.plans.regimens import MAIN_ACTS

EVENT_DAY_SQL = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER)"

ARMS = [
    "ARTEMETHER LUMEFANTRINE",
    "Artemether-Lumefantrine  + Primaquine",
    "Amodiaquine Artesunate",
    "ARTESUNATE + AMODIAQUINE",
    "DIHYDROARTEMISININ-PIPERAQUINE",
    "artenimol piperaquine",
    "ARTESUNATE AMODIAQUINE CHLORPHENIRAMINE",
    "CHLOROQUINE",
    None,
    "ARTHEMETHER LUMEFANTRINE",
    " Artesunate + Mefloquine ",
    "Artemisinin + Naphthoquine",
    "Artesunate–Mefloquine",
    "Dihydroartemisinin — Piperaquine",
    "Artemether Lumefantrine",
]
COUNTRY_CODES = ["AGO", "BEN", "BFA", "CIV", "CMR", "GAB", "KEN", "MOZ", "NER", "NGA", "RWA", "SEN", "UGA", "ZMB", "XXX", None]
CODES = [
    "AL", "AL3", "AL_6", "AL_adult", "AL_PQ", "AL3+PQh0", "AS", "AQ", "AS+AQ", "ASAQ", "AS+AQ(1)FDC", "AS3+AQ-nFDC",
    "AS+SP", "AS3+SP", "AS+SMP", "ASMQ", "ASMQ_child", "AQ+SP", "CQ", "CQ - double dose", "ART+NQ", "DHA-PPQ", "DHAPQPa",
    "DHAPPQb", "DP", "SP", "NA", None, "NEW+DRUG",
]
GENOTYPES = ["RECRUDESCENCE", "REINFECTION", "INDETERMINATE"]
CLASSIFIED = ["ACPR", "LATE TREATMENT FAILURE", "LATE PARASITOLOGICAL FAILURE", "EARLY TREATMENT FAILURE", "LATE CLINICAL FAILURE"]
TERMS = [
    "ACPR", "LATE PARASITOLOGICAL FAILURE", "ADEQUATE PARASITOLOGICAL AND CLINICAL RESPONSE", "ETF", "LCF", "LPF", "COMPLETED",
    "ADVERSE EVENT", "OTHER ANTI-MALARIAL", "EXCLUDED", "LATE CLINICAL FAILURE", "LOST TO FOLLOW-UP", "WITHDREW CONSENT", None,
    "EARLY TREATMENT FAILURE", "LATE TREATMENT FAILURE",
]
DAYS = [1, 2, 3, 8, 15, 29, 43]
OUTCOMES = ["ACPR", "RECRUDESCENCE", "REINFECTION", "  ", None, "LTF", "LOST TO FOLLOW-UP", "OTHERS", " INDETERMINATE"]


def event_day() -> Column:
    """Day of an event, the first day being 1."""
    return F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + 1


def pick(values: list, index: Column) -> Column:
    """One of a fixed list, by a number starting at 0; the twin is ``sqltext.pick``."""
    listed = ", ".join("NULL" if v is None else f'"{v}"' if isinstance(v, str) else str(v) for v in values)
    return F.element_at(F.expr(f"array({listed})"), (index % len(values) + 1).cast("int"))


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


# --- study domains -------------------------------------------------------------------

D_SQL = f"""d AS (SELECT *, {EVENT_DAY_SQL} AS day, 'S' || (user_id % 5) AS studyid, 'P' || user_id AS usubjid,
             'M' || (user_id % 4) AS sid, 'Q' || user_id AS pid FROM events)"""


def days(t: Tables) -> DataFrame:
    user = F.col("user_id")
    return t.events.select(
        "*",
        event_day().alias("day"),
        _text("S", user % 5).alias("studyid"),
        _text("P", user).alias("usubjid"),
        _text("M", user % 4).alias("sid"),
        _text("Q", user).alias("pid"),
    )


def demographics(t: Tables) -> DataFrame:
    user = F.col("user_id")
    return (
        days(t)
        .select("studyid", "usubjid", "user_id")
        .distinct()
        .select(
            "studyid",
            "usubjid",
            (user % 90).cast("double").alias("age"),
            pick(["YEARS", "MONTHS", "WEEKS", None], user).alias("ageu"),
            pick(["F", "M", "U"], user).alias("sex"),
            pick(ARMS, user).alias("arm"),
            pick(COUNTRY_CODES, user).alias("country"),
        )
    )


DM_SQL = f"""dm AS (SELECT studyid, usubjid,
    (user_id % 90) / CASE user_id % 4 WHEN 1 THEN 12.0::DOUBLE WHEN 2 THEN 365.25::DOUBLE / 7 ELSE 1.0::DOUBLE END AS age_years,
    {S.pick(["F", "M", None], "user_id % 3")} AS sex, {S.pick(ARMS, f"user_id % {len(ARMS)}")} AS arm,
    {S.pick(COUNTRY_CODES, f"user_id % {len(COUNTRY_CODES)}")} AS country
  FROM (SELECT DISTINCT studyid, usubjid, user_id FROM d))"""


def _finding(t: Tables, code: str, kinds: list[str], test: Column, result: dict[str, Column], unit: Column) -> DataFrame:
    event, day = F.col("event_id"), F.col("day")
    blank = F.lit(None).cast("string")
    columns = {
        f"{code}testcd": test,
        f"{code}stresn": result.get("stresn", F.lit(None).cast("double")),
        f"{code}stresc": blank,
        f"{code}orres": result.get("orres", blank),
        f"{code}stresu": unit,
        f"{code}orresu": blank,
        f"{code}hr": F.when(event % 13 == 0, event % 24).cast("double"),
        f"{code}dy": F.when(event % 17 != 0, day).cast("double"),
        f"{code}method": pick(["MICROSCOPY", "PCR", None], event),
        "visitdy": F.when(event % 19 != 0, day).cast("double"),
        "visitnum": (event % 6).cast("double"),
        "visit": _text("V", event % 6),
        "epoch": F.lit("TREATMENT"),
        "seq": (event % 3).cast("int"),
    }
    chosen = days(t).filter(F.col("event_type").isin(kinds))
    return chosen.select("studyid", "usubjid", event.alias("_row"), *[c.alias(n) for n, c in columns.items()])


def microbiology(t: Tables) -> DataFrame:
    test = F.when(F.col("event_type") == "view", "PFALCIPA").otherwise("PFALCIPS")
    value = F.when(F.col("event_id") % 8 != 0, F.col("value"))
    frame = _finding(t, "mb", ["view", "click"], test, {"stresn": value}, F.lit("10^6/L"))
    empty = {"mbstdy": "double", "mbevlint": "string", "mbevintx": "string"}
    return frame.withColumns({n: F.lit(None).cast(k) for n, k in empty.items()})


def genotyping(t: Tables) -> DataFrame:
    result = {"orres": pick(GENOTYPES, F.col("event_id"))}
    return _finding(t, "pf", ["signup"], F.lit("INTP"), result, F.lit(None).cast("string"))


def responses(t: Tables) -> DataFrame:
    result = {"orres": pick(CLASSIFIED, F.col("event_id"))}
    return _finding(t, "rs", ["error"], F.lit("WHOMAL01"), result, F.lit(None).cast("string"))


def vital_signs(t: Tables) -> DataFrame:
    test = pick(["WEIGHT", "HEIGHT", "TEMP"], F.col("event_id"))
    return _finding(t, "vs", ["purchase"], test, {"stresn": F.col("value")}, pick(["kg", "cm", "C"], F.col("event_id")))


def dispositions(t: Tables) -> DataFrame:
    event = F.col("event_id")
    chosen = days(t).filter(F.col("event_type").isin("signup", "error"))
    return chosen.select(
        "studyid",
        "usubjid",
        event.alias("_row"),
        pick(TERMS, event).alias("dsterm"),
        F.lit(None).cast("string").alias("dsmodify"),
        F.when(event % 3 == 0, pick(TERMS, event + 5)).alias("dsdecod"),
        F.col("day").cast("double").alias("visitdy"),
    )


def interventions(t: Tables) -> DataFrame:
    event = F.col("event_id")
    chosen = days(t).filter(F.col("event_type") == "click")
    return chosen.select(
        "studyid",
        "usubjid",
        event.alias("_row"),
        pick(CODES, event).alias("intrt"),
        F.lit(None).cast("string").alias("indecod"),
        pick(["ANTIMALARIAL", "OTHER"], F.floor(event / 4)).alias("inclas"),
        F.lit("mg").alias("indosu"),
        F.col("day").cast("double").alias("visitdy"),
        (event % 6).cast("double").alias("visitnum"),
    )


def _wide_sql(name: str, kinds: str, day: str, columns: str) -> str:
    return (
        f"{name} AS (SELECT studyid, usubjid, {day} AS time, {columns}, min(event_id) AS r_{name} "
        f"FROM d WHERE event_type IN ({kinds}) GROUP BY ALL)"
    )


def first_sql(value: str, condition: str = "true") -> str:
    return f"arg_min_null({value}, event_id) FILTER (WHERE {condition})"


VISIT_DAY_SQL = "CAST(CASE WHEN event_id % 19 <> 0 THEN day END AS DOUBLE)"
COUNT_SQL = "CASE WHEN event_id % 8 <> 0 THEN value END"
IS_VIEW, IS_CLICK = "event_type = 'view'", "event_type = 'click'"
WIDE_SQL = ",\n".join(
    [
        _wide_sql(
            "mb",
            "'view', 'click'",
            "CAST(CASE WHEN event_id % 17 <> 0 THEN day END AS DOUBLE)",
            f"{first_sql(COUNT_SQL, IS_VIEW)} AS pfmicl, "
            f"{first_sql(COUNT_SQL, IS_CLICK)} AS gfmicl",
        ),
        _wide_sql("pf", "'signup'", VISIT_DAY_SQL, f"{first_sql(S.pick(GENOTYPES, 'event_id % 3'))} AS intp"),
        _wide_sql("rs", "'error'", VISIT_DAY_SQL, f"{first_sql(S.pick(CLASSIFIED, 'event_id % 5'))} AS who"),
        _wide_sql(
            "vs",
            "'purchase'",
            VISIT_DAY_SQL,
            ", ".join(
                f"{first_sql('value', f'event_id % 3 = {i}')} AS {n}" for i, n in enumerate(["weight_kg", "height_cm", "temp_c"])
            ),
        ),
        f"""ds AS (SELECT studyid, usubjid, CAST(day AS DOUBLE) AS time, {S.pick(TERMS, "event_id % 16")} AS disposition,
                  coalesce(CASE WHEN event_id % 3 = 0 THEN {S.pick(TERMS, "(event_id + 5) % 16")} END, {S.pick(TERMS, "event_id % 16")}) AS disposition_2
           FROM d WHERE event_type IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY studyid, usubjid, day ORDER BY event_id) = 1)""",
        f"""ints AS (SELECT studyid, usubjid, CAST(day AS DOUBLE) AS visitdy, {S.pick(CODES, f"event_id % {len(CODES)}")} AS intrt,
                  {S.pick(["ANTIMALARIAL", "OTHER"], "event_id // 4 % 2")} AS inclas, CAST(event_id % 6 AS DOUBLE) AS visitnum, event_id AS r_in
           FROM d WHERE event_type = 'click'
           QUALIFY row_number() OVER (PARTITION BY studyid, usubjid, day, event_id // 4 % 2 ORDER BY event_id) = 1)""",
    ]
)


def _same(left: str, right: str, keys=("studyid", "usubjid", "time")) -> str:
    return " AND ".join(f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in keys)


def _keys(left: str, right: str, keys=("studyid", "usubjid", "time")) -> str:
    return ", ".join(f"coalesce({left}.{k}, {right}.{k}) AS {k}" for k in keys)


MERGED_SQL = f"""
WITH {D_SQL}, {DM_SQL}, {WIDE_SQL},
m0 AS (SELECT mb.*, age_years, sex, arm, country, intrt, inclas, visitnum, r_in FROM mb
       LEFT JOIN dm ON mb.studyid = dm.studyid AND mb.usubjid = dm.usubjid
       LEFT JOIN ints i ON mb.studyid = i.studyid AND mb.usubjid = i.usubjid AND mb.time IS NOT DISTINCT FROM i.visitdy),
m1 AS (SELECT {_keys("m", "pf")}, m.* EXCLUDE (studyid, usubjid, time), intp, r_pf FROM m0 m FULL JOIN pf ON {_same("m", "pf")}),
m2 AS (SELECT {_keys("m", "rs")}, m.* EXCLUDE (studyid, usubjid, time), who, r_rs FROM m1 m FULL JOIN rs ON {_same("m", "rs")}),
m3 AS (SELECT {_keys("m", "vs")}, m.* EXCLUDE (studyid, usubjid, time), weight_kg, height_cm, temp_c, r_vs FROM m2 m FULL JOIN vs ON {_same("m", "vs")}),
m4 AS (SELECT m.*, disposition, disposition_2 FROM m3 m LEFT JOIN ds ON {_same("m", "ds")})"""
MERGED_ORDER = "r_mb NULLS LAST, r_in NULLS LAST, r_pf NULLS LAST, r_rs NULLS LAST, r_vs NULLS LAST"


# --- observation tables --------------------------------------------------------------

SITES = ["Kisumu", "Lambaréné", None]
HOUR_SQL = "CASE WHEN event_id % 5 <> 0 THEN 0 END"


def _observed(t: Tables, kind: str, columns: dict[str, Column], treatment: bool = False) -> DataFrame:
    event = F.col("event_id")
    day, hour = ("dayoftreat", "houroftreat") if treatment else ("dayofobs", "hourofobs")
    return (
        days(t)
        .filter(F.col("event_type") == kind)
        .select(
            "pid",
            "sid",
            pick(SITES, F.col("user_id")).alias("site"),
            (F.col("day") - 3).alias(day),
            F.when(event % 5 != 0, 0).alias(hour),
            event.alias("_row"),
            *[c.alias(n) for n, c in columns.items()],
        )
    )


def observation_tables(t: Tables) -> list[DataFrame]:
    event, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    number = value.cast("string")
    return [
        _observed(
            t,
            "view",
            {
                "id": _text("a", event),
                "disease": F.lit("malaria"),
                "ageyears": F.when(event % 10 != 0, (user % 30) / 4.0),
                "gender": pick(["F", "M", ""], user),
            },
        ),
        _observed(
            t,
            "click",
            {
                "id": _text("b", event),
                "disease": F.lit("fever"),
                "temp": value,
                "weight": value + 1,
                "height": value + 2,
                "lastdayfup": F.when(event % 6 != 0, (user % 43).cast("string")),
            },
        ),
        _observed(
            t,
            "error",
            {"id": _text("c", event), "pfmicl": F.when(event % 7 != 0, number).otherwise("NA"), "gfmicl": number},
        ),
        _observed(t, "signup", {"pcr": pick(["RC", "RI", None], event)}),
        _observed(t, "purchase", {"treat": pick(CODES, user * 7 + event % 2)}, treatment=True),
    ]


def patient_set(t: Tables) -> DataFrame:
    """One row per patient with a purchase: the day of the last one, and the outcome."""
    return (
        days(t)
        .filter(F.col("event_type") == "purchase")
        .groupBy("sid", "pid", "user_id")
        .agg((F.max("day") - 3).alias("lastday"))
        .select("sid", "pid", "lastday", pick(["LTFRC", "ACPR", "MissedD28", "LTFRI", "LowHb", "NoPfAtInc", None], F.col("user_id")).alias("outcome"))
    )


def patient_set_measures(t: Tables) -> DataFrame:
    """The patient set with more of its columns: a site of its own, a density and a day."""
    rows = days(t).filter(F.col("event_type") == "purchase").groupBy("sid", "pid", "user_id")
    measured = rows.agg((F.max("day") - 3).alias("lastday"), F.max("value").alias("pfmicl0"), F.min("day").alias("recurparday"))
    return measured.withColumn("site", pick(SITES, F.col("user_id") + 1))


def _observed_sql(name: str, kind: str, columns: str) -> str:
    return (
        f"{name} AS (SELECT pid, sid, {S.pick(SITES, 'user_id % 3')} AS site, day - 3 AS dayofobs, {HOUR_SQL} AS hourofobs, "
        f"{columns}, event_id AS r_{name} FROM d WHERE event_type = '{kind}')"
    )


OBS_KEYS = ("pid", "sid", "site", "dayofobs", "hourofobs")
OBSERVED_SQL = f"""
WITH {D_SQL},
{_observed_sql("su", "view", f"'a' || event_id AS id, 'malaria' AS disease, CASE WHEN event_id % 10 <> 0 THEN (user_id % 30) / 4.0::DOUBLE END AS ageyears, {S.pick(['F', 'M', ''], 'user_id % 3')} AS gender")},
{_observed_sql("cl", "click", "value AS temp, value + 1 AS weight, value + 2 AS height, CASE WHEN event_id % 6 <> 0 THEN CAST(user_id % 43 AS VARCHAR) END AS lastdayfup")},
{_observed_sql("pa", "error", "CASE WHEN event_id % 7 <> 0 THEN CAST(value AS VARCHAR) ELSE 'NA' END AS pfmicl, CAST(value AS VARCHAR) AS gfmicl")},
{_observed_sql("pc", "signup", f"{S.pick(['RC', 'RI', None], 'event_id % 3')} AS pcr")},
{_observed_sql("tr", "purchase", f"{S.pick(CODES, f'(user_id * 7 + event_id % 2) % {len(CODES)}')} AS treat")},
o1 AS (SELECT {_keys("m", "x", OBS_KEYS)}, id, disease, ageyears, gender, r_su, x.* EXCLUDE (pid, sid, site, dayofobs, hourofobs) FROM su m FULL JOIN cl x ON {_same("m", "x", OBS_KEYS)}),
o2 AS (SELECT {_keys("m", "x", OBS_KEYS)}, m.* EXCLUDE (pid, sid, site, dayofobs, hourofobs), x.* EXCLUDE (pid, sid, site, dayofobs, hourofobs) FROM o1 m FULL JOIN pa x ON {_same("m", "x", OBS_KEYS)}),
o3 AS (SELECT {_keys("m", "x", OBS_KEYS)}, m.* EXCLUDE (pid, sid, site, dayofobs, hourofobs), x.* EXCLUDE (pid, sid, site, dayofobs, hourofobs) FROM o2 m FULL JOIN pc x ON {_same("m", "x", OBS_KEYS)}),
o4 AS (SELECT {_keys("m", "x", OBS_KEYS)}, m.* EXCLUDE (pid, sid, site, dayofobs, hourofobs), x.* EXCLUDE (pid, sid, site, dayofobs, hourofobs) FROM o3 m FULL JOIN tr x ON {_same("m", "x", OBS_KEYS)}),
o5 AS (SELECT * FROM o4 QUALIFY row_number() OVER (PARTITION BY pid, sid, site, dayofobs, hourofobs
         ORDER BY r_su NULLS LAST, r_cl NULLS LAST, r_pa NULLS LAST, r_pc NULLS LAST, r_tr NULLS LAST) = 1),
ob AS (SELECT * FROM o5 WHERE NOT dayofobs < 0),
ps AS (SELECT sid, pid, max(day) - 3 AS lastday, {S.pick(["LTFRC", "ACPR", "MissedD28", "LTFRI", "LowHb", "NoPfAtInc", None], "user_id % 7")} AS outcome
       FROM d WHERE event_type = 'purchase' GROUP BY sid, pid, user_id),
oc AS (SELECT ob.* REPLACE (ob.dayofobs + 1 AS dayofobs), outcome FROM ob
       LEFT JOIN ps ON ob.sid = ps.sid AND ob.pid = ps.pid AND ob.dayofobs = ps.lastday)"""
OBSERVED_ORDER = "r_su NULLS LAST, r_cl NULLS LAST, r_pa NULLS LAST, r_pc NULLS LAST, r_tr NULLS LAST"


# --- final cohort, as rows of orders -------------------------------------------------


def cohort(t: Tables) -> DataFrame:
    order, who = F.col("o_orderkey"), F.col("o_custkey")
    age = F.when(who % 29 != 0, (who % 60) / 12.0)
    density = F.when(order % 11 == 1, 0.0).when(order % 11 != 0, F.floor(F.col("o_totalprice") * 2).cast("double"))
    return t.orders.select(
        _text("S", who % 40).alias("studyid"),
        _text("P", who).alias("usubjid"),
        pick(DAYS, order).cast("double").alias("time"),
        age.alias("age_years"),
        age.alias("age"),
        pick(["F", "M", None], who).alias("sex"),
        pick(["F", "M", "", None], who).alias("gender"),
        density.alias("pfmicl"),
        pick(MAIN_ACTS, who).alias("act_name"),
        pick(OUTCOMES, order).alias("outcome_2"),
        pick(["RECRUDESCENCE", "REINFECTION", None], order).alias("intp"),
        pick(["SDTM", "MAPPER"], who).alias("origin"),
        order.alias("_row"),
    )


COHORT_SQL = f"""x0 AS (SELECT 'S' || (o_custkey % 40) AS studyid, 'P' || o_custkey AS usubjid,
    CAST({S.pick(DAYS, "o_orderkey % 7")} AS DOUBLE) AS time, CASE WHEN o_custkey % 29 <> 0 THEN (o_custkey % 60) / 12.0::DOUBLE END AS age_years,
    CASE WHEN o_custkey % 29 <> 0 THEN (o_custkey % 60) / 12.0::DOUBLE END AS age,
    {S.pick(["F", "M", None], "o_custkey % 3")} AS sex, {S.pick(["F", "M", "", None], "o_custkey % 4")} AS gender,
    CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE floor(o_totalprice * 2) END AS pfmicl,
    {S.pick(MAIN_ACTS, "o_custkey % 4")} AS act_name, nullif(trim({S.pick(OUTCOMES, f"o_orderkey % {len(OUTCOMES)}")}), '') AS outcome_2,
    {S.pick(["RECRUDESCENCE", "REINFECTION", None], "o_orderkey % 3")} AS intp, {S.pick(["SDTM", "MAPPER"], "o_custkey % 2")} AS origin,
    o_orderkey AS _row FROM orders)"""


def patients(t: Tables) -> DataFrame:
    """A patient set: one row per patient-treatment, as rows of orders."""
    order, who = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        _text("S", who % 40).alias("sid"),
        _text("P", order).alias("pid"),
        pick(CODES, order).alias("treat"),
        F.when(who % 13 != 0, (who % 40) / 4.0).alias("ageyears"),
        F.when(order % 17 != 0, (order % 12 + 22)).cast("int").alias("lastday"),
        F.when(order % 9 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("pfmicl0"),
        pick(["LTFRC", "ACPR", "LTFRI", None], order).alias("outcome"),
    )


PATIENTS_SQL = f"""p AS (SELECT 'S' || (o_custkey % 40) AS sid, 'P' || o_orderkey AS pid, {S.pick(CODES, f"o_orderkey % {len(CODES)}")} AS treat,
    CASE WHEN o_custkey % 13 <> 0 THEN (o_custkey % 40) / 4.0::DOUBLE END AS ageyears,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 12 + 22 AS INTEGER) END AS lastday,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS pfmicl0, {S.pick(["LTFRC", "ACPR", "LTFRI", None], "o_orderkey % 4")} AS outcome FROM orders)"""


def registry(t: Tables) -> DataFrame:
    """Study registry: some studies no patient has, some without an investigator."""
    number = F.col("c_custkey") % 50
    return (
        t.customer.select(number.alias("k"))
        .distinct()
        .select(
            _text("S", F.col("k")).alias("sid"),
            F.when(F.col("k") % 7 != 0, _text("inv", F.col("k"))).alias("sid_inv"),
            pick(["Mapped", "Domains"], F.col("k")).alias("data_format"),
            F.when(F.col("k") % 3 != 0, _text("PM", F.col("k") % 20)).alias("pubmed"),
        )
    )


REGISTRY_SQL = f"""g AS (SELECT 'S' || k AS sid, CASE WHEN k % 7 <> 0 THEN 'inv' || k END AS sid_inv, {S.pick(["Mapped", "Domains"], "k % 2")} AS data_format,
      CASE WHEN k % 3 <> 0 THEN 'PM' || (k % 20) END AS pubmed FROM (SELECT DISTINCT c_custkey % 50 AS k FROM customer))"""

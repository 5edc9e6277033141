"""The whole path from study files to report tables, with conservation checks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import study_files
from cohortmill.plans import cohort as C
from cohortmill.plans import domains as D
from cohortmill.plans import reports as P
from cohortmill.sources import files as S
from cohortmill.sources import schemas

PATIENTS = "sid string, pid string, site string, treat string, outcome string, ageyears double, lastday int, pfmicl0 string"


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    return study_files.write_study(tmp_path_factory.mktemp("study files"))


def read_domain(spark, paths, code):
    table = S.read_table(spark, paths[code], schemas.DOMAINS[code], row_order=True)
    return S.normalise_domain(table, None if code == "DM" else code)


def read_days(spark, paths):
    domain = {code: read_domain(spark, paths, code) for code in schemas.DOMAINS if code in paths}

    def wide(code, timing=("visitdy",), tests=None):
        return D.numeric_time(D.prepare_domain(domain[code], code, timing, tests))

    days = D.merge_subject_days(
        D.prepare_domain(domain["MB"], "MB", ["mbdy"]),
        D.prepare_demographics(domain["DM"]),
        D.prepare_interventions(domain["IN"]),
        wide("PF").drop("time_source"),
        wide("RS").drop("time_source"),
        wide("VS").drop("time_source"),
        D.prepare_disposition(domain["DS"], prefer_decoded=False),
    )
    return days, D.prepare_disposition(domain["DS"])


def read_observations(spark, paths):
    tables = [S.read_latin1(spark, paths[n], schemas.OBSERVATIONS[n], "na_only", row_order=True) for n in schemas.OBSERVATIONS]
    patients = S.read_latin1(spark, paths["patients"], PATIENTS)
    return tables, patients


def build(spark, paths):
    trials = C.curate_trials(*read_days(spark, paths))
    tables, patients = read_observations(spark, paths)
    observed = C.curate_observations(C.classify_observations(C.attach_outcome(C.merge_observations(tables), patients)))
    countries = S.read_lookup(spark, paths["countries"], schemas.COUNTRIES)
    return trials, observed, countries


@pytest.fixture(scope="module")
def built(spark, paths):
    trials, observed, countries = build(spark, paths)
    return S.stage(trials), S.stage(observed), countries


def test_domain_row_order_survives_cleaning(spark, paths):
    mb = read_domain(spark, paths, "MB")
    assert S.ROW in mb.columns and "seq" in mb.columns and "domain" not in mb.columns
    firsts = mb.orderBy(S.ROW).select("seq").limit(3).collect()
    assert [r["seq"] for r in firsts][0] == 1


def test_prepared_domain_has_one_row_per_key(spark, paths):
    wide = D.prepare_domain(read_domain(spark, paths, "MB"), "MB", ["mbdy"])
    assert {"pfalcipa_10_6_l", "pfalcips_10_6_l", "other_na"} <= set(wide.columns)
    assert wide.groupBy("studyid", "usubjid", "time", "time_source").count().filter("count > 1").count() == 0


def test_trials_hold_only_act_subjects_with_baseline_counts(spark, paths, built):
    trials = built[0]
    assert trials.count() > 0
    assert trials.filter("time = 1 AND pfmicl IS NULL").count() == 0
    arms = {r["arm_2"] for r in trials.select("arm_2").distinct().collect()}
    assert "CHLOROQUINE" not in arms
    assert trials.filter("sex = 'U'").count() == 0


def test_observations_are_unique_and_start_at_day_one(spark, paths):
    tables, patients = read_observations(spark, paths)
    merged = C.merge_observations(tables)
    assert merged.groupBy(*C.OBSERVATION_KEYS).count().filter("count > 1").count() == 0
    assert merged.filter("dayofobs < 0").count() == 0
    keys = None
    for t in tables:
        k = t.withColumnsRenamed({"dayoftreat": "dayofobs", "houroftreat": "hourofobs"}).select(*C.OBSERVATION_KEYS)
        keys = k if keys is None else keys.unionByName(k)
    assert merged.count() == keys.filter("dayofobs >= 0").distinct().count()
    aligned = C.attach_outcome(merged, patients)
    assert aligned.agg(F.min("dayofobs")).first()[0] == 1
    late = aligned.filter("outcome IS NOT NULL").join(patients.select("sid", "pid", "lastday"), ["sid", "pid"])
    assert late.filter("dayofobs <> lastday + 1").count() == 0


def test_pool_keeps_every_subject_day_once(built):
    trials, observed, _ = built
    pooled = C.pool(trials, observed)
    keys = ["usubjid", "studyid", "country_name_2", "time"]
    both = trials.select(*keys).unionByName(observed.select(*keys)).distinct()
    assert pooled.count() == both.count()
    assert set(C.COHORT_TYPES.items()) <= {(n, t) for n, t in pooled.dtypes}
    assert {r["origin"] for r in pooled.select("origin").distinct().collect()} == {"SDTM", "MAPPER"}


def test_final_cohort_meets_every_criterion(built):
    final = C.final_cohort(*built)
    assert final.count() > 0
    assert final.filter("age IS NULL OR age_years >= 5").count() == 0
    assert final.filter(~F.col("act_name").isin(C.MAIN_ACTS)).count() == 0
    assert final.filter("country_name IS NULL AND country_name_2 IS NOT NULL").count() == 0


def test_excluded_study_is_dropped_for_its_origin_only(frame, built):
    enriched = C.enrich(C.pool(built[0], built[1]))
    twin = enriched.filter("origin = 'MAPPER'").withColumn("studyid", F.lit("YYDSM"))
    kept = C.eligible(twin.unionByName(twin.withColumn("origin", F.lit("SDTM"))))
    assert {r["origin"] for r in kept.select("origin").distinct().collect()} == {"SDTM"}


def test_reports_run_on_the_built_cohort(built):
    data = S.stage(P.analysis_table(C.final_cohort(*built)))
    table = {r["parasitaemia_categories"]: r for r in P.density_by_arm(data, P.BASELINE_DAY).collect()}
    baseline = data.filter("time = 1 AND pfmicl IS NOT NULL")
    for arm in C.MAIN_ACTS:
        cells = baseline.filter(F.col("act_name") == arm).select("studyid", "usubjid", "parasitaemia_categories").distinct().count()
        assert table["Total"][arm] == cells
    shares = P.outcome_shares(data).groupBy("studyid").agg(F.sum("prop").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in shares)
    study = P.study_table(data, ["time", "pfmicl"]).agg(F.sum("n")).first()[0]
    assert study == data.select("studyid", "usubjid").distinct().count()
    for frame in (P.outcome_by_study(data), P.baseline_median(data), P.baseline_table(data), P.final_extract(data), P.recurrence_curve(data, ["act_name"])):
        frame.collect()


def test_patient_set_reports(spark, paths):
    _, patients = read_observations(spark, paths)
    registry = S.read_lookup(spark, paths["registry"], schemas.REGISTRY)
    described = P.describe_patients(P.in_registry(patients, registry, "sid_inv"))
    assert "OB0" not in {r["sid"] for r in described.collect()}
    kept = P.eligible_patients(described)
    assert kept.filter("ageyears >= 5 OR lastday <> 28 OR act_category <> 'ACT'").count() == 0
    above = P.eligible_patients(described, P.HYPER_DENSITY).count()
    assert above == kept.filter("pfmicl0 > 250000").count()
    assert sum(r["n"] for r in P.above_density(described).collect()) == described.filter("pfmicl0 IS NOT NULL").count()
    assert {r["sid"] for r in P.studies_not_in(registry, patients).collect()} == {"OB3", "OB4"}


def test_quality_profile(spark, paths):
    tables, _ = read_observations(spark, paths)
    merged = S.stage(C.merge_observations(tables))
    parts = P.quality_profile(merged)
    assert parts["last_days"].agg(F.sum("n")).first()[0] == merged.count()
    assert parts["followed_28"].first()["n"] == merged.filter("dayofobs > 27").select("pid").distinct().count()
    assert P.mean_density_by_day(merged).count() == merged.select("dayofobs").distinct().count()


def test_same_result_for_any_partitioning(spark, paths, built):
    def picture(final):
        shown = [c for c in final.columns if c not in ("_row",)]
        return sorted(map(str, final.select(*shown).collect()))

    expected = picture(C.final_cohort(*built))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        assert picture(C.final_cohort(*build(spark, paths))) == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("policy, text", [("na_only", [None, "", "a"]), ("na_and_empty", [None, None, "a"])])
def test_missing_policies(spark, tmp_path, policy, text):
    path = tmp_path / "t.csv"
    path.write_text('x,n\nNA,1\n"",bad\na,NA\n')
    got = S.read_table(spark, str(path), "x string, n int", na_policy=policy, row_order=True).orderBy(S.ROW).collect()
    assert [r["x"] for r in got] == text and [r["n"] for r in got] == [1, None, None]


def test_latin1_and_stage_round_trip(spark, frame, tmp_path):
    df = frame("a string, b double", ("Lambaréné", 1.5), (None, None))
    S.write_csv(df, str(tmp_path / "out"), "ISO-8859-1")
    assert b"Lambar\xe9n\xe9" in b"".join(p.read_bytes() for p in (tmp_path / "out").glob("*.csv"))
    back = S.read_latin1(spark, str(tmp_path / "out"), "a string, b double")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert sorted(map(str, S.stage(df).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        S.export(df, str(tmp_path / "x"), "xlsx")


def test_rows_keep_file_order_over_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("x\n" + "\n".join(str(i) for i in range(20_000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
        df = S.read_table(spark, str(path), "x int", row_order=True)
        assert df.rdd.getNumPartitions() > 4
        assert [r["x"] for r in df.orderBy(S.ROW).collect()] == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_schemas_parse():
    for ddl in [*schemas.DOMAINS.values(), *schemas.OBSERVATIONS.values(), schemas.PATIENT_SET, schemas.REGISTRY, schemas.COUNTRIES]:
        names = [f.name for f in StructType.fromDDL(ddl)]
        assert len(names) == len(set(names))


def test_columns_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('STUDYID,DOMAIN,USUBJID,AGE\nS1,DM,P1,4\n')
    (tmp_path / "b.csv").write_text('AGE,USUBJID,STUDYID\n5,"P ""2"", x",S\\1\n')
    schema = "STUDYID string, USUBJID string, AGE double"
    got = S.read_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], schema)
    assert sorted(map(tuple, got.collect())) == [("S1", "P1", 4.0), ("S\\1", 'P "2", x', 5.0)]
    with pytest.raises(ValueError, match="no column SEX"):
        S.read_table(spark, str(tmp_path / "a.csv"), "SEX string")


def test_partition_values_keep_their_text(spark, tmp_path):
    df = spark.createDataFrame([("001", 1), (None, 2)], "k string, n int")
    assert sorted(map(tuple, S.stage(df, f"{tmp_path}/p", ["k"]).collect()), key=str) == [("001", 1), (None, 2)]
    with pytest.raises(Exception, match="empty text"):
        S.stage(spark.createDataFrame([("", 1)], "k string, n int"), f"{tmp_path}/q", ["k"])

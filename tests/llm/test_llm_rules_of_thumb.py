"""What operators 1, 5, 7 and 8 make of input that the tables do not hold."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortmill.llm import licences, linededup, mixing, rules, secrets, toxicity
from cohortmill.llm.queries import LANGS, MIX_TOPICS, SOURCES, table

MARGINS = {"source": SOURCES, "lang": LANGS, "topic": MIX_TOPICS}


@pytest.fixture(scope="module")
def documents(spark, folder):
    return table(spark, folder, "documents")


def mixed(docs, **targets):
    t = MARGINS | targets
    return mixing.mix_sources(docs, t["source"], t["lang"], t["topic"])


@pytest.mark.parametrize("unmet", [["source"], ["lang"], ["topic"], ["source", "lang"], ["source", "lang", "topic"]])
def test_margins_that_no_row_meets(documents, unmet):
    rows = mixed(documents, **{m: {"nowhere": 0.7, "here neither": 0.3} for m in unmet}).collect()
    assert len(rows) == 200 and all(math.isfinite(r.expected_copies) and r.expected_copies >= 0 for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert sum(r.expected_copies * r.n_tokens for r in rows) == pytest.approx(total)
    for m in set(MARGINS) - set(unmet):
        for value, share in MARGINS[m].items():
            own = [r for r in rows if r[m] == value]
            if own:
                met = sum(s for v, s in MARGINS[m].items() if any(r[m] == v and r.n_tokens for r in rows))
                assert sum(r.expected_copies * r.n_tokens for r in own) / total == pytest.approx(share / met, abs=0.02)
    if len(unmet) == 3:
        assert {round(r.expected_copies, 9) for r in rows if r.n_tokens} == {1.0}


def test_missing_sources_and_languages(documents):
    none = documents.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert mixed(none).where("expected_copies >= 0 AND raking_residual < 0.01").count() == 200
    assert mixed(documents.limit(0)).collect() == []


def test_the_residual_tells_whether_the_targets_are_met(documents):
    close = mixed(documents).select("raking_residual").distinct().collect()
    assert len(close) == 1 and 0 <= close[0][0] < 0.02
    one = mixing.mix_sources(documents, {"src0": 0.9, "src1": 0.1}, {"en": 0.1, "fr": 0.9}, MIX_TOPICS, rounds=1).select("raking_residual").first()[0]
    many = mixing.mix_sources(documents, {"src0": 0.9, "src1": 0.1}, {"en": 0.1, "fr": 0.9}, MIX_TOPICS, rounds=60).select("raking_residual").first()[0]
    assert many <= one


def test_pipeline_on_other_sources(spark, folder, tmp_path, documents):
    table(spark, folder, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents.withColumn("source", F.concat(F.lit("web_"), "source")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) > 50 and all(r.source.startswith("web_") for r in rows)
    asked = corpus_pipeline.mixing(spark, documents, folder, sources={"src1": 1.0}, langs={}, topics={"prose": 1.0})
    assert asked.count() > 0


# --- toxicity -----------------------------------------------------------------------------


@pytest.mark.parametrize("kinds", [[], [0], [1]])
def test_no_text_is_toxic_without_labels_of_both_kinds(spark, documents, kinds):
    labels = spark.createDataFrame([(k, t) for t in kinds for k in range(50)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(documents, labels).collect()
    assert len(rows) == 200 and {r.predicted for r in rows} == {0} and len({r.score for r in rows}) == 1


def test_spans_are_cut_alike_for_training_and_scoring():
    import pyarrow as pa

    from cohortmill.llm.words import Words, text_bytes

    text = "Don't be an idiot!!!stupid, i d i o t Élan!"
    batch = pa.RecordBatch.from_arrays([pa.array([True]), pa.array([False]), pa.array([text])], ["toxic", "apart", "text"])
    rows = [r for b in toxicity.span_rows(iter([batch])) for r in b.to_pylist()]
    assert all(r["toxic"] for r in rows)
    found = toxicity.strings(Words(*text_bytes(pa.array([text]))))
    single = [found.data[a + 1 : b - 1].tobytes().decode() for a, b in zip(found.begin[:-1], found.begin[1:], strict=True)]
    assert {"dont", "idiotstupid", "idiot", "élan"} <= set(single)
    assert {r["word"] for r in rows if " " not in r["word"]} == {w for w in single if len(w) > 1}
    for r in rows:
        again = toxicity.as_strings([r["word"]])
        assert again.data.tobytes().replace(b"\x01", b"").replace(b"\x02", b" ").decode().strip() == r["word"]


def test_toxic_texts_of_the_held_out_fifth_are_told(spark):
    folder = "/root/testdata/sf0.1"
    found = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), train_rows=4_000, train_words=20_000, n_landmarks=300).where("held_out")
    rows = found.join(table(spark, folder, "labels").where("toxic IS NOT NULL"), "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = (np.array([r.score for r in rows if r.toxic == t]) for t in (1, 0))
    area = ((bad[:, None] > good[None, :]) + 0.5 * (bad[:, None] == good[None, :])).mean()
    print("held-out area", area, "of", len(bad), len(good), "told", sum(r.predicted == 1 for r in rows if r.toxic == 1), sum(r.predicted == 0 for r in rows if r.toxic == 0))
    assert area >= 0.98


# --- secrets ------------------------------------------------------------------------------


def spread(value):
    n = len(value)
    times = [value.count(c) for c in set(value)]
    return (math.log2(n) - sum(k * math.log2(k) for k in times) / n) / math.log2(min(n, 16))


SECRET, COMMON, WORD = "tok_4f9a1b2c3d", "hunter2abc", "correcthorsebatterystaple"


def kinds(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return {r.doc_id: (r.n_live, r.n_example) for r in secrets.scan_secrets(docs, **options).collect()}


def test_one_owner_and_few_repositories_are_live(spark):
    rows = [(1, f"token = {SECRET}", "a"), (2, f"password: {COMMON}", "a"), (3, f"password: {WORD}", "b"), (4, "password: aaaaaaaaaa", "b"), (5, "secret=abababab", "b"), (6, "secret=abababab", None), (7, f"token={SECRET}x", None)]
    assert kinds(spark, rows) == {1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0), 7: (1, 0)}
    assert min(spread(v) for v in (SECRET, COMMON, WORD)) > 0.65 > spread("abababab")


def test_many_repositories_of_one_owner_are_an_example(spark):
    hot = [(k, f"text {k} token = {SECRET}", "hot") for k in range(500)]
    assert set(kinds(spark, hot).values()) == {(0, 1)}
    nobody = [(k, f"text {k} token = {SECRET}", None) for k in range(50)]
    assert set(kinds(spark, nobody).values()) == {(0, 1)}


def test_between_the_two_no_span_is_added(spark):
    two = [(1, f"token = {SECRET}", "a"), (2, f"token = {SECRET}!", "b")]
    assert set(kinds(spark, two).values()) == {(0, 0)}
    some = [(k, f"text {k} token = {SECRET}", "a") for k in range(10)]
    assert set(kinds(spark, some).values()) == {(0, 0)}
    three = [(k, f"token = {SECRET} {k}", f"s{k}") for k in range(3)]
    assert set(kinds(spark, three).values()) == {(0, 1)}


def test_a_repeated_row_is_one_repository(spark):
    assert set(kinds(spark, [(1, f"token = {SECRET}", "a")] * 40).values()) == {(1, 0)}


def test_spans_of_every_text_match_the_plain_patterns(spark, folder, documents):
    want = {}
    for r in documents.collect():
        text, spans = r.text or "", []
        for k, (kind, pattern, least) in enumerate((("assign", secrets.ASSIGN, 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
            for m in re.finditer(pattern, text):
                if len(m[2] if kind == "assign" else m[0]) >= least:
                    spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        want[r.doc_id] = hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()
    assert {r.doc_id: r.base_sha256 for r in secrets.scan_secrets(documents).collect()} == want


# --- licences -----------------------------------------------------------------------------

GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
MIT = "# Permission is hereby granted, free of charge, to any person obtaining\n# a copy of this software and associated documentation files (the \"Software\"),\n# to deal in the Software without restriction, including without limitation\n# the rights to use, copy, modify, merge, publish, distribute, sublicense,\n# and/or sell copies of the Software, subject to the following conditions:"
TOLD = [
    ("Distributed under the GPL v3.", "gpl"),
    ("This file is GPLv2 or later.", "gpl"),
    ("Released under MIT.", "mit"),
    ("Dual MIT/Apache-2.0", "mit"),
    ("Available under the BSD 3-Clause terms", "bsd"),
    ("Diese Datei steht unter der Lizenz MIT", "mit"),
    (GPL, "gpl"),
    (GPL.replace("General Public", "Affero General Public"), "agpl"),
    (MIT, "mit"),
    (f"{GPL}\n\n{MIT}", "gpl,mit"),
    ("Das Buch liegt auf dem Tisch.\nReleased under the MIT License.\nUnd so weiter", "mit"),
    ("word " * 400 + "Licensed under the Apache License, Version 2.0. " + "other " * 200, "apache"),
    ("He studied at MIT in Boston.", ""),
    ("Wir gehen mit dem Hund unter der Brücke", ""),
    ("The copyright of the house", ""),
    ("Licensed under the Eclipse Public License 2.0.", ""),
    ("No words of that sort", ""),
]


@pytest.fixture(scope="module")
def model(spark):
    return licences.fit_licences(spark)


def test_short_wrapped_and_embedded_notices_are_told(spark, model):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TOLD)], "doc_id long, text string")
    found = {r.doc_id: r.licences for r in licences.scan_licences(docs, model=model).collect()}
    assert [found[k] for k in range(len(TOLD))] == [f for _, f in TOLD]


def test_the_prefilter_drops_nothing(spark, model, documents):
    docs = spark.createDataFrame([(1000 + k, t) for k, (t, _) in enumerate(TOLD)], "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    one, other = ({tuple(r) for r in licences.scan_licences(docs, model=model, prefilter=p).collect()} for p in (True, False))
    assert one == other


def plain_terms(text):
    words = re.sub(r"[^a-z0-9.\-]+|\.(?![a-z0-9])", " ", text.lower()).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in licences.COMMON or b not in licences.COMMON]
    return {w for w in words if w not in licences.COMMON} | set(pairs)


def test_families_and_chances_match_the_plain_sums(spark, model):
    count, classify = model.stages.stages
    weights, constants, place = classify.coefficientMatrix.toArray(), classify.interceptVector.toArray(), {t: k for k, t in enumerate(count.vocabulary)}
    texts = [t for t, _ in TOLD]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").withColumn("words", licences.tokens(F.col("text")))
    for r in model.rated(rows).collect():
        own = [place[t] for t in plain_terms(texts[r.k]) if t in place]
        raw = (weights[:, own].sum(1) + constants) / model.temperature
        chance = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
        assert r.family == licences.FAMILIES[int(chance.argmax())] and r.chance == pytest.approx(chance.max(), rel=1e-6)


def test_held_out_templates_are_told(spark):
    """Each half of the templates and forms is rated by a model that saw the other half only."""
    rows = licences.literal_rows(spark, "text:string, label:double, fold:int", licences.examples()).withColumn("words", licences.tokens(F.col("text"))).withColumn("terms", licences.terms(F.col("words")))
    right = total = 0
    for k in range(2):
        fitted = licences.LicenceModel(licences._fitted(rows.where(F.col("fold") != k)), 1.0, 0.0)
        for r in fitted.rated(rows.where(F.col("fold") == k).drop("terms")).select("label", "family").collect():
            total += 1
            right += licences.FAMILIES[int(r.label)] == r.family
    print("held-out templates told", right, "of", total)
    assert right / total > 0.75


# --- lines --------------------------------------------------------------------------------


def kept(df):
    return {(r.doc_id, r.text): r.n_dropped for r in df.collect()}


def test_rows_of_one_id_are_one_document(spark):
    same = spark.createDataFrame([(7, f"shared\nown {k}") for k in range(12)] + [(8, "shared")], "doc_id long, text string")
    assert {r.n_dropped for r in linededup.dedup_lines(same, min_docs=3).collect()} == {0}
    mixed_ids = same.unionByName(spark.createDataFrame([(9, "SHARED ")], "doc_id long, text string"))
    assert {r.n_dropped for r in linededup.dedup_lines(mixed_ids, min_docs=3).collect()} == {1}
    nobody = spark.createDataFrame([(None, f"shared\nown {k}") for k in range(4)], "doc_id long, text string")
    assert {r.n_dropped for r in linededup.dedup_lines(nobody, min_docs=4).collect()} == {1}


def test_runs_that_last_meet_the_next_days_lines(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"

    def day(first, n):
        return spark.createDataFrame([(k, f"every day\nday {first}\nown {k}") for k in range(first, first + n)], "doc_id long, text string")

    for first, n, dropped in ((0, 3, 0), (10, 3, 1), (20, 1, 1), (30, 6, 2)):
        runs = linededup.LineRuns(spark, min_docs=5, buckets=3, folder=folder)
        found = linededup.dedup_lines(day(first, n), min_docs=5, batches=2, runs=runs).collect()
        assert {r.n_dropped for r in found} == {dropped}
        assert len(runs.levels) == bin(runs.batches).count("1")
        runs.close()
    with pytest.raises(ValueError, match="counts up to 5"):
        linededup.LineRuns(spark, min_docs=6, folder=folder)
    again = linededup.LineRuns(spark, min_docs=5, folder=folder)
    assert again.batches == 8 and again.buckets == 3 and again.frequent().count() == 2
    run = spark.table(again.levels[3])
    assert "Exchange" not in linededup.LineRuns._merged(run, run)._jdf.queryExecution().executedPlan().toString()
    again.close()


# --- rules --------------------------------------------------------------------------------


def test_learned_rules_hold_on_rows_they_were_not_learned_from(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels").where("quality IS NOT NULL")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    found = rules.apply_rules(docs, labels.where(half)).where("NOT base_failed").join(labels.where(~half), "doc_id").select("kept", "quality").collect()
    right = sum(r.kept == (r.quality == 1) for r in found)
    print("held-out rows told", right, "of", len(found))
    assert len(found) > 200 and right / len(found) > 0.9


def test_verdicts_match_the_rules_by_hand(spark):
    larger = "/root/testdata/sf0.1"
    learned = rules.fit_rules(rules.text_counts(table(spark, larger, "documents")), table(spark, larger, "labels"))
    counts = rules.text_counts(table(spark, "/root/testdata/sf0.01", "documents"))
    rows = counts.select("doc_id", rules.decision_list(learned).alias("kept"), rules.which_rule(learned).alias("rule"), *[rules.statistic(k).alias(k) for k in rules.RATIOS]).collect()
    values = {k: np.array([r[k] for r in rows], float) for k in rules.RATIOS}
    hits = [rules.covers(rule, values) for rule in learned]
    for i, r in enumerate(rows):
        first = next((k for k, hit in enumerate(hits) if hit[i]), None)
        assert r.kept == (first is None) and r.rule == (None if first is None else " and ".join(map(str, learned[first])))
    assert learned and any(h.any() for h in hits)

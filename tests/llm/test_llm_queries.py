"""The registered queries against their SQL or a plain version, and what the learned ones learn."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
import parity
import plain
from cohortmill.llm import decontaminate, linededup, mixing, quality, rules, simhash, substrings, toxicity, words
from cohortmill.llm.queries import LANGS, MIX_TOPICS, QUERIES, SOURCES, SQL, table

NAMES = sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in table(spark, folder, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_all_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in NAMES] == list(range(1, 14))
    assert {*NAMES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "source mixing"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, folder, name):
    assert parity.compare(QUERIES[name](spark, folder), parity.connect(folder), SQL[name]) == []


def test_xxh64_of_any_length():
    random.seed(7)
    parts = [random.randbytes(random.randrange(120)) for _ in range(2000)] + [b"z" * 4096]
    edges = np.cumsum([0, *map(len, parts)])
    found = words.xxh64(np.frombuffer(b"".join(parts), np.uint8), edges[:-1], edges[1:])
    assert found.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_simhash_matches_the_plain_version(spark, folder, texts):
    ids = sorted(texts)
    prints = [plain.fingerprint(texts[d]) for d in ids]
    root = plain.groups(prints)
    want = {(d, f"{p:016x}", ids[r]) for d, p, r in zip(ids, prints, root, strict=True)}
    assert {tuple(r) for r in QUERIES["op3_simhash_near_dedup"](spark, folder).collect()} == want


@pytest.mark.parametrize("leaf", [1, 4, 256])
def test_crowded_blocks_lose_no_link(spark, leaf):
    """A chain and a cloud of prints that share their blocks, whichever division meets them."""
    random.seed(3)
    base = random.getrandbits(64)
    prints = {base}
    while len(prints) < 60:
        prints.add(random.choice(sorted(prints)) ^ sum(1 << b for b in random.sample(range(64), random.choice([1, 2, 3, 6]))))
    prints = sorted(prints)
    root = plain.groups(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "print long"), 2, leaf)
    found = {r["print"]: r["root"] for r in simhash.components(links).collect()}
    groups = lambda of: {frozenset(p for p in signed if of(p) == r) for r in map(of, signed)}
    assert groups(lambda p: found.get(p, p)) == groups(lambda p: root[signed.index(p)])


def test_rules_count_like_the_plain_version(spark, folder, texts):
    rows = QUERIES["op10_quality_rules"](spark, folder).collect()
    for r in rows:
        want = plain.counts(texts[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_agree_with_labels(spark, larger):
    found = QUERIES["op10_quality_rules"](spark, larger).where("NOT base_failed").join(table(spark, larger, "labels"), "doc_id")
    assert found.where("kept = (quality = 1)").count() >= 0.97 * found.count()


def test_a_decision_list_is_an_ordered_expression(spark):
    x = {k: np.zeros(300) for k in rules.RATIOS}
    x["symbols_per_word"] = np.linspace(0, 1, 300)
    x["words"] = np.arange(300.0)
    bad = (x["symbols_per_word"] > 0.8) | (x["words"] < 30)
    learned = rules.learn_rules(x, bad, np.arange(300) % 3 != 0)
    hit = np.logical_or.reduce([rules.covers(r, x) for r in learned])
    assert len(learned) == 2 and (hit == bad).mean() > 0.98
    assert "CASE WHEN" in str(rules.decision_list(learned))


def test_leaks_match_the_plain_version(spark, larger):
    items = {r.item_id: r.text for r in table(spark, larger, "benchmark").collect()}
    docs = {r.doc_id: r.text for r in table(spark, larger, "documents").collect()}
    found = {r.doc_id: set(map(int, filter(None, r["items"].split(",")))) for r in QUERIES["op2_benchmark_decontamination"](spark, larger).collect()}
    want = {d: plain.leaked_items(t, items) for d, t in docs.items()}
    assert any(want.values())
    assert [d for d in docs if not want[d] <= found[d]] == []
    # placeholders may add items with other numbers or names; these tables hold none
    assert [d for d in docs if not found[d] <= want[d]] == []


def test_reparameterised_questions(spark):
    question = "A farmer named Anna sells 12 eggs for 3 dollars and Anna then buys 12 kg of corn from her neighbour Tom at the market"
    docs = {
        1: "Intro text here. " + question.replace("Anna", "Maria").replace("12", "40").replace("Tom", "Raj").replace("3", "7") + " more text follows",
        2: question.replace("Anna sells", "Maria sells").replace("and Anna", "and Olga").replace("12 eggs", "40 eggs").replace("12 kg", "41 kg"),
        3: question,
        4: "a farmer sells corn and then buys eggs from the market of her neighbour",
        5: question.upper(),
    }
    found = decontaminate.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(9, question)], "item_id long, text string"))
    assert {r.doc_id: r.contaminated for r in found.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    joined = decontaminate.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(9, question)], "item_id long, text string"), most_windows=0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("most_windows", [2_000_000, 3])
def test_questions_dense_in_numbers_or_with_a_name_first(spark, most_windows):
    items = {
        1: "A train covers 120 km in 2 hours and 180 km in 3 hours. What is its speed?",
        2: "What is 15 plus 27 minus 8 times 3 ?",
        3: "John has 12 apples. John gives 5 apples to his sister and eats 2.",
        4: "12 15 18 21 24 27",
        5: "What is the capital of France?",
    }
    docs = {
        1: "See: A train covers 90 km in 5 hours and 70 km in 4 hours. What is its speed? Think.",
        2: "What is 31 plus 64 minus 9 times 7 ?",
        3: "Well, Mary has 31 apples. Mary gives 7 apples to his sister and eats 4. Done",
        4: "A train covers 90 km in 5 hours and 90 km in 90 hours. What is its speed?",
        5: "1 2 3 4 5 6 7 8 9 10",
        6: "This is the capital of Germany.",
        7: "The row is 12 15 18 21 24 27 here",
    }
    found = decontaminate.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), most_windows=most_windows)
    assert {r.doc_id: r["items"] for r in found.collect()} == {1: "1", 2: "2", 3: "3", 4: "", 5: "", 6: "", 7: "4"}


def test_questions_shorter_than_a_window(spark):
    items = [(1, "Who wrote Faust?"), (2, "Add 3 to it"), (3, "yes")]
    docs = {1: "Quiz: who wrote Faust? Goethe did", 2: "Now add 7 to it and go on", 3: "who wrote that Faust", 4: "add it to 3", 5: "Yes, add 3 to it. Who wrote Faust", 6: ""}
    found = decontaminate.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r["items"] for r in found.collect()} == {1: "1", 2: "2", 3: "", 4: "", 5: "1,2,3", 6: ""}


def test_weak_labels_find_the_bad_texts(spark, larger):
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    _, model = quality.fit_quality(docs)
    accuracy = dict(zip(quality.LABELLERS, model.accuracy(), strict=True))
    assert min(accuracy[k] for k in ("symbols", "capitals", "bars", "stutter")) > 0.9
    judged = quality.score_quality(docs).join(labels, "doc_id")
    assert judged.where("kept AND quality = 1").count() >= 0.99 * judged.where("quality = 1").count()
    assert judged.where("NOT kept AND quality = 0").count() >= 0.95 * judged.where("quality = 0").count()


def test_em_recovers_the_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.7
    patterns = np.zeros((20_000, len(quality.LABELLERS)), int)
    for j in range(patterns.shape[1]):
        right = rng.random(20_000) < 0.6 + 0.03 * j
        cast = rng.random(20_000) < 0.8
        patterns[:, j] = np.where(cast, np.where(right == good, quality.GOOD, quality.BAD), quality.ABSTAIN)
    model = quality.fit_votes(patterns, np.ones(20_000))
    assert abs(model.good - 0.7) < 0.03
    assert np.abs(model.accuracy() - (0.6 + 0.03 * np.arange(patterns.shape[1]))).max() < 0.03


def test_toxicity_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    rows = QUERIES["op7_toxicity"](spark, sf).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    up, down = (np.array([r.score for r in held if r.toxic == k]) for k in (1, 0))
    assert ((up[:, None] > down).mean() + 0.5 * (up[:, None] == down).mean()) > 0.95
    assert np.mean(up >= 0.5) > 0.8 and np.mean(down >= 0.5) < 0.03


def test_the_string_kernel_tolerates_gaps():
    bad, fine = ["idiot", "moron", "scumbag", "worthless"], ["garden", "window", "reading", "teacher", "the", "other", "winter"]
    names = bad + fine
    machine = toxicity.fit_machine(names, np.array([50.0] * 4 + [5.0] * 7), np.array([0.0] * 4 + [60.0] * 7), n_landmarks=11)
    margin = dict(zip(["idiot", "idioot", "i.d.i.o.t", "i d i o t", "wworthless", "garden", "teachers"], machine.margins(toxicity.as_strings(["idiot", "idioot", "i.d.i.o.t", "i d i o t", "wworthless", "garden", "teachers"])), strict=True))
    assert min(margin[k] for k in ("idiot", "idioot", "i.d.i.o.t", "i d i o t", "wworthless")) > 0 > max(margin["garden"], margin["teachers"])
    naive = lambda s, t: sum(toxicity.DECAY ** (a + b - 8) for x, a in subsequences(s) for y, b in subsequences(t) if x == y)
    a, b = "idiots", "idixot"
    found = toxicity.as_strings([a])
    marks = toxicity.as_strings([b])
    vector = np.zeros(toxicity.BUCKETS)
    for _, bucket, worth in marks.terms():
        np.add.at(vector, bucket, worth)
    assert abs(found.sums(vector)[0] * found.norms()[0] - naive(f"\x01{a}\x02", f"\x01{b}\x02")) < 1e-6


def test_insults_split_spread_or_made_of_harmless_words(spark):
    random.seed(4)
    fine = ["garden", "window", "reading", "teacher", "other", "winter", "go", "back", "home", "to", "your", "hole", "the", "crawl", "bread"]
    rows = []
    for k in range(600):
        w = random.choices(fine, k=12)
        if k % 3 == 0:
            w[4:5] = ["idiot"] if k % 2 else ["crawl", "back", "home"]
        elif any(w[j : j + 3] == ["crawl", "back", "home"] for j in range(12)):
            continue
        rows.append((k, " ".join(w), int(k % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), n_landmarks=100)
    base = "garden window reading {} teacher other winter bread the"
    asked = ["idiot", "idi ot", "idxiot", "crawl back home", "home", "back crawl", "to your home"]
    score = dict(zip(asked, model.scores(words.Words(*words.text_bytes(pa.array([base.format(a) for a in asked])))), strict=True))
    assert min(score[a] for a in ("idiot", "idi ot", "idxiot", "crawl back home")) > 0.5 > max(score[a] for a in ("home", "back crawl", "to your home")), score


def subsequences(s):
    out = []
    for k in range(len(s)):
        for step in toxicity.STEPS:
            if k + step[-1] < len(s):
                out.append((tuple(s[k + x] for x in step), step[-1] + 1))
    return out


def test_automaton_finds_first_ends():
    random.seed(11)
    for _ in range(40):
        reference = [random.randrange(3) for _ in range(60)]
        query = [random.randrange(3) for _ in range(60)]
        found = dict(substrings.Automaton(reference).first_ends(query, 4))
        for end in range(3, 60):
            window = query[end - 3 : end + 1]
            ends = [k for k in range(3, 60) if reference[k - 3 : k + 1] == window]
            assert found.get(end) == (ends[0] if ends else None)


def test_substrings_match_the_plain_version_in_small_shards(spark):
    random.seed(5)
    passages = [" ".join(f"p{random.randrange(5000)}" for _ in range(random.randrange(5, 40))) for _ in range(12)]
    rows = []
    for d in range(80):
        parts = [random.choice(passages) if random.random() < 0.5 else " ".join(f"w{random.randrange(200)}" for _ in range(random.randrange(30))) for _ in range(random.randrange(6))]
        rows.append((d, "\n ".join(parts)))
    rows += [(100, rows[3][1]), (101, " ".join(rows[3][1].split()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: (n, gone, plain_sha(kept)) for d, (n, gone, kept) in plain.without_repeats(rows).items()}
    for options in ({}, {"shard_windows": 7, "task_words": 5, "most_rows": 0}):
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs, **options).collect()}
        assert found == want


def plain_sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("batches", [1, 2, 3, 7])
def test_line_runs_in_any_number_of_batches(spark, batches):
    random.seed(2)
    texts = ["\n".join(random.choice(["Alpha ", " alpha", "beta", "", "gamma", f"own {k}"]) for _ in range(random.randrange(6))) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(docs, min_docs=6, batches=batches).collect()}
    assert found == dict(enumerate(plain.dedup_lines(texts, 6)))


def test_runs_are_merged_by_level(spark):
    runs = linededup.LineRuns(spark, min_docs=3, buckets=4)
    for k in range(7):
        runs.add(spark.createDataFrame([(k % 2, 0), (9, 9)], "h1 long, h2 long"))
    assert sorted(runs.levels) == [0, 1, 2] and {r.h1 for r in runs.frequent().collect()} == {0, 1, 9}
    text = runs._merged(*runs._runs()[:2])._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in text and "Exchange" not in text  # bucket by bucket
    runs.close()


def test_raking_meets_the_margins(spark, larger):
    mixed = mixing.mix_sources(table(spark, larger, "documents"), SOURCES, LANGS, MIX_TOPICS)
    total = mixed.agg(F.sum("n_tokens")).first()[0]
    for column, targets in (("source", SOURCES), ("lang", LANGS), ("topic", MIX_TOPICS)):
        share = {r[0]: r[1] / total for r in mixed.groupBy(column).agg(F.sum(F.col("n_tokens") * F.col("expected_copies"))).collect()}
        known = sum(v for k, v in targets.items() if k in share)
        assert all(abs(share[k] - v / known) < 0.01 for k, v in targets.items() if k in share), column
    drawn = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert abs(drawn / total - 1) < 0.1


def test_each_stage_matches_a_plain_version(spark, folder):
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.orderBy("doc_id").collect()
        out = stage(spark, docs, folder)
        kept = {r.doc_id: r for r in out.collect()}
        if name == "quality classifier":
            score = {r.doc_id: r.kept for r in quality.score_quality(docs, train_rows=8_000).collect()}
            assert set(kept) == {d for d, good in score.items() if good}
        elif name == "line dedup":
            want = plain.dedup_lines([r.text for r in rows])
            assert {d: r.text for d, r in kept.items()} == {r.doc_id: t for r, (t, _, _) in zip(rows, want, strict=True)}
            assert all(r.n_chars == len(r.text) for r in kept.values())
        elif name == "simhash near-dedup":
            root = plain.groups([plain.fingerprint(r.text) for r in rows])
            assert set(kept) == {rows[k].doc_id for k in set(root)}
        elif name == "benchmark decontamination":
            items = {r.item_id: r.text for r in table(spark, folder, "benchmark").collect()}
            assert set(kept) == {r.doc_id for r in rows if not plain.leaked_items(r.text, items)}
        else:
            everything = mixing.mix_sources(docs, SOURCES, LANGS, MIX_TOPICS)
            assert set(kept) == {r.doc_id for r in everything.where("copies > 0").collect()}
        if name != "source mixing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)

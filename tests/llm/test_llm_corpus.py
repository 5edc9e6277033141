"""Importance resampling, source divergence and the language model against plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import plain
from cohortmill.llm import bilinear, crc, divergence, importance
from cohortmill.llm.queries import QUERIES, table
from cohortmill.llm.words import SPACE, Words

TEXT = "doc_id long, text string, lang string, source string, n long, buckets string, item string, row int"


def frame(spark, rows):
    """Rows of (id, text, lang, source) among columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], TEXT)


@pytest.fixture(scope="module")
def documents(spark, folder):
    return [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text", "lang", "source").collect()]


ODD = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, "one two\nthree\n\nfour", "en", None),
    (3, "one two\nthree\n\nfour", "en", None),
    (None, "ONE two", "en", "a"),
    (None, None, None, None),
    (4, "\n" * 50 + "x" * 500 + "é" * 200 + "\n" + "x" * 500, "en", "b"),
    (5, "\n".join(f"w{k % 7} w{k % 11} über{k % 5}" for k in range(4000)), "de", "b"),
    (5, "\n".join(f"w{k % 7} w{k % 11} über{k % 5}" for k in range(4000)), "de", "b"),
    (6, "a-b a_b a1b 1 2 3 d'e " * 30, "de", "a"),
    (7, "a-b a_b a1b 1 2 3 d'e " * 30, "de", "c"),
]


def test_crc_of_runs_and_of_runs_put_together():
    random.seed(3)
    parts = [random.randbytes(n) for n in [*range(140), 1000, 66, 65, 64]]
    edges = np.cumsum([0, *map(len, parts)])
    data = np.frombuffer(b"".join(parts), np.uint8)
    found = crc.crc32(data, edges[:-1], edges[1:])
    assert found.tolist() == [zlib.crc32(p) for p in parts]
    other = parts[::-1]
    both = crc.joined(found, np.array([zlib.crc32(p) for p in other], np.uint32), np.array([len(p) for p in other]))
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(parts, other, strict=True)]


def ranked(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_importance_matches_the_plain_version(spark, folder, documents):
    target = [r.text for r in table(spark, folder, "benchmark").collect()]
    want = plain.importance([r[:2] for r in documents], target)
    assert ranked(QUERIES["op11_importance_resampling"](spark, folder)) == sorted(((r[0], *w) for r, w in zip(documents, want, strict=True)), key=str)
    assert sum(w[3] is not None for w in want) > 5


def test_importance_of_odd_rows(spark):
    target = spark.createDataFrame([("w1 w2 über3",), (None,), ("",), ("d e\na",)], "text string")
    want = plain.importance([r[:2] for r in ODD], ["w1 w2 über3", None, "", "d e\na"], percent=60, min_words=2)
    found = ranked(importance.rank_by_importance(frame(spark, ODD), target, percent=60, min_words=2))
    assert found == sorted(((r[0], *w) for r, w in zip(ODD, want, strict=True)), key=str)
    drawn = importance.importance_resample(frame(spark, ODD), target, percent=60, min_words=2)
    assert drawn.columns == frame(spark, ODD).columns
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r, w in zip(ODD, want, strict=True) if w[3] is not None and r[0] is not None}


def test_importance_without_rows(spark):
    some, none = frame(spark, ODD), frame(spark, []).limit(0)
    assert importance.rank_by_importance(none, some).collect() == []
    want = plain.importance([r[:2] for r in ODD], [])
    assert ranked(importance.rank_by_importance(some, none)) == sorted(((r[0], *w) for r, w in zip(ODD, want, strict=True)), key=str)


def test_a_line_of_many_texts_is_counted_with_its_occurrences(spark):
    rows = [(k, "same line here\n" + f"own{k}", "en", "a") for k in range(200)]
    lines = importance.distinct_lines(frame(spark, rows), "text").collect()
    assert sorted(r.n for r in lines) == [1] * 200 + [200]
    assert ranked(importance.rank_by_importance(frame(spark, rows), frame(spark, rows[:3]), min_words=1)) == sorted(((r[0], *w) for r, w in zip(rows, plain.importance([r[:2] for r in rows], [r[1] for r in rows[:3]], min_words=1), strict=True)), key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_divergence_matches_the_plain_version(spark, folder, documents):
    want = plain.divergence([r[1:] for r in documents])
    assert told(QUERIES["op12_source_divergence"](spark, folder)) == sorted(want, key=str)


@pytest.mark.parametrize("min_docs", [1, 2, 99])
def test_divergence_of_odd_rows(spark, min_docs):
    want = plain.divergence([r[1:] for r in ODD], min_docs)
    assert told(divergence.source_divergence(frame(spark, ODD), min_docs=min_docs)) == sorted(want, key=str)
    assert divergence.source_divergence(frame(spark, []).limit(0)).collect() == []


def test_divergence_in_blocks_and_panels(spark, documents, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_CELLS", 700)
    monkeypatch.setattr(divergence, "PANEL", 3)
    monkeypatch.setattr(divergence, "MOST_ROWS", 50)
    want = plain.divergence([r[1:] for r in documents], 3)
    assert told(divergence.source_divergence(frame(spark, documents), min_docs=3)) == sorted(want, key=str)


def test_equal_scores_come_in_order_of_bytes_however_many(spark):
    terms = [f"{a}{b}" for a in "zyxéab" for b in "mnopqrst"]
    rows = [(k, " ".join(terms), "en", "a") for k in range(3)] + [(k, "other words", "en", "b") for k in range(3)]
    found = [r for r in told(divergence.source_divergence(frame(spark, rows), min_docs=2)) if r[1:3] == ("a", "term")]
    assert [r[3] for r in sorted(found, key=lambda r: r[5])] == sorted(terms, key=str.encode)[:10]


def test_large_counts_stay_exact():
    total = np.array([9_000_000_000_000_000 // 1000])
    n = np.array([[0], [7], [8_999_999_999_990]])
    assert divergence._shares(n, total)[:, 0].tolist() == [1 + 10**9 * (x + 2) // int(total[0]) for x in n[:, 0].tolist()]


def scored(df):
    return {r.doc_id: r for r in df.collect()}


def test_base_scores_match_the_plain_version(spark, folder, documents):
    found = scored(QUERIES["op13_language_model"](spark, folder))
    assert len(found) == len(documents)
    for (id, *_), (held, *numbers, base) in zip(documents, plain.unigram_scores([r[:2] for r in documents]), strict=True):
        r = found[id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, *numbers)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_the_model_tells_held_out_texts_better_than_the_base(spark):
    rows = [r for r in QUERIES["op13_language_model"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 50
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.1


def test_words_beyond_the_broadcast_ones_are_met_in_the_join(spark, documents):
    all_known, few = (scored(bilinear.score_texts(frame(spark, documents), n_words=20, n_endings=7, n_known=n, rounds=1)) for n in (10**6, 20))
    for id, r in all_known.items():
        assert (r.n_tokens, r.n_known) == (few[id].n_tokens, few[id].n_known)
        assert r.base_score == pytest.approx(few[id].base_score, rel=1e-9)


def test_chances_of_a_context_add_up_to_one():
    random = np.random.default_rng(1)
    share = random.random(40)
    model = bilinear.Bilinear.begun(share / share.sum(), 5)
    model.values[:] = random.normal(0, 1, len(model.values))
    for earlier in (0, 17, 40):
        norms = model.norms(earlier)
        for before in range(41):
            score = (model.first[before] + model.second[earlier]) @ model.told.T + model.bias
            assert np.exp(score - norms[before]).sum() == pytest.approx(1, rel=1e-4)


def test_shares_within_a_unit_add_up_to_one(spark):
    rows = [(k, " ".join(f"w{k * j % 97}" for j in range(60)), "en", "a") for k in range(1, 40)]
    texts = frame(spark, rows)
    counts = bilinear.word_counts(texts, 5)
    corpus = bilinear.corpus_of(counts, len(rows), 10, 5, 30)
    own = set(corpus.units.hashes.view(np.int64).tolist())
    for ending in range(5):
        rest = [r.n for r in counts.collect() if r.ending == ending and r.word not in own]
        unit = 11 + ending
        assert sum(n + 0.1 for n in rest) + 0.1 == pytest.approx(10 ** corpus.within[unit])
    assert corpus.tokens == corpus.unit_n.sum() == 39 * 61


def test_noise_contrastive_learning_finds_the_chances():
    """A chain of units in which the next one depends on the one before."""
    random = np.random.default_rng(2)
    chance = random.dirichlet(np.ones(6) * 0.5, 6)
    now = [0]
    for _ in range(60_000):
        now.append(random.choice(6, p=chance[now[-1]]))
    now = np.array(now, np.int32)
    share = np.bincount(now, minlength=6) / len(now)
    model = bilinear.Bilinear.begun(share, 1)
    spread = np.full(len(model.values), 1e-2, np.float32)
    for at in range(2, len(now) - 256, 256):
        i = np.arange(at, at + 256)
        model.learn(now[i], now[i - 1], now[i - 2], random.choice(6, 32, p=share), share, spread)
    score = np.array([[(model.first[b] + model.second[e]) @ model.told.T + model.bias for e in range(6)] for b in range(6)])
    p = np.exp(score - np.log(np.exp(score).sum(-1, keepdims=True)))
    assert np.abs(p.mean(1) - chance).mean() < 0.06


def test_odd_rows_get_scores(spark):
    found = bilinear.score_texts(frame(spark, ODD)).collect()
    want = plain.unigram_scores([r[:2] for r in ODD])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in found), key=str)
    assert got == sorted(((row[0], *w[:4]) for row, w in zip(ODD, want, strict=True)), key=str)
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)
    assert len({(r.base_score, r.score) for r in found if r.doc_id == 5}) == 1
    assert bilinear.score_texts(frame(spark, []).limit(0)).collect() == []


def test_scores_without_rows_to_learn_from(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    found = bilinear.score_texts(frame(spark, [(k, "some words here", "en", "a") for k in held])).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found} == {(True, 4, 0, 0, 0.0)}
    assert all(np.isfinite(r.score) for r in found)


def test_contexts_begin_anew_with_each_text():
    data = b"a b  c d e"
    words = Words(np.frombuffer(data, np.uint8), np.array([0, 4, 4, len(data)]), SPACE)
    now, before, earlier, text = bilinear.in_context(words, np.arange(1, 6, dtype=np.int32), 99)
    assert now.tolist() == [1, 2, 0, 0, 3, 4, 5, 0] and text.tolist() == [0, 0, 0, 1, 2, 2, 2, 2]
    assert before.tolist() == [99, 1, 2, 99, 99, 3, 4, 5] and earlier.tolist() == [99, 99, 1, 99, 99, 99, 3, 4]


def test_texts_of_another_type_of_id(spark):
    docs = spark.createDataFrame([("x1", "some words"), (None, "some words")], "doc_id string, text string")
    assert {r.doc_id for r in bilinear.score_texts(docs).collect()} == {"x1", None}
    assert {r.doc_id for r in importance.rank_by_importance(docs, docs).collect()} == {"x1", None}
    assert pa.types.is_int64(divergence.source_divergence(docs.selectExpr("text", "doc_id lang", "doc_id source")).toArrow()["value"].type)

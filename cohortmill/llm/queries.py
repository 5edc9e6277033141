"""The operators over the whole ``documents`` table as registered queries, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.llm.bilinear import score_texts
from cohortmill.llm.decontaminate import find_leaks
from cohortmill.llm.divergence import source_divergence
from cohortmill.llm.importance import rank_by_importance
from cohortmill.llm.licences import scan_licences
from cohortmill.llm.linededup import dedup_lines
from cohortmill.llm.mixing import mix_sources
from cohortmill.llm.quality import score_quality
from cohortmill.llm.rules import apply_rules
from cohortmill.llm.secrets import scan_secrets
from cohortmill.llm.simhash import near_duplicates
from cohortmill.llm.substrings import dedup_substrings
from cohortmill.llm.toxicity import score_toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The mixture asked for: shares of the tokens by source, by language and by topic.
SOURCES = {f"src{k}": 0.05 for k in range(20)}
LANGS = {"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1}
MIX_TOPICS = {"prose": 0.85, "tables": 0.05, "legal": 0.08, "contact": 0.02}


def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(table(spark, folder, "documents"), SOURCES, LANGS, MIX_TOPICS, rounds=50, seed=42)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("expected_copies", 6).alias("expected_copies"), "copies")


def _values(targets: dict[str, float]) -> str:
    return ", ".join(f"('{k}', {k_at}, {v!r}::DOUBLE)" for k_at, (k, v) in enumerate(targets.items()))


def _goal(place: str, targets: str, n: int) -> str:
    """SQL for what each place of a margin should weigh."""
    return f"""
    SELECT m.{place}, CASE WHEN m.{place} = {n} OR coalesce((SELECT sum(share) FROM {targets} WHERE k IN (SELECT {place} FROM mass_{place} WHERE mass > 0)), 0) <= 0 THEN m.mass
        ELSE coalesce(g.share, 0) / (SELECT sum(share) FROM {targets} WHERE k IN (SELECT {place} FROM mass_{place} WHERE mass > 0))
             * ((SELECT sum(mass) FROM mass_{place}) - coalesce((SELECT mass FROM mass_{place} WHERE {place} = {n}), 0)) END AS goal_{place}
    FROM mass_{place} m LEFT JOIN {targets} g ON g.k = m.{place}"""


OP1_SQL = f"""
WITH RECURSIVE
source_targets(name, k, share) AS (VALUES {_values(SOURCES)}),
lang_targets(name, k, share) AS (VALUES {_values(LANGS)}),
topic_targets(name, k, share) AS (VALUES {_values(MIX_TOPICS)}),
told AS (
    SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens,
           CASE WHEN contains(text, ' | ') THEN 'tables'
                WHEN contains(text, 'icensed under') OR contains(text, 'eleased under') OR contains(text, 'opyright') THEN 'legal'
                WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic
    FROM documents),
placed AS (
    SELECT told.*, coalesce(a.k, {len(SOURCES)}) AS s, coalesce(b.k, {len(LANGS)}) AS l, coalesce(c.k, {len(MIX_TOPICS)}) AS t
    FROM told LEFT JOIN source_targets a ON told.source = a.name LEFT JOIN lang_targets b ON told.lang = b.name LEFT JOIN topic_targets c ON told.topic = c.name),
cells AS (SELECT s, l, t, sum(n_tokens)::DOUBLE AS tokens FROM placed GROUP BY s, l, t),
mass_s AS (SELECT s, sum(tokens) AS mass FROM cells GROUP BY s),
mass_l AS (SELECT l, sum(tokens) AS mass FROM cells GROUP BY l),
mass_t AS (SELECT t, sum(tokens) AS mass FROM cells GROUP BY t),
goal_s AS ({_goal("s", "source_targets", len(SOURCES))}),
goal_l AS ({_goal("l", "lang_targets", len(LANGS))}),
goal_t AS ({_goal("t", "topic_targets", len(MIX_TOPICS))}),
rake(i, s, l, t, w, goal_s, goal_l, goal_t) AS (
    SELECT 0, s, l, t, tokens, goal_s, goal_l, goal_t FROM cells JOIN goal_s USING (s) JOIN goal_l USING (l) JOIN goal_t USING (t)
    UNION ALL
    SELECT i + 1, s, l, t, coalesce(w * goal_t / nullif(sum(w) OVER (PARTITION BY t), 0), 0), goal_s, goal_l, goal_t FROM (
        SELECT i, s, l, t, coalesce(w * goal_l / nullif(sum(w) OVER (PARTITION BY l), 0), 0) AS w, goal_s, goal_l, goal_t FROM (
            SELECT i, s, l, t, coalesce(w * goal_s / nullif(sum(w) OVER (PARTITION BY s), 0), 0) AS w, goal_s, goal_l, goal_t FROM rake WHERE i < 50))),
expected AS (
    SELECT p.*, CASE WHEN c.tokens > 0 THEN r.w / c.tokens ELSE 0 END AS e
    FROM placed p JOIN cells c USING (s, l, t) JOIN rake r USING (s, l, t) WHERE r.i = 50)
SELECT doc_id, source, lang, topic, n_tokens, round(e, 6) AS expected_copies,
       (floor(e) + CASE WHEN ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < e - floor(e) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM expected
"""


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=5, share=0.8)


def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=3, bits=2)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.key = f.key
GROUP BY doc_id
"""

def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*first, "rule")


def op5_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(table(spark, folder, "documents"), overlap=0.6)


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), train_rows=8_000)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), train_rows=4_000, train_words=20_000, n_landmarks=300)


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"), min_owners=3, min_repositories=20, most_repositories=5, min_spread=0.65)


OP8_SQL = r"""
WITH patterns(rank, kind, pattern, least) AS (VALUES
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
    (1, 'access', 'AKIA[A-Z0-9]+', 20),
    (2, 'hex', '[0-9a-f]+', 24)),
texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
matched AS (
    SELECT doc_id, source, 0 AS rank, regexp_extract_all(text, (SELECT pattern FROM patterns WHERE rank = 0)) AS hits,
           string_split_regex(text, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS gaps
    FROM texts
    UNION ALL SELECT doc_id, source, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM texts
    UNION ALL SELECT doc_id, source, 2, regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM texts),
turns AS (SELECT doc_id, source, rank, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS turn FROM matched),
placed AS (
    SELECT doc_id, source, rank, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY turn))::BIGINT AS stop,
           CASE rank WHEN 0 THEN regexp_extract(hit, (SELECT pattern FROM patterns WHERE rank = 0), 2) ELSE hit END AS value
    FROM turns),
base AS (
    SELECT doc_id, source, p.rank, kind, stop - length(hit) AS start, stop, value
    FROM placed p JOIN patterns q ON p.rank = q.rank WHERE length(value) >= least),
judged AS (
    SELECT value, count(DISTINCT source) >= 3 OR count(DISTINCT doc_id) >= 20 AS example,
           count(DISTINCT source) <= 1 AND count(DISTINCT doc_id) <= 5
           AND round((log2(length(value)::DOUBLE) - list_sum(list_transform(list_sort(list_transform(list_distinct(string_split(value, '')), lambda c: (length(value) - length(replace(value, c, '')))::DOUBLE)),
                                                                           lambda k: k * log2(k))) / length(value)) / log2(least(length(value), 16)::DOUBLE), 6) >= 0.65 AS live
    FROM base GROUP BY value),
extra AS (
    SELECT DISTINCT doc_id, CASE WHEN example THEN 4 ELSE 3 END AS rank, CASE WHEN example THEN 'example' ELSE 'live' END AS kind,
           stop - length(b.value) AS start, stop
    FROM base b JOIN judged j ON b.value = j.value WHERE example OR live),
every AS (SELECT doc_id, rank, kind, start, stop FROM base UNION ALL SELECT doc_id, rank, kind, start, stop FROM extra),
per_text AS (
    SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
           count(*) FILTER (WHERE rank = 3) AS n_live, count(*) FILTER (WHERE rank = 4) AS n_example,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base_spans,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
    FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN per_text p ON d.doc_id = p.doc_id
"""


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_substrings(table(spark, folder, "documents"), size=20)


OP9_SQL = r"""
WITH parts AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+')) AS word,
                      generate_subscripts(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), 1) AS i FROM documents),
texts AS (SELECT doc_id, list(word ORDER BY i) FILTER (WHERE word <> '') AS w FROM parts GROUP BY doc_id),
numbered AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM texts WHERE len(w) >= 20),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s : s + 19], ' ') ORDER BY doc_id, s) AS turn FROM numbered),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM ranked WHERE turn > 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
kept AS (
    SELECT a.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY a.pos) FILTER (WHERE g.pos IS NULL) AS kept
    FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id)
SELECT t.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    ranked = rank_by_importance(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=5, min_words=20, seed=42)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a text, byte by byte from its hexadecimal form, by a table that SQL makes from the polynomial.
OP11_SQL = r"""
WITH crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS step
    FROM (SELECT unnest(range(256)) AS i)),
texts AS (
    SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
told AS (
    SELECT doc_id, side, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM texts),
runs AS (
    SELECT doc_id, side, unnest(list_concat(w, list_concat(
        list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w)::BIGINT - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS run
    FROM told),
hexed AS (SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM runs)),
buckets AS (
    SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                                lambda a, b: xor(a >> 8, step[1 + (xor(a, b) & 255)])), 4294967295) % 10000 AS bucket
    FROM hexed, crc),
counts AS (
    SELECT bucket, count(*) FILTER (WHERE side = 0)::DOUBLE AS s, count(*) FILTER (WHERE side = 1)::DOUBLE AS t FROM runs JOIN buckets USING (run) GROUP BY bucket),
totals AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (
    SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM runs JOIN buckets USING (run) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM told d LEFT JOIN weights w ON d.doc_id = w.doc_id WHERE d.side = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"), min_docs=10, top=10)


OP12_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
hits AS (
    SELECT doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs),
per_doc AS (SELECT doc_id, lang, source, term, count(*) AS n FROM hits GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM per_doc GROUP BY lang, term HAVING count(*) >= 10),
per_group AS (SELECT lang, source, term, sum(n) AS n FROM per_doc GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
    SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN per_group c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
shares AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)::HUGEINT) // (t.total + 2 * l.v)::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (lang_n + 2)::HUGEINT) // (l.total + 2 * l.v)::HUGEINT AS q
    FROM cells JOIN totals t USING (lang, source) JOIN langs l USING (lang)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every_pair AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source),
marks AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM marks))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op13_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"), n_words=512, n_endings=255, n_known=200_000, rounds=2, seed=42)


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_benchmark_decontamination, op3_simhash_near_dedup, op4_line_dedup, op5_licence_scan, op6_quality_classifier, op7_toxicity, op8_secret_scan, op9_substring_dedup, op10_quality_rules, op11_importance_resampling, op12_source_divergence, op13_language_model)}
SQL = {"op1_source_mixing": OP1_SQL, "op4_line_dedup": OP4_SQL, "op8_secret_scan": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_source_divergence": OP12_SQL}

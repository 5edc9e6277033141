"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.staging import stage
from cohortmill.llm.words import U, Words, blocks, mix, run_hashes

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bars", "n_bangs", "n_upper", "n_digits", "n_same_as_before"]
WINDOW = 5


def _marked(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL, BAR, BANG, UPPER, DIGIT = (_marked(x) for x in (b"#*$%&|<>", b"|", b"!", bytes(range(65, 91)), bytes(range(48, 58))))


def repeated(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for each hash that its text holds twice or more."""
    key = mix(hashes + (text.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def count_words(words: Words) -> list[np.ndarray]:
    """The COUNTS of each text."""
    data, offsets = words.data, words.offsets

    def per_text(flag: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[at[1:]] - total[at[:-1]]

    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    solid = np.cumsum(inside[:-1]) > 0
    hashes, text = words.hashes(), words.text_of

    at = words.runs(WINDOW)
    covered = np.zeros(len(words) + WINDOW, np.int64)
    again = at[repeated(text[at], run_hashes(hashes, WINDOW)[at])]
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    repeat = np.cumsum(covered)[: len(words)] > 0
    before = np.concatenate([np.zeros(min(1, len(words)), bool), (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])])

    # lines: a break ends one, and so does the end of a text
    ends = np.flatnonzero(data == 10)
    line_text = np.concatenate([np.searchsorted(offsets, ends, "right") - 1, np.arange(len(offsets) - 1)])
    line_end = np.concatenate([ends, offsets[1:]])
    order = np.lexsort((line_end, line_text))
    line_text, line_end = line_text[order], line_end[order]
    new = np.concatenate([np.ones(min(1, len(line_text)), bool), line_text[1:] != line_text[:-1]])
    line_start = np.where(new, offsets[line_text], np.concatenate([np.zeros(min(1, len(line_end)), np.int64), line_end[:-1] + 1]))
    full = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    lines = Words.__new__(Words)
    lines.data, lines.start, lines.end = data, line_start[full], line_end[full]
    key = mix(lines.hashes() + (line_text[full].astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
    _, first = np.unique(key, return_index=True)
    dup = np.ones(len(key), bool)
    dup[first] = False

    return [
        words.counts,
        per_text(solid & (data & 0xC0 != 0x80)),
        per_text(SYMBOL[data]),
        np.bincount(line_text[full][dup], minlength=len(offsets) - 1),
        per_text(repeat, words.first),
        np.bincount(line_text, minlength=len(offsets) - 1),
        per_text(BAR[data]),
        per_text(BANG[data]),
        per_text(UPPER[data]),
        per_text(DIGIT[data]),
        per_text(before, words.first),
    ]


def text_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, COUNTS) for each row; a NULL text has no words and one empty line."""
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    schema = own.select("doc_id").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in count_words(words))], ["doc_id", *COUNTS])

    return own.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Statistics on which rules are grown: name, the count above and the count below the line.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeat_words_per_word": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "bars_per_word": ("n_bars", "n_words"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "same_as_before_per_word": ("n_same_as_before", "n_words"),
    "words": ("n_words", None),
}


def statistic(name: str) -> Column:
    over, under = RATIOS[name]
    value = F.col(over).cast("double")
    return value if under is None else value / F.greatest(F.col(under), F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = statistic(self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.name] > self.threshold if self.above else values[self.name] <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


Rule = list[Condition]


def covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(values) for c in rule])


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, cuts: int) -> Rule:
    """Add the condition with the largest information gain until the rule covers no good row."""
    rule: Rule = []
    live = np.ones(len(bad), bool)
    while (~bad & live).any() and (bad & live).any():
        p, n = int((bad & live).sum()), int((~bad & live).sum())
        best, gain = None, 1e-9
        for name, x in values.items():
            points = np.unique(np.quantile(x[live], np.linspace(0, 1, cuts + 1)[:-1]))
            inside = np.sort(x[live & bad])
            outside = np.sort(x[live & ~bad])
            for above in (True, False):
                low_p, low_n = np.searchsorted(inside, points, "right"), np.searchsorted(outside, points, "right")
                q, m = (p - low_p, n - low_n) if above else (low_p, low_n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = np.where(q > 0, q * (np.log2(q / (q + m)) - np.log2(p / (p + n))), -1.0)
                k = int(np.argmax(found))
                if found[k] > gain:
                    best, gain = Condition(name, above, float(points[k])), float(found[k])
        if best is None:
            break
        x = values[best.name][live]
        higher = x[x > best.threshold]
        if len(higher):  # half way to the next value, so that the line lies in the gap
            best = Condition(best.name, best.above, float((best.threshold + higher.min()) / 2))
        rule.append(best)
        live &= best.holds(values)
    return rule


def _plain(rule: Rule) -> Rule:
    """Without conditions that a later one on the same statistic and side implies."""
    return [c for k, c in enumerate(rule) if not any((c.name, c.above) == (d.name, d.above) for d in rule[k + 1 :])]


def learn_rules(values: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray, precision: float = 0.9, cuts: int = 200, most: int = 20) -> list[Rule]:
    """Conjunctions that cover the bad rows, in the order found.

    Each is grown on the rows marked ``grow`` that no earlier one covers, then cut back to the leading conditions that do best on the
    other rows. Learning ends when a rule's precision on those is below ``precision``, or after ``most`` rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most and (bad & left & grow).any():
        part = left & grow
        rule = _grow({k: v[part] for k, v in values.items()}, bad[part], cuts)
        rest = left & ~grow
        held = {k: v[rest] for k, v in values.items()}
        scores = []
        for k in range(1, len(rule) + 1):
            hit = covers(rule[:k], held)
            p, n = int((hit & bad[rest]).sum()), int((hit & ~bad[rest]).sum())
            scores.append(((p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0, k))
        if not scores:
            break
        _, sure, k = max(scores, key=lambda s: (s[0], -s[2]))
        if sure < precision:
            break
        rules.append(_plain(rule[:k]))
        left &= ~covers(rules[-1], values)
    return rules


def decision_list(rules: list[Rule]) -> Column:
    """True for rows to keep: the first rule that holds rejects, and rows that none covers stay."""
    out = F
    for rule in rules:
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column()
        out = out.when(test, F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def which_rule(rules: list[Rule]) -> Column:
    """The text of the rule that rejects a row, NULL for none."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column()
        out = F.when(test, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def fit_rules(counts: DataFrame, labels: DataFrame, max_rows: int = 20_000, precision: float = 0.9) -> list[Rule]:
    """Learn from labelled rows that the fixed rules let pass: at most ``max_rows`` of them, chosen by a hash of their id.

    ``labels`` has doc_id and quality (1 good, 0 bad). Rows without a label or an id are not used; several labels of one id count by
    majority, a tie as good. Two thirds of the sample grow the rules, a third cuts them back.
    """
    vote = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    rows = counts.where(~base_failed()).join(vote, "doc_id").select("bad", F.xxhash64("doc_id").alias("turn"), *[statistic(k).alias(k) for k in RATIOS])
    sample = rows.orderBy("turn", *RATIOS).limit(max_rows).toArrow()
    values = {k: sample[k].to_numpy().astype(float) for k in RATIOS}
    bad = sample["bad"].to_numpy().astype(bool)
    grow = sample["turn"].to_numpy() % 3 != 0
    return learn_rules(values, bad, grow, precision)


def apply_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, precision: float = 0.9) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, rule) for each row of ``docs`` (doc_id, text; others are not read).

    kept is false if the fixed rules fail (under 10 words, or over a fifth of them in repeated windows), else what the learned list
    says. NULL and empty texts fail; repeated rows get equal results; an empty table gives an empty result; without labels no rule is
    learned and the fixed ones decide alone.
    """
    counts = stage(text_counts(docs), "counts")
    rules = fit_rules(counts, labels, max_rows, precision)
    return counts.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & decision_list(rules)).alias("kept"), which_rule(rules).alias("rule"))

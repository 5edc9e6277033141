"""Benchmark decontamination by templates: windows with typed placeholders find alignments, whose slots are checked for consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.staging import fresh, stage
from cohortmill.llm.words import BASE, U, Words, ascii_lower, blocks, mix, run_hashes, text_bytes

#: Words that are units after a number, and words that are numbers.
UNITS = ["cm", "mm", "m", "km", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "mile", "miles", "inch", "inches", "feet", "foot", "g", "kg", "mg", "gram", "grams", "kilograms", "pound", "pounds", "ton", "tons", "l", "ml", "liter", "liters", "litre", "litres", "s", "ms", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "percent", "degrees", "celsius", "fahrenheit", "kelvin", "volts", "watts", "joules", "newtons", "hz", "mph"]
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million"]
#: Words that open sentences and are no names.
OPENERS = ["a", "an", "the", "this", "that", "these", "those", "there", "here", "it", "its", "he", "she", "they", "we", "you", "i", "his", "her", "their", "our", "my", "your", "what", "which", "who", "whose", "whom", "when", "where", "why", "how", "if", "in", "on", "at", "to", "of", "for", "from", "by", "with", "after", "before", "during", "while", "as", "and", "or", "but", "so", "then", "because", "since", "each", "every", "all", "some", "no", "not", "is", "are", "was", "were", "do", "does", "did", "has", "have", "had", "der", "die", "das", "ein", "eine", "es", "er", "sie", "wir", "ich", "was", "wer", "wie", "wo", "wann", "warum", "wenn", "und", "oder", "aber", "auf", "mit", "von", "zu", "le", "la", "les", "un", "une", "il", "elle", "nous", "vous", "ils", "que", "qui", "quel", "quelle", "comment", "quand", "pourquoi", "si", "et", "ou", "mais", "dans", "avec", "pour", "el", "los", "las", "una", "ella", "ellos", "cual", "como", "cuando", "donde", "y", "o", "pero", "en", "con", "por", "para"]

NUMBER, UNIT, NAME = (mix(np.array([k], U))[0] for k in (101, 102, 103))
SALT = U(0x5851F42D4C957F2D)
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
STOP = np.array([chr(b) in ".!?:;|" for b in range(256)])


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    out = ascii_lower(data)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + np.uint8(32), out).astype(np.uint8)


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Words:
    out = Words.__new__(Words)
    out.data, out.start, out.end = data, start, end
    return out


def _known(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    edges = np.cumsum([0, *map(len, raw)])
    return np.sort(_spans(np.frombuffer(b"".join(raw), np.uint8), edges[:-1], edges[1:]).hashes())


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    return known[at] == values if len(known) else np.zeros(len(values), bool)


class Templates:
    """Tokens of a block of texts: ``canon`` with placeholders, ``value`` as written, ``kind`` of placeholder (0 for none), and where each text begins (``first``).

    A token is a word without punctuation at its ends, in lower case; a word of punctuation alone is none. Numbers (figures, or
    number words), units after a number, and capitalised words within a sentence become placeholders. A capitalised word at the start
    of a text or sentence is a literal and may be a name as well (``maybe``), unless it is one of OPENERS.
    """

    def __init__(self, words: Words):
        data = words.data
        solid = np.flatnonzero(ALNUM[data])
        edge = np.searchsorted(solid, words.start)
        stop = np.searchsorted(solid, words.end)
        real = np.flatnonzero(stop > edge)
        start, end = solid[edge[real]], solid[stop[real] - 1] + 1
        text = words.text_of[real]
        low = lower(data)
        value = _spans(low, start, end).hashes()
        new_text = np.ones(len(real), bool)
        new_text[1:] = text[1:] != text[:-1]
        after_stop = np.ones(len(real), bool)
        after_stop[1:] = STOP[data[words.end[real[:-1]] - 1]] | (real[1:] != real[:-1] + 1)
        capital = (low[start] != data[start]) | ((data[start] == 0xC3) & (low[np.minimum(start + 1, len(low) - 1)] != data[np.minimum(start + 1, len(low) - 1)])) if len(real) else np.zeros(0, bool)
        number = DIGIT[data[start]] | _in(value, _known(NUMBERS))
        after_number = np.zeros(len(real), bool)
        after_number[1:] = number[:-1] & ~new_text[1:]
        unit = after_number & _in(value, _known(UNITS)) & ~number
        small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122) | (data >= 128) & (low == data))])
        capital &= small[end] > small[start]  # a word in capitals throughout is not a name
        capital &= ~number & ~unit
        opening = new_text | after_stop
        self.maybe = capital & opening & ~_in(value, _known(OPENERS))
        self.slot = number | unit | capital & ~opening
        self.kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(self.maybe | capital & ~opening, NAME, U(0))))
        self.canon, self.value, self.text = np.where(self.slot, self.kind, value), value, text
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(words.first) - 1))]).astype(np.int64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each window begins, its hash, how many of its words are literal, and whether it is a template.

        Every window is there as written, and as a template in each of its forms that has a placeholder: words that may be names count once
        as literal and once as names, each for itself.
        """
        n = len(self.value) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool)
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        total = np.concatenate([[0], np.cumsum(self.slot)])
        literal = size - (total[at + size] - total[at])
        salted = self.canon ^ SALT
        form = np.flatnonzero(literal < size)
        found = [(at, run_hashes(self.value, size)[at], np.full(len(at), size)), (at[form], run_hashes(salted, size)[at[form]], literal[form])]
        bits = np.zeros(len(at), np.int64)
        for k in range(size):
            bits |= self.maybe[at + k].astype(np.int64) << k
        some = np.flatnonzero(bits)
        for names in range(1, 1 << size):
            hit = some[(bits[some] & names) == names]
            if len(hit):
                h = np.zeros(len(hit), U)
                for k in range(size):
                    h = h * BASE + (NAME ^ SALT if names >> k & 1 else salted[at[hit] + k])
                found.append((at[hit], mix(h), literal[hit] - names.bit_count()))
        places, hashes, literals = (np.concatenate(x) for x in zip(*found, strict=True))
        return places, hashes, literals, np.arange(len(places)) >= len(at)


class Questions:
    """The items of a benchmark as tokens, and the windows (``seeds``) by which texts are aligned with them.

    All windows as written are seeds. Templates are if ``literals`` words are literal; where too few windows of an item have that many, the
    windows with the most literal words are too, so many that a text with ``share`` of the windows holds one. An item
    with fewer than ``literals`` words that can be literal is found as written only.
    """

    def __init__(self, texts: list[str], size: int, share: float, literals: int):
        found = Templates(Words(*text_bytes(pa.array(texts, pa.string()))))
        self.value, self.kind, self.maybe, self.first = found.value, found.kind, found.maybe, found.first
        self.share, self.literals = share, literals
        n = np.diff(self.first)
        self.size = np.minimum(size, n)
        self.windows = np.where(n > 0, n - self.size + 1, 0)
        need = np.ceil(share * self.windows - 1e-9).astype(np.int64)
        plain = np.concatenate([[0], np.cumsum(~found.slot & ~found.maybe)])
        open_words = np.concatenate([[0], np.cumsum(~found.slot)])
        self.template = open_words[self.first[1:]] - open_words[self.first[:-1]] >= literals
        hidden = np.zeros(len(n), np.int64)
        self.seeds = {}
        for length in np.unique(self.size[self.size > 0]).tolist():
            at, h, literal, template = found.windows(length)
            mine = self.size[found.text[at]] == length
            at, h, literal, template = at[mine], h[mine], literal[mine], template[mine]
            item = found.text[at]
            each = at[~template]
            sure = plain[each + length] - plain[each]
            order = np.lexsort((each, -sure, found.text[each]))
            turn = np.arange(len(each)) - np.searchsorted(found.text[each[order]], found.text[each[order]])
            owner = found.text[each[order]]
            chosen = np.zeros(len(found.value), bool)
            chosen[each[order][(turn <= self.windows[owner] - need[owner]) & (sure[order] > 0)]] = True
            seed = ~template | self.template[item] & ((literal >= literals) | chosen[at])
            dropped = np.unique(at[~seed & self.template[item]])
            hidden += np.bincount(found.text[dropped], minlength=len(n))
            at, h, item = at[seed], h[seed], item[seed]
            order = np.argsort(h, kind="stable")
            keys, begin = np.unique(h[order], return_index=True)
            self.seeds[length] = keys, np.append(begin, len(order)), item[order], (at - self.first[item])[order]
        self.least = need - hidden

    def aligned(self, found: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, start): alignments of texts with items that share a seed, if the seeds met and the windows without seeds can make the share."""
        out = []
        for length, (keys, begin, items, places) in self.seeds.items():
            at, h, _, _ = found.windows(length)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[k] == h)
            hit = hit[np.argsort(at[hit], kind="stable")]
            sizes = begin[k[hit] + 1] - begin[k[hit]]
            so_far = np.cumsum(sizes)
            text = found.text[at[hit]]
            low = 0
            while low < len(hit):  # texts by the million entries, or one
                high = int(np.searchsorted(so_far, so_far[low] - sizes[low] + 1_000_000, "right"))
                high = max(int(np.searchsorted(text, text[min(high, len(hit) - 1)], "left")), int(np.searchsorted(text, text[low], "right"))) if high < len(hit) else high
                n = sizes[low:high]
                entry = np.repeat(begin[k[hit[low:high]]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                of, item, place = np.repeat(text[low:high], n), items[entry], places[entry]
                start = np.repeat(at[hit[low:high]], n) - place
                pair, inverse = np.unique(of * len(self.size) + item, return_inverse=True)
                met = np.unique(inverse * (int(places.max()) + 1) + place) // (int(places.max()) + 1)
                enough = np.bincount(met, minlength=len(pair)) >= self.least[pair % len(self.size)]
                out.append(np.unique(np.stack([of, item, start], 1)[enough[inverse]], axis=0))
                low = high
        return tuple(np.concatenate(out).T) if out else (np.zeros(0, np.int64),) * 3

    def held(self, item: int, found: Templates, text: int, starts: np.ndarray) -> int:
        """How many windows of the item the text holds, as written or as templates, with the item's first word at any of ``starts``."""
        size, first, last = int(self.size[item]), int(self.first[item]), int(self.first[item + 1])
        got = np.zeros(self.windows[item], bool)

        def whole(fits: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(fits)])
            return total[size:] - total[:-size] == size

        for start in starts.tolist():
            low, high = max(0, int(found.first[text]) - start), min(last - first, int(found.first[text + 1]) - start)
            mine, theirs = slice(first + low, first + high), slice(start + low, start + high)
            same = self.value[mine] == found.value[theirs]
            slot = (self.kind[mine] == found.kind[theirs]) & (self.kind[mine] != 0) & ~(same & (self.maybe[mine] | found.maybe[theirs]))
            written = whole(same)
            got[low : low + len(written)] |= written
            fits = whole(same | slot)
            if not self.template[item] or not (fits & ~written).any():
                continue
            edges = np.zeros(high - low + 1, np.int64)
            edges[: len(fits)] += fits
            edges[size : size + len(fits)] -= fits
            inside = np.cumsum(edges[:-1]) > 0
            if (inside & same & ~slot).sum() < self.literals:
                continue
            at = np.flatnonzero(inside & slot)
            pairs, place, inverse, count = np.unique(np.stack([self.value[mine][at], found.value[theirs][at]], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
            agreed = np.zeros(len(pairs), bool)
            there, back = set(), set()
            for p in np.lexsort((place, -count)).tolist():
                a, b = pairs[p].tolist()
                if a not in there and b not in back:
                    agreed[p] = True
                    there.add(a)
                    back.add(b)
            right = same | slot
            right[at[~agreed[inverse.ravel()]]] = False
            got[low : low + len(fits)] |= whole(right)
        return int(got.sum())

    def met(self, found: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, share) of the items of which a text holds the share."""
        text, item, start = self.aligned(found)
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        heads = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
        out = []
        for low, high in zip(heads.tolist(), [*heads[1:].tolist(), len(text)], strict=False):
            part = self.held(int(item[low]), found, int(text[low]), start[low:high]) / int(self.windows[item[low]])
            if part >= self.share:
                out.append((text[low], item[low], part))
        return tuple(np.array([o[k] for o in out], kind) for k, kind in enumerate((np.int64, np.int64, float)))


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", size: int = 5, share: float = 0.8, literals: int = 3, most_windows: int = 2_000_000) -> DataFrame:
    """(k1, k2, item_id, share): documents that hold at least ``share`` of the windows of a benchmark item, as written or as templates.

    k1 and k2 are hashes of the document's id and text. Windows with enough literal words find alignments of documents and items; along
    each, every window is compared, those full of placeholders too. A window counts as written, or if its placeholders agree with the map of the
    alignment, in which each value of the item stands for one value of the document and the other way round (the commoner pair, then
    the earlier, wins) and for which ``literals`` words are the same. So an item with other numbers or names is found and a chance meeting
    of placeholders is not. The items are sent along in parts of about ``most_windows`` words, the documents passed once for each part.
    """
    items = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct().withColumn("i", F.xxhash64("text"))
    names = stage(items, "benchmark-items")
    distinct = names.select("i", "text").distinct()
    total = distinct.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n_parts = max(1, -(-total // max(1, most_windows)))
    part = F.pmod(F.col("i"), F.lit(n_parts))
    rows = docs.select(F.xxhash64(F.col(id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"), F.col(text).alias("text"))
    schema = "k1 long, k2 long, i long, share double"
    found = docs.sparkSession.createDataFrame([], schema)
    for k in sorted(r[0] for r in distinct.select(part).distinct().collect()):
        asked = distinct.where(part == k).orderBy("i", "text").collect()
        keys = np.array([r["i"] for r in asked], np.int64)
        questions = Questions([r["text"] for r in asked], size, share, literals)
        found = found.unionByName(rows.mapInArrow(_search(questions, keys), schema))
    named = found.join(F.broadcast(names.select("item_id", "i")) if n_parts == 1 else names.select("item_id", "i"), "i")
    return named.groupBy("k1", "k2", "item_id").agg(F.max("share").alias("share"))


def _search(questions: Questions, keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            text, item, share = questions.met(Templates(words))
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(k1[text]), pa.array(k2[text]), pa.array(keys[item]), pa.array(share)], ["k1", "k2", "i", "share"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, n_items, items, share) for each row of ``docs``: the items found, by id and joined by commas, and the best share.

    NULL and empty texts hold nothing. An item without words is never found; one with fewer words than a window is
    one window of its own length, found wherever a document has these words in a row. Repeated rows get equal results; an empty table or an empty benchmark gives no leak. Only the id and
    the text are read.
    """
    found = leaks(docs, benchmark, **options).groupBy("k1", "k2").agg(F.array_join(F.transform(F.sort_array(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("items"), F.count_distinct("item_id").alias("n"), F.max("share").alias("share"))
    id, text = options.get("id", "doc_id"), options.get("text", "text")
    rows = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.col(id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"))
    met = rows.join(found, ["k1", "k2"], "left")
    return met.select("doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_rows: int = 1_000_000, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. Up to ``most_rows`` of these are broadcast; more are met by a shuffle."""
    id, text = options.get("id", "doc_id"), options.get("text", "text")
    k1, k2 = fresh(docs, "row_key_1", "row_key_2")
    found = stage(leaks(docs, benchmark, **options).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "leaks")
    keyed = docs.withColumns({k1: F.xxhash64(F.col(id)), k2: F.xxhash64(F.col(text))})
    few = found.count() <= most_rows
    return keyed.join(F.broadcast(found) if few else found, [k1, k2], "left_anti").drop(k1, k2)

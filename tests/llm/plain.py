"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text, size=3):
    w = words(ascii_lower(text or ""))
    shingles = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits=2):
    """The smallest position reachable from each position."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def line_key(line):
    return ascii_lower(line.strip(SPACE))


def dedup_lines(texts, min_docs=10):
    """(kept text, lines, lines dropped) of each text."""
    found = Counter(k for t in texts for k in {line_key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not line_key(x) or found[line_key(x)] < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def without_repeats(rows, size=20):
    """{id: (words, removed, kept)} of rows (id, text) with distinct ids."""
    first, texts = {}, {d: words(t) for d, t in rows}
    for d in sorted(texts):
        for k in range(len(texts[d]) - size + 1):
            first.setdefault(tuple(texts[d][k : k + size]), (d, k))
    out = {}
    for d, w in texts.items():
        gone = {p for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] != (d, k) for p in range(k, k + size)}
        out[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def leaked_items(text, items, size=5, share=0.8):
    """Items of whose windows, as written without punctuation, the text holds the share."""

    def tokens(t):
        return [x for x in (re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in words(t)) if x]

    def windows(t):
        w = tokens(t)
        return [tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []

    own = set(windows(text))
    return {i for i, t in items.items() if (w := windows(t)) and sum(x in own for x in w) >= share * len(w)}


def ownership(values):
    """Distinct documents and owners of each value, from (value, document, owner)."""
    docs, owners = defaultdict(set), defaultdict(set)
    for value, doc, owner in values:
        docs[value].add(doc)
        if owner is not None:
            owners[value].add(owner)
    return {v: (len(docs[v]), len(owners[v])) for v in docs}


def letters(text, digits):
    """Runs of letters A to Z (and digits) and of characters beyond ASCII, A-Z in lower case."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def run_buckets(text, most=3, n=10_000):
    w = letters(text, True)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def importance(rows, target, percent=5, min_words=20, seed=42, n=10_000):
    """(n_features, weight, score, rank) of each (id, text), by position."""
    found = [run_buckets(t) for _, t in rows]
    s, t = Counter(b for f in found for b in f), Counter(b for x in target for b in run_buckets(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + n) / ((s[b] + 1) * (big_t + n)))) for b in range(n)]
    out = []
    for (id, _), f in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((k for k, (_, t) in enumerate(rows) if len(letters(t, True)) >= min_words), key=lambda k: (-out[k][2], rows[k][0] is not None, rows[k][0] or 0))
    for place, k in enumerate(able[: percent * len(able) // 100]):
        out[k][3] = place + 1
    return [tuple(x) for x in out]


def divergence(rows, min_docs=10, top=10):
    """(lang, source, part, item, value, rank) of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, used, whole = Counter(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = Counter(letters(text, False))
        docs.update((lang, t) for t in terms)
        used[lang, source].update(terms)
        whole[lang].update(terms)
    out = []
    for lang in {lang for _, lang, _ in rows}:
        kept = [t for t in whole[lang] if docs[lang, t] >= min_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        p = {source: shares(used[k]) for k in used if k[0] == lang for source in [k[1]]}
        q = shares(whole[lang])
        for a in p:
            pairs = [(b, sum(apart(p[a][t], p[b][t]) for t in kept)) for b in p if b != a]
            marks = [(t, apart(p[a][t], q[t])) for t in kept if used[lang, a][t] and p[a][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", marks, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, a, part, item, value, k + 1))
    return out


def unigram_scores(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each (id, text)."""
    held = [zlib.crc32(("" if id is None else str(id)).encode()) % 10 == 0 for id, _ in rows]
    tokens = [[*words(ascii_lower(text or "")), ""] for _, text in rows]
    c = Counter(t for h, ts in zip(held, tokens, strict=True) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    return [(h, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) for h, ts in zip(held, tokens, strict=True)]

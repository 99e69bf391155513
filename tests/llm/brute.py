"""Plain-Python models of the operators, for small tables."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
NORMAL = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(values, seed=42):
    """xxhash64 of a list of longs, as Spark chains it."""
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
    return signed(seed)


def word_hash(word):
    return signed(xxhash.xxh64(word.encode(), seed=42).intdigest())


def base_rules(text):
    w = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    hit = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": len(w) < 20 or 100 * len(hit) > 30 * len(w),
    }


def buckets(text, size):
    h = [word_hash(w) for w in words(text)]
    return [x % size for x in h] + [spark_hash(h[i : i + 2]) % size for i in range(len(h) - 1)]


def shingles(text):
    w = words(fold(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_groups(rows):
    """{doc_id: component} for (doc_id, text) rows without null ids."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in root}


def repeats(rows, window=20):
    """[(doc_id, n_words, n_removed, kept)] for (doc_id, text) rows with distinct ids."""
    first, out = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in first:
                gone.update(range(i, i + window))
            else:
                first[key] = (d, i)
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contaminated(text, items, size=10):
    """(n_words, n_hit, sorted item names) for items [(item_id, text)]."""
    w = NORMAL.findall(fold(text))
    hit, found = set(), set()
    for item, body in items:
        b = NORMAL.findall(fold(body))
        k = min(size, len(b))
        wanted = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in wanted:
                hit.update(range(i, i + k))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """{source: target} by filling up one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values()) * share
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not full:
            target.update({s: weight[s] * level for s in free})
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def best_fit(lengths, size):
    """Row loads of best-fit-decreasing, by looking at every row."""
    rows = []
    for n in lengths:
        fits = [i for i, load in enumerate(rows) if load + n <= size]
        if fits:
            rows[max(fits, key=lambda i: rows[i])] += n
        else:
            rows.append(n)
    return sorted(rows)


def by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out

"""A small table with everything an operator may meet, and plain-Python versions of what the operators return."""

import hashlib
import random
import re
from collections import defaultdict

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, block int, node string, row string, score double, "
    "size long, target double, label string, token long, `odd name` string"
)
SPACE = "[^\x20\x09-\x0d]+"
ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, count, vocabulary=400):
    chosen = random.Random(seed)
    return [f"w{chosen.randrange(vocabulary)}é" if chosen.random() < 0.1 else f"Wo{chosen.randrange(vocabulary)}" for _ in range(count)]


def texts():
    base = prose(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    passage = prose(2, 60)
    long = prose(3, 30_000, 50_000)
    out = [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one",
        "One",
        "a b c d",
        "a  b\tc\nd",
        "12 34 !!! ??",
        "日本語のテキスト ですよ 。",
        "€ … «»",
        " ".join(base),
        " ".join(base),
        "\n".join(base) + "  ",
        " ".join(near),
        " ".join(near[:-1]),
        " ".join(prose(4, 80) + passage + prose(5, 80)),
        " ".join(prose(6, 80) + passage + prose(7, 40)),
        " ".join(passage),
        " ".join(long),
        " ".join(long[:20_000] + passage),
        "same " * 300,
        "same " * 299 + "same",
        "x" * 5_000,
        "é" * 400,
        "A" * 49,
        "A" * 50,
        "Released under the MIT License. idiot scum trash!!!",
        " ".join(prose(8, 30)) + " Licensed under the Apache License, Version 2.0. " + " ".join(prose(9, 30)),
    ]
    return out


def rows():
    out, n = [], 0
    for i, text in enumerate(texts()):
        source = None if i % 7 == 3 else f"src{i % 3}"
        out.append((i + 1, text, None if i % 5 == 0 else ("en", "fr")[i % 2], source))
        n = i + 2
    out.append(out[10])  # a repeated row
    out.append((None, texts()[10], None, None))  # no doc_id
    out.append((None, " ".join(prose(30, 50)), "en", "src1"))
    out.append((5, "another text under a used id " + " ".join(prose(31, 40)), "fr", "src2"))
    out += [(n + i, " ".join(prose(40 + i, 30 + 7 * i)), "en", "src0") for i in range(12)]
    return [(*r, len(r[1] or ""), 1, "n", "r", 0.5, 3, 1.5, "l", 7, "odd") for r in out]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def words(text, pattern=SPACE, lower=False):
    text = text or ""
    return re.findall(pattern, text.translate(LOWER) if lower else text)


def order(doc_id):
    return float("inf") if doc_id is None else doc_id


def sha(data):
    return hashlib.sha256(data).hexdigest()


def substring_dedup(given, window=13):
    """doc_id, n_words, n_removed, digest of the kept words, for every row."""
    first = {}
    for doc_id, text in given:
        w = words(text)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, float("inf")), order(doc_id))
    out = []
    for doc_id, text in given:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < order(doc_id):
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), sha(kept.encode())))
    return out


def byte_dedup(given, length=50):
    """doc_id, n_bytes, n_removed, n_spans, digest of the kept bytes, for every row."""
    first = {}
    for doc_id, text in given:
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], float("inf")), order(doc_id))
    out = []
    for doc_id, text in given:
        b = (text or "").encode()
        gone = bytearray(len(b))
        reach = 0
        for s in range(len(b)):
            if s + length <= len(b) and first[b[s : s + length]] < order(doc_id):
                reach = s + length
            gone[s] = s < reach
        spans = sum(1 for s in range(len(b)) if gone[s] and (s == 0 or not gone[s - 1]))
        out.append((doc_id, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingle_set(text, size=5):
    w = words(text, lower=True)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_components(given):
    """doc_id, n_shingles, component_id, for every row."""
    sets = [shingle_set(t) for _, t in given]
    parent = list(range(len(given)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            held[shingle].append(i)
    pairs = {(a, b) for g in held.values() for a in g for b in g if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(given):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return [
        (doc_id, len(sets[i]), min(least[root(i)], default=None) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(given)
    ]


def item_windows(text, window=10):
    w = words(text, ALNUM, lower=True)
    if not w:
        return set()
    n = min(window, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def contamination(given, items, window=10):
    """doc_id, n_words, hit words, sorted item names, for every row."""
    known = defaultdict(set)
    for item_id, text in items:
        for key in item_windows(text, window):
            known[key].add(item_id)
    sizes = {len(k) for k in known}
    out = []
    for doc_id, text in given:
        w = words(text, ALNUM, lower=True)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                names = known.get(tuple(w[s : s + n]))
                if names:
                    hit.update(range(s, s + n))
                    found |= names
        out.append((doc_id, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out

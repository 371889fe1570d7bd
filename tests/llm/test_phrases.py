"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np

from ndspark.llm import phrases
from ndspark.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plainly(docs, longest=3, least=10, inside=50, first=2000):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    whole = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in whole.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= inside * f[lang, w[i : i + k]]:
                    covered.add((lang, w[i : i + k]))
    out = []
    for lang in {x for x, _ in whole}:
        rows = []
        for (own, w), a in whole.items():
            if own == lang and (lang, w) not in covered:
                score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                rows.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def table(spark, docs):
    return spark.createDataFrame([(i, t, g, "clash", 1, "x") for i, (g, t) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, f long, words string")


def found(spark, docs, **more):
    return sorted(map(tuple, phrases.collocations(table(spark, docs), **more).collect()))


def corpus(seed, n, vocabulary=9):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "ça", "New", "YORK", " x", "a\u001cb", "日本"]
    gaps = [" "] * 12 + ["  ", "\t", ", ", ". ", "\n", "\r\n", "!?", ";", " : ", "\x0b"]
    return [(r.choice(["en", "en", "en", "de", None, "und"]), "".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(60)))) for _ in range(n)]


def test_as_by_plain_counting(spark):
    docs = corpus(1, 700) + [("en", None), ("en", ""), (None, " \n"), ("fr", "New York " * 12), ("fr", "new york, " * 15)] + [corpus(2, 1)[0]] * 30
    want = plainly(docs)
    assert len(want) > 100 and {x[0] for x in want} >= {"en", "und", "fr"}
    assert found(spark, docs) == want
    assert found(spark, docs, shard_words=50) == want
    assert found(spark, docs, longest=4, least=4, inside=70, first=40, shard_words=300) == plainly(docs, 4, 4, 70, 40)
    assert found(spark, docs, longest=2) == plainly(docs, 2)
    assert found(spark, docs[:0]) == []


def test_very_long_texts_are_read_in_slices(spark):
    r = random.Random(5)
    long = "".join(r.choice(["aa", "b", "ccc", "x" * 90]) + r.choice([" ", " ", " ", "\n"]) for _ in range(30_000))
    for size in (64, 1000, 10**9):
        seen, held = Counter(), []
        for some, over in phrases.tokens(long.encode(), size):
            some = held + some
            keep = 0 if over else 2
            seen.update(tuple(some[i : i + 3]) for i in range(len(some) - keep) if b"" not in some[i : i + 3] and i + 3 <= len(some))
            held = some[len(some) - keep :] if keep else []
        assert seen == Counter(tuple(w.encode() for w in p[i : i + 3]) for p in (x.split() for x in long.split("\n")) for i in range(len(p) - 2))
    docs = [("en", long), ("en", "y" * 300_000 + " aa b")]
    before = phrases.SLICE
    try:
        phrases.SLICE = 1 << 12
        assert found(spark, docs, shard_words=1000) == plainly(docs)
    finally:
        phrases.SLICE = before


def test_suffixes_and_intervals():
    r = np.random.default_rng(3)
    seq = np.append(r.integers(0, 4, 4000), 0)
    order = phrases.suffixes(seq, np.flatnonzero(seq), 5)
    keys = [tuple(seq[i : i + 5]) for i in order]
    assert keys == sorted(keys)
    for n, (at, count) in enumerate(phrases.intervals(seq, order, 5), 1):
        want = Counter(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1) if seq[i : i + n].all())
        assert dict(zip((tuple(seq[i : i + n]) for i in at), count)) == want


def test_only_extensions_of_frequent_phrases_are_counted(spark):
    docs = table(spark, corpus(7, 120))
    with Scratch(spark) as scratch:
        counts = {(r["lang"], r["phrase"]): r["f"] for r in phrases.phrase_counts(docs, scratch, least=6).collect()}
    assert all(counts[x, " ".join(p.split(" ")[:2])] >= f and counts[x, " ".join(p.split(" ")[1:])] >= f for (x, p), f in counts.items() if p.count(" ") == 2)

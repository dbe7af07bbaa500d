"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusgauge.llm import collocations as C
from corpusgauge.llm.collocations import CollocationParams, collocations, frequent_phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest=3):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return f, total


def brute(rows, p=CollocationParams(), top=2000):
    f, total = counted(rows, p.longest)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= p.least}
    out = {}
    for (lang, w), a in candidates.items():
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(la == lang and len(v) > len(w) and 100 * b >= p.inside * a
                     and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (la, v), b in candidates.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, ph.decode(), -a, left, right, total[lang], -s)
                  for lang, found in out.items() for i, (s, a, ph, left, right) in enumerate(sorted(found)[:top]))


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    words = ["The", "of", "and", "é", "É", "漢字", "new", "york", "City", "a-b", " ", "x\x1cy", "%"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda k: "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?", "\x0b"]) for w in rng.choices(words, weights, k=k))
    rows = [(rng.choice(["en", "en", "en", "de", None, "", "漢"]), text(rng.randrange(1, 200)) + rng.choice(["", "new york city hall", "New York"]))
            for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, None), ("fr", "one two"), ("en", "a a a a a a a a a a a a"), ("en", " \t.")] + rows[:20]


@pytest.mark.parametrize("p", [CollocationParams(), CollocationParams(chunk=700, partition=9000, slack=1),
                               CollocationParams(longest=4, least=6, inside=70, chunk=3000, partition=1 << 30)])
def test_matches_plain_counting(spark, p):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, P int").repartition(4)
    want = brute(rows, p)
    assert sorted(tuple(r) for r in collocations(df, p=p).collect()) == want
    assert len(want) > 40 and {w[0] for w in want} >= {"en", "und", ""}


def test_all_frequent_phrases_with_exact_counts(spark):
    rows = corpus(9, 200)
    df = spark.createDataFrame(rows, "lang string, text string")
    p = CollocationParams(chunk=2000, partition=4000, slack=1)
    got = {(r.lang, r.phrase): r.n for r in frequent_phrases(df, p=p).filter("size > 0").collect()}
    f, _ = counted(rows)
    assert got == {(lang, " ".join(w)): n for (lang, w), n in f.items() if n >= p.least}


def test_top_and_empty(spark):
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations(df, top=3).collect()) == brute(rows, top=3)
    assert collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_frequent_keys_survive_all_merges(seed):
    rng = np.random.default_rng(seed)
    p = CollocationParams(least=10, slack=1)
    parts = [np.unique((rng.zipf(1.2, 3000) % 100_000).astype(np.uint64), return_counts=True) for _ in range(12)]
    # adversarial: keys that come ten times, once in each of ten parts
    parts = [(np.concatenate([k, np.arange(200_000, 200_300, dtype=np.uint64)]), np.concatenate([c, np.ones(300, np.int64)]))
             if i < 10 else (k, c) for i, (k, c) in enumerate(parts)]
    total = Counter()
    for k, c in parts:
        total.update(dict(zip(k.tolist(), c.tolist())))
    mass = sum(total.values())
    rows = [(C.packed_keys(k), C.packed_list(c.astype("<u4"))) for k, c in parts]
    summary = C.merged(rows, mass, p)
    assert summary.taken < p.least and len(summary.keys) <= summary.capacity < len(total)
    assert {k for k, n in total.items() if n >= p.least} <= set(summary.reaching(p.least).tolist())
    alive = summary.reaching(p.least)
    assert C.counted(rows, alive).tolist() == [total[k] for k in alive.tolist()]
    for k, n in zip(summary.keys.tolist(), summary.counts.tolist()):
        assert n <= total[k] <= n + summary.taken


def test_long_texts_are_cut_at_pieces():
    text = b"a b c. d e! " * 500 + b"tail without end"
    parts = C.cut_at_pieces(text, 100)
    assert b"".join(parts) == text and len(parts) > 40 and all(x[-1:] in b".!" for x in parts[:-1])
    assert C.cut_at_pieces(b"x " * 500, 100) == [b"x " * 500]


def test_scores_pass_64_bits(spark):
    rows = [("en", 1, "x", 3 * 10**12), ("en", 1, "y", 5 * 10**12), ("en", 2, "x y", 2 * 10**12)]
    got = C.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n bigint")).collect()
    assert [(r.l, r.r, r.score) for r in got] == [(3 * 10**12, 5 * 10**12, 10**6 * 4 // 15)]


def test_packed_keys_and_partitions():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    keys = np.unique(np.concatenate([keys, np.array([0, 2**64 - 1], np.uint64)]))
    assert (C.unpacked_keys(C.packed_keys(keys)) == keys).all() and len(C.unpacked_keys(C.packed_keys(keys[:0]))) == 0
    for n in (1, 2, 7, 1000):
        assert len(C.bounds(n)) == n - 1 and (np.diff(C.bounds(n)) > 0).all()


def test_words_of_chunks_without_frequent_phrases_count(spark):
    rows = [("en", "one two three")] + [("en", "a b")] * 12
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = collocations(df, p=CollocationParams(chunk=5)).collect()
    assert [(r.phrase, r.a, r.n) for r in got] == [("a b", 12, 27)]

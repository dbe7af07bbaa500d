"""Repeated runs of words against a dictionary of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from corpusgauge.llm import substrings as S
from corpusgauge.llm.substrings import SubstringParams, remove_repeated_words


def brute(rows, length=35):
    texts = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(t[i:i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[tuple(t[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(t), sum(gone), spans, b" ".join(w for w, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def rows_of(df):
    got = df.collect()
    for r in got:
        assert sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed
    return sorted(((r.id, r.n_words, r.n_removed, len(r.starts), bytes(r.kept)) for r in got), key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "漢字", "a b", "x", "Y", "y"] + [f"w{i}" for i in range(40)]
    words = lambda n: rng.choices(vocabulary, k=n)
    space = lambda ws: "".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b "]) for w in ws)
    passages = [words(rng.choice([20, 34, 35, 36, 50, 90, 300])) for _ in range(12)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += words(rng.randrange(0, 60))
            if rng.random() < 0.7:
                passage = rng.choice(passages)
                a = rng.randrange(len(passage) // 2)
                parts += passage[a:a + rng.randrange(len(passage))]
        out.append(space(parts))
    base, line = words(150), words(50)
    for i in range(25):  # edited copies
        edited = list(base)
        for _ in range(i % 7):
            edited[rng.randrange(len(edited))] = "EDIT"
        out.append(space(edited))
    out += [space(words(40) + line + words(40)) for _ in range(40)]   # one line, many contexts
    out += [space(base), space(base), "a " * 100, "a " * 34, "b " * 35, "b " * 36, "p q " * 60, "", None, " \n", "one two",
            "x y z " * 200, space(words(900)), space(passages[0] * 5), "c " * 35, "c " * 35, "d " * 34 + "e"]
    return out


@pytest.mark.parametrize("p", [SubstringParams(), SubstringParams(group=2, piece=120, gram=4, batch=7, salt=3)])
def test_matches_brute_force(spark, p):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, th int").repartition(4)
    want = brute(rows)
    assert rows_of(remove_repeated_words(df, p=p)) == want
    assert sum(w[2] > 0 for w in want) > 80


def test_short_windows(spark):
    rows = list(enumerate(corpus(8)[:60]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    p = SubstringParams(length=5, gram=3, group=10, piece=50)
    assert rows_of(remove_repeated_words(df, p=p)) == brute(rows, 5)


def test_nulls_repeats_and_empty(spark):
    t = " ".join(random.Random(1).choices("abcdefgh", k=90))
    rows = [(None, t), (None, t[:80]), (1, t[20:] + " x"), (1, "y " * 40), (1, "y " * 40), (2, None)]
    rows += [(7, " ".join(f"v{i}" for i in range(300)))] * 40   # equal rows
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(remove_repeated_words(df)) == brute(rows)
    assert remove_repeated_words(df.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(4)
    words = [f"{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[500:620])), (2, " ".join(words[59_000:59_033])), (3, " ".join(words[::-1]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(remove_repeated_words(df, p=SubstringParams(piece=7000))) == brute(rows)


def test_subtrees_have_the_depths():
    p = SubstringParams(length=4, gram=2)
    phrases = [b"a b c d e f".split(), b"a b c d e x".split(), b"z b c d e f".split(), b"a b c q".split()]
    # windows and the anchor's place in the phrase; all anchors are "b c"
    ats = np.array([2 << 8 | 1, 2 << 8 | 1, 2 << 8 | 1, 0 << 8 | 1])
    of, number, depth = S.deep_suffixes(np.zeros(4, np.int64), ats, phrases, p)
    got = {(int(a), int(b)): int(c) for a, b, c in zip(of, number, depth)}
    assert got == {(0, 0): 5, (1, 0): 5, (0, 1): 5, (2, 1): 5, (1, 1): 4, (0, 2): 4, (2, 2): 4}


def test_query_equals_its_sql_on_the_small_table(spark):
    import hashlib

    from corpusgauge.llm.queries import llm_queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = llm_queries()["op12_repeated_words"].build(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(
        ((k, n, m, hashlib.sha256(b).hexdigest()) for k, n, m, _, b in brute(rows)), key=str)

"""Repeated passages against a dictionary of all 200-byte strings."""

import hashlib
import random
from collections import Counter

from corpusgauge.llm.repeats import RepeatParams, remove_repeats


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(t), sum(gone), spans, kept))
    return sorted(out, key=str)


def rows_of(df):
    got = df.collect()
    for r in got:
        assert sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed
    return sorted(((r.id, r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in got), key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "é", "ü", " ", " ", "ing", "a", "\n", "漢"]
    text = lambda n: "".join(rng.choices(syllables, k=n))
    passages = [text(rng.choice([60, 90, 110, 130, 250, 700])) for _ in range(12)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(text(rng.randrange(0, 200)))
            if rng.random() < 0.7:
                passage = rng.choice(passages)
                a = rng.randrange(len(passage) // 2)
                parts.append(passage[a:a + rng.randrange(len(passage))])
        out.append("".join(parts))
    base = text(500)
    for i in range(25):  # edited copies, edits some 100 bytes apart
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = "X"
        out.append("".join(words))
    out += [base, base, "a" * 700, "a" * 199, "b" * 200, "b" * 201, "ab" * 150, "", None, "short", "xyz" * 1000, text(3000)]
    out += [passages[0] * 5, "c" * 200, "d" * 199 + "e", "c" * 200]
    return out


def test_matches_brute_force(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lo int").repartition(4)
    want = brute(rows)
    assert rows_of(remove_repeats(df)) == want
    assert rows_of(remove_repeats(df, p=RepeatParams(chunk=2000, gram=20, block=5))) == want
    assert sum(w[2] > 0 for w in want) > 30


def test_nulls_repeats_and_empty(spark):
    t = "".join(random.Random(1).choices("abcdef ", k=400))
    rows = [(None, t), (None, t[:250]), (1, t[100:350] + "x"), (1, "y" * 250), (1, "y" * 250), (2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(remove_repeats(df)) == brute(rows)
    assert remove_repeats(df.limit(0)).count() == 0


def test_query_on_the_small_table(spark):
    from corpusgauge.llm.queries import llm_queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = llm_queries()["op7_repeated_passages"].build(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(
        ((k, n, m, s, hashlib.sha256(b).hexdigest()) for k, n, m, s, b in brute(rows)), key=str)

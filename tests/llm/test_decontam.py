"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

from corpusgauge.llm.decontam import (DecontamParams, Phrases, build_index, contamination, drop_contaminated, n_hit,
                                      near_hits)
from corpusgauge.llm.common import written

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for key, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, passage in items:
            t = words(passage)
            if item is None or not t:
                continue
            size = min(window, len(t))
            grams = {tuple(t[i:i + size]) for i in range(len(t) - size + 1)}
            for i in range(len(ws) - size + 1):
                if tuple(ws[i:i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        out.append((key, len(ws), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def data():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "naïve", "the", "of"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 9, 10, 11, 40])))) for i in range(14)]
    items += [(90, None), (91, "... !!"), (None, "w1 w2 w3"), (92, "The END"), (93, items[3][1])]
    docs = []
    for i in range(80):
        text = " ".join(rng.choices(vocab, k=rng.choice([0, 5, 60, 200])))
        if i % 3 == 0:
            passage = items[rng.randrange(14)][1].upper().replace("ÉTÉ", "Été").replace("NAÏVE", "naïve")
            text = f"{text}. {passage}, {text[:50]} the-end"
        docs.append((i, text))
    return docs + [(7, docs[3][1]), (None, docs[6][1]), (200, None), (201, ""), (202, "--"), (None, None)], items


def rows(df):
    got = df.withColumn("n", n_hit()).collect()
    for r in got:
        assert all(a < b for a, b in zip(r.starts, r.ends)) and all(b < a for b, a in zip(r.ends, r.starts[1:]))
    return sorted(((r.id, r.n_words, r.n, tuple(r["items"])) for r in got), key=str)


def test_matches_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(*r, "s") for r in docs], "doc_id bigint, text string, shard string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert rows(contamination(d, b)) == want
    # small shards, and items in several blocks
    assert rows(contamination(d, b, p=DecontamParams(shard_bytes=2000, block_chars=600))) == want
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [docs[i] for i in range(len(docs)) if not [x for x in brute([docs[i]], items) if x[2]]], key=str)


def test_empty_tables(spark):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(contamination(d, b.limit(0))) == brute(docs, [])
    assert contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "gamma alpha beta"), (3, "alpha beta"),
                               (4, "alpha " + "x " * 20 + "beta gamma"), (5, "beta gamma. alpha")], "doc_id bigint, text string")
    phrases = Phrases([("q", b"alpha beta gamma")], 10)
    index = written(build_index(d, "text", "doc_id", list(phrases.terms)), "index")
    got = {(r.id, r.item) for r in near_hits(index, phrases, 5).collect()}
    assert got == {(1, "q"), (2, "q"), (5, "q")}


def test_query_against_brute_force(spark):
    from corpusgauge.llm.queries import llm_queries

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = llm_queries()["op9_decontamination"].build(spark, sf).collect()
    want = [(k, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for k, n, h, i in brute(docs, items)]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == want
    assert any(r.contaminated for r in got)

"""Licence scan: held-out accuracy, the unknown class, and that skipping paragraphs is exact."""

import re

import pytest
from pyspark.sql import functions as F

from corpusgauge.llm import license_scan as L
from corpusgauge.llm.license_data import TEMPLATES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, L.train(docs)


def test_held_out_accuracy(spark, trained):
    _, model = trained
    rows = L.altered(L.templates(spark), L.LicenseParams()).filter("copy % 4 = 3 and label <> 'unknown'")
    docs = rows.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.col("label").alias("license"))
    got = L.scan(docs, model).withColumnRenamed("license", "found").join(docs, F.col("id") == F.col("doc_id"), "right")
    right = got.filter("found = license").count()
    wrong = got.filter("found <> license and found <> 'unknown'").count()
    total = docs.count()
    assert right >= 0.9 * total and wrong <= 0.02 * total


def test_unknown_and_none(spark, trained):
    _, model = trained
    rows = [(1, "Released under the MIT License."), (2, "Licensed under the Example Vendor Community License."),
            (3, "The quick brown fox. Nothing here is a notice at all."), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0."),
            (None, "Licensed under CC BY-NC 4.0."), (6, "x\n" * 3000 + "Licensed under the Apache License, Version 2.0."),
            (7, "the mit report"), (8, "Licensed under CC BY 4.0.")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "doc_id int, text string, paragraph string")
    got = sorted(((r.id, r.paragraph_no, r.license) for r in L.scan(df, model).collect()), key=str)
    want = {(1, 0, "MIT"), (6, 3000, "Apache-2.0"), (None, 0, "CC-BY-NC-4.0"), (8, 0, "CC-BY-4.0")}
    assert want <= set(got) and got.count((None, 0, "CC-BY-NC-4.0")) == 2
    assert all(x in want or x[2] == "unknown" for x in got) and not [x for x in got if x[0] in (3, 4, 5)]
    assert L.scan(df.limit(0), model).count() == 0


def test_the_marker_words_lose_nothing(spark, trained):
    """Every paragraph scored without the marker words gives the same findings."""
    docs, model = trained
    every = L.with_grams(L.paragraphs(docs, "text").select("paragraph").distinct(), "paragraph")
    full = L.predicted(L.score(every, model, []), model).filter("family <> 'none'").select("paragraph").distinct()
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {texts[r.id].split("\n")[r.paragraph_no] for r in L.scan(docs, model).collect()}
    assert got == {r.paragraph for r in full.collect()}


def test_ordinary_sentences_with_every_notice_word(spark):
    """What is found hangs on n-grams: a sample that uses all words of the notices hides none of them."""
    notices = [t for ts in TEMPLATES.values() for t in ts]
    vocabulary = sorted({w for r in L.templates(spark).select(L.words(F.col("text")).alias("w")).collect() for w in r.w})
    rows = [(i, f"Yesterday our {w} stood beside {w} gardens\nand nobody saw another {w} there") for i, w in enumerate(vocabulary)]
    plain = spark.createDataFrame(rows, "doc_id int, text string").coalesce(4)
    model = L.train(plain, p=L.LicenseParams(negative_docs=len(rows)))
    planted = spark.createDataFrame([(i, f"{rows[i][1]}\n{t}") for i, t in enumerate(notices)], "doc_id int, text string").coalesce(4)
    got = {(r.id, r.paragraph_no): r.license for r in L.scan(planted, model).collect()}
    want = {(i, 2): f for i, t in enumerate(notices) for f, ts in TEMPLATES.items() if t in ts}
    assert {k for k in want if got.get(k) == want[k]} == set(want) and set(got) == set(want)


def test_query_finds_the_planted_notices(spark):
    from corpusgauge.llm.queries import llm_queries

    rows = llm_queries()["op2_license_scan"].build(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, n, f) for i, t in texts.items() for n, line in enumerate((t or "").split("\n"))
            for f, ts in TEMPLATES.items() if line in ts}
    assert want and want <= {(r.doc_id, r.paragraph_no, r.license) for r in rows}
    for r in rows:
        if r.license != "unknown":
            assert re.search("(?i)licen|permission|copyright|redistribut|waived", texts[r.doc_id].split("\n")[r.paragraph_no])

"""Prompt contexts, case records, and what a task keeps of its scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.operators import reports as R
from corpusgauge.operators import retrieval as RT


def test_context_blocks_in_order(spark):
    sections = spark.createDataFrame([(1, "b", "Second", 2), (1, "a", "First", 1), (2, "b", "Second", 1), (3, "c", None, 1)],
                                     "k int, id string, section string, pos int")
    kb = spark.createDataFrame([("a", "ক", "one"), ("b", None, "two")], "id string, text string, text_english string")
    got = {r["k"]: (r["context"], r["n_sections"]) for r in RT.full_prompt_context(sections, kb, ["k"]).collect()}
    a, b = "[a] First\nবাংলা: ক\nEnglish: one", "[b] Second\nবাংলা: \nEnglish: two"
    assert got == {1: (a + "\n\n" + b, 2), 2: (b, 1), 3: ("[c] \nবাংলা: \nEnglish: ", 1)}


def test_language_rules(spark):
    df = spark.createDataFrame([("english",), ("bangla",), ("mixed",), ("unknown",), (None,)], "m string")
    got = [r[0] for r in df.select(RT.language_rule(F.col("m"))).collect()]
    assert got == [X.LANGUAGE_RULES["english"], X.LANGUAGE_RULES["bangla"]] + [X.LANGUAGE_RULE_BOTH] * 3


def test_case_records_have_all_fields(spark):
    df = spark.createDataFrame([(1, "text", None, ["s1"], 4), (2, None, "physical", None, None)],
                               "id int, transcript string, abuse_type string, applicable_sections array<string>, severity int")
    rows = {r["id"]: r.asDict() for r in R.case_records(df, ["id"]).collect()}
    assert set(rows[1]) == {"id", *R.CASE_DEFAULTS}
    assert rows[1]["abuse_type"] == "" and rows[1]["applicable_sections"] == ["s1"] and rows[1]["severity"] == 4
    assert rows[2]["transcript"] == "" and rows[2]["applicable_sections"] == [] and rows[2]["severity"] is None
    assert all(r["reporter_type"] == "unknown" and r["legal_advice_bangla"] == "" and r["uno_district"] is None for r in rows.values())


@pytest.mark.parametrize("tile", [4_000_000, 50])
def test_cosine_top_k_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(RT, "TILE_SCORES", tile)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(200, 4)), 1)
    x[10] = x[11] = x[12] = x[150]    # ties
    x[20] = 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(5)
    got = {}
    for r in RT.cosine_top_k(df, "id", "v", df.filter("id != 20").withColumnRenamed("id", "q").withColumnRenamed("v", "qv"), "q", "qv", 4).collect():
        got.setdefault(r["q"], {})[r["rank"]] = r["id"]
    with np.errstate(invalid="ignore"):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in got:
        sims = np.nan_to_num(unit @ unit[q], nan=-9)
        want = sorted(range(200), key=lambda i: (-round(sims[i], 12), i))[:4]
        assert np.allclose(sims[[got[q][i] for i in (1, 2, 3, 4)]], sims[want])
    assert len(got) == 199 and [got[10][i] for i in (1, 2, 3, 4)] == [10, 11, 12, 150]


def test_lexical_overlap_with_many_queries(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(150)] + [(900, None), (901, "")]
    queries = [(i, " ".join(rng.choice(words, 5))) for i in range(80)] + [(500, None)]
    d = spark.createDataFrame(docs, "did long, t string").repartition(4)
    q = spark.createDataFrame(queries, "qid long, qt string")
    got = {}
    for r in RT.lexical_overlap(q, "qid", "qt", d, "did", "t", 3).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["did"], r["score"]))
    for i, t in queries:
        scores = sorted((-len(set((t or "").split()) & set((x or "").split())), j) for j, x in docs)
        want = [(k + 1, j, -s) for k, (s, j) in enumerate([x for x in scores if x[0] < 0][:3])]
        assert sorted(got.get(i, [])) == want

"""Word lists are looked up in one pass; exact rules run only where a word occurs."""

from corpusgauge import fixed as X
from corpusgauge.functions import text as T
from corpusgauge.operators.classify import extract_entities


def test_markers_are_found_in_one_pass(spark):
    texts = [None, "", "x", "xALLAHx", "no", "সব আল্লাহ", "din ner", "x" * 5000 + "zakat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    out = df.select("i", T.is_religious("x").alias("r"))
    low = [(t or "").lower() for t in texts]
    assert [r["r"] for r in out.orderBy("i").collect()] == [any(m.lower() in t for m in X.RELIGIOUS_MARKERS) for t in low]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "instr" not in plan and "ArrowEvalPython" in plan


def test_entity_rules_run_where_a_word_occurs(spark):
    cases = [("my Grandfather, 72 years old", 72, "grandfather", None), ("mothers day", None, None, None), ("_mother mother", None, "mother", None),
             ("(মাকে) স্বামী।", None, "mother", "spouse"), ("মাকেও", None, None, None), ("DAUGHTER-IN-LAW and son", None, None, "daughter-in-law"),
             ("bold old", None, "elderly", None), ("৬৫ বছর", 65, None, None), ("12 years", None, None, None), ("AGE 70age", 70, None, None),
             (None, None, None, None), ("", None, None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    out = extract_entities(df, "x")
    assert out.columns == ["i", "x", "age", "victim_relation", "abuser_relation"]
    assert [(r["age"], r["victim_relation"], r["abuser_relation"]) for r in out.orderBy("i").collect()] == [c[1:] for c in cases]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan

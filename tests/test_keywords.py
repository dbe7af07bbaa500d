"""The built-in keyword dictionary: all three lists reach the registered queries."""

from corpusgauge import fixed as X
from corpusgauge.plans.registry import all_queries


def test_bangla_and_mixed_keywords_classify(spark, tmp_path):
    assert sum(map(len, X.KEYWORDS.values())) == 231
    rows = [(1, 1, "user", "তার ছেলে জমি ও টাকা নিয়েছে"), (1, 2, "user", "তারা আমাকে CARE করে না"),
            (2, 1, "user", "লাশ পাওয়া গেছে"), (2, 2, "user", "no such words"), (3, 1, "user", "They hit করেছে"), (3, 2, "user", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): (r.category, r.matched, r.severity > 0, r.legal_sections != "")
           for r in all_queries()["keyword_classify"].build(spark, str(tmp_path)).collect()}
    assert got == {(1, 1): ("financial", "জমি, টাকা", True, True), (1, 2): ("neglect", "care করে না", True, True),
                   (2, 1): ("murder", "লাশ", True, True), (2, 2): ("unknown", "", False, False),
                   (3, 1): ("physical", "hit, hit করেছে", True, True), (3, 2): ("unknown", "", False, False)}


def test_every_keyword_is_found(spark):
    from corpusgauge.operators.classify import classify_text

    rows = [(c, w.lower()) for c, words in X.KEYWORDS.items() for w in words]
    df = spark.createDataFrame(rows, "want string, text string")
    assert all(r.total_hits > 0 and r.category != "unknown" for r in classify_text(df, "text").collect())


def test_the_automaton_finds_what_a_scan_per_keyword_finds(spark):
    import random

    from pyspark.sql import functions as F

    from corpusgauge.operators.classify import found_keywords

    rng = random.Random(6)
    # short words over few letters: they overlap, begin, end and contain each other
    letters = "abকখ é"
    words = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(150)})
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(300)] + ["", words[0], "".join(words)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    got = {r["id"]: sorted(r["f"]) for r in df.select("id", found_keywords(F.col("text"), words).alias("f")).collect()}
    assert got == {i: [w for w in words if w in t] for i, t in enumerate(texts)}
    real = sorted({w.lower() for ws in X.KEYWORDS.values() for w in ws})
    mixed = ["".join(rng.choices(real, k=6)) for _ in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(mixed)], "id int, text string")
    got = {r["id"]: sorted(r["f"]) for r in df.select("id", found_keywords(F.col("text"), real).alias("f")).collect()}
    assert got == {i: [w for w in real if w in t] for i, t in enumerate(mixed)}
    assert df.select(found_keywords(F.col("text"), []).alias("f")).filter("size(f) > 0").count() == 0

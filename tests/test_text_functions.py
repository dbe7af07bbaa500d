"""Column functions on the edge rows listed for the comment fixture."""

from pyspark.sql import functions as F

from corpusgauge.functions import normalize as N
from corpusgauge.functions import text as T
from corpusgauge.operators import quality as Q


def _one(spark, col_expr, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col_expr).collect()]


def test_unicode_strip_and_length(spark):
    vals = ["\t hello 　", "  ", "কষ্ট", "😀a", " x "]
    assert _one(spark, T.ustrip("x"), vals) == ["hello", "", "কষ্ট", "😀a", "x"]
    assert _one(spark, T.char_len("x"), vals) == [5, 0, 4, 2, 1]


def test_tag_language_order(spark):
    vals = ["مرحبا", "মা ভালো hello", "মা ভালো", "hello", "😀!!", "مرحبا মা"]
    assert _one(spark, T.tag_language("x"), vals) == [
        "arabic", "bn+en", "bengali", "latin", "emoji/other", "bengali"]


def test_spam_and_textless(spark):
    vals = ["join t.me/abc", "This is FAIR USE notice", "𝗚𝗼𝗼𝗴𝗹𝗲 promo", "http://x.com/photo.php?id=1",
            "Premium account offer", "🙏🙏", "...", "normal comment"]
    assert _one(spark, T.is_spam("x"), vals) == [True, True, True, True, True, False, False, False]
    assert _one(spark, T.is_textless("x"), vals)[5:] == [True, True, False]


def test_language_mode(spark):
    vals = ["", "আমি ভালো আছি", "hello there", "আমি ভালো আছি ok", "123"]
    assert _one(spark, T.language_mode("x"), vals) == ["unknown", "bangla", "english", "bangla", "unknown"]


def test_religious_substring_and_emoji(spark):
    vals = ["inshallah", "dinner time", "plain", "ok 👍"]
    assert _one(spark, T.is_religious("x"), vals) == [True, True, False, False]
    assert _one(spark, T.has_emoji("x"), vals) == [False, False, False, True]


def test_char_wb_short_word_once(spark):
    got = _one(spark, T.char_wb_ngrams("x", 3, 5), ["a", "the"])
    assert got[0] == [" a "]
    assert sorted(got[1]) == sorted([" th", "the", "he ", " the", "the ", " the "])


def test_word_ngrams(spark):
    df = spark.createDataFrame([(["the", "cat", "sat"],), (["one"],)], "t array<string>")
    got = [r[0] for r in df.select(T.word_ngrams("t", 2)).collect()]
    assert got == [["the", "cat", "sat", "the cat", "cat sat"], ["one"]]


def test_lenient_numbers_and_dates(spark):
    assert _one(spark, N.lenient_int("x"), ["42", " 7 ", "abc", None]) == [42, 7, None, None]
    assert _one(spark, N.lenient_int("x", 0), ["abc"]) == [0]
    got = _one(spark, N.day_first_date("x"), ["5/3/2021", "31/12/2020", "not a date"])
    assert [str(d) if d else None for d in got] == ["2021-03-05", "2020-12-31", None]


def test_age_and_relations(spark):
    vals = ["আমার বাবার বয়স ৭৫ বছর", "he is 200 years old", "my father is 70 years old",
            "আমাকে মারধর করেছে", "মা কে মেরেছে ছেলে", "the son-in-law hit grandma"]
    ages = _one(spark, N.age_from_text("x"), vals)
    assert ages[:3] == [75, None, 70]
    from corpusgauge.operators.classify import extract_entities
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    rows = extract_entities(df, "x").collect()
    assert rows[0]["victim_relation"] == "father"
    assert rows[3]["victim_relation"] is None  # 'মা' inside 'আমাকে' is not a word
    assert rows[4]["victim_relation"] == "mother" and rows[4]["abuser_relation"] == "son"
    assert rows[5]["victim_relation"] == "grandmother" and rows[5]["abuser_relation"] == "son-in-law"


def test_entity_normalisation(spark):
    from corpusgauge.operators.classify import normalize_entities
    schema = ("reporter_type string, victim_name string, victim_age string, victim_gender string, "
              "location string, abuser_name string, abuser_relation string, incident_date string")
    rows = [("garbage", "অজ্ঞাত", "75", "মহিলা", " Dhaka ", "null", "", None),
            (" Self ", "Rahim", "5", "M", "unknown", "x", "son", "2024-01-01"),
            ("third_party", None, "text", "other", None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = df.select(normalize_entities(F.struct(*df.columns)).alias("e")).select("e.*").collect()
    assert out[0]["reporter_type"] == "unknown" and out[0]["victim_name"] is None
    assert out[0]["victim_age"] == 75 and out[0]["victim_gender"] == "Female" and out[0]["location"] == "Dhaka"
    assert out[0]["abuser_name"] is None and out[0]["abuser_relation"] is None
    assert out[1]["reporter_type"] == "self" and out[1]["victim_age"] is None and out[1]["victim_gender"] == "Male"
    assert out[2]["victim_age"] is None and out[2]["victim_gender"] is None


def test_json_fallback(spark):
    from pyspark.sql import types as Ty
    schema = Ty.StructType([Ty.StructField("severity", Ty.StringType())])
    vals = ['{"severity": "4"}', 'Sure! {"severity": "3"} hope this helps', "not json", None]
    got = _one(spark, N.parse_json_fallback(F.col("x"), schema), vals)
    assert [g["severity"] if g else None for g in got] == ["4", "3", None, None]


def test_translate_list_and_placeholders(spark):
    m = {"physical": "শারীরিক নির্যাতন", "neglect": "অবহেলা"}
    got = _one(spark, N.translate_list("x", m), ["Physical, neglect", "", "murder"])
    assert got == ["শারীরিক নির্যাতন ও অবহেলা (Physical, neglect)", "", "murder (murder)"]
    assert _one(spark, N.placeholder("x", "?"), [None, " ", "a"]) == ["?", "?", "a"]
    assert _one(spark, N.ascii_to_bangla_digits("x"), ["2024"]) == ["২০২৪"]


def test_clean_corpus_priority(spark):
    rows = [(1, "  same text  "), (2, "same text"), (3, "🙏"), (4, "ok"), (5, "t.me/x promo"),
            (6, "t.me/x promo"), (7, "\tsame text　")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r["id"]: r["remove_reason"] for r in Q.clean_corpus(df, "id", "text").collect()}
    assert out == {1: None, 2: Q.REASON_DUP, 3: Q.REASON_TEXTLESS, 4: Q.REASON_SHORT,
                   5: Q.REASON_SPAM, 6: Q.REASON_SPAM, 7: Q.REASON_DUP}


def test_java_whitespace_class_equals_python_isspace(spark):
    """The fast Java form and the portable class match Python's str.isspace on every code point."""
    cps = spark.range(0, 0x110000).filter((F.col("id") < 0xD800) | (F.col("id") > 0xDFFF)).select(
        "id", F.decode(F.unhex(F.lpad(F.hex(F.col("id")), 8, "0")), "utf-32").alias("c"))
    r = cps.select("id", F.col("c").rlike("^" + T.WS_RUN_JAVA + "$").alias("j"),
                   F.col("c").rlike("^" + T.WS_RUN_REGEX + "$").alias("p"))
    got = sorted(x[0] for x in r.filter("j").select("id").collect())
    assert got == sorted(c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c).isspace())
    assert r.filter("j <> p").count() == 0

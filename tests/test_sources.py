"""Sources and sinks on small fixture files (written to pytest's tmp_path)."""

import json

from pyspark.sql import functions as F

from corpusgauge.sources import io as IO


def test_read_corpus_keeps_blanks(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('comment_id,Comment,platform,abuse_type,Likes,Date\n'
                 'x1,"line one\nline two",fb,Neglect,,2024\n'
                 'x2,"",yt,"Physical, ""quoted""",5,\n', encoding="utf-8")
    rows = IO.read_corpus(spark, str(p)).orderBy("comment_id").collect()
    assert rows[0]["Comment"] == "line one\nline two" and rows[0]["Likes"] == ""
    assert rows[1]["Comment"] == "" and rows[1]["abuse_type"] == 'Physical, "quoted"' and rows[1]["Date"] == ""


def test_read_code_batches_drops_stray_lines(spark, tmp_path):
    (tmp_path / "batch_001.csv").write_text("comment_id,pol,emo\nC00001,Neg,ANG\nC00002,Neu,OTH\n")
    (tmp_path / "batch_002.csv").write_text("C00003,Pos,PRY\n")
    df = IO.read_code_batches(spark, str(tmp_path / "batch_*.csv"))
    rows = df.orderBy("comment_id").collect()
    assert [r["comment_id"] for r in rows] == ["C00001", "C00002", "C00003"]
    assert rows[2]["source_file"].endswith("batch_002.csv")


def test_read_keywords_and_kb(spark, tmp_path):
    kw = {"physical": {"bangla": ["মারধর"], "english": ["beat", "hit"], "mixed_forms": []},
          "verbal": {"bangla": [], "english": ["insult"], "mixed_forms": ["insult করে"]}}
    p = tmp_path / "kw.json"
    p.write_text(json.dumps(kw, ensure_ascii=False), encoding="utf-8")
    lists = IO.keyword_lists(IO.read_keywords(spark, str(p)))
    assert lists == {"physical": ["মারধর", "beat", "hit"], "verbal": ["insult", "insult করে"]}
    kb = {"pma_sec5": {"section": "S5", "text": "t", "text_english": "e", "applicable_for": ["all"],
                       "severity_min": 1}}
    q = tmp_path / "kb.json"
    q.write_text(json.dumps(kb), encoding="utf-8")
    r = IO.read_kb(spark, str(q)).first()
    assert r["id"] == "pma_sec5" and r["applicable_for"] == ["all"]


def test_read_reports_missing_broken_and_capped(spark, tmp_path):
    assert IO.read_reports(spark, str(tmp_path / "nothing")).count() == 0
    p = tmp_path / "r.json"
    p.write_text('{"id": "a", "risk_level": 3, "abuse_types": ["physical"]}\n{broken\n'
                 '{"id": "b", "risk_level": 1}\n', encoding="utf-8")
    df = IO.read_reports(spark, str(p))
    assert sorted(r["id"] for r in df.collect()) == ["a", "b"]
    assert IO.read_reports(spark, str(p), limit=1).count() == 1


def test_append_reports_consent_and_whitelist(spark, tmp_path):
    df = spark.createDataFrame([(True, 3, "Rahim", ["physical"]), (False, 2, "Karim", ["neglect"])],
                               "consent boolean, risk_level int, victim_name string, abuse_types array<string>")
    out = str(tmp_path / "store")
    assert IO.append_reports(df, out) == 1
    back = IO.read_reports(spark, out)
    assert back.count() == 1 and "victim_name" not in back.columns
    assert len(back.first()["id"]) == 20


def test_write_partitioned_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    IO.write_table(df, str(tmp_path / "splits"), partition_by=["split"])
    assert spark.read.parquet(str(tmp_path / "splits")).filter(F.col("split") == "test").count() == 1
    inv = IO.table_inventory(spark, {"region": "/root/testdata/sf0.001/region.parquet"}).first()
    assert inv["n_rows"] == 5 and inv["n_columns"] == 2 and inv["bytes"] > 0


def test_keyword_composition_and_enriched_kb(spark, tmp_path):
    from corpusgauge.operators.eda import keyword_composition
    from corpusgauge.operators.retrieval import enriched_kb_documents
    kw = {"physical": {"bangla": ["মারধর"], "english": ["beat", "hit"], "mixed_forms": []},
          "neglect": {"bangla": [], "english": ["neglect"], "mixed_forms": ["care করে না"]}}
    p = tmp_path / "kw.json"
    p.write_text(json.dumps(kw, ensure_ascii=False), encoding="utf-8")
    kws = IO.read_keywords(spark, str(p))
    comp = {r["category"]: (r["bangla"], r["english"], r["mixed_forms"], r["total"])
            for r in keyword_composition(kws).collect()}
    assert comp == {"physical": (1, 2, 0, 3), "neglect": (0, 1, 1, 2)}
    kb = {"bpc_323": {"section": "S323", "text": "t", "text_english": "e", "applicable_for": ["physical"],
                      "severity_min": 4},
          "pma_sec4": {"section": "S4", "text": "t4", "text_english": "e4", "applicable_for": ["neglect", "all"],
                       "severity_min": 2},
          "pma_sec1": {"section": "S1", "text": "t1", "text_english": "e1", "applicable_for": ["all"],
                       "severity_min": 1}}
    q = tmp_path / "kb.json"
    q.write_text(json.dumps(kb, ensure_ascii=False), encoding="utf-8")
    docs = {r["id"]: r for r in enriched_kb_documents(IO.read_kb(spark, str(q)), kws).collect()}
    assert docs["bpc_323"]["document"].endswith("Related complaints: মারধর beat hit")
    assert docs["pma_sec1"]["document"] == "S1\nt1\ne1" and docs["pma_sec1"]["law"] == "PMA"
    assert docs["bpc_323"]["law"] == "BPC" and docs["pma_sec4"]["document"].endswith("neglect care করে না")


def test_source_type_norm(spark):
    from corpusgauge.functions.normalize import source_type_norm
    df = spark.createDataFrame([("primary (Interview)",), ("Secondary Interview",), ("Newspaper",)], "x string")
    got = [r[0] for r in df.select(source_type_norm("x")).collect()]
    assert got == ["Primary (Interview)", "Secondary (Interview)", "Newspaper"]

"""Host-level quality rules: the prior, the verdicts and odd rows."""

from corpusgauge.llm.quality import QualityRules, filter_quality, host_quality, text_metrics


def doc(i, symbols=False):
    words = [f"w{i}x{k}" for k in range(30)]
    return " ".join(w + "##" if symbols else w for w in words)


def test_metrics():
    assert text_metrics(None) == text_metrics(b"") == (0, 0, 0, 0, 0, 0)
    text = "Été  a\tb\x0bc\n\n \na b\na b\n#$%&*|<>\n".encode()
    assert text_metrics(text) == (9, 3 + 1 + 1 + 1 + 4 + 8, 8, 4, 1, 0)
    twice = " ".join(f"w{i}" for i in range(9))
    assert text_metrics((twice + " x " + twice).encode())[5] == 18
    assert text_metrics(b"a " * 9)[5] == 9          # windows that overlap
    assert text_metrics("a b c".encode())[0] == 2   # a no-break space is part of a word


def test_host_verdicts_are_shrunk(spark):
    rows = [(i, doc(i), "clean", "x") for i in range(60)]
    rows += [(100 + i, doc(i, True), "bad", "x") for i in range(50)] + [(160, doc(160), "bad", "x")]
    rows += [(200, doc(200, True), "small", "x")]   # one failure: shrunk towards the corpus
    rows += [(300 + i, doc(i, i == 0), "mixed", "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, kept string")
    got = {r.doc_id: r for r in host_quality(df).collect()}
    assert not any(got[100 + i].kept for i in range(50)) and got[160].kept   # clean documents stay on any host
    assert got[100].host_bad and not got[0].host_bad and not got[300].host_bad
    assert got[300].soft_failed and got[300].kept                            # a soft failure on a good host
    n, f = {"clean": 60, "bad": 51, "small": 1, "mixed": 40}, {"clean": 0, "bad": 50, "small": 1, "mixed": 1}
    total = sum(n.values())
    mean = sum(f.values()) / total
    var = sum((f[h] / n[h]) ** 2 * n[h] for h in n) / total - mean**2
    weight = mean * (1 - mean) / var - 1
    for i, h in ((0, "clean"), (100, "bad"), (200, "small"), (300, "mixed")):
        assert abs(got[i].host_rate - (f[h] + mean * weight) / (n[h] + weight)) < 1e-9
    kept = filter_quality(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_odd_rows(spark):
    rows = [(None, doc(1), None, "x"), (None, doc(1), None, "x"), (1, None, "a", None), (2, "", "a", "x"), (3, "word " * 40_000, "a", "x"),
            (4, doc(4), "a", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, n_words string")
    got = sorted(((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in host_quality(df, rules=QualityRules()).collect()), key=str)
    assert got == sorted([(None, 30, 0, False, True)] * 2 + [(1, 0, 0, True, False), (2, 0, 0, True, False), (3, 40_000, 40_000, True, False),
                                                             (4, 30, 0, False, True)], key=str)
    assert host_quality(df.limit(0)).count() == 0 and filter_quality(df.limit(0)).count() == 0


def test_the_host_verdict_decides_on_the_given_documents(spark):
    from corpusgauge.plans.registry import load

    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = host_quality(docs).collect()
    gone = [r for r in rows if not r.base_failed and not r.kept]
    assert gone and all(r.soft_failed and r.host_bad for r in gone)
    assert any(r.soft_failed and r.kept for r in rows)          # soft failures on ordinary hosts stay
    assert len({r.host_rate for r in rows if r.host_bad}) < len({r.host_rate for r in rows}) / 2
    # without the hosts' verdicts all of them stay
    blind = {r.doc_id for r in host_quality(docs, rules=QualityRules(host_deviations=1e9)).collect() if r.kept}
    assert blind - {r.doc_id for r in rows if r.kept} == {r.doc_id for r in gone}


def test_hosts_that_fail_alike_are_not_bad(spark):
    rows = [(h * 100 + i, doc(i, i < 5), f"h{h}") for h in range(6) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    assert all(r.kept and not r.host_bad for r in host_quality(df).collect())
    one = df.filter("source = 'h0'")
    assert all(r.kept for r in host_quality(one).collect())

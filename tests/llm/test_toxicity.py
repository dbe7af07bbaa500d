"""Classifier chains: held-out accuracy, out-of-fold inputs, defined results for odd rows."""

import numpy as np

from corpusgauge.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Trained on even ids of the table, judged on the odd ones."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = X.train(docs, labels.filter("doc_id % 2 = 0"))
    known = {r.doc_id: r.toxic for r in labels.filter("doc_id % 2 = 1").collect()}
    got = {r.id: r.toxic for r in X.score(docs, chain).filter("id % 2 = 1").collect()}
    hits = [got[i] for i, y in known.items() if y]
    alarms = [got[i] for i, y in known.items() if not y]
    assert len(hits) > 100 and sum(hits) >= 0.85 * len(hits)
    assert sum(alarms) <= 0.005 * len(alarms)


def test_later_models_are_fed_out_of_fold(monkeypatch):
    """A feature that only memorises rows must not look reliable to the next model."""
    rng = np.random.default_rng(0)
    n = 120
    x, first, second = np.eye(n), rng.integers(0, 2, n).astype(float), rng.integers(0, 2, n).astype(float)
    fed = []
    real = X.Linear

    class Spy(real):
        def __init__(self, x, y, l2):
            fed.append((x.copy(), y.copy()))
            super().__init__(x, y, l2)

    monkeypatch.setattr(X, "Linear", Spy)
    models, _ = X.fit_chain(x, np.column_stack([first, second]), X.ToxicityParams())
    assert len(models) == 2 and [m.w.size for m in models] == [n + 1, n + 2]
    earlier = next(a for a, y in fed if a.shape[1] == n + 1 and len(a) == n)[:, -1]
    fitted = models[0](x)
    assert ((fitted > 0.5) == first).mean() > 0.99       # it knows its own rows,
    assert ((earlier > 0.5) == first).mean() < 0.75      # but what the next one sees does not


def test_earlier_probabilities_are_used():
    chain = X.Chain(["a", "b"], [b"w"], [], X.ToxicityParams())
    one, two = object.__new__(X.Linear), object.__new__(X.Linear)
    one.w, two.w = np.array([8.0, -4.0]), np.array([0.0, 10.0, -5.0])
    chain.models = [one, two]
    q = chain.predict(chain.matrix([b"w here", b"none", None, b""]))
    assert (q[:, 1] > 0.5).tolist() == [True, False, False, False]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("you idiotic person " if i % 2 else "a kind person ") + f"w{i}", "x") for i in range(60)]
                                 + [(100, None, "x"), (101, "", "x"), (None, "IDIOTIC", "x"), (1, "you idiotic person", "x"),
                                    (102, "word " * 40_000 + "idiotic", "x")],
                                 "doc_id int, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (999, 1), (100, 1), (7, 1)],
                                   "doc_id int, toxic int")
    got = X.score(docs, X.train(docs, labels)).collect()
    assert len(got) == 65
    for r in got:
        assert r.toxic == (r.id is None or r.id == 102 or r.id < 100 and r.id % 2 == 1)
    none = X.train(docs, labels.filter("toxic = 0"))
    assert not any(r.toxic for r in X.score(docs, none).collect())
    assert not X.train(docs.limit(0), labels).models
    assert X.score(docs.limit(0), none).count() == 0

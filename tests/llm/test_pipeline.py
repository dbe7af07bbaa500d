"""The pipeline against brute-force versions of its stages, one after another."""

import re

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from corpusgauge.llm.bpe import read_ranks
from corpusgauge.llm.secret_scan import RULES
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_minhash import brute as components
from tests.llm.test_secret_scan import spans

SF = "/root/testdata/sf0.001"


def symbols(text):
    return sum(text.count(c) for c in "#*$%&|<>")


def base_failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at: dict = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    twice = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(words) < 20 or 100 * len(twice) > 30 * len(words)


def soft_failed(text):
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return 100 * symbols(text) > 50 * len(words) or 100 * (len(lines) - len(set(lines))) > 30 * len(lines)


def kept_by_hosts(rows):
    """The quality stage in plain Python."""
    hosts: dict = {}
    for r in rows:
        n = hosts.setdefault(r["source"], [0, 0])
        n[0] += 1
        n[1] += base_failed(r["text"]) or soft_failed(r["text"])
    total = sum(n for n, _ in hosts.values())
    mean = sum(f for _, f in hosts.values()) / total
    var = sum((f / n) ** 2 * n for n, f in hosts.values()) / total - mean**2
    weight = mean * (1 - mean) / var - 1 if var > 1e-12 and mean * (1 - mean) > var else 1.0
    rate = {h: (f + mean * weight) / (n + weight) for h, (n, f) in hosts.items()}
    middle = sum(rate[h] * n for h, (n, _) in hosts.items()) / total
    deviation = max(sum(rate[h] ** 2 * n for h, (n, _) in hosts.items()) / total - middle**2, 0) ** 0.5
    bad = {h for h in hosts if rate[h] > middle + deviation + 1e-6}
    return [r for r in rows if not base_failed(r["text"]) and not (r["source"] in bad and soft_failed(r["text"]))]


def brute(rows, items):
    rows = kept_by_hosts(rows)
    keep = {i for i, (_, c) in components([(r["doc_id"], r["text"]) for r in rows]).items() if i == c}
    rows = [r for r in rows if r["doc_id"] in keep]
    rows = [r for r in rows if not contaminated([(r["doc_id"], r["text"])], items)[0][3]]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = []
    for r in rows:
        text, done, at = r["text"], "", 0
        for _, start, end in spans(text, RULES):
            if start >= at:
                done += text[at:start] + "[SECRET]"
            at = max(at, end)
        out.append((r["doc_id"], r["lang"], r["source"], library.encode_ordinary(done + text[at:])))
    return sorted(out)


def test_run_equals_the_stages_in_plain_python(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    want = brute(rows, items)
    assert sorted((r.doc_id, r.lang, r.source, list(r.ids)) for r in got) == want
    assert 0 < len(want) < len(rows)


@pytest.mark.parametrize("n", range(5))
def test_every_stage_takes_odd_rows(spark, n):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, extra columns."""
    good = " ".join(f"Word{i}" for i in range(30))
    rows = [(1, good, "en", "a", 5, "x"), (1, good, "en", "a", 5, "x"), (None, good + " more", None, None, None, None),
            (2, None, "en", "a", 0, "x"), (3, "", "en", None, 0, "x"), (4, "long word " * 30_000, "en", "a", 1, "x"), (5, good.lower(), "en", "b", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    name, stage = corpus_pipeline.STAGES[n]
    got = stage(spark, df, SF)
    if n < 4:
        assert got.columns == df.columns
    found = sorted(((r.doc_id, r.source) for r in got.collect()), key=str)
    every = sorted(((r[0], r[3]) for r in rows), key=str)
    want = {"quality": [(1, "a"), (1, "a"), (5, "b"), (None, None)],
            "near-duplicates": [x for x in every if x != (5, "b")]}.get(name, every)
    assert found == sorted(want, key=str)
    assert stage(spark, df.limit(0), SF).count() == 0


def test_quality_query(spark):
    """op5 against plain Python, on all rows."""
    from corpusgauge.llm.queries import llm_queries

    rows = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    keep = {r["doc_id"] for r in kept_by_hosts(list(rows.values()))}
    for r in llm_queries()["op5_host_quality"].build(spark, SF).collect():
        text = rows[r.doc_id]["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (
            len(words), sum(map(len, words)), symbols(text), len(lines) - len(set(lines)))
        assert r.base_failed == base_failed(text) and r.kept == (r.doc_id in keep)

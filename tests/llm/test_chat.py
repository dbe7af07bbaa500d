"""Reply trees: paths against recursion, formatting against plain Python, reading back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusgauge.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<s>[assistant]\nhi</s>\n", "\\l\\e\\\\", "a\\", "[x]<y>\\g", "", "é🙂\n\n", "<|im_end|>"]


def escape(text):
    for char, letter in chat.ESCAPES:
        text = text.replace(char, "\\" + letter)
    return text


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(8)
    rows = []
    for conv in [1, 2, 3, None]:
        for node in range(40 if conv != 3 else 1):
            parent = rng.randrange(node) if node and rng.random() < 0.9 else None
            rows.append((conv, node, parent, rng.choice(["user", "assistant", "sys]tem"]), rng.choice(NASTY), float(rng.randrange(5))))
    for node in range(70):  # a long chain
        rows.append((9, node, node - 1 if node else None, "user", f"t{node}", 1.0))
    rows += [(1, 77, 999, "user", "orphan", 1.0), (2, 80, 81, "user", "cycle", 9.0), (2, 81, 80, "user", "cycle", 9.0)]
    return rows, spark.createDataFrame(rows, "conv int, node bigint, parent bigint, role string, text string, score double")


def paths_of(rows):
    at = {(c, n): p for c, n, p, *_ in rows}
    parents = {(c, p) for c, n, p, *_ in rows if (c, p) in at}
    out = {}
    for c, n, *_ in rows:
        if (c, n) in parents:
            continue
        path, node = [], n
        while node is not None and (c, node) in at:
            path.append(node)
            node = at[c, node]
        out[c, n] = path[::-1]
    return out


def test_paths_and_ranks(forest):
    rows, df = forest
    want, score = paths_of(rows), {(c, n): s for c, n, _, _, _, s in rows}
    got = {(r.conv, r.leaf): (r.path, r.score) for r in chat.branches(df).collect()}
    assert got == {k: (p, sum(score[k[0], n] for n in p)) for k, p in want.items()}
    best = {(r.conv, r["rank"]): r.leaf for r in chat.best_branches(chat.branches(df), 2).collect()}
    for conv in {c for c, _ in want}:
        order = sorted((k for k in want if k[0] == conv), key=lambda k: (-got[k][1], -len(want[k]), k[1]))
        assert [best.get((conv, i + 1)) for i in range(min(2, len(order)))] == [k[1] for k in order[:2]]


def test_format_reads_back(forest):
    rows, df = forest
    message = {(c, n): (role, text) for c, n, _, role, text, _ in rows}
    want = paths_of(rows)
    out = chat.format_branches(df, chat.best_branches(chat.branches(df), 99)).withColumn(
        "turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.masked_texts(F.col("formatted"), F.col("loss_mask")))
    got = out.collect()
    assert len(got) == len(want)
    for r in got:
        turns = [message[r.conv, n] for n in want[r.conv, r.leaf]]
        assert r.formatted == "".join(f"<s>[{escape(a)}]\n{escape(t)}</s>\n" for a, t in turns)
        assert [(t.role, t.text) for t in r.turns] == turns
        assert list(r.loss) == [t for a, t in turns if a == "assistant"]


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 0, None, None, "x"), (1, 0, "user", "b", "x"), (1, 0, "user", "b", "x"), (None, 3, "assistant", "q", "x"),
                                (2, None, "assistant", None, "x")], "conv_id int, turn int, role string, text string, path string")
    got = {r.conv: r.formatted for r in chat.format_conversations(df).collect()}
    assert got == {1: "<s>[]\n</s>\n" + "<s>[user]\nb</s>\n" * 2, None: "<s>[assistant]\nq</s>\n", 2: "<s>[assistant]\n</s>\n"}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_query_digests(spark):
    from corpusgauge.llm.queries import CONTROL_TEXT, llm_queries

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-1: [("user", CONTROL_TEXT), ("assistant", CONTROL_TEXT)]}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = llm_queries()["op10_chat_format"].build(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(t for a, t in turns if a == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(f"<s>[{escape(a)}]\n{escape(t)}</s>\n") for a, t in turns)

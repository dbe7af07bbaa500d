"""The transducer against the tiktoken library; decoding against the bytes."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from corpusgauge.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
SAMPLES = ["", " ", "a", "  two  spaces ", "\n\n\t x", "Été déjà vu — naïve", "日本語のテキスト 🙂🙃", "aaaaaaaaaaaaaaaaaaaaaaa" * 40,
           "=" * 300, " " * 500 + "end", "0123456789" * 50, "it's we'll I'd THE'S", "<|endoftext|>", "\x00\x01�​",
           "deadbeef" * 400, "antidisestablishmentarianism" * 30, "abcabcabdabc" * 200]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def random_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "ing", "é", "ß", "tion", "a", "b", "z", "q", "Ġ", "0", "9", "#", "!!", " ", "  ", "\n", "ü", "漢", "🙂"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(n)]


def test_equals_the_library(library):
    make = bpe.encoder(PATH, P.PATTERN)
    read = bpe.decoder(PATH)
    for text in SAMPLES + random_texts(3000):
        ids = list(make([text])[0])
        assert ids == library.encode_ordinary(text), text[:80]
        assert read.text(ids) == text and read.bytes(ids) == text.encode()


def test_bytes_without_structure(library, monkeypatch):
    """Pieces straight through the transducer, with the caches emptied all the time."""
    rng = random.Random(2)
    monkeypatch.setattr(bpe, "MAX_MOVES", 40)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 40)
    t = bpe.Transducer(library._mergeable_ranks)
    for _ in range(60):
        many = [bytes(rng.choices(b"abetinos \n\xc3\xa9\xe2\x80", k=rng.randrange(0, 120))) for _ in range(9)]
        flat, begins = t.encode_many(many)
        for i, data in enumerate(many):
            want = library._encode_single_piece(data) if data else []
            assert t.encode(data) == want == flat[begins[i]:begins[i + 1]].tolist()
    assert len(t.fits) <= 41


def test_memory_of_pieces_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 50)
    make = bpe.Encoder(PATH, P.PATTERN)
    texts = random_texts(400, seed=9)
    for i in range(0, 400, 40):
        flat, ends = make(texts[i:i + 40])
        assert [list(flat[a:b]) for a, b in zip(ends, ends[1:])] == library.encode_ordinary_batch(texts[i:i + 40])


def test_bounded_lookahead(library):
    """What is not yet emitted is bounded, however long the piece."""
    t = bpe.Transducer(library._mergeable_ranks)
    left, emit = [], t.emit
    t.emit = lambda *a: (left.append(len(r[0])) or r) if (r := emit(*a)) else r
    for data in (b"abracadabra" * 3000, b"=" * 20_000, b"\xc3\xa9" * 9000, b" " * 30_000, b"ab" * 9000):
        assert t.encode(data) == library._encode_single_piece(data)
    assert left and max(left) < t.lookahead


def test_streaming_decode_of_split_and_broken_characters():
    read = bpe.decoder(PATH)
    ranks = bpe.read_ranks(PATH)
    for data in (b"\xf0\x9f\x99\x82ok", b"\xf0\x9f", b"\xc3(", b"\xff\xfe", b"a\xe2\x82", b"\xe2\x28\xa1", b"\xed\xa0\x80x", b"\xf4\x90\x80\x80"):
        ids = [ranks[data[i:i + 1]] for i in range(len(data))]
        assert read.text(ids) == data.decode("utf-8", "replace")
        assert read.bytes(ids) == data


def test_operator_handles_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "Hello wörld", "x"), (2, None, None), (None, "", "y"), (1, "Hello wörld", "x")],
                               "doc_id bigint, text string, decoded string")
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, as_text=True)
    assert out.columns == ["doc_id", "decoded", "ids", "decoded_"]
    got = sorted(((r.doc_id, r.decoded, len(r.ids), r.decoded_) for r in out.collect()), key=str)
    assert got == sorted([(1, "x", 4, "Hello wörld"), (2, None, 0, ""), (None, "y", 0, ""), (1, "x", 4, "Hello wörld")], key=str)
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query_on_the_small_table(spark, library):
    from corpusgauge.llm.queries import llm_queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = llm_queries()["op1_byte_bpe"].build(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_short_pieces_leave_no_moves_and_little_memory():
    """Pieces that go together use the arrays; the moves are not held a second time as tuples."""
    import public_tokenizers

    e = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = [f"reaund thonea{i} lyes শব্দ{i}" for i in range(300)] + [None]
    flat, ends = e(texts)
    assert e.transducer.made and not e.transducer.moves
    assert all(isinstance(p, bytes) for p in e.pieces.values())
    one = [e([t]) for t in texts]
    assert flat.tolist() == [x for f, _ in one for x in f] and len(ends) == len(texts) + 1


def test_encode_and_decode_share_a_python_worker(spark):
    """Two steps in a row are one pass over the rows; a step in between keeps them apart, with the same rows."""
    df = spark.createDataFrame([(i, f"Wörd{i} und mehr 🙂 " * i if i % 7 else None, f"k{i}") for i in range(1300)],
                               "doc_id bigint, text string, kept string")
    ids = bpe.encode(df, PATH, P.PATTERN)
    together, apart = bpe.decode(ids, PATH, as_text=True), bpe.decode(ids.filter("doc_id >= 0"), PATH, as_text=True)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert (plan(together), plan(apart)) == (1, 2)
    assert together.schema == apart.schema
    rows = sorted(together.collect())
    assert rows == sorted(apart.collect()) and len(rows) == 1300
    assert all(r.decoded == (f"Wörd{r.doc_id} und mehr 🙂 " * r.doc_id if r.doc_id % 7 else "") for r in rows)
    assert sorted(ids.collect()) == [r[:3] for r in rows]

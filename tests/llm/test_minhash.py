"""MinHash near-duplicates against all-pairs brute force."""

import random

from corpusgauge.llm.minhash import NearDupParams, drop_near_duplicates, least_matches, near_duplicates, tail

SCHEMA = "doc_id bigint, text string, kept string, bucket int"


def shingles(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """doc_id -> (set size, smallest reachable id)."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for base in range(12):
        words = rng.choices(vocab, k=rng.choice([40, 120, 400]))
        for _ in range(rng.choice([1, 2, 9, 30])):
            copy = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 50) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    # a chain: each version differs from the one before by a little
    words = rng.choices(vocab, k=300)
    for step in range(12):
        words[step * 20] = f"new{step}"
        texts.append(" ".join(words))
    texts += ["", None, "one two", "ONE  two", "one two three four five", "Été one two three four", " \n\t"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    want = brute(rows)
    # small blocks, so that the open buckets are compared in several groups
    for p in (NearDupParams(), NearDupParams(block=4)):
        got = {r.doc_id: r for r in near_duplicates(df, p=p).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_pairs_not_near_the_bucket_minimum_are_linked(spark):
    """The smallest member of a bucket links with few, its other members among themselves."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base[:150] + [f"z{i}" for i in range(30)]))]
    for i in range(1, 60):
        words = base[:-20] + [f"u{i // 3}x{k}" for k in range(20)]
        words[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, p=NearDupParams(block=8)).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1),
                                (2, "a b c d e f", "x", 1), (3, None, None, None)], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)],
                         key=str)
    assert drop_near_duplicates(df).count() == 4
    assert near_duplicates(df.limit(0)).count() == 0


def test_sequential_bounds():
    """A pair at the threshold is dropped with the chosen probability at most at each look."""
    p = NearDupParams()
    steps = least_matches(p)
    assert [s for s, _ in steps] == list(range(p.batch, p.hashes + 1, p.batch))
    for seen, least in steps:
        assert tail(least, seen, 0.85) > p.miss and (least == 0 or tail(least - 1, seen, 0.85) <= p.miss)

"""MinHash near-duplicates with sequential Bayesian verification.

1. :func:`sign` reads every whole text once: size of its set of word shingles, a 128-bit key
   of that set, and ``bands * band_rows`` min-hashes.
2. Documents with equal sets form a class (a partial aggregate on the key), represented by
   its smallest id.  Copies are never compared or expanded.
3. Representatives meet in band buckets.  A bucket does not emit its pairs: every member is
   compared with the bucket's smallest member only, so a bucket of any size costs as many
   comparisons as it has members.
4. :func:`prune` compares the two signatures in batches; after each batch the posterior of the
   similarity (uniform prior, so a beta distribution) must still give the threshold more than
   ``miss`` probability.  Survivors are verified on the full shingle sets (:func:`confirm`).
5. Links give components.  In buckets whose members are still in several components, the
   members outside the bucket's largest component are compared with all others, in blocks of
   bounded size, skipping pairs that are connected already (:func:`rest_links`).  Every pair
   that shares a bucket has then been compared or is known to be connected.

With 32 bands of 6 rows a pair at the threshold 0.85 shares no bucket with probability
(1 - 0.85^6)^32 < 3e-7.

Nulls and empty texts have no shingles and are linked with nothing; a row with a null id is
linked with nothing and is kept.  Rows that share an id are one document, linked if any of
their texts is.  An empty table gives no rows.  Extra columns are ignored by
:func:`near_duplicates` and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import byte_values, free_name, mixed, tune, window_hashes, word_hashes, written
from corpusgauge.llm.components import components


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5             # words in a shingle
    threshold_pct: int = 85    # link if 100 * intersection >= threshold_pct * union
    bands: int = 32
    band_rows: int = 6
    batch: int = 32            # min-hashes compared before each look at the posterior
    miss: float = 1e-6         # a pair is dropped below this posterior probability
    block: int = 512           # members compared with as many others at a time
    seed: int = 20240607

    @property
    def hashes(self) -> int:
        return self.bands * self.band_rows


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles (A-Z in lower case)."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(word_hashes(words), k))


def coefficients(p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    a = rng.integers(0, 2**64, p.hashes, dtype=np.uint64) | np.uint64(1)
    return a[:, None], rng.integers(0, 2**64, p.hashes, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the set, in slices that fit the cache."""
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 1024):
        h = ((shingles[i:i + 1024] * a + b) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, h.min(axis=1), out=low)
    return low


def linked_sets(x: np.ndarray, y: np.ndarray, p: NearDupParams) -> bool:
    """The link condition on two full sets."""
    if not len(x) or 100 * min(len(x), len(y)) < p.threshold_pct * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= p.threshold_pct * (len(x) + len(y) - both)


def sign(docs: DataFrame, text_col: str, carry: list[str], p: NearDupParams) -> DataFrame:
    """The columns ``carry`` and n_shingles, k1, k2 (null without shingles), sig."""
    tune(docs.sparkSession)
    schema = docs.select(*[f"`{c}`" for c in carry]).schema
    for name, kind in (("n_shingles", "long"), ("k1", "long"), ("k2", "long"), ("sig", "binary")):
        schema = schema.add(name, kind)

    def run(batches):
        a, b = coefficients(p)
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for text in byte_values(batch.column(0)):
                s = shingle_set(text, p.words)
                n.append(len(s))
                if not len(s):
                    k1.append(None), k2.append(None), sig.append(None)
                    continue
                key = xxhash.xxh3_128_digest(s.tobytes())
                k1.append(int.from_bytes(key[:8], "big", signed=True))
                k2.append(int.from_bytes(key[8:], "big", signed=True))
                sig.append(signature(mixed(s), a, b).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(sig, pa.binary())], names=schema.names)

    source = docs.select(F.col(f"`{text_col}`").alias("_0"),
                         *[F.col(f"`{c}`").alias(f"_{i + 1}") for i, c in enumerate(carry)])
    return source.mapInArrow(run, schema)


def tail(matches: int, seen: int, t: float) -> float:
    """P(similarity >= t) after ``matches`` of ``seen`` equal min-hashes, uniform prior."""
    n = seen + 1
    return sum(comb(n, j) * t**j * (1 - t) ** (n - j) for j in range(matches + 1))


def least_matches(p: NearDupParams) -> list[tuple[int, int]]:
    """(hashes seen, matches needed to go on) after each batch."""
    t = p.threshold_pct / 100
    out = []
    for seen in range(p.batch, p.hashes + 1, p.batch):
        out.append((seen, next(m for m in range(seen + 1) if tail(m, seen, t) > p.miss)))
    return out


def survives(x: np.ndarray, y: np.ndarray, p: NearDupParams, steps: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of the signature matrices ``x`` and ``y`` that pass every batch."""
    alive = np.arange(len(x))
    matches = np.zeros(len(x), np.int64)
    for seen, least in steps:
        part = slice(seen - p.batch, seen)
        matches = matches + (x[alive, part] == y[alive, part]).sum(axis=1)
        ok = matches >= least
        alive, matches = alive[ok], matches[ok]
        if not len(alive):
            break
    return alive


def matrix(sigs: list[bytes], p: NearDupParams) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), p.hashes)


def prune(pairs: DataFrame, sigs: DataFrame, p: NearDupParams) -> DataFrame:
    """The candidate pairs (u, v) whose signatures (node, sig) pass the sequential test."""
    steps = least_matches(p)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v, x, y = batch.columns
            keep = pa.array(survives(matrix(x.to_pylist(), p), matrix(y.to_pylist(), p), p, steps), pa.int64())
            yield pa.RecordBatch.from_arrays([u.take(keep), v.take(keep)], names=["u", "v"])

    x = sigs.select(F.col("node").alias("u"), F.col("sig").alias("x"))
    y = sigs.select(F.col("node").alias("v"), F.col("sig").alias("y"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(run, "u bigint, v bigint")


def confirm(pairs: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are linked; ``texts`` has (node, text)."""
    def run(batches):
        for batch in batches:
            keep, sets = [], {}

            def shingles(node, text):
                # a bucket's smallest member meets many others: its set is made once a batch
                if (found := sets.get((node, len(text)))) is None:
                    found = sets[node, len(text)] = (text, shingle_set(text, p.words))
                return found[1] if found[0] == text else shingle_set(text, p.words)

            for i, (u, v, a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                 byte_values(batch.column(2)), byte_values(batch.column(3)))):
                if not a or not b:
                    continue
                if linked_sets(shingles(u, a), shingles(v, b), p):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["u", "v"])

    pairs = written(pairs, "survivors")
    a = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def shingle_tables(nodes: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(node, set): the sorted shingle hashes of each of the ``nodes``."""
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, p.words).tobytes() for t in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return nodes.join(texts, "node").select("node", "text").mapInArrow(run, "node bigint, set binary")


def rest_links(rows: DataFrame, p: NearDupParams) -> DataFrame:
    """Links in buckets whose members are in several components.

    ``rows`` has (bucket, band, node, label, sig, set, stray, n_stray, n_all): the members that
    are not in the bucket's largest component are strays.  Strays and members are dealt to
    blocks of about ``p.block``; each pair of blocks is one group, so no task holds a bucket,
    however large.  A pair is compared if its labels differ, if no link found in the group
    joins them already, and if it did not meet in an earlier band; likely pairs come first.
    Only links leave the group."""
    steps, width = least_matches(p), 4 * p.band_rows
    blocks = lambda n: F.ceil(F.col(n) / p.block).cast("bigint")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1))
    held = rows.withColumn("i", own("n_stray")).withColumn("j", own("n_all"))
    columns = ["bucket", "i", "j", "band", "node", "label", "sig", "set"]
    left = held.filter("stray").withColumn("j", upto("n_all")).select(*columns, F.lit(True).alias("stray"))
    right = held.withColumn("i", upto("n_stray")).select(*columns, F.lit(False).alias("stray"))

    def compare(table: pa.Table) -> pa.Table:
        node, label = table.column("node").to_pylist(), table.column("label").to_numpy()
        stray = table.column("stray").to_numpy(zero_copy_only=False)
        band, sets = table.column("band")[0].as_py(), table.column("set")
        sig = matrix(table.column("sig").to_pylist(), p)
        heads = np.ascontiguousarray(sig).view(np.dtype((np.void, width)))
        names, group = np.unique(label, return_inverse=True)
        out: tuple[list, list] = ([], [])
        one, other = np.flatnonzero(stray), np.flatnonzero(~stray)
        for i in one.tolist():
            js = other[group[other] != group[i]]
            if band and len(js):
                js = js[~(heads[js, :band] == heads[i, :band]).any(axis=1)]
            if len(js):
                js = js[survives(np.broadcast_to(sig[i], (len(js), p.hashes)), sig[js], p, steps)]
            if not len(js):
                continue
            js = js[np.argsort(-(sig[js] == sig[i]).sum(axis=1), kind="stable")]
            x = np.frombuffer(sets[i].as_py(), np.uint64)
            while len(js):
                j, js = int(js[0]), js[1:]
                if linked_sets(x, np.frombuffer(sets[j].as_py(), np.uint64), p):
                    out[0].append(node[i]), out[1].append(node[j])
                    group[group == group[j]] = group[i]
                    js = js[group[js] != group[i]]
        return pa.table({"u": pa.array(out[0], pa.int64()), "v": pa.array(out[1], pa.int64())})

    return left.union(right).groupBy("bucket", "i", "j").applyInArrow(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    p: NearDupParams = NearDupParams()) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set),
    component_id (smallest id reachable by links), kept (doc_id = component_id)."""
    named = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed = written(sign(named, "text", ["doc_id"], p), "signatures")
    return linked(signed, named, p)


def linked(signed: DataFrame, named: DataFrame, p: NearDupParams) -> DataFrame:
    keys = ["k1", "k2"]
    known = signed.filter("doc_id is not null and k1 is not null")
    classes = written(known.groupBy(*keys).agg(F.min("doc_id").alias("node")), "classes")
    sigs = written(known.join(classes, keys).filter("doc_id = node").select("node", "sig"), "class-signatures")
    texts = named.select(F.col("doc_id").alias("node"), "text")

    width = 4 * p.band_rows
    bands = sigs.select("node", F.posexplode(F.expr(
        f"transform(sequence(0, {p.bands - 1}), b -> xxhash64(b, substring(sig, b * {width} + 1, {width})))"))
        .alias("band", "bucket"))
    buckets = written(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_all"), F.min("node").alias("pivot"))
                      .filter("n_all > 1"), "buckets")
    members = written(bands.join(buckets, "bucket"), "members")
    first = members.filter("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    links = written(confirm(prune(first, sigs, p), texts, p), "links")
    labels = written(components(links), "labels")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    # pairs with the pivot are done, so two others are needed; one label in a bucket: done as well
    others = labelled(members.filter("n_all > 2 and node <> pivot")).select("bucket", "band", "node", "label")
    open_ = written(others.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n_all"),
                                    (F.sum("n") - F.max("n")).alias("n_stray")).filter("n_stray > 0"), "open-buckets")
    rows = written(others.join(open_, "bucket").withColumn("stray", F.col("label") != F.col("main"))
                   .drop("main"), "open-members")
    open_sets = written(shingle_tables(rows.select("node").distinct(), texts, p).join(sigs, "node"), "open-sets")
    more = written(rest_links(rows.join(open_sets, "node"), p), "more-links")
    if more.limit(1).count():
        labels = written(components(links.union(more)), "labels")

    joined = signed.drop("sig").join(classes, keys, "left").withColumn(
        "class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id"))).drop("node")
    out = joined.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    return out.withColumn("component_id", F.coalesce("label", "class_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).drop("label", *keys)


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                         p: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of ``docs`` whose document is kept: one document of each component stays."""
    gone, mark = near_duplicates(docs, text_col, id_col, p).filter("not kept"), free_name(docs, "_gone")
    gone = written(gone.select(F.col("doc_id").alias(mark)).distinct(), "dropped-ids")
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(mark), "left_anti")

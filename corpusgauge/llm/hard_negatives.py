"""Hard negatives of anchors by inner product, pruned by summaries of vector segments.

A vector is cut into segments of ``width`` components.  Each segment's mean and deviation are
stored beside the vector; those of a segment twice as wide follow from its two halves.  For two
vectors x, y and segments of w components

    sum w * (mean_x * mean_y - dev_x * dev_y)  <=  <x, y>  <=  sum w * (mean_x * mean_y + dev_x * dev_y)

because the parts about the means meet at most as the product of their lengths.  A block of rows
meets a block of anchors first with one segment for the whole vector, then with segments of half
the width, and so on; rows and anchors none of whose pairs can still matter leave the block at
every step.  What is left is scored exactly, in integers.

The anchors are the query set: they go to the tasks in blocks of ``block_bytes``, the rows are
read in place, and a task sends on only the best of each anchor (or anchor and positive).  Two
passes a block: the positives, then the negatives between the bounds that the positives set.
Each block's result is appended to a written table, so the driver holds one block at a time.

Rows without id, label or vector, or with a null component, take no part.  Vectors of different
lengths are filled up with zeros.  Rows that repeat an id count once, with the smallest (label,
vector).  Equal scores are ordered by id.  An anchor without a positive, and a positive without a
negative, gives no row; an empty table gives none.  Scores that pass 63 bits are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.common import written
from corpusgauge.session import scratch_path


@dataclass(frozen=True)
class MineParams:
    positives: int = 5           # an anchor's best rows of its label
    negatives: int = 5           # rows of other labels, for each positive
    low: int = 80                # a negative's score lies between low and high hundredths
    high: int = 100              # of the positive's
    width: int = 4               # components of the smallest segment
    rows: int = 4096             # rows that meet a block of anchors at a time
    block_bytes: int = 8 << 20   # of the anchors sent to the tasks at a time


def matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """A list column as rows of equal length, a multiple of ``width``, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()]
    across = -(-max([1, *sizes.tolist()]) // width) * width
    out = np.zeros((len(column), across), kind)
    out[np.arange(across) < sizes[:, None]] = flat
    return out


def summary(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of ``width`` components."""
    parts = x.reshape(len(x), x.shape[1] // width, width).astype(np.float64)
    return parts.mean(axis=2), parts.std(axis=2)


def filled(x: np.ndarray, across: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, across - x.shape[1])))


def hierarchy(means: np.ndarray, devs: np.ndarray, width: int, across: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means, deviations) times the root of the segment's width, from one segment to all."""
    means, devs = filled(means, across), filled(devs, across)
    steps = [(means * width ** 0.5, devs * width ** 0.5)]
    while means.shape[1] > 1:
        pair = means.reshape(len(means), means.shape[1] // 2, 2)
        square = (pair ** 2 + devs.reshape(pair.shape) ** 2).mean(axis=2)
        means = pair.mean(axis=2)
        devs = np.sqrt(np.maximum(square - means ** 2, 0))
        width *= 2
        steps.append((means * width ** 0.5, devs * width ** 0.5))
    return steps[::-1]


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``x`` and ``y``."""
    n = max(x.shape[1], y.shape[1])
    x, y = filled(x, n), filled(y, n)
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(y.astype(np.float64)).max(initial=0)) * n
    if most < 2.0 ** 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if most >= 2.0 ** 63:
        raise ValueError("inner products pass 63 bits")
    return x @ y.T


class Block:
    """Anchors (or rows) with their summaries."""

    def __init__(self, ids, labels, vectors, means, devs):
        self.ids, self.labels, self.vectors, self.means, self.devs = ids, labels, vectors, means, devs

    def steps(self, width: int, segments: int):
        return hierarchy(self.means, self.devs, width, segments)


def survivors(rows: Block, anchors: Block, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, width: int):
    """Numbers of the rows and of the anchors that have a pair which is ``allowed`` and whose
    score can lie between the anchor's ``least`` and ``most``."""
    wide = max(rows.means.shape[1], anchors.means.shape[1])
    segments = 1 << (wide - 1).bit_length()
    r, a = np.arange(len(rows.ids)), np.arange(len(anchors.ids))
    for (mr, sr), (ma, sa) in zip(rows.steps(width, segments), anchors.steps(width, segments)):
        if not len(r) or not len(a):
            break
        middle, spread = mr[r] @ ma[a].T, sr[r] @ sa[a].T
        # scores are integers: half of one, and far more than the rounding of large sums
        spread += 0.5 + 1e-12 * (np.abs(middle) + spread)
        alive = allowed[np.ix_(r, a)] & (middle + spread >= least[a]) & (middle - spread <= most[a])
        r, a = r[alive.any(axis=1)], a[alive.any(axis=0)]
    return r, a


class Best:
    """The ``k`` best (score descending, id ascending) of each of ``n`` keys."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        self.floor = np.full(n, -np.inf)   # the k-th best score

    def add(self, key: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[near], ids[near]
        s, i = np.concatenate([self.scores[key], scores]), np.concatenate([self.ids[key], ids])
        order = np.lexsort((i, -s))[:self.k]
        self.scores[key], self.ids[key] = s[order], i[order]
        if len(order) == self.k:
            self.floor[key] = s[order[-1]]


def row_blocks(batches, p: MineParams):
    """The batches of (id, label, vector, means, devs) in blocks of ``p.rows`` rows."""
    held, n = [], 0

    def block():
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return Block(t.column(0).to_numpy(), t.column(1).to_numpy(), matrix(t.column(2), np.int64, p.width),
                     matrix(t.column(3), np.float64, 1), matrix(t.column(4), np.float64, 1))

    for batch in batches:
        for start in range(0, batch.num_rows, p.rows):
            part = batch.slice(start, p.rows)
            held.append(part)
            n += part.num_rows
            if n >= p.rows:
                yield block()
                held, n = [], 0
    if n:
        yield block()


def segment_table(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, p: MineParams = MineParams()) -> DataFrame:
    """``vectors`` (integers) with the means and deviations of their segments, one row an id."""
    i, label, v = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{label_col}`").cast("bigint"), F.col(f"`{vec_col}`").cast("array<bigint>")
    clean = vectors.select(i.alias("id"), F.struct(label.alias("label"), v.alias("vec")).alias("row")).filter(
        "id is not null and row.label is not null and row.vec is not null and forall(row.vec, x -> x is not null)")
    one = clean.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vec")
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*one.schema, T.StructField("means", doubles), T.StructField("devs", doubles)])

    def run(batches):
        for batch in batches:
            means, devs = summary(matrix(batch.column(2), np.int64, p.width), p.width) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(means), pa.list_(pa.float64())),
                                              pa.array(list(devs), pa.list_(pa.float64()))], names=schema.names)

    return written(one.mapInArrow(run, schema), "segments")


def positives_of(table: DataFrame, anchors: Block, p: MineParams) -> DataFrame:
    """(anchor, positive, score, rank): the best rows of the anchors' labels."""
    def run(batches):
        best = Best(len(anchors.ids), p.positives)
        for rows in row_blocks(batches, p):
            for label in np.unique(rows.labels):
                x, y = np.flatnonzero(rows.labels == label), np.flatnonzero(anchors.labels == label)
                xs, ys = part(rows, x), part(anchors, y)
                allowed = xs.ids[:, None] != ys.ids
                r, a = survivors(xs, ys, allowed, best.floor[y], np.full(len(y), np.inf), p.width)
                scores = exact(xs.vectors[r], ys.vectors[a])
                for j, key in enumerate(a):
                    ok = (xs.ids[r] != ys.ids[key]) & (scores[:, j] >= best.floor[y[key]])
                    best.add(y[key], scores[ok, j], xs.ids[r][ok])
        yield best_rows([(i,) for i in anchors.ids.tolist()], best, ["anchor", "positive", "score"])

    found = table.mapInArrow(run, "anchor bigint, positive bigint, score bigint")
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "positive")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.positives)


def part(b: Block, rows: np.ndarray) -> Block:
    return Block(b.ids[rows], b.labels[rows], b.vectors[rows], b.means[rows], b.devs[rows])


def best_rows(keys: list[tuple], best: Best, names: list[str]) -> pa.RecordBatch:
    out = [(*key, i, s) for key, ids, scores in zip(keys, best.ids, best.scores) for i, s in zip(ids.tolist(), scores.tolist())]
    columns = zip(*out) if out else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def negatives_of(table: DataFrame, anchors: Block, positives: list[list[tuple[int, int]]], p: MineParams) -> DataFrame:
    """(anchor_id, positive_id, positive_score, negative_id, negative_score, rank); ``positives``:
    (id, score) of each anchor's."""
    keys = [(a, i, s) for a, found in zip(anchors.ids.tolist(), positives) for i, s in found]
    owner = np.repeat(np.arange(len(positives)), [len(x) for x in positives])
    score = [s for _, _, s in keys]
    # low * positive <= 100 * negative <= high * positive
    least, most = np.array([-(-p.low * s // 100) for s in score]), np.array([p.high * s // 100 for s in score])
    by_anchor = np.split(np.arange(len(keys)), np.cumsum([len(x) for x in positives])[:-1]) if positives else []
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches):
        best = Best(len(keys), p.negatives)
        top = np.full(len(anchors.ids), -np.inf)
        np.maximum.at(top, owner, most)
        for rows in row_blocks(batches, p):
            need = np.full(len(anchors.ids), np.inf)
            np.minimum.at(need, owner, np.maximum(least, best.floor))
            allowed = rows.labels[:, None] != anchors.labels
            r, a = survivors(rows, anchors, allowed, need, top, p.width)
            scores = exact(rows.vectors[r], anchors.vectors[a])
            for j, anchor in enumerate(a):
                column, other = scores[:, j], allowed[r, anchor]
                for key in by_anchor[anchor]:
                    ok = other & (column <= most[key]) & (column >= max(least[key], best.floor[key]))
                    best.add(key, column[ok], rows.ids[r][ok])
        yield best_rows(keys, best, names)

    found = table.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.negatives)


def anchor_block(rows: DataFrame, p: MineParams) -> Block:
    t = rows.toArrow()
    t = t.sort_by("id").combine_chunks()
    column = lambda n: t.column(n).combine_chunks()
    return Block(column("id").to_numpy(), column("label").to_numpy(), matrix(column("vec"), np.int64, p.width),
                 matrix(column("means"), np.float64, 1), matrix(column("devs"), np.float64, 1))


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
         p: MineParams = MineParams()) -> DataFrame:
    """(anchor_id, positive_id, positive_score, negative_id, negative_score, rank) of the rows
    that fulfil ``is_anchor`` (over the columns id and label) against all rows."""
    table = segment_table(vectors, id_col, label_col, vec_col, p)
    spark, path = table.sparkSession, scratch_path(table.sparkSession, "negatives")
    chosen = table.filter(is_anchor)
    size = chosen.agg(F.sum(F.lit(32) + 24 * F.size("vec"))).first()[0] or 0
    n = 1 + size // p.block_bytes
    out = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint, rank int"
    for k in range(n if size else 0):
        anchors = anchor_block(chosen.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k), p)
        found: dict[int, list] = {}
        for r in positives_of(table, anchors, p).collect():   # a few rows for each anchor of the block
            found.setdefault(r.anchor, []).append((r.rank, r.positive, r.score))
        positives = [[x[1:] for x in sorted(found.get(i, []))] for i in anchors.ids.tolist()]
        negatives_of(table, anchors, positives, p).write.mode("append").parquet(path)
    if not size:
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(path)

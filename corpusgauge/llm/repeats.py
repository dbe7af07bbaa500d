"""Repeated passages by prefix-free parsing with rolling-hash triggers.

A string of ``length`` bytes (200) that starts in two places of the corpus is repeated, and every
byte it covers is removed.

1. Parse.  A rolling hash of ``gram`` bytes is taken at every byte.  In every window of
   ``length`` bytes the place of the smallest hash is the window's trigger; it depends on those
   bytes alone, so equal windows have the trigger in the same place.  A phrase is all that the
   windows of one trigger cover.  Phrases are longer than ``length`` and overlap by
   ``length - 1`` bytes, so every window lies in exactly one phrase, and the order of the
   corpus' suffixes up to ``length`` bytes is the order of the phrases' own suffixes: the
   dictionary's suffixes alone decide which windows are equal.  About one byte in 85 is a
   trigger; a phrase is one narrow row (hash at the trigger, hash of the phrase, place).
2. Dictionary.  Phrases are counted by their trigger's hash (a partial aggregate).  A trigger
   hash that occurs once has no repeated window.  If all phrases of a trigger hash are equal, all
   their windows are repeated: copies and long passages end here, however many they are.
3. Where phrases of one trigger hash differ (the edges of passages, edited copies), their
   distinct strings are fetched once each, and their suffixes are compared: first blocks of 16
   neighbouring windows (what the block's windows share, and all they cover), then single
   windows in blocks that are still undecided.  These are aggregates too, keyed by content, so
   no task holds the phrases of a frequent trigger.
4. The repeated windows are joined back to the phrases' places, gathered per text, and each text
   is cut once.

Strings are compared by 64-bit hashes within a 64-bit trigger hash of another base.  Texts
are told apart by 79 bits of hash of id and text.  A null text is empty; null and repeated ids keep their rows, and
the occurrences in repeated rows count as occurrences.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.common import byte_values, discard, mixed, tune, written


@dataclass(frozen=True)
class RepeatParams:
    length: int = 200      # bytes of a repeated string
    gram: int = 32         # bytes under the rolling hash
    block: int = 16        # windows compared together in undecided phrases
    chunk: int = 1 << 20   # bytes parsed at a time (a longer text: all of it)

    def __post_init__(self):
        if not self.gram < self.length or self.length - self.gram >= 256:
            raise ValueError("a phrase's windows are numbered in one byte")


PLACE_BITS = np.uint64(28)  # of a position in a chunk; the rest of the word orders the hashes


@lru_cache(maxsize=1)
def constants() -> tuple[np.ndarray, np.ndarray, int, int]:
    """Two tables of random byte values and two odd bases."""
    rng = np.random.default_rng(97)
    values = rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
    return values[0], values[1], int(rng.integers(0, 2**63)) * 2 + 1, int(rng.integers(0, 2**63)) * 2 + 1


class Powers:
    """Powers of the two bases and of their inverses, as many as the longest chunk needed."""

    def __init__(self):
        self.size = 0

    def upto(self, n: int):
        if n > self.size:
            self.size = max(n, 1 << 16)
            _, _, a, b = constants()
            self.tables = []
            for base in (a, pow(a, -1, 2**64), b, pow(b, -1, 2**64)):
                steps = np.full(self.size, base, np.uint64)
                steps[0] = 1
                self.tables.append(np.cumprod(steps, dtype=np.uint64))
        return [t[:n] for t in self.tables]


POWERS = Powers()


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by running minima of blocks of ``w``."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    rows = padded.reshape(-1, w)
    front = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[w - 1:w - 1 + n])


def phrases(texts: list[bytes], p: RepeatParams):
    """(text number, trigger hash, phrase hash, first window, last window, trigger) as arrays."""
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    none = np.empty(0, np.int64)
    if n < p.length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    v1, v2, _, _ = constants()
    pow1, inv1, pow2, inv2 = POWERS.upto(n + 1)
    zero = np.zeros(1, np.uint64)
    sum1 = np.concatenate([zero, np.cumsum(v1[data] * pow1[:n])])
    grams = mixed((sum1[p.gram:] - sum1[:-p.gram]) * inv1[:n - p.gram + 1])
    places = np.arange(len(grams), dtype=np.uint64)
    low = sliding_min((grams >> PLACE_BITS << PLACE_BITS) | places, p.length - p.gram + 1)
    trigger = (low & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    # windows that lie in one text; a phrase is a run of windows with one trigger
    owner = np.repeat(np.arange(len(texts)), np.maximum(size - p.length + 1, 0))
    inside = np.arange(len(owner)) - np.repeat(
        np.cumsum(np.maximum(size - p.length + 1, 0)) - np.maximum(size - p.length + 1, 0),
        np.maximum(size - p.length + 1, 0)) + first[owner]
    if not len(inside):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    of = trigger[inside]
    new = np.flatnonzero((np.diff(of) != 0) | (np.diff(owner) != 0)) + 1
    begin = np.concatenate([[0], new])
    end = np.concatenate([new, [len(inside)]]) - 1
    lo, hi, x = inside[begin], inside[end], of[begin]
    sum2 = np.concatenate([zero, np.cumsum(v2[data] * pow2[:n])])
    whole = mixed((sum2[hi + p.length] - sum2[lo]) * inv2[lo])
    text = owner[begin]
    return text, grams[x], whole, lo - first[text], hi - first[text], x - first[text]


def chunks(texts: list[bytes], size: int):
    """Runs of texts of about ``size`` bytes, with the number of the first."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, texts[start:i]
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, texts[start:]


def packed(mark, lo, first, last):
    """Windows ``first`` to ``last`` after the window ``lo`` of a text, and 15 more bits of the
    text's hash, in one number.  Both numbers after ``lo`` are below 256."""
    return mark << 48 | lo << 16 | first << 8 | last


def unpacked(at: int) -> tuple[int, int, int, int]:
    """(mark, lo, first, last), windows counted from the text's start."""
    lo = at >> 16 & 0xFFFFFFFF
    return at >> 48, lo, lo + (at >> 8 & 255), lo + (at & 255)


def parse(texts: DataFrame, p: RepeatParams) -> DataFrame:
    """``texts`` (th, mark, text) -> one row per phrase: th, trigger hash ``key``, phrase hash
    ``whole``, and ``at``: its first window, its last one and its trigger after that."""
    tune(texts.sparkSession)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("th", "key", "whole", "at")])

    def run(batches):
        for batch in batches:
            data = [t or b"" for t in byte_values(batch.column(2))]
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            for start, part in chunks(data, p.chunk):
                text, key, whole, lo, hi, x = phrases(part, p)
                row = text + start
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)),
                     pa.array(packed(marks[row], lo, hi - lo, x - lo))], names=schema.names)

    return texts.select("th", "mark", "text").mapInArrow(run, schema)


def with_text(texts: DataFrame, rows: DataFrame, out: str) -> DataFrame:
    """``texts`` and the list ``out`` of the ``r`` of ``rows`` (th, r) in each.

    Always a left join on the same key, so that Spark moves the texts once for all uses of this
    in a plan; the narrow side is the build side."""
    lists = rows.groupBy("th").agg(F.collect_list("r").alias(out)).select(F.col("th").alias("_th"), out)
    return texts.join(lists.hint("shuffle_hash"), F.col("th") == F.col("_th"), "left").select("id", "th", "mark", "text", out)


def struct_lists(column: pa.Array, names: list[str]):
    """For each row of a list-of-struct column: tuples of the named fields."""
    flat = column.values
    fields = [flat.field(n).to_pylist() for n in names]
    ends = column.offsets.to_pylist()
    rows = list(zip(*fields))
    return [rows[a:b] for a, b in zip(ends, ends[1:])]


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def compare_blocks(texts: DataFrame, dictionary: DataFrame, p: RepeatParams) -> DataFrame:
    """Blocks of neighbouring windows of the distinct undecided phrases: key, shared (hash of what
    all windows of the block have in common), cover (hash of all they cover, and where), whole,
    n (occurrences), and a text and the place in it that has the block's windows."""
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for th, mark, text, reps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                            byte_values(batch.column(3)), struct_lists(batch.column(4), ["key", "whole", "at", "n"])):
                for key, whole, at, n in reps:
                    of, lo, hi, x = unpacked(at)
                    if of != mark:
                        continue
                    for b in range((x - hi) // p.block, (x - lo) // p.block + 1):
                        # windows of the block start at x - a, a from block * b on
                        far, near = x - p.block * (b + 1) + 1, x - p.block * b
                        i0, i1 = max(lo, far), min(hi, near)
                        shared = signed(xxhash.xxh3_64_intdigest(text[near:far + p.length], seed=b))
                        cover = signed(xxhash.xxh3_64_intdigest(text[i0:i1 + p.length], seed=(x - i0) << 16 | (x - i1)))
                        out.append((th, key, whole, n, shared, cover, packed(mark, lo, i0 - lo, i1 - lo)))
            yield rows_batch(out, names)

    names = ["th", "key", "whole", "n", "shared", "cover", "at"]
    reps = dictionary.select("th", F.struct("key", "whole", "at", "n").alias("r"))
    return with_text(texts, reps, "reps").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def rows_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def compare_windows(texts: DataFrame, blocks: DataFrame, p: RepeatParams) -> DataFrame:
    """Single windows of undecided blocks: key, window (hash), whole, n, j (number in the phrase)."""
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for mark, text, found in zip(batch.column(2).to_pylist(), byte_values(batch.column(3)),
                                         struct_lists(batch.column(4), ["key", "whole", "n", "at"])):
                for key, whole, n, at in found:
                    of, lo, i0, i1 = unpacked(at)
                    if of == mark:
                        out += [(key, signed(xxhash.xxh3_64_intdigest(text[i:i + p.length])), whole, n, i - lo)
                                for i in range(i0, i1 + 1)]
            yield rows_batch(out, names)

    names = ["key", "window", "whole", "n", "j"]
    rows = blocks.select("th", F.struct("key", "whole", "n", "at").alias("r"))
    return with_text(texts, rows, "blocks").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def cut(texts: DataFrame, spans: DataFrame, p: RepeatParams) -> DataFrame:
    """id, n_bytes, n_removed, starts and ends (maximal removed runs), kept (the remaining bytes)."""
    schema = texts.select("id").schema.add("n_bytes", "long").add("n_removed", "long").add(
        "starts", T.ArrayType(T.IntegerType())).add("ends", T.ArrayType(T.IntegerType())).add("kept", "binary")

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            flat, ends = batch.column(4).values.to_numpy(zero_copy_only=False), batch.column(4).offsets.to_pylist()
            for i, (mark, text) in enumerate(zip(batch.column(2).to_pylist(), byte_values(batch.column(3)))):
                text = text or b""
                edge = np.zeros(len(text) + 1, np.int32)
                of, _, first, last = unpacked(flat[ends[i]:ends[i + 1]])
                runs = of == mark
                np.add.at(edge, first[runs], 1)
                np.add.at(edge, last[runs] + p.length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out[0].append(len(text)), out[1].append(int(gone.sum()))
                out[2].append(turn[::2]), out[3].append(turn[1::2])
                out[4].append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=schema.names)

    return with_text(texts, spans, "spans").mapInArrow(run, schema)


def joined_runs(runs):
    """Sorted runs of windows (first * 256 + last) with neighbouring ones made one."""
    first, last = lambda r: F.shiftright(r, 8), lambda r: r.bitwiseAND(255)
    end = lambda acc: F.element_at(acc, -1)
    return F.aggregate(F.slice(runs, 2, 256), F.slice(runs, 1, 1), lambda acc, r: F.when(
        first(r) <= last(end(acc)) + 1,
        F.concat(F.slice(acc, 1, F.size(acc) - 1),
                 F.array(F.shiftleft(first(end(acc)), 8) + F.greatest(last(end(acc)), last(r)))))
        .otherwise(F.concat(acc, F.array(r))))


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   p: RepeatParams = RepeatParams()) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, starts, ends, kept (see :func:`cut`)."""
    # a row is known by 79 bits of hash of its id and text: nulls and repeats need no care
    named = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    texts = docs.select(named[0].alias("id"), F.xxhash64(*named, named[0].isNull()).alias("th"),
                        F.shiftright(F.hash(*named), 17).cast("bigint").alias("mark"), named[1].alias("text"))
    parsed = written(parse(texts, p), "phrases")
    # written, so that the join has a shuffle on both sides and Spark can split a frequent key
    keys = written(parsed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("w0"), F.max("whole").alias("w1"))
                   .filter("n > 1").select("key", (F.col("w0") != F.col("w1")).alias("open")), "repeated-triggers")
    found = written(parsed.join(keys, "key"), "repeated-phrases")
    discard(parsed)
    # the windows of a phrase: the first is its first, so the numbers after it are 0 and (its last)
    last = F.shiftright("at", 8).bitwiseAND(255)
    place = F.shiftleft(F.shiftright("at", 16), 16)
    equal = found.filter("not open").select("th", place.bitwiseOR(last).alias("r"))

    open_ = found.filter("open")
    dictionary = written(open_.groupBy("key", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("th", "at")).alias("at"))
        .select("key", "whole", "n", "at.th", "at.at"), "dictionary")
    blocks = compare_blocks(texts, dictionary, p)
    state = (blocks.groupBy("key", "shared").agg(F.sum("n").alias("total"), F.min("cover").alias("c0"),
                                                 F.max("cover").alias("c1"))
             .filter("total > 1").select("key", "shared", (F.col("c0") != F.col("c1")).alias("mixed")))
    decided = blocks.join(state, ["key", "shared"])
    windows = compare_windows(texts, decided.filter("mixed"), p)
    twice = windows.groupBy("key", "window").agg(F.sum("n").alias("total")).filter("total > 1").select("key", "window")
    single = windows.join(twice, ["key", "window"]).select(
        "key", "whole", (F.shiftleft("j", 8) + F.col("j")).alias("run"))
    whole_blocks = decided.filter("not mixed").select("key", "whole", F.col("at").bitwiseAND(0xFFFF).alias("run"))
    # at most ``length`` numbers a phrase
    repeated = single.union(whole_blocks).groupBy("key", "whole").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    repeated = repeated.select("key", "whole", joined_runs(F.col("runs")).alias("runs"))
    partly = open_.join(repeated, ["key", "whole"]).select("th", place.alias("place"), F.explode("runs").alias("run")).select(
        "th", F.col("place").bitwiseOR(F.col("run")).alias("r"))
    return cut(texts, equal.union(partly), p)

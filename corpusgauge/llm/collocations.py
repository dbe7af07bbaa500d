"""Phrase collocations by mergeable Misra-Gries summaries and one exact recount.

Texts are lower-cased (A-Z), cut at ``.,;:!?`` and 0A-0D (hex) into pieces, and those into words at
spaces and tabs; n-grams of 1 to ``longest`` words are counted within pieces, per language.

1. Chunks.  A task packs the pieces it reads into chunks of ``chunk`` bytes, one written row each.
2. Summaries.  A chunk's n-grams are hashed to keys, whose upper bits name one of P partitions.
   For each partition a chunk gives one row: its sorted keys, their counts, and their mass (the sum
   of the counts).  These are Misra-Gries summaries with as many counters as keys.
3. Merging.  A partition's task knows the partition's whole mass M and merges the summaries with
   C > M / ``least`` counters: counts of equal keys are added, and when more than C are left, the
   (C+1)-st largest count is taken from all, and what is not positive goes.  Each such step takes
   its amount from C + 1 counters at least, so all steps together take D < M / C < ``least`` from a
   key: every n-gram that occurs ``least`` times survives.  Keys whose count plus D stays below
   ``least`` go as well.
4. Recount.  A second pass over the same rows adds up the survivors' counts exactly; the rare ones
   go.  Each frequent n-gram is given back to one of the chunks that have it, which names its words.

An n-gram leaves a chunk as a few bytes of a sorted list of keys, a frequent one is one counter a
chunk, its words leave one chunk, and nothing is sent to all tasks.  N-grams are told apart by
64-bit hashes of their words and language.

A null text is empty, a null language ``und``.  Repeated rows count each time, ids are not read.  A
long text is cut at the ends of pieces; a task holds one chunk, or one longer piece.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.common import MIX, byte_values, mixed, tune, written
from corpusgauge.llm.repeats import POWERS, constants


@dataclass(frozen=True)
class CollocationParams:
    longest: int = 3                    # words of a phrase
    least: int = 10                     # occurrences of a phrase
    inside: int = 50                    # percent of them inside one longer phrase: dropped
    chunk: int = 4 << 20                # bytes of text whose n-grams are counted together
    partition: int = 8 << 20            # bytes of text for each hash partition
    slack: int = 2                      # counters of a summary: this times mass / least


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END, SPACE = 1, 2   # classes of bytes: ends of pieces, spaces between words
CLASS = np.zeros(256, np.uint8)
CLASS[list(b".,;:!?\n\x0b\x0c\r")] = END
CLASS[list(b" \t")] = SPACE


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: they set the number of partitions."""
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0


def cut_at_pieces(text: bytes, size: int):
    """``text`` in parts of about ``size`` bytes that end with a piece."""
    if len(text) <= size:
        return [text]
    ends = np.flatnonzero(CLASS[np.frombuffer(text, np.uint8)] == END) + 1
    marks = ends[np.flatnonzero(np.diff(ends // size, prepend=0))].tolist()
    return [text[a:b] for a, b in zip([0, *marks], [*marks, len(text)]) if a < b]


def chunk_rows(docs: DataFrame, text_col: str, lang_col: str, p: CollocationParams) -> DataFrame:
    """(chunk, langs, sizes, blob): texts of about ``p.chunk`` bytes, lower-cased and compressed,
    grouped by language; a text ends with an end of piece."""
    tune(docs.sparkSession)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        held: dict[str, list[bytes]] = {}
        size = 0

        def row():
            joined = {k: b"\n".join([*v, b""]) for k, v in held.items()}
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(joined.values()))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([list(joined)], pa.list_(pa.string())),
                 pa.array([[len(v) for v in joined.values()]], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["chunk", "langs", "sizes", "blob"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                for part in cut_at_pieces((text or b"").translate(LOWER), p.chunk):
                    held.setdefault(lang, []).append(part)
                    size += len(part) + 1
                    if size >= p.chunk:
                        yield row()
                        number, held, size = number + 1, {}, 0
        if size:
            yield row()

    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).cast("string"), F.col(f"`{text_col}`"))
    return written(texts.mapInArrow(run, "chunk bigint, langs array<string>, sizes array<bigint>, blob binary"), "chunks", "uncompressed")


def one_by_one(batch: pa.RecordBatch):
    """The rows of a batch of chunks, one in memory at a time."""
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in batch.columns]


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word, of some words at a time."""
    values, _, _, _ = constants()
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), step):
        a, b = start[i:i + step] - start[i], stop[i:i + step] - start[i]
        part = raw[start[i]:start[i] + b[-1]]
        power, inverse, _, _ = POWERS.upto(len(part) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[part] * power[:len(part)])])
        out[i:i + step] = mixed((total[b] - total[a]) * inverse[a])
    return out


class Words:
    """The words of a chunk: where they are in ``data``, their hashes, and the number of words from
    each to the end of its piece."""

    def __init__(self, langs: list[str], sizes: list[int], blob: bytes):
        self.langs, self.data = langs, zstandard.ZstdDecompressor().decompress(blob)
        raw = np.frombuffer(self.data, np.uint8)
        kind = CLASS[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.stop = turn[::2], turn[1::2]
        self.hash = word_hashes(raw, self.start, self.stop)
        piece = np.searchsorted(np.flatnonzero(kind == END), self.start)
        last = np.flatnonzero(np.diff(piece, append=-1))
        self.left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(piece)) + 1 if len(piece) else piece
        self.lang = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        # a language's name stands first in the hash of its n-grams
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)
        self.seed = seeds[self.lang] if len(self.start) else np.empty(0, np.uint64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the runs of ``k`` words within pieces."""
        first = np.flatnonzero(self.left >= k)
        h = self.seed[first] + np.uint64(k)
        for j in range(k):
            h = h * MIX + self.hash[first + j]
        return first, mixed(h)


def bounds(partitions: int) -> np.ndarray:
    """The smallest key of each partition but the first."""
    return np.array([(i << 64) // partitions for i in range(1, partitions)], np.uint64)


def packed_list(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpacked_list(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, low bytes first and high bytes last."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return packed_list(steps.view(np.uint8).reshape(-1, 8).T.copy())


def unpacked_keys(x: bytes) -> np.ndarray:
    planes = unpacked_list(x, np.uint8).reshape(8, -1)
    return np.cumsum(planes.T.copy().view("<u8").ravel(), dtype=np.uint64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts (``keys``: sorted runs)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def summaries(chunks: DataFrame, partitions: int, p: CollocationParams) -> DataFrame:
    """(p, chunk, mass, keys, counts): a chunk's summary of each partition."""
    limits = bounds(partitions)

    def run(batches):
        for batch in batches:
            for chunk, langs, sizes, blob in one_by_one(batch):
                words = Words(langs, sizes, blob)
                # one size after the other: a third of the memory
                found = [np.unique(words.grams(k)[1], return_counts=True) for k in range(1, p.longest + 1)]
                keys, counts = added(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))
                edges = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
                counts = counts.astype("<u4")
                out = [(i, chunk, int(counts[a:b].sum(dtype=np.int64)), packed_keys(keys[a:b]), packed_list(counts[a:b]))
                       for i, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                kinds = [pa.int64()] * 3 + [pa.binary()] * 2
                columns = zip(*out) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = ["p", "chunk", "mass", "keys", "counts"]
    return chunks.mapInArrow(run, "p bigint, chunk bigint, mass bigint, keys binary, counts binary")


class Summary:
    """A Misra-Gries summary: sorted ``keys``, their ``counts``, and how much was ``taken`` from each."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Counters of other summaries, in any order and repeated, are added."""
        self.keys, self.counts = added(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(self.keys) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            amount = int(np.partition(self.counts, at)[at])
            self.taken += amount
            left = self.counts > amount
            self.keys, self.counts = self.keys[left], self.counts[left] - amount

    def reaching(self, least: int) -> np.ndarray:
        """Keys that may have occurred ``least`` times."""
        return self.keys[self.counts + self.taken >= least]


def merged(rows: list[tuple[bytes, bytes]], mass: int, p: CollocationParams) -> Summary:
    """One summary of all ``rows`` (keys, counts); some are taken together, up to its capacity."""
    summary = Summary(p.slack * mass // p.least + 1)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for i, (keys, counts) in enumerate(rows):
        held.append((unpacked_keys(keys), unpacked_list(counts, "<u4").astype(np.int64)))
        n += len(held[-1][0])
        if n >= summary.capacity or i == len(rows) - 1:
            summary.merge(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    return summary


def matches(alive: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the sorted ``alive`` and in ``keys`` of the keys that both have."""
    if not len(alive):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(alive, keys), len(alive) - 1)
    mine = np.flatnonzero(alive[at] == keys)
    return at[mine], mine


def counted(rows: list[tuple[bytes, bytes]], alive: np.ndarray) -> np.ndarray:
    """How often each of the sorted keys ``alive`` occurs in all ``rows``."""
    out = np.zeros(len(alive), np.int64)
    for keys, counts in rows:
        at, mine = matches(alive, unpacked_keys(keys))
        out[at] += unpacked_list(counts, "<u4")[mine]
    return out


def frequent_keys(rows: DataFrame, p: CollocationParams) -> DataFrame:
    """(chunk, keys, counts): every key that occurs ``least`` times, with its exact count, once, for
    a chunk that has it."""
    def group(key, t):
        rows = list(zip(t.column("keys").to_pylist(), t.column("counts").to_pylist()))
        alive = merged(rows, sum(t.column("mass").to_pylist()), p).reaching(p.least)
        n = counted(rows, alive)
        alive, n = alive[n >= p.least], n[n >= p.least]
        owned = np.zeros(len(alive), bool)
        out = []
        # each partition begins with another chunk, so that all chunks get their share
        first = int(key[0].as_py()) * 7919 % len(rows)
        for i in [*range(first, len(rows)), *range(first)]:
            at, _ = matches(alive, unpacked_keys(rows[i][0]))
            at = at[~owned[at]]
            owned[at] = True
            if len(at):
                out.append((t.column("chunk")[i].as_py(), packed_keys(alive[at]), packed_list(n[at])))
        columns = zip(*out) if out else [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "keys", "counts"])

    return rows.groupBy("p").applyInArrow(group, "chunk bigint, keys binary, counts binary")


def named(chunks: DataFrame, keys: DataFrame, p: CollocationParams) -> DataFrame:
    """(lang, size, phrase, n): the words of each chunk's ``keys``, and the number of its words as size 0."""
    names = ["lang", "size", "phrase", "n"]

    def run(batches):
        for batch in batches:
            for langs, sizes, blob, found in one_by_one(batch):
                words = Words(langs, sizes, blob)
                mine = np.concatenate([unpacked_keys(r["keys"]) for r in found or []] or [np.empty(0, np.uint64)])
                total = np.concatenate([unpacked_list(r["counts"], np.int64) for r in found or []] or [np.empty(0, np.int64)])
                order = np.argsort(mine)
                mine, total = mine[order], total[order]
                of, every = np.unique(words.lang, return_counts=True)
                lang, size, counts, phrases = [of], [np.zeros(len(of), np.int64)], [every], [b""] * len(of)
                for k in range(1, p.longest + 1):
                    first, h = words.grams(k)
                    at, hit = matches(mine, h)
                    which, one = np.unique(at, return_index=True)
                    a = first[hit[one]]
                    lang.append(words.lang[a]), size.append(np.full(len(a), k)), counts.append(total[which])
                    each = [[words.data[i:j] for i, j in zip(words.start[a + j].tolist(), words.stop[a + j].tolist())] for j in range(k)]
                    phrases += map(b" ".join, zip(*each))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[i] for i in np.concatenate(lang).tolist()], pa.string()),
                     pa.array(np.concatenate(size).astype(np.int32)), pa.array(phrases, pa.binary()),
                     pa.array(np.concatenate(counts).astype(np.int64))], names=names)

    lists = keys.groupBy("chunk").agg(F.collect_list(F.struct("keys", "counts")).alias("found"))
    joined = chunks.join(lists, "chunk", "left").select("langs", "sizes", "blob", "found")
    return joined.mapInArrow(run, "lang string, size int, phrase binary, n bigint").withColumn("phrase", F.col("phrase").cast("string"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                     p: CollocationParams = CollocationParams()) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of 1 to ``longest`` words that occur ``least`` times,
    exactly, and the number of all words as size 0."""
    partitions = 1 + text_bytes(docs, text_col) // p.partition
    chunks = chunk_rows(docs, text_col, lang_col, p)
    rows = written(named(chunks, frequent_keys(summaries(chunks, partitions, p), p), p), "phrases")
    words = rows.filter("size = 0").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return rows.filter("size > 0").unionByName(words)


def scored(phrases: DataFrame, p: CollocationParams = CollocationParams()) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases of two words and more: of all cuts in
    two the one with the lowest score floor(1000000 a a / (l r)), and of those the first.

    ``phrases``: as of :func:`frequent_phrases`.  A side of a cut occurs as often as
    the phrase at least, so it is in the table."""
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "size", "a", F.explode(F.array(
        F.struct("k", F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")),
        F.struct("k", F.lit("r").alias("side"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))).alias("s")).select(
        "lang", "phrase", "size", "a", "s.k", "s.side", "s.part")
    known = phrases.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    count = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    ks = range(1, p.longest)
    wide = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "size", "a").agg(
        *[count(k, side).alias(f"{side}{k}") for k in ks for side in "lr"])
    # exact: products as decimals of 38 digits; a score is 1000000 at most
    big = lambda c: f"cast({c} as decimal(18, 0))"
    score = lambda k: F.expr(f"cast(1000000 as decimal(7, 0)) * {big('a')} * {big('a')} div ({big(f'l{k}')} * {big(f'r{k}')})")
    best = F.array_min(F.filter(F.array(*[
        F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in ks]),
        lambda x: x["score"].isNotNull()))
    return wide.withColumn("best", best).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def not_inside(candidates: DataFrame, phrases: DataFrame, p: CollocationParams = CollocationParams()) -> DataFrame:
    """``candidates`` without those that lie in a longer phrase with ``inside`` percent of their
    occurrences."""
    inner = phrases.filter("size > 2").select("lang", "n", "size", F.split("phrase", " ").alias("w")).select(
        "lang", "n", "size", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k")).select(
        "lang", "n", "k", "w", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i")).select(
        "lang", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase"), "n")
    most = inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    return candidates.join(most, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < p.inside * F.col("a"))).drop("most")


def collocations(docs: DataFrame, top: int = 2000, text_col: str = "text", lang_col: str = "lang",
                 p: CollocationParams = CollocationParams()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations by score,
    occurrences and phrase; ``n``: all words of the language."""
    phrases = frequent_phrases(docs, text_col, lang_col, p)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = not_inside(scored(phrases, p), phrases, p).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    words = phrases.filter("size = 0").select("lang", "n")
    return first.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

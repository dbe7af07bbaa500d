"""Repeated runs of words by suffix trees of prefix groups.

A window of ``length`` words (35) that starts in two places of the corpus is repeated, and every
word it covers is removed.  A suffix here starts at a window; windows are equal if their suffixes
share a path of ``length`` words in the suffix tree, that is an internal node at least so deep.

1. Prefixes.  Of the runs of ``gram`` words in a window the one with the smallest hash is its
   anchor; equal windows have theirs in the same place.  A suffix's prefix reaches from its first
   word to the end of its anchor, so prefixes have different lengths (``gram`` to ``length``
   words), and the neighbouring suffixes of one anchor are kept as one narrow row (a phrase: the
   anchor's hash, the hash of all words that its windows cover, the place).
2. Groups.  An anchor that occurs once makes only leaves: its suffixes are dropped after one
   count.  A phrase that occurs twice makes all its windows repeated, however many copies there
   are.  What is left are the phrases that occur once and share their anchor with other phrases.
3. Subtrees.  The different phrases of an anchor form a group that fits into memory: at most
   ``group`` phrases.  A task sorts its groups' suffixes (ranks of 1, 2, 4, ... words), takes the
   common prefix of neighbours, and so has the groups' suffix trees; a suffix below an internal
   node of depth d >= ``length`` starts a repeat of d words.  An anchor with more phrases gets the
   longest prefixes, all ``length`` words: its groups are the deep nodes themselves, which are
   only counted, so no task holds a frequent anchor's phrases.
4. The repeats are gathered per text, joined to maximal runs, and each text is cut once.

Words are the runs of bytes other than 20 and 09-0D (hex), unchanged, and are compared by 64-bit
hashes.  Texts are told apart by 79 bits of hash of id and text.  A null text has no words; null
and repeated ids keep their rows, and the words of repeated rows count as occurrences.  A text of
any length is parsed in pieces of ``piece`` words.  An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.common import byte_values, discard, mixed, tune, window_hashes, word_hashes, written
from corpusgauge.llm.repeats import POWERS, constants, packed, rows_batch, signed, sliding_min, struct_lists, unpacked


@dataclass(frozen=True)
class SubstringParams:
    length: int = 35        # words of a repeated window
    gram: int = 6           # words of an anchor
    group: int = 1000       # phrases of an anchor whose subtree is built in memory
    piece: int = 1 << 20    # words parsed at a time
    batch: int = 2000       # phrases whose subtrees are built at a time (and the last group's)
    salt: int = 32          # tasks that share the windows equal to a frequent one

    def __post_init__(self):
        if not 0 < self.gram <= self.length or self.length - self.gram >= 256:
            raise ValueError("a phrase's windows are numbered in one byte")
        if self.piece + self.length >= 1 << 24:
            raise ValueError("a piece's words are numbered in 24 bits")


PLACE = np.uint64(24)   # bits of a position in a piece; the rest of the word orders the hashes


def phrases(hashes: np.ndarray, owner: np.ndarray, p: SubstringParams):
    """Phrases of the words ``hashes`` of the texts ``owner``: (first window, last, anchor, hash of
    the anchor, hash of all words), as arrays."""
    n = len(hashes) - p.length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    grams = window_hashes(hashes, p.gram)
    places = np.arange(len(grams), dtype=np.uint64)
    low = sliding_min((grams >> PLACE << PLACE) | places, p.length - p.gram + 1)
    anchor = (low & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    window = np.flatnonzero(owner[:n] == owner[p.length - 1:])
    of = anchor[window]
    # a new phrase where the anchor changes or a window is missing (the end of a text)
    new = np.flatnonzero((np.diff(of) != 0) | (np.diff(window) != 1)) + 1
    begin = np.concatenate([[0], new]) if len(window) else new[:0]
    end = np.concatenate([new, [len(window)]]) - 1 if len(window) else new[:0]
    lo, hi, x = window[begin], window[end], of[begin]
    _, _, power, inverse = POWERS.upto(len(hashes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:len(hashes)])])
    whole = mixed((total[hi + p.length] - total[lo]) * inverse[lo])
    return lo, hi, x, grams[x].view(np.int64), whole.view(np.int64)


def pieces(texts: list[list[bytes]], p: SubstringParams):
    """Runs of texts of about ``piece`` words: lists of (text number, first word, words).  A longer
    text comes in parts that overlap, so that each window lies in one."""
    held: list[tuple[int, int, list[bytes]]] = []
    size = 0
    for t, words in enumerate(texts):
        for start in range(0, max(len(words) - p.length + 1, 0), p.piece):
            part = words[start:start + p.piece + p.length - 1] if len(words) > p.piece else words
            if held and size + len(part) > p.piece:
                yield held
                held, size = [], 0
            held.append((t, start, part))
            size += len(part)
    if held:
        yield held


def parse(texts: DataFrame, p: SubstringParams) -> DataFrame:
    """``texts`` (th, mark, text) -> one row per phrase: th, ``key`` (hash of the anchor), ``whole``
    (hash of its words), ``at`` (its first window, and the last one and the anchor after that)."""
    tune(texts.sparkSession)
    names = ["th", "key", "whole", "at"]

    def run(batches):
        constants()
        for batch in batches:
            marks = batch.column(1).to_numpy()
            for held in pieces([(t or b"").split() for t in byte_values(batch.column(2))], p):
                sizes = [len(words) for _, _, words in held]
                owner = np.repeat(np.arange(len(held)), sizes)
                lo, hi, x, key, whole = phrases(word_hashes([w for _, _, words in held for w in words]), owner, p)
                of = owner[lo]
                row = np.array([t for t, _, _ in held])[of]
                # places in the piece -> places in the text
                first = np.array([s for _, s, _ in held]) - np.cumsum([0, *sizes[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(key), pa.array(whole),
                     pa.array(packed(marks[row], lo + first[of], hi - lo, x - lo))], names=names)

    return texts.select("th", "mark", "text").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def with_text(texts: DataFrame, rows: DataFrame, out: str) -> DataFrame:
    """``texts`` and the different ``r`` of ``rows`` (th, r) in each, as a list ``out``.

    Always a left join on the same key, so that Spark moves the texts once for all uses in a plan;
    a text's list is as long as the text at most, however often its row is repeated."""
    lists = rows.groupBy("th").agg(F.collect_set("r").alias(out)).select(F.col("th").alias("_th"), out)
    return texts.join(lists.hint("shuffle_hash"), F.col("th") == F.col("_th"), "left").select("id", "th", "mark", "text", out)


def phrase_words(texts: DataFrame, reps: DataFrame, p: SubstringParams) -> DataFrame:
    """The words of the phrases ``reps`` (th, key, at, n), each in a text that has it."""
    kinds = [pa.int64()] * 4 + [pa.binary()]
    names = ["th", "key", "at", "n", "words"]

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for th, mark, text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                             byte_values(batch.column(3)), struct_lists(batch.column(4), ["key", "at", "n"])):
                words = text.split() if found else []
                for key, at, n in found:
                    of, lo, hi, _ = unpacked(at)
                    if of == mark:
                        out.append((th, key, at, n, b" ".join(words[lo:hi + p.length])))
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = reps.select("th", F.struct("key", "at", "n").alias("r"))
    return with_text(texts, rows, "reps").mapInArrow(run, "th bigint, key bigint, at bigint, n bigint, words binary")


def ranks(first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the runs of 1, 2, 4, ... words from every place, by doubling.  ``first``: a number
    for each word, ``end``: the place after its phrase; shorter runs end there."""
    places = np.arange(len(first))
    out = [np.unique(first, return_inverse=True)[1].astype(np.int64) + 1]
    longest = int((end - places).max(initial=1))
    step = 1
    while step < longest:
        after = places + step
        second = np.where(after < end, out[-1][np.minimum(after, len(first) - 1)], 0)
        out.append(np.unique(out[-1] * (len(first) + 1) + second, return_inverse=True)[1].astype(np.int64) + 1)
        step *= 2
    return out


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that the suffixes at the places ``a`` and ``b`` have in common."""
    out = np.zeros(len(a), np.int64)
    top = len(end) - 1
    for level in range(len(levels) - 1, -1, -1):
        i, j, step = a + out, b + out, 1 << level
        inside = (i + step <= end[a]) & (j + step <= end[b])
        out += step * (inside & (levels[level][np.minimum(i, top)] == levels[level][np.minimum(j, top)]))
    return out


def deep_suffixes(keys: np.ndarray, ats: np.ndarray, phrases_: list[list[bytes]], p: SubstringParams):
    """The suffix trees of whole groups of phrases: (phrase number, first word of the suffix in it,
    depth) of the suffixes below an internal node of ``length`` words or more."""
    sizes = np.array([len(w) for w in phrases_], np.int64)
    stop = np.cumsum(sizes)
    start = stop - sizes
    words = word_hashes([w for phrase in phrases_ for w in phrase])
    levels = ranks(words, np.repeat(stop, sizes))
    windows = sizes - p.length + 1
    of = np.repeat(np.arange(len(sizes)), windows)
    number = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = start[of] + number
    # a prefix ends with its anchor, so suffixes of one length before it make a subtree
    before = (ats[of] & 255) - number
    order = np.lexsort((levels[-1][place], before, keys[of]))
    a, b = order[:-1], order[1:]
    near = (keys[of[a]] == keys[of[b]]) & (before[a] == before[b])
    depth = np.where(near, common_prefix(levels, place[a], place[b], np.repeat(stop, sizes)), 0)
    depth[depth < p.length] = 0
    below = np.zeros(len(of) + 1, np.int64)[:len(of)]
    np.maximum.at(below, a, depth)
    np.maximum.at(below, b, depth)
    hit = np.flatnonzero(below)
    return of[hit], number[hit], below[hit]


def subtree_repeats(rows: DataFrame, p: SubstringParams) -> DataFrame:
    """(th, r) of the repeated suffixes of phrases that occur once; ``rows``: :func:`phrase_words`
    of groups that fit into memory."""
    def found(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        th, key, at, n = (t.column(c).to_numpy() for c in range(4))
        of, number, depth = deep_suffixes(key, at, [w.split() for w in t.column(4).to_pylist()], p)
        once = n[of] == 1
        of, number, depth = of[once], number[once], depth[once]
        # the windows that a node covers, counted from the phrase's first
        place = at[of] >> 16 << 16
        return pa.RecordBatch.from_arrays([pa.array(th[of]), pa.array(place | number << 8 | (number + depth - p.length))],
                                          names=["th", "r"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < p.batch:
                continue
            # whole groups only: the last group's rows wait
            keys = np.concatenate([b.column(1).to_numpy() for b in held])
            cut = int(np.flatnonzero(keys == keys[-1])[0])
            if cut:
                t = pa.Table.from_batches(held)
                yield found(t.slice(0, cut).to_batches())
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
        if n:
            yield found(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "th bigint, r bigint")


def long_prefix_repeats(rows: DataFrame, p: SubstringParams) -> DataFrame:
    """(th, r) of the repeated windows of phrases that occur once, for anchors with too many
    phrases: the prefix is the whole window, and a group of two is a deep node."""
    names = ["key", "window", "th", "n", "r"]

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for th, key, at, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split()
                for i in range(len(words) - p.length + 1):
                    window = signed(xxhash.xxh3_64_intdigest(b" ".join(words[i:i + p.length])))
                    out.append((key, window, th, n, at >> 16 << 16 | i << 8 | i))
            yield rows_batch(out, names)

    windows = rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    twice = windows.groupBy("key", "window").agg(F.sum("n").alias("total")).filter("total > 1").select(
        "key", "window", F.explode(F.sequence(F.lit(0), F.lit(p.salt - 1))).alias("salt"))
    mine = windows.filter("n = 1").withColumn("salt", F.pmod(F.xxhash64("th", "r"), F.lit(p.salt)).cast("int"))
    return mine.join(twice, ["key", "window", "salt"]).select("th", "r")


def cut(texts: DataFrame, spans: DataFrame, p: SubstringParams) -> DataFrame:
    """id, n_words, n_removed, starts and ends (maximal removed runs of words), kept (the other
    words, joined by one space)."""
    runs = T.ArrayType(T.IntegerType())
    names = ["id", "n_words", "n_removed", "starts", "ends", "kept"]
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType)] + [
        T.StructField(n, k) for n, k in zip(names[1:], (T.LongType(), T.LongType(), runs, runs, T.BinaryType()))])

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            flat, ends = batch.column(4).values.to_numpy(zero_copy_only=False), batch.column(4).offsets.to_pylist()
            for i, (mark, text) in enumerate(zip(batch.column(2).to_pylist(), byte_values(batch.column(3)))):
                words = (text or b"").split()
                of, _, first, last = unpacked(flat[ends[i]:ends[i + 1]])
                mine = of == mark
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, first[mine], 1)
                np.add.at(edge, last[mine] + p.length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                keep, at = [], 0
                for a, b in zip(turn[::2], turn[1::2]):
                    keep += words[at:a]
                    at = b
                for column, value in zip(out, (len(words), int(gone.sum()), turn[::2], turn[1::2], b" ".join(keep + words[at:]))):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return with_text(texts, spans, "spans").mapInArrow(run, schema)


def remove_repeated_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                          p: SubstringParams = SubstringParams()) -> DataFrame:
    """One row per document: id, n_words, n_removed, starts, ends, kept (see :func:`cut`)."""
    named = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    texts = docs.select(named[0].alias("id"), F.xxhash64(*named, named[0].isNull()).alias("th"),
                        F.shiftright(F.hash(*named), 17).cast("bigint").alias("mark"), named[1].alias("text"))
    parsed = written(parse(texts, p), "anchors")
    # written before they are joined: both sides of a join are then shuffles, which Spark can split
    # where an anchor is frequent
    shared = written(parsed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared-anchors")
    # dealt by text again: the rows of a frequent phrase lie in many files, and the next join can split them
    found = written(parsed.join(shared, "key").repartition("th"), "phrases")
    discard(parsed)
    different = written(found.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("th", "at")).alias("one"))
                        .select("key", "whole", "n", "one.th", "one.at"), "different-phrases")
    copies = written(different.filter("n > 1").select("key", "whole"), "copied-phrases")
    last = F.shiftright("at", 8).bitwiseAND(255)
    copied = found.join(copies, ["key", "whole"]).select(
        "th", F.shiftleft(F.shiftright("at", 16), 16).bitwiseOR(last).alias("r"))
    groups = written(different.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"))
                     .filter("size > 1 and least = 1").select("key", "size"), "prefix-groups")
    reps = different.join(groups, "key")
    small, large = F.col("size") <= p.group, F.col("size") > p.group
    columns = ["th", "key", "at", "n"]
    spans = copied.union(subtree_repeats(phrase_words(texts, reps.filter(small).select(columns), p), p)).union(
        long_prefix_repeats(phrase_words(texts, reps.filter(large).select(columns), p), p))
    return cut(texts, spans, p)

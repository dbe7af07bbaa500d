"""Benchmark decontamination by a distributed positional inverted index.

1. :func:`build_index` reads every whole text once.  The documents of a shard (consecutive
   rows of one partition, about ``shard_bytes`` of text) are laid out one after another, one
   empty position between two; a shard is one row: its documents with their first positions
   and word counts, its terms, and for each term the sorted list of its positions.  Only terms
   of the test items are kept where ``terms`` is given: no other can match.  The index is
   written as a table and is never shuffled; a hot source or a common word only makes more
   shards or longer lists.
2. :func:`phrase_hits` takes each window of the test items against each shard: the lists of
   its terms, shifted by their places in the window, are intersected starting from the rarest
   term, so common words are only looked up where the rare ones already agree.  What is left
   are the starts of exact matches.  :func:`near_hits` finds places where all terms of an item
   lie near an occurrence of its rarest.

Test items are taken in blocks of at most ``block_chars`` characters, so what is sent to the
tasks is bounded however many items there are.

A null or empty text has no words; a null or wordless item matches nothing, an item with fewer
words than the window is one shorter window, items with a null id are left out.  Repeated rows
are judged one by one.  Empty tables give no rows (documents) or no hits (items).
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.common import byte_values, free_name, tune, written

# A-Z in lower case; what is no digit, letter or non-ASCII character separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                for b in range(256))


@dataclass(frozen=True)
class DecontamParams:
    window: int = 10
    shard_bytes: int = 8 << 20
    block_chars: int = 4_000_000


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


INDEX = [("first", "array<int>"), ("n_words", "array<int>"), ("terms", "array<binary>"), ("at", "array<int>"),
         ("positions", "array<int>")]


def build_index(docs: DataFrame, text_col: str, id_col: str, terms: list[bytes] | None = None,
                shard_bytes: int = 8 << 20) -> DataFrame:
    """One row per shard: a random number for it, ids and the columns of :data:`INDEX`; the
    positions of ``terms[i]`` are ``positions[at[i]:at[i + 1]]``.  To be written before use."""
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(kind))])
    for name, ddl in INDEX:
        schema.add(name, T.ArrayType(T.IntegerType() if ddl == "array<int>" else T.BinaryType()))
    fixed = {t: i for i, t in enumerate(terms)} if terms is not None else None

    def shard(ids, rows, vocab):
        size = np.array([len(r) for r in rows], np.int64)
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        stream = np.full(int((size + 1).sum()), -1, np.int32)
        for a, r in zip(first.tolist(), rows):
            stream[a:a + len(r)] = r
        where = np.flatnonzero(stream >= 0)
        found = stream[where]
        order = np.argsort(found, kind="stable")
        used, at = np.unique(found[order], return_index=True)
        names = list(vocab)
        return pa.RecordBatch.from_arrays(
            [pa.array([secrets.randbits(63)], pa.int64())] + [pa.array([x], pa.list_(y)) for x, y in (
                (ids, id_type[0]), (first, pa.int32()), (size, pa.int32()), ([names[i] for i in used], pa.binary()),
                (np.append(at, len(found)), pa.int32()), (where[order], pa.int32()))], names=schema.names)

    id_type: list = [None]

    def run(batches):
        ids, rows, size = [], [], 0
        vocab = fixed if fixed is not None else {}
        for batch in batches:
            id_type[0] = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                words = split_words(text)
                if fixed is None:
                    row = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words))
                else:
                    row = np.fromiter(map(vocab.get, words, repeat(-1)), np.int32, len(words))
                ids.append(key), rows.append(row)
                size += len(text or b"") + 64
                if size >= shard_bytes:
                    yield shard(ids, rows, vocab)
                    ids, rows, size = [], [], 0
                    vocab = fixed if fixed is not None else {}
        if ids:
            yield shard(ids, rows, vocab)

    return docs.select(F.col(f"`{id_col}`").alias("_0"), F.col(f"`{text_col}`").alias("_1")).mapInArrow(run, schema)


class Phrases:
    """The windows of a block of test items: distinct term sequences and the items they are in."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items = [i for i, _ in items]
        self.terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for n, (_, text) in enumerate(items):
            ids = [self.terms.setdefault(w, len(self.terms)) for w in split_words(text)]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                found.setdefault(tuple(ids[i:i + window]), set()).add(n)
        self.windows = [(np.array(w, np.int64), np.array(sorted(of), np.int64)) for w, of in found.items()]


def shards(batches, terms: dict[bytes, int]):
    """(its number, ids, posting lists) of each row of an index."""
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        ends = {name: c.offsets.to_pylist() for name, c in columns.items() if name != "shard"}
        flat = {name: columns[name].values.to_numpy(zero_copy_only=False) for name in ("first", "n_words", "at", "positions")}
        for i in range(batch.num_rows):
            row = {name: x[ends[name][i]:ends[name][i + 1]] for name, x in flat.items()}
            row["terms"] = columns["terms"].values[ends["terms"][i]:ends["terms"][i + 1]].to_pylist()
            ids = columns["ids"].values[ends["ids"][i]:ends["ids"][i + 1]]
            yield columns["shard"][i].as_py(), ids, Shard(row, terms)


class Shard:
    """The posting lists of one row of the index, by the block's term numbers."""

    def __init__(self, row: dict, terms: dict[bytes, int]):
        self.at, self.positions = np.asarray(row["at"], np.int64), np.asarray(row["positions"], np.int64)
        self.local = np.full(len(terms), -1, np.int64)
        for i, term in enumerate(row["terms"]):
            if (n := terms.get(term)) is not None:
                self.local[n] = i
        # a list's length by term; none for a term that the shard does not hold
        self.size = np.where(self.local >= 0, np.diff(self.at)[self.local] if len(self.at) > 1 else 0, 0)
        self.first, self.n_words = np.asarray(row["first"], np.int64), np.asarray(row["n_words"], np.int64)

    def list_of(self, term: int) -> np.ndarray:
        i = self.local[term]
        return self.positions[self.at[i]:self.at[i + 1]]

    def starts(self, window: np.ndarray) -> np.ndarray:
        """Where the window occurs: shifted lists intersected from the rarest term on."""
        order = np.argsort(self.size[window], kind="stable")
        if not self.size[window[order[0]]]:
            return self.positions[:0]
        starts = self.list_of(window[order[0]]) - order[0]
        for k in order[1:]:
            lists = self.list_of(window[k])
            i = np.searchsorted(lists, starts + k)
            i[i == len(lists)] = 0
            starts = starts[lists[i] == starts + k]
            if not len(starts):
                break
        return starts

    def near(self, terms: np.ndarray, reach: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most ``reach`` words away in
        the same document."""
        order = terms[np.argsort(self.size[terms], kind="stable")]
        if not self.size[order[0]]:
            return self.positions[:0]
        here = self.list_of(order[0])
        for term in order[1:]:
            lists, doc = self.list_of(term), np.searchsorted(self.first, here, side="right") - 1
            low = np.maximum(here - reach, self.first[doc])
            high = np.minimum(here + reach, self.first[doc] + self.n_words[doc] - 1)
            here = here[np.searchsorted(lists, low) < np.searchsorted(lists, high, side="right")]
            if not len(here):
                break
        return here


def phrase_hits(index: DataFrame, phrases: Phrases) -> DataFrame:
    """One row per document: its shard and place there, id, n_words, items (those with a window
    in it, sorted as strings), starts and ends (the maximal runs of hit words)."""
    windows, terms, names = phrases.windows, phrases.terms, phrases.items
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("place", T.LongType()),
                           T.StructField("id", index.schema["ids"].dataType.elementType),
                           T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
                           T.StructField("starts", T.ArrayType(T.IntegerType())),
                           T.StructField("ends", T.ArrayType(T.IntegerType()))])
    rows = max((len(w) for w, _ in windows), default=1)
    # all windows as one matrix (short ones padded with their own first term), to see at once
    # which have all their terms in a shard
    grid = np.array([np.concatenate([w, np.full(rows - len(w), w[0])]) for w, _ in windows], np.int64).reshape(-1, rows)

    def run(batches):
        for number, ids, shard in shards(batches, terms):
            n = len(shard.first)
            edge = np.zeros(int(shard.first[-1] + shard.n_words[-1]) + 2, np.int64)
            pairs = []
            for w in np.flatnonzero((shard.size[grid] > 0).all(axis=1)) if len(windows) else ():
                window, of = windows[w]
                starts = shard.starts(window)
                if len(starts):
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + len(window), -1)
                    doc = np.unique(np.searchsorted(shard.first, starts, side="right") - 1)
                    pairs.append(np.stack([np.repeat(doc, len(of)), np.tile(of, len(doc))]))
            hit = np.cumsum(edge) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            begins, ends = turn[::2], turn[1::2]
            owner = np.searchsorted(shard.first, begins, side="right") - 1
            cut = np.searchsorted(owner, np.arange(n + 1))
            found: dict[int, set[str]] = {}
            for doc, item in np.concatenate(pairs, axis=1).T.tolist() if pairs else ():
                found.setdefault(doc, set()).add(names[item])
            begins, ends = begins - shard.first[owner], ends - shard.first[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), pa.array(np.arange(n)), ids, pa.array(shard.n_words, pa.int64()),
                 pa.array([sorted(found.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                 pa.array([begins[cut[i]:cut[i + 1]] for i in range(n)], pa.list_(pa.int32())),
                 pa.array([ends[cut[i]:cut[i + 1]] for i in range(n)], pa.list_(pa.int32()))], names=schema.names)

    return index.mapInArrow(run, schema)


def near_hits(index: DataFrame, phrases: Phrases, reach: int) -> DataFrame:
    """Proximity matches (id, item, position): places where the rarest term of an item stands
    and every other term of it within ``reach`` words, in any order."""
    of: dict[str, set[int]] = {}
    for window, items in phrases.windows:
        for n in items.tolist():
            of.setdefault(phrases.items[n], set()).update(window.tolist())
    terms, wanted = phrases.terms, {k: np.array(sorted(v), np.int64) for k, v in of.items()}
    schema = T.StructType([T.StructField("id", index.schema["ids"].dataType.elementType),
                           T.StructField("item", T.StringType()), T.StructField("position", T.IntegerType())])

    def run(batches):
        for _, ids, shard in shards(batches, terms):
            out: tuple[list, list, list] = ([], [], [])
            for item, needed in wanted.items():
                here = shard.near(needed, reach)
                doc = np.searchsorted(shard.first, here, side="right") - 1
                out[0].extend(doc.tolist())
                out[1].extend([item] * len(here))
                out[2].extend((here - shard.first[doc]).tolist())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())],
                names=schema.names)

    return index.mapInArrow(run, schema)


def item_blocks(items: DataFrame, text_col: str, id_col: str, p: DecontamParams) -> list[DataFrame]:
    """The items (id as a string, text) in blocks of about ``block_chars`` characters."""
    named = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text"))
    named = named.filter("item is not null and text is not null")
    chars = named.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = 1 + chars // p.block_chars
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [named if n == 1 else named.filter(part == i) for i in range(n)]


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  item_text_col: str = "text", item_id_col: str = "item_id",
                  p: DecontamParams = DecontamParams()) -> DataFrame:
    """One row per document: id, n_words, items, starts, ends (see :func:`phrase_hits`)."""
    blocks = item_blocks(items, item_text_col, item_id_col, p)
    index, found = None, None
    for block in blocks:
        phrases = Phrases([(r.item, r.text.encode("utf-8")) for r in block.collect()], p.window)
        if index is None:  # several blocks share one index of all terms
            terms = list(phrases.terms) if len(blocks) == 1 else None
            index = written(build_index(docs, text_col, id_col, terms, p.shard_bytes), "postings")
        hits = phrase_hits(index, phrases)
        found = hits if found is None else found.union(hits)
    if len(blocks) > 1:
        found = merge_blocks(found)
    return found.drop("shard", "place")


def merge_blocks(found: DataFrame) -> DataFrame:
    """One row per document from one per document and block of items; runs that touch are joined."""
    every = found.groupBy("shard", "place").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("runs"))
    none = F.expr("cast(array() as array<struct<starts:int,ends:int>>)")
    end = lambda acc: F.element_at(acc, -1)
    runs = F.aggregate("runs", none, lambda acc, x: F.when(
        F.coalesce(F.try_element_at(acc, F.lit(-1))["ends"] >= x["starts"], F.lit(False)),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            end(acc)["starts"].alias("starts"), F.greatest(end(acc)["ends"], x["ends"]).alias("ends")))))
        .otherwise(F.concat(acc, F.array(x))))
    return every.withColumn("runs", runs).select("shard", "place", "id", "n_words", "items",
                                                 F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"))


def n_hit():
    """Hit words of a row of :func:`contamination`."""
    return F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text",
                      p: DecontamParams = DecontamParams()) -> DataFrame:
    """The rows of ``docs`` without a hit.  Rows are told apart by their text alone, on which
    the verdict depends, so null and repeated ids need no care."""
    key = free_name(docs, "_text")
    keyed = docs.withColumn(key, F.sha2(F.col(f"`{text_col}`"), 256))
    named = keyed.select(F.col(key).alias("key"), F.col(f"`{text_col}`").alias("text"))
    hits = contamination(named, items, id_col="key", p=p)
    gone = written(hits.filter(F.size("items") > 0).select(F.col("id").alias("gone")).distinct(), "contaminated")
    return keyed.join(gone, F.col(key) == F.col("gone"), "left_anti").drop(key)

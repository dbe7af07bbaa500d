"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding.  The merges (a rank for every token) are compiled into a transducer that reads one
byte at a time.  A token sequence is the encoding of its bytes exactly if every adjacent pair
is the encoding of the pair's bytes (a known property of BPE), so the last token at a position
is the one token that ends there and fits after the last token where it starts.  A later token
can only reach back over the longest suffix that is the beginning of some token: that live
suffix is the state, and the last tokens of the positions in it are registers.  A boundary on
which the ways back from all live positions agree is final, and the tokens before it are
emitted: the lookahead is bounded by the longest token.  States and moves are made when first
met (lazy determinisation); there are at most as many as beginnings of tokens, and they are
dropped all together when they exceed a bound.

Decoding.  Tokens are read one at a time; a UTF-8 state machine carries an unfinished character
from one token to the next.  Its transitions are by whole tokens and are made when first met as
well.  Malformed bytes become U+FFFD, as in a decoder that replaces errors; the bytes
themselves are always returned unchanged.

Null texts have no tokens (an empty list), and a null list of ids decodes to no bytes.  Empty
tables give no rows, repeated rows are encoded one by one, other columns are carried along.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.common import MIX, free_name, tune

# Bounds of what a worker keeps; at the bound the cache is emptied, results do not change.
MAX_MOVES = 200_000
MAX_PIECES = 200_000
MAX_PAIRS = 100_000

# Slots of the table of pairs, and the most tokens that may end in one place.
PAIR_BITS = 20
PAIR_SLOTS = 1 << PAIR_BITS
MAX_ENDS = 24
# Pieces up to this many bytes go through the transducer together (so many at a time), longer ones alone.
SHORT = 48
TOGETHER = 8192
# Texts whose pieces are held at a time.
TEXTS = 100

BYTES = [bytes((i,)) for i in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_pair(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition, for short inputs: merge the leftmost pair of lowest rank until none is left."""
    parts = [BYTES[x] for x in data]
    none = len(ranks)
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return parts


class Transducer:
    """Byte-at-a-time encoder of one piece of text.

    A state is a live suffix; a move gives the next state, how far the live suffix's start
    advances, and the tokens that may end at the new position.  The registers are the last
    tokens of the live positions (and, until they are emitted, of those before)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lookahead = 4 * max(map(len, ranks))
        self.begins = {token[:i] for token in ranks for i in range(1, len(token))}
        self.fits: dict[int, bool] = {}
        self.length = np.zeros(max(self.tokens) + 1, np.int32)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.seen_pair = np.full(PAIR_SLOTS, -1, np.int64)
        self.seen_fits = np.zeros(PAIR_SLOTS, bool)
        self.clear()

    def clear(self) -> None:
        self.states: list[bytes] = [b""]
        self.names: dict[bytes, int] = {b"": 0}
        self.moves: dict[int, tuple[int, int, tuple]] = {}  # by state * 256 + byte; those met one byte at a time
        # all moves as arrays, for many pieces at a time: row of a move by state * 256 + byte
        self.made = 0
        self.row = np.full(256 * 256, -1, np.int32)
        self.table = np.full((1024, 2 + 2 * MAX_ENDS), -1, np.int32)  # next, cut, starts, tokens

    def pair(self, left: int, right: int) -> bool:
        """Is (left, right) the encoding of its own bytes?  Nothing (-1) goes before any token."""
        if len(self.fits) > MAX_PAIRS:
            self.fits.clear()
        if left < 0:
            ok = True
        else:
            a, b = self.tokens[left], self.tokens[right]
            ok = merge_pair(a + b, self.ranks) == [a, b]
        self.fits[left << 32 | right] = ok
        return ok

    def step(self, state: int, byte: int) -> tuple[int, int, tuple]:
        """A move as a tuple, from the arrays if it is there."""
        at = self.row[state << 8 | byte]
        if at < 0:
            self.move(state, byte)
            at = self.row[state << 8 | byte]
        n, cut, *ends = self.table[at].tolist()
        found = self.moves[state << 8 | byte] = (n, cut, tuple((k, t) for k, t in zip(ends[::2], ends[1::2]) if t >= 0))
        return found

    def move(self, state: int, byte: int) -> None:
        grown = self.states[state] + BYTES[byte]
        cut = next(k for k in range(len(grown) + 1) if k == len(grown) or grown[k:] in self.begins)
        ends = tuple((k, self.ranks[grown[k:]]) for k in range(len(grown)) if grown[k:] in self.ranks
                     and len(merge_pair(grown[k:], self.ranks)) == 1)
        if not ends:
            raise ValueError("the vocabulary does not hold every byte")
        live = grown[cut:]
        if (n := self.names.get(live)) is None:
            n = self.names[live] = len(self.states)
            self.states.append(live)
        if len(self.row) < 256 * len(self.states):
            self.row = np.concatenate([self.row, np.full_like(self.row, -1)])
        if len(self.table) == self.made:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        if len(ends) > (self.table.shape[1] - 2) // 2:
            raise ValueError("more tokens end in one place than MAX_ENDS")
        at = self.row[state << 8 | byte] = self.made
        self.made += 1
        self.table[at, :2] = n, cut
        for i, (k, token) in enumerate(ends):
            self.table[at, 2 + 2 * i:4 + 2 * i] = k, token

    def back(self, last: list[int], end: int) -> list[int]:
        """The tokens up to the position ``end``, last first."""
        out = []
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out

    def emit(self, last: list[int], base: int, out: list[int]) -> tuple[list[int], int]:
        """Emit what all live positions share; the rest of the registers."""
        common: set[int] | None = None
        for end in range(base, len(last)):
            ways = {end}
            while end:
                end -= len(self.tokens[last[end]])
                ways.add(end)
            common = ways if common is None else common & ways
        final = max(common)
        out.extend(reversed(self.back(last, final)))
        return last[final:], base - final

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`pair` of many, through a table of one pair a slot."""
        key = left.astype(np.int64) << 32 | right
        slot = ((key.view(np.uint64) * MIX) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        ok = self.seen_fits[slot]
        other = np.flatnonzero(self.seen_pair[slot] != key)
        if len(other):
            for i in other.tolist():
                fit = self.fits.get(int(key[i]))
                ok[i] = self.pair(int(left[i]), int(right[i])) if fit is None else fit
            self.seen_pair[slot[other]] = key[other]
            self.seen_fits[slot[other]] = ok[other]
            # two of these may share a slot: the last key written must go with its own answer
            last = np.flatnonzero(self.seen_pair[slot[other]] == key[other])
            self.seen_fits[slot[other[last]]] = ok[other[last]]
        return ok

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and where each begins (and the last ends).
        All pieces take their next byte together: one move of the transducer for each."""
        if self.made > MAX_MOVES:
            self.clear()
        if not any(pieces):
            return np.empty(0, np.int32), np.zeros(len(pieces) + 1, np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        width = int(size[0])
        data = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in order]), np.uint8).reshape(-1, width)
        last = np.full((len(pieces), width + 1), -1, np.int32)
        state, base = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for j in range(width):
            m = int(np.searchsorted(-size, -j, side="left"))  # pieces longer than j bytes
            key = state[:m] << 8 | data[:m, j]
            row = self.row[key]
            if (row < 0).any():
                for x in np.unique(key[row < 0]).tolist():
                    self.move(x >> 8, x & 255)
                row = self.row[key]
            move = self.table[row]
            todo = np.arange(m)
            for i in range(2, move.shape[1], 2):
                token = move[todo, i + 1]
                ok = self.pairs(last[todo, base[todo] + move[todo, i]], token)
                last[todo[ok], j + 1] = token[ok]
                todo = todo[~ok]
                if not len(todo):
                    break
            state[:m] = move[:, 0]
            base[:m] += move[:, 1]
        # the ways back from all ends, one token of each at a time
        steps, end, alive = [], size.copy(), np.flatnonzero(size > 0)
        count = np.zeros(len(pieces), np.int64)
        while len(alive):
            token = last[alive, end[alive]]
            steps.append((alive, token))
            count[alive] += 1
            end[alive] -= self.length[token]
            alive = alive[end[alive] > 0]
        begins = np.zeros(len(pieces) + 1, np.int64)
        back = np.empty(len(pieces), np.int64)
        back[order] = count
        np.cumsum(back, out=begins[1:])
        flat = np.empty(int(begins[-1]), np.int32)
        for i, (alive, token) in enumerate(steps):
            flat[begins[order[alive]] + count[alive] - 1 - i] = token
        return flat, begins

    def encode(self, data: bytes) -> list[int]:
        if self.made > MAX_MOVES:
            self.clear()
        out: list[int] = []
        known, fits = self.moves.get, self.fits.get
        state, base, last, full = 0, 0, [-1], self.lookahead
        for byte in data:
            state, cut, ends = known(state << 8 | byte) or self.step(state, byte)
            for k, token in ends:
                left = last[base + k]
                ok = fits(left << 32 | token)
                if ok or ok is None and self.pair(left, token):
                    break
            last.append(token)
            base += cut
            if len(last) > full:
                last, base = self.emit(last, base, out)
                full = len(last) + self.lookahead
        out.extend(reversed(self.back(last, len(last) - 1)))
        return out


class Encoder:
    """Texts to ids: the pattern's matches, each through the transducer (remembered per piece)."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.transducer = Transducer(self.ranks)
        self.pieces: dict[str, bytes] = {}  # the ids as 32-bit numbers

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of new pieces."""
        short: list[str] = []
        for piece in pieces:
            data = piece.encode("utf-8")
            if data in self.ranks:  # a piece that is itself a token is that token, by definition
                self.pieces[piece] = array("i", [self.ranks[data]]).tobytes()
            elif len(data) <= SHORT:
                short.append(piece)
            else:
                self.pieces[piece] = array("i", self.transducer.encode(data)).tobytes()
        short.sort(key=len)
        for at in range(0, len(short), TOGETHER):
            some = short[at:at + TOGETHER]
            flat, begins = self.transducer.encode_many([x.encode("utf-8") for x in some])
            ids, begins = flat.tobytes(), (4 * begins).tolist()
            for i, piece in enumerate(some):
                self.pieces[piece] = ids[begins[i]:begins[i + 1]]

    def __call__(self, texts: list[str | None]) -> tuple[array, list[int]]:
        """The ids of all texts one after another, and where each begins (and the last ends)."""
        flat, ends = array("i"), [0]
        for at in range(0, len(texts), TEXTS):
            found = [self.find(text or "") for text in texts[at:at + TEXTS]]
            new = {piece for pieces in found for piece in pieces if piece not in self.pieces}
            if len(self.pieces) + len(new) > MAX_PIECES:
                self.pieces.clear()
                new = {piece for pieces in found for piece in pieces}
            if new:
                self.learn(new)
            get = self.pieces.__getitem__
            for pieces in found:
                flat.frombytes(b"".join(map(get, pieces)))
                ends.append(len(flat))
        return flat, ends


def utf8_need(lead: int) -> int:
    """Continuation bytes after a lead byte; -1 for a byte that starts no character."""
    if lead < 0x80:
        return 0
    if 0xC2 <= lead <= 0xDF:
        return 1
    if 0xE0 <= lead <= 0xEF:
        return 2
    return 3 if 0xF0 <= lead <= 0xF4 else -1


class Decoder:
    """Ids to bytes and text, one token at a time.  The state of the UTF-8 machine is the
    unfinished character (at most three bytes)."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.moves: dict[bytes, dict[int, tuple[bytes, str]]] = {}

    def bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def move(self, state: bytes, token: int) -> tuple[bytes, str]:
        data = state + self.tokens[token]
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # an unfinished character at the end
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if utf8_need(byte) >= back:
                    # it may still be finished only if what is there is a valid beginning
                    tail = codecs.getincrementaldecoder("utf-8")("replace")
                    if tail.decode(data[-back:]) == "":
                        cut -= back
                break
        return data[cut:], data[:cut].decode("utf-8", "replace")

    def text(self, ids) -> str:
        out, state = [], b""
        for token in ids:
            row = self.moves.get(state)
            if row is None:
                row = self.moves[state] = {}
            step = row.get(token)
            if step is None:
                step = row[token] = self.move(state, token)
            state = step[0]
            out.append(step[1])
        if state:
            out.append(state.decode("utf-8", "replace"))
        return "".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def mapped(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)``.  Where ``df`` comes from here as well, both steps take a
    task's batches one after another in the same Python worker: no second worker holds memory
    beside the first, and the rows do not go through the JVM in between."""
    source, steps = df.__dict__.get("mapped", (df, ()))
    steps = (*steps, run)

    def chain(batches):
        for step in steps:
            batches = step(batches)
        return batches

    out = source.mapInArrow(chain, schema)
    out.mapped = source, steps
    return out


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None,
           out: str = "ids") -> DataFrame:
    """The columns ``carry`` (all but the text by default) and ``out``: the ids of the whole text."""
    tune(df.sparkSession)
    carry = [c for c in df.columns if c not in (text_col, out)] if carry is None else carry
    schema = T.StructType([df.schema[c] for c in carry] + [T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        make = encoder(path, pattern)
        for batch in batches:
            flat, ends = make(batch.column(0).to_pylist())
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], column], names=[*carry, out])

    source = df.select(F.col(f"`{text_col}`").alias("_0"),
                       *[F.col(f"`{c}`").alias(f"_{i + 1}") for i, c in enumerate(carry)])
    return mapped(source, run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded", as_text: bool = False) -> DataFrame:
    """``df`` and ``out``: the bytes (or the text) that the ids stand for."""
    tune(df.sparkSession)
    out = free_name(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType() if as_text else T.BinaryType())])
    at = df.columns.index(ids_col)

    def run(batches):
        make = decoder(path)
        for batch in batches:
            ids, read = batch.column(at), make.text if as_text else make.bytes
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
            column = [read(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            kind = pa.string() if as_text else pa.binary()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, kind)], names=schema.names)

    return mapped(df, run, schema)

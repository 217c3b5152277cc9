"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression.  Each code point gets a class from a table;
looking at the next one or two code points refines it (a blank before a word, an
apostrophe that begins a contraction).  A class is then a transition function over eight
states.  Functions compose associatively, so a text is cut into equal rows, every row is
scanned for all eight start states at once, the rows' functions are composed, and each
row's true start state selects its boundaries.  Slices between boundaries go through a
cache of merged pieces, which is bounded in bytes and emptied when a task ends.

Defined results: null text is the empty text (no ids); an empty table gives an empty
table; other columns of the input pass through; a column that clashes with an output
name is replaced.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.kernel import blocks, lean

LETTER, NUMBER, OTHER, SPACE_MID, BLANK_LAST, SPACE_LAST, SHORT, LONG, RESET = range(9)
#: States: in letters, in numbers, in others, in white space, after a joining blank, one or two code points of a contraction to come, fresh.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_BLANK, S_ONE, S_TWO, S_FRESH = range(8)
ROW = 2048
BLOCK_CHARS = 1 << 18
#: Bytes that each of the cache's two generations holds at most, and what an entry takes besides its text and ids.
CACHE_BYTES = 16 << 20
ENTRY_BYTES = 190


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and boundary[class, state]."""
    to = np.zeros((9, 8), np.uint8)
    cut = np.ones((9, 8), bool)
    for c, own in ((LETTER, S_LETTER), (NUMBER, S_NUMBER), (OTHER, S_OTHER)):
        to[c] = own
        cut[c, [own, S_BLANK]] = False
        to[c, S_TWO], to[c, S_ONE] = S_ONE, S_FRESH
        cut[c, [S_TWO, S_ONE]] = False
    for c, rest in ((SHORT, S_ONE), (LONG, S_TWO)):
        to[c] = rest
        to[c, [S_OTHER, S_BLANK]] = S_OTHER
        cut[c, [S_OTHER, S_BLANK]] = False
    to[SPACE_MID] = S_SPACE
    cut[SPACE_MID, S_SPACE] = False
    to[BLANK_LAST], to[SPACE_LAST], to[RESET] = S_BLANK, S_FRESH, S_FRESH
    return to, cut


NEXT, CUT = _transitions()
_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space (SPACE_MID) or other."""
    if not _classes:
        table = np.full(0x110000 + 1, OTHER, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = LETTER
            elif kind == "N":
                table[c] = NUMBER
        spaces = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        table[spaces] = SPACE_MID
        table[0x110000] = RESET
        _classes.append(table)
    return _classes[0]


def classes_of(points: np.ndarray) -> np.ndarray:
    """Refined classes; 0x110000 separates texts."""
    kinds = class_table()[points]
    n = len(points)
    if n < 2:
        return kinds
    follow = np.empty(n, np.uint8)
    follow[:-1], follow[-1] = kinds[1:], RESET
    last = (kinds == SPACE_MID) & (follow != SPACE_MID) & (follow != RESET)
    kinds[last] = np.where(points[last] == 32, BLANK_LAST, SPACE_LAST)
    for i in np.flatnonzero(points == 39).tolist():
        one = chr(points[i + 1]) if i + 1 < n and points[i + 1] < 128 else ""
        two = chr(points[i + 2]) if i + 2 < n and points[i + 2] < 128 else ""
        if one and one in "stmd":
            kinds[i] = SHORT
        elif one + two in ("re", "ve", "ll"):
            kinds[i] = LONG
    return kinds


def boundaries(points: np.ndarray) -> np.ndarray:
    """Positions at which a piece (or a separator) begins: a blockwise associative scan of transition functions."""
    kinds = classes_of(points)
    n = len(kinds)
    rows = max(1, -(-n // ROW))
    grid = np.full(rows * ROW, RESET, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, ROW).T)
    # What every row does to each of the eight start states.
    step = np.ascontiguousarray(NEXT.reshape(-1))
    state = np.broadcast_to(np.arange(8, dtype=np.uint8)[:, None], (8, rows))
    wide = grid.astype(np.uint8) << 3
    for c in range(ROW):
        state = step[wide[c] | state]
        if c % 32 == 31 and (state == state[0]).all():
            # All start states have met: from here one row of states stands for all eight.
            one = state[0]
            for d in range(c + 1, ROW):
                one = step[wide[d] | one]
            state = np.broadcast_to(one, (8, rows))
            break
    function = state.T
    start = np.empty(rows, np.uint8)
    now = S_FRESH
    for r in range(rows):
        start[r] = now
        now = function[r, now]
    cut = np.empty((ROW, rows), bool)
    mark = np.ascontiguousarray(CUT.reshape(-1))
    now = start
    for c in range(ROW):
        key = wide[c] | now
        cut[c] = mark[key]
        now = step[key]
    return np.flatnonzero(np.ascontiguousarray(cut.T).reshape(-1)[:n])


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Rank of the token that two adjacent tokens form, by open addressing over arrays."""

    EMPTY = np.uint64((1 << 64) - 1)
    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        find = ranks.get
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = find(token[:i]), find(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.bits = max(10, (4 * len(left) + 1).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY, np.uint64)
        self.rank = np.full(1 << self.bits, self.NONE, np.int64)
        key, value = self._key(np.array(left, np.int64), np.array(right, np.int64)), np.array(rank, np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == self.EMPTY
            self.keys[slot[free]] = key[free]
            won = self.keys[slot] == key
            self.rank[slot[won]] = value[won]
            key, value, slot = key[~won], value[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none."""
        key = self._key(a, b)
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.rank[slot], self.NONE)
        open_ = np.flatnonzero((there != key) & (there != self.EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (there != self.EMPTY)]
        return out


class Merger:
    """Pair merging by rank, for many pieces at once, with a two-generation cache of merged pieces."""

    def __init__(self, ranks: dict[bytes, int], most: int = CACHE_BYTES):
        self.ranks, self.most = ranks, most
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(ranks)
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one long piece by a heap and a linked list: n log n."""
        n, rank = len(piece), self.ranks.get
        end, left, right = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        alive = bytearray(b"\1") * n
        # Rank, first byte and end of a pair in one number.
        heap = [(r << 80) + (i << 40) + i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        low = (1 << 40) - 1
        while heap:
            pair = heapq.heappop(heap)
            i, stop = pair >> 40 & low, pair & low
            j = right[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            end[i], alive[j], right[i] = stop, 0, right[j]
            if (k := right[i]) < n:
                left[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r << 80) + (i << 40) + end[k])
            if (k := left[i]) >= 0 and (r := rank(piece[k:stop])) is not None:
                heapq.heappush(heap, (r << 80) + (k << 40) + stop)
        return b"".join(self.packed[piece[i : end[i]]] for i in range(n) if alive[i])

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pieces: in each round every unfinished piece joins its leftmost pair of lowest rank."""
        if not pieces:
            return []
        none = PairTable.NONE
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        rank = np.full(len(token), none, np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.pairs.find(token[inner], token[inner + 1])
        done_owner, done_token = [], []
        while len(token):
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.concatenate((heads, [len(token)])))
            if (over := least == none).any():
                out = np.repeat(over, sizes)
                done_owner.append(owner[out])
                done_token.append(token[out])
                token, owner, rank = token[~out], owner[~out], rank[~out]
                if not len(token):
                    break
                least, sizes = least[~over], sizes[~over]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))]
            token[at] = rank[at]
            stay = np.ones(len(token), bool)
            stay[at + 1] = False
            # Positions of the joined tokens after the second halves are gone.
            at = at - np.arange(len(at))
            token, owner, rank = token[stay], owner[stay], rank[stay]
            rank[at] = none
            for i in (at[(at + 1 < len(token))], at[at > 0] - 1):
                i = i[owner[i] == owner[np.minimum(i + 1, len(token) - 1)]]
                rank[i] = self.pairs.find(token[i], token[i + 1])
        owner, token = np.concatenate(done_owner), np.concatenate(done_token)
        order = np.argsort(owner, kind="stable")
        raw = token[order].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(owner, minlength=len(pieces))) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The cache, with all these pieces in it; what the last block did not use may go."""
        missing = [p for p in set(pieces) if p not in self.young]
        # A character of a piece counts twice: for itself and for its part of the ids.
        size = sum(map(len, missing)) * 2 + ENTRY_BYTES * len(missing)
        if self.held + size > self.most:
            self.old, self.young = self.young, {}
            missing = list(set(pieces))
            self.held, size = 0, sum(map(len, missing)) * 2 + ENTRY_BYTES * len(missing)
        self.held += size
        new, batch = [], []
        for p in missing:
            known = self.old.get(p)
            if known is not None:
                self.young[p] = known
            elif (raw := p.encode()) in self.packed:
                self.young[p] = self.packed[raw]
            elif len(raw) > 64:
                self.young[p] = self.merge_long(raw)
            else:
                new.append(p)
                batch.append(raw)
        self.young.update(zip(new, self.merge_many(batch), strict=True))
        return self.young


def encode_texts(texts: list[str], merger: Merger) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each text its ids (little-endian, 32 bits) and the code-point offset of every piece."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
            size += len(texts[end]) + 1
            end += 1
        group = texts[at:end]
        at = end
        lengths = np.fromiter(map(len, group), np.int64, len(group))
        stops = np.cumsum(lengths + 1) - 1
        whole = "\0".join(group) + "\0"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        points[stops] = 0x110000
        cuts = boundaries(points)
        # Every text ends at a separator, which is a boundary of its own and gives a piece that no text uses.
        last = np.searchsorted(cuts, stops)
        first = np.concatenate(([0], last[:-1] + 1))
        places = cuts.tolist()
        pieces = [whole[i:j] for i, j in zip(places, places[1:], strict=False)]
        ids = merger.learn(pieces).__getitem__
        for a, b, zero in zip(first.tolist(), last.tolist(), (stops - lengths).tolist(), strict=True):
            yield b"".join(map(ids, pieces[a:b])), cuts[a:b] - zero


_mergers: dict[str, Merger] = {}
_tokens: dict[str, list[bytes]] = {}


def merger_for(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(load_ranks(path))
    return _mergers[path]


def forget() -> None:
    """Empty this process's caches."""
    for merger in _mergers.values():
        merger.forget()


def tokens_for(path: str) -> list[bytes]:
    if path not in _tokens:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _tokens[path] = table
    return _tokens[path]


def _with(schema: T.StructType, *added: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(added))


def _keep(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(i) for i, f in enumerate(batch.schema) if f.name in names]


def _encoding(schema: T.StructType, vocabulary: str, column: str):
    """The schema with what encoding adds, and the function of batches that adds it."""
    schema = _with(schema, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("piece_starts", T.BinaryType()))
    kept = schema.names[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_for(vocabulary)
        try:
            for whole in batches:
                at = whole.schema.get_field_index(column)
                for a, b, _, _ in blocks(whole.column(at)):
                    batch = whole.slice(a, b - a)
                    ids, starts = [], []
                    for packed, own in encode_texts([t or "" for t in batch.column(at).to_pylist()], merger):
                        ids.append(packed)
                        starts.append(own.astype("<u4").tobytes())
                    columns = [*_keep(batch, kept), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(starts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        finally:
            merger.forget()

    return schema, run


def _decoding(schema: T.StructType, vocabulary: str, column: str):
    """The schema with what decoding adds, and the function of batches that adds it."""
    schema = _with(schema, T.StructField("decoded", T.BinaryType()))
    kept = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens_for(vocabulary)
        pick = table.__getitem__
        for whole in batches:
            at = whole.schema.get_field_index(column)
            for a, b, _, _ in blocks(whole.column(at)):
                batch = whole.slice(a, b - a)
                out = [b"".join(map(pick, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*_keep(batch, kept), pa.array(out, pa.binary())], names=schema.names)

    return schema, run


def encode(df: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """Add ``n_tokens`` (long), ``ids`` (binary: 32-bit little-endian ids) and ``piece_starts`` (binary: 32-bit code-point offset of every pre-token, for decoding spans) to df.

    ``vocabulary`` is the path of a rank file that every executor can open.
    """
    schema, run = _encoding(df.schema, vocabulary, column)
    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, vocabulary: str, column: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary: the bytes that the ids stand for); null ids give empty bytes, an id outside the vocabulary raises IndexError."""
    schema, run = _decoding(df.schema, vocabulary, column)
    return df.mapInArrow(lean(run), schema)


def round_trip(df: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """What ``encode`` and then ``decode`` of its ids add, by one Python worker a task: two would each stay alive for the stages that follow."""
    schema, encoded = _encoding(df.schema, vocabulary, column)
    schema, decoded = _decoding(schema, vocabulary, "ids")
    return df.mapInArrow(lean(lambda batches: decoded(encoded(batches))), schema)


def digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """The op1 row of every document: encode, decode, and digest both."""
    encoded = encode(df.select("doc_id", "text"), vocabulary).drop("text", "piece_starts")
    return decode(encoded, vocabulary).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

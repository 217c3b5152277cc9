"""Vectorised text kernels over Arrow string columns, and shared-folder helpers.

The kernels see a column as one byte buffer with document offsets.  Every function
works on whole texts; a block only bounds how many *documents* are handled at a time.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.plans.scratch import drop_table, materialize, new_folder

__all__ = ["blocks", "buffer_of", "crc_split", "drop_table", "fresh", "lean", "materialize", "mix", "new_folder", "shingle_sets", "span_hashes", "without_keys", "word_spans", "words"]

BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240501)
#: A random 64-bit value for each byte; A-Z share the value of a-z.
BYTE_HASH = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_HASH[65:91] = BYTE_HASH[97:123]
#: Bytes that separate words: tab, line feed, vertical tab, form feed, return, blank.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SHINGLE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes of an Arrow batch that goes to Python at most, and the setting that bounds them.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(run: Callable) -> Callable:
    """run (a function of Arrow batches) with bounded memory: batches of the session are cut at BATCH_BYTES, and when a task ends its freed memory goes back to the system, as Python workers stay alive."""
    session = SparkSession.getActiveSession()
    if session is not None and int(re.sub("[^0-9]", "", session.conf.get(_BATCH_SETTING))) > BATCH_BYTES:
        session.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def run_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run_lean


def fresh(df: DataFrame, n: int) -> list[str]:
    """n column names that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    names = (f"own_{uuid.uuid4().hex[:12]}" for _ in range(4 * n + 4))
    return [x for x in names if x not in taken][:n]


def without_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose id and text hash are not in keys (doc_id, text_hash); null ids meet, and docs may have any other columns."""
    a, b = fresh(docs, 2)
    keys = keys.withColumnsRenamed({"doc_id": a, "text_hash": b})
    return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(docs["text"]) == F.col(b)), "left_anti")


def crc_split(column: str = "doc_id") -> str:
    """SQL: true for the held-out fifth of the documents."""
    return f"coalesce(crc32(encode(cast({column} as string), 'UTF-8')) % 5 = 0, false)"


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about ``most`` bytes."""
    data, offsets = buffer_of(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; no word crosses documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~IS_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def powers(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """64-bit hash of each byte span: a prefix sum of weighted bytes, so no loop over spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and case-folded (A-Z) hashes of all words, and the first word of each document (one more entry than documents)."""
    starts, ends = word_spans(data, offsets)
    return starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document; one shingle where it has fewer words than ``width``; none without words."""
    _, _, hashes, first = words(data, offsets)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : n - width + 1 + k] * _SHINGLE[k] if n >= width else 0
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            yield mix(np.array([int((hashes[a:b] * _SHINGLE[8 : 8 + b - a]).sum(dtype=np.uint64)) ^ (b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


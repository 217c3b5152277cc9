"""Language identification by bit-sliced n-gram filters.

Every language has a set of byte 4-grams (A-Z folded, other ASCII signs as blanks): those
that make up at least ``LEAST_SHARE`` of its training n-grams and at least ``CONTRAST`` times
the share that they have in the language where they are most frequent.  The n-grams are
counted exactly in Spark over all training rows, in one pass; a language's set has at most
``1 / LEAST_SHARE`` members whatever the input.

The sets are held as Bloom filters laid side by side: ``ROWS`` tables of ``2 ** BITS`` words,
in which bit l of a word belongs to language l (64 languages to a table).  One look-up in each
table and an AND give all languages that contain an n-gram.  A text's bits are counted for each
language, corrected for that language's false-positive rate, and the largest count decides.

Defined results: ``und`` with score 0 for null texts and texts without a letter; if no
n-gram is known, the most frequent training language with score ``1 / languages``; of
equal counts the alphabetically first language; without training rows ``und``; repeated rows
train each time and get equal predictions; texts are read whole, however long; other columns
of documents, of any name, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.kernel import blocks, crc_split, drop_table, lean, materialize

BITS = 20
ROWS = 2
GRAM = 4
LEAST_SHARE = 2e-6
CONTRAST = 0.125
#: N-grams of training texts that a task holds before it counts them and hands the counts on.
COUNT_GRAMS = 4_000_000
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_fold = np.full(256, 32, np.uint8)
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)
_fold[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every n-gram with a letter as a number, the n-gram's document, and n-grams for each document."""
    n = len(data)
    folded = _fold[data].astype(np.uint32)
    if n < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    gram = folded[:-3] | folded[1:-2] << np.uint32(8) | folded[2:-1] << np.uint32(16) | folded[3:] << np.uint32(24)
    left = np.repeat(offsets[1:], np.diff(offsets))[: n - GRAM + 1] - np.arange(n - GRAM + 1)
    at = np.flatnonzero((left >= GRAM) & (gram != 0x20202020))
    owner = np.searchsorted(offsets, at, "right") - 1
    return gram[at], owner, np.bincount(owner, minlength=len(offsets) - 1)


def places(gram: np.ndarray, row: int) -> np.ndarray:
    """Cells of n-grams in one of the tables."""
    return ((gram.astype(np.uint64) * _MULTIPLIERS[row]) >> np.uint64(64 - BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, gram, n) of texts (text, lang): counts of n-grams, and of documents as gram -1."""
    codes: dict[str, int] = {}
    held: list[np.ndarray] = []
    docs: list[int] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        names = np.array(list(codes), object)
        key, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        size = 0
        for i in range(0, len(key), 100_000):
            part = key[i : i + 100_000]
            made = [pa.array(names[part >> np.uint64(32)], pa.string()), pa.array((part & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n[i : i + 100_000])]
            yield pa.RecordBatch.from_arrays(made, names=["lang", "gram", "n"])

    for batch in batches:
        langs = np.array([codes.setdefault(x, len(codes)) for x in batch.column(1).to_pylist()], np.int64)
        docs += [0] * (len(codes) - len(docs))
        for code, n in zip(*np.unique(langs, return_counts=True), strict=True):
            docs[code] += int(n)
        for a, b, data, offsets in blocks(batch.column(0)):
            gram, owner, _ = grams(data, offsets)
            held.append(langs[a:b][owner].astype(np.uint64) << np.uint64(32) | gram)
            size += len(gram)
            if size >= COUNT_GRAMS:
                yield from flush()
    if size:
        yield from flush()
    if codes:
        yield pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()), pa.array([-1] * len(codes), pa.int64()), pa.array(docs, pa.int64())], names=["lang", "gram", "n"])


class Filters:
    """The bit-sliced filters of all languages; words: slices of 64 languages x ROWS x cells."""

    def __init__(self, langs: list[str], docs: list[int], words: np.ndarray):
        self.langs, self.words = langs, words
        self.prior = int(np.argmax(docs)) if langs else 0
        self.false_rate = np.ones(len(langs))
        for i in range(len(langs)):
            held = (words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            self.false_rate[i] = float(np.prod(held.mean(axis=1)))

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (documents x languages) and n-grams of each document."""
        gram, _, sizes = grams(data, offsets)
        out = np.zeros((len(sizes), len(self.langs)))
        full = np.flatnonzero(sizes)
        if len(full):
            heads = np.concatenate(([0], np.cumsum(sizes)))[full]
            cells = [places(gram, k) for k in range(ROWS)]
            for s, words in enumerate(self.words):
                mask = words[0][cells[0]]
                for k in range(1, ROWS):
                    mask &= words[k][cells[k]]
                for i in range(64 * s, min(len(self.langs), 64 * s + 64)):
                    bit = ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
                    found = np.add.reduceat(bit, heads)
                    rate = min(self.false_rate[i], 0.99)
                    out[full, i] = np.maximum(0, (found - rate * sizes[full]) / (1 - rate))
        return out, sizes


def gram_sets(total: DataFrame) -> DataFrame:
    """(lang, gram) of every language's set, from counts (lang, gram, n)."""
    counted = total.where("gram >= 0")
    sums = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    shares = counted.join(F.broadcast(sums), "lang").select("lang", "gram", (F.col("n") / F.col("all")).alias("share")).where(f"share >= {LEAST_SHARE}")
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    return shares.join(best, "gram").where(f"share >= {CONTRAST} * best").select("lang", "gram")


def fit(docs: DataFrame) -> Filters:
    """Filters from every row of docs that isn't held out and has a language."""
    train = docs.where(f"lang is not null and text is not null and not {crc_split()}").select("text", "lang")
    counted = train.mapInArrow(lean(_count), "lang string, gram long, n long")
    total = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sizes = dict(sorted(tuple(r) for r in total.where("gram = -1").select("lang", "n").collect()))
    code = {x: i for i, x in enumerate(sizes)}

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([code[x] for x in batch.column(0).to_pylist()], np.int64)
            gram = batch.column(1).to_numpy().astype(np.uint64)
            for k in range(ROWS):
                cell = ((own >> 6) * ROWS + k << BITS) + places(gram, k)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array((np.uint64(1) << (own & 63).astype(np.uint64)).view(np.int64))], names=["cell", "bit"])

    got = gram_sets(total).mapInArrow(bits, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(-(-len(sizes) // 64) * ROWS << BITS, np.uint64)
    words[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    drop_table(total)
    return Filters(list(sizes), list(sizes.values()), words.reshape(-1, ROWS, 1 << BITS))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    lettered = docs.select("doc_id", "text", F.expr("coalesce(text rlike '\\\\p{L}', false)").alias("lettered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                found = np.array(batch.column(2).slice(a, b - a).to_pylist(), bool)
                best, score = np.full(b - a, -1), np.zeros(b - a)
                if filters.langs:
                    hits, _ = filters.hits(data, offsets)
                    total = hits.sum(axis=1)
                    best = np.where(total > 0, hits.argmax(axis=1), filters.prior)
                    score = np.where(total > 0, hits.max(axis=1) / np.maximum(total, 1e-12), 1 / len(filters.langs))
                names = [filters.langs[i] if ok and i >= 0 else "und" for i, ok in zip(best.tolist(), found.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(np.where(found, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return lettered.mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """The op7 row of every document."""
    return predict(docs, fit(docs)).select("doc_id", F.expr(crc_split()).alias("held_out"), "lang_pred", "score")

"""Toxicity by class-conditional Kneser-Ney models.

Two word models, one of toxic and one of ordinary labelled documents, give every word after its
context (the word before it) a probability.  Level by level:

* ``q_b(w)``: continuation counts of both classes (in how many different contexts a word
  occurs, so copies of a text add nothing), and one share for all unknown words;
* ``q_c(w)``: the class's continuation counts, backing off to ``q_b``;
* ``s_c(w|h)``: the bigram counts of both classes, backing off to ``q_c``, so an expression
  that is rare in both is smoothed by shared counts;
* ``p_c(w|h)``: the class's bigram counts, backing off to ``s_c``.

Counts are discounted by ``n1 / (n1 + 2 n2)`` of their level's counts of counts.  What a
context hands down follows from its own counts; where both classes have a weight the larger one
holds for both, so that the class of fewer texts isn't the more certain one, and a context that
a class has never seen is left to ``s_c`` in both.  Each level sums to 1 over all words and the
unknown one.

A word's evidence is ``log p_toxic - log p_ordinary`` less the log of the classes' sizes (their
numbers of different bigrams, so one long repetitive text doesn't move it), where that is
positive.  A document's feature is the mean of this over all its words: the part of the
length-normalised log-likelihood ratio by which words speak for toxicity.  The decision
threshold comes from a histogram of that feature over a fifth of the training documents (the
tuning fold), which is left out of the counts.

All counts are exact, cover every labelled training document and stay in tables of the shared
folder that grow with the input.  Evidence that fits ``TABLE_ROWS`` rows is looked up where
texts are read; more is joined by a shuffle of those bigrams that a bit table lets through.

Defined results: null, empty and wordless texts have the feature 0; documents of an unknown
label do not train; a document with several labels trains once for each; repeated rows of
documents train each time and get equal scores; other columns, of any name, pass through
``keep_clean``; without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.kernel import IS_SPACE, blocks, crc_split, drop_table, lean, materialize, mix, span_hashes, without_keys, word_spans

#: Evidence of at most this many bigrams and words (32 MB in each Python worker) is broadcast; more is joined.
TABLE_ROWS = 2_000_000
#: Bits of the bit table for each key, and its largest size as a power of two.
KEY_BITS, MOST_BITS = 32, 28
#: Words of training texts that a task counts before it hands the counts on.
COUNT_WORDS = 1_000_000
#: Labels of at most this many rows (48 MB) are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Keys and features of at most this many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Discounts stay below this, so that every seen context keeps some mass.
MOST_DISCOUNT = 0.95
#: Bins of the tuning histogram, over features from 0 to 1.
BINS = 1 << 14
#: The feature from which a document is toxic if no tuning document has one of the labels.
UNTUNED = 0.05

#: Letters (A-Z folded), digits and bytes over 127 carry a word; other bytes are skipped in its hash.
_table = np.zeros(256, np.uint64)
_rng = np.random.default_rng(7)
_table[:] = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_table[65:91] = _table[97:123]
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_fold = np.where(IS_WORD, np.arange(256), 32).astype(np.uint8)
assert IS_SPACE[32]


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (a run of letters, digits and bytes over 127; A-Z folded), and each document's first."""
    folded = _fold[data]
    starts, ends = word_spans(folded, offsets)
    return span_hashes(folded, starts, ends, _table), np.searchsorted(starts, offsets)


def _key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9FB21C651E98DF25) + word)


def _befores(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word; 0 at a document's start."""
    before = np.zeros(len(ids), np.uint64)
    before[1:] = ids[:-1]
    heads = first[:-1]
    before[heads[heads < len(ids)]] = 0
    return before


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (before, word, o, t) of texts (text, toxic): counts of bigrams in ordinary and toxic documents."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        before, word, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        pair = _key(before, word)
        order = np.argsort(pair)
        new = np.flatnonzero(np.concatenate(([True], pair[order[1:]] != pair[order[:-1]])))
        both = np.diff(np.append(new, len(order)))
        bad = np.add.reduceat(toxic[order], new)
        at = order[new]
        made = [before[at].view(np.int64), word[at].view(np.int64), (both - bad).astype(np.int32), bad.astype(np.int32)]
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in made], names=["before", "word", "o", "t"])

    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), np.int32)
        for a, b, data, offsets in blocks(batch.column(0)):
            ids, first = word_ids(data, offsets)
            if len(ids):
                held.append((_befores(ids, first), ids, np.repeat(labels[a:b], np.diff(first))))
            if sum(len(x[1]) for x in held) >= COUNT_WORDS:
                yield from flush()
    if held:
        yield from flush()


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, tuning) of the training documents that have a label; tuning: the fold that sets the threshold."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    fold = F.expr("floor(crc32(encode(cast(doc_id as string), 'UTF-8')) / 5) % 5 = 0").alias("tuning")
    return docs.select("doc_id", "text").where(f"not {crc_split()}").join(known, "doc_id").select("doc_id", "text", "toxic", fold)


def discount(n1: int | None, n2: int | None) -> float:
    """Kneser-Ney's estimate of the absolute discount; a half where no count is 1."""
    return min(MOST_DISCOUNT, n1 / (n1 + 2 * (n2 or 0))) if n1 else 0.5


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Model:
    """Evidence in tables (before, word, value) and (word, value); the latter holds after contexts that aren't in the former. Not usable without both classes."""

    def __init__(self, train: DataFrame):
        """train: (text, toxic) of every document to count."""
        counted = train.mapInArrow(lean(_count), "before long, word long, o int, t int")
        pairs = materialize(counted.groupBy("before", "word").agg(F.sum("o").alias("o"), F.sum("t").alias("t")), "pairs")
        some = {"o": F.col("o") > 0, "t": F.col("t") > 0, "b": F.lit(True)}
        n = {"o": F.col("o"), "t": F.col("t"), "b": F.col("o") + F.col("t")}
        row = pairs.agg(*(F.count_if(n[c] == k).alias(f"{c}{k}") for c in n for k in (1, 2)), F.sum("o").alias("no"), F.sum("t").alias("nt")).first()
        self.usable = bool(row.no and row.nt)
        self.pairs = self.words = self.table = None
        if not self.usable:
            return
        level = {c: discount(row[f"{c}1"], row[f"{c}2"]) for c in n}
        words = materialize(pairs.groupBy("word").agg(*(F.count_if(some[c]).alias(c) for c in some)), "contexts")
        deep = words.agg(
            *(F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in n for k in (1, 2)), *(F.sum(c).alias(f"{c}n") for c in n), *(F.count_if(F.col(c) > 0).alias(f"{c}v") for c in n)
        ).first()
        d = {c: discount(deep[f"{c}1"], deep[f"{c}2"]) for c in n}
        self.prior = max(0.0, math.log(deep.on / deep.tn))
        # The discounts of bigrams and of words, for ordinary, toxic and both.
        self.discounts = {"pair": level, "word": d}
        less = lambda col, by: F.greatest(col - by, F.lit(0.0))
        shared = less(F.col("b"), d["b"]) / deep.bn + d["b"] * deep.bv / deep.bn / (deep.bv + 1)
        down = {c: d[c] * deep[f"{c}v"] / deep[f"{c}n"] for c in "ot"}
        most = max(down.values())
        mass = {c: (1 - most) * less(F.col(c), d[c]) / (deep[f"{c}n"] * (1 - down[c])) + most * shared for c in "ot"}
        rated = words.select("word", mass["o"].alias("qo"), mass["t"].alias("qt"))
        self.words = materialize(rated.select("word", (F.log(F.col("qt") / F.col("qo")) - self.prior).alias("value")).where("value > 0"), "words")
        # Only a bigram of a toxic text, or one that ends in a toxic word, can be or hide evidence.
        own = pairs.join(_small(self.words.select("word", F.lit(True).alias("bad"))), "word", "left").where("t > 0 or bad")
        own = materialize(own, "some")
        follow = pairs.groupBy("before").agg(*(F.count_if(some[c]).alias(f"f{c}") for c in some), *(F.sum(n[c]).alias(f"n{c}") for c in n))
        met = own.join(rated, "word").join(_small(own.select("before").distinct()), "before").join(follow, "before")
        back = {c: level[c] * F.col(f"f{c}") / F.col(f"n{c}") for c in n}
        kept = {c: less(F.col(c), level[c]) / (F.col(f"n{c}") * (1 - back[c])) for c in "ot"}
        low = {c: less(n["b"], level["b"]) / F.col("nb") + back["b"] * F.col(f"q{c}") for c in "ot"}
        hand = F.when((F.col("no") > 0) & (F.col("nt") > 0), F.greatest(back["o"], back["t"])).otherwise(1.0)
        high = {c: F.when(hand < 1, (1 - hand) * kept[c]).otherwise(0.0) + hand * low[c] for c in "ot"}
        made = met.select("before", "word", "bad", (F.log(high["t"] / high["o"]) - self.prior).alias("value")).where("value > 0 or bad")
        self.pairs = materialize(made.select("before", "word", "value"), "evidence")
        for used in (pairs, words, own):
            drop_table(used)
        if self.pairs.count() + self.words.count() <= TABLE_ROWS:
            self.table = _Table(self.pairs, self.words)

    def features(self, rows: DataFrame) -> DataFrame:
        """(doc_id, text_hash, feature) of texts (doc_id, text) whose feature isn't 0; null ids stay."""
        texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
        if self.table is not None:
            shared = texts.sparkSession.sparkContext.broadcast(self.table)
            return texts.mapInArrow(lean(_sums(shared)), "doc_id long, text_hash long, feature double").distinct()
        shared = texts.sparkSession.sparkContext.broadcast([_filter(self.pairs), _filter(self.words)])
        asked = texts.mapInArrow(lean(_ask(shared)), "doc_id long, text_hash long, before long, word long, times int, size int").distinct()
        known = asked.join(self.pairs.withColumnRenamed("value", "exact"), ["before", "word"], "left").join(_small(self.words), "word", "left")
        known = known.withColumn("value", F.coalesce("exact", "value")).where("value > 0")
        return known.groupBy("doc_id", "text_hash").agg((F.sum(F.col("value") * F.col("times")) / F.max("size")).alias("feature"))


def _filter(table: DataFrame) -> np.ndarray:
    """A bit table of the keys (before and word, or word), put together by 64 bits in Spark; its size follows their number."""
    bits = min(MOST_BITS, max(12, (KEY_BITS * table.count()).bit_length()))
    columns = table.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy().view(np.uint64) for i in range(len(columns))]
            place = ((_key(*keys) if len(keys) == 2 else keys[0]) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array((np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64))], names=["at", "bit"])

    out = np.zeros(1 << (bits - 6), np.uint64)
    got = table.select(*columns).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def _has(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    place = (keys >> np.uint64(64 - (len(table).bit_length() + 5))).astype(np.int64)
    return (table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


class _Map:
    """Values of 64-bit keys: sorted arrays behind a bit table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = min(MOST_BITS, max(12, (16 * len(keys)).bit_length()))
        place = (keys >> np.uint64(64 - bits)).astype(np.int64)
        self.bits = np.zeros(1 << (bits - 6), np.uint64)
        np.bitwise_or.at(self.bits, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that are there, and their values."""
        at = np.flatnonzero(_has(self.bits, keys)) if len(self.keys) else np.zeros(0, np.int64)
        spot = np.minimum(np.searchsorted(self.keys, keys[at]), max(0, len(self.keys) - 1))
        ok = self.keys[spot] == keys[at]
        return at[ok], self.values[spot[ok]]


class _Table:
    """The evidence as arrays."""

    def __init__(self, pairs: DataFrame, words: DataFrame):
        before, word, value = (c.to_numpy() for c in pairs.toArrow().columns)
        self.pairs = _Map(_key(before.view(np.uint64), word.view(np.uint64)), value)
        word, value = (c.to_numpy() for c in words.toArrow().columns)
        self.words = _Map(word.view(np.uint64), value)

    def values(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The evidence of every bigram."""
        out = np.zeros(len(word))
        for at, value in (self.words.find(word), self.pairs.find(_key(before, word))):
            out[at] = np.maximum(value, 0.0)
        return out


def _sums(table):
    """Rows (doc_id, text_hash, feature) of texts (doc_id, text_hash, text) with evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(2)):
                ids, first = word_ids(data, offsets)
                if not len(ids):
                    continue
                sums = np.concatenate(([0.0], np.cumsum(table.value.values(_befores(ids, first), ids))))
                total = sums[first[1:]] - sums[first[:-1]]
                rows = np.flatnonzero(total > 1e-12)
                mean = total[rows] / np.diff(first)[rows]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a).take(pa.array(rows)) for i in range(2)), pa.array(np.round(mean, 9))], names=["doc_id", "text_hash", "feature"])

    return run


def _ask(filters):
    """Rows (doc_id, text_hash, before, word, times, words of the text) of texts: their different bigrams that the bit tables let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = filters.value
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(2)):
                ids, first = word_ids(data, offsets)
                if not len(ids):
                    continue
                before = _befores(ids, first)
                pair = _key(before, ids)
                hit = np.flatnonzero(_has(pairs, pair) | _has(words, ids))
                owner = np.searchsorted(first, hit, "right") - 1
                order = np.lexsort((pair[hit], owner))
                hit, owner = hit[order], owner[order]
                new = np.ones(len(hit), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (pair[hit[1:]] != pair[hit[:-1]])
                times = np.diff(np.append(np.flatnonzero(new), len(hit)))
                hit, owner = hit[new], owner[new]
                rows = pa.array(owner)
                made = [before[hit].view(np.int64), ids[hit].view(np.int64), times.astype(np.int32), np.diff(first)[owner].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a).take(rows) for i in range(2)), *map(pa.array, made)], names=["doc_id", "text_hash", "before", "word", "times", "size"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, float]:
    """The model and the feature value at which a document counts as toxic, from the training documents only."""
    train = _labelled(docs, labels)
    model = Model(train.where("not tuning").select("text", "toxic"))
    if not model.usable:
        return model, math.inf
    tuning = train.where("tuning")
    found = _attach(tuning.select("doc_id", F.xxhash64("text").alias("text_hash"), "toxic"), model.features(tuning.select("doc_id", "text").distinct()))
    place = F.expr(f"cast(least(feature * {BINS}, {BINS - 1}) as int)")
    hist = np.zeros((2, BINS))
    for toxic, k, n in found.groupBy("toxic", place.alias("bin")).count().collect():
        hist[toxic, k] = n
    return model, _threshold(hist)


def _threshold(hist: np.ndarray) -> float:
    """The cut that loses least, a false alarm (as a part of its class) counting twice; of equally good ones the geometric middle."""
    sums = hist.sum(axis=1, keepdims=True)
    if not sums.all():
        return UNTUNED
    share = np.cumsum(hist / sums, axis=1)
    gain = 2 * share[0] - share[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return math.sqrt((1 + float(best[0])) * (1 + float(best[-1]))) / BINS


def _attach(rows: DataFrame, features: DataFrame) -> DataFrame:
    """rows (with doc_id and text_hash) and their feature, 0 where there is none; null ids meet."""
    found = materialize(features, "features").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("feature").alias("_feature"))
    joined = rows.join(_small(found), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.withColumn("feature", F.coalesce("_feature", F.lit(0.0))).drop("_id", "_hash", "_feature")


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """(doc_id, feature, score) of every row of docs: score is 0 without evidence, a half at the threshold, and nears 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    if not model.usable:
        return rows.select("doc_id", F.lit(0.0).alias("feature"), F.lit(0.0).alias("score"))
    found = _attach(rows, model.features(docs))
    return found.select("doc_id", "feature", (F.col("feature") / (F.col("feature") + F.lit(threshold))).alias("score"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op2 row of every document."""
    return score(docs, *fit(docs, labels)).select("doc_id", F.expr(crc_split()).alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"), "feature")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score as toxic; all columns stay."""
    model, threshold = fit(docs, labels)
    if not model.usable:
        return docs
    bad = materialize(model.features(docs).where(F.col("feature") >= threshold).select("doc_id", "text_hash"), "toxic")
    return without_keys(docs, F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad)

"""Benchmark decontamination by template canonicalisation.

Words become template tokens: a word that begins with a digit is a number, a unit name right
after a number is a unit, a run of capitalised words is one name, and any other word is
itself (A-Z folded, outer signs dropped).  Windows of ``WIDTH`` tokens with at least
``LITERALS`` ordinary words are hashed and joined with those of the benchmark items, so a
question with other numbers or names still meets its original.  Matches of one document and
item at one displacement must bind slots consistently: equal slots of the item to equal
slots of the document and different ones to different ones; windows that hold a slot bound
twice don't count, and a group with such a slot counts if the rest is at least half of the
item's windows.  An item counts as leaked when its consistent windows reach
``LEAST_WINDOWS``, or all that it has.

Every text is read whole and once.  A table of fixed size (``2 ** FILTER_BITS`` bits) of the
items' windows drops nearly all document windows before the join; the items' windows are
broadcast if they are few, and joined by a shuffle otherwise.

Items without such a window (short ones, or mostly of numbers, units and names) have windows
of their whole length: their words, compared one by one, and with at least ``LITERALS``
ordinary words their template tokens too.  Documents are searched for windows of these
lengths only; an item of a single word is found wherever that word stands.

Defined results: null and wordless texts match nothing; texts are read whole, however long;
repeated rows of one id and text give one row; of items with one id each text counts; an empty
table gives no rows; other columns of documents, of any name, pass through ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.kernel import blocks, drop_table, lean, materialize, mix, powers, span_hashes, without_keys, word_spans

WIDTH = 8
LITERALS = 4
LEAST_WINDOWS = 4
FILTER_BITS = 24
#: Item windows of at most this many rows (about 100 MB with their slots) are broadcast.
BROADCAST_WINDOWS = 500_000
#: Names of units.
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes
ounce ounces pound pounds lb lbs ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days
week weeks month months year years percent degree degrees dollar dollars cent cents euro euros usd eur hz khz mhz ghz watt watts
kw volt volts amp amps joule joules kmh mph kb mb gb tb byte bytes bit bits""".split()

_rng = np.random.default_rng(99)
_table = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_table[65:91] = _table[97:123]
_is_core = np.zeros(256, bool)
_is_core[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_table[~_is_core] = 0
_is_end = np.zeros(256, bool)
_is_end[[33, 46, 58, 63]] = True
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in _rng.integers(1, 1 << 63, 3))
_weights = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(data, starts, ends, _table)


_raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
_units = np.sort(_hashes(_raw, *word_spans(_raw, np.array([0, len(_raw)]))))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template token of every word or run of names, its slot value (0 for an ordinary word), and the first token of each document; hash of every word, and the first word of each document."""
    starts, ends = word_spans(data, offsets)
    core = np.flatnonzero(_is_core[data])
    if not len(core):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.searchsorted(core, starts)
    inner = core[np.minimum(at, len(core) - 1)]
    real = (at < len(core)) & (inner < ends)
    starts, ends = inner[real], ends[real]
    first = heads_of = np.searchsorted(starts, offsets)
    folded = data.copy()
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    wide = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
    folded[wide] += 0x20
    value = _hashes(folded, starts, ends)
    head = data[starts]
    number = (head >= 48) & (head <= 57)
    begins = np.zeros(len(starts) + 1, bool)
    begins[first[:-1]] = True
    begins = begins[:-1]
    accented = (head == 0xC3) & np.isin(starts + 1, wide)
    after = starts + 1 + accented
    # The letter after the first one is small: a-z or a byte of a letter that isn't À-Þ.
    following = data[np.minimum(after, len(data) - 1)]
    small = (after < ends) & (((following >= 97) & (following <= 122)) | ((following >= 128) & ~np.isin(after + 1, wide)))
    opens = begins.copy()
    opens[1:] |= _is_end[data[ends[:-1] - 1]]
    name = (((head >= 65) & (head <= 90)) | accented) & small & ~opens
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = number[:-1] & ~begins[1:]
    spot = np.minimum(np.searchsorted(_units, value), len(_units) - 1)
    unit = after_number & (_units[spot] == value)
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    slot = np.where(number | unit | name, value | np.uint64(1), np.uint64(0))
    # A name right after a name, without a sign between them, belongs to it.
    joined = np.zeros(len(starts), bool)
    joined[1:] = name[1:] & name[:-1] & ~begins[1:] & _is_core[data[ends[:-1] - 1]]
    if joined.any():
        heads = np.flatnonzero(~joined)
        # The last word stands for the name: capitals right before a copied passage don't change its first name.
        slot = slot[np.append(heads[1:], len(joined)) - 1]
        token = token[heads]
        first = np.searchsorted(heads, first)
    return token, slot, first, value, heads_of


def windows(token: np.ndarray, slot: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first token and document of every window with enough ordinary words."""
    n = len(token) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolled = np.zeros(n, np.uint64)
    plain = np.concatenate(([0], np.cumsum(slot == 0)))
    for k in range(WIDTH):
        rolled += token[k : n + k] * _weights[k]
    stop = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero((np.arange(n) + WIDTH <= stop) & (plain[WIDTH:] - plain[:-WIDTH] >= LITERALS))
    return mix(rolled[at]), at, np.searchsorted(first, at, "right") - 1


def _runs(keys: np.ndarray, first: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As windows, of every run of ``kind // 2`` words (odd kinds) or template tokens."""
    n = kind // 2
    at = np.arange(max(0, len(keys) - n + 1))
    at = at[at + n <= np.repeat(first[1:], np.diff(first))[: len(at)]]
    up, down = powers(len(keys) + 1)
    sums = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(keys * up[: len(keys)], out=sums[1:])
    return mix((sums[at + n] - sums[at]) * down[at] + mix(np.array([kind], np.uint64))), at, np.searchsorted(first, at, "right") - 1


def _whole(token: np.ndarray, slot: np.ndarray, first: np.ndarray, value: np.ndarray, heads: np.ndarray, owner: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, hash, first token, document) of the whole texts that have no window."""
    left = np.setdiff1d(np.flatnonzero(np.diff(first) > 0), owner)
    plain = np.concatenate(([0], np.cumsum(slot == 0)))
    found = []
    for d in left.tolist():
        sides = [(value, heads, 1)]
        if plain[first[d + 1]] - plain[first[d]] >= LITERALS:
            sides.append((token, first, 0))
        for keys, starts, odd in sides:
            a, b = int(starts[d]), int(starts[d + 1])
            kind = 2 * (b - a) + odd
            found.append((kind, _runs(keys[a:b], np.array([0, b - a]), kind)[0], np.array([a]), np.array([d])))
    return found


def _emit(key: str, filter_=None, kinds: tuple[int, ...] | None = None):
    """Rows (key, hash of the text, window, place in its text, slots, kind) of windows that pass the filter; kinds: the whole lengths to look for, None for items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filter_ is None else filter_.value
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(2)):
                token, slot, first, value, heads = tokens(data, offsets)
                found, at, owner = windows(token, slot, first)
                sets = [(0, found, at, owner)]
                if kinds is None:
                    sets += _whole(token, slot, first, value, heads, owner)
                else:
                    sets += [(k, *_runs(*((value, heads) if k % 2 else (token, first)), k)) for k in kinds]
                for kind, found, at, owner in sets:
                    if bits is not None and len(found):
                        place = (found >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        ok = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                        found, at, owner = found[ok], at[ok], owner[ok]
                    # Windows of words have no slots.
                    width = WIDTH if kind == 0 else 0 if kind % 2 else kind // 2
                    slots = slot[at[:, None] + np.arange(width)].view(np.int64).reshape(-1) if len(at) and width else np.zeros(0, np.int64)
                    rows = pa.array(owner)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a, b - a).take(rows),
                            batch.column(1).slice(a, b - a).take(rows),
                            pa.array(found.view(np.int64)),
                            pa.array((at - (heads if kind % 2 else first)[owner]).astype(np.int32)) if len(at) else pa.array([], pa.int32()),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(slots)),
                            pa.array(np.full(len(at), kind, np.int64)),
                        ],
                        names=[key, "text_hash", "window", "place", "slots", "kind"],
                    )

    return run


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window, item_place, item_slots, item_windows, item_kind) of benchmark items (item_id, text); of items with one id each text counts."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = rows.mapInArrow(lean(_emit("item_id")), "item_id long, text_hash long, window long, place int, slots array<long>, kind long").distinct()
    sizes = found.groupBy("item_id", "text_hash").agg(F.countDistinct("place").alias("item_windows"))
    # Null ids meet too.
    ids = [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("item_id", "text_hash")]
    both = found.alias("f").join(sizes.alias("s"), ids[0] & ids[1])
    return both.select("f.item_id", F.col("f.text_hash").alias("item_hash"), "window", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "item_windows", F.col("kind").alias("item_kind"))


def _filter(items: DataFrame) -> np.ndarray:
    """The bits of all item windows, put together by word so that the driver gets a table of fixed size."""
    place = F.shiftrightunsigned("window", 64 - FILTER_BITS)
    words = items.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(window, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return bits.view(np.uint8)


def _consistent(met: DataFrame, group: list[str]) -> DataFrame:
    """met without the windows that hold a slot bound twice in their group; clashed: 1 where the group had one."""
    pairs = met.select(*group, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*group, F.col("s.item_slots").alias("x"), F.col("s.slots").alias("y")).where("x <> 0").distinct()
    none = F.lit(None).cast("long")
    twice = pairs.groupBy(*group, "x").count().where("count > 1").select(*group, "x", none.alias("y")).union(pairs.groupBy(*group, "y").count().where("count > 1").select(*group, none, "y"))
    clash = materialize(twice.groupBy(*group).agg(F.collect_set("x").alias("xs"), F.collect_set("y").alias("ys")), "clashes")
    few = F.broadcast(clash) if clash.count() <= BROADCAST_WINDOWS else clash
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in group]
    both = met.alias("m").join(few.alias("c"), [reduce(and_, same)], "left").where("xs is null or not (arrays_overlap(item_slots, xs) or arrays_overlap(slots, ys))")
    return both.select("m.*", F.expr("cast(xs is not null as int)").alias("clashed"))


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WINDOWS) -> DataFrame:
    """Leaked items: (doc_id, text_hash, item_id, n_windows, item_windows, slots, changed_slots), one row for each document text and item."""
    known = materialize(item_windows(items), "items")
    table = docs.sparkSession.sparkContext.broadcast(_filter(known))
    kinds = tuple(sorted(r.item_kind for r in known.where("item_kind > 0").select("item_kind").distinct().collect()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = rows.mapInArrow(lean(_emit("doc_id", table, kinds)), "doc_id long, text_hash long, window long, place int, slots array<long>, kind long")
    few = known.count() <= BROADCAST_WINDOWS
    met = found.join(F.broadcast(known) if few else known, "window").withColumn("shift", F.col("place") - F.col("item_place"))
    # Windows of words and of tokens have places of their own.
    found = materialize(met.where("kind = item_kind").drop("window", "kind"), "met")
    group = ["doc_id", "text_hash", "item_id", "item_hash", "item_kind", "shift"]
    met = materialize(_consistent(found, group), "consistent")
    drop_table(found)
    pairs = (
        met.select(*group, F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
        .select(*group, F.col("s.item_slots").alias("x"), F.col("s.slots").alias("y"))
        .where("x <> 0")
        .distinct()
    )
    zero = F.lit(0).cast("long")
    sizes = met.groupBy(*group).agg(F.countDistinct("item_place").alias("n"), F.max("item_windows").alias("item_windows"), F.max("clashed").alias("clashed"))
    sizes = sizes.where("clashed = 0 or 2 * n >= item_windows").drop("clashed")
    parts = [
        pairs.groupBy(*group, "x").agg(F.count("*").alias("bound"), F.sum(F.expr("cast(x <> y as int)")).alias("changed")).select(*group, "bound", F.lit(1).cast("long").alias("slots"), "changed", zero.alias("n"), zero.alias("item_windows")),
        pairs.groupBy(*group, "y").agg(F.count("*").alias("bound")).select(*group, "bound", zero, zero, zero, zero),
        sizes.select(*group, F.lit(1).cast("long"), zero, zero, "n", "item_windows"),
    ]
    judged = parts[0].union(parts[1]).union(parts[2]).groupBy(*group).agg(F.max("bound").alias("bound"), *(F.sum(c).alias(c) for c in ("slots", "changed", "n", "item_windows"))).where("n > 0")
    total = judged.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(
        F.sum("n").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("slots").alias("slots"), F.min("changed").alias("changed_slots")
    )
    return total.where(f"n_windows >= least({least}, item_windows)").drop("item_hash").distinct()


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The op9 rows: every document with every item that it leaks."""
    return leaks(docs, items).drop("text_hash")


def keep_clean(docs: DataFrame, items: DataFrame, most: int = 1_000_000) -> DataFrame:
    """docs without the rows that leak an item; all columns stay. The leaking rows' keys are broadcast if they are at most ``most``."""
    found = materialize(leaks(docs, items).select("doc_id", "text_hash").distinct(), "leaks")
    return without_keys(docs, F.broadcast(found) if found.count() <= most else found)

"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a
threshold (percent).  Steps:

1. One pass gives every document a 64-bit node number (a hash of its whole shingle set, so
   documents of one set share a node) and counts all shingles in a fixed-size table.
2. A second pass orders each set by (frequency class, hash) and emits a prefix.  A prefix of
   ``n - ceil(t n) + l`` tokens must share at least ``l`` tokens with a partner's prefix of
   the same ``l``; of two documents the smaller ``l`` holds.  Each document takes the ``l``
   from 1 to ``MOST_SHARED`` that minimises its estimated scan and verification cost.
3. Tokens are brought together.  Before a token that two prefixes share, both prefixes show
   all that the documents have, so tokens that no other prefix has are not shared there.
   That bounds a pair's overlap at each shared token: by the smaller rank (among tokens that
   others have) before it, and the smaller rest of the set after it.
4. Rather than all pairs of a list, rounds test each member against one leader, the document
   with the largest part that can be shared, later another one.  Verified links merge
   components, and only pairs of different components that pass the bounds stay candidates.
   When few are left, or a round no longer helps, all of them are enumerated, counted against
   ``l`` and verified: no component is missed.

Defined results: null, empty and blank texts have the empty set and link with nothing; with
fewer words than ``width`` the whole sequence is the one shingle; repeated rows, and rows of
equal sets, share a component; pairs at the threshold link; a row without id is its own and has
a null component; texts are read whole, however long; other columns of documents, of any name,
are not read; an empty table gives no rows.  Sets are compared as 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.components import components
from pathloom.llm.kernel import blocks, drop_table, lean, materialize, mix, shingle_sets

#: log2 of the counters of the frequency table, and counters in one of its cells.
SKETCH_BITS = 22
CELL = 1 << 16
#: Largest number of shared prefix tokens asked for, and what one verification costs in posting scans.
MOST_SHARED = 4
VERIFY_COST = 8.0
#: From this frequency class on (2 ** (HOT / 2) times the mean), a token's list is dealt to SALTS tasks.
HOT = 8
SALTS = 16
#: Enumerate all cross-component pairs once their estimate is at most this many for each posting, or a round leaves more than
#: this part of it, or after MOST_ROUNDS.
FEW = 4.0
SLOW = 0.7
MOST_ROUNDS = 8
#: Members that one leader's set is compared with in a task; larger groups are dealt to several tasks.
GROUP = 128
#: Pairs of at most this many rows (about 60 MB) are broadcast to pick their documents' texts; more are joined by a shuffle.
BROADCAST_IDS = 600_000

#: Different texts of a component that meet in one block when links are counted, and tokens that are counted at a time.
BLOCK = 512
COLUMNS = 1024

#: What a side of a pair is known by.
SIDE = ("node", "n", "l", "rank", "rest", "root", "marks", "last", "most")


def _node(own: np.ndarray) -> int:
    """The node number of a shingle set: order-free sums of two mixes."""
    a = int(mix(own).sum(dtype=np.uint64))
    b = int(mix(own * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64))
    return int(mix(np.array([(a * 3 + (b ^ (b >> 17)) * 0xA24BAED4963EE407 + len(own)) & ((1 << 64) - 1)], np.uint64)).view(np.int64)[0])


def least_shared(n: int, percent: int) -> int:
    """Smallest intersection that a partner of any size needs with a set of n."""
    return -(-n * percent // 100)


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n", "node", "cell", "counts"]
        for batch in batches:
            sizes, nodes = [], []
            for _, _, data, offsets in blocks(batch.column(1)):
                for own in shingle_sets(data, offsets, width):
                    sizes.append(len(own))
                    nodes.append(_node(own) if len(own) else None)
                    # In place: a table of counts for each block would take twice this one.
                    np.add.at(counts, (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], names=names)
        cells = [(i, counts[i * CELL : (i + 1) * CELL]) for i in range(len(counts) // CELL)]
        cells = [(i, zlib.compress(c.tobytes(), 1)) for i, c in cells if c.any()]
        if cells:
            k = len(cells)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([i for i, _ in cells], pa.int32()), pa.array([c for _, c in cells], pa.binary())], names=names)

    return run


def _add_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CELL, np.uint64)
    for packed in pdf["counts"]:
        raw = zlib.decompress(packed)
        total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * CELL else np.uint64)
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def frequency_classes(cells: DataFrame) -> tuple[np.ndarray, float]:
    """Class of every counter (twice log2 of count over mean, 0 to 200) and the mean; the driver gets 2 ** SKETCH_BITS counters whatever the input."""
    salted = cells.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(16)))
    partly = salted.groupBy("cell", "part").applyInPandas(lambda pdf: _add_cells(pdf), "cell int, counts binary")
    counts = np.zeros(1 << SKETCH_BITS, np.uint64)
    for cell, packed in partly.groupBy("cell").applyInPandas(lambda pdf: _add_cells(pdf), "cell int, counts binary").toLocalIterator():
        counts[cell * CELL : (cell + 1) * CELL] = np.frombuffer(zlib.decompress(packed), np.uint64)
    mean = max(1.0, float(counts.sum()) / len(counts))
    return np.clip(np.floor(2 * np.log2(np.maximum(counts, 1) / mean)), 0, 200).astype(np.uint8), mean


def shared_needed(excess: np.ndarray, n: int, percent: int) -> int:
    """The number of shared prefix tokens, 1 to MOST_SHARED, of least estimated cost; excess has the expected list lengths above chance, in order."""
    base = n - least_shared(n, percent)
    best, chosen = float("inf"), 1
    scans = np.cumsum(excess[: base + MOST_SHARED])
    for share in range(1, min(MOST_SHARED, least_shared(n, percent)) + 1):
        cost = float(scans[min(base + share, n) - 1]) * (1 + VERIFY_COST / (share * share)) + share
        if cost < best:
            best, chosen = cost, share
    return chosen


def _prefixes(table, mean: float, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = table.value
        excess_of = np.where(np.arange(256) > 1, mean * (2.0 ** (np.arange(256) / 2)), 0)
        seen: set[int] = set()
        tokens, nodes, infos = [], [], []
        low = np.uint64((1 << 56) - 1)

        def out() -> pa.RecordBatch:
            lengths = [len(t) for t in tokens]
            token = np.concatenate(tokens)
            node = np.repeat(np.array(nodes, np.int64), lengths)
            salt = np.where((token >> np.uint64(56)) >= HOT, node % SALTS, 0).astype(np.int32)
            made = [token.view(np.int64), salt, node, np.concatenate(infos)]
            for x in (tokens, nodes, infos):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["token", "salt", "node", "info"])

        rows = 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                for own in shingle_sets(data, offsets, width):
                    if not (n := len(own)) or (node := _node(own)) in seen:
                        continue
                    seen.add(node)
                    key = (classes[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (own & low)
                    most = min(n, n - least_shared(n, percent) + MOST_SHARED)
                    if most < n:
                        key = np.partition(key, most - 1)[:most]
                    key.sort()
                    share = shared_needed(excess_of[(key >> np.uint64(56)).astype(np.int64)], n, percent)
                    tokens.append(key[: n - least_shared(n, percent) + share])
                    nodes.append(node)
                    # Set size, place in the order, and tokens asked for, in one number.
                    infos.append((n << 32) + (np.arange(len(tokens[-1]), dtype=np.int64) << 4) + share)
                    rows += len(tokens[-1])
                if rows > 150_000:
                    yield out()
                    rows = 0
        if rows:
            yield out()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token, salt and node: each once, those in lists of two or more (or of salted tokens)."""
    held: list[np.ndarray] | None = None  # the last row so far, and whether it begins its list

    def emit(cols: list[np.ndarray], new: np.ndarray, last: bool) -> pa.RecordBatch | None:
        multi = ~new
        multi[:-1] |= ~new[1:]
        multi |= (cols[0].view(np.uint64) >> np.uint64(56)) >= HOT
        if not last:
            multi[-1] = False
        if not multi.any():
            return None
        info = cols[3][multi]
        made = [cols[0][multi], cols[2][multi], (info >> 32).astype(np.int32), (info & 15).astype(np.int32), (info >> 4 & (1 << 28) - 1).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["token", "node", "n", "l", "pos"])

    for batch in batches:
        cols = [np.array(c) for c in batch.columns]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate((h, c)) for h, c in zip(held[:4], cols, strict=True)]
        new = np.ones(len(cols[0]), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        fresh = new.copy()
        fresh[1:] |= cols[2][1:] != cols[2][:-1]
        if held is not None:
            new[0] = held[4][0]
        cols, new = [c[fresh] for c in cols], new[fresh]
        if (made := emit(cols, new, False)) is not None:
            yield made
        held = [c[-1:].copy() for c in cols] + [new[-1:].copy()]
    if held is not None and (made := emit(held[:4], held[4], True)) is not None:
        yield made


def _sets(width: int):
    """Rows (group, salt, lead, node, tokens) of texts (text, node, group, salt, lead); a text of another node, of a repeated id, gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                found = [(_node(own), own.tobytes()) if len(own) else (None, b"") for own in shingle_sets(data, offsets, width)]
                part = batch.slice(a, b - a)
                ok = [i for i, (node, want) in enumerate(zip((f[0] for f in found), part.column(1).to_pylist(), strict=True)) if node == want]
                kept = part.take(pa.array(ok, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column(2), kept.column(3), kept.column(4), kept.column(1), pa.array([found[i][1] for i in ok], pa.binary())], names=["group", "salt", "lead", "node", "tokens"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group, salt and lead (leaders first): each member's overlap with its leader."""
    leader, key = np.zeros(0, np.uint64), None
    for batch in batches:
        out: list[tuple[int, int, int, int, int]] = []
        for group, salt, lead, node, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(tokens, np.uint64)
            if lead == 0:
                leader, key = own, (group, salt)
            elif key == (group, salt):
                out.append((group, node, len(leader), len(own), len(np.intersect1d(leader, own, assume_unique=True))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["a", "b", "a_n", "b_n", "shared"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of the sets share: products of 0/1 matrices, COLUMNS tokens of more than one set at a time."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = times[column] > 1
    row, column = row[several], (np.cumsum(times > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n = int((times > 1).sum())
    out = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, n, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, n - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def _degrees(percent: int):
    """Of rows sorted by (group, salt), in which salt names two blocks: each node with the copies of the texts that it links with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def counted() -> pa.RecordBatch:
            side, node, copies = (np.array([h[i] for h in held]) for i in range(3))
            size = np.array([len(h[3]) for h in held])
            shared = _shared([h[3] for h in held])
            linked = (100 + percent) * shared >= percent * (size[:, None] + size[None, :])
            np.fill_diagonal(linked, False)
            if side.any():
                # Two different blocks: each side only meets the other one.
                linked &= side[:, None] != side[None, :]
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(linked @ copies)], names=["node", "links"])

        for batch in batches:
            for group, salt, side, node, copies, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (group, salt):
                    if held:
                        yield counted()
                    key, held = (group, salt), []
                held.append((side, node, copies, np.frombuffer(tokens, np.uint64)))
        if held:
            yield counted()

    return run


class Join:
    """One run of the join over (doc_id, text) rows."""

    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 80):
        self.docs, self.width, self.percent = docs.select("doc_id", "text"), width, percent
        self.spark = docs.sparkSession

    def _possible(self, x: str, y: str) -> str:
        """SQL: whether two sides (prefixes of column names) that share a token can link: by size, and by rank before and rest after this token."""
        reach = f"least({x}rank, {y}rank) + 1 + least({x}rest, {y}rest)"
        return f"100 * least({x}n, {y}n) >= {self.percent} * greatest({x}n, {y}n) AND {100 + self.percent} * ({reach}) >= {self.percent} * ({x}n + {y}n)"

    def _covered(self) -> str:
        """SQL: whether x and y can link by the marks of their shareable prefix tokens: all those of the side whose last one comes first show in the other side, if shared."""
        reach = "if(x_last <= y_last, x_most - bit_count(x_marks & ~y_marks), y_most - bit_count(y_marks & ~x_marks))"
        return f"{100 + self.percent} * ({reach}) >= {self.percent} * (x_n + y_n)"

    def _postings(self, lists: DataFrame) -> DataFrame:
        """lists with each posting's rank among its document's tokens that others have, the size of the set after it, and of the document: its part of such tokens, 64 hashed marks of them, the last one, and the most that can be shared."""
        own = W.partitionBy("node")
        ranked = lists.select(
            "token", "node", "n", "l", (F.col("n") - F.col("pos") - 1).alias("rest"), (F.row_number().over(own.orderBy("token")) - 1).alias("rank"), F.count("*").over(own).alias("live"),
            F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(token) & 63 as int))")).over(own).alias("marks"), F.max("token").over(own).alias("last"), F.min(F.col("n") - F.col("pos") - 1).over(own).alias("tail"),
        )
        return ranked.select("token", "node", "n", "l", "rank", "rest", (F.col("live") / F.col("n")).alias("part"), "marks", "last", (F.col("live") + F.col("tail")).cast("int").alias("most"))

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with their set sizes and number of shared shingles. Every set travels once for each pair that it is the member of, and once for each task that it leads."""
        sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("tasks"))
        dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("salt"))
        members = dealt.select(F.col("b").alias("node"), F.col("a").alias("group"), "salt", F.lit(1).alias("lead"))
        leaders = dealt.select(F.col("a").alias("node"), F.col("a").alias("group"), "salt", F.lit(0).alias("lead")).distinct()
        wanted = materialize(members.union(leaders).join(self.classes.select("node", "doc_id"), "node"), "wanted")
        texts = self.docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id").select("text", "node", "group", "salt", "lead")
        sets = texts.mapInArrow(lean(_sets(self.width)), "group long, salt int, lead int, node long, tokens binary")
        met = sets.repartition("group", "salt").sortWithinPartitions("group", "salt", "lead")
        checked = materialize(met.mapInArrow(lean(_overlaps), "a long, b long, a_n long, b_n long, shared long").distinct(), "checked")
        drop_table(wanted)
        return checked

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Documents (doc_id, n, node), classes (node, doc_id of the representative, copies), and verified links (a, b) that span every component."""
        found = materialize(self.docs.mapInArrow(lean(_profile(self.width)), "doc_id long, n long, node long, cell int, counts binary"), "profiles")
        rows = found.where("cell is null").select("doc_id", "n", "node")
        classes, mean = frequency_classes(found.where("cell is not null").select("cell", "counts"))
        self.classes = materialize(rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "classes")
        table = self.spark.sparkContext.broadcast(classes)
        named = self.docs.where("doc_id is not null").select("text")
        postings = named.mapInArrow(lean(_prefixes(table, mean, self.width, self.percent)), "token long, salt int, node long, info long")
        dealt = postings.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
        shared = materialize(dealt.mapInArrow(lean(_lists), "token long, node long, n int, l int, pos int"), "lists")
        table.destroy()
        lists = materialize(self._postings(shared), "postings")
        drop_table(shared)
        size = lists.count()
        links = root = tested = None
        good = f"{100 + self.percent} * shared >= {self.percent} * (a_n + b_n)"
        before = float("inf")
        for turn in range(MOST_ROUNDS + 1):
            own = lists.withColumn("root", F.col("node"))
            if root is not None:
                own = lists.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
            # Of each list its components, and the member with the largest shareable part; later rounds take another one for each token.
            first = F.struct("part", "node") if turn == 0 else F.struct(F.xxhash64("token", "node", F.lit(turn)).alias("h"), "node")
            leader = F.struct(*[F.col(c).alias(f"y_{c}") for c in ("node", "n", "rank", "rest")])
            sizes = own.groupBy("token", "root").agg(F.count("*").alias("root_size"), F.max_by(leader, first).alias("y"), F.max("part").alias("part"))
            best = F.struct("part", "y.y_node") if turn == 0 else F.struct("root_size", "y.y_node")
            mixed = sizes.groupBy("token").agg(F.sum("root_size").alias("every"), F.sum(F.col("root_size") * F.col("root_size")).alias("squares"), F.max_by(F.struct("root", "y"), best).alias("top")).where("every * every > squares")
            mixed = materialize(mixed.select("token", ((F.col("every") * F.col("every") - F.col("squares")) / 2).alias("left"), F.col("top.root").alias("y_root"), "top.y.*"), "mixed")
            left = mixed.agg(F.sum("left")).first()[0] or 0
            if left == 0:
                drop_table(mixed)
                break
            x = own.select("token", *[F.col(c).alias(f"x_{c}") for c in SIDE])
            last = turn > 0 and (left <= FEW * size + 10_000 or left > SLOW * before or turn == MOST_ROUNDS)
            before = left
            pairs = self._all_pairs(x, own, mixed) if last else self._leader_pairs(x, mixed)
            both = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
            if tested is not None:
                pairs = pairs.select("*", *both).join(tested, ["lo", "hi"], "left_anti")
            pairs = materialize(pairs.select("a", "b"), "pairs")
            drop_table(mixed)
            checked = self._verify(pairs)
            drop_table(pairs)
            tested = checked.select(*both) if tested is None else tested.union(checked.select(*both))
            new = checked.where(good).select("a", "b")
            links = new if links is None else links.union(new)
            if last:
                break
            root = components(links)
        if links is None:
            links = lists.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        return rows, self.classes, links

    def _leader_pairs(self, x: DataFrame, mixed: DataFrame) -> DataFrame:
        """(a: leader, b: member): every member with the leader of most of its lists, if they can link and have no component in common."""
        met = x.join(mixed, "token").where(f"x_root <> y_root and {self._possible('x_', 'y_')}")
        counts = met.groupBy("x_node", "y_node").agg(F.count("*").alias("c"))
        return counts.groupBy(F.col("x_node").alias("b")).agg(F.max_by("y_node", F.struct("c", "y_node")).alias("a")).select("a", "b")

    def _all_pairs(self, x: DataFrame, own: DataFrame, mixed: DataFrame) -> DataFrame:
        """All pairs of different components that share enough prefix tokens and can link. Only members outside a list's leading component meet the others."""
        places = mixed.select("token", F.col("y_root").alias("top_root"))
        y = own.join(places, "token").select("token", "top_root", *[F.col(c).alias(f"y_{c}") for c in SIDE])
        outside = x.join(places, "token").where("x_root <> top_root").drop("top_root")
        met = outside.join(y, "token").where(f"x_root <> y_root and (y_root = top_root or x_node < y_node) and {self._possible('x_', 'y_')} and {self._covered()}")
        pairs = met.groupBy(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).agg(
            F.count("*").alias("c"), F.max(F.least("x_l", "y_l")).alias("l"), F.min(F.least("x_rest", "y_rest")).alias("rest"), F.max(F.col("x_n") + F.col("y_n")).alias("n")
        )
        # All shared prefix tokens, and at most the smaller rest after the last of them.
        return pairs.where(f"c >= l and {100 + self.percent} * (c + rest) >= {self.percent} * n").select("a", "b")


def _count_links(join: Join, root: DataFrame) -> DataFrame:
    """(node, links): how many rows of other texts each text links with, of components (node, root).

    A component's texts are dealt into blocks of about BLOCK, and every two blocks meet in one
    task, where only counts come out; the pairs are never rows.  A component of up to BLOCK texts
    travels once, one of n texts n / BLOCK times.
    """
    sizes = root.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = root.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("root", "node", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("salt"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    wanted = materialize(pairs.join(join.classes, "node").select("root", "node", "salt", "side", "copies", "doc_id"), "wanted")
    texts = join.docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id")
    # The group's columns pass through the set builder in one.
    texts = texts.select("text", "node", F.struct("root", "salt", "side", "copies").alias("group"), F.lit(0).alias("salt"), F.lit(0).alias("lead"))
    sets = texts.mapInArrow(lean(_sets(join.width)), "group struct<root:long,salt:string,side:int,copies:long>, salt int, lead int, node long, tokens binary")
    # A document of a repeated id and text stands for its copies once.
    met = sets.select("group.root", "group.salt", "group.side", "node", "group.copies", "tokens").repartition("root", "salt").sortWithinPartitions("root", "salt", "node", "side")
    met = met.dropDuplicates(["root", "salt", "node", "side"]).sortWithinPartitions("root", "salt", "node", "side")
    met = met.select("root", "salt", "side", "node", "copies", "tokens")
    counts = materialize(met.mapInArrow(lean(_degrees(join.percent)), "node long, links long").groupBy("node").agg(F.sum("links").alias("links")), "links")
    drop_table(wanted)
    return counts


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Verified links (a, b: representatives' doc_ids) that connect every component of different texts."""
    _, classes, links = Join(docs, width, percent).run()
    a, b = (classes.select(F.col("node").alias(k), F.col("doc_id").alias(f"{k}_id")) for k in "ab")
    return links.join(a, "a").join(b, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def assign(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links (other rows that it links with; null without id) of every row of docs."""
    join = Join(docs, width, percent)
    rows, classes, links = join.run()
    root = components(links)
    least = root.join(classes, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = root.join(least, "root").select("node", "component_id").join(_count_links(join, root), "node", "left")
    several = classes.join(linked, "node", "left").where("copies > 1 or component_id is not null")
    several = several.select("node", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    several = materialize(several, "assigned")
    found = rows.join(several, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.expr("if(doc_id is null, null, coalesce(component_id, doc_id))").alias("component_id"), F.expr("if(doc_id is null, null, coalesce(n_links, 0L))").alias("n_links"))
    return found

"""A key store of levels: sorted Parquet directories, a buffer of recent batches, and a manifest.

Inserts append to the buffer.  When it reaches ``max_buffer_keys`` the buffer and all levels
below the first free level become that level (the logarithmic method).  Readers see what the
newest manifest lists.  A merge writes the new level first and then a new manifest; what only
older manifests list stays for the ``KEPT`` last of them, so a DataFrame handed out before a
merge still runs, and a crash leaves a readable store.  A batch's name is committed in the
manifest that commits its data, so a batch that is run again is not stored twice.

Levels are clustered by (path, value), so row-group bounds prune path prefixes and, inside a
prefix, values.  With ``reverse`` every level has a second copy, clustered by the reversed path;
a query takes the copy that ``choose_direction`` names.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.glob import Pattern, choose_direction
from pathloom.operators.search import HIGHEST, LOWEST, Query, search
from pathloom.plans.scratch import file_system, remove
from pathloom.sources.keys import SCHEMA

BUFFER_KEYS = 1_000_000
#: Keys in one file of a level: about 256 MB at 80 bytes a key.
FILE_KEYS = 3_000_000
#: Manifests whose data stay.
KEPT = 3
#: Batch names that a manifest remembers.
BATCHES = 1000
FORWARD, BACKWARD = "forward", "backward"


def level_number(n_keys: int, max_buffer_keys: int) -> int:
    """The level that a bulk load of n keys becomes; negative for less than half a buffer."""
    return math.ceil(math.log2(n_keys / max_buffer_keys)) if n_keys else 0


class Store:
    def __init__(self, spark: SparkSession, root: str, max_buffer_keys: int = BUFFER_KEYS, reverse: bool = False):
        """``reverse`` keeps a second copy of each level by reversed path, so patterns that begin with a wildcard prune too."""
        self.spark, self.root, self.max_buffer_keys, self.reverse = spark, root.rstrip("/"), max_buffer_keys, reverse

    # Manifests: small files numbered upwards; the highest complete one holds.

    def _manifests(self) -> list[int]:
        system, folder = file_system(self.spark, f"{self.root}/_manifests")
        if not system.exists(folder):
            return []
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        return sorted(int(n.removeprefix("m")) for n in names if n.startswith("m"))

    def _load(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/_manifests/m{number}", wholetext=True).first()[0])

    def state(self) -> dict:
        """The newest manifest: levels (number: path, keys), buffer (paths and their keys), and the last batches' names."""
        found = self._manifests()
        return self._load(found[-1]) if found else {"levels": {}, "buffer": [], "buffer_keys": 0, "batches": []}

    def _commit(self, state: dict) -> None:
        nr = (self._manifests() or [-1])[-1] + 1
        system, folder = file_system(self.spark, f"{self.root}/_manifests")
        system.mkdirs(folder)
        _, temporary = file_system(self.spark, f"{self.root}/_manifests/_{uuid.uuid4().hex}")
        out = system.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, final = file_system(self.spark, f"{self.root}/_manifests/m{nr}")
        if not system.rename(temporary, final):
            raise RuntimeError("another writer has made this manifest")

    def vacuum(self, kept: int = KEPT) -> None:
        """Delete the manifests before the last ``kept`` and the data that only they list."""
        numbers = self._manifests()
        old, new = [self._load(n) for n in numbers[:-kept]], [self._load(n) for n in numbers[-kept:]]
        paths = lambda states: {p for s in states for p in [*(x["path"] for x in s["levels"].values()), *s["buffer"]]}
        for path in paths(old) - paths(new):
            remove(self.spark, path)
        for n in numbers[:-kept]:
            remove(self.spark, f"{self.root}/_manifests/m{n}")

    def _write(self, keys: DataFrame, clustered: bool) -> str:
        """A new folder with the keys by path and, for a level of a reversed store, by reversed path."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows = keys.select(*SCHEMA.names)
        if clustered:
            rows = rows.repartitionByRange("path", "value").sortWithinPartitions("path", "value")
        rows.write.option("maxRecordsPerFile", FILE_KEYS).parquet(f"{path}/{FORWARD}")
        if clustered and self.reverse:
            back = self._read([f"{path}/{FORWARD}"]).withColumn("rpath", F.reverse("path"))
            back = back.repartitionByRange("rpath", "value").sortWithinPartitions("rpath", "value")
            back.write.option("maxRecordsPerFile", FILE_KEYS).parquet(f"{path}/{BACKWARD}")
        return path

    def _count(self, path: str) -> int:
        return self._read([f"{path}/{FORWARD}"]).count()

    def clear(self) -> None:
        remove(self.spark, self.root)

    def bulk_load(self, keys: DataFrame) -> int:
        """Replace all that is stored; returns the level."""
        path = self._write(keys, True)
        n = self._count(path)
        level = level_number(n, self.max_buffer_keys)
        self._commit({"levels": {str(level): {"path": path, "keys": n, "reverse": self.reverse}}, "buffer": [], "buffer_keys": 0, "batches": self.state()["batches"]})
        self.vacuum()
        return level

    def insert(self, keys: DataFrame, batch: str | None = None) -> bool:
        """Append keys; merge when the buffer is full. A ``batch`` name that is stored already is left out; returns whether the keys were taken."""
        state = self.state()
        if batch is not None and batch in state["batches"]:
            return False
        path = self._write(keys, False)
        state["buffer"].append(path)
        state["buffer_keys"] += self._count(path)
        if batch is not None:
            state["batches"] = [*state["batches"], batch][-BATCHES:]
        self._commit(state)
        if state["buffer_keys"] >= self.max_buffer_keys:
            self.merge()
        return True

    def merge(self) -> int | None:
        """Move the buffer and all levels below the first free level into that level; returns it."""
        state = self.state()
        if not state["buffer"]:
            return None
        free = 0
        while str(free) in state["levels"]:
            free += 1
        below = [k for k in state["levels"] if int(k) < free]
        gone = [state["levels"][k]["path"] for k in below] + state["buffer"]
        path = self._write(self._read([f"{p}/{FORWARD}" for p in gone]), True)
        new = {"path": path, "keys": self._count(path), "reverse": self.reverse}
        state["levels"] = {k: v for k, v in state["levels"].items() if k not in below} | {str(free): new}
        self._commit(state | {"buffer": [], "buffer_keys": 0})
        self.vacuum()
        return free

    flush = merge

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        """All keys as one bag."""
        state = self.state()
        return self._read([f"{p}/{FORWARD}" for p in [*(x["path"] for x in state["levels"].values()), *state["buffer"]]]).select(*SCHEMA.names)

    def facts(self) -> DataFrame:
        """(place, n_keys, parts): each level by its number, and the buffer with its batches."""
        state = self.state()
        rows = [(k, v["keys"], 1) for k, v in state["levels"].items()] + [("buffer", state["buffer_keys"], len(state["buffer"]))]
        return self.spark.createDataFrame(rows, "place string, n_keys long, parts long")

    def query(self, pattern: str, low: int = LOWEST, high: int = HIGHEST, direction: str = "auto") -> DataFrame:
        """Keys of all levels and the buffer that answer the query; ``direction`` 1 takes the levels' forward copies, 0 the backward ones, auto what suits the pattern."""
        state = self.state()
        if direction == "auto":
            direction = choose_direction(pattern)
        backward = [x["path"] for x in state["levels"].values() if x["reverse"] and direction == "0"]
        forward = [*(x["path"] for x in state["levels"].values() if x["path"] not in backward), *state["buffer"]]
        out = search(self._read([f"{p}/{FORWARD}" for p in forward]).select(*SCHEMA.names), pattern, low, high)
        if backward:
            condition = Query(pattern, low, high).condition()
            if suffix := Pattern(pattern).suffix:
                condition = F.col("rpath").startswith(suffix[::-1]) & condition
            out = out.union(self._read([f"{p}/{BACKWARD}" for p in backward]).where(condition).select(*SCHEMA.names))
        return out

    def query_file(self, path: str) -> DataFrame:
        """(qid, pattern, low, high, matches) of the queries of a file, counted in one pass over all levels and the buffer."""
        from pathloom.operators.search import batch_counts
        from pathloom.sources.lines import read_queries

        return batch_counts(self.read(), [Query(*q) for q in read_queries(self.spark, path)])

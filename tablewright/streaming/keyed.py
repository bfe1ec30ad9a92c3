"""A keyed table that a stream keeps up to date: one row per key, the newest.

The table is a few written segments, each with one row per key. A micro-batch adds its newest rows as a segment; neighbours are merged
while the older one is at most twice as large, so sizes fall off geometrically: there are about log2(rows) segments, a row is rewritten about that often, and reading
costs at most about twice the live keys, however many batches there were.

The list of segments is a small file of its own, written beside and then renamed, named by the batch. A batch that runs again finds its number
there and changes nothing; one that was killed between writing a segment and the rename left the table as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.ordered import orderable
from tablewright.operators.rows import first_per_key

GROWTH = 2  # a segment is merged with the one before it while that is at most so many times as large


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    return first_per_key(events, keys, [F.desc(c) for c in order + orderable(events, keys + order)])


class KeyedTable:
    """One writer at a time (the sink of one stream), any number of readers."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order

    def _place(self, name: str):
        """Hadoop's path and file system, so that any store Spark writes to will do."""
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(context._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place, fs = self._place(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def segments(self) -> tuple[int, list[list]]:
        """Number of the last batch (-1 before the first) and [folder, rows] of each segment, oldest first."""
        lists = [n for n in self._names("lists") if n.endswith(".json")]
        if not lists:
            return -1, []
        text = self.spark.read.text(f"{self.path}/lists/{lists[-1]}", wholetext=True).first()[0]
        return int(lists[-1].split(".")[0]), json.loads(text)

    def _publish(self, batch: int, parts: list[list]) -> None:
        """The swap: readers see the old list or the new one."""
        beside, fs = self._place(f"lists/{batch:012d}.{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not fs.rename(beside, self._place(f"lists/{batch:012d}.json")[0]):
            raise RuntimeError(f"batch {batch} could not be published")

    def _write(self, df: DataFrame) -> list:
        folder = f"data/{uuid.uuid4().hex}"
        latest(df, self.keys, self.order).write.parquet(f"{self.path}/{folder}")
        return [folder, self._read([folder]).count()]

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def merge(self, df: DataFrame, batch: int) -> None:
        """Adds a micro-batch; one that is in the table already has no effect."""
        last, parts = self.segments()
        if batch <= last:
            return
        new = self._write(df)
        size, joined = new[1], [new]
        while parts and parts[-1][1] <= GROWTH * size:
            joined.insert(0, parts.pop())
            size += joined[0][1]
        self._publish(batch, [*parts, self._write(self._read([f for f, _ in joined])) if len(joined) > 1 else new])

    def read(self) -> DataFrame:
        """The newest row of every key."""
        _, parts = self.segments()
        if not parts:
            raise ValueError(f"no batch was written to {self.path}")
        found = self._read([f for f, _ in parts])
        return found if len(parts) == 1 else latest(found, self.keys, self.order)

    def clean(self) -> int:
        """Deletes segments and lists that the newest list does not need, when no reader uses them any more; their number."""
        last, parts = self.segments()
        keep = {f.split("/")[-1] for f, _ in parts}
        old = [f"data/{n}" for n in self._names("data") if n not in keep] + [f"lists/{n}" for n in self._names("lists") if n != f"{last:012d}.json"]
        for name in old:
            place, fs = self._place(name)
            fs.delete(place, True)
        return len(old)

"""Incremental refresh: a stream of change events folded into versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; a partial maximum, so hot keys shrink before they are shuffled."""
    rest = [c for c in changes.columns if c not in (key, *order)]
    best = changes.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("last"))
    return best.select(key, *[F.col("last").getField(c).alias(c) for c in (*order, *rest)])


class Snapshots:
    """Versions of a keyed table at `path`, a folder each. Readers pin the version they opened.

    What is committed is told by the folders themselves, so a new process goes on where the last one stopped. A batch of the
    stream makes the version of its own number; one that runs again finds its version complete and leaves it as it is. A
    batch without rows makes no version.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str]):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order

    def _folder(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions: those that the writer's commit has marked."""
        where, fs = self._folder()
        if not fs.exists(where):
            return []
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop(f"{self.path}/{n}/_SUCCESS")))

    @property
    def version(self) -> int:
        return max(self.versions(), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        wanted = self.version if version is None else version
        if wanted < 0:
            raise ValueError("nothing has been committed")
        return self.spark.read.parquet(f"{self.path}/v{wanted}")

    def apply(self, changes: DataFrame, version: int) -> None:
        """Fold a batch into a new version; rows that arrive late, behind their key's last, change nothing."""
        done = self.versions()
        if version in done or changes.isEmpty():
            return
        older = [v for v in done if v < version]
        rows = changes if not older else self.read(older[-1]).unionByName(changes)
        latest(rows, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def forget(self, keep: int = 2) -> None:
        """Delete all but the newest versions."""
        where, fs = self._folder()
        for v in self.versions()[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)


def refresh(stream: DataFrame, snapshots: Snapshots, checkpoint: str, seconds: float | None = None) -> None:
    """Fold all that `stream` has by now, batch after batch, and stop; called again, it goes on with what is new. With
    `seconds`, a batch starts each so many seconds, so changes in between are folded together, until the query is stopped."""
    writer = stream.writeStream.foreachBatch(snapshots.apply).option("checkpointLocation", checkpoint)
    if seconds is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        writer.trigger(processingTime=f"{seconds} seconds").start()


def freshness(snapshots: Snapshots, dirty: bool, running: bool, wait: bool = False) -> str:
    """What a reader gets: `fresh` if nothing changed, `stale` for the last version while changes are folded in (or an error
    instead, where it will not take that), `missing` before the first version."""
    if not snapshots.versions():
        return "missing"
    if not dirty and not running:
        return "fresh"
    if running and not wait:
        return "stale"
    return "wait"

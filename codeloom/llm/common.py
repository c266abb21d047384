"""Shared helpers: tables in the shared folder, column picking, ASCII words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and code points 9 to 13.
BLANK = r"\x20\x09-\x0D"
#: The same characters as text, for translate().
BLANK_CHARS = " \t\n\x0b\x0c\r"
WORD = f"[^{BLANK}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where that is unset, as in tests, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/codeloom/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = passing(new_path(spark, label))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


#: Whether Spark deletes the shuffle files of a statement at its end; else they stay until the driver collects garbage.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash_alone(df: DataFrame, label: str) -> DataFrame:
    """As `stash`, and the shuffle files that the writing took are deleted when it is done."""
    conf = df.sparkSession.conf
    before = conf.get(FREES, None)
    conf.set(FREES, "true")
    try:
        return stash(df, label)
    finally:
        conf.unset(FREES) if before is None else conf.set(FREES, before)


#: Folders of tables that only serve results not yet written.
_PASSING: list[str] = []


def passing(path: str) -> str:
    _PASSING.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df.stash_path)
        _PASSING.remove(df.stash_path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables stashed within are deleted at the end, when what is made of them has been written."""
    first = len(_PASSING)
    try:
        yield
    finally:
        for path in _PASSING[first:]:
            _delete(spark, path)
        del _PASSING[first:]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is (lower() would change other letters as well)."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Arrow batches of at most `rows` texts and about `size` bytes, so that a worker holds some MB at a time."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(spark.conf.get(name).removesuffix("b")) <= most:
            spark.conf.set(name, most)


def give_back() -> None:
    """Return unused memory of this process to the system: Python's, Arrow's, then the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A function for mapInArrow that returns its memory when its task ends, as workers are kept for later tasks."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """Raise unless the ids are whole numbers (of any width): other ids have no place in a 64-bit order."""
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"{id_col} must be of a whole number type, not {kind}")

"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, those of the largest ids first. A batch's hashes merge-anti-join the runs: what no run holds is
new, so the batch has the largest document with that line, which keeps it; what some run holds only adds to its count.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, ascii_lower, discard, new_path, passing, stash, whole_ids

#: A null id sorts before every other id.
NO_ID = -(1 << 63)
#: Lists of lost lines are searched line by line up to this length; the lines of longer ones are joined with them.
SEARCHED = 512


def line_key(line: Column) -> Column:
    # \z: `$` would also match before a final line separator
    return ascii_lower(F.regexp_replace(line, f"\\A[{BLANK}]+|[{BLANK}]+\\z", ""))


def line_hash(key: Column) -> Column:
    """128 bits as a struct (h1, h2)."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def eligible_hashes(text: Column, min_chars: int) -> Column:
    """Distinct hashes of a text's keys of at least `min_chars` code points."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_key)
    return F.transform(F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars)), line_hash)


class LineRuns:
    """Runs of line hashes in the shared folder, in levels.

    A run has one row (h1, h2, n, last) a hash: in how many documents its batches held the line, and the largest id if
    that batch was the first to hold it. Runs are tables bucketed by hash and sorted within their buckets, so that
    anti-joins and compactions of runs merge bucket with bucket, without a shuffle. When a level has `fanout` runs, they
    are compacted into one of the next level: counts add up. A batch thus costs its own size plus the merges with the
    runs, and each row is rewritten once a level.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, label: str) -> DataFrame:
        name = f"codeloom_{uuid.uuid4().hex}"
        rows = rows.select("h1", "h2", F.col("n").cast("long").alias("n"), "last").repartition(self.buckets, "h1", "h2")
        path = passing(new_path(self.spark, label))
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out.stash_path, out.table_name = path, name
        return out

    def _drop(self, *runs: DataFrame) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run.table_name}")
            discard(run)

    def close(self) -> None:
        """Delete all runs."""
        self._drop(*self.runs())
        self.levels = [[]]

    def runs(self) -> list[DataFrame]:
        """All runs; a hash has a row in each run whose batches held it."""
        return [run for level in self.levels for run in level]

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The rows of `hashes` (h1, h2, ...) that no run holds."""
        for run in self.runs():
            hashes = hashes.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> None:
        """Take in a batch of rows (h1, h2, id), one for each line of each document, whose ids are below those of all
        batches before. Hashes that are in no run get the batch's largest id, the others add their count only."""
        sums = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        batch = self._write(sums, "batch")
        if self.runs():
            fresh = self.unseen(batch.select("h1", "h2", "last"))
            marked = batch.select("h1", "h2", "n").join(fresh.hint("merge"), ["h1", "h2"], "left")
            run = self._write(marked, "run-0")
            self._drop(batch)
        else:
            run = batch
        self.levels[0] = [*self.levels[0], run]
        at = 0
        while len(self.levels[at]) >= self.fanout:
            merged = self._write(self._merged(self.levels[at]), f"run-{at + 1}")
            self._drop(*self.levels[at])
            self.levels[at] = []
            if len(self.levels) == at + 1:
                self.levels.append([])
            self.levels[at + 1] = [*self.levels[at + 1], merged]
            at += 1

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs side by side, bucket by bucket; of each hash one run has the largest id."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("h1", "h2", F.col("n").alias("n2"), F.col("last").alias("last2")).hint("merge")
            count = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
            return a.join(b, ["h1", "h2"], "full_outer").select("h1", "h2", count.alias("n"), F.coalesce("last", "last2").alias("last"))

        return reduce(two, runs)

    def frequent(self, min_docs: int) -> DataFrame:
        """Hashes found in at least `min_docs` documents, over all runs."""
        return self._merged(self.runs()).filter(F.col("n") >= min_docs)


def _feed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, h1, h2): a row for each distinct line of each document; rows of equal id are one document."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")
    rows = docs.select(ids, F.explode(eligible_hashes(F.col(text_col), min_chars)).alias("h")).select("id", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    repeated = not docs.select(ids).groupBy("id").count().filter("count > 1").isEmpty()
    return rows.distinct() if repeated else rows


def drop_lists(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(x_id, dropped): for each id, the hashes of the lines its documents lose."""
    spark = docs.sparkSession
    feed = stash(_feed(docs, id_col, text_col, min_chars), "line-feed")
    cuts = feed.select("id").approxQuantile("id", [k / batches for k in range(1, batches)], 0.01)
    at = sum(((F.col("id").cast("double") >= c).cast("int") for c in cuts), F.lit(0))
    store = LineRuns(spark, fanout)
    for b in range(batches, 0, -1):
        store.add(feed.filter(at == b - 1))
    often = stash(store.frequent(min_docs).select("h1", "h2", "last"), "line-often")
    store.close()
    lost = feed.join(often, ["h1", "h2"]).filter(F.col("id") < F.col("last"))
    lists = stash(lost.groupBy(F.col("id").alias("x_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("dropped")), "line-lists")
    discard(feed, often)
    return lists


def _without_lost(rows: DataFrame, min_chars: int) -> DataFrame:
    """(row, n_lines, n_dropped, kept) of rows (row, lines, dropped), for lists of any length: lines are joined with the
    lost hashes of their row, and put together again."""
    rows = stash(rows.withColumn("at", F.monotonically_increasing_id()), "long-lists")
    lines = rows.select("at", F.posexplode("lines").alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = lines.select("at", "pos", "line", (F.length(key) >= min_chars).alias("counts"), line_hash(key).alias("h"))
    lost = rows.select("at", F.explode("dropped").alias("h"), F.lit(True).alias("lost"))
    stays = lines.join(lost, ["at", "h"], "left").filter(~(F.col("counts") & F.coalesce("lost", F.lit(False))))
    stays = stays.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("stays"))
    rows = rows.join(stays, "at", "left").withColumn("stays", F.coalesce("stays", F.array().cast("array<struct<pos:int,line:string>>")))
    return rows.select("row", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stays")).cast("long").alias("n_dropped"), F.array_join(F.transform("stays", lambda x: x["line"]), "\n").alias("kept"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """`docs` with text_col rewritten, and n_lines (before) and n_dropped added.

    A line's key is the line without surrounding white space, A-Z lower-cased. Keys of at least `min_chars` code points
    that are in at least `min_docs` documents stay only in documents of the largest id holding them; all their lines
    elsewhere go. Rows of equal id are one document, rows of null id another one that sorts first. Ids must be whole
    numbers. A null text counts as one empty line and comes out as an empty text. Only hashes are shuffled for the
    search; texts move once, to meet their lists of lost lines. Empty input gives no rows; the two added names replace
    columns of the same name.
    """
    whole_ids(docs, id_col)
    lists = drop_lists(docs, id_col, text_col, min_chars, min_docs, batches, fanout)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("r_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))
    long = F.size("dropped") > SEARCHED
    short = lists.select("x_id", F.when(~long, F.col("dropped")).alias("dropped"), long.alias("long"))
    joined = rows.join(short, F.col("r_id") == F.col("x_id"), "left")
    out = _searched(joined.filter("long IS NULL OR NOT long").select("row", "lines", "dropped"), min_chars)
    # only the rows with long lists go the other way
    some = stash(lists.filter(long), "long-lists")
    n = some.count()
    if n:
        some = F.broadcast(some.select("x_id")) if n <= 100_000 else some.select("x_id")
        held = rows.join(some, F.col("r_id") == F.col("x_id"), "left_semi")
        out = out.unionByName(_without_lost(held.join(lists.filter(long), F.col("r_id") == F.col("x_id")).select("row", "lines", "dropped"), min_chars))
    return _result(out, names, text_col)


def _searched(rows: DataFrame, min_chars: int) -> DataFrame:
    """As _without_lost, by a search of each line in its row's list."""
    lost = lambda x: (F.length(line_key(x)) >= min_chars) & F.array_contains("dropped", line_hash(line_key(x)))
    stays = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~lost(x)))
    rows = rows.select("row", F.size("lines").cast("long").alias("n_lines"), stays.alias("stays"))
    return rows.select("row", "n_lines", (F.col("n_lines") - F.size("stays")).alias("n_dropped"), F.array_join("stays", "\n").alias("kept"))


def _result(rows: DataFrame, names: list[str], text_col: str) -> DataFrame:
    return rows.select(*[(F.col("kept") if c == text_col else F.col("row").getField(c)).alias(c) for c in names], "n_lines", "n_dropped")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
often AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, i, line, often.k IS NOT NULL AND l.doc_id < often.last AS dropped FROM l LEFT JOIN often ON l.k = often.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op8_line_dedup(spark, sf_dir):
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))

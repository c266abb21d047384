"""Mixing sources to target weights: Efraimidis-Spirakis sampling with complete epochs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

#: Characters that count against a document's quality.
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1: falls with the share of symbol characters. Null or empty texts get 1."""
    share = 1 - F.length(F.translate(text, SYMBOLS, "")) / F.length(text)
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.25), 1 - 3 * share)).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u from a digest of the id: the order does not depend on partitions or reruns."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target): all sizes shared by weight, a target stopping at `cap` times its source.

    Sources in code point order, null last, take the weights in turn. Closed form of the repeated resharing: with the
    sources ordered by cap * size / weight, the first whose level fits under its own stop gives the common level. One
    row per source meets in one task, after partial sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ring = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(ring, (place % len(weights) + 1).cast("int")).cast("long"))
    stop = F.lit(cap) * F.col("source_size")
    order = Window.orderBy(F.col("stop_level"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    return (
        per.withColumn("stop_level", stop / F.col("weight"))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("stopped", F.coalesce(F.sum(stop).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.col("stopped")).cast("double") / F.col("open_weight").cast("double"))
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("stop_level"), F.struct("rank", "level"))).over(whole))
        .select(
            "source",
            "source_size",
            F.when(F.col("rank") < F.col("first.rank"), stop.cast("double"))
            .otherwise(F.least(F.col("first.level") * F.col("weight"), stop.cast("double")))
            .alias("target"),
        )
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: int = 20240229,
    buckets: int = 16384,
) -> tuple[DataFrame, DataFrame]:
    """(sizes, limits) of the mix: one row per document, and one per source with what it takes.

    Every document is taken for floor(target / source size) complete epochs; the rest of the target goes to documents
    in sampling-key order while they bring the sum nearer to it. The prefix sums are made in two steps, so that no
    source meets in one task: sums per key bucket first, then rows of the one bucket of each source where the target
    is reached. Sizes are kept in the shared folder, so the texts are read once.
    """
    size = word_count(F.col(text_col))
    key = sampling_key(F.col(id_col), quality_weight(F.col(text_col)), seed)
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")
    ).withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("key"))) * buckets)).cast("int"))
    sizes = stash(sizes, "mix-sizes")

    goal = source_targets(sizes, weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("epochs", F.floor(ratio + 1e-9)).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    goal = stash(goal, "mix-goal")

    by_source = Window.partitionBy("b_source").orderBy("bucket")
    sums = sizes.groupBy(F.col("source").alias("b_source"), "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.withColumn(
        "before", F.coalesce(F.sum("bucket_size").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    last = (
        sums.join(goal, F.col("b_source").eqNullSafe(F.col("source")))
        .filter(F.col("before") <= F.col("rest"))
        .groupBy(F.col("source").alias("l_source"), "rest")
        .agg(F.max(F.struct("bucket", "before")).alias("at"))
        .select("l_source", "rest", F.col("at.bucket").alias("l_bucket"), F.col("at.before").alias("before"))
    )
    inside = sizes.join(last, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("bucket") == F.col("l_bucket")))
    order = Window.partitionBy("l_source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        inside.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
        .filter(F.col("ahead") + F.col("size") / 2 <= F.col("rest"))
        .groupBy(F.col("l_source").alias("c_source"))
        .agg(F.max(F.struct("key", "doc_id", "size")).alias("cut"))
    )
    limits = (
        goal.join(last.drop("rest", "before"), F.col("source").eqNullSafe(F.col("l_source")), "left")
        .join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left")
        .select(F.col("source").alias("g_source"), "source_size", "target", "epochs", "l_bucket", "cut")
    )
    return sizes, stash(limits, "mix-limits")


def times_taken(key: Column, doc_id: Column, size: Column, bucket: Column) -> Column:
    """How often a document is taken, on rows joined with the limits."""
    within = (bucket == F.col("l_bucket")) & (F.struct(key.alias("key"), doc_id.alias("doc_id"), size.alias("size")) <= F.col("cut"))
    return F.col("epochs") + F.when((bucket < F.col("l_bucket")) | within, 1).otherwise(0)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken): what each document gives to the mix, in words.

    Nulls: a null text has size 0, a null source is a source of its own (last), a null id is an id like others.
    Repeated rows count each; rows equal in id, size and quality stand or fall together. Documents without words take
    0. Empty input gives no rows. Other columns are ignored, whatever their names.
    """
    sizes, limits = mix_plan(docs, **options)
    times = times_taken(F.col("key"), F.col("doc_id"), F.col("size"), F.col("bucket"))
    return sizes.join(limits, F.col("source").eqNullSafe(F.col("g_source"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken.

    Documents without words, null and empty texts among them, are never taken; a null source is one of its own. Repeated
    rows count each and fare alike. Empty input gives no rows. Columns keep their names, whatever they are.
    """
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    sizes, limits = mix_plan(docs, **options)
    buckets, seed = options.get("buckets", 16384), options.get("seed", 20240229)
    names = docs.columns
    size, key = word_count(F.col(text_col)), sampling_key(F.col(id_col), quality_weight(F.col(text_col)), seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source_col).alias("r_source"), F.col(id_col).alias("r_id"), size.alias("r_size"), key.alias("r_key"))
    rows = rows.withColumn("r_bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("r_key"))) * buckets)).cast("int"))
    times = times_taken(F.col("r_key"), F.col("r_id"), F.col("r_size"), F.col("r_bucket")).cast("int")
    return (
        rows.join(limits, F.col("r_source").eqNullSafe(F.col("g_source")))
        .filter(F.col("r_size") > 0)
        .select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
        .select(*[F.col("row").getField(c).alias(c) for c in names])
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5('20240229:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0)
         / CASE WHEN length(text) > 0 THEN greatest(0.25, 1 - 3 * (1 - CAST(length(translate(text, '#*$%&|<>', '')) AS DOUBLE) / length(text))) ELSE 1.0 END AS key
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, row_number() OVER o AS rank, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM per WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST)),
fit AS (
  SELECT arg_min(CAST(total - stopped AS DOUBLE) / CAST(open_weight AS DOUBLE), rank) AS level, min(rank) AS rank
  FROM leveled WHERE CAST(total - stopped AS DOUBLE) / CAST(open_weight AS DOUBLE) <= CAST(3 * source_size AS DOUBLE) / weight),
goal AS (
  SELECT l.source, l.source_size,
         CASE WHEN l.rank < f.rank THEN CAST(3 * l.source_size AS DOUBLE) ELSE least(f.level * l.weight, CAST(3 * l.source_size AS DOUBLE)) END AS target
  FROM leveled l, fit f),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS epochs FROM goal),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, greatest(0.0, p.target - p.epochs * p.source_size) AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN ahead + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""


def op2_mixing(spark, sf_dir):
    from .common import table

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

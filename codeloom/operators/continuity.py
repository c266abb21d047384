"""Continuity: which earlier symbol a renamed or moved one was, by equal or near shape hashes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidences of a unique and of one of several equal shapes, what corroboration adds, caps, and near shapes.
UNIQUE, UNIQUE_CAP, SEVERAL, SEVERAL_CAP, MORE, NEAR = 0.85, 0.95, 0.60, 0.70, 0.05, 4


def scope(qualified_name: Column) -> Column:
    """What is before the last point of a qualified name; null without one."""
    return F.when(qualified_name.contains("."), F.regexp_replace(qualified_name, r"\.[^.]*$", ""))


def shares_scope(a_file: Column, b_file: Column, a_name: Column, b_name: Column) -> Column:
    return (a_file == b_file) | F.coalesce((scope(a_name) == scope(b_name)) & (scope(a_name) != ""), F.lit(False))


def similar_name(a: Column, b: Column) -> Column:
    """Different names of four letters or more that begin or end with the same four, or are equal after the first four."""
    x, y = F.lower(a), F.lower(b)
    same = (F.substring(x, 1, 4) == F.substring(y, 1, 4)) | (F.right(x, F.lit(4)) == F.right(y, F.lit(4))) | (F.substring(x, 5, 1 << 30) == F.substring(y, 5, 1 << 30))
    return (a != b) & (F.least(F.length(x), F.length(y)) >= 4) & same


def continuity(symbols: DataFrame, history: DataFrame) -> DataFrame:
    """(symbol_id, previous_symbol_key, confidence, reason) of symbols (symbol_id, name, qualified_name, file_id, symbol_key,
    shape_hash) without history: the one they most likely were.

    Equal shapes first. Of one other symbol of the shape the confidence is high; of several, file, scope or a like name must
    speak for one. Else the nearest shape within four bits, of like name or the same scope. Partners of a shape are reduced
    to the best before rows are made, so shapes that many symbols share do not multiply.
    """
    s = symbols.filter("shape_hash IS NOT NULL").select("symbol_id", "name", "qualified_name", "file_id", "symbol_key", "shape_hash")
    fresh = s.join(history.select("symbol_id").distinct(), "symbol_id", "left_anti")
    size = s.groupBy("shape_hash").agg(F.count(F.lit(1)).alias("n"))
    # the first symbols of each shape by file, by scope and over all stand for its members: two of each, as one may be the symbol itself
    firsts = lambda keys: s.groupBy("shape_hash", *keys).agg(F.slice(F.array_sort(F.collect_set("symbol_id")), 1, 2).alias("two"))
    known = fresh.join(size, "shape_hash").filter("n > 1").withColumn("scope", scope(F.col("qualified_name")))
    by_file = firsts(["file_id"]).withColumnRenamed("two", "in_file")
    by_scope = s.withColumn("scope", scope(F.col("qualified_name"))).filter("scope IS NOT NULL AND scope <> ''").groupBy("shape_hash", "scope").agg(F.slice(F.array_sort(F.collect_set("symbol_id")), 1, 2).alias("in_scope"))
    over_all = firsts([]).withColumnRenamed("two", "in_all")
    other = lambda c: F.get(F.filter(F.col(c), lambda x: x != F.col("symbol_id")), F.lit(0))
    picked = known.join(by_file, ["shape_hash", "file_id"], "left").join(by_scope, ["shape_hash", "scope"], "left").join(over_all, "shape_hash", "left")
    picked = picked.select("symbol_id", "name", "qualified_name", "file_id", "n", F.coalesce(other("in_file"), other("in_scope"), other("in_all")).alias("p_id")).filter("p_id IS NOT NULL")
    p = s.select(F.col("symbol_id").alias("p_id"), F.col("name").alias("p_name"), F.col("qualified_name").alias("p_qualified"), F.col("file_id").alias("p_file"), "symbol_key", F.col("shape_hash").alias("p_hash"))
    both = picked.join(p, "p_id").withColumn("in_scope", shares_scope(F.col("file_id"), F.col("p_file"), F.col("qualified_name"), F.col("p_qualified"))).withColumn("like_name", similar_name(F.col("name"), F.col("p_name")))
    more = F.when(F.col("in_scope"), MORE).otherwise(0.0) + F.when(F.col("like_name"), MORE).otherwise(0.0)
    exact = both.filter("n = 2 OR in_scope OR like_name")
    value = F.when(F.col("n") == 2, F.least(F.lit(UNIQUE_CAP), UNIQUE + more)).otherwise(F.least(F.lit(SEVERAL_CAP), SEVERAL + more))
    exact = exact.select("symbol_id", F.col("symbol_key").alias("previous_symbol_key"), F.round(value, 2).alias("confidence"), F.when(F.col("n") == 2, "unique-shape").otherwise("one-of-shapes").alias("reason"))
    rest = fresh.join(size.filter("n > 1"), "shape_hash", "left_anti")
    return exact.unionByName(_nearest(rest, s))


def _nearest(rest: DataFrame, s: DataFrame) -> DataFrame:
    """The nearest other shape within NEAR bits: shapes meet on two of six parts, which no near pair can miss."""
    cuts = [64 * i // 6 for i in range(7)]
    part = [F.shiftrightunsigned("shape_hash", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(6)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), part[i].alias("x"), part[j].alias("y")) for k, (i, j) in enumerate(combinations(range(6), 2))])).alias("key")
    a = rest.select("symbol_id", "name", "qualified_name", "file_id", "shape_hash", keys)
    b = s.select(F.col("symbol_id").alias("p_id"), F.col("name").alias("p_name"), F.col("qualified_name").alias("p_qualified"), F.col("file_id").alias("p_file"), "symbol_key", F.col("shape_hash").alias("p_hash"), keys)
    distance = F.bit_count(F.col("shape_hash").bitwiseXOR(F.col("p_hash")))
    near = a.join(b, "key").filter("symbol_id <> p_id").withColumn("d", distance).filter(F.col("d") <= NEAR)
    near = near.filter(similar_name(F.col("name"), F.col("p_name")) | shares_scope(F.col("file_id"), F.col("p_file"), F.col("qualified_name"), F.col("p_qualified")))
    best = near.groupBy("symbol_id").agg(F.min(F.struct("d", "p_id", "symbol_key")).alias("best"))
    value = F.when(F.col("best.d") == 0, 0.8).when(F.col("best.d") <= 2, 0.6).otherwise(0.4)
    return best.select("symbol_id", F.col("best.symbol_key").alias("previous_symbol_key"), value.alias("confidence"), F.lit("near-shape").alias("reason"))

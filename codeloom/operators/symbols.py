"""Callers and callees, edge resolution, spans, budgets and ranking over symbol and edge frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

#: How many times as many rows as edges a step further is taken to make, for the number of its tasks.
FURTHER = 8
#: Pairs that a task of a join makes, on average, and tasks at most.
PAIRS_A_TASK, MOST_TASKS = 8_000_000, 10_000


def call_sites(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A row a call site: the caller with its file, and the callee's id."""
    return edges.join(symbols, edges["src"] == symbols["symbol_id"]).join(files, "file_id").select("edge_id", F.col("src").alias("caller_id"), F.col("name").alias("caller"), "file_id", "rel_path", "role", F.col("dst").alias("callee_id"))


def callees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_id, callee_id, callee, sites): distinct callees with their numbers of call sites; a missing target stays."""
    sites = edges.groupBy(F.col("src").alias("caller_id"), F.col("dst").alias("callee_id")).agg(F.count(F.lit(1)).alias("sites"))
    return sites.join(symbols.select(F.col("symbol_id").alias("callee_id"), F.col("name").alias("callee")), "callee_id", "left").select("caller_id", "callee_id", "callee", "sites")


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """`refs` (ref_id, file_id, to_name) with (to_id, tier): the smallest id of that name in the same file, else in an
    imported file, else anywhere. Every tier is reduced to a row a key before its join, so hot names do not multiply."""
    local = symbols.groupBy("file_id", F.col("name").alias("to_name")).agg(F.min("symbol_id").alias("id"))
    anywhere = local.groupBy("to_name").agg(F.min("id").alias("any_id"))
    imported = imports.join(local.withColumnRenamed("file_id", "to_file"), "to_file").groupBy(F.col("from_file").alias("file_id"), "to_name").agg(F.min("id").alias("import_id"))
    out = refs.join(local, ["file_id", "to_name"], "left").join(imported, ["file_id", "to_name"], "left").join(anywhere, "to_name", "left")
    tier = F.when(F.col("id").isNotNull(), "same_file").when(F.col("import_id").isNotNull(), "imported").when(F.col("any_id").isNotNull(), "global").otherwise("none")
    return out.select("ref_id", "file_id", "to_name", F.coalesce("id", "import_id", "any_id").alias("to_id"), tier.alias("tier"))


def blocks_of(low: Column, high: Column) -> Column:
    """(level, block) of the blocks that make up the lines from `low` to `high`: block b of level k holds the 2^k lines from
    b * 2^k. At most two a level, so the logarithm of the lines bounds them."""
    shifted = lambda x, k: F.call_function("shiftright", x, k)

    def at(k: Column) -> Column:
        first, end = -shifted(-low, k), shifted(high + 1, k)
        odd = lambda x: (first < end) & (x.bitwiseAND(F.lit(1)) == 1)
        ends = F.array(F.when(odd(first), first), F.when(odd(end), end - 1))
        return F.transform(F.filter(ends, lambda x: x.isNotNull()), lambda x: F.struct(k.alias("level"), x.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(high - low + 1)) - 1), at))


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The smallest span of the same file around each point (point_id, file_id, line): (point_id, span_id), null if none.

    Spans are cut into blocks of lines that keep the smallest span each, and a line asks the blocks around it, one a level.
    So rows grow with spans, lines and the logarithm of a span's lines, not with the overlaps.
    """
    ranges = spans.filter("line_start <= line_end").groupBy("file_id", F.col("line_start").cast("long").alias("low"), F.col("line_end").cast("long").alias("high")).agg(F.min("span_id").alias("span_id"))
    blocks = ranges.select("file_id", F.explode(blocks_of(F.col("low"), F.col("high"))).alias("at"), F.struct((F.col("high") - F.col("low")).alias("w"), "span_id").alias("span"))
    blocks = blocks.groupBy("file_id", "at.level", "at.block").agg(F.min("span").alias("span"))
    lines = points.select("file_id", F.col("line").cast("long").alias("line")).distinct()
    # the highest level is one number
    asked = lines.join(F.broadcast(blocks.agg(F.max("level").alias("top")))).select("file_id", "line", F.explode(F.sequence(F.lit(0), "top")).alias("level"))
    found = asked.withColumn("block", F.call_function("shiftright", F.col("line"), F.col("level"))).join(blocks, ["file_id", "level", "block"])
    best = found.groupBy("file_id", "line").agg(F.min("span").alias("best"))
    near = points.select("point_id", "file_id", F.col("line").cast("long").alias("line")).join(best, ["file_id", "line"], "left")
    return near.groupBy("point_id").agg(F.min("best").alias("best")).select("point_id", F.col("best.span_id").alias("span_id"))


def tasks_for(left: DataFrame, right: DataFrame, keys: list[str]) -> int:
    """How many tasks a join on `keys` should have by the pairs that it makes; read from counts of keys, one number a key."""
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(c)) for df, c in ((left, "x"), (right, "y"))]
    pairs = counts[0].join(counts[1], keys).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
    return min(MOST_TASKS, int(pairs / PAIRS_A_TASK) + 1)


def overlapping(hunks: DataFrame, spans: DataFrame, bucket: int = 8) -> DataFrame:
    """Distinct (hunk_id, span_id) of spans and hunks (hunk_id, file_id, start, end) that overlap in a file.

    A pair is made in one bucket of lines, that of the first line of both, and for the first hunk of an id that reaches the
    span. So pairs are made once, and none is moved or held to be compared with others. Spans whose id is not their own
    are few or none; pairs of those are made distinct.
    """
    cut = lambda df, a, b: df.withColumn(f"{a}_b", F.floor(F.col(a) / bucket)).withColumn("b", F.explode(F.sequence(f"{a}_b", F.floor(F.col(b) / bucket))))
    spans = spans.select("span_id", "file_id", "line_start", "line_end").distinct()
    ids = spans.groupBy("span_id").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("file_id", "line_start", "line_end")])
    single = cut(ids.filter("n = 1").drop("n"), "line_start", "line_end")
    shared = cut(spans.join(ids.filter("n > 1").select("span_id"), "span_id", "left_semi"), "line_start", "line_end")
    earlier = Window.partitionBy("hunk_id", "file_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    hunks = hunks.select("hunk_id", "file_id", "start", "end").filter("file_id IS NOT NULL")
    n = tasks_for(cut(hunks, "start", "end"), single, ["file_id", "b"])
    parts = cut(hunks.withColumn("reached", F.max("end").over(earlier)), "start", "end")

    def met(some: DataFrame) -> DataFrame:
        both = parts.repartition(n, "file_id", "b").join(some.repartition(n, "file_id", "b").hint("merge"), ["file_id", "b"])
        first = (F.col("b") == F.greatest("start_b", "line_start_b")) & (F.col("reached").isNull() | (F.col("reached") < F.col("line_start")))
        return both.filter((F.col("start") <= F.col("line_end")) & (F.col("end") >= F.col("line_start")) & first).select("hunk_id", "span_id")

    return met(single).unionByName(met(shared).distinct())


def most_frequent(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value of each group, the smallest of equal ones."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), value)).alias("best"))
    return best.select(group, F.col(f"best.{value}").alias(value), (-F.col("best.m")).alias("n"))


def within_budget(df: DataFrame, size: Column, order: list, budget: int, partition: str) -> DataFrame:
    """Rows in order until their sizes pass the budget; the row that crosses it stays, so each part keeps one or more."""
    before = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("_before") < budget).drop("_before")


def count_calls(edges: DataFrame, symbols: DataFrame, files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(symbol_id, sites, callers, caller_files, test_sites, test_files): call sites of each called symbol, distinct callers
    and their files, and those of test files. Three distinct counts make four rows of each, in `tasks` tasks."""
    ends = edges.select(F.col("src").alias("caller_id"), F.col("dst").alias("symbol_id")).join(symbols.select(F.col("symbol_id").alias("caller_id"), "file_id"), "caller_id").join(files.select("file_id", "role"), "file_id")
    in_tests = F.col("role") == "test"
    return dealt(ends, tasks, "symbol_id").groupBy("symbol_id").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("caller_id").alias("callers"), F.count_distinct("file_id").alias("caller_files"), F.count(F.when(in_tests, 1)).alias("test_sites"), F.count_distinct(F.when(in_tests, F.col("file_id"))).alias("test_files"))


def first_test_calls(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(to_name, from_id, line): the earliest line on which each test symbol calls a name."""
    tests = symbols.select(F.col("symbol_id").alias("from_id"), "file_id").join(files.filter("role = 'test'").select("file_id"), "file_id", "left_semi").select("from_id")
    return edges.join(tests, "from_id", "left_semi").groupBy("to_name", "from_id").agg(F.min("line").alias("line"))


def caller_bounds(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, resolved, by_name, definitions): call sites that are resolved to a symbol, and those that name it: the
    least and the most callers that it can have; and how many symbols share the name."""
    named = edges.groupBy(F.col("to_name").alias("name")).agg(F.count(F.lit(1)).alias("by_name"))
    sure = edges.filter("to_id IS NOT NULL").groupBy(F.col("to_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("resolved"))
    shared = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("definitions"))
    out = symbols.select("symbol_id", "name").join(sure, "symbol_id", "left").join(named, "name", "left").join(shared, "name")
    return out.select("symbol_id", F.coalesce("resolved", F.lit(0)).alias("resolved"), F.greatest(F.coalesce("by_name", F.lit(0)), F.coalesce("resolved", F.lit(0))).alias("by_name"), "definitions")


def drop_for_budget(files: DataFrame, symbols: DataFrame, size: Column, order: list, budget: int) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) that fit a budget together: file rows go first, from the end, then symbol rows; one symbol stays."""
    running = lambda df: df.withColumn("_sum", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    kept = running(symbols).withColumn("_k", F.row_number().over(Window.orderBy(*order))).filter((F.col("_sum") <= budget) | (F.col("_k") == 1))
    used = kept.agg(F.coalesce(F.max("_sum"), F.lit(0)).alias("_used"))
    left = running(files).join(F.broadcast(used)).filter(F.col("_sum") + F.col("_used") <= budget)
    return left.drop("_sum", "_used"), kept.drop("_sum", "_k")


def rank_tests(edges: DataFrame, tests: DataFrame, limit: int = 30, tasks: int | None = None) -> DataFrame:
    """The `limit` best tests of each symbol that is no test itself: direct callers among `tests` (test_id) score 100,
    callers through one more symbol 40. (symbol_id, test_id, distance, score, rank), of equal ones the smallest id first."""
    step = dealt(edges.select("src", "dst"), tasks, "src").distinct()
    direct = step.join(tests, F.col("src") == F.col("test_id")).select("test_id", F.col("dst").alias("symbol_id"))
    further = dealt(direct, tasks, "symbol_id").join(step, F.col("symbol_id") == F.col("src")).select("test_id", F.col("dst").alias("symbol_id"), F.lit(2).alias("distance"))
    found = direct.withColumn("distance", F.lit(1)).unionByName(further).filter("test_id <> symbol_id").join(tests.select(F.col("test_id").alias("symbol_id")), "symbol_id", "left_anti")
    # what a symbol's tests are counted, joined and ranked by is dealt once, in tasks for all the rows that steps make
    best = dealt(found, tasks and tasks * FURTHER, "symbol_id").groupBy("symbol_id", "test_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("symbol_id").orderBy("distance", "test_id"))
    return best.select("symbol_id", "test_id", "distance", F.when(F.col("distance") == 1, 100).otherwise(40).alias("score"), rank.alias("rank")).filter(F.col("rank") <= limit)

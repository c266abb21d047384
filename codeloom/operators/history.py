"""History operators: change coupling, churn, continuity of contracts, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

#: How many times as many pairs as rows commits are taken to make, for the number of their tasks.
PAIRS = 4


def half_up(x: Column, digits: int = 2) -> Column:
    """Round half towards positive infinity."""
    k = 10**digits
    return F.floor(x * k + 0.5) / k


def coupling(history: DataFrame, min_support: int = 2, max_commit_symbols: int = 50, limit: int | None = None, since: Column | None = None, tasks: int | None = None) -> DataFrame:
    """(target, partner, support, confidence, partner_commits) from rows (symbol_id, commit_sha, committed_at).

    Commits that touch more than `max_commit_symbols` symbols say nothing about coupling; this breadth bound also keeps
    the self-join on commits linear in the rows. Confidence is support over the target's effective commits.
    """
    from .graph import _checkpoint

    rows = _checkpoint(dealt(history.select("symbol_id", "commit_sha", "committed_at"), tasks, "commit_sha").distinct())
    narrow = dealt(rows, tasks, "commit_sha").groupBy("commit_sha").agg(F.count_distinct("symbol_id").alias("breadth")).filter(F.col("breadth") <= max_commit_symbols).select("commit_sha")
    recent = rows if since is None else rows.filter(F.col("committed_at") >= since)
    # a commit is one row with its symbols, so pairs are made within rows, each once
    grouped = dealt(recent, tasks, "commit_sha").join(narrow, "commit_sha").groupBy("commit_sha").agg(F.array_sort(F.collect_set("symbol_id")).alias("s"))
    grouped = _checkpoint(grouped)
    effective = grouped.select(F.explode("s").alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("effective"))
    commits = recent.groupBy(F.col("symbol_id").alias("partner")).agg(F.count(F.lit(1)).alias("partner_commits"))
    pairs = grouped.filter(F.size("s") > 1).select("s", F.posexplode("s").alias("i", "low")).select("low", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("high"))
    once = dealt(pairs, tasks and tasks * PAIRS, "low", "high").groupBy("low", "high").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= min_support)
    ends = F.explode(F.array(F.struct(F.col("low").alias("target"), F.col("high").alias("partner")), F.struct(F.col("high").alias("target"), F.col("low").alias("partner"))))
    support = once.select(ends.alias("e"), "support").select("e.target", "e.partner", "support")
    out = support.join(effective, "target").join(commits, "partner").select("target", "partner", "support", half_up(F.col("support") / F.col("effective")).alias("confidence"), "partner_commits")
    if limit is None:
        return out
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("support"), "partner_commits", "partner"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def churn(commits: DataFrame, top_authors: int = 2) -> DataFrame:
    """(file_id, commits, last_sha, last_at, authors): of rows (file_id, commit_sha, committed_at, author).

    `authors`: the most frequent ones, of equal ones the latest seen first, joined by commas.
    """
    total = commits.groupBy("file_id").agg(F.count(F.lit(1)).alias("commits"), F.max(F.struct("committed_at", "commit_sha")).alias("last"))
    by = commits.groupBy("file_id", "author").agg(F.count(F.lit(1)).alias("n"), F.max("committed_at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), F.desc("at"), "author"))
    names = by.withColumn("rank", rank).filter(F.col("rank") <= top_authors).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("rank", "author"))).alias("a"))
    names = names.select("file_id", F.array_join(F.transform("a", lambda x: x["author"]), ",").alias("authors"))
    return total.join(names, "file_id").select("file_id", "commits", F.col("last.commit_sha").alias("last_sha"), F.col("last.committed_at").alias("last_at"), "authors")


def diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key and status: added, removed or changed, of keyed rows; equal rows are left out. Nulls compare as values."""
    a = old.select(*key, F.struct(*fields).alias("before"))
    b = new.select(*key, F.struct(*fields).alias("after"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.select(*key, status.alias("status")).filter("status IS NOT NULL")

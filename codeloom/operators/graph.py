"""Graph operators over node and edge frames: ranks, reachability, paths, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the checkpoint folder, which all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank) of `nodes` (id) over distinct `edges` (src, dst) between them; the mass of sinks is lost.

    Each source is a row with all its targets, so a round moves ranks once to them, explodes, and sums by target before
    the shuffle. Lineage is cut every few rounds.
    """
    n = nodes.count()
    base = (1 - damping) / max(n, 1)
    edges = edges.select("src", "dst").distinct()
    edges = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    # hubs are split into rows of at most some thousand targets
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    lists = edges.groupBy("src", F.pmod(F.xxhash64("dst"), F.lit(64)).alias("some")).agg(F.collect_list("dst").alias("targets"))
    sources = _checkpoint(lists.join(degree, "src").select("src", "degree", "targets"))
    # only sources and targets need their ranks in between; all nodes get theirs at the end
    ranks = sources.select("src").distinct().select(F.col("src").alias("id"), F.lit(1.0 / max(n, 1)).alias("rank"))
    ids = _checkpoint(ranks.select("id"))
    for k in range(rounds):
        sent = sources.join(ranks, sources["src"] == ranks["id"]).select(F.explode("targets").alias("dst"), (F.col("rank") / F.col("degree")).alias("part"))
        flow = sent.groupBy("dst").agg(F.sum("part").alias("flow"))
        if k == rounds - 1:
            return nodes.select("id").join(flow, F.col("id") == F.col("dst"), "left").select("id", (F.lit(base) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        ranks = ids.join(flow, F.col("id") == F.col("dst"), "left").select("id", (F.lit(base) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            ranks = _checkpoint(ranks)
    return nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))


def reach(edges: DataFrame, starts: DataFrame, max_depth: int = 4, forward: bool = True, max_nodes: int | None = None) -> DataFrame:
    """(start, id, depth): nodes reachable from each of `starts` (start), the start excluded, with their least depth.

    A loop over depths: the frontier is joined with the edges, and an anti-join drops what has been seen. Only frontiers
    are written; what has been seen is their union. A level after which more than max_nodes are seen is the last.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = edges.select(F.col(a).alias("at"), F.col(b).alias("to")).distinct()
    frontier = seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth"))
    count = 0
    for depth in range(1, max_depth + 1):
        found = frontier.join(step, frontier["id"] == step["at"]).select("start", F.col("to").alias("id")).distinct()
        frontier = _checkpoint(found.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if max_nodes is not None:
            count += frontier.count()
            if count > max_nodes:
                break
    return seen.filter("depth > 0")


def shortest_path(edges: DataFrame, source: int, target: int, max_depth: int = 6) -> list[int] | None:
    """Nodes of a shortest path, of equal ones that of the smallest parents; None if there is none in reach.

    Only the parents on the one path are read by the driver, one row a level.
    """
    if source == target:
        return [source]
    spark = edges.sparkSession
    step = edges.select("src", "dst").distinct()
    seen = spark.createDataFrame([(source, None, 0)], "id long, parent long, depth int")
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.join(step, frontier["id"] == step["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = _checkpoint(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return None
        seen = _checkpoint(seen.unionByName(frontier))
        if not frontier.filter(F.col("id") == target).isEmpty():
            path = [target]
            while path[-1] != source:
                path.append(seen.filter(F.col("id") == path[-1]).first()["parent"])
            return path[::-1]
    return None


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node id connected with each node, direction ignored.

    Labels spread to neighbours and are then shortened through their own labels, so rounds grow with the logarithm of
    path lengths.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = _checkpoint(both)
    labels = _checkpoint(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["src"], "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("best"))
        root = step.groupBy(F.col("label").alias("r")).agg(F.min("best").alias("hook"))
        step = step.join(root, step["id"] == root["r"], "left").select("id", "label", F.least("best", F.coalesce("hook", "best")).alias("best"))
        step = _checkpoint(step)
        up = step.select(F.col("id").alias("u"), F.col("best").alias("higher"))
        after = _checkpoint(step.join(up, step["best"] == up["u"]).select("id", "label", F.col("higher").alias("next")))
        if after.filter("label <> next").isEmpty():
            return after.select("id", F.col("next").alias("component"))
        labels = after.select("id", F.col("next").alias("label"))

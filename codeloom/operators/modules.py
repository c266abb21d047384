"""Modules: clusters of files by the weights between them, their labels and measures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, reach
from .symbols import most_frequent

#: Weights by kind, the most sweeps, and the gains that count.
WEIGHTS = {"call": 1.0, "import": 2.0, "tests": 3.0, "service": 3.0}
SWEEPS, TIE, LEAST_GAIN = 20, 1e-12, 1e-6


def louvain(nodes: list[int], pairs: list[tuple[int, int, float]], total: float | None = None) -> dict[int, int]:
    """Community of each node, named by a node: one level, nodes in ascending order, until a sweep gains nothing.

    A node moves to the neighbouring community that gains most, k_in / W - tot * k / (2 W^2), from its own at 0; ties go to
    the smaller name. `total` is W, the sum of all node weights, where the pairs are a part of a larger graph.
    """
    near: dict[int, dict[int, float]] = {v: {} for v in nodes}
    for a, b, w in pairs:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    weight = {v: sum(near[v].values()) for v in nodes}
    whole = sum(weight.values()) if total is None else total
    at, tot = {v: v for v in nodes}, dict(weight)
    if whole <= 0:
        return at
    for _ in range(SWEEPS):
        gained, moved = 0.0, False
        for v in sorted(nodes):
            own, k = at[v], weight[v]
            tot[own] -= k
            inside: dict[int, float] = {}
            for u, w in near[v].items():
                inside[at[u]] = inside.get(at[u], 0.0) + w
            best, best_gain = own, 0.0
            base = inside.get(own, 0.0) / whole - tot[own] * k / (2 * whole * whole)
            for c in sorted(inside):
                gain = inside[c] / whole - tot[c] * k / (2 * whole * whole) - base if c != own else 0.0
                if gain > best_gain + TIE or (abs(gain - best_gain) <= TIE and c < best and gain > 0):
                    best, best_gain = c, gain
            tot[best] += k
            if best != own:
                at[v], moved, gained = best, True, gained + best_gain
        if not moved or gained < LEAST_GAIN:
            break
    return at


def symmetric(weights: DataFrame) -> DataFrame:
    """(a, b, w), a < b: weighted sums over kinds and both directions of (from_file, to_file, kind, weight)."""
    factor = F.create_map(*[F.lit(x) for item in WEIGHTS.items() for x in item])[F.col("kind")]
    rows = weights.filter("from_file <> to_file").select(F.least("from_file", "to_file").alias("a"), F.greatest("from_file", "to_file").alias("b"), (F.col("weight") * F.coalesce(factor, F.lit(1.0))).alias("w"))
    return rows.groupBy("a", "b").agg(F.sum("w").alias("w"))


def communities(files: DataFrame, weights: DataFrame) -> DataFrame:
    """(file_id, community) of files (file_id). Clusters never cross connected components, so each component is a group of
    its own, with the total weight of the whole graph; within one the sweeps are sequential by definition."""
    pairs = symmetric(weights)
    total = pairs.agg(F.sum("w")).first()[0]
    total = 2.0 * (total or 0.0)
    nodes = files.select(F.col("file_id").alias("id"))
    comp = components(nodes, pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = comp.select("component", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("w"))
    rows = rows.unionByName(pairs.join(comp.withColumnRenamed("id", "a"), "a").select("component", "a", "b", "w"))

    def run(table: pa.Table) -> pa.Table:
        got = table.select(["a", "b", "w"]).to_pydict()
        nodes = [a for a, b in zip(got["a"], got["b"], strict=True) if b is None]
        at = louvain(nodes, sorted((a, b, w) for a, b, w in zip(got["a"], got["b"], got["w"], strict=True) if b is not None), total)
        return pa.table({"file_id": pa.array(list(at), pa.int64()), "community": pa.array(list(at.values()), pa.int64())})

    return rows.groupBy("component").applyInArrow(run, "file_id long, community long")


def module_tables(files: DataFrame, weights: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """members (file_id, module_id), modules and module_edges of files (file_id, rel_path, language).

    Modules are numbered by their smallest file. A label is the most frequent top folder (for files at the root, their
    names without extension), `#n` added to the n-th further module of a label. Cohesion is the share of weight that stays
    inside (1 without weight); centrality the sum of ranks of symbols that can be ranked.
    """
    found = communities(files, weights)
    first = found.groupBy("community").agg(F.min("file_id").alias("low"))
    place = F.row_number().over(Window.orderBy("low")).cast("long")
    members = found.join(first.select("community", place.alias("module_id")), "community").select("file_id", "module_id")
    placed = files.join(members, "file_id")
    top = F.when(F.col("rel_path").contains("/"), F.substring_index("rel_path", "/", 1)).otherwise(F.regexp_replace("rel_path", r"\.[^.]*$", ""))
    label = most_frequent(placed.withColumn("top", top), "module_id", "top").select("module_id", F.col("top").alias("base"))
    tongue = most_frequent(placed.filter("language IS NOT NULL"), "module_id", "language").select("module_id", "language")
    number = F.row_number().over(Window.partitionBy("base").orderBy("module_id")) - 1
    label = label.withColumn("label", F.when(number > 0, F.concat_ws("#", "base", number.cast("string"))).otherwise(F.col("base"))).drop("base")
    a, b = members.select(F.col("file_id").alias("from_file"), F.col("module_id").alias("from_id")), members.select(F.col("file_id").alias("to_file"), F.col("module_id").alias("to_id"))
    between = weights.join(a, "from_file").join(b, "to_file")
    edges = between.filter("from_id <> to_id").groupBy("from_id", "to_id", "kind").agg(F.sum("weight").alias("weight"))
    factor = F.create_map(*[F.lit(x) for item in WEIGHTS.items() for x in item])[F.col("kind")]
    flow = between.withColumn("w", F.col("weight") * F.coalesce(factor, F.lit(1.0)))
    sides = flow.select(F.col("from_id").alias("module_id"), F.when(F.col("from_id") == F.col("to_id"), F.col("w")).otherwise(0.0).alias("inside"), "w")
    sides = sides.unionByName(flow.filter("from_id <> to_id").select(F.col("to_id").alias("module_id"), F.lit(0.0).alias("inside"), "w"))
    cohesion = sides.groupBy("module_id").agg((F.sum("inside") / F.sum("w")).alias("cohesion"))
    central = symbols.filter("is_rankable").join(members, "file_id").groupBy("module_id").agg(F.sum("pagerank").alias("centrality"), F.count(F.lit(1)).alias("symbols"))
    size = members.groupBy("module_id").agg(F.count(F.lit(1)).alias("size"))
    modules = size.join(label, "module_id", "left").join(tongue, "module_id", "left").join(cohesion, "module_id", "left").join(central, "module_id", "left")
    modules = modules.select("module_id", "label", "language", "size", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("cohesion", F.lit(1.0)).alias("cohesion"), F.coalesce("centrality", F.lit(0.0)).alias("centrality"))
    return {"members": members, "modules": modules, "module_edges": edges}


def reachable_groups(edges: DataFrame, start: int, max_depth: int = 4, outward: bool = True) -> DataFrame:
    """(id, depth) of the modules or boundaries that one depends on, or that depend on it, over (from_id, to_id)."""
    pairs = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return reach(pairs, edges.sparkSession.createDataFrame([(start,)], "start long"), max_depth, forward=outward).select("id", "depth")


def import_closure(imports: DataFrame, file_id: int, max_depth: int = 4, max_nodes: int = 5000) -> DataFrame:
    """(id, depth) of the files that a file imports, over resolved imports; a level that passes max_nodes is the last."""
    pairs = imports.filter("resolved_file_id IS NOT NULL").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst"))
    return reach(pairs, imports.sparkSession.createDataFrame([(file_id,)], "start long"), max_depth, max_nodes=max_nodes).select("id", "depth")



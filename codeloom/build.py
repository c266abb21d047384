"""The index of a source tree, from its files to all derived tables, each written before the next is made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Index
from .extract import files as X
from .functions.text import target_host, target_path
from .operators import derive, graph, history, lookups, modules, services
from .operators import symbols as S
from .operators.similarity import with_shape_hash
from .sources import git, manifests, store, tree

#: Version of the history rows; another one makes all watermarks stale.
HISTORY_VERSION = 1


def _texts(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, content) of the tree's manifests, protocol files and YAML files."""
    path = F.col("rel_path")
    names = tree.listing(spark, root).filter(path.rlike(r"(?i)(\.proto|\.ya?ml|(^|/)(package\.json|pyproject\.toml|Cargo\.toml|go\.mod|go\.work|composer\.json|requirements[^/]*\.txt))$") & ~tree.skipped(path))
    return tree.with_contents(names, root).select("rel_path", F.decode("content", "UTF-8").alias("content"))


def build(spark: SparkSession, root: str, out: str, old: dict[str, DataFrame] | None = None, with_history: bool = True, **options) -> Index:
    """Scan `root`, and write the tables of its index as Parquet folders under `out`; `options` are those of `tree.scan`.

    With the tables of an `old` index, files of equal content are not parsed again: their extracted records are kept.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("error").parquet(f"{out.rstrip('/')}/{name}")
        return spark.read.parquet(f"{out.rstrip('/')}/{name}")

    t: dict[str, DataFrame] = {}
    t["files"] = kept(tree.scan(spark, root, **options), "files")
    parsed = X.extracted(t["files"])
    if old is not None and "records" in old:
        work, same = store.gated(old["files"], t["files"])
        # ids follow paths, so kept records take the file's new id
        ids = t["files"].select("rel_path", F.col("file_id").alias("new_id"))
        reused = old["records"].join(same.select("rel_path"), "rel_path", "left_semi").join(ids, "rel_path").withColumn("file_id", F.col("new_id")).select(*parsed.columns)
        parsed = X.extracted(work).unionByName(reused)
    t["records"] = kept(parsed, "records")
    texts = kept(_texts(spark, root), "texts")
    t["imports"] = kept(derive.resolve_imports(X.flat(t["records"], "imports"), t["files"]), "imports")
    syms = X.symbols(t["records"])
    hashable = F.col("kind").isin("function", "method", "constructor") & (F.col("symbol_role") != "declaration") & (F.col("loc") >= 4)
    syms = kept(with_shape_hash(syms.withColumn("body", F.when(hashable, F.col("body"))), "body", "shape_hash"), "symbols_unranked")
    refs = kept(X.edges(t["records"], syms), "references")
    known = t["imports"].filter("resolved_file_id IS NOT NULL").select(F.col("file_id").alias("from_file"), F.col("resolved_file_id").alias("to_file")).distinct()
    resolved = S.resolve(refs.select(F.col("edge_id").alias("ref_id"), "file_id", "to_name"), syms, known)
    edges = refs.join(resolved.select(F.col("ref_id").alias("edge_id"), "to_id", "tier"), "edge_id").select("edge_id", "from_id", "to_id", "to_name", "kind", "line", "file_id", "tier")
    t["edges"] = kept(derive.test_edges(edges, syms, t["files"]), "edges")
    ranks = graph.pagerank(lookups.rankable_ids(syms).withColumnRenamed("symbol_id", "id"), lookups.rankable_edges(t["edges"], syms))
    t["symbols"] = kept(store.with_ranks(syms, ranks), "symbols")

    routes = X.flat(t["records"], "routes").drop("place")
    protos = manifests.proto_routes(texts)
    # protocol files are no parsed sources: their routes have ids of files below 1
    protos = protos.withColumn("file_id", -F.abs(F.xxhash64("rel_path"))).select(*[F.col(c) if c in protos.columns or c == "file_id" else F.lit(None).cast("string").alias(c) for c in routes.columns])
    routes = derive.resolve_handlers(routes.unionByName(protos), t["symbols"]).withColumn("route_id", F.monotonically_increasing_id() + 1)
    t["routes"] = kept(routes, "routes")
    calls = X.flat(t["records"], "service_calls").drop("place")
    first = t["symbols"].groupBy("file_id", F.col("qualified_name").alias("caller")).agg(F.min("symbol_id").alias("symbol_id"))
    calls = calls.join(first, ["file_id", "caller"], "left").withColumn("path", F.when(F.col("protocol") == "http", target_path(F.col("raw_target")))).withColumn("host", target_host(F.col("raw_target")))
    t["service_calls"] = kept(calls.withColumn("normalized_path", F.col("path")).withColumn("call_id", F.monotonically_increasing_id() + 1), "service_calls")
    t["links"] = kept(services.link_table(services.resolve_links(t["service_calls"], t["routes"], manifests.service_hosts(texts)), t["service_calls"], t["routes"]), "links")
    keys = X.flat(t["records"], "config_keys").withColumn("point_id", F.monotonically_increasing_id())
    spans = t["symbols"].filter(F.col("kind").isin("function", "method", "constructor")).select(F.col("symbol_id").alias("span_id"), "file_id", "line_start", "line_end")
    t["config_keys"] = kept(keys.join(S.enclosing(keys.select("point_id", "file_id", "line"), spans), "point_id").withColumnRenamed("span_id", "symbol_id").drop("point_id", "place"), "config_keys")
    t["external_dependencies"] = kept(manifests.dependencies(texts), "external_dependencies")

    weights = kept(derive.file_weights(t["edges"], t["symbols"], t["imports"], t["links"]), "file_weights")
    for name, df in modules.module_tables(t["files"], weights, t["symbols"]).items():
        t[name] = kept(df, name)
    # every path may make a folder a boundary, manifests with their contents
    every = t["files"].select("rel_path", F.lit("").alias("content")).unionByName(texts)
    roots = kept(manifests.boundary_roots(every), "boundary_roots")
    t["boundary_members"] = kept(manifests.boundary_members(t["files"], roots), "boundary_members")
    t["boundaries"] = kept(manifests.boundaries(roots, t["boundary_members"]), "boundaries")
    named = t["boundary_members"].join(t["boundaries"].select("root", "boundary_id"), "root")
    t["boundary_edges"] = kept(derive.rollup(weights.filter("kind <> 'tests'"), named, "boundary_id"), "boundary_edges")
    t["lines"] = kept(t["files"].select("file_id", F.posexplode(F.split("content", "\n")).alias("line", "text")), "lines")
    if with_history and "://" not in root and git.is_repository(root):
        t |= _history(spark, root, t, kept)
    return Index(t)


def _history(spark: SparkSession, root: str, t: dict[str, DataFrame], kept) -> dict[str, DataFrame]:
    """history, file_churn and watermarks of a repository's files."""
    patches = kept(git.file_patches(t["files"].select("file_id", "rel_path"), root), "patches")
    meta = patches.select("commit_sha", "file_id", "committed_at", "author", "subject").dropDuplicates(["commit_sha", "file_id"])
    hunks = git.patch_rows(patches).join(meta.select("commit_sha", "file_id", "committed_at"), ["commit_sha", "file_id"])
    rows = derive.history_rows(hunks, lookups.with_history(t["symbols"]), F.current_date())
    authors = meta.groupBy("commit_sha").agg(F.max("author").alias("author"), F.max("subject").alias("subject"))
    rows = rows.join(authors, "commit_sha").withColumn("pr_number", git.pr_number(F.col("subject")))
    marks = t["files"].select("rel_path", "hash", F.lit("follow").alias("options"), F.lit(HISTORY_VERSION).alias("version"))
    return {"history": kept(rows, "history"), "file_churn": kept(history.churn(meta), "file_churn"), "watermarks": kept(marks, "watermarks")}


def export(index: Index, path: str, root: str | None = None) -> dict:
    """A bundle of an index's tables; texts and lines stay out."""
    tables = {n: df.drop("content") if n == "files" else df for n, df in index.tables.items() if n not in ("lines", "records")}
    return store.Bundle(index.spark, path).export(tables, {"head": git.head(root), "remote": git.remote(root)} if root else None)

"""Writes: keyed upserts, hash gates, pruning, watermarks, and snapshots of all tables with a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the layout of snapshots and bundles.
FORMAT = 1
#: The key of each kept table, and the column that names the file a row hangs on, if any.
TABLES = {
    "files": ("file_id", None), "symbols": ("symbol_id", "file_id"), "edges": ("edge_id", "file_id"), "file_imports": ("import_id", "file_id"), "routes": ("route_id", "file_id"),
    "service_calls": ("call_id", "file_id"), "service_links": ("link_id", None), "config_keys": ("config_id", "file_id"), "external_dependencies": (None, None), "file_churn": ("file_id", None),
    "symbol_history": (None, None), "modules": ("module_id", None), "module_members": ("file_id", None), "boundaries": ("boundary_id", None), "boundary_members": ("file_id", None), "continuity": (None, None),
}


def classify_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path, status) of files (rel_path, hash): added, removed, dirty or unchanged."""
    a, b = old.select("rel_path", F.col("hash").alias("was")), new.select("rel_path", F.col("hash").alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "dirty").otherwise("unchanged")
    return a.join(b, "rel_path", "full_outer").select("rel_path", status.alias("status"))


def gated(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to parse, kept) of files (rel_path, hash, role, ...): files whose hash changed or that are new; and the old rows of
    the others, their role refreshed."""
    was = old.select("rel_path", F.col("hash").alias("_was"))
    work = new.join(was, "rel_path", "left").filter(F.col("_was").isNull() | (F.col("_was") != F.col("hash"))).drop("_was")
    fresh = new.select("rel_path", F.col("hash").alias("_is"), *[F.col(c).alias(f"_{c}") for c in ("role", "is_vendor", "is_generated") if c in new.columns and c in old.columns])
    kept = old.join(fresh, "rel_path").filter(F.col("hash") == F.col("_is"))
    return work, kept.select(*[F.col(f"_{c}").alias(c) if f"_{c}" in kept.columns and c != "hash" else F.col(c) for c in old.columns])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those with their keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`old` and those rows of `new` whose key it does not hold; of equal keys in `new` the least row counts."""
    rest = [c for c in new.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*") if rest else new.select(*key).distinct()
    return old.unionByName(once.join(old.select(*key), key, "left_anti").select(*old.columns))


def replace_scope(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """`old` without the rows of the scopes that `new` has rows of, and `new`: delete, then insert."""
    return old.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new.select(*old.columns))


def wipe_dependents(tables: dict[str, DataFrame], gone_files: DataFrame) -> dict[str, DataFrame]:
    """Tables without what hangs on the files (file_id): their symbols and rows go; calls to their symbols lose their
    target, so that they are resolved again."""
    out = {}
    gone = gone_files.select("file_id").distinct()
    lost = tables["symbols"].join(gone, "file_id", "left_semi").select(F.col("symbol_id").alias("lost_id"))
    for name, df in tables.items():
        hangs = TABLES.get(name, (None, None))[1]
        if name in ("files", "module_members", "boundary_members", "file_churn") or hangs:
            df = df.join(gone, "file_id", "left_anti")
        elif name in ("symbol_history", "continuity"):
            df = df.join(lost.withColumnRenamed("lost_id", "symbol_id"), "symbol_id", "left_anti")
        if name == "edges" and "to_id" in df.columns:
            df = df.join(lost, F.col("to_id") == F.col("lost_id"), "left").withColumn("to_id", F.when(F.col("lost_id").isNull(), F.col("to_id"))).drop("lost_id")
        out[name] = df
    return out


def prune(files: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, gone) of files (rel_path, ...): those not among `seen` (rel_path) go; rows of external bundles stay."""
    external = F.coalesce(F.col("external_bundle_id").isNotNull(), F.lit(False)) if "external_bundle_id" in files.columns else F.lit(False)
    marked = files.join(seen.select("rel_path").distinct().withColumn("_seen", F.lit(True)), "rel_path", "left").withColumn("_stays", F.coalesce("_seen", F.lit(False)) | external)
    return marked.filter("_stays").select(*files.columns), marked.filter("NOT _stays").select(*files.columns)


def with_ranks(symbols: DataFrame, ranks: DataFrame) -> DataFrame:
    """`symbols` with pagerank from ranks (id, rank): 0 where a symbol cannot be ranked or has none."""
    rest = symbols.drop("pagerank")
    joined = rest.join(ranks.select(F.col("id").alias("symbol_id"), F.col("rank").alias("_rank")), "symbol_id", "left")
    return joined.withColumn("pagerank", F.when(F.col("is_rankable"), F.coalesce("_rank", F.lit(0.0))).otherwise(0.0)).drop("_rank")


def stale_watermarks(files: DataFrame, marks: DataFrame, options: str, version: int) -> DataFrame:
    """Files (rel_path, hash) whose watermark (rel_path, hash, options, version) is missing or of other content, options or
    algorithm: the work that is left."""
    done = marks.filter((F.col("options") == options) & (F.col("version") == version)).select("rel_path", "hash")
    return files.join(done, ["rel_path", "hash"], "left_anti")


def git_state(old: dict, new: dict) -> dict:
    """`old` with the values of `new`; a missing remote keeps the known one."""
    return {**old, **{k: v for k, v in new.items() if v is not None or k != "remote"}}


class Bundle:
    """A snapshot of tables at `path`: a Parquet folder a table, and a manifest that is written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def export(self, tables: dict[str, DataFrame], meta: dict | None = None) -> dict:
        """Write all tables, then the manifest with row counts and the roster: a hash over the sorted (rel_path, hash)."""
        counts = {}
        for name, df in tables.items():
            df.write.mode("error").parquet(f"{self.path}/{name}")
            counts[name] = self.spark.read.parquet(f"{self.path}/{name}").count()
        manifest = {"format": FORMAT, "id": uuid.uuid4().hex, "tables": counts, "roster": roster(tables["files"]).first()["roster"] if "files" in tables else None, **(meta or {})}
        self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("error").text(f"{self.path}/_manifest")
        return manifest

    def manifest(self) -> dict:
        """The manifest, checked: its format is known and every table has the rows that it tells."""
        rows = self.spark.read.text(f"{self.path}/_manifest").take(2)
        if len(rows) != 1:
            raise ValueError("a bundle has one manifest")
        found = json.loads(rows[0][0])
        if found.get("format") != FORMAT:
            raise ValueError(f"format {found.get('format')} is not known")
        return found

    def load(self) -> dict[str, DataFrame]:
        found = self.manifest()
        tables = {n: self.spark.read.parquet(f"{self.path}/{n}") for n in found["tables"]}
        for name, rows in found["tables"].items():
            if tables[name].count() != rows:
                raise ValueError(f"{name} does not have {rows} rows")
        if found["roster"] and roster(tables["files"]).first()["roster"] != found["roster"]:
            raise ValueError("the roster of files differs")
        return tables


def roster(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted lines of path and hash. Lines are hashed a range at a time, so no task holds all."""
    lines = files.select("rel_path", F.concat_ws(" ", "rel_path", "hash").alias("line")).repartitionByRange(F.col("rel_path").asc())
    # groups of paths by their hash keep each list short; the groups' digests are hashed in order
    grouped = lines.groupBy(F.substring(F.md5("rel_path"), 1, 3).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("d"))
    return grouped.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "\n"), 256).alias("roster"))


def external_layer(routes: DataFrame, bundle_routes: DataFrame, bundle_id: str) -> DataFrame:
    """`routes` and those of another repository's bundle, marked with its id; an earlier layer of that id is replaced."""
    own = routes if "external_bundle_id" in routes.columns else routes.withColumn("external_bundle_id", F.lit(None).cast("string"))
    kept = own.filter(~F.coalesce(F.col("external_bundle_id") == bundle_id, F.lit(False)))
    return kept.unionByName(bundle_routes.withColumn("external_bundle_id", F.lit(bundle_id)), allowMissingColumns=True)

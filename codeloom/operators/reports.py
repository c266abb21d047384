"""Answers made of several queries: context of a symbol, checks before a change, change detection, architecture, contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evidence, lookups
from .derive import groups_of_callees
from .graph import reach
from .history import diff
from .symbols import overlapping

#: How precise an answer is.
EXACT, BOUNDED, BY_NAME, GUESS, UNKNOWN = "exact", "bounded", "name-aggregate", "heuristic", "unknown"
#: Fields of a contract that are compared.
CONTRACT_FIELDS = "protocol method path operation topic queue exchange service framework".split()


def precision(resolved: Column, by_name: Column) -> Column:
    """How far counts of callers can be trusted: exact if no call by name is open, bounded if some are resolved."""
    return F.when(by_name.isNull(), UNKNOWN).when(resolved == by_name, EXACT).when(resolved > 0, BOUNDED).otherwise(BY_NAME)


def changed_symbols(hunks: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (symbol_id) of symbols whose lines overlap the changed ranges (rel_path, start, end), from 0."""
    placed = hunks.join(files.select("file_id", "rel_path"), "rel_path").select(F.monotonically_increasing_id().alias("hunk_id"), "file_id", "start", "end")
    spans = symbols.select(F.col("symbol_id").alias("span_id"), "file_id", "line_start", "line_end")
    return overlapping(placed, spans).select(F.col("span_id").alias("symbol_id")).distinct()


def detect_changes(hunks: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, caller_depth: int = 2) -> dict[str, DataFrame]:
    """direct: the symbols that changes touch; callers: those that call them over up to caller_depth steps and are not
    touched themselves, with their least depth; both by rank."""
    direct = changed_symbols(hunks, symbols, files)
    calls = edges.filter("kind = 'call' AND to_id IS NOT NULL").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    back = reach(calls, direct.select(F.col("symbol_id").alias("start")), caller_depth, forward=False)
    far = back.groupBy(F.col("id").alias("symbol_id")).agg(F.min("depth").alias("depth")).join(direct, "symbol_id", "left_anti")
    shown = symbols.select("symbol_id", "qualified_name", "kind", "file_id", "pagerank")
    return {"direct": direct.join(shown, "symbol_id").orderBy(F.desc("pagerank"), "symbol_id"), "callers": far.join(shown, "symbol_id").orderBy(F.desc("pagerank"), "symbol_id")}


def trace_summary(reached: DataFrame, symbols: DataFrame, files: DataFrame, top: int = 10, samples: int = 3) -> dict[str, DataFrame]:
    """Of reached (id, depth): counts by depth; the files with most, of equal ones the nearest, with up to `samples` names."""
    placed = reached.join(symbols.select(F.col("symbol_id").alias("id"), "qualified_name", "file_id"), "id").join(files.select("file_id", "rel_path"), "file_id")
    order = Window.partitionBy("rel_path").orderBy("depth", "id")
    named = placed.withColumn("k", F.row_number().over(order))
    per = named.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("nearest"), F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.struct("k", "qualified_name")))).alias("s"))
    per = per.select("rel_path", "n", "nearest", F.transform("s", lambda x: x["qualified_name"]).alias("samples"))
    return {"depths": reached.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).orderBy("depth"), "files": per.orderBy(F.desc("n"), "nearest", "rel_path").limit(top)}


def architecture(tables: dict[str, DataFrame], top: int = 10) -> dict[str, DataFrame]:
    """Languages, roles, top symbols, hotspots, entry points, top folders and routes by framework."""
    files, symbols = tables["files"], tables["symbols"]
    visible = symbols.join(files, "file_id").filter(lookups.lens())
    out = {
        "languages": files.groupBy("language").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language"),
        "roles": files.groupBy("role").agg(F.count(F.lit(1)).alias("files")).orderBy("role"),
        "top_symbols": visible.orderBy(F.desc("pagerank"), "symbol_id").limit(top).select("symbol_id", "qualified_name", "pagerank"),
        "hotspots": visible.orderBy(F.desc(F.coalesce("cognitive", F.lit(0))), F.desc("pagerank"), "symbol_id").limit(top).select("symbol_id", "qualified_name", "cognitive", "pagerank"),
        "folders": files.groupBy(F.substring_index("rel_path", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "folder").limit(top),
    }
    if "edges" in tables:
        called = tables["edges"].filter("kind = 'call' AND to_id IS NOT NULL").select(F.col("to_id").alias("symbol_id")).distinct()
        calling = tables["edges"].filter("kind = 'call' AND to_id IS NOT NULL").groupBy(F.col("from_id").alias("symbol_id")).agg(F.count_distinct("to_id").alias("callees"))
        out["entry_points"] = visible.filter("is_rankable").join(called, "symbol_id", "left_anti").join(calling, "symbol_id").orderBy(F.desc("callees"), "symbol_id").limit(top).select("symbol_id", "qualified_name", "callees")
    if "routes" in tables:
        out["routes"] = tables["routes"].groupBy("framework").agg(F.count(F.lit(1)).alias("routes")).orderBy(F.desc("routes"), "framework")
    return out


def context(symbol_id: int, tables: dict[str, DataFrame], callers: int = 10, callees: int = 10, tests: int = 10, commits: int = 5, caller_depth: int = 3) -> dict[str, DataFrame]:
    """What one needs to know of a symbol: itself, callers, callees, transitive callers, tests and their state, risk with its
    largest parts, routes, configuration, history, module and boundary. Lists are cut, each with its total."""
    symbols, files, edges = tables["symbols"], tables["files"], tables["edges"]
    spark = symbols.sparkSession
    one = spark.createDataFrame([(symbol_id,)], "symbol_id long")
    calls = edges.filter("kind = 'call' AND to_id IS NOT NULL")
    shown = symbols.select("symbol_id", "qualified_name", "kind", "pagerank")
    cut = lambda rows, order, n: lookups.first_of(rows.withColumn("all", F.lit(1)), ["all"], order, n).drop("all")
    into = calls.filter(F.col("to_id") == symbol_id).groupBy(F.col("from_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("sites"))
    out_of = edges.filter((F.col("kind") == "call") & (F.col("from_id") == symbol_id)).groupBy(F.col("to_id").alias("symbol_id"), "to_name").agg(F.count(F.lit(1)).alias("sites"))
    back = reach(calls.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), one.select(F.col("symbol_id").alias("start")), caller_depth, forward=False)
    ranked = evidence.ranked_tests(one, edges, symbols, files, tables.get("lines"))
    signals = evidence.risk_signals(one, tables, caller_depth, ranked)
    out = {
        "symbol": lookups.projected(symbols.join(one, "symbol_id", "left_semi")),
        "callers": cut(into.join(shown, "symbol_id"), [F.desc("pagerank"), "symbol_id"], callers),
        "callees": cut(out_of.join(shown, "symbol_id", "left"), [F.desc("sites"), "to_name"], callees),
        "transitive_callers": back.filter("depth > 1").groupBy("depth").agg(F.count(F.lit(1)).alias("n")),
        "tests": cut(ranked, ["place"], tests),
        "coverage": evidence.coverage_states(one, ranked, files),
        "risk": evidence.risk(signals),
        "contributions": evidence.contributions(signals, 5).filter("contribution <> 0"),
    }
    if "routes" in tables:
        out["routes"] = cut(lookups.handled_routes(tables["routes"], symbol_id), ["path", "method"], 12)
    if "config_keys" in tables:
        out["config_keys"] = cut(lookups.config_keys_of(tables["config_keys"], symbol_id), ["key"], 12)
    if "links" in tables:
        out["links"] = cut(tables["links"].filter((F.col("caller_id") == symbol_id) | (F.col("handler_id") == symbol_id)), [F.desc("confidence"), "link_id"], 12)
    if "history" in tables:
        out["commits"] = lookups.newest_commits(lookups.symbol_history(tables["history"], symbol_id, limit=200), commits)
    for table, key in (("members", "module_id"), ("boundary_members", "root")):
        if table in tables:
            out[key] = symbols.join(one, "symbol_id", "left_semi").select("file_id").join(tables[table], "file_id")
    return out


def preflight(hunks: DataFrame | None, symbol_id: int | None, tables: dict[str, DataFrame], caller_depth: int = 3, tests: int = 5) -> dict[str, DataFrame]:
    """Before a change of a symbol, or of changed ranges: the symbols, each with its risk, largest parts and likely tests; the
    boundaries that they call into; warnings; and the highest risk."""
    symbols, files, edges = tables["symbols"], tables["files"], tables["edges"]
    spark = symbols.sparkSession
    targets = changed_symbols(hunks, symbols, files) if symbol_id is None else spark.createDataFrame([(symbol_id,)], "symbol_id long")
    ranked = evidence.ranked_tests(targets, edges, symbols, files, tables.get("lines"))
    states = evidence.coverage_states(targets, ranked, files)
    signals = evidence.risk_signals(targets, tables, caller_depth, ranked)
    levels = evidence.risk(signals)
    warn = F.filter(
        F.array(
            F.when(F.col("risk") == "high", F.lit("high-risk")),
            F.when(F.col("state").isin("tests-indexed-no-link", "no-indexed-tests"), F.lit("no-linked-tests")),
            F.when(F.col("state") == "heuristic-only", F.lit("tests-by-name-only")),
            F.when(F.col("route_exposed") > 0, F.lit("route-handler")),
            F.when(F.col("boundary_crossings") > 0, F.lit("crosses-boundaries")),
        ),
        lambda x: x.isNotNull(),
    )
    out = {
        "symbols": targets.join(symbols.select("symbol_id", "qualified_name", "kind", "file_id"), "symbol_id").join(levels, "symbol_id"),
        "contributions": evidence.contributions(signals, 3).filter("contribution <> 0"),
        "tests": ranked.filter(F.col("place") <= tests),
        "warnings": levels.join(states, "symbol_id").join(signals, "symbol_id").select("symbol_id", F.explode(warn).alias("warning")),
        "overall": evidence.worst(levels),
    }
    if "boundary_members" in tables:
        own = symbols.join(targets, "symbol_id", "left_semi").join(tables["boundary_members"], "file_id").select("symbol_id", F.col("root").alias("own"))
        crossed = groups_of_callees(edges, symbols.select("symbol_id", "file_id"), tables["boundary_members"], "root").join(own, "symbol_id").filter("root <> own")
        out["boundaries"] = crossed.groupBy("root").agg(F.count_distinct("symbol_id").alias("symbols")).orderBy(F.desc("symbols"), "root")
    return out


def contract_key() -> Column:
    """What identifies an endpoint, by protocol; null for protocols without contracts."""
    p = F.coalesce("protocol", F.lit("http"))
    key = lambda *parts: F.concat_ws("|", *parts)
    dest = F.coalesce("queue", "exchange")
    by = F.when(p == "http", key(p, F.upper("method"), "path")).when(p.isin("trpc", "graphql") & F.col("operation").isNotNull(), key(p, "operation"))
    by = by.when((p == "grpc") & F.col("operation").isNotNull(), key(p, F.replace("operation", F.lit("/"), F.lit("."))))
    by = by.when(p.isin("kafka", "sns", "nats", "redis_pubsub") & F.col("topic").isNotNull(), key(p, "topic"))
    return by.when(p.isin("sqs", "rabbitmq") & dest.isNotNull(), key(p, dest))


def _contract_columns(routes: DataFrame) -> DataFrame:
    missing = [c for c in CONTRACT_FIELDS if c not in routes.columns]
    return routes.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])


def contract_surface(routes: DataFrame) -> DataFrame:
    """(key, each of CONTRACT_FIELDS, route_id) of routes; of equal keys the last route counts."""
    keyed = _contract_columns(routes).withColumn("key", contract_key()).filter("key IS NOT NULL")
    last = keyed.groupBy("key").agg(F.max(F.struct("route_id", *CONTRACT_FIELDS)).alias("r"))
    return last.select("key", "r.*")


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, status) of the surfaces of two sets of routes: added, removed or changed."""
    return diff(contract_surface(old), contract_surface(new), ["key"], CONTRACT_FIELDS)


def affected_callers(changes: DataFrame, old_routes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, status, caller_id, link_id): who calls the removed and changed endpoints."""
    ids = _contract_columns(old_routes).withColumn("key", contract_key()).select("key", "route_id")
    return changes.filter("status <> 'added'").join(ids, "key").join(links.select("route_id", "caller_id", "link_id"), "route_id").select("key", "status", "caller_id", "link_id")


def contract_table(changes: DataFrame) -> DataFrame:
    """(key, line): a row of a Markdown table for each change, removed ones first."""
    rank = F.when(F.col("status") == "removed", 0).when(F.col("status") == "changed", 1).otherwise(2)
    return changes.select("key", F.concat(F.lit("| "), "status", F.lit(" | `"), "key", F.lit("` |")).alias("line"), rank.alias("rank")).orderBy("rank", "key").drop("rank")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n): rows of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")).select("table_name", "n")
        out = one if out is None else out.unionByName(one)
    return out


def batch(calls: list[tuple[str, dict]], tools: dict[str, Callable], most: int = 25) -> list[dict]:
    """Results of up to `most` read-only calls in order; one that fails has its error, and the others go on."""
    if len(calls) > most:
        raise ValueError(f"at most {most} calls")
    out = []
    for name, args in calls:
        try:
            out.append({"tool": name, "ok": True, "result": tools[name](**args)})
        except Exception as error:  # noqa: BLE001 - failures are isolated by definition
            out.append({"tool": name, "ok": False, "error": f"{type(error).__name__}: {error}"})
    return out

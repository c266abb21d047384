"""One entry for all questions to an index: named tools with checked arguments, over a dict of tables.

A tool returns a DataFrame, or a dict of them where an answer has several parts. Arguments that it does not know, and
missing ones, raise TypeError; values outside of what a tool takes raise ValueError. Tools only read.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import continuity as _continuity
from .operators import derive, evidence, graph, history, lookups, modules, reports, search, services, similarity
from .operators import symbols as S


class Index:
    """Questions to the tables of an index: files, symbols, edges, and what there is of the others."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self.spark = tables["files"].sparkSession

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"the index has no {name}")
        return self.tables[name]

    def _one(self, symbol: str, file: str | None = None) -> int:
        """The id of the best definition that a name, or a number, means."""
        if symbol.isdigit():
            return int(symbol)
        found = lookups.definition(self.table("symbols"), self.table("files"), symbol, file, 1).first()
        if found is None:
            raise ValueError(f"no symbol {symbol}")
        return found["symbol_id"]

    def _calls(self) -> DataFrame:
        return self.table("edges").filter("kind = 'call' AND to_id IS NOT NULL").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))

    def _start(self, value: int) -> DataFrame:
        return self.spark.createDataFrame([(value,)], "start long")

    # counts
    def stats(self) -> DataFrame:
        return reports.table_counts(self.tables)

    def health(self) -> dict[str, DataFrame]:
        return {"tables": self.stats(), "roles": self.table("files").groupBy("role").agg(F.count(F.lit(1)).alias("files"))}

    def provenance(self) -> DataFrame:
        source = F.col("provenance") if "provenance" in self.table("edges").columns else F.lit("scanner")
        return self.table("edges").groupBy(source.alias("provenance"), "kind").agg(F.count(F.lit(1)).alias("n"))

    # names
    def symbols(self, query: str | None = None, top: int = 20, limit: int = 50, **flags: bool) -> DataFrame:
        if query is None:
            return lookups.top_symbols(self.table("symbols"), self.table("files"), top, **flags)
        return search.search_symbols(self.table("symbols"), self.table("files"), query, limit, **flags)

    def search(self, query: str, limit: int = 30, budget: int | None = None) -> dict[str, DataFrame]:
        out = {"files": search.search_files(self.table("files"), query, limit).drop("content"), "symbols": search.search_symbols(self.table("symbols"), self.table("files"), query, limit)}
        if budget is not None:
            size = F.length(F.to_json(F.struct("*"))) / 4
            out["files"], out["symbols"] = S.drop_for_budget(out["files"], out["symbols"], size, [F.desc("score")], budget)
        return out

    def definition(self, symbol: str, file: str | None = None, limit: int = 50) -> DataFrame:
        return lookups.definition(self.table("symbols"), self.table("files"), symbol, file, limit)

    def did_you_mean(self, symbol: str) -> DataFrame:
        return search.did_you_mean(self.table("symbols"), self.table("files"), symbol)

    def file_symbols(self, file: str, limit: int = 200) -> DataFrame:
        one = lookups.match_file(self.table("files"), file).select("file_id")
        return self.table("symbols").join(one, "file_id").orderBy("line_start", "symbol_id").limit(limit)

    def skeleton(self, file: str, focus: str | None = None) -> DataFrame:
        one = lookups.match_file(self.table("files"), file).select("file_id")
        return derive.skeleton(self.table("symbols").join(one, "file_id", "left_semi"), focus, self.tables.get("lines")).orderBy("place")

    def complexity(self, by: str = "cyclomatic", least: int = 1, limit: int = 50) -> DataFrame:
        return lookups.complexity_ranking(self.table("symbols"), by, least, limit)

    # callers and callees
    def callers(self, symbol: str, file: str | None = None, limit: int = 40, by_file: bool = False, by_name: bool = False, snippet_lines: int = 0) -> DataFrame:
        edges, symbols, files = self.table("edges").filter("kind = 'call'"), self.table("symbols"), self.table("files")
        hits = edges.filter(F.col("to_name") == symbol) if by_name else edges.filter(F.col("to_id") == self._one(symbol, file))
        who = symbols.select(F.col("symbol_id").alias("from_id"), F.col("qualified_name").alias("caller"), F.col("file_id").alias("caller_file"))
        rows = hits.select("edge_id", "from_id", "line").join(who, "from_id").join(files.select(F.col("file_id").alias("caller_file"), "rel_path"), "caller_file")
        if by_file:
            return rows.groupBy("rel_path").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("from_id").alias("callers")).orderBy(F.desc("sites"), "rel_path").limit(limit)
        rows = rows.orderBy("rel_path", "line", "edge_id").limit(limit)
        if snippet_lines:
            sites = rows.select(F.col("edge_id").alias("site_id"), F.col("caller_file").alias("file_id"), "line")
            rows = rows.join(derive.snippets(sites, self.table("lines"), snippet_lines, snippet_lines).select(F.col("site_id").alias("edge_id"), "snippet"), "edge_id")
        return rows

    def callees(self, symbol: str, file: str | None = None, limit: int = 40) -> DataFrame:
        out = self.table("edges").filter((F.col("kind") == "call") & (F.col("from_id") == self._one(symbol, file))).groupBy("to_id", "to_name").agg(F.count(F.lit(1)).alias("sites"))
        named = self.table("symbols").select(F.col("symbol_id").alias("to_id"), "qualified_name")
        return out.join(named, "to_id", "left").orderBy(F.desc("sites"), "to_name").limit(limit)

    def ambiguity(self, symbol: str) -> DataFrame:
        bounds = S.caller_bounds(self.table("edges").filter("kind = 'call'"), self.table("symbols"))
        return bounds.filter(F.col("symbol_id") == self._one(symbol)).withColumn("precision", reports.precision(F.col("resolved"), F.col("by_name")))

    # traces
    def trace_path(self, source: str, target: str, max_depth: int = 6) -> DataFrame:
        path = graph.shortest_path(self._calls(), self._one(source), self._one(target), max_depth) or []
        rows = self.spark.createDataFrame(list(enumerate(path)), "place int, symbol_id long")
        return rows.join(self.table("symbols").select("symbol_id", "qualified_name"), "symbol_id").orderBy("place")

    def trace_callers(self, symbol: str, max_depth: int = 4, max_nodes: int = 20_000, limit: int = 100, offset: int = 0) -> dict[str, DataFrame]:
        return self._trace(symbol, False, max_depth, max_nodes, limit, offset)

    def trace_callees(self, symbol: str, max_depth: int = 4, max_nodes: int = 20_000, limit: int = 100, offset: int = 0) -> dict[str, DataFrame]:
        return self._trace(symbol, True, max_depth, max_nodes, limit, offset)

    def _trace(self, symbol: str, forward: bool, max_depth: int, max_nodes: int, limit: int, offset: int) -> dict[str, DataFrame]:
        found = graph.reach(self._calls(), self._start(self._one(symbol)), max_depth, forward, max_nodes)
        out = reports.trace_summary(found, self.table("symbols"), self.table("files"))
        named = found.join(self.table("symbols").select(F.col("symbol_id").alias("id"), "qualified_name"), "id")
        return {**out, "items": lookups.page(named, ["depth", "id"], limit, offset)}

    def trace_file_dependencies(self, file: str, max_depth: int = 4) -> DataFrame:
        one = lookups.match_file(self.table("files"), file).first()
        if one is None:
            raise ValueError(f"no file {file}")
        found = modules.import_closure(self.table("imports"), one["file_id"], max_depth)
        return found.join(self.table("files").select(F.col("file_id").alias("id"), "rel_path"), "id").orderBy("depth", "rel_path")

    def trace_module_dependencies(self, module_id: int, max_depth: int = 4, outward: bool = True) -> DataFrame:
        return modules.reachable_groups(self.table("module_edges"), module_id, max_depth, outward)

    def trace_service_path(self, source: str, target: str, max_depth: int = 6) -> DataFrame:
        path = services.service_path(self.table("links"), self._one(source), self._one(target), max_depth)
        return self.spark.createDataFrame(list(enumerate(path)), "place int, symbol_id long")

    def trace_service_dependencies(self, symbol: str, max_depth: int = 4, max_nodes: int = 200, max_fanout: int = 20, limit: int = 25) -> DataFrame:
        found, cutoff = services.service_reach(self.table("links"), self._one(symbol), max_depth, max_nodes, max_fanout)
        return found.withColumn("cutoff", F.lit(cutoff)).orderBy("depth", "symbol_id").limit(limit)

    def trace_module_service_dependencies(self, module_id: int, max_depth: int = 4) -> DataFrame:
        return services.module_reach(services.module_links(self.table("links"), self.table("symbols"), self.table("members")), module_id, max_depth)

    def trace(self, scope: str, **arguments) -> DataFrame | dict[str, DataFrame]:
        """One of the traces, by its scope."""
        scopes = {"path": self.trace_path, "callers": self.trace_callers, "callees": self.trace_callees, "files": self.trace_file_dependencies, "modules": self.trace_module_dependencies, "service_path": self.trace_service_path, "services": self.trace_service_dependencies, "module_services": self.trace_module_service_dependencies}
        if scope not in scopes:
            raise ValueError(f"scope is one of {sorted(scopes)}")
        return _checked(scopes[scope], arguments)

    # services, dependencies, configuration
    def routes(self, method: str | None = None, framework: str | None = None, path_part: str | None = None, limit: int = 100) -> DataFrame:
        return lookups.routes_list(self.table("routes"), self.table("files"), self.table("symbols"), limit, path_part, method=method, framework=framework)

    def service_calls(self, protocol: str | None = None, method: str | None = None, min_confidence: float = 0.0, limit: int = 100, offset: int = 0) -> DataFrame:
        return lookups.calls_list(self.table("service_calls"), self.table("files"), self.table("symbols"), limit, offset, min_confidence, protocol=protocol, method=method)

    def service_links(self, protocol: str | None = None, match_kind: str | None = None, min_confidence: float = 0.0, limit: int = 100, offset: int = 0) -> DataFrame:
        return lookups.links_list(self.table("links"), self.table("service_calls"), self.table("routes"), self.table("symbols"), self.table("files"), limit, offset, min_confidence, protocol=protocol, match_kind=match_kind)

    def dependencies(self, ecosystem: str | None = None, name: str | None = None, limit: int = 200) -> DataFrame:
        return lookups.dependencies_list(self.table("external_dependencies"), ecosystem, name, limit)

    def config(self, key: str | None = None, source: str | None = None, limit: int = 200) -> DataFrame:
        return lookups.config_list(self.table("config_keys"), self.table("files"), self.table("symbols"), key, source, limit)

    # groups
    def modules(self, by: str = "centrality", limit: int = 50) -> DataFrame:
        return lookups.modules_list(self.table("modules"), by, limit)

    def module_members(self, module_id: int) -> DataFrame:
        return lookups.module_members(self.table("members"), self.table("files"), module_id)

    def symbol_module(self, symbol: str) -> DataFrame:
        own = self.table("symbols").filter(F.col("symbol_id") == self._one(symbol)).select("file_id")
        return own.join(self.table("members"), "file_id").join(self.table("modules"), "module_id")

    def module_dependencies(self, module_id: int, outward: bool = True) -> DataFrame:
        return lookups.neighbours(self.table("module_edges"), self.table("modules"), module_id, outward)

    def boundaries(self) -> DataFrame:
        return self.table("boundaries").orderBy("root")

    def boundary_for_file(self, file: str) -> DataFrame:
        return lookups.group_of_file(self.table("boundary_members"), self.table("boundaries"), self.table("files"), file, "root")

    def boundary_dependencies(self, boundary_id: int, outward: bool = True) -> DataFrame:
        return lookups.neighbours(self.table("boundary_edges"), self.table("boundaries"), boundary_id, outward, "boundary_id")

    def architecture(self) -> dict[str, DataFrame]:
        return reports.architecture(self.tables)

    # history
    def churn(self, limit: int = 20) -> DataFrame:
        return self.table("file_churn").orderBy(F.desc("commits"), "file_id").limit(limit)

    def history(self, symbol: str, limit: int = 50, since: str | None = None) -> DataFrame:
        return lookups.symbol_history(self.table("history"), self._one(symbol), None if since is None else F.to_timestamp(F.lit(since)), limit)

    def changes_with(self, symbol: str, min_support: int = 2, max_commit_symbols: int = 50, since: str | None = None, limit: int = 20, include_same_file: bool = True) -> DataFrame:
        one = self._one(symbol)
        out = history.coupling(self.table("history"), min_support, max_commit_symbols, since=None if since is None else F.to_timestamp(F.lit(since))).filter(F.col("target") == one)
        places = self.table("symbols").select(F.col("symbol_id").alias("partner"), F.col("file_id").alias("partner_file"))
        own = self.table("symbols").select(F.col("symbol_id").alias("target"), "file_id")
        out = out.join(places, "partner").join(own, "target").withColumn("same_file", F.col("file_id") == F.col("partner_file"))
        out = out if include_same_file else out.filter("NOT same_file")
        return out.orderBy(F.desc("support"), "partner_commits", "partner").limit(min(limit, 200))

    def continuity(self, symbol: str) -> DataFrame:
        found = self.tables.get("continuity")
        found = _continuity.continuity(self.table("symbols"), self.table("history")) if found is None else found
        return lookups.continuity_of(found, self._one(symbol))

    # tests, risk, changes
    def behavior(self, symbol: str, limit: int = 30, indirect_depth: int = 2) -> dict[str, DataFrame]:
        one = self.spark.createDataFrame([(self._one(symbol),)], "symbol_id long")
        ranked = evidence.ranked_tests(one, self.table("edges"), self.table("symbols"), self.table("files"), self.tables.get("lines"), indirect_depth, limit)
        return {"tests": ranked.orderBy("place"), "coverage": evidence.coverage_states(one, ranked, self.table("files"))}

    def risk(self, symbol: str, caller_depth: int = 3) -> dict[str, DataFrame]:
        signals = evidence.risk_signals(self.spark.createDataFrame([(self._one(symbol),)], "symbol_id long"), self.tables, caller_depth)
        return {"risk": evidence.risk(signals), "contributions": evidence.contributions(signals)}

    def context(self, symbol: str, callers: int = 10, callees: int = 10, tests: int = 10, commits: int = 5, caller_depth: int = 3) -> dict[str, DataFrame]:
        return reports.context(self._one(symbol), self.tables, callers, callees, tests, commits, caller_depth)

    def preflight(self, symbol: str | None = None, hunks: DataFrame | None = None) -> dict[str, DataFrame]:
        if (symbol is None) == (hunks is None):
            raise ValueError("one of symbol and hunks is needed")
        return reports.preflight(hunks, None if symbol is None else self._one(symbol), self.tables)

    def detect_changes(self, hunks: DataFrame, caller_depth: int = 2) -> dict[str, DataFrame]:
        return reports.detect_changes(hunks, self.table("symbols"), self.table("files"), self.table("edges"), caller_depth)

    def duplicates(self, max_distance: int = 6, least_loc: int = 4, limit: int = 50) -> DataFrame:
        rows = lookups.hashed(self.table("symbols"), self.table("files"), least_loc).select(F.col("symbol_id").alias("id"), F.col("shape_hash").alias("hash"))
        found = similarity.duplicate_clusters(rows, max_distance)
        return found.orderBy(F.desc("members"), "cluster", "id").limit(limit)

    def contract_diff(self, old_routes: DataFrame) -> dict[str, DataFrame]:
        changes = reports.contract_diff(old_routes, self.table("routes"))
        out = {"changes": changes, "table": reports.contract_table(changes)}
        return {**out, "affected": reports.affected_callers(changes, old_routes, self.table("links"))} if "links" in self.tables else out

    # dispatch
    def tools(self) -> dict[str, inspect.Signature]:
        """The names of all tools and what they take."""
        skip = {"tools", "call", "batch", "table"}
        return {n: inspect.signature(f) for n, f in inspect.getmembers(self, inspect.ismethod) if not n.startswith("_") and n not in skip}

    def call(self, tool: str, **arguments) -> DataFrame | dict[str, DataFrame]:
        if tool not in self.tools():
            raise ValueError(f"no tool {tool}")
        return _checked(getattr(self, tool), arguments)

    def batch(self, calls: list[tuple[str, dict]]) -> list[dict]:
        return reports.batch([(n, {"tool": n, **a}) for n, a in calls], {n: self.call for n, _ in calls})


def _checked(f: Callable, arguments: dict):
    """The result of a call whose arguments fit: limits and depths are not negative."""
    bound = inspect.signature(f).bind(**arguments)
    for name, value in bound.arguments.items():
        if isinstance(value, int) and not isinstance(value, bool) and value < 0 and (name.startswith("max_") or name in ("limit", "offset", "top")):
            raise ValueError(f"{name} must not be negative")
    return f(*bound.args, **bound.kwargs)

"""Filters and lookups over the tables of a code graph, each on a total order, with paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds whose history is followed.
HISTORIC = ("function", "method", "constructor", "class")
SYMBOL_COLUMNS = "symbol_id name qualified_name kind file_id line_start line_end signature symbol_role pagerank loc cyclomatic cognitive max_nesting".split()
PAGE_CAP = 1000


def projected(symbols: DataFrame) -> DataFrame:
    """The columns of a symbol that answers show; those that a table lacks are null."""
    return symbols.select(*[F.col(c) if c in symbols.columns else F.lit(None).alias(c) for c in SYMBOL_COLUMNS])


def lens(include_vendor: bool = False, include_generated: bool = False, include_tests: bool = False, include_declarations: bool = False, include_type_refs: bool = False, symbol_role: bool = True) -> Column:
    """The default visibility filter over symbols with their files; each flag takes one condition away."""
    keep = F.lit(True)
    for included, hidden in ((include_vendor, F.col("is_vendor")), (include_generated, F.col("is_generated")), (include_tests, F.col("role") == "test")):
        keep = keep if included else keep & ~hidden
    for included, role in ((include_declarations, "declaration"), (include_type_refs, "type_ref")) if symbol_role else ():
        keep = keep if included else keep & (F.col("symbol_role") != role)
    return keep


def variants(name: str) -> list[str]:
    """A qualified name as it is and in the other spellings: with `.` for `::`, and the other way round."""
    return list(dict.fromkeys([name, name.replace("::", "."), name.replace(".", "::") if "::" in name or "." in name else name][: 3 if "." in name and "::" not in name else 2]))


def find_symbols(symbols: DataFrame, needle: str, limit: int | None = 50) -> DataFrame:
    """Symbols whose name or qualified name holds `needle`, ASCII case ignored (`%` and `_` stand for any); highest rank first."""
    found = symbols.filter(F.col("name").ilike(f"%{needle}%") | F.col("qualified_name").ilike(f"%{needle}%"))
    return found if limit is None else found.orderBy(F.desc("pagerank"), "symbol_id").limit(limit)


def in_file(path: Column, fragment: str) -> Column:
    """Whether a path is `fragment`, or ends with it after a slash; ASCII case ignored, no character stands for others."""
    end = fragment.replace("\\", "/").lstrip("/").lower()
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (low == end) | low.endswith(f"/{end}")


def definition(symbols: DataFrame, files: DataFrame, name: str, file: str | None = None, limit: int = 50) -> DataFrame:
    """Definitions of a name or qualified name in any spelling, in files that `file` names; highest rank first."""
    names = variants(name)
    found = symbols.filter(F.col("name").isin(names) | F.col("qualified_name").isin(names)).join(files.select("file_id", "rel_path", "role", "is_vendor", "is_generated"), "file_id")
    if file:
        found = found.filter(in_file(F.col("rel_path"), file))
    return found.orderBy(F.desc("pagerank"), "symbol_id").limit(limit)


def by_key(symbols: DataFrame, key: str) -> DataFrame:
    return symbols.filter(F.col("symbol_key") == key)


def match_file(files: DataFrame, file: str) -> DataFrame:
    """The one file that a path names best: equal, else ending so after a slash; the first by path."""
    exact = F.lower("rel_path") == file.replace("\\", "/").lstrip("/").lower()
    return files.filter(in_file(F.col("rel_path"), file)).orderBy(F.desc(exact), "rel_path").limit(1)


def file_symbols(symbols: DataFrame, files: DataFrame, file: str, limit: int = 200) -> DataFrame:
    """The symbols of a file in order of their lines."""
    one = files.filter(F.col("rel_path") == file).select("file_id", "rel_path")
    return symbols.join(one, "file_id").orderBy("line_start", "symbol_id").limit(limit)


def top_symbols(symbols: DataFrame, files: DataFrame, limit: int = 20, **flags) -> DataFrame:
    return symbols.join(files.select("file_id", "rel_path", "role", "is_vendor", "is_generated"), "file_id").filter(lens(**flags)).orderBy(F.desc("pagerank"), "symbol_id").limit(limit)


def complexity_ranking(symbols: DataFrame, by: str = "cyclomatic", least: int = 1, limit: int = 50) -> DataFrame:
    """Symbols with most of one of loc, cyclomatic, cognitive and max_nesting; ties by rank."""
    if by not in ("loc", "cyclomatic", "cognitive", "max_nesting"):
        raise ValueError(f"{by} is no metric")
    return symbols.filter(F.col(by) >= least).orderBy(F.desc(by), F.desc("pagerank"), "symbol_id").limit(limit)


def page(rows: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of rows on a total order; at most PAGE_CAP."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, PAGE_CAP)))


def paged(rows: DataFrame, order: list, limit: int = 100, offset: int = 0) -> tuple[DataFrame, dict]:
    """The page, and total, next_offset (None at the end) and truncated."""
    total, end = rows.count(), offset + min(limit, PAGE_CAP)
    return page(rows, order, limit, offset), {"total": total, "next_offset": end if end < total else None, "truncated": end < total}


def routes_list(routes: DataFrame, files: DataFrame, symbols: DataFrame, limit: int = 200, path_part: str | None = None, **equal) -> DataFrame:
    """Routes with their file and handler, filtered by equality of columns (method, framework, protocol, operation, topic,
    queue, service) and a part of the path; ordered by path and method."""
    out = routes
    for column, value in equal.items():
        if value is not None:
            out = out.filter((F.upper(column) if column == "method" else F.col(column)) == (value.upper() if column == "method" else value))
    if path_part:
        out = out.filter(F.col("path").ilike(f"%{path_part}%"))
    handlers = symbols.select(F.col("symbol_id").alias("handler_id"), F.col("qualified_name").alias("handler"))
    out = out.join(files.select("file_id", "rel_path"), "file_id", "left").join(handlers, "handler_id", "left")
    return out.orderBy("path", "method", "route_id").limit(limit)


def calls_list(calls: DataFrame, files: DataFrame, symbols: DataFrame, limit: int = 100, offset: int = 0, min_confidence: float = 0.0, path_part: str | None = None, **equal) -> DataFrame:
    """A page of outbound calls with their file and caller; document definitions are no calls."""
    out = calls.filter((F.col("confidence") >= min_confidence) & (F.coalesce("framework", F.lit("")) != "gql-doc"))
    for column, value in equal.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    if path_part:
        out = out.filter(F.coalesce("normalized_path", "raw_target").ilike(f"%{path_part}%"))
    callers = symbols.select("symbol_id", F.col("qualified_name").alias("caller"))
    return page(out.join(files.select("file_id", "rel_path"), "file_id", "left").join(callers, "symbol_id", "left"), ["rel_path", "line", "call_id"], limit, offset)


def links_list(links: DataFrame, calls: DataFrame, routes: DataFrame, symbols: DataFrame, files: DataFrame, limit: int = 100, offset: int = 0, min_confidence: float = 0.0, **equal) -> DataFrame:
    """A page of service links with both ends: the call, its caller and file; the route, its handler and file."""
    out = links.filter(F.col("confidence") >= min_confidence)
    for column, value in equal.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    c = calls.select("call_id", F.col("line").alias("call_line"), F.col("raw_target"), F.col("file_id").alias("call_file"))
    r = routes.select("route_id", F.col("method").alias("route_method"), F.col("path").alias("route_path"), F.col("file_id").alias("route_file"))
    named = lambda id_, out_: symbols.select(F.col("symbol_id").alias(id_), F.col("qualified_name").alias(out_))
    place = lambda id_, out_: files.select(F.col("file_id").alias(id_), F.col("rel_path").alias(out_))
    out = out.join(c, "call_id", "left").join(r, "route_id", "left").join(named("caller_id", "caller"), "caller_id", "left").join(named("handler_id", "handler"), "handler_id", "left")
    out = out.join(place("call_file", "call_path"), "call_file", "left").join(place("route_file", "handler_path"), "route_file", "left")
    return page(out, [F.desc("confidence"), "link_id"], limit, offset)


def links_of(links: DataFrame, symbol_id: int, side: str = "caller") -> DataFrame:
    return links.filter(F.col(f"{side}_id") == symbol_id).orderBy(F.desc("confidence"), "link_id")


def dependencies_list(deps: DataFrame, ecosystem: str | None = None, name_part: str | None = None, limit: int = 200) -> DataFrame:
    out = deps if ecosystem is None else deps.filter(F.col("ecosystem") == ecosystem)
    out = out if name_part is None else out.filter(F.col("name").ilike(f"%{name_part}%"))
    return out.orderBy("ecosystem", "name", "manifest_path").limit(limit)


def config_list(keys: DataFrame, files: DataFrame, symbols: DataFrame, key_part: str | None = None, source: str | None = None, limit: int = 200) -> DataFrame:
    out = keys if source is None else keys.filter(F.col("source") == source)
    out = out if key_part is None else out.filter(F.col("key").ilike(f"%{key_part}%"))
    named = symbols.select("symbol_id", F.col("qualified_name").alias("reader"))
    return out.join(files.select("file_id", "rel_path"), "file_id").join(named, "symbol_id", "left").orderBy("key", "rel_path", "line").limit(limit)


def modules_list(modules: DataFrame, by: str = "centrality", limit: int = 50) -> DataFrame:
    order = {"centrality": F.desc("centrality"), "size": F.desc("size"), "label": F.asc("label")}[by]
    return modules.orderBy(order, "module_id").limit(limit)


def module_members(members: DataFrame, files: DataFrame, module_id: int) -> DataFrame:
    return members.filter(F.col("module_id") == module_id).join(files.select("file_id", "rel_path"), "file_id").orderBy("rel_path")


def module_top_symbols(members: DataFrame, symbols: DataFrame, module_id: int, limit: int = 10) -> DataFrame:
    inside = members.filter(F.col("module_id") == module_id).select("file_id")
    return symbols.join(inside, "file_id", "left_semi").filter("is_rankable").orderBy(F.desc("pagerank"), "symbol_id").limit(limit)


def group_of_file(members: DataFrame, groups: DataFrame, files: DataFrame, file: str, key: str = "module_id") -> DataFrame:
    """The module (or boundary) of the file that a path names."""
    return match_file(files, file).select("file_id").join(members, "file_id").join(groups, key)


def neighbours(edges: DataFrame, groups: DataFrame, group_id: int, outward: bool = True, key: str = "module_id") -> DataFrame:
    """(other, label, kind, weight) of the edges of a module or boundary, heaviest first."""
    here, there = ("from_id", "to_id") if outward else ("to_id", "from_id")
    out = edges.filter(F.col(here) == group_id).select(F.col(there).alias("other"), "kind", "weight")
    return out.join(groups.select(F.col(key).alias("other"), "label"), "other").orderBy(F.desc("weight"), "other", "kind")


def symbol_history(history: DataFrame, symbol_id: int, since: Column | None = None, limit: int = 50) -> DataFrame:
    rows = history.filter(F.col("symbol_id") == symbol_id)
    return (rows if since is None else rows.filter(F.col("committed_at") >= since)).orderBy(F.desc("committed_at"), F.desc("commit_sha")).limit(limit)


def newest_commits(history: DataFrame, limit: int = 5) -> DataFrame:
    """Commits once each, newest first."""
    once = history.groupBy("commit_sha").agg(F.max("committed_at").alias("committed_at"))
    return once.orderBy(F.desc("committed_at"), F.desc("commit_sha")).limit(limit)


def continuity_of(continuity: DataFrame, symbol_id: int) -> DataFrame:
    return continuity.filter(F.col("symbol_id") == symbol_id).orderBy(F.desc("confidence"), F.desc("previous_symbol_key"))


def handled_routes(routes: DataFrame, symbol_id: int) -> DataFrame:
    return routes.filter(F.col("handler_id") == symbol_id).orderBy("path", "method")


def config_keys_of(keys: DataFrame, symbol_id: int) -> DataFrame:
    return keys.filter(F.col("symbol_id") == symbol_id).select("key", "source").distinct().orderBy("key")


def files_list(files: DataFrame) -> DataFrame:
    return files.orderBy("rel_path")


def rankable_ids(symbols: DataFrame) -> DataFrame:
    return symbols.filter("is_rankable").select("symbol_id")


def rankable_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (src, dst) of resolved calls between symbols that can be ranked."""
    ids = rankable_ids(symbols)
    calls = edges.filter("kind = 'call' AND to_id IS NOT NULL").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()
    return calls.join(ids.withColumnRenamed("symbol_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi")


def with_history(symbols: DataFrame, files: DataFrame | None = None, paths: list[str] | None = None) -> DataFrame:
    """Symbols whose history is followed, of all files or of those that `paths` name (case ignored)."""
    out = symbols.filter(F.col("kind").isin(*HISTORIC) & F.col("symbol_key").isNotNull())
    if paths is None:
        return out
    some = files.filter(F.lower("rel_path").isin([p.replace("\\", "/").lower() for p in paths])).select("file_id")
    return out.join(some, "file_id", "left_semi")


def hashed(symbols: DataFrame, files: DataFrame, least_loc: int = 4, include_tests: bool = False, limit: int | None = 50_000) -> DataFrame:
    """Symbols with a shape hash; the first by id up to `limit`."""
    out = symbols.filter(F.col("shape_hash").isNotNull() & (F.col("loc") >= least_loc)).join(files.select("file_id", "role", "rel_path"), "file_id")
    out = out if include_tests else out.filter("role <> 'test'")
    return out if limit is None else out.orderBy("symbol_id").limit(limit)


def lacks_hashes(symbols: DataFrame, least_loc: int = 4) -> bool:
    eligible = symbols.filter(F.col("kind").isin("function", "method", "constructor") & (F.col("symbol_role") != "declaration") & (F.col("loc") >= least_loc))
    return eligible.filter(F.col("shape_hash").isNotNull()).isEmpty() and not eligible.isEmpty()


def first_of(rows: DataFrame, partition: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each part, with `place` from 1 and `total`, its number of rows."""
    window = Window.partitionBy(*partition)
    return rows.withColumn("place", F.row_number().over(window.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(window)).filter(F.col("place") <= n)

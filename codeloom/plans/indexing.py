"""Queries over stand-in source trees: texts made of the star schema's rows, scanned, extracted, resolved and linked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..extract import files as X
from ..operators import derive, evidence, lookups, modules, reports, search, services
from ..operators import symbols as S
from ..operators.continuity import scope, shares_scope, similar_name
from ..sources import git, manifests, store, tree
from . import views as V
from .catalogue import query

LANGUAGES = ("typescript", "go", "java", "rust", "c", "csharp", "python")


def _code(spark, d: str) -> DataFrame:
    """A file for each part: a function with p_size % 4 nested branches around one call, in one of seven languages."""
    key, k = F.col("p_partkey").cast("string"), (F.col("p_size") % 4).cast("int")
    name, call = F.concat(F.lit("f"), key), F.concat(F.lit("g"), (F.col("p_partkey") % 7).cast("string"), F.lit("(x);\n"))

    def braces(head: str, tail: str, test: str = "if (x) {\n", wrapped: bool = False) -> Column:
        body = F.concat(F.lit(head), name, F.lit(tail), F.repeat(F.lit(test), k), call, F.repeat(F.lit("}\n"), k), F.lit("}\n"))
        return F.concat(F.lit("class C"), key, F.lit(" {\n"), body, F.lit("}\n")) if wrapped else body

    indents = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.concat(F.repeat(F.lit("    "), i), F.lit("if x:\n")))
    python = F.concat(F.lit("def "), name, F.lit("(x):\n"), F.when(k > 0, F.array_join(indents, "")).otherwise(""), F.repeat(F.lit("    "), k + 1), F.regexp_replace(call, ";", ""))
    texts = [
        braces("function ", "(x) {\n"), braces("func ", "(x int) {\n", "if x > 0 {\n"), braces("void ", "(int x) {\n", wrapped=True), braces("fn ", "(x: i32) {\n", "if x > 0 {\n"),
        braces("void ", "(int x) {\n"), braces("public void ", "(int x) {\n", wrapped=True), python,
    ]
    which = (F.col("p_partkey") % 7).cast("int")
    pick = lambda items: F.element_at(F.array(*items), which + 1)
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("src/f"), key).alias("rel_path"), pick([F.lit(x) for x in LANGUAGES]).alias("language"), pick(texts).alias("content"))


_CODE = """WITH c AS (SELECT p_partkey AS k, p_partkey % 7 AS w, p_size % 4 AS n, p_partkey % 7 IN (2, 5) AS wrapped, p_partkey % 7 = 6 AS py FROM part)"""


@query(_CODE + """, f AS (SELECT k AS file_id, CASE WHEN wrapped THEN 'C' || k || '.f' || k ELSE 'f' || k END AS qualified_name, CASE WHEN wrapped THEN 'method' ELSE 'function' END AS kind,
  CASE WHEN wrapped THEN 1 ELSE 0 END AS line_start, CASE WHEN wrapped THEN 1 ELSE 0 END + CASE WHEN py THEN n + 1 ELSE 2 * n + 2 END AS line_end,
  CASE WHEN py THEN n + 2 ELSE 2 * n + 3 END AS loc, 1 + n AS cyclomatic, n * (n + 1) // 2 AS cognitive, n AS max_nesting FROM c)
SELECT file_id, qualified_name, kind, line_start::INT AS line_start, line_end::INT AS line_end, loc::INT AS loc, cyclomatic::INT AS cyclomatic, cognitive::INT AS cognitive, max_nesting::INT AS max_nesting FROM f
UNION ALL SELECT k, 'C' || k, 'class', 0, (2 * n + 4)::INT, (2 * n + 5)::INT, NULL, NULL, NULL FROM c WHERE wrapped""")
def q_extract_symbols(spark, d):
    cols = "file_id qualified_name kind line_start line_end loc cyclomatic cognitive max_nesting".split()
    return X.flat(X.extracted(_code(spark, d)), "symbols").select(*cols)


@query(_CODE + " SELECT k AS file_id, 'g' || w AS name, (CASE WHEN wrapped THEN 2 ELSE 1 END + n)::INT AS line, CASE WHEN wrapped THEN 'C' || k || '.f' || k ELSE 'f' || k END AS caller FROM c")
def q_extract_calls(spark, d):
    return X.flat(X.extracted(_code(spark, d)), "calls").select("file_id", "name", "line", "caller")


def _scripts(spark, d: str) -> DataFrame:
    """Scripts with one statement each: a route, client calls, messages both ways, an environment read."""
    key = F.col("s_suppkey").cast("string")
    line = lambda a, b: F.concat(F.lit(a), key, F.lit(b))
    texts = [line("app.get('/r", "/:id', handle);\n"), line("axios.post('/r", "/1');\n"), line("producer.send({ topic: 't", "', messages: [] });\n"), line("consumer.subscribe({ topic: 't", "' });\n"), line("const v = process.env.KEY_", ";\n"), line("fetch(`/r${x}/p", "`, { method: 'PUT' });\n")]
    return V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("s"), key, F.lit(".ts")).alias("rel_path"), F.lit("typescript").alias("language"), F.element_at(F.array(*texts), (F.col("s_suppkey") % 6 + 1).cast("int")).alias("content"))


@query("""SELECT s_suppkey AS file_id, CASE WHEN s_suppkey % 6 = 0 THEN 'GET' ELSE 'CONSUME' END AS method, CASE WHEN s_suppkey % 6 = 0 THEN '/r' || s_suppkey || '/:id' ELSE 't' || s_suppkey END AS path,
 CASE WHEN s_suppkey % 6 = 0 THEN 'http' ELSE 'kafka' END AS protocol, CASE WHEN s_suppkey % 6 = 0 THEN 'handle' END AS handler_name FROM supplier WHERE s_suppkey % 6 IN (0, 3)""")
def q_extract_routes(spark, d):
    return X.flat(X.extracted(_scripts(spark, d)), "routes").select("file_id", "method", "path", "protocol", "handler_name")


@query("""SELECT s_suppkey AS file_id, CASE s_suppkey % 6 WHEN 1 THEN 'POST' WHEN 2 THEN 'PUBLISH' ELSE 'PUT' END AS method, CASE s_suppkey % 6 WHEN 1 THEN '/r' || s_suppkey || '/1' WHEN 2 THEN 't' || s_suppkey ELSE '/r:param/p' || s_suppkey END AS raw_target,
 CASE s_suppkey % 6 WHEN 2 THEN 'kafka' ELSE 'http' END AS protocol, CASE s_suppkey % 6 WHEN 1 THEN 'axios' WHEN 2 THEN 'kafkajs' ELSE 'fetch' END AS framework FROM supplier WHERE s_suppkey % 6 IN (1, 2, 5)""")
def q_extract_service_calls(spark, d):
    return X.flat(X.extracted(_scripts(spark, d)), "service_calls").select("file_id", "method", "raw_target", "protocol", "framework")


@query("SELECT s_suppkey AS file_id, 'KEY_' || s_suppkey AS key FROM supplier WHERE s_suppkey % 6 = 4")
def q_extract_config(spark, d):
    return X.flat(X.extracted(_scripts(spark, d)), "config_keys").select("file_id", "key")


def _paths(spark, d: str) -> DataFrame:
    dirs, ends = ["src", "vendor", "tests", "generated", "docs"], [".ts", ".py", ".go", ".test.ts", "_test.go", ".pb.go", ".min.js", ".txt"]
    at = lambda items, n: F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("doc_id") % n + 1).cast("int"))
    return V.table(spark, d, "documents").select("doc_id", F.concat(at(dirs, 5), F.lit("/f"), F.col("doc_id").cast("string"), at(ends, 8)).alias("path"))


_PATHS = "WITH p AS (SELECT doc_id, ['src', 'vendor', 'tests', 'generated', 'docs'][doc_id % 5 + 1] || '/f' || doc_id || ['.ts', '.py', '.go', '.test.ts', '_test.go', '.pb.go', '.min.js', '.txt'][doc_id % 8 + 1] AS path FROM documents)"


@query(_PATHS + """ SELECT doc_id, path, ['typescript', 'python', 'go', 'typescript', 'go', 'go', 'javascript', NULL][doc_id % 8 + 1] AS language,
 CASE WHEN doc_id % 5 = 1 THEN 'vendor' WHEN doc_id % 5 = 3 OR doc_id % 8 IN (5, 6) THEN 'generated' WHEN doc_id % 5 = 2 OR doc_id % 8 IN (3, 4) THEN 'test' ELSE 'project' END AS role,
 doc_id % 5 = 1 OR doc_id % 8 IN (5, 6) AS skipped, doc_id % 5 IN (1, 4) OR doc_id % 8 IN (5, 6) AS skipped_fast FROM p""")
def q_file_roles(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("doc_id", "path", tree.language(p).alias("language"), tree.role(p).alias("role"), tree.skipped(p).alias("skipped"), tree.skipped(p, "fast").alias("skipped_fast"))


@query("SELECT p_partkey AS path_id, (row_number() OVER (ORDER BY 'k' || p_partkey)) AS file_id FROM part")
def q_numbered_paths(spark, d):
    keys = V.table(spark, d, "part").select("p_partkey", F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("rel_path"))
    return keys.join(tree.numbered(keys, "rel_path", "file_id"), "rel_path").select(F.col("p_partkey").alias("path_id"), "file_id")


@query(_PATHS + """, t AS (SELECT doc_id, regexp_extract(path, '^(.*)/', 1) AS d, regexp_extract(path, '/([^/]+?)(\\.[^./]+)$', 1) AS b, regexp_extract(path, '(\\.[^./]+)$', 1) AS e FROM p)
SELECT DISTINCT doc_id, unnest(CASE WHEN e IN ('.ts', '.js') THEN [x || b || y || e FOR x IN [d || '/', d || '/__tests__/', 'tests/'] FOR y IN ['.test', '.spec', '.tests']] WHEN e = '.go' THEN [d || '/' || b || '_test.go'] WHEN e = '.py' THEN [d || '/test_' || b || '.py', d || '/' || b || '_test.py', 'tests/test_' || b || '.py'] ELSE [] END) AS test_path FROM t""".replace("[x || b || y || e FOR x IN [d || '/', d || '/__tests__/', 'tests/'] FOR y IN ['.test', '.spec', '.tests']]", "flatten([[d || '/' || b || y || e, d || '/__tests__/' || b || y || e, 'tests/' || b || y || e] FOR y IN ['.test', '.spec', '.tests']])").replace("\\\\", "\\"))
def q_expected_tests(spark, d):
    return _paths(spark, d).select("doc_id", F.explode(derive.expected_tests(F.col("path"))).alias("test_path")).distinct()


def _modules(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Scripts d<size % 5>/m<key>.ts, each importing its neighbour by a relative name."""
    part = V.table(spark, d, "part")
    files = part.select(F.col("p_partkey").alias("file_id"), F.format_string("d%d/m%d.ts", F.col("p_size") % 5, F.col("p_partkey")).alias("rel_path"), F.lit("typescript").alias("language"))
    imports = part.select(F.col("p_partkey").alias("file_id"), F.format_string("../d%d/m%d", F.col("p_partkey") % 5, F.col("p_partkey") + 1).alias("import_name"))
    return files, imports


_IMPORTS = "SELECT p.p_partkey AS file_id, q.p_partkey AS resolved_file_id FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey + 1 AND q.p_size % 5 = p.p_partkey % 5"


@query(_IMPORTS)
def q_resolve_imports(spark, d):
    files, imports = _modules(spark, d)
    return derive.resolve_imports(imports, files).select("file_id", "resolved_file_id")


@query(f"""WITH RECURSIVE i AS (SELECT file_id, resolved_file_id FROM ({_IMPORTS}) WHERE resolved_file_id IS NOT NULL), s AS (SELECT min(file_id) AS id FROM i),
 w AS (SELECT id, 0 AS depth FROM s UNION ALL SELECT resolved_file_id, depth + 1 FROM w JOIN i ON file_id = id WHERE depth < 4) SELECT id, min(depth)::INT AS depth FROM w WHERE depth > 0 GROUP BY id""")
def q_import_closure(spark, d):
    files, imports = _modules(spark, d)
    resolved = derive.resolve_imports(imports, files)
    start = resolved.filter("resolved_file_id IS NOT NULL").agg(F.min("file_id")).first()[0]
    return modules.import_closure(resolved, start if start is not None else -1)


@query("SELECT s.symbol_id AS route_id, m.symbol_id AS handler_id FROM g_symbols s JOIN (SELECT file_id, name, min(symbol_id) AS symbol_id FROM g_symbols GROUP BY ALL) m ON m.file_id = s.file_id AND m.name = s.name")
def q_route_handlers(spark, d):
    s = V.symbols(spark, d)
    return derive.resolve_handlers(s.select(F.col("symbol_id").alias("route_id"), "file_id", F.col("name").alias("handler_name")), s).select("route_id", "handler_id")


def _named_edges(spark, d: str) -> DataFrame:
    """Calls with names; those to every third symbol are not resolved."""
    names = V.symbols(spark, d).select(F.col("symbol_id").alias("dst"), F.col("name").alias("to_name"))
    to = F.when(F.col("dst") % 3 != 0, F.col("dst"))
    return V.edges(spark, d, "dst").join(names, "dst").select("edge_id", F.col("src").alias("from_id"), to.alias("to_id"), "to_name", F.lit("call").alias("kind"), (F.col("edge_id") % 400).cast("int").alias("line"))


_NAMED = "e AS (SELECT edge_id, src AS from_id, CASE WHEN dst % 3 <> 0 THEN dst END AS to_id, name AS to_name, (edge_id % 400)::INT AS line FROM g_edges JOIN g_symbols ON dst = symbol_id)"


@query(f"""WITH {_NAMED}, n AS (SELECT to_name, count(*) AS by_name FROM e GROUP BY 1), r AS (SELECT to_id, count(*) AS resolved FROM e WHERE to_id IS NOT NULL GROUP BY 1), s AS (SELECT name, count(*) AS definitions FROM g_symbols GROUP BY 1)
SELECT symbol_id, coalesce(resolved, 0) AS resolved, greatest(coalesce(by_name, 0), coalesce(resolved, 0)) AS by_name, definitions,
 CASE WHEN coalesce(resolved, 0) = greatest(coalesce(by_name, 0), coalesce(resolved, 0)) THEN 'exact' WHEN coalesce(resolved, 0) > 0 THEN 'bounded' ELSE 'name-aggregate' END AS precision
FROM g_symbols x JOIN s ON s.name = x.name LEFT JOIN n ON to_name = x.name LEFT JOIN r ON to_id = symbol_id""")
def q_caller_bounds(spark, d):
    out = S.caller_bounds(_named_edges(spark, d), V.symbols(spark, d))
    return out.withColumn("precision", reports.precision(F.col("resolved"), F.col("by_name")))


@query("""SELECT dst AS symbol_id, count(*) AS sites, count(DISTINCT src) AS callers, count(DISTINCT s.file_id) AS caller_files, count(*) FILTER (WHERE role = 'test') AS test_sites, count(DISTINCT s.file_id) FILTER (WHERE role = 'test') AS test_files
FROM g_edges JOIN g_symbols s ON src = s.symbol_id JOIN g_files f ON f.file_id = s.file_id GROUP BY dst""")
def q_call_counts(spark, d):
    return S.count_calls(V.edges(spark, d, "src"), V.symbols(spark, d), V.files(spark, d), V.tasks(spark, d))


@query(f"WITH {_NAMED} SELECT to_name, from_id, min(line) AS line FROM e JOIN g_symbols ON from_id = symbol_id JOIN g_files USING (file_id) WHERE role = 'test' GROUP BY ALL")
def q_first_test_calls(spark, d):
    return S.first_test_calls(_named_edges(spark, d), V.symbols(spark, d), V.files(spark, d))


@query(f"""WITH {_NAMED}, t AS (SELECT DISTINCT from_id, to_id FROM e JOIN g_symbols a ON from_id = a.symbol_id JOIN g_files fa ON fa.file_id = a.file_id JOIN g_symbols b ON to_id = b.symbol_id JOIN g_files fb ON fb.file_id = b.file_id WHERE fa.role = 'test' AND fb.role <> 'test')
SELECT 'call' AS kind, count(*) AS n FROM e UNION ALL SELECT 'tests', count(*) FROM t""")
def q_test_edge_synthesis(spark, d):
    n = V.tasks(spark, d)
    made = derive.test_edges(_named_edges(spark, d), V.symbols(spark, d), V.files(spark, d), n)
    return derive.test_edges(made, V.symbols(spark, d), V.files(spark, d), n).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s.symbol_id, arg_max(p.symbol_id, (p.line_start, -p.line_end, p.symbol_id)) AS parent_id, count(p.symbol_id)::INT AS depth FROM g_symbols s LEFT JOIN g_symbols p ON p.file_id = s.file_id AND p.line_start <= s.line_start AND s.line_end <= p.line_end
 AND (p.line_start < s.line_start OR p.line_end > s.line_end OR p.symbol_id < s.symbol_id) GROUP BY s.symbol_id""")
def q_skeleton(spark, d):
    return derive.skeleton_rows(V.symbols(spark, d)).select("symbol_id", "parent_id", "depth")


@query("""WITH h AS (SELECT event_id AS commit_sha, 1 + user_id % 55 AS file_id, event_id % 500 + 1 AS a, event_id % 500 + 1 + greatest(0, event_id % 3 - 1) AS b, event_id % 40 = 0 AS fresh, ts FROM events)
SELECT DISTINCT symbol_id, commit_sha, CASE WHEN fresh THEN 'file-addition' ELSE 'overlap' END AS match_strategy, round(greatest(0.3, 1 - least(0.7, greatest(0, date_diff('day', ts::DATE, DATE '2030-01-01')) / 365.0 * 0.1)), 9) AS confidence
FROM h JOIN g_symbols s ON s.file_id = h.file_id AND (fresh OR (line_start + 1 <= b AND line_end + 1 >= a))""")
def q_history_rows(spark, d):
    e = V.table(spark, d, "events")
    hunks = e.select(F.col("event_id").alias("commit_sha"), (1 + F.col("user_id") % 55).alias("file_id"), (F.col("event_id") % 500 + 1).alias("new_start"), (F.col("event_id") % 3).alias("new_lines"), (F.col("event_id") % 40 == 0).alias("is_file_addition"), F.lit(1).alias("lines_added"), F.lit(0).alias("lines_removed"), F.col("ts").alias("committed_at"))
    rows = derive.history_rows(hunks, V.symbols(spark, d), F.lit("2030-01-01").cast("date"))
    return rows.select("symbol_id", "commit_sha", "match_strategy", F.round("confidence", 9).alias("confidence"))


@query("""WITH w AS (SELECT a.file_id % 4 AS f, b.file_id % 4 AS t, src AS symbol_id FROM g_edges JOIN g_symbols a ON src = a.symbol_id JOIN g_symbols b ON dst = b.symbol_id) SELECT symbol_id, count(DISTINCT t) AS n FROM w WHERE f <> t GROUP BY symbol_id""")
def q_crossings(spark, d):
    members = V.files(spark, d).select("file_id", (F.col("file_id") % 4).alias("module_id"))
    edges = V.edges(spark, d).select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.lit("call").alias("kind"))
    return derive.crossings(edges, V.symbols(spark, d), members)


@query("""SELECT a.file_id % 4 AS from_id, b.file_id % 4 AS to_id, 'call' AS kind, count(*) AS weight FROM g_edges JOIN g_symbols a ON src = a.symbol_id JOIN g_symbols b ON dst = b.symbol_id WHERE a.file_id % 4 <> b.file_id % 4 GROUP BY ALL""")
def q_group_rollup(spark, d):
    members = V.files(spark, d).select("file_id", (F.col("file_id") % 4).alias("module_id"))
    edges = V.edges(spark, d).select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.lit("call").alias("kind"))
    return derive.rollup(derive.file_weights(edges, V.symbols(spark, d)), members)


#: Signals made of the columns of parts, for the rules of the risk score.
_SIGNAL = {s: f"(p_partkey * {i + 3} + p_size) % {7 + 5 * i}" for i, s in enumerate(evidence.SIGNALS)}
_PART = {
    "direct_callers": "least(24, {n})", "transitive_callers": "least(18, 3 * ln(1 + {n}))", "route_exposed": "CASE WHEN {n} > 0 THEN 20 ELSE 0 END", "direct_tests": "-least(30, 10 * {n})", "indirect_tests": "-least(8, 2 * {n})",
    "assertion_count": "-least(10, 2 * {n})", "recent_commits": "4 * ln(1 + least(200, {n}))", "distinct_authors": "CASE WHEN {n} <= 1 THEN 0 ELSE least(15, 3 * ({n} - 1)) END", "cyclomatic": "greatest(0, {n} - 8)", "cognitive": "0.5 * greatest(0, {n} - 12)",
    "config_keys": "least(15, 3 * {n})", "module_crossings": "least(20, 2 * {n})", "outbound_calls": "least(10, 2 * {n})", "inbound_links": "least(15, 3 * {n})", "cross_module_links": "least(10, 2 * {n})", "ambiguous_links": "least(5, {n})", "boundary_crossings": "least(12, 1.5 * {n})",
}
_LONG = " UNION ALL ".join(f"SELECT p_partkey AS symbol_id, {i} AS i, '{s}' AS signal, {_SIGNAL[s]} AS value, floor(CAST({_PART[s].format(n='(' + _SIGNAL[s] + ')')} AS DOUBLE) * 100 + 0.5) / 100 AS contribution FROM part" for i, s in enumerate(evidence.SIGNALS))


def _signals(spark, d: str) -> DataFrame:
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), *[F.expr(_SIGNAL[s]).cast("long").alias(s) for s in evidence.SIGNALS])


@query(f"SELECT symbol_id, signal, value, contribution, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY abs(contribution) DESC, i)::INT AS place FROM ({_LONG})) WHERE place <= 5")
def q_risk_contributions(spark, d):
    return evidence.contributions(_signals(spark, d), 5)


_RISK = f"SELECT symbol_id, floor(sum(contribution) * 100 + 0.5) / 100 AS score FROM (SELECT * FROM ({_LONG}) ORDER BY symbol_id, i) GROUP BY symbol_id"


@query(f"SELECT symbol_id, CASE WHEN score >= 50 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS risk, round(score, 1) AS score FROM ({_RISK})")
def q_risk_levels(spark, d):
    return evidence.risk(_signals(spark, d)).select("symbol_id", "risk", F.round("score", 1).alias("score"))


@query(f"SELECT CASE max(CASE WHEN score >= 50 THEN 2 WHEN score >= 20 THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk FROM ({_RISK})")
def q_overall_risk(spark, d):
    return evidence.worst(evidence.risk(_signals(spark, d)))


@query("""WITH w AS (SELECT symbol_id, name, split_part(name, ' ', 1) AS a, lower(qualified_name) AS q FROM g_symbols)
SELECT symbol_id, regexp_matches(q, '(^|[^a-z0-9])' || regexp_escape(lower(a))) OR regexp_matches(q, regexp_escape(lower(a)) || '($|[^a-z0-9])') AS matches FROM w""")
def q_name_matches(spark, d):
    return V.symbols(spark, d).select("symbol_id", evidence.name_matches(F.col("qualified_name"), F.split("name", " ")[0]).alias("matches"))


@query("""WITH n AS (SELECT DISTINCT p_name AS x, p_type AS t FROM part)
SELECT a.x AS a, b.x AS b, a.x <> b.x AND least(length(a.x), length(b.x)) >= 4 AND (left(lower(a.x), 4) = left(lower(b.x), 4) OR right(lower(a.x), 4) = right(lower(b.x), 4) OR substr(lower(a.x), 5) = substr(lower(b.x), 5)) AS alike FROM (SELECT DISTINCT x FROM n) a, (SELECT DISTINCT x FROM n) b WHERE left(a.x, 1) = left(b.x, 1)""")
def q_similar_names(spark, d):
    n = V.table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    m = n.withColumnRenamed("a", "b")
    return n.join(m, F.substring("a", 1, 1) == F.substring("b", 1, 1)).select("a", "b", similar_name(F.col("a"), F.col("b")).alias("alike"))


@query("""SELECT symbol_id, CASE WHEN qualified_name LIKE '%.%' THEN regexp_replace(qualified_name, '\\.[^.]*$', '') END AS scope, kind || ':' || qualified_name AS symbol_key, coalesce(regexp_replace(qualified_name, '\\.[^.]*$', '') = 'Brand#11', false) OR file_id = 12 AS shared FROM g_symbols""".replace("\\\\", "\\"))
def q_scopes(spark, d):
    s = V.symbols(spark, d)
    q = F.col("qualified_name")
    return s.select("symbol_id", scope(q).alias("scope"), X.symbol_key().alias("symbol_key"), shares_scope(F.col("file_id"), F.lit(12), q, F.lit("Brand#11.x")).alias("shared"))


@query("""SELECT 'http|' || method || '|' || path AS key, max(route_id) AS route_id FROM g_routes GROUP BY ALL""")
def q_contract_surface(spark, d):
    return reports.contract_surface(V.routes(spark, d)).select("key", "route_id")


@query("""WITH a AS (SELECT 'f' || o_custkey AS rel_path, max(o_orderstatus) AS hash FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT 'f' || o_custkey AS rel_path, max(o_orderstatus) AS hash FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)
SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'dirty' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (rel_path)""")
def q_file_changes(spark, d):
    return store.classify_changes(*_versions(spark, d))


def _versions(spark, d: str) -> tuple[DataFrame, DataFrame]:
    o = V.table(spark, d, "orders")
    side = lambda c: o.filter(c).groupBy(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("rel_path")).agg(F.max("o_orderstatus").alias("hash"))
    return side("o_orderkey % 3 <> 0"), side("o_orderkey % 3 <> 1")


_VERSIONS = "WITH a AS (SELECT 'f' || o_custkey AS rel_path, max(o_orderstatus) AS hash FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT 'f' || o_custkey AS rel_path, max(o_orderstatus) AS hash FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)"


@query(_VERSIONS + " SELECT 'parse' AS what, count(*) AS n FROM b LEFT JOIN a USING (rel_path) WHERE a.hash IS DISTINCT FROM b.hash UNION ALL SELECT 'kept', count(*) FROM a JOIN b USING (rel_path) WHERE a.hash = b.hash")
def q_hash_gate(spark, d):
    work, kept = store.gated(*_versions(spark, d))
    return work.agg(F.lit("parse").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(kept.agg(F.lit("kept").alias("what"), F.count(F.lit(1)).alias("n")))


@query(_VERSIONS + " SELECT rel_path, coalesce(b.hash, a.hash) AS hash FROM a FULL JOIN b USING (rel_path)")
def q_upsert(spark, d):
    return store.upsert(*_versions(spark, d), ["rel_path"])


@query(_VERSIONS + " SELECT rel_path, coalesce(a.hash, b.hash) AS hash FROM a FULL JOIN b USING (rel_path)")
def q_insert_ignore(spark, d):
    return store.insert_ignore(*_versions(spark, d), ["rel_path"])


@query(_VERSIONS + " SELECT rel_path, a.hash FROM a SEMI JOIN b USING (rel_path)")
def q_prune(spark, d):
    return store.prune(*_versions(spark, d))[0]


@query(_VERSIONS + " SELECT rel_path, b.hash FROM b LEFT JOIN a USING (rel_path) WHERE a.hash IS DISTINCT FROM b.hash")
def q_watermarks(spark, d):
    old, new = _versions(spark, d)
    return store.stale_watermarks(new, old.withColumn("options", F.lit("o")).withColumn("version", F.lit(1)), "o", 1)


@query("SELECT 'calls' AS table_name, count(*) AS n FROM g_calls UNION ALL SELECT 'edges', count(*) FROM g_edges UNION ALL SELECT 'symbols', count(*) FROM g_symbols")
def q_table_counts(spark, d):
    return reports.table_counts({"symbols": V.symbols(spark, d), "edges": V.edges(spark, d), "calls": V.calls(spark, d)})


@query("""WITH w AS (SELECT file_id, unnest(regexp_extract_all(lower(rel_path), '[a-z0-9]+')) AS term FROM g_files), l AS (SELECT file_id, count(*) AS len FROM w GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
h AS (SELECT q, file_id, count(*) AS tf FROM w, (VALUES ('brand'), ('1')) v(q) WHERE starts_with(term, q) GROUP BY ALL), f AS (SELECT q, count(*) AS df FROM h GROUP BY q)
SELECT file_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN f USING (q) JOIN l USING (file_id), st GROUP BY file_id""")
def q_search_files(spark, d):
    return search.bm25(search.file_index(V.files(spark, d)), search.query_terms("Brand 1")).select("id", F.round("score", 6).alias("score"))


@query("""SELECT page_id AS row_id, CASE page_id % 3 WHEN 0 THEN page_id END AS number, CASE page_id % 3 WHEN 0 THEN 'https://github.com/o/r/pull/' || page_id END AS url FROM pages""")
def q_pull_requests(spark, d):
    n = F.col("page_id").cast("string")
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Fix it (#"), n, F.lit(")\nmore"))).otherwise(F.concat(F.lit("Fix #"), n))
    number = git.pr_number(text)
    return V.table(spark, d, "pages").select(F.col("page_id").alias("row_id"), number.cast("long").alias("number"), git.pr_url(F.lit("https://github.com/o/r.git"), number).alias("url"))


@query("""SELECT event_id AS commit_sha, event_id % 90 + 1 AS new_start, CASE WHEN event_id % 4 = 0 THEN 1 ELSE event_id % 4 END AS new_lines, event_id % 10 = 0 AS is_file_addition, CASE WHEN event_id % 4 = 0 THEN 1 ELSE event_id % 4 END AS lines_added, 1 AS lines_removed FROM events""")
def q_patch_rows(spark, d):
    e = V.table(spark, d, "events")
    start, n = F.col("event_id") % 90 + 1, F.col("event_id") % 4
    count = F.when(n == 0, F.lit(1)).otherwise(n)
    head = F.when(F.col("event_id") % 10 == 0, F.lit("new file mode 100644\n--- /dev/null\n+++ b/x\n")).otherwise(F.lit("--- a/x\n+++ b/x\n"))
    size = F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit(","), n.cast("string")))
    patch = F.concat(head, F.lit("@@ -3 +"), start.cast("string"), size, F.lit(" @@ def f\n-old\n"), F.repeat(F.lit("+new\n"), count.cast("int")))
    rows = git.patch_rows(e.select(F.col("event_id").alias("commit_sha"), F.lit(1).cast("long").alias("file_id"), patch.alias("patch")))
    return rows.select("commit_sha", *[F.col(c).cast("long").alias(c) for c in ("new_start", "new_lines")], "is_file_addition", *[F.col(c).cast("long").alias(c) for c in ("lines_added", "lines_removed")])


@query("SELECT 'pypi' AS ecosystem, 'lib' || s_suppkey AS name, '==1.' || s_suppkey AS version, 'p' || s_suppkey || '/requirements.txt' AS manifest_path, false AS is_dev FROM supplier")
def q_dependencies(spark, d):
    key = F.col("s_suppkey").cast("string")
    return manifests.dependencies(V.table(spark, d, "supplier").select(F.concat(F.lit("p"), key, F.lit("/requirements.txt")).alias("rel_path"), F.concat(F.lit("# top\n-r x\nlib"), key, F.lit(" ==1."), key, F.lit("  # end\n")).alias("content")))


@query("SELECT 'Svc' || s_suppkey || '/Get' AS operation, 'Get' AS handler_name, 'Svc' || s_suppkey AS service FROM supplier")
def q_proto_routes(spark, d):
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("service Svc"), key, F.lit(" { // rpc Old(A) returns (B)\n rpc Get (stream Q) returns (R);\n}\n"))
    return manifests.proto_routes(V.table(spark, d, "supplier").select(F.concat(key, F.lit(".proto")).alias("rel_path"), text.alias("content"))).select("operation", "handler_name", "service")


@query("SELECT 'svc' || s_suppkey AS host, ['k' || s_suppkey || '.yaml'] AS paths FROM supplier".replace("['k' || s_suppkey || '.yaml'] AS paths", "'k' || s_suppkey || '.yaml' AS paths"))
def q_service_hosts(spark, d):
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("kind: Service\nmetadata:\n  labels: x\n  name: Svc"), key, F.lit("\n---\nkind: Job\nmetadata:\n  name: no\n"))
    return manifests.service_hosts(V.table(spark, d, "supplier").select(F.concat(F.lit("k"), key, F.lit(".yaml")).alias("rel_path"), text.alias("content"))).select("host", F.array_join("paths", ",").alias("paths"))


@query("""WITH f AS (SELECT p_partkey AS file_id, p_size % 6 AS g FROM part) SELECT file_id, CASE WHEN g < 3 THEN 'services/s' || g WHEN g = 3 THEN 'packages/p' END AS root FROM f WHERE g <= 3""")
def q_boundary_members(spark, d):
    g = F.col("p_size") % 6
    folder = F.when(g < 3, F.concat(F.lit("services/s"), g.cast("string"), F.lit("/src/"))).when(g == 3, F.lit("packages/p/")).otherwise(F.lit(""))
    files = V.table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.concat(folder, F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("rel_path"), F.lit("").alias("content"))
    return manifests.boundary_members(files, manifests.boundary_roots(files))


@query("""WITH l AS (SELECT doc_id, i AS line, lines[i] AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))
SELECT doc_id AS site_id, substr(string_agg(text, chr(10) ORDER BY line), 1, 400) AS snippet FROM l WHERE line <= 3 GROUP BY doc_id""")
def q_snippets(spark, d):
    docs = V.table(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "text")).select("file_id", (F.col("p") + 1).alias("line"), "text")
    sites = docs.select(F.col("doc_id").alias("site_id"), F.col("doc_id").alias("file_id"), F.lit(1).alias("line"))
    return derive.snippets(sites, lines, 2, 2).select("site_id", "snippet")


@query("""SELECT file_id, count(*) AS hits FROM (SELECT doc_id AS file_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents) WHERE regexp_matches(t, '\\bexpect\\s*\\(') OR regexp_matches(t, '(?i)\\bassert(?:equals?|true|false|throws?|that)?\\s*\\(') OR regexp_matches(t, '\\bassert\\s+') OR regexp_matches(t, '(?i)\\b(?:should|to)\\.(?:be|equal|throw|deep|have|eq|exist)\\b') GROUP BY 1""".replace("\\\\", "\\"))
def q_assertion_lines(spark, d):
    lines = V.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    return lines.filter(F.col("text").rlike(evidence.ASSERTIONS)).groupBy("file_id").agg(F.count(F.lit(1)).alias("hits"))


@query("""SELECT commit_sha, committed_at FROM (SELECT commit_sha, max(committed_at) AS committed_at FROM g_history GROUP BY 1) ORDER BY committed_at DESC, commit_sha DESC LIMIT 25""")
def q_newest_commits(spark, d):
    return lookups.newest_commits(V.history(spark, d), 25)


@query("""SELECT symbol_id, commit_sha, place, total FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY committed_at DESC, commit_sha DESC)::INT AS place, count(*) OVER (PARTITION BY symbol_id) AS total FROM g_history) WHERE place <= 12""")
def q_first_rows_with_totals(spark, d):
    return lookups.first_of(V.history(spark, d, "symbol_id"), ["symbol_id"], [F.desc("committed_at"), F.desc("commit_sha")], 12).select("symbol_id", "commit_sha", "place", "total")


@query("""WITH l AS (SELECT c.call_id, r.route_id, c.path FROM g_calls c JOIN g_routes r ON r.path = c.path AND r.method = 'ANY') SELECT call_id, route_id, (call_id % 5) AS from_id, (route_id % 5) AS to_id FROM l WHERE call_id % 5 <> route_id % 5""")
def q_cross_module_links(spark, d):
    links = services.link_calls(V.calls(spark, d), V.routes(spark, d)).filter("match_kind = 'literal_path'")
    return links.select("call_id", "route_id", (F.col("call_id") % 5).alias("from_id"), (F.col("route_id") % 5).alias("to_id")).filter("from_id <> to_id")

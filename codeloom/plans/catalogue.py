"""Queries by name, each over whole tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, history, search, services, similarity
from ..operators import lookups
from ..operators import symbols as S
from ..session import shared_dir
from ..streaming.refresh import Snapshots, refresh
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = V.with_views(sql)
        return f

    return add


@query("SELECT s.symbol_id, s.name, s.loc, count(DISTINCT src) AS callers FROM g_edges JOIN g_symbols s ON dst = symbol_id GROUP BY ALL ORDER BY callers DESC, symbol_id LIMIT 20")
def q_top_hubs(spark, d):
    hubs = V.edges(spark, d).groupBy(F.col("dst").alias("symbol_id")).agg(F.count_distinct("src").alias("callers"))
    return hubs.join(V.symbols(spark, d), "symbol_id").select("symbol_id", "name", "loc", "callers").orderBy(F.desc("callers"), "symbol_id").limit(20)


@query("SELECT edge_id, src AS caller_id, name AS caller, rel_path, dst AS callee_id FROM g_edges JOIN g_symbols ON src = symbol_id JOIN g_files USING (file_id)")
def q_callers_by_id(spark, d):
    return S.call_sites(V.edges(spark, d), V.symbols(spark, d), V.files(spark, d)).select("edge_id", "caller_id", "caller", "rel_path", "callee_id")


@query("SELECT src AS caller_id, dst AS callee_id, name AS callee, count(*) AS sites FROM g_edges LEFT JOIN g_symbols ON dst = symbol_id GROUP BY ALL")
def q_unique_callees(spark, d):
    return S.callees(V.edges(spark, d), V.symbols(spark, d))


@query("SELECT name, count(*) AS sites, count(DISTINCT src) AS callers FROM g_edges JOIN g_symbols ON dst = symbol_id GROUP BY name")
def q_count_callers(spark, d):
    e = V.edges(spark, d).join(V.symbols(spark, d), F.col("dst") == F.col("symbol_id"))
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("src").alias("callers"))


@query("SELECT dst AS callee_id, rel_path, count(*) AS sites FROM g_edges JOIN g_symbols ON src = symbol_id JOIN g_files USING (file_id) GROUP BY ALL")
def q_group_callers_by_file(spark, d):
    return S.call_sites(V.edges(spark, d), V.symbols(spark, d), V.files(spark, d)).groupBy("callee_id", "rel_path").agg(F.count(F.lit(1)).alias("sites"))


@query("SELECT name, count(*) AS definitions, count(DISTINCT string_split(qualified_name, '.')[1]) AS owners FROM g_symbols GROUP BY name HAVING count(*) > 1")
def q_shared_names(spark, d):
    s = V.symbols(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("definitions"), F.count_distinct(F.get(F.split("qualified_name", r"\."), F.lit(0))).alias("owners"))
    return s.filter("definitions > 1")


@query("SELECT DISTINCT name, string_split(qualified_name, '.')[1] AS owner FROM g_symbols")
def q_owner_classes(spark, d):
    return V.symbols(spark, d).select("name", F.get(F.split("qualified_name", r"\."), F.lit(0)).alias("owner")).distinct()


@query("SELECT symbol_id, name, loc FROM g_symbols WHERE name ILIKE '%re%' OR qualified_name ILIKE '%re%'")
def q_find_symbols(spark, d):
    return lookups.find_symbols(V.symbols(spark, d), "RE", limit=None).select("symbol_id", "name", "loc")


@query("SELECT symbol_id, name, loc FROM g_symbols JOIN g_files USING (file_id) WHERE NOT is_vendor AND NOT is_generated AND role <> 'test' ORDER BY loc DESC, symbol_id LIMIT 50")
def q_top_symbols(spark, d):
    s = V.symbols(spark, d).join(V.files(spark, d), "file_id").filter(lookups.lens(symbol_role=False))
    return s.select("symbol_id", "name", "loc").orderBy(F.desc("loc"), "symbol_id").limit(50)


@query("SELECT symbol_id, name, role, is_vendor, is_generated FROM g_symbols JOIN g_files USING (file_id) WHERE NOT is_generated")
def q_lens_all(spark, d):
    return V.symbols(spark, d).join(V.files(spark, d), "file_id").filter(lookups.lens(True, False, True, symbol_role=False)).select("symbol_id", "name", "role", "is_vendor", "is_generated")


@query("SELECT symbol_id, loc, dense_rank() OVER (PARTITION BY kind ORDER BY loc DESC) AS rank FROM g_symbols WHERE loc >= 10")
def q_complexity_rank(spark, d):
    return V.symbols(spark, d).filter("loc >= 10").select("symbol_id", "loc", F.dense_rank().over(Window.partitionBy("kind").orderBy(F.desc("loc"))).cast("long").alias("rank"))


@query("SELECT symbol_id, file_id, line_start, row_number() OVER (PARTITION BY file_id ORDER BY line_start, symbol_id) AS place FROM g_symbols")
def q_file_symbols(spark, d):
    order = Window.partitionBy("file_id").orderBy("line_start", "symbol_id")
    return V.symbols(spark, d).select("symbol_id", "file_id", "line_start", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def q_page_links(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(200).limit(100)


_RESOLVED = """
WITH refs AS (SELECT edge_id AS ref_id, a.file_id, b.name AS to_name FROM g_edges JOIN g_symbols a ON src = a.symbol_id JOIN g_symbols b ON dst = b.symbol_id),
imports AS (SELECT DISTINCT a.file_id AS from_file, a.file_id + 1 AS to_file FROM g_files a),
local AS (SELECT file_id, name, min(symbol_id) AS id FROM g_symbols GROUP BY ALL),
imp AS (SELECT from_file, name, min(id) AS id FROM imports JOIN local ON to_file = file_id GROUP BY ALL),
any_ AS (SELECT name, min(id) AS id FROM local GROUP BY name),
r AS (SELECT ref_id, refs.file_id, to_name, coalesce(l.id, i.id, y.id) AS to_id,
      CASE WHEN l.id IS NOT NULL THEN 'same_file' WHEN i.id IS NOT NULL THEN 'imported' WHEN y.id IS NOT NULL THEN 'global' ELSE 'none' END AS tier
      FROM refs LEFT JOIN local l ON l.file_id = refs.file_id AND l.name = to_name LEFT JOIN imp i ON from_file = refs.file_id AND i.name = to_name LEFT JOIN any_ y ON y.name = to_name)
"""


def _resolved(spark, d):
    s = V.symbols(spark, d)
    a, b = s.select(F.col("symbol_id").alias("src"), "file_id"), s.select(F.col("symbol_id").alias("dst"), F.col("name").alias("to_name"))
    refs = V.edges(spark, d).join(a, "src").join(b, "dst").select(F.col("edge_id").alias("ref_id"), "file_id", "to_name")
    imports = V.files(spark, d).select(F.col("file_id").alias("from_file"), (F.col("file_id") + 1).alias("to_file"))
    return S.resolve(refs, s, imports)


@query(_RESOLVED + "SELECT ref_id, file_id, to_name, to_id, tier FROM r")
def q_resolve_edges(spark, d):
    return _resolved(spark, d)


@query(_RESOLVED + "SELECT tier, count(*) AS n FROM r GROUP BY tier")
def q_resolve_stats(spark, d):
    return _resolved(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT edge_id, src, dst FROM g_edges JOIN g_symbols a ON src = a.symbol_id JOIN g_files fa ON fa.file_id = a.file_id JOIN g_symbols b ON dst = b.symbol_id JOIN g_files fb ON fb.file_id = b.file_id
WHERE fa.role = 'test' AND fb.role <> 'test'""")
def q_test_edges(spark, d):
    roles = V.symbols(spark, d).join(V.files(spark, d), "file_id").select("symbol_id", "role")
    tests = roles.filter("role = 'test'").select(F.col("symbol_id").alias("src"))
    e = V.edges(spark, d).join(tests, "src", "left_semi")
    return e.join(tests.withColumnRenamed("src", "dst"), "dst", "left_anti").select("edge_id", "src", "dst")


@query("""WITH p AS (SELECT symbol_id AS point_id, file_id, line_start + 3 AS line FROM g_symbols)
SELECT point_id, arg_min(s.symbol_id, (s.line_end - s.line_start, s.symbol_id)) AS span_id FROM p LEFT JOIN g_symbols s ON s.file_id = p.file_id AND line BETWEEN s.line_start AND s.line_end GROUP BY point_id""")
def q_enclosing_span(spark, d):
    s = V.symbols(spark, d)
    points = s.select(F.col("symbol_id").alias("point_id"), "file_id", (F.col("line_start") + 3).alias("line"))
    return S.enclosing(points, s.select(F.col("symbol_id").alias("span_id"), "file_id", "line_start", "line_end"))


@query("""WITH h AS (SELECT event_id AS hunk_id, 1 + user_id % 55 AS file_id, event_id % 500 AS a, event_id % 500 + 2 AS b FROM events)
SELECT DISTINCT hunk_id, symbol_id AS span_id FROM h JOIN g_symbols s ON s.file_id = h.file_id AND line_start <= b AND line_end >= a""")
def q_overlap_spans(spark, d):
    h = V.table(spark, d, "events").select(F.col("event_id").alias("hunk_id"), (1 + F.col("user_id") % 55).alias("file_id"), (F.col("event_id") % 500).alias("start"), (F.col("event_id") % 500 + 2).alias("end"))
    return S.overlapping(h, V.symbols(spark, d).select(F.col("symbol_id").alias("span_id"), "file_id", "line_start", "line_end"))


@query("""WITH roots AS (SELECT * FROM (VALUES ('/en'), ('/en/1'), ('/fr'), ('/de'), ('/')) t(root))
SELECT call_id, arg_max(root, length(root)) AS root FROM g_calls JOIN roots ON root = '/' OR path = root OR starts_with(path, root || '/') GROUP BY call_id""")
def q_longest_prefix(spark, d):
    roots = spark.createDataFrame([("/en",), ("/en/1",), ("/fr",), ("/de",), ("/",)], "root string")
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.when(k == 1, "/").otherwise(F.array_join(F.slice(parts, 1, k), "/")))
    c = V.calls(spark, d).select("call_id", F.explode(prefixes).alias("root"))
    return c.join(roots, "root").groupBy("call_id").agg(F.max_by("root", F.length("root")).alias("root"))


@query("SELECT role, count(DISTINCT file_id) AS files, count(symbol_id) AS symbols, sum(loc)::BIGINT AS loc FROM g_files LEFT JOIN g_symbols USING (file_id) GROUP BY role")
def q_role_counts(spark, d):
    j = V.files(spark, d).join(V.symbols(spark, d), "file_id", "left")
    return j.groupBy("role").agg(F.count_distinct("file_id").alias("files"), F.count("symbol_id").alias("symbols"), F.sum("loc").alias("loc"))


def _file_weights(spark, d):
    s = V.symbols(spark, d)
    a, b = s.select(F.col("symbol_id").alias("src"), F.col("file_id").alias("from_file")), s.select(F.col("symbol_id").alias("dst"), F.col("file_id").alias("to_file"))
    return V.edges(spark, d).join(a, "src").join(b, "dst").groupBy("from_file", "to_file").agg(F.count(F.lit(1)).alias("weight"))


_WEIGHTS = "WITH w AS (SELECT a.file_id AS from_file, b.file_id AS to_file, count(*) AS weight FROM g_edges JOIN g_symbols a ON src = a.symbol_id JOIN g_symbols b ON dst = b.symbol_id GROUP BY ALL) "


@query(_WEIGHTS + "SELECT * FROM w WHERE from_file <> to_file")
def q_file_weights(spark, d):
    return _file_weights(spark, d).filter("from_file <> to_file")


@query(_WEIGHTS + """, m AS (SELECT from_file // 10 AS f, to_file // 10 AS t, sum(weight)::BIGINT AS w FROM w GROUP BY ALL),
e AS (SELECT f AS module, CASE WHEN f = t THEN w ELSE 0 END AS intra, w FROM m UNION ALL SELECT t, 0, w FROM m WHERE f <> t)
SELECT module, sum(intra)::BIGINT AS intra, sum(w)::BIGINT AS total, round(sum(intra) / sum(w), 8) AS cohesion FROM e GROUP BY module""")
def q_cohesion(spark, d):
    m = _file_weights(spark, d).groupBy(F.floor(F.col("from_file") / 10).alias("f"), F.floor(F.col("to_file") / 10).alias("t")).agg(F.sum("weight").alias("w"))
    e = m.select(F.col("f").alias("module"), F.when(F.col("f") == F.col("t"), F.col("w")).otherwise(0).alias("intra"), "w")
    e = e.unionByName(m.filter("f <> t").select(F.col("t").alias("module"), F.lit(0).cast("long").alias("intra"), "w"))
    return e.groupBy("module").agg(F.sum("intra").alias("intra"), F.sum("w").alias("total"), F.round(F.sum("intra") / F.sum("w"), 8).alias("cohesion"))


@query("SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)) WHERE r = 1")
def q_mode_tiebreak(spark, d):
    return S.most_frequent(V.table(spark, d, "documents"), "source", "lang")


_COUPLING = """
WITH rows_ AS (SELECT DISTINCT symbol_id, commit_sha, committed_at FROM g_history),
ok AS (SELECT commit_sha FROM rows_ GROUP BY 1 HAVING count(DISTINCT symbol_id) <= 50),
recent AS (SELECT * FROM rows_ WHERE committed_at >= TIMESTAMP '{since}'),
good AS (SELECT DISTINCT symbol_id, commit_sha FROM recent SEMI JOIN ok USING (commit_sha)),
eff AS (SELECT symbol_id, count(*) AS e FROM good GROUP BY 1), pc AS (SELECT symbol_id, count(*) AS n FROM recent GROUP BY 1),
sup AS (SELECT a.symbol_id AS target, b.symbol_id AS partner, count(*) AS support FROM good a JOIN good b ON a.commit_sha = b.commit_sha AND a.symbol_id <> b.symbol_id GROUP BY ALL HAVING count(*) >= 2)
SELECT target, partner, support, floor(support / e * 100 + 0.5) / 100 AS confidence, n AS partner_commits FROM sup JOIN eff ON target = eff.symbol_id JOIN pc ON partner = pc.symbol_id
"""


@query(_COUPLING.format(since="1900-01-01"))
def q_coupling(spark, d):
    return history.coupling(V.history(spark, d), tasks=V.tasks(spark, d))


@query(_COUPLING.format(since="1996-06-01"))
def q_coupling_since(spark, d):
    return history.coupling(V.history(spark, d), since=F.to_timestamp(F.lit("1996-06-01")), tasks=V.tasks(spark, d))


@query("SELECT commit_sha, count(DISTINCT symbol_id) AS breadth FROM g_history GROUP BY 1 HAVING count(DISTINCT symbol_id) > 5")
def q_noise_commits(spark, d):
    return V.history(spark, d).groupBy("commit_sha").agg(F.count_distinct("symbol_id").alias("breadth")).filter("breadth > 5")


@query("""WITH by_ AS (SELECT file_id, author, count(*) AS n, max(committed_at) AS latest FROM g_churn GROUP BY ALL),
top AS (SELECT file_id, string_agg(author, ',' ORDER BY r) AS authors FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, latest DESC, author) AS r FROM by_) WHERE r <= 2 GROUP BY file_id)
SELECT file_id, count(*) AS commits, arg_max(commit_sha, (committed_at, commit_sha)) AS last_sha, max(committed_at) AS last_at, any_value(authors) AS authors FROM g_churn JOIN top USING (file_id) GROUP BY file_id""")
def q_churn(spark, d):
    return history.churn(V.churn_events(spark, d))


@query("SELECT file_id, count(*) AS commits FROM g_churn GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def q_top_churned(spark, d):
    return V.churn_events(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("commits")).orderBy(F.desc("commits"), "file_id").limit(20)


@query("SELECT symbol_id, commit_sha, committed_at, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY committed_at DESC, commit_sha DESC) AS r FROM g_history) WHERE r <= 10")
def q_history(spark, d):
    order = Window.partitionBy("symbol_id").orderBy(F.desc("committed_at"), F.desc("commit_sha"))
    return V.history(spark, d, "symbol_id").withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 10").select("symbol_id", "commit_sha", "committed_at", "place")


def _rounds() -> str:
    head = "WITH n AS (SELECT count(*)::DOUBLE AS n FROM part), e AS MATERIALIZED (SELECT DISTINCT src, dst FROM g_edges), o AS (SELECT src, count(*) AS deg FROM e GROUP BY src), r0 AS (SELECT symbol_id AS id, 1.0 / n AS rank FROM g_symbols, n)"
    for k in range(20):
        head += f", r{k + 1} AS MATERIALIZED (SELECT r.id, 0.15 / n + 0.85 * coalesce(f, 0) AS rank FROM r{k} r CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank / deg) AS f FROM e JOIN o USING (src) JOIN r{k} ON id = src GROUP BY dst) ON dst = r.id)"
    return head + " SELECT id, round(rank, 8) AS rank FROM r20"


@query(_rounds())
def q_pagerank(spark, d):
    return graph.pagerank(V.symbols(spark, d).select(F.col("symbol_id").alias("id")), V.edges(spark, d)).select("id", F.round("rank", 8).alias("rank"))


def _levels(a: str, b: str, depth: int) -> str:
    out = f"WITH s AS (SELECT min(symbol_id) AS start FROM g_symbols), e AS MATERIALIZED (SELECT DISTINCT {a} AS x, {b} AS y FROM g_edges), l0 AS (SELECT start, start AS id, 0 AS depth FROM s)"
    for k in range(depth):
        out += f", l{k + 1} AS MATERIALIZED (SELECT * FROM l{k} UNION ALL SELECT DISTINCT start, y, {k + 1} FROM l{k} JOIN e ON id = x WHERE depth = {k} AND y NOT IN (SELECT id FROM l{k}))"
    return out + f" SELECT start, id, depth FROM l{depth} WHERE depth > 0"


def _start(spark, d):
    return V.symbols(spark, d).agg(F.min("symbol_id").alias("start"))


@query(_levels("src", "dst", 3))
def q_forward_reach(spark, d):
    return graph.reach(V.edges(spark, d), _start(spark, d), 3)


@query(_levels("dst", "src", 3))
def q_reverse_reach(spark, d):
    return graph.reach(V.edges(spark, d), _start(spark, d), 3, forward=False)


@query(f"SELECT depth, count(*) AS n FROM ({_levels('dst', 'src', 3)}) GROUP BY depth".replace("g_edges", "g_edges"))
def q_trace_histogram(spark, d):
    return graph.reach(V.edges(spark, d), _start(spark, d), 3, forward=False).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM g_edges UNION SELECT dst, src FROM g_edges),
c AS (SELECT symbol_id AS id, symbol_id AS label FROM g_symbols UNION SELECT b, label FROM c JOIN e ON id = a WHERE label < b)
SELECT id, min(label) AS component FROM c GROUP BY id""")
def q_components(spark, d):
    return graph.components(V.symbols(spark, d).select(F.col("symbol_id").alias("id")), V.edges(spark, d))


@query(r"""SELECT symbol_id, t AS token FROM (SELECT symbol_id, unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(qualified_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[\s._\-/:]+'), lambda x: x <> ''))) AS t FROM g_symbols)""")
def q_tokens(spark, d):
    return V.symbols(spark, d).select("symbol_id", F.explode(T.identifier_tokens(F.col("qualified_name"))).alias("token"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'idiot')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(len) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM t)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / m)), 6) AS score FROM t, s WHERE a > 0 OR b > 0""")
def q_bm25_docs(spark, d):
    postings = search.index(V.table(spark, d, "documents"), "doc_id", {"text": F.col("text")})
    return search.bm25(postings, ["the", "idiot"], prefixes=False).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT call_id, method, path, host FROM g_calls")
def q_normalize_url(spark, d):
    return V.calls(spark, d)


_LINKS = """
WITH ex AS (SELECT call_id, route_id, 'literal_path' AS match_kind, 0.95 * CASE WHEN c.method = r.method THEN 1.0 ELSE 0.9 END AS raw FROM g_calls c JOIN g_routes r ON c.path = r.path AND (c.method = r.method OR r.method = 'ANY')),
pa AS (SELECT call_id, route_id, 'route_pattern' AS match_kind, 0.85 * CASE WHEN c.method = r.method THEN 1.0 ELSE 0.9 END AS raw FROM g_calls c JOIN g_routes r ON r.path LIKE '%:%' AND (c.method = r.method OR r.method = 'ANY')
  AND len(string_split(c.path, '/')) = 3 AND string_split(c.path, '/')[2] = string_split(r.path, '/')[2] WHERE call_id NOT IN (SELECT call_id FROM ex)),
u AS (SELECT call_id, route_id, match_kind, floor(raw * 1000 + 0.5) / 1000 AS confidence FROM (SELECT * FROM ex UNION ALL SELECT * FROM pa)),
l AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY confidence DESC, route_id, match_kind) AS r, count(*) OVER (PARTITION BY call_id) AS candidates FROM u)
"""


@query(_LINKS + "SELECT call_id, route_id, match_kind, confidence, candidates FROM l WHERE r = 1")
def q_service_links(spark, d):
    return services.link_calls(V.calls(spark, d), V.routes(spark, d))


@query(_LINKS + "SELECT match_kind, count(*) AS n FROM l WHERE r = 1 GROUP BY match_kind")
def q_links_by_kind(spark, d):
    return services.link_calls(V.calls(spark, d), V.routes(spark, d)).groupBy("match_kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
SELECT o_custkey, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b USING (o_custkey) WHERE a.n IS DISTINCT FROM b.n OR a.s IS DISTINCT FROM b.s""")
def q_contract_diff(spark, d):
    o = V.table(spark, d, "orders")
    side = lambda c: o.filter(c).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("s"))
    cut = F.to_timestamp(F.lit("1995-01-01"))
    return history.diff(side(F.col("o_orderdate") < cut), side(F.col("o_orderdate") >= cut), ["o_custkey"], ["n", "s"])


@query("""WITH c AS (SELECT dst AS symbol_id, count(*) AS n FROM g_edges GROUP BY 1), t AS (SELECT dst AS symbol_id, count(*) AS n FROM g_edges JOIN g_symbols a ON src = a.symbol_id JOIN g_files f ON f.file_id = a.file_id WHERE role = 'test' GROUP BY 1),
h AS (SELECT symbol_id, count(*) AS n, count(DISTINCT author) AS a FROM g_history GROUP BY 1),
x AS (SELECT s.symbol_id, CAST(least(24, coalesce(c.n, 0)) AS DOUBLE) AS direct_callers, floor(-CAST(least(30, 10 * coalesce(t.n, 0)) AS DOUBLE) * 100 + 0.5) / 100 AS direct_tests, floor(4 * ln(1 + least(200, coalesce(h.n, 0))) * 100 + 0.5) / 100 AS recent_commits,
 CASE WHEN coalesce(h.a, 0) <= 1 THEN 0.0 ELSE CAST(least(15, 3 * (h.a - 1)) AS DOUBLE) END AS authors, CAST(greatest(0, loc - 8) AS DOUBLE) AS complexity
 FROM g_symbols s LEFT JOIN c USING (symbol_id) LEFT JOIN t USING (symbol_id) LEFT JOIN h USING (symbol_id))
SELECT symbol_id, direct_callers, direct_tests, recent_commits, authors, complexity, round(direct_callers + direct_tests + recent_commits + authors + complexity, 2) AS score,
 CASE WHEN round(direct_callers + direct_tests + recent_commits + authors + complexity, 2) >= 50 THEN 'high' WHEN round(direct_callers + direct_tests + recent_commits + authors + complexity, 2) >= 20 THEN 'medium' ELSE 'low' END AS bucket FROM x""")
def q_risk(spark, d):
    s, e = V.symbols(spark, d), V.edges(spark, d, "dst")
    callers = e.groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias("callers"))
    tests = s.join(V.files(spark, d).filter("role = 'test'"), "file_id").select(F.col("symbol_id").alias("src"))
    tested = e.join(tests, "src", "left_semi").groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias("tests"))
    h = V.history(spark, d, "symbol_id").groupBy("symbol_id").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("author").alias("people"))
    x = s.join(callers, "symbol_id", "left").join(tested, "symbol_id", "left").join(h, "symbol_id", "left").na.fill(0, ["callers", "tests", "commits", "people"])
    x = x.select(
        "symbol_id",
        F.least(F.lit(24), F.col("callers")).cast("double").alias("direct_callers"),
        history.half_up(-F.least(F.lit(30), 10 * F.col("tests")).cast("double")).alias("direct_tests"),
        history.half_up(4 * F.log(1 + F.least(F.lit(200), F.col("commits")).cast("double"))).alias("recent_commits"),
        F.when(F.col("people") <= 1, 0.0).otherwise(F.least(F.lit(15), 3 * (F.col("people") - 1)).cast("double")).alias("authors"),
        F.greatest(F.lit(0), F.col("loc") - 8).cast("double").alias("complexity"),
    )
    score = F.round(F.col("direct_callers") + F.col("direct_tests") + F.col("recent_commits") + F.col("authors") + F.col("complexity"), 2)
    return x.withColumn("score", score).withColumn("bucket", F.when(F.col("score") >= 50, "high").when(F.col("score") >= 20, "medium").otherwise("low"))


@query("""SELECT conv_id, turn, n FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b < 1000""")
def q_token_budget(spark, d):
    c = V.table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return S.within_budget(c, F.col("n"), ["turn", "role", "text"], 1000, "conv_id").select("conv_id", "turn", "n")


@query("SELECT doc_id, i AS line, lines[i] AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))")
def q_text_lines(spark, d):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return V.table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "text")


#: Shape hashes of whole documents: tokens, grams, each distinct gram's FNV-1a, votes of the bits.
SHAPE_SQL = rf"""s_kinds AS MATERIALIZED (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '{similarity.SHAPE.replace("'", "''")}'), lambda t: NOT regexp_matches(t, '^(//|#|/[*])')),
    lambda t: CASE WHEN regexp_matches(t, '^["''`]') THEN 'STRING' WHEN regexp_matches(t, '^[A-Za-z_$]') THEN 'NAME' WHEN regexp_matches(t, '^[0-9]') THEN 'NUMBER' ELSE 'OP:' || t END) AS kinds FROM documents),
  s_grams AS MATERIALIZED (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, kinds[i] || '|' || kinds[i + 1] || '|' || kinds[i + 2] AS gram FROM (SELECT doc_id, kinds, unnest(range(1, len(kinds) - 1)) AS i FROM s_kinds WHERE len(kinds) >= 8)) GROUP BY ALL),
  s_hashes AS MATERIALIZED (SELECT gram, list_reduce(list_prepend({similarity.FNV_START}::UHUGEINT, list_transform(string_split(gram, ''), lambda c: (unicode(c) & 255)::UHUGEINT)), lambda h, c: (xor(h, c) * {similarity.FNV_PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM (SELECT DISTINCT gram FROM s_grams)),
  s_votes AS MATERIALIZED (SELECT doc_id, b, sum(CASE WHEN (h // power2) % 2 = 1 THEN n ELSE -n END) AS votes FROM s_grams JOIN s_hashes USING (gram), (SELECT b, (1::UHUGEINT << b::UHUGEINT) AS power2 FROM range(0, 64) r(b)) GROUP BY ALL),
  s_doc AS MATERIALIZED (SELECT doc_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS hash FROM (SELECT doc_id, CAST(sum(CASE WHEN votes > 0 THEN (1::HUGEINT << b::HUGEINT) ELSE 0 END) AS HUGEINT) AS u FROM s_votes GROUP BY doc_id))"""


def _shapes(spark, d):
    return similarity.with_shape_hash(V.table(spark, d, "documents").select("doc_id", "text"), "text")


@query(f"WITH {SHAPE_SQL} SELECT doc_id, hash FROM documents LEFT JOIN s_doc USING (doc_id)")
def q_simhash(spark, d):
    return _shapes(spark, d)


@query(f"WITH {SHAPE_SQL}, v AS MATERIALIZED (SELECT DISTINCT hash FROM s_doc) SELECT x.hash AS a, y.hash AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance FROM v x JOIN v y ON x.hash < y.hash WHERE bit_count(xor(x.hash, y.hash)) <= 6")
def q_hamming_pairs(spark, d):
    return similarity.hamming_pairs(_shapes(spark, d))


@query(f"""WITH RECURSIVE {SHAPE_SQL}, v AS MATERIALIZED (SELECT hash, min(doc_id) AS id FROM s_doc GROUP BY hash),
  e AS MATERIALIZED (SELECT x.hash AS src, y.hash AS dst FROM v x JOIN v y ON bit_count(xor(x.hash, y.hash)) <= 6),
  r AS (SELECT hash, hash AS at FROM v UNION SELECT r.hash, e.dst FROM r JOIN e ON r.at = e.src),
  c AS MATERIALIZED (SELECT r.hash, min(v.id) AS cluster FROM r JOIN v ON r.at = v.hash GROUP BY r.hash)
  SELECT doc_id, cluster, members FROM (SELECT doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS members FROM s_doc JOIN c USING (hash)) WHERE members > 1""")
def q_duplicate_clusters(spark, d):
    found = similarity.duplicate_clusters(_shapes(spark, d).withColumnRenamed("doc_id", "id"))
    return found.withColumnRenamed("id", "doc_id")


@query("SELECT user_id, last.ts AS ts, last.event_id AS event_id, last.event_type AS event_type, last.value AS value FROM (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id, event_type := event_type, value := value)) AS last FROM events GROUP BY user_id)")
def q_stream_refresh(spark, d):
    where = f"{shared_dir(spark)}/codeloom/refresh-{uuid.uuid4().hex}"
    events = spark.readStream.schema(V.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    snapshots = Snapshots(spark, f"{where}/snapshots", "user_id", ["ts", "event_id"])
    refresh(events.select("user_id", "ts", "event_id", "event_type", "value"), snapshots, f"{where}/checkpoint")
    return snapshots.read()


@query("""WITH e AS MATERIALIZED (SELECT DISTINCT src, dst FROM g_edges), t AS MATERIALIZED (SELECT symbol_id FROM g_symbols JOIN g_files USING (file_id) WHERE role = 'test'),
  d AS (SELECT symbol_id AS test_id, dst AS symbol_id, 1 AS distance FROM t JOIN e ON src = symbol_id),
  a AS (SELECT test_id, symbol_id, min(distance) AS distance FROM (SELECT * FROM d UNION ALL SELECT test_id, dst, 2 FROM d JOIN e ON src = d.symbol_id) WHERE test_id <> symbol_id GROUP BY ALL),
  k AS (SELECT symbol_id, test_id, distance, row_number() OVER (PARTITION BY symbol_id ORDER BY distance, test_id) AS rank FROM a WHERE symbol_id NOT IN (SELECT symbol_id FROM t))
  SELECT symbol_id, test_id, CAST(distance AS INTEGER) AS distance, CASE WHEN distance = 1 THEN 100 ELSE 40 END AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 30""")
def q_test_ranking(spark, d):
    tests = V.symbols(spark, d).join(V.files(spark, d).filter("role = 'test'"), "file_id").select(F.col("symbol_id").alias("test_id"))
    return S.rank_tests(V.edges(spark, d, "src"), tests, tasks=V.tasks(spark, d))

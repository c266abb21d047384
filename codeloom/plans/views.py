"""The star-schema tables seen as a code graph: files, symbols, edges, history, calls and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import target_host, target_path
from ..session import dealt

#: Rows that a task of a join, an aggregate or a window over line items holds.
ROWS_A_TASK = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, d: str, name: str = "lineitem") -> int:
    """In how many tasks to hold rows made of a table's, by its number of rows (told by the files' footers)."""
    return table(spark, d, name).count() // ROWS_A_TASK + 1


def files(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").select(F.col("p_brand").alias("rel_path")).distinct()
    fid = F.regexp_extract("rel_path", "([0-9]+)", 1).cast("long")
    role = F.when(F.col("file_id") % 4 == 0, "test").when(F.col("file_id") % 4 == 1, "vendor").otherwise("project")
    return brands.withColumn("file_id", fid).select("file_id", "rel_path", role.alias("role"), (F.col("file_id") % 4 == 1).alias("is_vendor"), (F.col("file_id") % 7 == 0).alias("is_generated"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("kind"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("file_id"), F.col("p_size").cast("long").alias("loc"),
        (F.col("p_partkey") % 500).alias("line_start"), (F.col("p_partkey") % 500 + F.col("p_size")).alias("line_end"),
    )


def edges(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    """One row a call site: each line item's part calls the part of the order's next line item. Dealt by `by`, if given."""
    n = tasks(spark, d)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), n, "l_orderkey")
    rows = lines.select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.row_number().over(order).alias("k"))
    found = rows.filter("dst IS NOT NULL AND src <> dst").select((F.col("l_orderkey") * 1000 + F.col("k")).alias("edge_id"), "src", "dst")
    return found if by is None else dealt(found, n, by)


def history(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    """Distinct (symbol_id, commit_sha, committed_at, author), dealt by commits, or by `by`. Lines and orders are made distinct
    where they meet, before their join, so that their rows are moved once."""
    n = tasks(spark, d)
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_orderkey").alias("commit_sha"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_sha"), F.col("o_orderdate").alias("committed_at"), F.col("o_custkey").alias("author"))
    found = dealt(lines, n, "commit_sha").distinct().join(dealt(orders, n, "commit_sha").distinct(), "commit_sha").select("symbol_id", "commit_sha", "committed_at", "author")
    return found if by is None else dealt(found, n, by)


def churn_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("commit_sha"), F.col("ts").alias("committed_at"), F.col("event_type").alias("author"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("call_id"), F.when(F.col("url").startswith("https"), "GET").otherwise("POST").alias("method"), target_path(F.col("url")).alias("path"), target_host(F.col("url")).alias("host"))


def routes(spark: SparkSession, d: str) -> DataFrame:
    """A pattern route for each language and each literal path of the pages that ends in .html."""
    literal = calls(spark, d).filter(F.col("path").endswith(".html")).groupBy("path").agg(F.min("call_id").alias("low"))
    literal = literal.select((F.col("low") + 100).alias("route_id"), F.lit("ANY").alias("method"), "path")
    fixed = spark.createDataFrame([(i, m, f"/{lang}/:id") for i, (m, lang) in enumerate([("GET", "en"), ("ANY", "fr"), ("POST", "de"), ("ANY", "es")])], "route_id long, method string, path string")
    return fixed.unionByName(literal)


#: The same views for DuckDB, as common table expressions.
SQL = {
    "g_files": """SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS file_id, p_brand AS rel_path,
        CASE WHEN CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) % 4 = 0 THEN 'test' WHEN CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) % 4 = 1 THEN 'vendor' ELSE 'project' END AS role,
        CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) % 4 = 1 AS is_vendor, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) % 7 = 0 AS is_generated
        FROM (SELECT DISTINCT p_brand FROM part)""",
    "g_symbols": """SELECT p_partkey AS symbol_id, p_name AS name, p_brand || '.' || p_name AS qualified_name, p_type AS kind,
        CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS file_id, CAST(p_size AS BIGINT) AS loc, p_partkey % 500 AS line_start, p_partkey % 500 + p_size AS line_end FROM part""",
    "g_edges": """SELECT l_orderkey * 1000 + k AS edge_id, src, dst FROM (SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER w AS dst, row_number() OVER w AS k
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) WHERE dst IS NOT NULL AND src <> dst""",
    "g_history": """SELECT DISTINCT l_partkey AS symbol_id, l_orderkey AS commit_sha, o_orderdate AS committed_at, o_custkey AS author FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "g_churn": "SELECT user_id AS file_id, event_id AS commit_sha, ts AS committed_at, event_type AS author FROM events",
    "g_calls": r"""SELECT call_id, method, CASE WHEN NOT starts_with(p, '/') THEN NULL WHEN length(p) > 1 AND ends_with(p, '/') THEN substr(p, 1, length(p) - 1) ELSE p END AS path, host FROM (
        SELECT call_id, method, host, CASE WHEN strpos(q, '#') > 0 THEN substr(q, 1, strpos(q, '#') - 1) ELSE q END AS p FROM (
        SELECT call_id, method, host, CASE WHEN strpos(r, '?') > 0 THEN substr(r, 1, strpos(r, '?') - 1) ELSE r END AS q FROM (
        SELECT call_id, method, CASE WHEN web THEN split_part(u, '/', 3) WHEN slash > 1 AND NOT starts_with(u, '/') AND regexp_full_match(substr(u, 1, slash - 1), '[a-zA-Z0-9._-]+') THEN substr(u, 1, slash - 1) END AS host,
          CASE WHEN web THEN CASE WHEN strpos(substr(u, strpos(u, '://') + 3), '/') > 0 THEN substr(substr(u, strpos(u, '://') + 3), strpos(substr(u, strpos(u, '://') + 3), '/')) ELSE '/' END
            WHEN slash > 1 AND NOT starts_with(u, '/') AND regexp_full_match(substr(u, 1, slash - 1), '[a-zA-Z0-9._-]+') THEN substr(u, slash) ELSE u END AS r
        FROM (SELECT page_id AS call_id, trim(url) AS u, strpos(trim(url), '/') AS slash, starts_with(lower(trim(url)), 'http://') OR starts_with(lower(trim(url)), 'https://') AS web,
          CASE WHEN starts_with(url, 'https') THEN 'GET' ELSE 'POST' END AS method FROM pages))))""",
    "g_routes": """SELECT * FROM (VALUES (0, 'GET', '/en/:id'), (1, 'ANY', '/fr/:id'), (2, 'POST', '/de/:id'), (3, 'ANY', '/es/:id')) t(route_id, method, path)
        UNION ALL SELECT min(call_id) + 100, 'ANY', path FROM g_calls WHERE path LIKE '%.html' GROUP BY path""",
}


def with_views(sql: str) -> str:
    """`sql` behind the views that it names, and those that they name."""
    need = [n for n in SQL if n in sql or (n == "g_calls" and "g_routes" in sql)]
    if not need:
        return sql
    head = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"

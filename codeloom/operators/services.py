"""Service links: outbound calls to the routes that answer them, and what can be reached through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_parameter, route_path
from .graph import _checkpoint

#: Confidence by kind of match, the factor of a known host, and of methods.
EXACT, PATTERN, PROCEDURE, PROCEDURE_TAIL, DOCUMENT, REMOTE, MESSAGE = 0.95, 0.85, 0.95, 0.70, 0.9, 0.95, 0.9
KNOWN_HOST, ANY_METHOD, OTHER_METHOD = 1.05, 0.9, 0.85
TOPICS, QUEUES = ("kafka", "sns", "nats", "redis_pubsub"), ("sqs", "rabbitmq")
CALL_COLUMNS = "protocol method path host env_key framework operation topic queue".split()


def method_score(call: Column, route: Column) -> Column:
    """1 if the methods are equal, 0.9 if either is ANY, else 0."""
    return F.when(call == route, 1.0).when((call == "ANY") | (route == "ANY"), ANY_METHOD).otherwise(0.0)


def _filled(rows: DataFrame, names: list[str]) -> DataFrame:
    out = rows
    for n in names:
        if n not in out.columns:
            out = out.withColumn(n, F.lit("http" if n == "protocol" else None).cast("string"))
    return out


def candidates(calls: DataFrame, routes: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """(call_id, route_id, match_kind, confidence, reason): every route that may answer each call.

    calls: call_id, and of protocol, method, path, host, env_key, framework, operation, topic, queue what there is;
    routes: route_id, method, path, and of protocol, operation, topic, queue. hosts: (host) that the tree declares.
    Each protocol joins by equality: HTTP by path, and calls without an exact hit by route patterns, on their number of
    segments and first segment; procedures, documents and remote methods by operation; messages by topic or queue.
    """
    c = _filled(calls, CALL_COLUMNS).select("call_id", *CALL_COLUMNS)
    r = _filled(routes, ["protocol", "operation", "topic", "queue"]).select("route_id", F.col("method").alias("r_method"), route_path(F.col("path")).alias("r_path"), F.coalesce("protocol", F.lit("http")).alias("r_protocol"), F.col("operation").alias("r_operation"), F.col("topic").alias("r_topic"), F.col("queue").alias("r_queue"))
    score = method_score(F.coalesce("method", F.lit("ANY")), F.coalesce("r_method", F.lit("ANY")))
    loose = F.when(score == 0, OTHER_METHOD).otherwise(score)

    def found(rows: DataFrame, kind: Column | str, confidence: Column, reason: Column | str) -> DataFrame:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        return rows.select("call_id", "route_id", as_column(kind).alias("match_kind"), F.least(F.lit(1.0), confidence).alias("raw"), as_column(reason).alias("reason"))

    http = c.filter("protocol = 'http' AND path IS NOT NULL")
    if hosts is None:
        http = http.withColumn("known", F.lit(False))
    else:
        declared = hosts.select(F.lower("host").alias("declared")).distinct()
        http = http.join(declared, F.lower("host") == F.col("declared"), "left").withColumn("known", F.col("declared").isNotNull()).drop("declared")
    boost = F.when(F.col("known"), KNOWN_HOST).otherwise(1.0)
    web = r.filter("r_protocol = 'http'")
    exact = http.join(web, F.col("path") == F.col("r_path")).filter(score > 0)
    kind = F.when(F.col("known") & F.col("env_key").isNull(), "service_host").when(F.col("env_key").isNotNull(), "env_base").otherwise("literal_path")
    named = F.when(F.col("known"), "literal_path+service_host").otherwise("literal_path")
    exact = found(exact, kind, EXACT * score * boost, named)

    left = http.join(exact.select("call_id").distinct(), "call_id", "left_anti").withColumn("s", F.split("path", "/")).withColumn("n", F.size("s"))
    shaped = web.withColumn("p", F.split("r_path", "/")).withColumn("n", F.size("p")).filter(F.exists("p", is_parameter))
    first = F.get("p", F.lit(1))
    keyed = shaped.withColumn("key", F.when(is_parameter(first), F.lit("*")).otherwise(F.concat(F.lit("="), first)))
    literal = F.concat(F.lit("="), F.get("s", F.lit(1)))
    wanted = left.withColumn("key", F.explode(F.array_distinct(F.array(literal, F.lit("*"))))).filter("key IS NOT NULL")
    hit = wanted.join(keyed, ["n", "key"]).filter(F.forall(F.zip_with("s", "p", lambda a, b: (a == b) | is_parameter(b)), lambda x: x) & (score > 0))
    by_host = F.when(F.col("known") & F.col("env_key").isNull(), "service_host").otherwise("route_pattern")
    pattern = found(hit, by_host, PATTERN * score * boost, F.when(F.col("known"), "route_pattern+service_host").otherwise("route_pattern"))

    rpc = c.filter("protocol = 'trpc' AND operation IS NOT NULL")
    procedures = r.filter("r_protocol = 'trpc'")
    full = found(rpc.join(procedures, F.col("operation") == F.col("r_operation")), "trpc_procedure", PROCEDURE * loose, "exact_operation")
    short = rpc.join(full.select("call_id").distinct(), "call_id", "left_anti").withColumn("tail", F.substring_index("operation", ".", -1))
    short = found(short.join(procedures, F.col("tail") == F.col("r_operation")), "trpc_procedure", PROCEDURE_TAIL * loose, "last_segment_operation")

    asked = c.filter("protocol = 'graphql' AND operation IS NOT NULL AND coalesce(framework, '') <> 'gql-doc'")
    if "raw_target" in calls.columns:
        docs = calls.filter("framework = 'gql-doc'").groupBy(F.col("raw_target").alias("doc")).agg(F.min("operation").alias("field"))
        asked = asked.join(docs, F.col("operation") == F.col("doc"), "left")
    else:
        asked = asked.withColumn("doc", F.lit(None).cast("string")).withColumn("field", F.lit(None).cast("string"))
    asked = asked.withColumn("asked", F.coalesce("field", "operation")).withColumn("by_doc", F.col("doc").isNotNull())
    answers = asked.join(r.filter("r_protocol = 'graphql'"), F.col("asked") == F.col("r_operation"))
    answers = found(answers, "graphql_operation", DOCUMENT * loose, F.when(F.col("by_doc"), "gql_doc_field").otherwise("exact_operation"))

    remote = c.filter("protocol = 'grpc'").join(r.filter("r_protocol = 'grpc'"), F.col("operation") == F.col("r_operation"))
    remote = found(remote, "grpc_method", F.lit(REMOTE), "exact_grpc_method")
    topics = c.filter(F.col("protocol").isin(*TOPICS)).join(r, (F.col("topic") == F.col("r_topic")) & (F.col("protocol") == F.col("r_protocol")))
    queues = c.filter(F.col("protocol").isin(*QUEUES)).join(r, (F.col("queue") == F.col("r_queue")) & (F.col("protocol") == F.col("r_protocol")))
    every = exact
    for more in (pattern, full, short, answers, remote, found(topics, "topic_match", F.lit(MESSAGE), "topic_match"), found(queues, "queue_match", F.lit(MESSAGE), "queue_match")):
        every = every.unionByName(more)
    return every.select("call_id", "route_id", "match_kind", (F.floor(F.col("raw") * 1000 + 0.5) / 1000).alias("confidence"), "reason")


def resolve_links(calls: DataFrame, routes: DataFrame, hosts: DataFrame | None = None, per_call: int = 25, evidence: int = 5) -> DataFrame:
    """(call_id, route_id, match_kind, confidence, reason, candidates, truncated, others): the best route of each call.

    candidates: how many routes there were; truncated: whether more than `per_call`; others: the next `evidence` routes as
    structs (route_id, match_kind, confidence). Of equal confidence the smallest route id wins, then the kind.
    """
    every = candidates(calls, routes, hosts)
    window = Window.partitionBy("call_id")
    order = window.orderBy(F.desc("confidence"), "route_id", "match_kind")
    ranked = every.withColumn("rank", F.row_number().over(order)).withColumn("candidates", F.count(F.lit(1)).over(window)).filter(F.col("rank") <= 1 + evidence)
    rest = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "route_id", "match_kind", "confidence"))))
    best = ranked.groupBy("call_id").agg(F.min(F.when(F.col("rank") == 1, F.struct("route_id", "match_kind", "confidence", "reason"))).alias("top"), F.max("candidates").alias("candidates"), rest.alias("rest"))
    return best.select("call_id", "top.*", "candidates", (F.col("candidates") > per_call).alias("truncated"), F.transform("rest", lambda x: F.struct(x["route_id"].alias("route_id"), x["match_kind"].alias("match_kind"), x["confidence"].alias("confidence"))).alias("others"))


def link_calls(calls: DataFrame, routes: DataFrame, hosts: list[str] = ()) -> DataFrame:
    """(call_id, route_id, match_kind, confidence, candidates): the best route of each call; see `resolve_links`."""
    known = calls.sparkSession.createDataFrame([(h,) for h in hosts], "host string") if hosts else None
    return resolve_links(calls, routes, known).select("call_id", "route_id", "match_kind", "confidence", "candidates")


def link_table(links: DataFrame, calls: DataFrame, routes: DataFrame) -> DataFrame:
    """`links` with link_id, protocol, caller_id and handler_id of their ends."""
    ends = links.join(calls.select("call_id", "protocol", F.col("symbol_id").alias("caller_id")), "call_id").join(routes.select("route_id", "handler_id"), "route_id")
    return ends.withColumn("link_id", F.col("call_id"))


def service_reach(links: DataFrame, start: int, max_depth: int = 4, max_nodes: int = 200, max_fanout: int = 20) -> tuple[DataFrame, str | None]:
    """(symbol_id, depth, protocols, match_kinds, hops) of the handlers that a symbol reaches through links (caller_id,
    handler_id, protocol, match_kind, confidence), and which limit cut it off: maxFanout, maxNodes, maxDepth or None.

    A level is one join; of each node the best `max_fanout` links are followed.
    """
    spark = links.sparkSession
    usable = links.filter("caller_id IS NOT NULL AND handler_id IS NOT NULL").select("caller_id", "handler_id", "protocol", "match_kind", "confidence")
    order = Window.partitionBy("caller_id").orderBy(F.desc("confidence"), "handler_id", "protocol", "match_kind")
    ranked = usable.withColumn("k", F.row_number().over(order))
    seen = spark.createDataFrame([(start, 0, [start])], "symbol_id long, depth int, hops array<long>")
    met, frontier, cutoff, count = None, seen, None, 1
    for depth in range(1, max_depth + 1):
        step = frontier.join(ranked.filter(F.col("k") <= max_fanout + 1), F.col("symbol_id") == F.col("caller_id"))
        if not step.filter(F.col("k") > max_fanout).isEmpty():
            cutoff = "maxFanout"
        step = step.filter(F.col("k") <= max_fanout)
        here = step.select(F.col("handler_id").alias("m_id"), "protocol", "match_kind")
        met = here if met is None else met.unionByName(here)
        new = step.groupBy("handler_id").agg(F.min("hops").alias("hops")).join(seen.select(F.col("symbol_id").alias("handler_id")), "handler_id", "left_anti")
        frontier = _checkpoint(new.select(F.col("handler_id").alias("symbol_id"), F.lit(depth).alias("depth"), F.concat("hops", F.array("handler_id")).alias("hops")).orderBy("hops", "symbol_id").limit(max(0, max_nodes + 1 - count)))
        n = frontier.count()
        if n == 0:
            break
        count += n
        seen = seen.unionByName(frontier)
        if count > max_nodes:
            cutoff = "maxNodes"
            break
    else:
        more = frontier.join(usable, F.col("symbol_id") == F.col("caller_id")).join(seen.select(F.col("symbol_id").alias("s")), F.col("handler_id") == F.col("s"), "left_anti")
        cutoff = cutoff or (None if more.isEmpty() else "maxDepth")
    kinds = met.groupBy("m_id").agg(F.sort_array(F.collect_set("protocol")).alias("protocols"), F.sort_array(F.collect_set("match_kind")).alias("match_kinds"))
    out = seen.filter("depth > 0").join(kinds, F.col("symbol_id") == F.col("m_id")).select("symbol_id", "depth", "protocols", "match_kinds", "hops")
    return out, cutoff


def service_path(links: DataFrame, source: int, target: int, max_depth: int = 6) -> list[int]:
    """Symbols of a shortest path through links, empty without one."""
    from .graph import shortest_path

    edges = links.filter("caller_id IS NOT NULL AND handler_id IS NOT NULL").select(F.col("caller_id").alias("src"), F.col("handler_id").alias("dst"))
    return shortest_path(edges, source, target, max_depth) or []


def module_links(links: DataFrame, symbols: DataFrame, members: DataFrame) -> DataFrame:
    """(from_id, to_id, protocol, links): links between modules, counted. members: (file_id, module_id)."""
    of = symbols.select("symbol_id", "file_id").join(members.select("file_id", "module_id"), "file_id").select("symbol_id", "module_id")
    a, b = of.select(F.col("symbol_id").alias("caller_id"), F.col("module_id").alias("from_id")), of.select(F.col("symbol_id").alias("handler_id"), F.col("module_id").alias("to_id"))
    return links.join(a, "caller_id").join(b, "handler_id").filter("from_id <> to_id").groupBy("from_id", "to_id", "protocol").agg(F.count(F.lit(1)).alias("links"))


def module_reach(rollup: DataFrame, start: int, max_depth: int = 4) -> DataFrame:
    """(module_id, depth, links): modules that one reaches through `module_links`, with the links that lead into each from
    the level before."""
    from .graph import reach

    spark = rollup.sparkSession
    edges = rollup.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    found = reach(edges, spark.createDataFrame([(start,)], "start long"), max_depth)
    levels = found.select("id", "depth").unionByName(spark.createDataFrame([(start, 0)], "id long, depth int"))
    into = rollup.join(levels.select(F.col("id").alias("from_id"), F.col("depth").alias("d0")), "from_id").join(levels.select(F.col("id").alias("to_id"), F.col("depth").alias("d1")), "to_id")
    return into.filter("d1 = d0 + 1").groupBy(F.col("to_id").alias("module_id"), F.col("d1").alias("depth")).agg(F.sum("links").alias("links"))

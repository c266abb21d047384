"""Golden facts on small frames."""

import random

from pyspark.sql import functions as F

from codeloom.operators import graph, history, services, similarity, symbols
from codeloom.streaming.refresh import Snapshots, refresh


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_imported_name_beats_the_same_name_elsewhere(spark):
    s = spark.createDataFrame([(1, 10, "check"), (2, 20, "check"), (3, 30, "other")], "symbol_id long, file_id long, name string")
    refs = spark.createDataFrame([(1, 30, "check"), (2, 30, "other"), (3, 30, "missing"), (4, 40, "check")], "ref_id long, file_id long, to_name string")
    imports = spark.createDataFrame([(30, 20)], "from_file long, to_file long")
    got = {r.ref_id: (r.to_id, r.tier) for r in symbols.resolve(refs, s, imports).collect()}
    assert got == {1: (2, "imported"), 2: (3, "same_file"), 3: (None, "none"), 4: (1, "global")}


def test_pagerank_loses_the_mass_of_sinks(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    ranks = {r.id: r.rank for r in graph.pagerank(nodes, edges(spark, [(1, 2), (1, 2), (2, 3)])).collect()}
    assert abs(ranks[1] - 0.05) < 1e-12 and abs(ranks[2] - (0.05 + 0.85 * 0.05)) < 1e-12
    assert sum(ranks.values()) < 1


def test_reach_path_and_components(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)])
    start = spark.createDataFrame([(1,)], "start long")
    assert {(r.id, r.depth) for r in graph.reach(e, start, 4).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert graph.shortest_path(e, 1, 4) == [1, 2, 3, 4] and graph.shortest_path(e, 4, 1) is None
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 8, 9)], "id long")
    assert {r.id: r.component for r in graph.components(nodes, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 8: 8, 9: 8}


def test_coupling_golden_fact(spark):
    rows = [(s, f"c{c}") for c in range(1, 4) for s in (1, 3)] + [(s, f"n{c}") for c in (1, 2) for s in (1, 2, 3, 4, 5, 6, 7, 8)] + [(2, "c1"), (2, "c2")]
    h = spark.createDataFrame([(s, c, 0) for s, c in rows], "symbol_id long, commit_sha string, committed_at int")
    got = {r.partner: (r.support, r.confidence) for r in history.coupling(h, 2, 6).filter("target = 1").collect()}
    assert got == {3: (3, 1.0), 2: (2, 0.67)}
    assert history.coupling(h, 4, 6).filter("target = 1").isEmpty()


def test_a_hundred_equal_routes_give_the_lowest_id(spark):
    calls = spark.createDataFrame([(1, "GET", "/a/7", "x"), (2, "GET", "/b", "pay")], "call_id long, method string, path string, host string")
    routes = spark.createDataFrame([(i, "GET", "/b") for i in range(5, 105)] + [(1, "ANY", "/a/:id"), (2, "GET", "/:p/:q")], "route_id long, method string, path string")
    got = {r.call_id: r for r in services.link_calls(calls, routes, ["pay"]).collect()}
    assert (got[2].route_id, got[2].candidates, got[2].match_kind) == (5, 100, "service_host")
    assert (got[1].route_id, got[1].confidence, got[1].candidates) == (2, 0.85, 2)


def test_smallest_enclosing_span(spark):
    spans = spark.createDataFrame([(1, 1, 0, 500), (2, 1, 100, 200), (3, 2, 0, 9)], "span_id long, file_id long, line_start long, line_end long")
    points = spark.createDataFrame([(1, 1, 150), (2, 1, 300), (3, 2, 50)], "point_id long, file_id long, line long")
    assert {r.point_id: r.span_id for r in symbols.enclosing(points, spans).collect()} == {1: 2, 2: 1, 3: None}


def test_renamed_twins_share_a_shape(spark):
    a = "def charge(user, sum):\n    # takes money\n    if sum > 10: return 'no'\n    return pay(user, sum)"
    b = a.replace("charge", "bill").replace("user", "client").replace("'no'", '"never; ever"').replace("takes money", "other words ( {")
    rows = [(1, a), (2, b), (3, "a = [1, 2, 3]; b = {x: y}; c = a[0] + b[x] * 2 - 7"), (4, "too few"), (5, None), (6, ""), (7, "'" + "x\\'" * 200_000)]
    hashed = similarity.with_shape_hash(spark.createDataFrame(rows, "id long, body string"), "body").cache()
    got = {r.id: r.hash for r in hashed.collect()}
    assert got[1] == got[2] is not None and got[3] not in (None, got[1])
    assert got[4] is got[5] is got[6] is got[7] is None
    assert similarity.fnv64("abc") == 0xE71FA2190541574B
    assert {(r.id, r.cluster, r.members) for r in similarity.duplicate_clusters(hashed).collect()} == {(1, 1, 2), (2, 1, 2)}


def test_hamming_pairs_lose_none(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [v ^ sum(1 << b for b in rng.sample(range(64), k)) for v in base for k in (0, 1, 3, 4, 6, 7)]
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in [*values, *values, None]], "hash long")
    got = {(r.a, r.b): r.distance for r in similarity.hamming_pairs(frame).collect()}
    far = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert got == {(x, y): far(x, y) for x in set(values) for y in set(values) if x < y and far(x, y) <= 6}


def test_refresh_goes_on_with_what_is_new(spark, tmp_path):
    schema = "path string, at long, body string"
    snapshots = Snapshots(spark, str(tmp_path / "snapshots"), "path", ["at"])
    for rows in ([("a", 1, "x"), ("b", 1, "y"), ("a", 3, "z")], [("a", 2, "late"), ("c", 4, None), ("b", 5, "w")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        refresh(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), snapshots, str(tmp_path / "checkpoint"))
    assert {tuple(r) for r in snapshots.read().collect()} == {("a", 3, "z"), ("b", 5, "w"), ("c", 4, None)}
    assert {tuple(r) for r in snapshots.read(0).collect()} == {("a", 3, "z"), ("b", 1, "y")}


def test_direct_tests_come_first(spark):
    tests = spark.createDataFrame([(1,), (2,)], "test_id long")
    got = [(r.symbol_id, r.test_id, r.score, r["rank"]) for r in symbols.rank_tests(edges(spark, [(1, 5), (1, 5), (2, 6), (6, 5), (2, 1)]), tests).collect()]
    assert sorted(got) == [(5, 1, 100, 1), (5, 2, 40, 2), (6, 2, 100, 1)]

"""Results of operators on inputs whose pairs are many more than their rows."""

import random
import re
import time

from pyspark.sql import functions as F

from codeloom.extract import files
from codeloom.operators import derive, evidence, graph, history, similarity, symbols
from codeloom.plans import catalogue, views
from codeloom.plans import indexing  # noqa: F401 - registers its queries
from codeloom.sources import tree


def test_smallest_spans_are_found_without_pairs(spark):
    n = 100_000
    spans = spark.range(1, n + 1).select(F.col("id").alias("span_id"), F.lit(1).alias("file_id"), (F.col("id") % 200).alias("line_start"), (1000 + F.col("id") % 300).alias("line_end"))
    points = spark.range(n).select(F.col("id").alias("point_id"), F.lit(1).alias("file_id"), (F.col("id") % 1400).alias("line"))
    began = time.time()
    got = symbols.enclosing(points, spans).groupBy("span_id").count().collect()
    assert time.time() - began < 60  # 10^10 pairs were made before
    assert sum(r["count"] for r in got) == n and None in {r.span_id for r in got}


def test_smallest_spans_equal_those_of_all_pairs(spark):
    rng = random.Random(3)
    spans = [(i, rng.randrange(2), a, a + rng.choice((-1, 0, 1, 7, 8, 40, 300))) for i in range(300) for a in [rng.randrange(-20, 400)]] + [(900, 1, None, 5), (901, None, 1, 5)]
    points = [(i, rng.randrange(3), rng.randrange(-40, 800)) for i in range(400)] + [(400, 1, None), (401, None, 3), (1, 0, 8)]
    got = symbols.enclosing(spark.createDataFrame(points, "point_id long, file_id long, line long"), spark.createDataFrame(spans, "span_id long, file_id long, line_start int, line_end int")).collect()
    fits = lambda p, f, x: [(b - a, s) for s, g, a, b in spans if None not in (f, x, g, a, b) and f == g and a <= x <= b]
    want: dict = {}
    for p, f, x in points:
        want.setdefault(p, []).extend(fits(p, f, x))
    assert len(got) == len(want) and {r.point_id: r.span_id for r in got} == {p: min(found)[1] if found else None for p, found in want.items()}


def test_skeleton_rows_equal_those_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), a, a + rng.choice((0, 1, 3, 8, 40, 150))) for i in range(400) for a in [rng.randrange(-10, 150)]] + [(900, None, 1, 2), (901, 1, None, 2), (902, 1, 3, None)]
    got = derive.skeleton_rows(spark.createDataFrame([(*r, "x") for r in rows], "symbol_id long, file_id long, line_start long, line_end int, name string")).collect()
    full = [r for r in rows if None not in r]
    for r in got:
        i, f, a, b = r.symbol_id, r.file_id, r.line_start, r.line_end
        around = [(p, -q, s) for s, g, p, q in full if None not in (f, a, b) and g == f and p <= a and b <= q and (p < a or q > b or s < i)]
        assert (r.depth, r.parent_id, r.name) == (len(around), max(around)[2] if around else None, "x")
    assert len(got) == len(rows)


def test_skeleton_rows_make_no_pairs(spark):
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("symbol_id"), F.lit(1).alias("file_id"), (F.col("id") % 5000).alias("line_start"), (20_000 - F.col("id") % 7000).alias("line_end"))
    began = time.time()
    got = derive.skeleton_rows(rows).agg(F.sum(F.col("depth").cast("long")).alias("depth"), F.count("parent_id").alias("n")).first()
    assert time.time() - began < 60  # about 10^9 pairs were made before
    assert got.n == n - 1 and got.depth > 10**9


def test_numbers_of_many_ranges_have_no_gaps(spark):
    n, ranges = 300_000, {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in ranges}
    for k, v in ranges.items():
        spark.conf.set(k, v)
    try:
        keys = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
        got = tree.numbered(keys, "key", "n").toPandas().sort_values("key")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert list(got["key"]) == sorted(f"k{i}" for i in range(n)) and list(got["n"]) == list(range(1, n + 1))


def test_overlaps_equal_those_of_all_pairs(spark):
    rng = random.Random(9)
    wide = lambda: rng.choice((-2, 0, 1, 5, 30, 200))
    spans = [(i % 230, i % 3, a, a + wide()) for i in range(300) for a in [rng.randrange(-20, 300)]] + [(500, 1, None, 4), (501, None, 1, 4)]
    hunks = [(i % 150, i % 4, a, a + wide()) for i in range(400) for a in [rng.randrange(-20, 300)]] + [(600, 1, 3, None), (601, None, 1, 4)]
    made = symbols.overlapping(spark.createDataFrame([(*h[:2], h[2], h[3]) for h in hunks], "hunk_id long, file_id long, start long, end int"), spark.createDataFrame(spans, "span_id long, file_id long, line_start int, line_end long")).collect()
    want = {(h, s) for h, f, a, b in hunks for s, g, p, q in spans if None not in (f, a, b, g, p, q) and f == g and a <= q and b >= p}
    assert len(made) == len(want) and {tuple(r) for r in made} == want


def shuffled_rows(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    jvm, sc = spark._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_overlaps_are_not_moved(spark):
    n = 6000
    spans = spark.range(n).select(F.col("id").alias("span_id"), F.lit(1).alias("file_id"), (F.col("id") % 7).alias("line_start"), (F.col("id") % 7 + 20).alias("line_end"))
    hunks = spark.range(n).repartition(4).select(F.col("id").alias("hunk_id"), F.lit(1).alias("file_id"), (F.col("id") % 20).alias("start"), (F.col("id") % 20 + 2).alias("end"))
    began = shuffled_rows(spark)
    pairs = symbols.overlapping(hunks, spans).agg(F.count("hunk_id"), F.sum("span_id")).first()
    assert pairs[0] > 30_000_000 and shuffled_rows(spark) - began < 3_000_000


def test_history_rows_are_not_moved(spark):
    n = 4000
    spans = spark.range(n).select(F.col("id").alias("symbol_id"), F.lit(1).alias("file_id"), (F.col("id") % 7).alias("line_start"), (F.col("id") % 7 + 20).alias("line_end"))
    hunks = spark.range(n).repartition(4).select(F.col("id").alias("commit_sha"), F.lit(1).alias("file_id"), (F.col("id") % 20 + 1).alias("new_start"), F.lit(3).alias("new_lines"), (F.col("id") % 2 == 0).alias("is_file_addition"), F.lit(1).alias("lines_added"), F.lit(0).alias("lines_removed"), F.to_timestamp(F.lit("2025-01-01")).alias("committed_at"))
    began = shuffled_rows(spark)
    rows = derive.history_rows(hunks, spans, F.lit("2026-01-01").cast("date")).groupBy("match_strategy").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("symbol_id") + F.col("commit_sha") + F.col("confidence")).alias("x")).collect()
    found = {r.match_strategy: r.n for r in rows}
    assert found["file-addition"] == n * n // 2 and found["overlap"] > 5_000_000 and shuffled_rows(spark) - began < 3_000_000


def test_short_files_of_one_partition_are_dealt_to_all_cores(spark):
    n = 700
    rows = spark.range(n).coalesce(1).select(F.col("id").alias("file_id"), F.concat(F.lit("f"), "id").alias("rel_path"), F.lit("go").alias("language"), F.concat(F.lit("func f"), "id", F.lit("(x int) {\n"), F.repeat(F.lit("// long\n"), F.when(F.col("id") == 5, 200_000).otherwise(1)), F.lit("g(x)\n}\n")).alias("content"))
    records = files.extracted(rows)
    assert records.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert {(r.file_id, r.name, r.caller) for r in files.flat(records, "calls").collect()} == {(i, "g", f"f{i}") for i in range(n)}
    assert records.count() == n


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contributions_are_ranked_within_their_row(spark):
    rows = spark.createDataFrame([(1, *range(len(evidence.SIGNALS))), (2, *[0] * len(evidence.SIGNALS))], "symbol_id long, " + ", ".join(f"{s} long" for s in evidence.SIGNALS))
    made = evidence.contributions(rows, 3)
    assert "Exchange" not in plan_of(made) and "Sort" not in plan_of(made)
    got = sorted((r.symbol_id, r.place, r.signal, r.value, r.contribution) for r in made.collect())
    assert [x[:3] for x in got if x[0] == 2] == [(2, k + 1, evidence.SIGNALS[k]) for k in range(3)]
    sizes = [abs(r.contribution) for r in evidence.contributions(rows).filter("symbol_id = 1").orderBy("place").collect()]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == len(evidence.SIGNALS) and [abs(x[4]) for x in got[:3]] == sizes[:3]


def test_history_and_edges_are_held_by_number_of_rows(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(views, "ROWS_A_TASK", 500)
    n = views.table(spark, data, "lineitem").count() // 500 + 1
    assert n > 10
    for made in (views.history(spark, data), views.history(spark, data, "symbol_id"), views.edges(spark, data, "dst")):
        assert made.rdd.getNumPartitions() == n
    many = re.compile(rf"hashpartitioning\([^()]*, (?:{n}|{n * symbols.FURTHER}|{n * history.PAIRS})\), REPARTITION_BY_NUM")
    for name in ("q_test_ranking", "q_history", "q_test_edge_synthesis", "q_noise_commits", "q_risk", "q_coupling", "q_coupling_since", "q_call_counts", "q_first_rows_with_totals"):
        small = catalogue.QUERIES[name](spark, data)
        assert many.search(plan_of(small)), name


def test_dealt_rows_give_the_same_results(spark):
    rng = random.Random(11)
    e = spark.createDataFrame([(i, rng.randrange(40), rng.randrange(40)) for i in range(400)], "edge_id long, src long, dst long")
    s = spark.createDataFrame([(i, i % 7) for i in range(40)], "symbol_id long, file_id long")
    f = spark.createDataFrame([(i, "test" if i % 3 == 0 else "project") for i in range(7)], "file_id long, role string")
    h = spark.createDataFrame([(rng.randrange(20), rng.randrange(60), 0) for i in range(300)], "symbol_id long, commit_sha long, committed_at int")
    named = e.select("edge_id", F.col("src").alias("from_id"), F.when(F.col("dst") % 5 > 0, F.col("dst")).alias("to_id"), F.lit("call").alias("kind"))
    tests = s.join(f.filter("role = 'test'"), "file_id").select(F.col("symbol_id").alias("test_id"))
    for run in (lambda n: symbols.rank_tests(e, tests, 3, n), lambda n: symbols.count_calls(e, s, f, n), lambda n: derive.test_edges(derive.test_edges(named, s, f, n), s, f, n), lambda n: history.coupling(h, tasks=n)):
        plain, dealt = (sorted(map(str, run(n).collect())) for n in (None, 3))
        assert plain == dealt and plain


def test_clusters_of_blocks_equal_those_of_all_pairs(spark):
    rng = random.Random(13)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({v ^ sum(1 << b for b in rng.sample(range(64), k)) for v in base for k in (0, 2, 4, 6, 7, 9) for _ in range(4)})
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 6
    label = {v: i for i, v in enumerate(values)}
    for _ in values:
        label = {v: min(label[w] for w in values if near(v, w)) for v in values}
    frame = spark.createDataFrame([(v,) for v in values], "id long")
    for size in (10_000, 50):
        links = similarity.value_links(frame, 6, size)
        assert all(near(r.src, r.dst) for r in links.collect())
        got = {r.id: r.component for r in graph.components(frame, links).collect()}
        groups = lambda of: {frozenset(v for v in values if of[v] == x) for x in of.values()}
        assert groups(got) == groups(label)


def test_links_of_alike_values_are_fewer_than_their_pairs(spark):
    n = 4000  # all within twelve bits: about 5 * 10^6 pairs of at most six
    frame = spark.range(n).select(F.col("id"), F.col("id").alias("hash"))
    began = shuffled_rows(spark)
    got = similarity.duplicate_clusters(frame).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("members").alias("m")).collect()
    assert [tuple(r) for r in got] == [(0, n, n)] and shuffled_rows(spark) - began < 200_000

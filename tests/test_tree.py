"""A small source tree from files to risk: scanning, extraction, resolution, links, evidence, modules, boundaries, bundles."""

import json
import subprocess
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from codeloom.api import Index
from codeloom.build import build, export
from codeloom.extract import files as X
from codeloom.functions import text as T
from codeloom.operators import continuity, derive, evidence, graph, lookups, modules, reports, search, services
from codeloom.operators import symbols as S
from codeloom.sources import git, manifests, scip, store, tree
from codeloom.streaming.refresh import Snapshots, freshness

from . import samples

TREE = {
    "package.json": json.dumps({"name": "@corp/root", "workspaces": ["packages/*", "!packages/old"], "dependencies": {"left": "^1.0"}, "devDependencies": {"right": "2"}}),
    "packages/web/package.json": json.dumps({"name": "@corp/web"}),
    "packages/web/src/app.ts": "import { charge } from './pay';\nexport function start() {\n  if (ready) { charge(1); }\n  return fetch('/api/charge/7', { method: 'POST' });\n}\n",
    "packages/web/src/pay.ts": "export function charge(n: number) {\n  return helper(n);\n}\nfunction helper(n) { return n + process.env.RATE; }\n",
    "packages/web/src/app.test.ts": "import { start } from './app';\nfunction test_start() {\n  expect(start()).toBe(1);\n  expect(2).toBe(2);\n}\n",
    "services/billing/main.py": "from .store import save\nimport os\n\n@app.post('/api/charge/{id}')\ndef charge(id):\n    return save(id)\n\ndef helper(n):\n    return os.getenv('RATE')\n",
    "services/billing/__init__.py": "",
    "services/billing/store.py": "def save(id):\n    for x in id:\n        if x:\n            return x\n    return None\n",
    "services/billing/requirements.txt": "flask==2.0  # web\n-e .\nnumpy\n",
    "vendor/lib/a.js": "function vendored() {}\n",
    "docs/notes.py": "def note(): pass\n",
    "src/skip.me/b.py": "def b(): pass\n",
    ".gitignore": "*.me/\n",
    "go.mod": "module example.com/corp/tool\nrequire (\n  github.com/x/y v1.2.3 // indirect\n)\nrequire github.com/z/w v0.1.0\n",
    "api/user.proto": 'service Users { // rpc Old(A) returns (B)\n  rpc Get (GetRequest) returns (stream User);\n}\n',
    "deploy/svc.yaml": "apiVersion: v1\nkind: Service\nmetadata:\n  name: Billing\n---\nkind: Deployment\nmetadata:\n  name: other\n",
    "docker-compose.yml": "version: '3'\nservices:\n  cache:\n    image: redis\n  queue:\n    image: mq\nvolumes:\n  data:\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    where = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (where / path).parent.mkdir(parents=True, exist_ok=True)
        (where / path).write_text(text)
    return str(where)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TREE.items()), "rel_path string, content string").cache()


@pytest.fixture(scope="module")
def tables(spark, root, tmp_path_factory):
    """All tables, each written, as an index build does: what is read later does not carry its making along."""
    where = tmp_path_factory.mktemp("tables")

    def kept(df, name):
        df.coalesce(1).write.parquet(f"{where}/{name}")
        return spark.read.parquet(f"{where}/{name}")

    files = kept(tree.scan(spark, root), "files")
    records = kept(X.extracted(files), "records")
    syms = X.symbols(records).withColumn("shape_hash", F.lit(None).cast("long"))
    imports = kept(derive.resolve_imports(X.flat(records, "imports"), files), "imports")
    refs = X.edges(records, syms)
    resolved = S.resolve(refs.select(F.col("edge_id").alias("ref_id"), "file_id", "to_name"), syms, imports.filter("resolved_file_id IS NOT NULL").select(F.col("file_id").alias("from_file"), F.col("resolved_file_id").alias("to_file")).distinct())
    edges = refs.join(resolved.select(F.col("ref_id").alias("edge_id"), "to_id"), "edge_id").select("edge_id", "from_id", "to_id", "to_name", "kind", "line", "file_id")
    edges = kept(derive.test_edges(edges, syms, files), "edges")
    ranks = graph.pagerank(lookups.rankable_ids(syms).withColumnRenamed("symbol_id", "id"), lookups.rankable_edges(edges, syms))
    syms = kept(store.with_ranks(syms, ranks), "symbols")
    routes = derive.resolve_handlers(X.flat(records, "routes").withColumn("route_id", F.monotonically_increasing_id()), syms)
    routes = kept(routes, "routes")
    calls = X.flat(records, "service_calls").withColumn("call_id", F.monotonically_increasing_id())
    first = syms.groupBy("file_id", F.col("qualified_name").alias("caller")).agg(F.min("symbol_id").alias("symbol_id"))
    calls = calls.join(first, ["file_id", "caller"], "left").withColumn("path", T.target_path(F.col("raw_target"))).withColumn("host", T.target_host(F.col("raw_target"))).withColumn("normalized_path", F.col("path"))
    calls = kept(calls, "calls")
    links = kept(services.link_table(services.resolve_links(calls, routes), calls, routes), "links")
    keys = X.flat(records, "config_keys")
    spans = syms.filter("kind = 'function'").select(F.col("symbol_id").alias("span_id"), "file_id", "line_start", "line_end")
    keys = keys.withColumn("point_id", F.monotonically_increasing_id())
    keys = keys.join(S.enclosing(keys.select("point_id", "file_id", "line"), spans), "point_id").withColumnRenamed("span_id", "symbol_id")
    keys = kept(keys, "keys")
    lines = files.select("file_id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return {"files": files, "symbols": syms, "edges": edges, "imports": imports, "routes": routes, "service_calls": calls, "links": links, "config_keys": keys, "lines": lines}


def column(df, name):
    return sorted(r[name] for r in df.select(name).collect())


def ids(tables):
    return {(r.rel_path, r.qualified_name): r.symbol_id for r in tables["symbols"].join(tables["files"], "file_id").collect()}


def test_scan(spark, root, tables):
    files = {r.rel_path: r for r in tables["files"].collect()}
    assert sorted(files) == ["docs/notes.py", "packages/web/src/app.test.ts", "packages/web/src/app.ts", "packages/web/src/pay.ts", "services/billing/__init__.py", "services/billing/main.py", "services/billing/store.py"]
    assert [files[p].file_id for p in sorted(files)] == [1, 2, 3, 4, 5, 6, 7]
    assert files["packages/web/src/app.test.ts"].role == "test" and files["services/billing/store.py"].language == "python" and len(files["docs/notes.py"].hash) == 16
    assert "vendor/lib/a.js" in column(tree.scan(spark, root, include_vendor=True), "rel_path") and "docs/notes.py" not in column(tree.scan(spark, root, "fast"), "rel_path")
    assert {r.outcome for r in tree.scan(spark, root, max_bytes=60).collect()} == {"ok", "too-large"}


def test_roles_and_ignore_rules(spark):
    paths = ["vendor/a_test.go", "src/x.pb.go", "a/__tests__/b.ts", "src/main.go", "third-party/x.c", "x.min.js", "spec/a.rb", "Generated/x.h"]
    got = {r.p: r.r for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", tree.role(F.col("p")).alias("r")).collect()}
    assert got == dict(zip(paths, ["vendor", "generated", "test", "project", "vendor", "generated", "test", "generated"]))
    rules = tree.IgnoreRules({".gitignore": "*.log\n/build\n!keep.log\ndocs/**/x\n# c\n", "sub/.gitignore": "!a.log\ntmp/\n"})
    cases = {"a.log": True, "sub/a.log": False, "keep.log": False, "build/x": True, "sub/build/x": False, "docs/a/b/x": True, "sub/tmp/y": True, "tmp/y": False}
    assert {p: rules.ignored(p) for p in cases} == cases


@pytest.mark.parametrize("language", sorted(samples.ALL))
def test_extraction_of_samples(language):
    got = X.extract(language, samples.ALL[language])
    measures = {s["qualified_name"]: (s["kind"], s["line_start"], s["line_end"], s["cyclomatic"], s["cognitive"], s["max_nesting"]) for s in got["symbols"]}
    want = {
        "go": {"Store": ("struct", 7, 9, None, None, None), "Get": ("method", 18, 31, 5, 7, 2), "Reader": ("interface", 13, 15, None, None, None)},
        "java": {"Orders.get": ("method", 11, 16, 4, 4, 2), "Orders.run#1": ("method", 22, 22, 3, 2, 1), "Orders.Orders": ("constructor", 9, 9, 1, 0, 0), "Orders.Kind": ("enum", 8, 8, None, None, None)},
        "rust": {"Point.walk": ("function", 13, 16, 7, 12, 3), "Area.twice": ("function", 5, 5, 1, 0, 0), "Map": ("type", 6, 6, None, None, None)},
        "cpp": {"Shape.scale": ("function", 13, 17, 4, 5, 2), "Shape.size": ("function", 8, 8, 2, 1, 0), "helper#1": ("function", 21, 21, 2, 2, 1), "Shape.area": ("method", 6, 6, None, None, None)},
        "csharp": {"Service.Load": ("method", 7, 11, 5, 7, 2), "Point": ("class", 3, 3, None, None, None), "Handler": ("type", 4, 4, None, None, None)},
        "typescript": {"Box.load": ("method", 10, 14, 8, 15, 3), "outer.inner": ("function", 18, 18, 1, 0, 0), "go": ("function", 5, 5, 1, 0, 0), "Box.constructor": ("constructor", 9, 9, 1, 0, 0)},
        "python": {"pay": ("function", 5, 11, 5, 8, 2), "A.run#1": ("function", 18, 18, 1, 0, 0), "A": ("class", 16, 18, None, None, None)},
    }[language]
    assert {k: measures[k] for k in want} == want and got["error"] is None


def test_services_of_samples():
    got = {k: X.extract(k, v) for k, v in samples.ALL.items()}
    routes = {(r["protocol"], r["method"], r["path"], r["handler_name"]) for r in got["typescript"]["routes"]}
    assert routes >= {("http", "GET", "/users/:id", "getUser"), ("http", "HEAD", "/both", "both"), ("trpc", "QUERY", "getUser", "getUserHandler"), ("graphql", "MUTATION", "addUser", None), ("kafka", "CONSUME", "refunds", None), ("rabbitmq", "CONSUME", "mail", "onMail")}
    calls = {(c["protocol"], c["method"], c["raw_target"], c["operation"] or c["topic"] or c["queue"]) for c in got["typescript"]["service_calls"]}
    assert calls >= {("http", "GET", "/api/users", None), ("http", "POST", "/charge/:param", None), ("trpc", "QUERY", "user.getUser", "user.getUser"), ("graphql", "MUTATION", "gql`mutation { addUser { id } }`", "addUser"), ("sqs", "PUBLISH", "https://sqs/1/jobs", "jobs"), ("sns", "PUBLISH", "arn:aws:sns:eu:1:alerts", "alerts"), ("redis_pubsub", "PUBLISH", "chan", "chan")}
    assert not any("count" in c["raw_target"] for c in got["typescript"]["service_calls"])
    assert {(r["method"], r["path"], r["handler_name"]) for r in got["java"]["routes"]} == {("GET", "/api/orders/{id}", "get"), ("POST", "/api/orders", "create")}
    assert {(c["protocol"], c["operation"]) for c in got["go"]["service_calls"]} >= {("grpc", "UserService/GetUser"), ("http", None)}
    assert {k["key"] for x in got.values() for k in x["config_keys"]} == {"TOPIC", "API_KEY", "MODE", "BASE"}
    assert got["rust"]["imports"] == ["std::collections::HashMap", "crate::a::{b, c}"] and got["cpp"]["imports"] == ["vector", "shape.h"]
    assert X.extract("python", "def (")["error"] and not X.extract("typescript", "function ((( {{{ `")["error"]


def test_resolution_and_edges(tables):
    at = ids(tables)
    resolved = {(r.file_id, r.import_name): r.resolved_file_id for r in tables["imports"].collect()}
    assert resolved[(3, "./pay")] == 4 and resolved[(2, "./app")] == 3 and resolved[(6, ".store")] == 7 and resolved[(6, "os")] is None
    edges = {(r.from_id, r.to_id, r.kind) for r in tables["edges"].collect()}
    web, bill = "packages/web/src/", "services/billing/"
    start, charge, own = at[(web + "app.ts", "start")], at[(web + "pay.ts", "charge")], at[(web + "pay.ts", "helper")]
    assert {(start, charge, "call"), (charge, own, "call"), (at[(bill + "main.py", "charge")], at[(bill + "store.py", "save")], "call"), (at[(web + "app.test.ts", "test_start")], start, "tests")} <= edges
    link = tables["links"].collect()[0]
    assert link.match_kind == "route_pattern" and link.caller_id == start and link.handler_id == at[(bill + "main.py", "charge")] and link.confidence == 0.85
    assert {(r.key, r.symbol_id) for r in tables["config_keys"].collect()} == {("RATE", own), ("RATE", at[(bill + "main.py", "helper")])}


def test_evidence_risk_and_reports(spark, tables):
    at = ids(tables)
    start, charge = at[("packages/web/src/app.ts", "start")], at[("packages/web/src/pay.ts", "charge")]
    targets = spark.createDataFrame([(start,), (charge,)], "symbol_id long")
    ranked = evidence.ranked_tests(targets, tables["edges"], tables["symbols"], tables["files"], tables["lines"]).collect()
    got = {r.symbol_id: (r.relation, r.distance, r.assertions, r.score) for r in ranked if r.place == 1}
    assert got[start] == ("direct-call", 1, 2, 108) and got[charge] == ("indirect-call", 2, 2, 48)
    states = {r.symbol_id: r.state for r in evidence.coverage_states(targets, spark.createDataFrame(ranked), tables["files"]).collect()}
    assert states == {start: "graph-linked", charge: "graph-linked"}
    signals = evidence.risk_signals(targets, tables)
    s = {r.symbol_id: r.asDict() for r in signals.collect()}
    assert s[start]["direct_tests"] == 1 and s[start]["outbound_calls"] == 1 and s[start]["ambiguous_links"] == 1 and s[charge]["direct_callers"] == 1 and s[charge]["transitive_callers"] == 1
    r = {x.symbol_id: (x.score, x.risk) for x in evidence.risk(signals).collect()}
    # a direct caller (the test), a direct test, two assertions, an outbound call, an ambiguous link
    assert r[start] == (1.0 - 10 - 4 + 2 + 1, "low")
    parts = evidence.contributions(signals, 2).filter(F.col("symbol_id") == start).orderBy("place").collect()
    assert [(p.signal, p.contribution) for p in parts] == [("direct_tests", -10.0), ("assertion_count", -4.0)]
    packet = reports.context(start, tables)
    assert packet["callees"].count() == 2 and packet["tests"].first().total >= 1 and packet["links"].count() == 1
    hunks = spark.createDataFrame([("packages/web/src/pay.ts", 1, 1)], "rel_path string, start int, end int")
    found = reports.detect_changes(hunks, tables["symbols"], tables["files"], tables["edges"])
    assert column(found["direct"], "symbol_id") == [charge] and start in column(found["callers"], "symbol_id")
    pre = reports.preflight(hunks, None, tables)
    assert pre["overall"].first().risk == "low" and column(pre["symbols"], "symbol_id") == [charge]
    shape = reports.architecture(tables)
    assert {r.language: r.files for r in shape["languages"].collect()} == {"python": 4, "typescript": 3} and shape["entry_points"].count() >= 1
    bounds = {r.symbol_id: (r.resolved, r.by_name, r.definitions) for r in S.caller_bounds(tables["edges"].filter("kind = 'call'"), tables["symbols"]).collect()}
    assert bounds[charge] == (1, 1, 2)
    text = [r.text for r in derive.skeleton(tables["symbols"].filter("file_id = 4")).orderBy("place").collect()]
    assert text[0].startswith("export function charge(n: number)  [L1-3]  { … 1 lines … }") or text[0].startswith("function charge(n: number)  [L1-3]  { … 1 lines … }")


def test_name_matching(spark):
    rows = [("test_start", "start", True), ("restart", "start", True), ("restarted", "start", False), ("teststartx", "start", False), ("Start", "start", True), ("a", "start", False), ("x.y", "x.y", True)]
    got = spark.createDataFrame(rows, "t string, n string, want boolean").select("t", evidence.name_matches(F.col("t"), F.col("n")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_search_and_lookups(spark, tables):
    found = search.search_symbols(tables["symbols"], tables["files"], "charg", limit=5).collect()
    assert {r.name for r in found} == {"charge"} and found[0].score >= found[-1].score > 0
    assert search.search_symbols(tables["symbols"], tables["files"], "tart", limit=5).first().name == "start"
    assert search.search_files(tables["files"], "billing store").first().rel_path == "services/billing/store.py"
    assert lookups.definition(tables["symbols"], tables["files"], "charge", "web/src/pay.ts").count() == 1
    assert lookups.definition(tables["symbols"], tables["files"], "charge", "ay.ts").count() == 0
    assert lookups.variants("A::B::c") == ["A::B::c", "A.B.c"] and lookups.variants("") == [""]
    assert lookups.match_file(tables["files"], "SRC/app.ts").first().rel_path == "packages/web/src/app.ts"
    assert [r.name for r in lookups.file_symbols(tables["symbols"], tables["files"], "services/billing/main.py").collect()] == ["charge", "helper"]
    assert lookups.complexity_ranking(tables["symbols"], "cognitive").first().name == "save"
    rows, page = lookups.paged(tables["symbols"], ["symbol_id"], 3, 2)
    assert column(rows, "symbol_id") == [3, 4, 5] and page == {"total": 8, "next_offset": 5, "truncated": True}
    assert lookups.routes_list(tables["routes"], tables["files"], tables["symbols"], method="post").first().handler == "charge"
    assert lookups.links_list(tables["links"], tables["service_calls"], tables["routes"], tables["symbols"], tables["files"]).first().call_path == "packages/web/src/app.ts"
    assert column(derive.snippets(spark.createDataFrame([(1, 4, 1)], "site_id long, file_id long, line int"), tables["lines"], 1, 0), "snippet") == ["export function charge(n: number) {\n  return helper(n);"]
    count = {r.symbol_id: r for r in S.count_calls(tables["edges"].filter("kind = 'call'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).filter("dst IS NOT NULL"), tables["symbols"], tables["files"]).collect()}
    assert count[ids(tables)[("packages/web/src/app.ts", "start")]].test_files == 1


def test_manifests_and_boundaries(texts, tables):
    deps = {(r.ecosystem, r.name, r.version, r.is_dev) for r in manifests.dependencies(texts).collect()}
    assert deps == {("npm", "left", "^1.0", False), ("npm", "right", "2", True), ("pypi", "flask", "==2.0", False), ("pypi", "numpy", None, False), ("go", "github.com/x/y", "v1.2.3", False), ("go", "github.com/z/w", "v0.1.0", False)}
    assert manifests.dependencies_of("Cargo.toml", '[dependencies]\na = "1"\nb = { version = "2" }\n[dev-dependencies]\nc = "3"\n') == [("cargo", "a", "1", False), ("cargo", "b", "2", False), ("cargo", "c", "3", True)]
    assert manifests.dependencies_of("pyproject.toml", '[project]\ndependencies = ["x>=1", "y"]\n[tool.poetry.dependencies]\nz = "^2"\n') == [("pypi", "x", ">=1", False), ("pypi", "y", None, False), ("pypi", "z", "^2", False)]
    assert [(r.operation, r.handler_name) for r in manifests.proto_routes(texts).collect()] == [("Users/Get", "Get")]
    assert column(manifests.service_hosts(texts), "host") == ["billing", "cache", "queue"]
    roots = manifests.boundary_roots(texts)
    got = {r.root: (r.label, r.kind, r.rank) for r in roots.collect()}
    assert got["packages/web"] == ("web", "package", 2) and got["services/billing"] == ("billing", "service", 0) and got[""][0] in ("root", "tool")
    members = manifests.boundary_members(tables["files"], roots)
    owned = manifests.boundaries(roots, members)
    assert {(r.root, r.file_count, r.boundary_id) for r in owned.collect()} == {("packages/web", 3, 1), ("services/billing", 3, 2)}
    assert len(manifests.fingerprint(roots).first().fingerprint) == 16
    assert manifests.workspace_globs("Cargo.toml", '[workspace]\nmembers = ["a/*"]\nexclude = ["a/x"]\n') == [("a/*", False), ("a/x", True)]
    assert manifests.workspace_globs("pnpm-workspace.yaml", "packages:\n  - 'a/*'\n  - b # c\n") == [("a/*", False), ("b", False)]
    assert manifests.workspace_globs("go.work", "use (\n ./a\n ./b\n)\nuse ./c\n") == [("./a", False), ("./b", False), ("./c", False)]
    across = derive.rollup(derive.file_weights(tables["edges"], tables["symbols"], tables["imports"], tables["links"]), members.withColumnRenamed("root", "module_id"))
    assert [(r.from_id, r.to_id, r.kind, r.weight) for r in across.collect()] == [("packages/web", "services/billing", "service", 1)]


def test_modules(tables):
    weights = derive.file_weights(tables["edges"], tables["symbols"], tables["imports"], tables["links"])
    got = modules.module_tables(tables["files"], weights, tables["symbols"])
    of = {r.file_id: r.module_id for r in got["members"].collect()}
    assert of[2] == of[3] == of[4] and of[6] == of[7] and len(set(of.values())) == 4
    labels = {r.module_id: (r.label, r.size) for r in got["modules"].collect()}
    assert labels[of[3]] == ("packages", 3) and labels[of[6]] == ("services#1", 2) and labels[of[1]] == ("docs", 1)
    assert column(modules.reachable_groups(got["module_edges"], of[3]), "id") == [of[6]]
    assert column(modules.import_closure(tables["imports"], 2), "id") == [3, 4]
    rolled = services.module_links(tables["links"], tables["symbols"], got["members"])
    assert [(r.module_id, r.depth, r.links) for r in services.module_reach(rolled, of[3]).collect()] == [(of[6], 1, 1)]


def test_louvain_finds_cliques():
    pairs = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a in g for b in g if a < b] + [(3, 4, 0.5)]
    at = modules.louvain(list(range(8)), pairs)
    assert len({at[i] for i in range(4)}) == 1 and len({at[i] for i in range(4, 8)}) == 1 and at[0] != at[4]
    assert modules.louvain([1, 2], []) == {1: 1, 2: 2}


def test_links_of_all_protocols(spark):
    routes = spark.createDataFrame(
        [(i, "POST", "/pay", "http", None, None, None) for i in range(100)] + [(200, "ANY", "/x/", "http", None, None, None), (201, "QUERY", "get", "trpc", "get", None, None), (202, "QUERY", "user", "graphql", "user", None, None), (203, "GET", "S/M", "grpc", "S/M", None, None), (204, "CONSUME", "t", "kafka", None, "t", None), (205, "CONSUME", "q", "sqs", None, None, "q"), (206, "GET", "/one", "http", None, None, None), (207, "GET", "/:id", "http", None, None, None)],
        "route_id long, method string, path string, protocol string, operation string, topic string, queue string",
    )
    calls = [(1, "http", "POST", "/pay", "pay.local", None), (2, "http", "GET", "/x", None, None), (3, "trpc", "QUERY", None, None, "user.get"), (4, "graphql", "QUERY", None, None, "DOC"), (5, "grpc", "M", None, None, "S/M"), (8, "http", "GET", "/one", None, None), (9, "http", "GET", "/two", None, None)]
    calls = spark.createDataFrame([(*c, None, None, None, None) for c in calls] + [(6, "kafka", "PUBLISH", None, None, None, "t", None, None, None), (7, "sqs", "PUBLISH", None, None, None, None, "q", None, None), (10, "graphql", "DOCUMENT", None, None, "user", None, None, "gql-doc", "DOC")], "call_id long, protocol string, method string, path string, host string, operation string, topic string, queue string, framework string, raw_target string")
    hosts = spark.createDataFrame([("pay.local",)], "host string")
    got = {r.call_id: r for r in services.resolve_links(calls, routes, hosts).collect()}
    assert (got[1].route_id, got[1].candidates, got[1].truncated, len(got[1].others), got[1].match_kind, got[1].confidence) == (0, 100, True, 5, "service_host", 0.997)
    assert (got[2].route_id, got[2].confidence) == (200, 0.855) and (got[3].route_id, got[3].confidence) == (201, 0.7) and got[4].reason == "gql_doc_field"
    assert [got[i].route_id for i in (5, 6, 7)] == [203, 204, 205] and 10 not in got
    assert got[8].route_id == 206 and got[8].candidates == 1 and (got[9].route_id, got[9].candidates) == (207, 1)


def test_service_traces(spark):
    links = spark.createDataFrame([(1, 2, "http", "literal_path", 0.9), (1, 3, "http", "literal_path", 0.8), (2, 4, "kafka", "topic_match", 0.9), (3, 4, "http", "route_pattern", 0.5), (4, 1, "http", "literal_path", 0.9)], "caller_id long, handler_id long, protocol string, match_kind string, confidence double")
    found, cutoff = services.service_reach(links, 1)
    assert {r.symbol_id: (r.depth, r.hops, r.protocols) for r in found.collect()} == {2: (1, [1, 2], ["http"]), 3: (1, [1, 3], ["http"]), 4: (2, [1, 2, 4], ["http", "kafka"])} and cutoff is None
    assert services.service_reach(links, 1, max_depth=1)[1] == "maxDepth" and services.service_reach(links, 1, max_fanout=1)[1] == "maxFanout" and services.service_reach(links, 1, max_nodes=1)[1] == "maxNodes"
    assert services.service_path(links, 1, 4) == [1, 2, 4] and services.service_path(links, 2, 3) == [2, 4, 1, 3]


def test_targets(spark):
    cases = {"https://h.x/a/b/?q#f": ("h.x", "/a/b"), "HTTP://h": ("h", "/"), "svc/a/b": ("svc", "/a/b"), "/a/": (None, "/a"), "ftp://x/y": (None, None), "plain": (None, None), "/": (None, "/"), " /a?x ": (None, "/a")}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", T.target_host(F.col("u")).alias("h"), T.target_path(F.col("u")).alias("p")).collect()
    assert {r.u: (r.h, r.p) for r in rows} == cases


def test_continuity(spark):
    rows = [(1, "validateUser", "Auth.validateUser", 1, 7), (2, "validateAll", "Auth.validateAll", 1, 7), (3, "other", "X.other", 2, 9), (4, "thing", "Y.thing", 3, 9), (5, "thing2", "Y.thing2", 3, 9), (6, "nearOne", "Z.nearOne", 4, 0b1111), (7, "nearTwo", "Z.nearTwo", 5, 0b1101)]
    syms = spark.createDataFrame([(i, n, q, f, f"function:{q}", h) for i, n, q, f, h in rows], "symbol_id long, name string, qualified_name string, file_id long, symbol_key string, shape_hash long")
    past = spark.createDataFrame([(2,), (5,), (7,)], "symbol_id long")
    got = {r.symbol_id: (r.previous_symbol_key, r.confidence) for r in continuity.continuity(syms, past).collect()}
    assert got == {1: ("function:Auth.validateAll", 0.95), 4: ("function:Y.thing2", 0.7), 6: ("function:Z.nearTwo", 0.6)}


def test_contracts(spark):
    schema = "route_id long, method string, path string, protocol string, operation string"
    old = spark.createDataFrame([(1, "get", "/a", "http", None), (2, "GET", "/b", "http", None), (3, "Q", "x", "trpc", "x"), (4, "Q", "y", "websocket", None)], schema)
    new = spark.createDataFrame([(9, "GET", "/a", "http", None), (8, "Q", "x2", "trpc", "x"), (7, "GET", "/c", "http", None)], schema)
    changes = reports.contract_diff(old, new)
    assert {r["key"]: r.status for r in changes.collect()} == {"http|GET|/b": "removed", "trpc|x": "changed", "http|GET|/c": "added", "http|GET|/a": "changed"}
    links = spark.createDataFrame([(5, 2, 77)], "link_id long, route_id long, caller_id long")
    assert [(r["key"], r.caller_id) for r in reports.affected_callers(changes, old, links).collect()] == [("http|GET|/b", 77)]
    assert reports.contract_table(changes).first().line == "| removed | `http|GET|/b` |"


def test_store_and_bundle(spark, tables, tmp_path):
    old = spark.createDataFrame([("a", "1", "project"), ("b", "2", "project"), ("c", "3", "test")], "rel_path string, hash string, role string")
    new = spark.createDataFrame([("a", "1", "vendor"), ("b", "9", "project"), ("d", "4", "project")], "rel_path string, hash string, role string")
    assert {r.rel_path: r.status for r in store.classify_changes(old, new).collect()} == {"a": "unchanged", "b": "dirty", "c": "removed", "d": "added"}
    work, kept = store.gated(old, new)
    assert column(work, "rel_path") == ["b", "d"] and [(r.rel_path, r.role) for r in kept.collect()] == [("a", "vendor")]
    stay, gone = store.prune(old, new)
    assert column(stay, "rel_path") == ["a", "b"] and column(gone, "rel_path") == ["c"]
    assert column(store.upsert(old, new, ["rel_path"]), "hash") == ["1", "3", "4", "9"] and store.insert_ignore(old, new, ["rel_path"]).count() == 4
    marks = spark.createDataFrame([("a", "1", "x", 1), ("b", "2", "y", 1)], "rel_path string, hash string, options string, version int")
    assert column(store.stale_watermarks(old, marks, "x", 1), "rel_path") == ["b", "c"]
    wiped = store.wipe_dependents({"symbols": tables["symbols"], "edges": tables["edges"]}, spark.createDataFrame([(4,)], "file_id long"))
    assert wiped["symbols"].count() == tables["symbols"].count() - 2 and wiped["edges"].filter("to_id IS NULL").count() > tables["edges"].filter("to_id IS NULL").count()
    bundle = store.Bundle(spark, f"{tmp_path}/bundle")
    bundle.export({"files": tables["files"].drop("content"), "routes": tables["routes"]}, {"head": "abc"})
    assert bundle.load()["routes"].count() == 1 and bundle.manifest()["head"] == "abc"
    layered = store.external_layer(store.external_layer(tables["routes"], tables["routes"], "x"), tables["routes"], "x")
    assert layered.count() == 2
    assert store.git_state({"head": "a", "remote": "r"}, {"head": "b", "remote": None}) == {"head": "b", "remote": "r"}


def test_git(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@x", *args], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a.py").write_text("def f():\n    return 1\n\ndef g():\n    return 2\n")
    run("add", ".")
    run("commit", "-qm", "first (#12)")
    (tmp_path / "a.py").write_text("def f():\n    return 1\n\ndef g():\n    return 3\n")
    run("commit", "-qam", "second")
    log = git.name_log(spark, str(tmp_path))
    assert log.count() == 2 and log.filter("seq = 0").first().subject == "second"
    assert log.select(git.pr_number(F.col("subject")).alias("n")).filter("n = 12").count() == 1
    files = spark.createDataFrame([(1, "a.py")], "file_id long, rel_path string")
    patches = git.file_patches(files, str(tmp_path))
    hunks = git.patch_rows(patches).join(patches.select("commit_sha", "committed_at"), "commit_sha")
    syms = spark.createDataFrame([(1, 1, 0, 1), (2, 1, 3, 4)], "symbol_id long, file_id long, line_start int, line_end int")
    rows = derive.history_rows(hunks, syms, F.current_date()).collect()
    assert sorted((r.symbol_id, r.match_strategy) for r in rows) == [(1, "file-addition"), (2, "file-addition"), (2, "overlap")] and all(r.confidence == 1.0 for r in rows)
    assert [(r.rel_path, r.start, r.end) for r in git.changed_hunks(spark, str(tmp_path), "HEAD~1").collect()] == [("a.py", 4, 4)]
    assert [(r.added, r.removed) for r in git.numstat(spark, str(tmp_path), "HEAD").collect()] == [(1, 1)] and git.is_repository(str(tmp_path)) and not git.is_shallow(str(tmp_path))
    now = datetime(2024, 3, 10, 12, tzinfo=UTC)
    assert git.since("90d", now).date().isoformat() == "2023-12-11" and git.since("2y", now).year == 2022 and git.since("2024-01-02", now).day == 2 and git.since("all", now) is None
    url = spark.range(1).select(git.pr_url(F.lit("git@github.com:o/r.git"), F.lit(7)).alias("u")).first().u
    assert url == "https://github.com/o/r/pull/7"


def test_scip(spark, tables, tmp_path):
    doc = {"documents": [{"relative_path": "packages/web/src/pay.ts", "language": "typescript", "symbols": [{"symbol": "x `pay.ts`/charge().", "display_name": "charge", "kind": "Function"}], "occurrences": [{"symbol": "x `pay.ts`/charge().", "range": [0, 16, 22], "symbol_roles": 1}, {"symbol": "y other#", "range": [1, 2, 5], "symbol_roles": 0}]}, {"relative_path": "unknown.ts", "symbols": [], "occurrences": []}]}
    (tmp_path / "index.json").write_text(json.dumps(doc))
    documents = scip.read(spark, str(tmp_path / "index.json"))
    merged = scip.definitions(documents, tables["files"], tables["symbols"]).collect()
    charge = ids(tables)[("packages/web/src/pay.ts", "charge")]
    assert [(r.name, r.symbol_id) for r in merged] == [("charge", charge)]
    assert [(r.from_id, r.to_name, r.to_id) for r in scip.reference_edges(documents, tables["files"], tables["symbols"]).collect()] == [(charge, "y other#", None)]


def test_batch():
    out = reports.batch([("a", {"x": 1}), ("b", {})], {"a": lambda x: x + 1, "b": lambda: 1 / 0})
    assert out[0]["result"] == 2 and not out[1]["ok"] and "ZeroDivisionError" in out[1]["error"]
    with pytest.raises(ValueError, match="at most"):
        reports.batch([("a", {})] * 26, {})


def test_tools(tables):
    index = Index(tables)
    at = ids(tables)
    start = at[("packages/web/src/app.ts", "start")]
    assert column(index.call("callers", symbol="charge", file="src/pay.ts"), "caller") == ["start"]
    assert index.call("callers", symbol="helper", by_name=True, by_file=True).first().sites == 1
    assert "charge" in column(index.call("callees", symbol="start"), "to_name")
    assert [r.qualified_name for r in index.call("trace_path", source="test_start", target="start").collect()] == ["test_start", "start"]
    assert index.call("trace", scope="callers", symbol=str(start))["depths"].first().n == 1
    assert index.call("routes", method="POST").count() == 1 and index.call("service_links").first().caller == "start"
    assert index.call("skeleton", file="store.py").first().text.startswith("def save(id)")
    assert [r["ok"] for r in index.batch([("stats", {}), ("definition", {"symbol": "nothing"}), ("callers", {"symbol": "nothing"}), ("no", {})])] == [True, True, False, False]
    assert len(index.tools()) >= 40
    with pytest.raises(TypeError):
        index.call("routes", colour="red")
    with pytest.raises(ValueError, match="negative"):
        index.call("complexity", limit=-1)


def test_snapshots_go_on_after_a_restart(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k long, at int, v string")
    first = Snapshots(spark, f"{tmp_path}/s", "k", ["at"])
    first.apply(make([(1, 1, "a"), (2, 1, "b")]), 0)
    again = Snapshots(spark, f"{tmp_path}/s", "k", ["at"])
    assert again.version == 0 and freshness(again, False, False) == "fresh" and freshness(again, True, True) == "stale"
    again.apply(make([(1, 0, "late"), (2, 5, "c")]), 1)
    again.apply(make([(9, 9, "twice")]), 1)
    assert sorted((r.k, r.v) for r in Snapshots(spark, f"{tmp_path}/s", "k", ["at"]).read().collect()) == [(1, "a"), (2, "c")]
    assert sorted((r.k, r.v) for r in again.read(0).collect()) == [(1, "a"), (2, "b")]
    again.forget(1)
    assert again.versions() == [1] and freshness(Snapshots(spark, f"{tmp_path}/none", "k", ["at"]), False, False) == "missing"


def test_build_of_a_repository(spark, root, tmp_path):
    subprocess.run(f"cp -r {root} {tmp_path}/r && cd {tmp_path}/r && git init -q && git add . && git -c user.name=A -c user.email=a@x commit -qm one", shell=True, check=True)
    index = build(spark, f"{tmp_path}/r", f"{tmp_path}/out")
    assert index.call("callers", symbol="charge", file="src/pay.ts").first().caller == "start"
    link = index.call("service_links").first()
    assert (link.caller, link.handler, link.match_kind) == ("start", "charge", "route_pattern")
    assert index.call("routes", framework="grpc").first().operation == "Users/Get" and index.call("history", symbol="start").count() == 1 and index.call("churn").count() == 7
    assert {r.root for r in index.call("boundaries").collect()} == {"packages/web", "services/billing"} and index.call("boundary_for_file", file="store.py").first().label == "billing"
    assert index.call("symbol_module", symbol="save").first().label == "services#1" and index.call("dependencies", ecosystem="go").count() == 2
    (tmp_path / "r/docs/notes.py").write_text("def other(): pass\n")
    again = build(spark, f"{tmp_path}/r", f"{tmp_path}/out2", old=index.tables, with_history=False)
    names = lambda x: column(x.tables["symbols"], "qualified_name")
    assert set(names(again)) - set(names(index)) == {"other"} and len(names(again)) == len(names(index))
    assert export(index, f"{tmp_path}/bundle", f"{tmp_path}/r")["head"]

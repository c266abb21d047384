"""Manifests, protocol files and deployment files of source trees, and package boundaries from them."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders whose children are boundaries by convention, and their kinds.
CONVENTIONS = {"services": "service", "packages": "package", "apps": "app", "libs": "lib"}
MANIFESTS = ("package.json", "pnpm-workspace.yaml", "pyproject.toml", "Cargo.toml", "go.mod", "go.work", "composer.json")
MAX_DEPTH = 6
SPEC = re.compile(r"\s*([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*([<>=~!^].+)?")


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except (tomllib.TOMLDecodeError, TypeError):
        return {}


def _json(text: str) -> dict:
    try:
        got = json.loads(text)
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def _spec(text: str) -> tuple[str, str | None] | None:
    m = SPEC.match(text)
    return (m[1], m[2].strip() if m[2] else None) if m else None


def dependencies_of(path: str, text: str) -> list[tuple[str, str, str | None, bool]]:
    """(ecosystem, name, version, is_dev) of a manifest, by its file name."""
    name, out = posixpath.basename(path), []
    if name == "package.json":
        pkg = _json(text)
        for group in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            some = pkg.get(group)
            for dep, version in some.items() if isinstance(some, dict) else ():
                if dep:
                    out.append(("npm", dep, version if isinstance(version, str) else None, group == "devDependencies"))
    elif name == "Cargo.toml":
        doc = _toml(text)
        for group in ("dependencies", "dev-dependencies", "build-dependencies"):
            for dep, value in (doc.get(group) or {}).items():
                out.append(("cargo", dep, value if isinstance(value, str) else value.get("version") if isinstance(value, dict) else None, group == "dev-dependencies"))
    elif name == "pyproject.toml":
        doc = _toml(text)
        for item in (doc.get("project") or {}).get("dependencies") or ():
            if isinstance(item, str) and _spec(item):
                out.append(("pypi", *_spec(item), False))
        poetry = (doc.get("tool") or {}).get("poetry") or {}
        for group in ("dependencies", "dev-dependencies"):
            for dep, value in (poetry.get(group) or {}).items():
                out.append(("pypi", dep, value if isinstance(value, str) else None, group == "dev-dependencies"))
    elif re.fullmatch(r"requirements.*\.txt", name):
        for line in text.split("\n"):
            line = re.sub(r"#.*$", "", line).strip()
            if line and not line.startswith("-") and _spec(line):
                out.append(("pypi", *_spec(line), bool(re.search("(?i)dev|test", path))))
    elif name == "go.mod":
        bare = re.sub(r"//[^\n]*", "", text)
        for block in re.findall(r"(?ms)^\s*require\s*\(([^)]*)\)", bare) + re.findall(r"(?m)^\s*require\s+([^(\n]+)$", bare):
            for line in block.split("\n"):
                parts = line.split()
                if len(parts) >= 2:
                    out.append(("go", parts[0], parts[1], False))
    return out


def _rows(files: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows (rel_path, *schema) that `rows_of(path, text)` makes of files (rel_path, content)."""
    names = ["rel_path", *[c.split()[0] for c in schema.split(", ")]]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], f"rel_path string, {schema}").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [dict(zip(names, (r["rel_path"], *row), strict=True)) for r in batch.to_pylist() for row in rows_of(r["rel_path"], r["content"] or "")]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select("rel_path", "content").mapInArrow(run, f"rel_path string, {schema}")


def dependencies(files: DataFrame) -> DataFrame:
    """(ecosystem, name, version, manifest_path, is_dev): of an ecosystem, name and manifest the last row counts."""
    manifests = files.filter(F.element_at(F.split("rel_path", "/"), -1).rlike(r"^(package\.json|Cargo\.toml|pyproject\.toml|go\.mod|requirements.*\.txt)$"))
    rows = _rows(manifests, "place int, ecosystem string, name string, version string, is_dev boolean", lambda p, t: [(i, *d) for i, d in enumerate(dependencies_of(p, t))])
    last = rows.groupBy("ecosystem", "name", F.col("rel_path").alias("manifest_path")).agg(F.max(F.struct("place", "version", "is_dev")).alias("x"))
    return last.select("ecosystem", "name", "x.version", "manifest_path", "x.is_dev")


def rpcs_of(text: str) -> list[tuple[str, str, str, str, int]]:
    """(service, method, request, response, line from 0) of a protocol file; comments do not count."""
    code = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    out = []
    for m in re.finditer(r"\bservice\s+(\w+)\s*\{", code):
        depth, end = 1, m.end()
        while end < len(code) and depth:
            depth += {"{": 1, "}": -1}.get(code[end], 0)
            end += 1
        kind = r"\(\s*(?:stream\s+)?([\w.]+)\s*\)"
        for r in re.compile(rf"\brpc\s+(\w+)\s*{kind}\s*returns\s*{kind}").finditer(code, m.end(), end):
            out.append((m[1], r[1], r[2], r[3], code.count("\n", 0, r.start())))
    return out


def proto_routes(files: DataFrame) -> DataFrame:
    """Routes of protocol files (rel_path, content): operation `Service/Method`, protocol grpc."""
    rows = _rows(files.filter(F.col("rel_path").endswith(".proto")), "service string, rpc string, request string, response string, line int", lambda _, t: rpcs_of(t))
    operation = F.concat_ws("/", "service", "rpc")
    return rows.select("rel_path", F.upper("rpc").alias("method"), operation.alias("path"), F.lit("grpc").alias("framework"), F.col("rpc").alias("handler_name"), "line", F.lit("grpc").alias("protocol"), operation.alias("operation"), "service", "request", "response")


def hosts_of(path: str, text: str) -> list[tuple[str]]:
    """Names of services that a cluster or compose file declares, lower-cased."""
    found = re.findall(r"(?ms)^kind\s*:\s*[\"']?Service[\"']?\s*$(?:(?!^---).)*?^metadata\s*:\s*\n(?:[ \t]+[^\n]*\n)*?[ \t]+name\s*:\s*[\"']?([\w.-]+)", text)
    compose = re.search(r"(?i)(?:^|/)docker-compose[^/]*\.ya?ml$", path) or (re.search(r"(?m)^version\s*:", text) and re.search(r"(?m)^services\s*:", text))
    if compose:
        base = level = None
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            m = re.match(r"([ \t]*)([\w-]+)\s*:\s*(?:#.*)?(\S.*)?$", line)
            if not m:
                continue
            indent = len(m[1].replace("\t", "  "))
            if base is not None and indent > base:
                level = indent if level is None else level
                found += [m[2]] if indent == level else []
            else:
                base, level = (indent, None) if m[2] == "services" and not m[3] else (None, None)
    return [(x.lower(),) for x in dict.fromkeys(found)]


def service_hosts(files: DataFrame) -> DataFrame:
    """(host, paths): hosts that the tree's YAML files declare, with the sorted files that do."""
    rows = _rows(files.filter(F.col("rel_path").rlike(r"(?i)\.ya?ml$")), "host string", hosts_of)
    return rows.groupBy("host").agg(F.sort_array(F.collect_set("rel_path")).alias("paths"))


def label_of(path: str, text: str) -> str:
    """A boundary's name: of its manifest, else of its folder."""
    folder, name = posixpath.basename(posixpath.dirname(path)) or ".", posixpath.basename(path)
    if name == "package.json":
        given = _json(text).get("name")
        return re.sub(r"^@[^/]+/", "", given) if isinstance(given, str) and given else folder
    if name == "pyproject.toml":
        doc = _toml(text)
        return (doc.get("project") or {}).get("name") or ((doc.get("tool") or {}).get("poetry") or {}).get("name") or folder
    if name == "Cargo.toml":
        return (_toml(text).get("package") or {}).get("name") or folder
    if name == "go.mod":
        m = re.search(r"(?m)^\s*module\s+(\S+)", text)
        return m[1].rstrip("/").rsplit("/", 1)[-1] if m else folder
    return folder


def workspace_globs(path: str, text: str) -> list[tuple[str, bool]]:
    """(glob, is_exclusion) of the members that a manifest declares."""
    name = posixpath.basename(path)
    if name == "package.json":
        ws = _json(text).get("workspaces")
        globs = ws if isinstance(ws, list) else ws.get("packages", []) if isinstance(ws, dict) else []
    elif name == "pnpm-workspace.yaml":
        block = re.search(r"(?m)^packages\s*:\s*\n((?:[ \t]*(?:-[^\n]*|#[^\n]*)?(?:\n|\Z))*)", text)
        globs = [re.sub(r"^(['\"])(.*?)\1.*$|\s+#.*$", r"\2", x).strip() for x in re.findall(r"(?m)^[ \t]*-\s*(.+?)\s*$", block[1])] if block else []
    elif name == "go.work":
        bare = re.sub(r"//[^\n]*", "", text)
        globs = [x for b in re.findall(r"\buse\s*\(([^)]*)\)", bare) for x in b.split()] + re.findall(r"(?m)^[ \t]*use[ \t]+([^\s(]+)", bare)
    elif name == "Cargo.toml":
        ws = _toml(text).get("workspace") or {}
        return [(g, False) for g in ws.get("members", [])] + [(g, True) for g in ws.get("exclude", [])]
    else:
        globs = []
    return [(g.removeprefix("!"), g.startswith("!")) for g in globs if isinstance(g, str)]


def glob_pattern(base: str, glob: str) -> str:
    """A regular expression of the folders that a workspace glob names, relative to `base`: `*`, `?` and `**`."""
    parts = [p for p in posixpath.normpath(glob).split("/") if p not in ("", ".")]
    out = re.escape(base) + ("/" if base else "")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+/)*[^/]+" if last else "(?:[^/]+/)*"
        else:
            out += "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part) + ("" if last else "/")
    return f"^{out}$"


def boundary_roots(files: DataFrame) -> DataFrame:
    """(root, manifest_path, label, kind, ecosystem, rank): the best claim on each folder of a tree's files (rel_path,
    content): 2 for a manifest, 1 for a member of a workspace, 0 by convention.

    Globs are few and kept by the driver; folders are matched with them in column expressions.
    """
    path = F.col("rel_path")
    deep = F.size(F.split(path, "/")) <= MAX_DEPTH + 1
    ecosystems = {"package.json": "npm", "pyproject.toml": "pypi", "Cargo.toml": "cargo", "go.mod": "go", "composer.json": "composer"}
    manifests = files.filter(deep & F.element_at(F.split(path, "/"), -1).isin(*MANIFESTS))

    def hits(p: str, text: str) -> list[tuple]:
        name, root, globs = posixpath.basename(p), posixpath.dirname(p), workspace_globs(p, text)
        eco = "npm" if name.startswith("pnpm") else "go" if name == "go.work" else ecosystems[name]
        out = [(root, "glob", g, "exclude" if no else "include", eco) for g, no in globs]
        if name in ecosystems:
            kind = "workspace-root" if name == "package.json" and globs else "package"
            out.append((root, "manifest", label_of(p, text), kind, eco))
        return out

    rows = _rows(manifests, "root string, what string, value string, kind string, ecosystem string", hits)
    claimed = rows.filter("what = 'manifest'").select("root", F.col("rel_path").alias("manifest_path"), F.col("value").alias("label"), "kind", "ecosystem", F.lit(2).alias("rank"))
    parts = F.split(path, "/")
    folders = files.filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(MAX_DEPTH))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root")).distinct()
    by_rule = []
    globs = rows.filter("what = 'glob'").select("root", "value", "kind", "ecosystem").collect()
    for eco in sorted({g["ecosystem"] for g in globs}):
        keep = "|".join(glob_pattern(g["root"], g["value"]) for g in globs if g["ecosystem"] == eco and g["kind"] == "include")
        drop = "|".join(glob_pattern(g["root"], g["value"]) for g in globs if g["ecosystem"] == eco and g["kind"] == "exclude")
        if keep:
            members = folders.filter(F.col("root").rlike(keep) & ((~F.col("root").rlike(drop)) if drop else F.lit(True)))
            by_rule.append(members.select("root", F.lit("").alias("manifest_path"), F.element_at(F.split("root", "/"), -1).alias("label"), F.lit("package").alias("kind"), F.lit(eco).alias("ecosystem"), F.lit(1).alias("rank")))
    kinds = F.create_map(*[F.lit(x) for item in CONVENTIONS.items() for x in item])
    level = F.split("root", "/")
    named = folders.filter((F.size(level) == 2) & level[0].isin(*CONVENTIONS))
    by_rule.append(named.select("root", F.lit("").alias("manifest_path"), level[1].alias("label"), kinds[level[0]].alias("kind"), F.lit(None).cast("string").alias("ecosystem"), F.lit(0).alias("rank")))
    every = claimed
    for more in by_rule:
        every = every.unionByName(more)
    best = every.groupBy("root").agg(F.max(F.struct("rank", "manifest_path", "label", "kind", "ecosystem")).alias("best"))
    return best.select("root", "best.manifest_path", "best.label", "best.kind", "best.ecosystem", "best.rank")


def prefixes(path: Column) -> Column:
    """The folders above a path, the deepest last; the root of the tree is not among them."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def boundary_members(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(file_id, root): the deepest boundary of each file that has one. The tree's own root owns no file."""
    up = files.select("file_id", F.explode(prefixes(F.col("rel_path"))).alias("root"))
    return up.join(roots.select("root").filter("root <> ''"), "root").groupBy("file_id").agg(F.max_by("root", F.length("root")).alias("root"))


def boundaries(roots: DataFrame, members: DataFrame) -> DataFrame:
    """`roots` that own files, with boundary_id by sorted root and file_count."""
    from .tree import numbered

    counts = members.groupBy("root").agg(F.count(F.lit(1)).alias("file_count"))
    return roots.join(counts, "root").join(numbered(counts, "root", "boundary_id"), "root").select("boundary_id", *roots.columns, "file_count")


def fingerprint(roots: DataFrame) -> DataFrame:
    """One row with 16 hex digits that change when any claim does."""
    line = F.concat_ws("\x00", "root", "manifest_path", "label", "kind", F.coalesce("ecosystem", F.lit("")))
    return roots.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256), 1, 16).alias("fingerprint"))

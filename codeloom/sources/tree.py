"""Source trees as tables: which files to read, in what language, and what part they play."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import _checkpoint

#: Extension to language.
LANGUAGES = {
    "py": "python", "pyw": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "go": "go", "java": "java", "rs": "rust", "c": "c", "cpp": "cpp", "cc": "cpp",
    "cxx": "cpp", "c++": "cpp", "hpp": "cpp", "hh": "cpp", "h++": "cpp", "h": "cpp", "cs": "csharp",
}
#: Folders and files left out by default; vendored and generated ones, unless asked for; and more in fast mode.
SKIPPED_DIRS = "node_modules .git .hg .svn dist build out .next .nuxt .svelte-kit .turbo coverage __pycache__ target obj cmake-build-* _build .gradle .cache .idea .vs Intermediate Saved DerivedDataCache".split()
SKIPPED_FILES = "*.min.js *.min.css *.bundle.js *.lock package-lock.json yarn.lock pnpm-lock.yaml".split()
VENDOR_DIRS = "vendor vendored Vendored third_party thirdparty ThirdParty".split()
GENERATED_FILES = "*.pb.go *.pb.ts *.pb.h *.pb.cc *.generated.h *.gen.cpp *.gen.h".split()
FAST_DIRS = "docs examples example assets static public media fixtures testdata migrations".split()
#: What makes a path vendored, generated or a test.
VENDOR_ROLE = r"(?i)(^|/)(vendor|vendored|third[_-]?party|external|node_modules|bower_components)/"
GENERATED_ROLE = (r"(?i)(^|/)generated/", r"(^|/)(\.next|\.nuxt|__generated__)/", r"(?i)(\.generated|\.gen|\.pb|_pb)\.[a-z]+$", r"(?i)\.min\.(js|css)$|\.bundle\.js$")
TEST_ROLE = (r"(?i)(^|/)(tests?|spec)/", r"(^|/)__tests__/", r"(?i)(\.test|\.spec|_test)\.[a-z]+$")
#: Generated headers and sources that are never parsed.
NEVER_PARSED = r"(?i)\.(generated\.h|gen\.cpp|gen\.h)$|\.pb\.(cc|h)$"
#: Names of files with ignore rules.
IGNORE_FILES = (".gitignore", ".ignore")


def _glob(pattern: str) -> str:
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)


def extension(path: Column) -> Column:
    """The lower-cased letters after the last point of the file's name, empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """The language by extension, null for others."""
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.create_map(*pairs)[extension(path)]


def is_vendor(path: Column) -> Column:
    return path.rlike(VENDOR_ROLE)


def is_generated(path: Column) -> Column:
    return F.greatest(*[path.rlike(p) for p in GENERATED_ROLE])


def role(path: Column) -> Column:
    """vendor, generated, test or project, the first that fits."""
    test = F.greatest(*[path.rlike(p) for p in TEST_ROLE])
    return F.when(is_vendor(path), "vendor").when(is_generated(path), "generated").when(test, "test").otherwise("project")


def skipped(path: Column, mode: str = "standard", include_vendor: bool = False, include_generated: bool = False) -> Column:
    """Whether a path is left out by default. mode: full (nothing but meta and build folders), standard, or fast."""
    dirs = [*SKIPPED_DIRS, *([] if include_vendor or mode == "full" else VENDOR_DIRS), *(FAST_DIRS if mode == "fast" else [])]
    files = [*SKIPPED_FILES, *([] if include_generated or mode == "full" else GENERATED_FILES)]
    return path.rlike(f"(^|/)({'|'.join(map(_glob, dirs))})/") | path.rlike(f"(^|/)({'|'.join(map(_glob, files))})$")


class IgnoreRules:
    """Layers of ignore files, each relative to its own folder; deeper layers, and later lines, win, and `!` takes back."""

    def __init__(self, layers: dict[str, str]):
        self.rules: list[tuple[str, bool, re.Pattern]] = []
        for where in sorted(layers, key=lambda p: (p.count("/"), p)):
            folder = where.rpartition("/")[0]
            for line in layers[where].splitlines():
                line = line.rstrip()
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                line = line[1:] if keep else line.removeprefix("\\")
                self.rules.append((f"{folder}/" if folder else "", keep, re.compile(self._pattern(line))))

    @staticmethod
    def _pattern(line: str) -> str:
        only_dir, line = line.endswith("/"), line.rstrip("/")
        rooted = "/" in line
        parts = line.lstrip("/").split("/")
        out = "" if rooted else "(?:.*/)?"
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part == "**":
                out += ".*" if last else "(?:.*/)?"
            else:
                out += _glob(part) + ("" if last else "/")
        return f"^{out}{'/' if only_dir else '(?:/|$)'}"

    def ignored(self, path: str) -> bool:
        out = False
        for folder, keep, pattern in self.rules:
            if path.startswith(folder) and pattern.match(path[len(folder) :]):
                out = not keep
        return out


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """`files` (rel_path, ...) without what the ignore files among `rules` (rel_path, content) leave out.

    The rules are the tree's own ignore files, some hundred lines a tree; they are compiled once a task.
    """
    layers = {r["rel_path"]: r["content"] or "" for r in rules.select("rel_path", "content").collect()}
    at, schema = files.columns.index("rel_path"), files.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = IgnoreRules(layers)
        for batch in batches:
            yield batch.filter(pa.array([not known.ignored(p) for p in batch.column(at).to_pylist()], pa.bool_()))

    return files.mapInArrow(run, schema)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, length) of all files under a folder of any store. Spark's own readers pass over names that begin with a
    point or an underscore, ignore files and package files among them, so names are listed here; contents are not read."""
    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    rows = [(i.path[len(base) + 1 :], i.size) for i in found if i.type == fs.FileType.File]
    return spark.createDataFrame(rows, "rel_path string, length long")


def with_contents(files: DataFrame, root: str) -> DataFrame:
    """`files` (rel_path, ...) with their contents as bytes, read by the tasks."""
    at = files.columns.index("rel_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for k, path in enumerate(batch.column(at).to_pylist()):
                with store.open_input_stream(f"{base.rstrip('/')}/{path}") as file:
                    content = pa.array([file.read()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, content], [*batch.schema.names, "content"])

    return files.mapInArrow(run, type(files.schema)([*files.schema.fields]).add("content", "binary"))


def scan(spark: SparkSession, root: str, mode: str = "standard", max_bytes: int | None = None, include_vendor: bool = False, include_generated: bool = False) -> DataFrame:
    """(file_id, rel_path, language, role, is_vendor, is_generated, outcome, length, lines, hash, content) of a tree's files.

    Only known extensions are listed, and paths are filtered before contents are read. outcome: `ok`, `too-large` or
    `skipped-name`; contents of others are null. Ids follow the sorted paths. hash: 16 hex digits of SHA-256.
    """
    names = listing(spark, root)
    path = F.col("rel_path")
    rules = with_contents(names.filter(F.element_at(F.split(path, "/"), -1).isin(*IGNORE_FILES)), root).select("rel_path", F.decode("content", "UTF-8").alias("content"))
    wanted = names.filter(language(path).isNotNull() & ~skipped(path, mode, include_vendor, include_generated))
    return described(with_contents(without_ignored(wanted, rules), root), max_bytes, include_generated)


def described(files: DataFrame, max_bytes: int | None = None, include_generated: bool = False) -> DataFrame:
    """Files (rel_path, length, content as bytes) with what `scan` says of them."""
    path = F.col("rel_path")
    outcome = F.when(F.lit(not include_generated) & path.rlike(NEVER_PARSED), "skipped-name")
    if max_bytes is not None:
        outcome = outcome.when(F.col("length") > max_bytes, "too-large")
    text = F.when(outcome.isNull(), F.decode("content", "UTF-8"))
    out = files.select("rel_path", language(path).alias("language"), role(path).alias("role"), is_vendor(path).alias("is_vendor"), is_generated(path).alias("is_generated"), F.coalesce(outcome, F.lit("ok")).alias("outcome"), "length", F.size(F.split(text, "\n")).alias("lines"), F.when(outcome.isNull(), F.substring(F.sha2("content", 256), 1, 16)).alias("hash"), text.alias("content"))
    # ids by sorted path: paths alone are numbered, so no content moves to one task
    ids = numbered(out.select("rel_path"), "rel_path", "file_id")
    return out.join(ids, "rel_path").select("file_id", *out.columns)


def numbered(keys: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): distinct keys numbered from 1 in order, by ranges: counts a range first, then places within it.

    Ranges are sampled and joined anew in each run, so the keys are written with theirs once and read by both steps.
    """
    ranged = _checkpoint(keys.select(key).distinct().repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    start = F.create_map(*[F.lit(x) for item in (before or {0: 0}).items() for x in item])[F.col("_part")]
    return ranged.select(key, (start + place).cast("long").alias(name))

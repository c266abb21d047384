"""Git history as tables. Subprocesses give text; parsing and all joins are Spark's."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
COMMIT = "%x01%H%x02%an%x02%ae%x02%at%x02%s"


def git(root: str, *args: str, timeout: int = 300) -> str:
    """Standard output of a git command; an empty text if it fails."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def is_repository(root: str) -> bool:
    return git(root, "rev-parse", "--is-inside-work-tree").strip() == "true"


def is_shallow(root: str) -> bool:
    return git(root, "rev-parse", "--is-shallow-repository").strip() == "true"


def head(root: str) -> str | None:
    return git(root, "rev-parse", "HEAD").strip() or None


def remote(root: str) -> str | None:
    return git(root, "config", "--get", "remote.origin.url").strip() or None


def pr_number(message: Column) -> Column:
    """The number of a pull request in a commit's message: `Merge pull request #n`, or `(#n)` at the end of its first line."""
    n = F.coalesce(F.regexp_extract(message, r"(?i)merge pull request #(\d+)", 1), F.lit(""))
    m = F.regexp_extract(message, r"\A[^\n]*\(#(\d+)\)", 1)
    return F.coalesce(F.nullif(n, F.lit("")), F.nullif(m, F.lit(""))).cast("int")


def pr_url(remote_url: Column, number: Column) -> Column:
    """The address of a pull request, where the remote is on GitHub."""
    repo = F.regexp_extract(remote_url, r"github\.com[:/]([^/]+/[^/]+?)(?:\.git)?/?$", 1)
    return F.when((repo != "") & number.isNotNull(), F.concat(F.lit("https://github.com/"), repo, F.lit("/pull/"), number.cast("string")))


def since(text: str | None, now: datetime) -> datetime | None:
    """A horizon: `2y`, `18mo`, `90d`, `6w`, an ISO date, or unix seconds; at midnight UTC. None for `all` or nothing."""
    if not text or text.strip().lower() in ("all", "none"):
        return None
    value = text.strip().lower()
    m = re.fullmatch(r"(\d+)\s*(y|mo|w|d)", value)
    if m:
        days = {"y": 365, "mo": 30, "w": 7, "d": 1}[m[2]] * int(m[1])
        at = now.astimezone(UTC) - timedelta(days=days)
    elif re.fullmatch(r"\d{9,}", value):
        at = datetime.fromtimestamp(int(value), UTC)
    else:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    return at.replace(hour=0, minute=0, second=0, microsecond=0)


def name_log(spark: SparkSession, root: str, *args: str) -> DataFrame:
    """(commit_sha, author, email, committed_at, subject, seq, rel_path): files of each commit without merges, newest
    first (seq 0)."""
    rows = []
    for seq, part in enumerate(git(root, "log", "--no-merges", "--name-only", f"--format={COMMIT}", *args).split("\x01")[1:]):
        top, _, names = part.partition("\n")
        sha, author, email, at, subject = top.split("\x02")
        rows += [(sha, author, email, int(at), subject, seq, n) for n in names.split("\n") if n.strip()]
    df = spark.createDataFrame(rows, "commit_sha string, author string, email string, at long, subject string, seq int, rel_path string")
    return df.withColumn("committed_at", F.timestamp_seconds("at")).drop("at")


def hunks_of(text: Column) -> Column:
    """Structs (old_start, old_lines, new_start, new_lines) of a patch."""
    heads = F.filter(F.split(text, "\n"), lambda x: x.rlike(HUNK))
    num = lambda x, k: F.regexp_extract(x, HUNK, k)
    count = lambda x, k: F.when(num(x, k) == "", 1).otherwise(F.try_to_number(num(x, k), F.lit("999999999")).cast("int"))
    return F.transform(heads, lambda x: F.struct(num(x, 1).cast("int").alias("old_start"), count(x, 2).alias("old_lines"), num(x, 3).cast("int").alias("new_start"), count(x, 4).alias("new_lines")))


def patch_rows(patches: DataFrame) -> DataFrame:
    """(commit_sha, file_id, old_start, old_lines, new_start, new_lines, is_file_addition, lines_added, lines_removed) of
    patches (commit_sha, file_id, patch), a row a hunk; added and removed are the whole patch's."""
    lines = F.split("patch", "\n")
    added = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    removed = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    fresh = F.col("patch").rlike(r"(?m)^new file mode|^--- /dev/null")
    return patches.select("commit_sha", "file_id", fresh.alias("is_file_addition"), added.alias("lines_added"), removed.alias("lines_removed"), F.explode(hunks_of(F.col("patch"))).alias("h")).select("commit_sha", "file_id", "h.*", "is_file_addition", "lines_added", "lines_removed")


def file_patches(files: DataFrame, root: str, follow: bool = True, shas: str | None = None) -> DataFrame:
    """(file_id, commit_sha, author, email, committed_at, subject, patch) of files (file_id, rel_path): the commits that
    touch each, with its patch. Every task asks git for its own files. With `shas` (an array column), only those commits,
    without a walk."""
    cols = ["file_id", "rel_path", *([shas] if shas else [])]
    schema = "file_id long, commit_sha string, author string, email string, at long, subject string, patch string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                how = ["show", *r[shas]] if shas else ["log", "--no-merges", *(["--follow"] if follow else [])]
                text = git(root, *how, "-U0", "--no-color", f"--format={COMMIT}", "--", r["rel_path"]) if not shas or r[shas] else ""
                rows = []
                for part in text.split("\x01")[1:]:
                    top, _, patch = part.partition("\n")
                    sha, author, email, at, subject = top.split("\x02")
                    rows.append((r["file_id"], sha, author, email, int(at), subject, patch))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    return files.select(*cols).mapInArrow(run, schema).withColumn("committed_at", F.timestamp_seconds("at")).drop("at")


def changed_hunks(spark: SparkSession, root: str, from_ref: str, to_ref: str = "HEAD") -> DataFrame:
    """(rel_path, start, end): line ranges from 0 of the new side that differ between two refs; one for each hunk."""
    rows, path = [], None
    for line in git(root, "diff", "-U0", "--no-color", "--no-ext-diff", from_ref, to_ref).split("\n"):
        if line.startswith("+++ "):
            path = line[6:] if line.startswith("+++ b/") else None
        m = re.match(HUNK, line)
        if m and path:
            begin, n = int(m[3]), int(m[4]) if m[4] is not None else 1
            rows.append((path, max(0, begin - 1), max(0, begin - 1) + max(0, n - 1)))
    return spark.createDataFrame(rows, "rel_path string, start int, end int")


def numstat(spark: SparkSession, root: str, sha: str) -> DataFrame:
    """(rel_path, added, removed) of a commit; binary files have nulls."""
    rows = [(p, int(a) if a.isdigit() else None, int(d) if d.isdigit() else None) for a, d, p in (x.split("\t") for x in git(root, "show", "--numstat", "--format=", sha).split("\n") if x.count("\t") == 2)]
    return spark.createDataFrame(rows, "rel_path string, added int, removed int")

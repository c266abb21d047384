"""Extraction over a table of files: one row a file with nested records, and flat tables of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import languages as L
from . import python_source
from .scan import Source
from .services import SERVICES

SYMBOL = "name string, qualified_name string, kind string, line_start int, line_end int, signature string, symbol_role string, loc int, cyclomatic int, cognitive int, max_nesting int, body string"
CALL = "name string, line int, caller string"
ROUTE = "method string, path string, framework string, handler_name string, line int, protocol string, operation string, topic string, queue string, exchange string"
SERVICE_CALL = "protocol string, method string, raw_target string, framework string, line int, confidence double, env_key string, operation string, topic string, queue string, exchange string, service string, caller string"
CONFIG_KEY = "key string, source string, line int"
RECORD = f"symbols array<struct<{SYMBOL}>>, calls array<struct<{CALL}>>, imports array<string>, routes array<struct<{ROUTE}>>, service_calls array<struct<{SERVICE_CALL}>>, config_keys array<struct<{CONFIG_KEY}>>, error string"
#: Kinds that can be ranked, and the length to which signatures are cut.
RANKABLE, SIGNATURE = ("function", "method", "constructor", "class"), 240
#: Tasks for each core, and files, or characters of them, whose records are handed over at a time.
DEALS, SOME, LONG = 4, 256, 1_000_000


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _row(schema: str, values: dict) -> dict:
    return {n: values.get(n) for n in _names(schema)}


def extract(language: str, text: str) -> dict:
    """The record of a file. A file that cannot be read has its error and nothing else."""
    empty = {"symbols": [], "calls": [], "imports": [], "routes": [], "service_calls": [], "config_keys": [], "error": None}
    if language == "python":
        try:
            got = python_source.extract(text)
        except ValueError as error:
            return {**empty, "error": str(error)}
        lines = text.split("\n")
        symbols = [_symbol(d, d.begin, d.end, lines[d.begin].strip(), "\n".join(lines[d.begin : d.end + 1])) for d in got["definitions"]]
        return {**empty, "symbols": symbols, "calls": got["calls"], "imports": got["imports"], "routes": [_row(ROUTE, r) for r in got["routes"]], "service_calls": [_row(SERVICE_CALL, r) for r in got["service_calls"]], "config_keys": got["config_keys"]}
    src = Source(text, L.LANGUAGES[language].lexer)
    found = L.definitions(src, language)

    def caller(at: int) -> str | None:
        inside = [d for d in found if d.begin <= at < d.end]
        return max(inside, key=lambda d: d.begin).qualified_name if inside else None

    def in_code(at: int) -> bool:
        """Whether a place is in a body or outside of definitions, not in a header, a type or a list of variants."""
        inside = max((d for d in found if d.begin <= at < d.end), key=lambda d: d.begin, default=None)
        if inside is None or inside.kind in ("function", "method", "constructor"):
            return inside is None or inside.body is None and inside.role == "definition" or inside.body is not None and at > inside.body
        return inside.kind == "class" and inside.body is not None and at > inside.body

    symbols = [_symbol(d, src.line(d.begin), src.line(max(d.begin, d.end - 1)), text[d.begin : d.end].split("\n")[0].strip(), text[d.begin : d.end]) for d in found]
    own = {src.code.find(d.name, d.begin) + d.name.startswith("~") for d in found if d.kind in ("function", "method", "constructor")}
    calls = [{"name": n, "line": src.line(at), "caller": caller(at)} for n, at in L.calls(src, language, own) if in_code(at)]
    out = {**empty, "symbols": symbols, "calls": calls, "imports": list(L.imports(src, language))}
    for table, row, at in SERVICES[language](src) if language in SERVICES else ():
        schema = {"routes": ROUTE, "service_calls": SERVICE_CALL, "config_keys": CONFIG_KEY}[table]
        out[table] = [*out[table], _row(schema, {**row, "caller": caller(at)})]
    return out


def _symbol(d: L.Definition, first: int, last: int, head: str, body: str) -> dict:
    values = {"name": d.name, "qualified_name": d.qualified_name, "kind": d.kind, "line_start": first, "line_end": last, "signature": re.sub(r"\s*\{\s*$", "", head)[:SIGNATURE], "symbol_role": d.role, "loc": d.loc, "cyclomatic": d.cyclomatic, "cognitive": d.cognitive, "max_nesting": d.max_nesting, "body": body if d.kind in ("function", "method", "constructor") else None}
    return _row(SYMBOL, values)


def extracted(files: DataFrame) -> DataFrame:
    """(file_id, rel_path, language, symbols, calls, imports, routes, service_calls, config_keys, error), a row a file of
    `files` (file_id, rel_path, language, content). Files are independent; those of null content have no records.

    Files are dealt to all cores, as a table of many short ones is read by few tasks.
    """
    tasks = DEALS * files.sparkSession.sparkContext.defaultParallelism
    rows = files.select("file_id", "rel_path", "language", "content").repartition(tasks, "file_id", "rel_path")
    schema = f"file_id long, rel_path string, language string, {RECORD}"
    target = files.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, size = [], 0
            for row in batch.to_pylist():
                known = row["language"] in L.LANGUAGES or row["language"] == "python"
                record = extract(row["language"], row["content"]) if known and row["content"] is not None else {**extract("python", ""), "error": None}
                done.append({"file_id": row["file_id"], "rel_path": row["rel_path"], "language": row["language"], **record})
                size += len(row["content"] or "")
                if len(done) >= SOME or size >= LONG:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                    done, size = [], 0
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return rows.mapInArrow(run, schema)


def flat(records: DataFrame, name: str) -> DataFrame:
    """One of the nested tables, a row a record, with file_id and its place in the file."""
    rows = records.select("file_id", F.posexplode(name).alias("place", "r"))
    if name == "imports":
        return rows.select("file_id", "place", F.col("r").alias("import_name"))
    return rows.select("file_id", "place", "r.*")


def symbol_key() -> Column:
    return F.concat_ws(":", "kind", "qualified_name")


def rankable() -> Column:
    return (F.col("symbol_role") == "definition") & F.col("kind").isin(*RANKABLE)


def symbols(records: DataFrame) -> DataFrame:
    """(symbol_id, file_id, ...): ids by file, then place; symbol_key and is_rankable added."""
    rows = flat(records, "symbols")
    per = records.select("file_id", F.size("symbols").alias("n"))
    from pyspark.sql import Window

    # one number a file meets in one task; symbols stay where they are
    start = F.sum("n").over(Window.orderBy("file_id")) - F.col("n")
    return rows.join(per.select("file_id", start.alias("start")), "file_id").select((F.col("start") + F.col("place") + 1).cast("long").alias("symbol_id"), *[c for c in rows.columns if c != "place"], symbol_key().alias("symbol_key"), rankable().alias("is_rankable"))


def edges(records: DataFrame, syms: DataFrame) -> DataFrame:
    """(edge_id, from_id, file_id, to_name, kind, line): calls within definitions. Callers are found by their file and
    qualified name, the first of equal ones; calls at module level are left out."""
    calls = flat(records, "calls").filter("caller IS NOT NULL")
    first = syms.groupBy("file_id", F.col("qualified_name").alias("caller")).agg(F.min("symbol_id").alias("from_id"))
    edge_id = F.concat_ws(":", "file_id", "place")
    return calls.join(first, ["file_id", "caller"]).select(edge_id.alias("edge_id"), "from_id", "file_id", F.col("name").alias("to_name"), F.lit("call").alias("kind"), "line")

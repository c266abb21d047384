"""Symbol indexes of other tools, as JSON: documents with symbols and occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.derive import merge_imported
from ..operators.symbols import enclosing

SCHEMA = (
    "documents array<struct<relative_path:string, language:string, "
    "symbols:array<struct<symbol:string, display_name:string, kind:string, documentation:array<string>>>, "
    "occurrences:array<struct<symbol:string, range:array<int>, symbol_roles:int, enclosing_range:array<int>>>>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(relative_path, symbols, occurrences), a row a document."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")


def occurrences(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, symbol, line_start, line_end, is_definition) of the documents whose files are known; others are left out."""
    rows = documents.join(files.select("file_id", F.col("rel_path").alias("relative_path")), "relative_path").select("file_id", F.explode("occurrences").alias("o"))
    span = F.coalesce("o.enclosing_range", "o.range")
    end = F.when(F.size(span) >= 4, span[2]).otherwise(span[0])
    return rows.select("file_id", F.col("o.symbol").alias("symbol"), span[0].alias("line_start"), end.alias("line_end"), (F.col("o.symbol_roles").bitwiseAND(F.lit(1)) == 1).alias("is_definition"))


def last_name(symbol):
    """The last descriptor of a symbol's moniker, without its marks."""
    return F.regexp_extract(symbol, r"([\w$]+)[^\w$]*$", 1)


def definitions(documents: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, file_id, name, qualified_name, kind, line_start, line_end, symbol_id): definitions, merged with known symbols."""
    info = documents.join(files.select("file_id", F.col("rel_path").alias("relative_path")), "relative_path").select("file_id", F.explode("symbols").alias("s")).select("file_id", F.col("s.symbol").alias("key"), F.col("s.display_name").alias("display"), F.lower("s.kind").alias("kind"))
    at = occurrences(documents, files).filter("is_definition").groupBy("file_id", F.col("symbol").alias("key")).agg(F.min(F.struct("line_start", "line_end")).alias("r"))
    found = info.join(at, ["file_id", "key"]).select("key", "file_id", F.coalesce(F.nullif(F.col("display"), F.lit("")), last_name(F.col("key"))).alias("name"), last_name(F.col("key")).alias("qualified_name"), F.coalesce("kind", F.lit("function")).alias("kind"), "r.line_start", "r.line_end")
    return merge_imported(found, symbols)


def reference_edges(documents: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_id, to_name, to_id, line): references, from the smallest symbol around each to the symbol that it names, which
    has the moniker's name where its document is not known."""
    refs = occurrences(documents, files).filter("NOT is_definition").select(F.monotonically_increasing_id().alias("point_id"), "file_id", "symbol", F.col("line_start").alias("line"))
    spans = symbols.filter("symbol_role = 'definition'").select(F.col("symbol_id").alias("span_id"), "file_id", "line_start", "line_end")
    around = enclosing(refs.select("point_id", "file_id", "line"), spans)
    targets = definitions(documents, files, symbols).groupBy(F.col("key").alias("symbol")).agg(F.min("symbol_id").alias("to_id"), F.min("name").alias("known_name"))
    out = refs.join(around, "point_id").filter("span_id IS NOT NULL").join(targets, "symbol", "left")
    return out.select(F.col("span_id").alias("from_id"), F.coalesce("known_name", "symbol").alias("to_name"), "to_id", "line")

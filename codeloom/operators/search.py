"""Ranked text search over an inverted index, by BM25 over several fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifier_tokens
from .lookups import find_symbols, lens

K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; all else parts words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def query_terms(text: str) -> list[str]:
    """The words of a query, distinct; each stands for all words that begin so."""
    import re

    return list(dict.fromkeys(w for w in re.split(r"[^\w]|_", text.lower()) if w))


def index(rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(term, id, tf, length): the inverted index of rows; a word counts once each time it is in a field, length over all."""
    every = rows.select(F.col(key).alias("id"), F.concat(*[words(c) for c in fields.values()]).alias("w"))
    return every.select("id", F.size("w").alias("length"), F.explode_outer("w").alias("term")).groupBy("term", "id", "length").agg(F.count("term").alias("tf"))


def symbol_index(symbols: DataFrame) -> DataFrame:
    split = F.array_join(identifier_tokens(F.concat_ws(" ", "name", "qualified_name")), " ")
    return index(symbols, "symbol_id", {"name": F.col("name"), "qualified_name": F.col("qualified_name"), "signature": F.col("signature") if "signature" in symbols.columns else F.lit(""), "split": split})


def file_index(files: DataFrame) -> DataFrame:
    return index(files, "file_id", {"rel_path": F.col("rel_path")})


def corpus(postings: DataFrame) -> DataFrame:
    """One row (n, mean): how many rows are indexed and their mean length. Kept with the index."""
    once = postings.groupBy("id").agg(F.first("length").alias("length"))
    return once.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))


def bm25(postings: DataFrame, terms: list[str], stats: DataFrame | None = None, prefixes: bool = True) -> DataFrame:
    """(id, score): rows that hold any of the terms, or words that begin with them.

    Only the postings of these terms are read and shuffled; statistics are one row, joined, so nothing is run on the way.
    """
    wanted = F.lit(False)
    number = F.lit(None).cast("int")
    for i, t in enumerate(terms):
        is_it = F.col("term").startswith(t) if prefixes else F.col("term") == t
        wanted, number = wanted | is_it, F.when(is_it, F.coalesce(number, F.lit(i))).otherwise(number)
    if prefixes:
        hits = [F.when(F.col("term").startswith(t), F.lit(i)) for i, t in enumerate(terms)]
        per = postings.filter(wanted).select("id", "length", "tf", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("t"))
    else:
        per = postings.filter(wanted).select("id", "length", "tf", number.alias("t"))
    per = per.groupBy("t", "id", "length").agg(F.sum("tf").alias("tf"))
    df = per.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    scored = per.join(F.broadcast(df), "t").join(F.broadcast(stats if stats is not None else corpus(postings)))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def search_symbols(symbols: DataFrame, files: DataFrame, text: str, limit: int = 50, postings: DataFrame | None = None, **flags) -> DataFrame:
    """Symbols by BM25, ties by rank; where nothing is found, those that hold the text as a part of their names."""
    seen = symbols.join(files.select("file_id", "rel_path", "role", "is_vendor", "is_generated"), "file_id").filter(lens(**flags))
    found = bm25(postings if postings is not None else symbol_index(symbols), query_terms(text)) if query_terms(text) else None
    if found is None or found.isEmpty():
        return find_symbols(seen, text, limit).withColumn("score", F.lit(0.0))
    return seen.join(found, F.col("symbol_id") == F.col("id")).drop("id").orderBy(F.desc("score"), F.desc("pagerank"), "symbol_id").limit(limit)


def search_files(files: DataFrame, text: str, limit: int = 30, **flags) -> DataFrame:
    """Files by BM25 over their paths: twice as many as asked for, then those that may be seen."""
    terms = query_terms(text)
    if not terms:
        return files.limit(0).withColumn("score", F.lit(0.0))
    top = bm25(file_index(files), terms).orderBy(F.desc("score"), "id").limit(2 * limit)
    return files.join(top, F.col("file_id") == F.col("id")).drop("id").filter(lens(symbol_role=False, **flags)).orderBy(F.desc("score"), "rel_path").limit(limit)


def did_you_mean(symbols: DataFrame, files: DataFrame, text: str) -> DataFrame:
    """The five nearest names of a text that names nothing."""
    return search_symbols(symbols, files, text, 5, include_tests=True).select("symbol_id", "qualified_name", "score")

"""Quality rules: per-document counts, and host verdicts from shrunk failure rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, BLANK_CHARS, WORD, stash

SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition rule.
SPAN = 5
#: Bounds of the rules besides the base rules.
MAX_SYMBOLS_PER_100_WORDS, MAX_DUP_LINES_PER_100_LINES, MIN_MEAN_CHARS, MAX_MEAN_CHARS = 50, 50, 2, 15


def _repeat_words(words: str) -> str:
    """SQL for the number of words in windows of SPAN words that occur twice or more in the array `words`.

    Windows become 64-bit hashes of word hashes. A primitive sort finds whether any hash repeats; only documents
    where one does sort (hash, position) pairs, whose repeated positions, in order, each cover SPAN words or up to
    the next one. No step is quadratic in the text.
    """
    hashes = f"transform({words}, w -> xxhash64(w))"
    at = ", ".join(f"h[i + {k}]" for k in range(SPAN))
    windows = f"transform(array({hashes}), h -> transform(sequence(0, size(h) - {SPAN}), i -> xxhash64({at})))[0]"
    any_twice = "size(array_distinct(g)) < size(g)"
    pairs = "array_sort(transform(g, (x, i) -> struct(x AS x, i AS i)))"
    twice = (
        f"array_sort(transform(filter(transform(array({pairs}), p -> transform(p, (e, k) -> struct(e.i AS i, "
        "(k > 0 AND p[k - 1].x = e.x) OR (k < size(p) - 1 AND p[k + 1].x = e.x) AS hit)))[0], e -> e.hit), e -> e.i))"
    )
    cover = f"aggregate({twice}, struct(-{SPAN} AS last, 0 AS n), (a, i) -> struct(i AS last, a.n + least({SPAN}, i - a.last) AS n), a -> a.n)"
    return (
        f"CASE WHEN size({words}) < {SPAN} THEN 0 ELSE "
        f"transform(array({windows}), g -> CASE WHEN {any_twice} THEN {cover} ELSE 0 END)[0] END"
    )


def rule_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` as a struct column `row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        "row",
        "t",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.translate("t", BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).alias("n_lines"),
    )
    rows = rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.expr(_repeat_words("words")).cast("long").alias("n_repeat_words"),
        "n_lines",
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _rules() -> list[Column]:
    """Whether a document fails the base rules, the symbol bound, the bound on repeated lines, and that on word lengths."""
    return [
        F.col("base_failed"),
        100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * F.col("n_words"),
        100 * F.col("n_dup_lines") > MAX_DUP_LINES_PER_100_LINES * F.col("n_lines"),
        ~F.col("word_chars").between(MIN_MEAN_CHARS * F.col("n_words"), MAX_MEAN_CHARS * F.col("n_words")),
    ]


def _any() -> Column:
    """1 if a document fails any rule, else 0."""
    return F.greatest(*[F.coalesce(r, F.lit(True)).cast("int") for r in _rules()])


#: A host fails when its rate is this many standard deviations of the prior above the prior's mean; but never at rates up to
#: the first bound, and always above the second.
DEVIATIONS, LEAST_RATE, MOST_RATE = 4.0, 0.25, 0.5
#: Hosts that fail are broadcast up to this many.
BROADCAST_HOSTS = 100_000


def host_verdicts(counts: DataFrame, host: str = "host") -> DataFrame:
    """(v_host, failed, n, rate, host_ok): failure rates of hosts, shrunk by a beta prior fitted to all hosts by moments.

    counts: (host, failed), a row a document, failed being 0 or 1. Only per-host sums are shuffled. The prior is a single
    row of sums, read by the driver; the bound follows from it.
    """
    per = counts.groupBy(F.col(host).alias("v_host")).agg(F.sum("failed").alias("failed"), F.count(F.lit(1)).alias("n"))
    per = stash(per, "hosts")
    raw = F.col("failed") / F.col("n")
    m = per.agg(F.avg(raw).alias("mean"), F.var_samp(raw).alias("var"), F.avg(1 / F.col("n")).alias("noise")).first()
    mean = min(max(m["mean"] or 0.0, 1e-6), 1 - 1e-6)
    spread = max((m["var"] or 0.0) - mean * (1 - mean) * (m["noise"] or 0.0), 1e-9)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4)
    bound = min(max(mean + DEVIATIONS * math.sqrt(mean * (1 - mean) / (strength + 1)), LEAST_RATE), MOST_RATE)
    rate = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return per.select("v_host", "failed", "n", rate.alias("rate"), (rate <= bound).alias("host_ok"))


def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep_rows: bool = False, every_rule: bool = False) -> DataFrame:
    """Counts and verdict of every row of `docs`: kept is false if the base rules fail it or its host fails.

    A host's rate is the share of its documents that fail any rule: the base rules, the bounds on symbols, on repeated
    lines, and on word lengths. With every_rule, each rule rejects its documents too, not only through their host.

    A host with null is a host of its own. Null and empty texts have no words and fail. Rows are judged one by one, so
    repeated rows count each; empty input gives no rows; other columns change nothing, whatever their names. With
    keep_rows, the columns are those of `docs` in a struct `row`, plus `kept`; the counts are then made twice (for the
    hosts, for the rows) rather than carrying texts through a shuffle. Hosts that fail are broadcast while they are few.
    """
    counted = rule_counts(docs, text_col).withColumn("failed", _any()).withColumn("host", F.col("row").getField(host_col))
    if not keep_rows:
        counted = stash(counted.select("*", F.col("row").getField(id_col).alias("doc_id")).drop("row"), "rules")
    bad = stash(host_verdicts(counted).filter("NOT host_ok").select("v_host", F.lit(True).alias("host_failed")), "failed-hosts")
    few = bad.count() <= BROADCAST_HOSTS
    out = counted.join(F.broadcast(bad) if few else bad, F.col("host").eqNullSafe(F.col("v_host")), "left")
    rejected = F.col("failed") > 0 if every_rule else F.col("base_failed")
    return out.withColumn("kept", ~rejected & F.col("host_failed").isNull())


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that pass every rule and whose host passes, with their columns. Nulls, empty texts, repeated rows,
    empty input and clashing names are as in `quality_rules`."""
    judged = quality_rules(docs, keep_rows=True, every_rule=True, **options)
    return judged.filter("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (
  SELECT doc_id, i, words[i:i + 4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
r AS (
  SELECT *, CAST(base_failed OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words AS INT) AS failed FROM f),
h AS (SELECT source, CAST(sum(failed) AS DOUBLE) AS failed, count(*) AS n FROM r GROUP BY source),
m AS (SELECT least(greatest(avg(failed / n), 1e-6), 1 - 1e-6) AS mean, coalesce(var_samp(failed / n), 0) AS var, avg(1.0 / n) AS noise FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * noise, 1e-9) - 1, 1.0), 1e4) AS strength FROM m),
b AS (SELECT mean, strength, least(greatest(mean + 4.0 * sqrt(mean * (1 - mean) / (strength + 1)), 0.25), 0.5) AS bound FROM p)
SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
       NOT r.base_failed AND (h.failed + b.mean * b.strength) / (h.n + b.strength) <= b.bound AS kept
FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source, b
"""


def op9_quality(spark, sf_dir):
    from .common import table

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule judges."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stash

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host then path), as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Lexical features of a url; the last two come from statistics of its host's suffix over all rows.
FEATURES = ("length", "depth", "digit_ratio", "entropy", "n_params", "host_length", "host_labels", "n_hyphens", "suffix_pages", "suffix_params")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0).otherwise(n - F.length(F.replace(text, c))))
    share = F.transform(counts, lambda k: F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0))
    return {
        "length": n.cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.when(n > 0, (n - F.length(F.translate(text, "0123456789", ""))) / n).otherwise(0.0),
        "entropy": F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0),
        "n_params": (F.length(text) - F.length(F.translate(text, "=", ""))).cast("double"),
        "host_length": F.length(host).cast("double"),
        "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "n_hyphens": (n - F.length(F.translate(text, "-", ""))).cast("double"),
    }


@dataclass
class Node:
    """A split (feature < threshold goes left) or, without feature, a leaf."""

    value: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


def _grow(rows: list, grads: list[float], hess: list[float], idx: list[int], depth: int, min_rows: int, shrink: float, bins: int) -> Node:
    g, h = sum(grads[i] for i in idx), sum(hess[i] for i in idx)
    node = Node(value=shrink * g / (h + 1.0))
    if depth == 0 or len(idx) < 2 * min_rows:
        return node
    best = (1e-6, None, 0.0)
    for f, name in enumerate(FEATURES):
        values = sorted({rows[i][f] for i in idx})
        cuts = values[1:] if len(values) <= bins else [values[k * (len(values) - 1) // bins] for k in range(1, bins + 1)]
        for cut in dict.fromkeys(cuts):
            lg = lh = ln = 0.0
            for i in idx:
                if rows[i][f] < cut:
                    lg, lh, ln = lg + grads[i], lh + hess[i], ln + 1
            if min(ln, len(idx) - ln) >= min_rows:
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, name, cut)
    if best[1] is None:
        return node
    f = FEATURES.index(best[1])
    sides = ([i for i in idx if rows[i][f] < best[2]], [i for i in idx if rows[i][f] >= best[2]])
    node.feature, node.threshold = best[1], best[2]
    node.left, node.right = (_grow(rows, grads, hess, s, depth - 1, min_rows, shrink, bins) for s in sides)
    return node


def boost(rows: list, labels: list[int], trees: int = 12, depth: int = 3, min_rows: int = 5, shrink: float = 0.4, bins: int = 16) -> tuple[float, list[Node]]:
    """Log-odds start and trees, fitted by second-order boosting of the logistic loss on rows of FEATURES."""
    if not rows:
        return 0.0, []
    share = min(max(sum(labels) / len(labels), 1e-3), 1 - 1e-3)
    start = math.log(share / (1 - share))
    score, out = [start] * len(rows), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grow(rows, [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p], list(range(len(rows))), depth, min_rows, shrink, bins)
        out.append(tree)
        for i, row in enumerate(rows):
            node = tree
            while node.feature:
                node = node.left if row[FEATURES.index(node.feature)] < node.threshold else node.right
            score[i] += node.value
    return start, out


def tree_column(node: Node) -> Column:
    if node.feature is None:
        return F.lit(float(node.value))
    return F.when(F.col(node.feature) < node.threshold, tree_column(node.left)).otherwise(tree_column(node.right))


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, sample_rows: int = 2000, threshold: float = 0.5) -> DataFrame:
    """`pages` in a struct `row`, with host, path, rule, verdict, and block_score where no rule decides.

    The labelled urls are those a rule judges. The trees are fitted on at most `sample_rows` distinct labelled feature
    rows, the first by a hash of the url, so reruns agree; scores are nested conditionals of columns. Suffix
    statistics (pages of the host's last label, and their mean parameter count) cover all rows. A null url, or one
    without `://`, has empty host and path, fits no rule, and is scored by its features. Without labelled rows the
    score is 0.5 and the verdict allow. Repeated rows get equal verdicts; empty input gives no rows.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), url.alias("u"), url_host(url).alias("host"), url_path(url).alias("path"))
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
    rows = rows.select("row", "u", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), "suffix", *[c.alias(n) for n, c in lexical(F.col("u"), F.col("host"), F.col("path")).items()])
    stats = rows.groupBy(F.col("suffix").alias("s_suffix")).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("suffix_pages"), F.avg("n_params").alias("suffix_params"))
    stats = stash(stats, "suffixes")
    rows = rows.join(stats, F.col("suffix") == F.col("s_suffix"), "left")
    sample = (
        rows.filter(F.col("ruled").isNotNull())
        .select(F.xxhash64("u").alias("at"), F.col("ruled"), *FEATURES)
        .dropDuplicates(["at"])
        .orderBy("at")
        .limit(sample_rows)
        .collect()
    )
    start, trees = boost([tuple(r[f] for f in FEATURES) for r in sample], [int(r["ruled"] == "block") for r in sample])
    margin = F.lit(float(start))
    for tree in trees:
        margin = margin + tree_column(tree)
    score = 1 / (1 + F.exp(-margin))
    return rows.select(
        "row",
        "host",
        "path",
        "rule",
        F.coalesce(F.col("ruled"), F.when(score > threshold, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("ruled").isNull(), score).alias("block_score"),
    )


def op4_url_filter(spark, sf_dir):
    from .common import table

    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")

"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels.

The voters are a lexicon and patterns that stand on their own: none is taken from labels. Each speaks for one class or
abstains. The label model is fitted without labels being trusted: where a row has one, it is a further noisy voter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash, tidy

#: Every ASCII character that is no letter or digit parts words.
PARTS = {c: " " for c in range(128) if not chr(c).isalnum()}
#: Lengths of the word beginnings that are features besides whole words.
BEGINNINGS = (5, 6, 7)
WORD_MEMO = 300_000
#: Words of abuse in four languages; each is a voter for toxic, with its plural and other endings.
LEXICON = """
idiot moron imbecile stupid dumb fool clown loser scum trash garbage filth filthy vermin worthless pathetic disgusting
despicable coward liar jerk bastard bitch slut whore asshole crap shit fuck damn dickhead retard freak creep pig
dumm trottel abschaum arschloch scheiße wertlos erbärmlich widerlich ekelhaft versager hurensohn
stupide crétin connard salaud salope merde ordure minable dégoûtant abruti
estúpido imbécil basura escoria inútil patético asqueroso mierda gilipollas cabrón
""".split()
#: Patterns that vote for toxic.
TOXIC_PATTERNS = {
    "shut up": r"\bshut (?:the \w+ )?up\b|\bhalt(?:'s| die) maul\b|\bferme ta gueule\b|\bcállate\b",
    "wish of harm": r"\bgo to hell\b|\b(?:kill|hang) yourself\b|\bdrop dead\b|\bhope (?:you|they) die\b",
    "hate of people": r"\b(?:i|we) hate (?:you|them|those|all)\b|\bich hasse (?:dich|euch)\b|\bje te déteste\b|\bte odio\b",
    "you are so": r"\byou(?:'re| are) (?:a |an |so |such )+\w*(?:idiot|fool|loser|liar|stupid|dumb|pathetic)",
    "masked oath": r"\b(?:f|sh)[*#@$!]{2,}\w*",
}
#: Words whose presence speaks for address of a person, and words of formal text.
ADDRESS = frozenset("you your yours yourself du dich dein deine tu te toi ton ta vous tú usted tus".split())
FORMAL = frozenset("license licence licensed copyright reserved warranty section article chapter isbn http https www".split())


def distinct_words(text: str | None) -> set[str]:
    return set((text or "").lower().translate(PARTS).split())


def word_features(word: str) -> list[str]:
    """A word stands for itself and for its beginnings, written with an asterisk."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def features(text: str | None) -> set[str]:
    return {f for w in distinct_words(text) for f in word_features(w)}


#: Names of the voters, and whether each speaks for toxic (1) or clean (0).
VOTERS = [*LEXICON, *TOXIC_PATTERNS, "no word of abuse", "calm and not addressed", "formal"]
SPEAKS_FOR = np.array([1] * (len(LEXICON) + len(TOXIC_PATTERNS)) + [0] * 3)


def voter() -> Callable[[str | None], list[int]]:
    """A function from a text to the numbers of the voters that do not abstain."""
    stems = {w: i for i, w in enumerate(LEXICON)}
    longest = max(map(len, stems))
    patterns = [re.compile(p) for p in TOXIC_PATTERNS.values()]

    def votes(text: str | None) -> list[int]:
        low = (text or "").lower()
        words = set(low.translate(PARTS).split())
        # a word counts for the longest stem it starts with, at most three letters after it
        fired = {stems[w[:k]] for w in words for k in range(max(3, len(w) - 3), min(len(w), longest) + 1) if w[:k] in stems}
        fired |= {len(LEXICON) + i for i, p in enumerate(patterns) if p.search(low)}
        first = len(LEXICON) + len(patterns)
        calm = "!" not in low and not words & ADDRESS
        return sorted(fired) + [first + i for i, f in enumerate((not fired, calm, bool(words & FORMAL))) if f]

    return votes


@dataclass
class LabelModel:
    """How often each voter fires in either class, how pairs of voters depend on each other within a class, and the prior.

    Given the class, votes follow a forest of the strongest dependences: a row's likelihood is the product of its voters'
    rates of firing or abstaining and, for each pair of the forest, of the ratio of the pair's joint rate to the product
    of both. So voters that fire together for the same reason do not count in full each. `gold` holds the rates at which
    a label, where there is one, says toxic in both classes.
    """

    prior: float
    rates: np.ndarray
    pairs: list[tuple[int, int]]
    lifts: np.ndarray
    gold: tuple[float, float]

    def posterior(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        fired, silent = np.log(self.rates), np.log(1 - self.rates)
        odds = math.log(self.prior / (1 - self.prior)) + votes @ (fired[1] - fired[0]) + (1 - votes) @ (silent[1] - silent[0])
        for k, (v, w) in enumerate(self.pairs):
            odds = odds + (self.lifts[1, k] - self.lifts[0, k])[(2 * votes[:, v] + votes[:, w]).astype(int)]
        g1, g0 = self.gold
        odds = odds + np.where(gold == 1, math.log(g1 / g0), np.where(gold == 0, math.log((1 - g1) / (1 - g0)), 0.0))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(votes: np.ndarray, gold: np.ndarray, speaks_for: np.ndarray, weights: np.ndarray, rounds: int = 15) -> LabelModel:
    """Expectation maximisation over rows of 0/1 votes; `gold` (1, 0, or -1 for none) is one more noisy voter.

    It starts from plain sums of votes: a row is as likely toxic as its firing voters for toxic, and its label, outweigh
    those for clean.
    Each round estimates rates and, for all pairs, joint rates within classes; the maximum spanning forest by mutual
    information within classes gives the next posterior.
    """
    n, known = votes.shape[1], gold >= 0
    q = 1 / (1 + np.exp(-(2.0 * votes @ (speaks_for == 1) - 1.0 * votes @ (speaks_for == 0) + np.where(gold == 1, 3.0, np.where(gold == 0, -3.0, -0.5)))))
    model = None
    for _ in range(rounds):
        mass = {1: q * weights, 0: (1 - q) * weights}
        total = {y: m.sum() + 2 for y, m in mass.items()}
        rates = np.stack([(votes.T @ mass[y] + (0.2 if y == 1 else 0.1)) / total[y] for y in (0, 1)])
        # a voter speaks for its class or for nothing
        wrong = np.where(speaks_for == 1, rates[1] < rates[0], rates[1] > rates[0])
        rates = np.clip(np.where(wrong, rates.mean(axis=0), rates), 1e-5, 1 - 1e-4)
        lift, worth = np.zeros((2, 4, n, n)), np.zeros((n, n))
        for y in (0, 1):
            p = rates[y]
            both = (votes * mass[y][:, None]).T @ votes
            one = np.diag(both)
            counts = (total[y] - 2 - one[:, None] - one[None, :] + both, one[None, :] - both, one[:, None] - both, both)
            expected = (np.outer(1 - p, 1 - p), np.outer(1 - p, p), np.outer(p, 1 - p), np.outer(p, p))
            for o, (c, e) in enumerate(zip(counts, expected, strict=True)):
                # pseudo-counts in the proportions of independence: rare pairs are taken as independent
                lift[y, o] = np.log((np.maximum(c, 0) + 2 * e) / (total[y] * e))
                worth += c * lift[y, o]
        root, pairs = list(range(n)), []

        def top(v: int, root=root) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        worth = np.triu(worth, 1)
        for k in np.argsort(-worth, axis=None, kind="stable").tolist():
            v, w = divmod(k, n)
            if worth[v, w] < 2:
                break
            if top(v) != top(w):
                root[top(v)] = top(w)
                pairs.append((v, w))
        lifts = np.array([[lift[y, :, v, w] for v, w in pairs] for y in (0, 1)]).reshape(2, len(pairs), 4)
        g = [(mass[y][known] @ (gold[known] == 1) + (1 if y else 0.05)) / (mass[y][known].sum() + 2) for y in (0, 1)]
        prior = float(np.clip((q @ weights) / weights.sum(), 0.005, 0.8))
        model = LabelModel(prior, rates, pairs, lifts, (float(np.clip(g[1], 0.5, 0.99)), float(np.clip(g[0], 0.002, 0.5))))
        q = model.posterior(votes, gold)
    return model


def best_features(counts: list[tuple[str, float, float]], n1: float, n0: float, most: int) -> list[str]:
    """The features that tell toxic rows from others best, by the log-likelihood ratio of (feature, toxic, clean) masses."""

    def gain(a: float, b: float) -> float:
        p, out = (a + b) / (n1 + n0), 0.0
        for k, n in ((a, n1), (b, n0)):
            for x, e in ((k, n * p), (n - k, n * (1 - p))):
                out += 2 * x * math.log(x / e) if x > 0 and e > 0 else 0.0
        return out

    ranked = sorted(((gain(a, b), f) for f, a, b in counts if n1 > 0 and n0 > 0 and a / n1 > 2 * (b + 0.5) / n0), key=lambda x: (-x[0], x[1]))
    return [f for g, f in ranked[:most] if g > 4]


def fit_linear(x: np.ndarray, target: np.ndarray, mass: np.ndarray, steps: int = 400, ridge: float = 5e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels of rows that count `mass` each, by Adam on all rows; (weights, bias)."""
    mass = (mass / mass.sum()).astype(x.dtype)
    w, b = np.zeros(x.shape[1], dtype=x.dtype), 0.0
    target = target.astype(x.dtype)
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        off = (1 / (1 + np.exp(-(x @ w + b))) - target) * mass
        g = np.append(x.T @ off + ridge * w, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(x.dtype), float(b - step[-1])
    return w, b


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        found = {f for w in distinct_words(text) for f in word_features(w) if f in self.weights}
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(map(self.weights.__getitem__, sorted(found)))))))


KINDS = (1, 0, -1)


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(l_id, y, text): rows of the training folds, at most `per_class` labelled toxic (1), as many clean (0) and a third
    as many unlabelled (-1), the first by a hash of their id; and how many rows of its kind one stands for. Of rows of
    equal id the least text is taken."""
    fold = F.crc32(F.col("l_id").cast("string").cast("binary")) % 5 != 0
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).filter("l_id IS NOT NULL").filter(fold)
    free = docs.select(F.col(id_col).alias("l_id")).filter("l_id IS NOT NULL").filter(fold).join(known.select("l_id"), "l_id", "left_anti").withColumn("y", F.lit(-1))
    rows = known.filter("y IN (0, 1)").unionByName(free).groupBy("l_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    most = {1: per_class, 0: per_class, -1: max(1, per_class // 3)}
    picked = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(most[y]) for y in KINDS]
    chosen = stash(picked[0].unionByName(picked[1]).unionByName(picked[2]), "toxicity-chosen")
    found = docs.select(F.col(id_col).alias("l_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "l_id")
    found = stash(found.groupBy("l_id", "y").agg(F.min("text").alias("text")), "toxicity-sample")
    return found, {y: counts.get(y, 0) / max(1, min(most[y], counts.get(y, 0))) for y in KINDS}


def read_votes(sample: DataFrame) -> DataFrame:
    """(l_id, y, fired) of rows (l_id, y, text)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = voter()
        for batch in batches:
            fired = [votes(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fired, pa.list_(pa.int32()))], ["l_id", "y", "fired"])

    return sample.select("l_id", "y", "text").mapInArrow(run, f"l_id {sample.schema['l_id'].dataType.simpleString()}, y int, fired array<int>")


def feature_rows(sample: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(l_id, f) of rows (l_id, text): their features, or, given names, the numbers of those that they have."""
    kind, at = sample.schema["l_id"].dataType.simpleString(), None if names is None else {f: i for i, f in enumerate(names)}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [features(t) if at is None else {at[f] for f in features(t) if f in at} for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(s) for s in sets], pa.list_(pa.string() if at is None else pa.int32()))], ["l_id", "f"])

    return sample.select("l_id", "text").mapInArrow(run, f"l_id {kind}, f array<{'string' if at is None else 'int'}>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, inputs: int = 3000, least_docs: int = 4) -> ToxicityModel:
    """Fit on a bounded sample. Texts stay with the executors: the driver reads the votes of the sample's rows, the names of
    at most `inputs` features and which of them each row has, so its memory is bounded whatever the texts are.

    Without any vote for toxic, all scores are the prior of 0.005.
    """
    small_batches(docs.sparkSession)
    sample, stands_for = sample_rows(docs, labels, id_col, text_col, label_col, per_class)
    rows = sorted(read_votes(sample).collect(), key=lambda r: r["l_id"])
    at = {r["l_id"]: i for i, r in enumerate(rows)}
    votes = np.zeros((len(rows), len(VOTERS)))
    for i, r in enumerate(rows):
        votes[i, r["fired"]] = 1
    gold = np.array([r["y"] for r in rows])
    mass = np.array([stands_for[r["y"]] for r in rows])
    used = np.flatnonzero(votes.any(axis=0)) if len(rows) else np.zeros(0, dtype=int)
    if not (SPEAKS_FOR[used] == 1).any():
        return ToxicityModel({}, math.log(0.005 / 0.995))
    q = fit_label_model(votes[:, used], gold, SPEAKS_FOR[used], mass).posterior(votes[:, used], gold)

    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    share = stash(spark.createDataFrame([(r["l_id"], float(q[i])) for i, r in enumerate(rows)], f"q_id {kind}, q double"), "toxicity-posterior")
    named = feature_rows(sample).join(F.broadcast(share), F.col("l_id") == F.col("q_id")).select(F.explode("f").alias("f"), "q")
    counts = named.groupBy("f").agg(F.sum("q").alias("a"), F.sum(1 - F.col("q")).alias("b")).filter(F.col("a") >= least_docs)
    n1, n0 = float(q.sum()), float((1 - q).sum())
    # the best by the ratio of rates first, so that the driver reads a bounded number
    ratio = (F.col("a") / n1) / ((F.col("b") + 0.5) / max(n0, 1e-9))
    top = counts.orderBy(F.desc(F.round(F.col("a") * F.log(ratio), 6)), "f").limit(4 * inputs).collect()
    names = best_features([(r["f"], r["a"], r["b"]) for r in top], n1, n0, inputs)
    if not names:
        return ToxicityModel({}, math.log(0.005 / 0.995))
    x = np.zeros((len(rows), len(names)), dtype=np.float32)
    for r in feature_rows(sample, names).collect():
        x[at[r["l_id"]], r["f"]] = 1
    w, b = fit_linear(x, q, mass)
    return ToxicityModel({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-3}, b)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; whole texts, null ones as empty; rows are independent of each other."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                words = distinct_words(text)
                if len(memo) > WORD_MEMO:
                    memo.clear()
                for w in words.difference(memo):
                    memo[w] = tuple(f for f in word_features(w) if f in weights)
                found = {f for t in filter(None, map(memo.__getitem__, words)) for f in t}
                margin = bias + sum(map(weights.__getitem__, sorted(found)))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`.

    The model is fitted on at most `per_class` toxic, `per_class` clean and a third as many unlabelled rows whose crc32(id
    as text) mod 5 is not 0. Null ids are scored and held out; null labels and labels of absent documents are left out;
    with an empty `labels` the label model rests on its voters alone. Null texts read as empty ones, which get the
    classifier's bias as any text without features. Repeated rows get equal scores; other columns are ignored, whatever
    their names; empty input gives no rows.
    """
    scored = score_documents(docs, train(docs, labels, id_col, text_col, label_col, per_class), id_col, text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir):
    from .common import table

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Benchmark decontamination with a generalised suffix automaton of the items' words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash, tidy

#: Every byte that is not part of a word becomes a blank; A-Z become a-z. Bytes from 0x80 on are parts of words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD_SPANS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Item words in one automaton; a larger benchmark is matched in several blocks.
BLOCK_WORDS = 500_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Automaton:
    """Suffix automaton of many word sequences, with the items that hold a state's words.

    step() keeps (state, length): the longest suffix of the words read that occurs in any item.
    """

    window: int
    vocab: dict[bytes, int] = field(default_factory=dict)
    nexts: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[set[str]] = field(default_factory=lambda: [set()])
    wholes: list[list[tuple[int, str]]] = field(default_factory=lambda: [[]])
    shortest: int = 1 << 30

    def _new(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.nexts.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.wholes.append([])
        return len(self.nexts) - 1

    def _extend(self, last: int, word: int) -> int:
        if (q := self.nexts[last].get(word)) is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, word, q)
        new = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.nexts[at]:
            self.nexts[at][word] = new
            at = self.link[at]
        if at >= 0:
            q = self.nexts[at][word]
            self.link[new] = q if self.length[q] == self.length[at] + 1 else self._split(at, word, q)
        return new

    def _split(self, at: int, word: int, q: int) -> int:
        twin = self._new(self.length[at] + 1, dict(self.nexts[q]), self.link[q])
        self.link[q] = twin
        while at >= 0 and self.nexts[at].get(word) == q:
            self.nexts[at][word] = twin
            at = self.link[at]
        return twin

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]], window: int) -> Automaton:
        self = cls(window)
        held = []
        for _, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            held.append(ids)
            last = 0
            for w in ids:
                last = self._extend(last, w)
        for (name, _), ids in zip(items, held, strict=True):
            if not ids:
                continue
            self.shortest = min(self.shortest, len(ids), window)
            state = n = 0
            for w in ids:
                state, n = self.step(state, n, w)
                if n >= window:
                    self.items[self._at(state, window)].add(name)
            self.wholes[state].append((len(ids), name))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.wholes[state] = self.wholes[state] + self.wholes[self.link[state]]
        return self

    def _at(self, state: int, n: int) -> int:
        """The state of the last n words of a match in `state`."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def step(self, state: int, n: int, word: int) -> tuple[int, int]:
        while word not in self.nexts[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            n = self.length[state]
        return self.nexts[state][word], n + 1

    def hits(self, words: list[bytes], whole: list[tuple[int, int]] | None = None) -> tuple[np.ndarray | None, set[str]]:
        """Which words are inside an occurrence of a window (None: none are), and the items with such windows.

        The spans of complete items, whatever their length, are added to `whole`."""
        ids = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), dtype=np.int32, count=len(words))
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False].astype(np.int8)))
        marks, found = None, set()
        for i, j in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if j - i < self.shortest:
                continue
            state = n = 0
            for k, w in enumerate(ids[i:j].tolist(), i):
                state, n = self.step(state, n, w)
                if n >= self.window:
                    if marks is None:
                        marks = np.zeros(len(words), dtype=bool)
                    marks[k + 1 - self.window : k + 1] = True
                    found |= self.items[self._at(state, self.window)]
                for m, name in self.wholes[state]:
                    if m <= n:
                        if whole is not None:
                            whole.append((k + 1 - m, k + 1))
                        if m >= self.window:
                            continue
                        if marks is None:
                            marks = np.zeros(len(words), dtype=bool)
                        marks[k + 1 - m : k + 1] = True
                        found.add(name)
        return marks, found


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, in blocks of at most about `block_words` words; the driver holds one block at a time."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    block, n = [], 0
    for r in rows.toLocalIterator():
        words = words_of(r["t"])
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((r["i"], words))
        n += len(words)
    if block:
        yield block


def unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` in a struct `row`, with n_words, n_hit, marks (a bit a word: inside a window), items and whole (a bit a word:
    inside a complete item).

    A window is `window` consecutive words of an item, or all words of a shorter one. Null or empty texts have no
    words; items without words match nothing; a null item id reads as an empty string. Rows are independent, so
    repeated rows get equal results. Texts are streamed once a block of items; the driver and an automaton hold one
    block, whose size is bounded, so the benchmark may be of any size; with several blocks, what is found so far is
    written between them. Empty input gives no rows; without items nothing is hit. The columns of `docs` may have any names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = docs.columns
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("binary").alias("marks"), F.array().cast("array<string>").alias("items"), F.lit(None).cast("binary").alias("whole")
    )
    at = names.index(text_col)
    for k, block in enumerate(benchmark_blocks(benchmark, item_id, item_text, block_words)):
        if k:
            out = stash(out, "benchmark-block")
        shared = spark.sparkContext.broadcast(block)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = Automaton.build(shared.value, window)
            for batch in batches:
                texts = batch.column(0).field(at).to_pylist()
                counts, sums, marks, items, wholes = [], [], [], [], []
                for text, old, had, old_whole in zip(texts, *(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True):
                    words, spans = words_of(text), []
                    hit, found = automaton.hits(words, spans)
                    if old is not None:
                        before = unpacked(old, len(words))
                        hit = before if hit is None else hit | before
                    whole = None if old_whole is None else unpacked(old_whole, len(words))
                    if spans and whole is None:
                        whole = np.zeros(len(words), dtype=bool)
                    for i, j in spans:
                        whole[i:j] = True
                    wholes.append(None if whole is None else np.packbits(whole).tobytes())
                    counts.append(len(words))
                    sums.append(0 if hit is None else int(hit.sum()))
                    marks.append(None if hit is None else np.packbits(hit).tobytes())
                    items.append(sorted(found.union(had)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(wholes, pa.binary())], ["row", "n_words", "n_hit", "marks", "items", "whole"])

        out = out.mapInArrow(run, out.schema)
    if benchmark.isEmpty():
        out = out.mapInArrow(counted_words(at), out.schema)
    return out


def counted_words(at: int):
    """Fills n_words of rows that no item was matched with."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array([len(words_of(t)) for t in batch.column(0).field(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *batch.columns[2:]], batch.schema.names)

    return run


def runs_of(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def cleaned(text: str, marks: np.ndarray, min_span: int, whole: np.ndarray | None = None) -> str:
    """`text` without the runs of marked words that are at least `min_span` words long, and without the words of `whole`."""
    spans = list(WORD_SPANS.finditer(text))
    cut = np.zeros(len(marks), dtype=bool) if whole is None else whole.copy()
    for i, j in runs_of(marks):
        cut[i:j] |= j - i >= min_span
    out, at = [], 0
    for i, j in runs_of(cut):
        out.append(text[at : spans[i].start()])
        at = spans[j - 1].end()
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, min_span: int = 10, max_coverage: float = 0.5, **options) -> DataFrame:
    """
    `docs` without benchmark passages: complete items, however short, and runs of at least `min_span` hit words are
    cut out of the text; documents of which more than `max_coverage` is hit go as a whole. Texts without hits stay as they are, null and empty ones too. Rows are independent, so repeated ones
    fare alike; empty input gives no rows; without items all rows stay. Other columns may have any names.
    """
    matched = match_benchmark(docs, benchmark, text_col, window=window, **options)
    at = docs.columns.index(text_col)
    schema = docs.schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keep, texts = batch.column(0), [], []
            for text, n, packed, whole in zip(row.field(at).to_pylist(), *(batch.column(c).to_pylist() for c in (1, 3, 5)), strict=True):
                if packed is None:
                    keep.append(True)
                else:
                    marks = unpacked(packed, n)
                    keep.append(bool(marks.sum() <= max_coverage * n))
                    text = cleaned(text, marks, min_span, None if whole is None else unpacked(whole, n))
                texts.append(text)
            columns = [pa.array(texts, row.field(i).type) if i == at else row.field(i) for i in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(keep))

    return matched.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of `docs`."""
    return match_benchmark(docs.select("doc_id", "text"), benchmark, **options).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH norm AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, w[i:i + n - 1] AS g
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM norm, sizes WHERE len(w) >= n)),
found AS (SELECT s.doc_id, s.i, s.n, x.item FROM spots s JOIN windows x ON s.n = x.n AND s.g = x.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT norm.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN hit ON norm.doc_id = hit.doc_id LEFT JOIN held ON norm.doc_id = held.doc_id
"""


def op3_decontaminate(spark, sf_dir):
    from .common import table

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Token counts by rank-synchronous merging of ragged numpy arrays, and pre-tokens shared with the encoder."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: The split pattern of byte-level BPE, its printable bytes, and the pre-tokens a worker remembers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
MEMO = 400_000
NONE = np.iinfo(np.int64).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    rest = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(rest)) for b in range(256)]


class Splitter:
    """Texts to pre-tokens; special strings are taken out first, as the library does by default."""

    def __init__(self, specials: dict[str, int]):
        self.specials = specials
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")").split if specials else None
        self.marks = tuple(specials)

    def __call__(self, text: str) -> list[str]:
        if not any(m in text for m in self.marks):
            return self.find(text)
        out: list[str] = []
        for piece in self.cut(text):
            out += [piece] if piece in self.specials else self.find(piece)
        return out


class RankMerger:
    """Counts the symbols that byte-level BPE leaves of many pre-tokens at once."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.base, self.keys, self.ranks = base, keys[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.first = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)

    def counts(self, tokens: list[str]) -> np.ndarray:
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        ids = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        done = lengths.copy()
        while len(ids) > 1:
            same = owner[1:] == owner[:-1]
            key = ids[:-1] * self.base + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(np.r_[rank, NONE], starts)
            live = low != NONE
            if not live.any():
                break
            sizes = np.diff(np.r_[starts, len(ids)])
            spread = np.repeat(low, sizes)
            hit = (rank == spread[:-1]) & (rank != NONE)
            where = np.flatnonzero(hit)
            new_run = np.r_[True, np.diff(where) != 1]
            run_start = np.maximum.accumulate(np.where(new_run, where, 0))
            where = where[(where - run_start) % 2 == 0]  # of overlapping equal pairs every other one, from the left
            ids[where] = self.result[rank[where]]
            keep = np.ones(len(ids), dtype=bool)
            keep[where + 1] = False
            keep &= np.repeat(live, sizes)  # sequences without a pair to merge are done
            np.subtract.at(done, owner[where], 1)
            ids, owner = ids[keep], owner[keep]
        return done


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Splitter, RankMerger]:
    spec = json.load(open(path, encoding="utf-8"))
    specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return Splitter(specials), RankMerger(spec["model"]["vocab"], spec["model"]["merges"])


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their token counts, with a bounded memo of pre-tokens."""
    split, merger = load(path)
    memo: dict[str, int] = dict.fromkeys(split.specials, 1)

    def count(texts: list[str]) -> list[int]:
        parts = [split(t) for t in texts]
        fresh = list({p for part in parts for p in part}.difference(memo))
        if len(memo) + len(fresh) > MEMO:
            memo.clear()
            memo.update(dict.fromkeys(split.specials, 1))
            fresh = list({p for part in parts for p in part}.difference(memo))
        for i in range(0, len(fresh), 50_000):
            some = fresh[i : i + 50_000]
            memo.update(zip(some, merger.counts(some).tolist(), strict=True))
        return [sum(map(memo.__getitem__, part)) for part in parts]

    return count


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs`.

    Null texts count as empty: 0 bytes, 0 tokens. Rows are independent: nulls in the id, repeated rows and other
    columns change nothing; empty input gives no rows. The vocabulary file must be at `path` on every executor.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = count(texts)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir):
    from .common import table

    return token_counts(table(spark, sf_dir, "documents"))

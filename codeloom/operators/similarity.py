"""Shape hashes of code and joins of hashes by their Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _checkpoint, components

#: What a shape token is, comments first; and the constants of FNV-1a with 64 bits.
COMMENT = r"//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\z)"
QUOTED = "|".join(rf"{q}[^{q}\\]*(?:\\.[^{q}\\]*)*(?:{q}|\\?\z)" for q in "\"'`")
NAME, NUMBER, OTHER = r"[A-Za-z_$][A-Za-z0-9_$]*", r"[0-9][0-9._xX]*", r"[^ \t\n\r]"
SHAPE = f"(?s)(?:{'|'.join((COMMENT, QUOTED, NAME, NUMBER, OTHER))})"
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Distinct grams whose votes a task keeps, and rows that it works on at a time.
MEMO, SOME = 50_000, 64
#: Values of a block in which all are compared with all of another, and tasks at most.
BLOCK, MOST_TASKS = 8192, 10_000


def shape_tokens(body: Column) -> Column:
    """Kinds of the tokens: names, numbers and strings folded, other characters kept, comments left out."""
    # possessive repeats: the matcher would need stack for each character of long strings otherwise
    found = F.regexp_extract_all(body, F.lit(SHAPE.replace("*(?:\\\\.", "*+(?:\\\\.").replace("]*)*", "]*+)*+")), F.lit(0))
    code = F.filter(found, lambda t: ~(t.startswith("//") | t.startswith("#") | t.startswith("/*")))
    kind = lambda t: F.when(t.rlike(r"^[\"'`]"), "STRING").when(t.rlike("^[A-Za-z_$]"), "NAME").when(t.rlike("^[0-9]"), "NUMBER").otherwise(F.concat(F.lit("OP:"), t))
    return F.transform(code, kind)


def fnv64(text: str) -> int:
    """FNV-1a over the low byte of each character."""
    h = FNV_START
    for c in text:
        h = (h ^ (ord(c) & 0xFF)) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def _votes(kinds: pa.ListArray, least: int, n: int, bits: dict[str, np.ndarray]) -> np.ndarray:
    """(hash, known) of lists of tokens, in whole-array steps: grams are numbers made of the numbers of their tokens, counted
    once a list; each distinct gram is hashed once, and `bits` keeps its 64 votes."""
    edges = kinds.offsets.to_numpy().astype(np.int64)
    coded = kinds.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    base, lengths = max(len(names), 1), np.diff(edges)
    fine = lengths >= max(least, n)
    # the first token of each gram, by list
    count = np.where(fine, lengths - n + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(edges[:-1] - edges[0], count)
    grams = np.zeros(len(first), dtype=np.int64)
    for k in range(n):
        grams = grams * base + codes[first + k]
    distinct, gram = np.unique(grams, return_inverse=True)
    pairs, times = np.unique(owner * max(len(distinct), 1) + gram, return_counts=True)
    owner, gram = pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)
    votes = np.zeros((max(len(distinct), 1), 64))
    for i, g in enumerate(distinct.tolist()):
        parts = []
        for _ in range(n):
            parts.append(names[g % base])
            g //= base
        text = "|".join(reversed(parts))
        if text not in bits:
            bits[text] = np.unpackbits(np.array([fnv64(text)], dtype="<u8").view(np.uint8), bitorder="little").astype(float) * 2 - 1
        votes[i] = bits[text]
    out = np.zeros(len(lengths), dtype=np.uint64)
    for b in range(64):
        total = np.bincount(owner, weights=times * votes[gram, b], minlength=len(lengths))
        out |= (total > 0).astype(np.uint64) << np.uint64(b)
    return out.view(np.int64), fine


def with_shape_hash(rows: DataFrame, body: str, name: str = "hash", least: int = 8, n: int = 3) -> DataFrame:
    """`rows` with a 64-bit SimHash, a signed long, over n-grams of shape tokens of the column `body`, which goes; null for
    fewer than `least` tokens and for null bodies."""
    rest = [c for c in rows.columns if c != body]
    tokens = rows.select(*[F.col(f"`{c}`") for c in rest], shape_tokens(F.col(f"`{body}`")).alias("_kinds"))
    schema = type(rows.schema)([rows.schema[c] for c in rest]).add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SOME):
                part = batch.slice(at, SOME)
                kinds = pa.array(part.column(len(rest)), pa.list_(pa.string()))
                known = np.array(kinds.is_valid())
                hashes, fine = _votes(kinds.fill_null(pa.scalar([], pa.list_(pa.string()))) if kinds.null_count else kinds, least, n, bits)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hashes, pa.int64(), mask=~(fine & known))], schema.names)
                if len(bits) > MEMO:
                    bits.clear()

    return tokens.mapInArrow(run, schema)


def block_choice(values: int, most: int) -> int:
    """Into how many blocks to cut the bits of so many values: what makes fewest copies and chance candidates."""

    def cost(blocks: int) -> float:
        copies, bits = comb(blocks, most), 64 * (blocks - most) / blocks
        return copies * values + copies * values * values / 2 ** (bits + 1)

    return min(range(most + 1, most + 7), key=cost)


def hamming_pairs(hashes: DataFrame, most: int = 6, blocks: int | None = None) -> DataFrame:
    """(a, b, distance), a < b: distinct values of `hash` at most `most` bits apart.

    Values that differ in at most `most` bits agree on at least blocks - most of the blocks that their bits are cut
    into, so values meet by every choice of so many blocks; no pair is lost. More values are cut into more blocks, so that
    chance meetings stay fewer than copies. Only distinct values take part: copies belong to their value and are never
    paired. A pair is made by the first choice that brings it together, so no pair is made twice.
    """
    values = hashes.select("hash").filter("hash IS NOT NULL").distinct()
    if blocks is None:
        values = _checkpoint(values)
        blocks = block_choice(values.count(), most)
    if not 0 <= most < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    at = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (at[i + 1] - at[i])) - 1) << at[i] for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    choices = list(combinations(range(blocks), blocks - most))
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("hash").bitwiseAND(F.lit(signed(sum(masks[i] for i in some)))).alias("bits")) for k, some in enumerate(choices)])
    rows = values.select("hash", F.explode(keys).alias("key")).select("hash", "key.choice", "key.bits")
    a, b = rows.withColumnRenamed("hash", "a"), rows.withColumnRenamed("hash", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pairs = a.join(b, ["choice", "bits"]).filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= most))
    # the first choice of equal blocks, in the order of combinations, is made of the first blocks that agree
    agree = F.filter(F.array(*[F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)]), lambda x: x.isNotNull())
    first = F.create_map(*[F.lit(x) for k, some in enumerate(choices) for x in (",".join(map(str, some)), k)]) if len(choices) <= 1000 else None
    if first is None:
        return pairs.select("a", "b", F.bit_count(differ).cast("int").alias("distance")).distinct()
    lead = F.array_join(F.slice(agree, 1, blocks - most), ",")
    return pairs.filter(first[lead] == F.col("choice")).select("a", "b", F.bit_count(differ).cast("int").alias("distance"))


def forest(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, places of their parents): a spanning forest of the links between values at most `most` bits apart. Values
    that have been reached leave, so those that are alike are compared with few others."""
    rest, left, front = np.arange(len(values)), values, np.zeros(0, dtype=np.int64)
    children, parents = [front], [front]
    while len(rest):
        if not len(front):
            front, rest, left = rest[:1], rest[1:], left[1:]
        some, front = front[:SOME], front[SOME:]
        near = np.bitwise_count(values[some][:, None] ^ left[None, :]) <= most
        hit = near.any(axis=0)
        if hit.any():
            children.append(rest[hit])
            parents.append(some[near[:, hit].argmax(axis=0)])
            front = np.concatenate([front, rest[hit]])
            rest, left = rest[~hit], left[~hit]
    return np.concatenate(children), np.concatenate(parents)


def value_links(values: DataFrame, most: int = 6, size: int = BLOCK) -> DataFrame:
    """(src, dst): links between distinct values (id) at most `most` bits apart, as many as connect what all of them do.

    Values are dealt to blocks of about `size`; each two blocks are compared in one task, which holds no more than
    them and returns a forest of their links. All values are compared, their pairs are never rows.
    """
    blocks = values.count() // size + 1
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = values.select("id", own.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    rows = rows.filter("b <> o") if blocks > 1 else rows  # two blocks have the links within each
    rows = rows.select("id", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).repartition(min(MOST_TASKS, blocks * (blocks + 1) // 2), "i", "j")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        child, parent = forest(ids.view(np.uint64), most)
        return pa.table({"src": pa.array(ids[child], pa.int64()), "dst": pa.array(ids[parent], pa.int64())})

    return rows.groupBy("i", "j").applyInArrow(run, "src long, dst long")


def duplicate_clusters(hashes: DataFrame, most: int = 6) -> DataFrame:
    """(id, cluster) of the rows (id, hash) that share a cluster with another: values linked by steps of at most `most` bits.

    A cluster is named by its smallest id. Hashes are written once, as each step would make them from the texts again.
    """
    known = _checkpoint(hashes.filter("hash IS NOT NULL"))
    values = _checkpoint(known.select(F.col("hash").alias("id")).distinct())
    linked = components(values, value_links(values, most))
    rows = known.join(linked.withColumnRenamed("id", "hash"), "hash")
    names = rows.groupBy("component").agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    return rows.join(names, "component").select("id", "cluster", "members")

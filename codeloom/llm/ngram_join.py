"""N-gram Jaccard join by a blocked product of the document by n-gram incidence matrix.

Rows of the matrix are documents with distinct sets of n-grams, columns are n-grams (64-bit hashes). Columns have one
order for all rows: those that rounds of counting found in several prefixes last, the others by how often the slots
that they hash to are filled in the whole corpus, then by hash. Of two rows
that meet the Jaccard bound, the prefixes of n - ceil(pct * n / 100) + 1 columns share one. So the product is formed
column by column over the prefixes only, where common passages come last, and products of rows that cannot reach the
bound by their sizes and the places of a shared column are discarded. Columns that one prefix alone holds are never
written: a map of bits, filled by a count of all of them, tells the rest (and few more, which a second count drops).
Pairs that share a column by chance grow faster than the corpus. So each set has a parity map, a bit of it for each
slot that an odd number of its columns hash to: two maps differ in at most as many bits as the sets differ in columns,
so pairs whose maps differ in more than the bound allows are discarded without their texts. Overlaps of the others are
counted in full.

Many rows may share a column. One of them, the row that shares most columns with others, leads: its overlaps with all
of them are counted first. Where the others do not all link to one group, all pairs of a column of few rows are
formed, and held against the parity maps before any is written. Columns that the same rows share are one for this; and
at first a row writes one pair only, with the first of those rows that it may link to, so that a group of near copies
without the leader costs in proportion to its rows, too. The pairs that these links have not brought together come
next. In a column of many rows, the overlap of two of them, x and y, follows
from their differences from the leader, dx and dy: x and y differ in |dx| + |dy| - 2 |dx & dy| n-grams. If that meets
the bound without a common difference, both meet it with the leader too; else they share at least one n-gram of a
prefix of their differences, and only such pairs, of rows that links have not yet brought together, are counted. So a
group of thousands of copies with edits of their own costs in proportion to its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, tidy, whole_ids
from .common import stash_alone as stash

#: Stands for a null id; sorts after all others.
NO_ID = (1 << 63) - 1
#: Tables of ids of at most so many rows may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000
#: White space, a random number for each other byte, and powers of an odd number: words hash as polynomials.
IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTE = np.where(IS_BLANK, 0, np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 64, 256, dtype=np.uint64))
ODD = 0x9E3779B97F4A7C15
U = np.uint64
#: Columns hash to so many slots, whose counts are made in chunks; so many partial counts are added up at a time.
SLOT_BITS, CHUNK_BITS, ADDED = 20, 14, 256
#: Columns known to be shared are marked in a map of a bit for each column of a prefix, within these powers of two, made
#: in chunks; in so many rounds.
MARK_BITS, MOST_MARK_BITS, MARKED_BITS, ROUNDS = 26, 29, 16, 2
#: Columns of at most so many rows have all their pairs formed where the leader's do not settle them.
FEW = 1024
#: Parity maps have so many bits at least; rows are paired by maps folded to so many at most, so many rows or bytes of
#: maps at a time.
FOLD_BITS, MOST_FOLD_BITS, PAIRED, PAIRED_BYTES = 512, 1 << 13, 1 << 15, 8 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[U(1), np.full(n - 1, ODD, dtype=U)], dtype=U)


def gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles; fewer words than n make one shingle,
    no words an empty set. Bytes, words and shingles of all texts are hashed in whole-array steps."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    blank = IS_BLANK[data]
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(starts):
        return [np.zeros(0, dtype=U) for _ in raw]
    stops = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    lengths = stops - starts
    spots = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.r_[starts, len(data)])) if starts[0] == 0 else None
    if spots is None:
        spots = np.arange(len(data), dtype=np.int32) - np.repeat(np.r_[0, starts].astype(np.int32), np.diff(np.r_[0, starts, len(data)]))
    longest = 1 << int(lengths.max()).bit_length()
    spots[blank] = 0
    h = mix(np.add.reduceat(BYTE[data] * powers(longest)[np.minimum(spots, longest - 1)], starts) + lengths.astype(U))
    bounds = np.searchsorted(starts, np.r_[0, ends])
    m = max(0, len(h) - n + 1)
    grams = np.zeros(m, dtype=U)
    for k in range(n):
        grams = mix(grams * U(ODD) + h[k : k + m] + U(k + 1))
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j - i >= n:
            out.append(np.unique(grams[i : j - n + 1]))
        elif j == i:
            out.append(np.zeros(0, dtype=U))
        else:  # the whole sequence, told apart from longer shingles by the number of its words
            one = np.full(1, j - i, dtype=U)
            for k in range(i, j):
                one = mix(one * U(ODD) + h[k : k + 1] + U(1 << 32))
            out.append(one)
    return out


def pieces(batch: pa.RecordBatch, column: int, size: int = 1 << 19) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of slices of a batch with at most about `size` characters each."""
    texts, at, n = batch.column(column).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= size or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, n = i + 1, 0


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> U(64 - SLOT_BITS)).astype(np.int64)


def marked_in(marks: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """1 where the bit of a map that a column hashes to is set, else 0."""
    bit = (grams >> U(64 - (len(marks) * 8).bit_length() + 1)).astype(np.int64)
    return (marks[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1


def prefix_keys(grams: np.ndarray, pct: int, levels: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The columns of a set that come first in the order of all columns, as many as its size and the bound ask for:
    unmarked columns before marked ones, of these those of rarely filled slots first."""
    n = len(grams)
    if not n:
        return grams
    order = np.argsort(levels[slots(grams)].astype(np.uint16) + marked_in(marks, grams).astype(np.uint16) * 256, kind="stable")
    return grams[order[: n - -(-pct * n // 100) + 1]]


def set_sums(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return int(mix(grams).sum(dtype=U).view(np.int64)), int(np.bitwise_xor.reduce(mix(grams ^ U(0x5851F42D4C957F2D))).view(np.int64)) if len(grams) else 0


def parity_map(grams: np.ndarray) -> bytes:
    """As many bits as the set has columns, up to a power of two (FOLD_BITS at least), each set if an odd number of
    columns has its number as their last bits. A map folds to half its size by the exclusive or of its halves."""
    m = max(FOLD_BITS, 1 << (len(grams) - 1).bit_length()) if len(grams) else FOLD_BITS
    return np.packbits((np.bincount((grams & U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Of the parity maps of two sets: the number of columns in which the sets differ at least."""
    if len(x) < len(y):
        x, y = y, x
    u, size = int.from_bytes(x, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        u = (u >> size) ^ (u & ((1 << size) - 1))
    return (u ^ int.from_bytes(y, "little")).bit_count()


def document_sets(rows: DataFrame, n: int) -> DataFrame:
    """(id, s1, s2, n_shingles, parity) of rows (id, text); and, with part, chunk and counts set instead, each task's
    counts of filled slots, a chunk of slots a row."""
    names = ["id", "s1", "s2", "n_shingles", "parity", "part", "chunk", "counts"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            sums = []
            for _, some in pieces(batch, 1):
                sets = gram_sets(some, n)
                counts += np.bincount(slots(np.concatenate(sets)), minlength=len(counts))
                sums += [(*set_sums(s), len(s), parity_map(s)) for s in sets]
            cols = [batch.column(0), *(pa.array([s[k] for s in sums], kinds[k + 1]) for k in range(4))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(sums), k) for k in kinds[5:])], names)
        chunks = counts.astype("<i8").reshape(-1, 1 << CHUNK_BITS)
        part = TaskContext.get().partitionId()
        cols = [pa.nulls(len(chunks), k) for k in kinds[:5]]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(chunks), kinds[5]), pa.array(range(len(chunks)), kinds[6]), pa.array([c.tobytes() for c in chunks], kinds[7])], names)

    return rows.mapInArrow(run, "id long, s1 long, s2 long, n_shingles long, parity binary, part int, chunk int, counts binary")


def slot_levels(partial: DataFrame) -> np.ndarray:
    """A byte for each slot that grows with the logarithm of its count, from rows (part, chunk, counts) of all tasks.

    Counts are added up in groups of at most ADDED rows, so no group grows with the input; the driver reads one count
    a slot.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, "<i8") for c in table.column("counts").to_pylist())
        first = table.slice(0, 1)
        return pa.table({"part": pa.array([first.column("part")[0].as_py() // ADDED], pa.int32()), "chunk": first.column("chunk").cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        partial = stash(partial.groupBy("chunk", F.floor(F.col("part") / ADDED).alias("some")).applyInArrow(add, "part int, chunk int, counts binary"), "slot-counts")
        parts = -(-parts // ADDED)
    counts = np.zeros((1 << SLOT_BITS - CHUNK_BITS, 1 << CHUNK_BITS))
    for r in partial.select("chunk", "counts").collect():
        counts[r["chunk"]] = np.frombuffer(r["counts"], "<i8")
    return np.minimum(np.log2(counts.ravel() + 1) * 8, 255).astype(np.uint8)


def marked_rows(rows: DataFrame, n: int) -> DataFrame:
    """`rows`, which have a column text, with the set's s1, s2 and n_shingles."""
    schema, at = type(rows.schema)([*rows.schema.fields]), rows.columns.index("text")
    for name in ("s1", "s2", "n_shingles"):
        schema = schema.add(name, "long")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [g for _, some in pieces(batch, at) for g in gram_sets(some, n)]
            sums = [(*set_sums(s), len(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([s[k] for s in sums], pa.int64()) for k in range(3))], schema.names)

    return rows.mapInArrow(run, schema)


def document_keys(rows: DataFrame, n: int, pct: int, levels: np.ndarray, marks: np.ndarray, held: np.ndarray | None = None) -> DataFrame:
    """(key, id, pos, size): the prefix columns of rows (id, text), their places in the prefix, and the set's size; of
    columns that the map `held` marks, if it is given."""
    shared = rows.sparkSession.sparkContext.broadcast((levels.tobytes(), marks.tobytes(), None if held is None else held.tobytes()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, marks, held = (x if x is None else np.frombuffer(x, np.uint8) for x in shared.value)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, some in pieces(batch, 1):
                sets = gram_sets(some, n)
                keys = [prefix_keys(g, pct, levels, marks).view(np.int64) for g in sets]
                k = np.array([len(x) for x in keys])
                spots = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                cols = [np.concatenate(keys), np.repeat(ids[at : at + len(some)], k), spots, np.repeat([len(g) for g in sets], k)]
                if held is not None:
                    wanted = marked_in(held, cols[0].view(U)).astype(bool)
                    cols = [c[wanted] for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "id", "pos", "size"])

    return rows.mapInArrow(run, "key long, id long, pos int, size int")


def mark_bits(sets: DataFrame, pct: int) -> int:
    """The power of two of a map that has a bit for each column of the prefixes of `sets`, as far as it may grow."""
    n = F.col("n_shingles")
    columns = sets.agg(F.sum(n - F.ceil(pct * n / 100) + 1)).first()[0] or 0
    return min(max(MARK_BITS, int(columns).bit_length()), MOST_MARK_BITS)


def repeated_columns(rows: DataFrame, n: int, pct: int, levels: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A map of bits, of the size of `marks`, in which columns that are in several of the prefixes are marked."""
    bits = (len(marks) * 8).bit_length() - 1
    chunk = F.shiftright("bit", MARKED_BITS)

    def pack(table: pa.Table) -> pa.Table:
        found = table.column("bit").to_numpy()
        image = np.zeros(1 << MARKED_BITS, dtype=np.uint8)
        image[found & ((1 << MARKED_BITS) - 1)] = 1
        return pa.table({"chunk": pa.array([int(found[0]) >> MARKED_BITS], pa.int32()), "image": pa.array([np.packbits(image, bitorder="little").tobytes()], pa.binary())})

    often = document_keys(rows, n, pct, levels, marks).groupBy("key").count().filter("count > 1")
    found = often.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("bit")).distinct()
    images = stash(found.groupBy(chunk.alias("c")).applyInArrow(pack, "chunk int, image binary"), "marks")
    out, size = np.zeros(len(marks), dtype=np.uint8), 1 << MARKED_BITS - 3
    for r in images.collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["image"], np.uint8)
    discard(images)
    return out


def marked_columns(rows: DataFrame, n: int, pct: int, levels: np.ndarray, bits: int = MARK_BITS) -> np.ndarray:
    """A map of 2^bits bits in which columns that are in several prefixes are marked, so that they come last in the order.

    Each round counts the columns of the prefixes that the marks so far give. Marks change the order for all rows alike,
    so any are right; the fewer prefixes share a column without being near copies, the less is compared.
    """
    marks = np.zeros(1 << bits - 3, dtype=np.uint8)
    for _ in range(ROUNDS):
        marks |= repeated_columns(rows, n, pct, levels, marks)
    return marks


def slack(x: int, y: int, pct: int) -> int:
    """The most n-grams in which sets of these sizes may differ and still meet the bound."""
    return (x + y) * (100 - pct) // (100 + pct)


def within_reach(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Those of the pairs (a, b) that may meet the bound by the sizes and parity maps of their `sets`."""
    x, y = (sets.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("parity").alias(f"parity_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)
            near = pa.array([least_apart(p, q) <= slack(m, n, pct) for m, n, p, q in maps], pa.bool_())
            yield batch.select([0, 1]).filter(near)

    joined = pairs.join(x, "a").join(y, "b")
    return joined.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long")


def counted(pairs: DataFrame, texts: DataFrame, n: int, pct: int) -> DataFrame:
    """(a, b, linked) of the pairs (a, b, more): whether 100 * overlap >= pct * union. Where `more` is set, further rows
    have (gram, size, off, pos, near): the prefix of its differences from a, n-grams that a lacks first, each
    with b's size, the number of differences, its place among them, and whether it is in the prefix that suffices for partners that differ
    from a as much or more."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    names = ["a", "b", "linked", "gram", "size", "off", "pos", "near"]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(k).to_pylist() for k in (0, 1)]
            left: dict[int, np.ndarray] = {}
            leads = batch.column(2).to_pylist()
            for a, text in zip(ids[0], leads, strict=True):
                if a not in left:
                    left[a] = gram_sets([text], n)[0]
            del leads
            heads, tails = [], []
            more = batch.column(4).to_pylist()
            for at, some in pieces(batch, 3):
                for k, y in enumerate(gram_sets(some, n), at):
                    a, b = ids[0][k], ids[1][k]
                    x = left[a]
                    added, removed = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                    off = len(added) + len(removed)
                    linked = off <= slack(len(x), len(y), pct)
                    heads.append((a, b, linked, len(y), off))
                    if more[k]:
                        most = slack(len(y), len(y) * 100 // pct, pct)
                        prefix = np.concatenate((added, removed))[: most + 1].view(np.int64)
                        tails.append((a, b, linked, prefix, len(y), off, most // 2 + 1))
            nothing = pa.nulls(len(heads))
            cols = list(zip(*heads, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((cols[0], cols[1], cols[2], nothing, cols[3], cols[4], nothing, nothing), kinds, strict=True)], names) if heads else empty
            if tails:
                m = np.array([len(t[3]) for t in tails])
                pos = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                a, b, linked, size, off, near = (np.repeat(np.array([t[k] for t in tails]), m) for k in (0, 1, 2, 4, 5, 6))
                grams = np.concatenate([t[3] for t in tails])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((a, b, linked, grams, size.astype(np.int32), off.astype(np.int32), pos.astype(np.int32), pos < near), kinds, strict=True)], names)

    return joined.select("a", "b", "text_a", "text_b", "more").mapInArrow(run, "a long, b long, linked boolean, gram long, size int, off int, pos int, near boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): the smallest node reachable. Labels are hooked and shortened in turn,
    each round written to the shared folder; sums per node are made before shuffling."""
    sym = stash(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "links")
    lab = stash(sym.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).select("node", F.least("node", "label").alias("label"), F.lit(None).cast("long").alias("old")), "labels")
    while not lab.filter(F.col("old").isNull() | (F.col("old") != F.col("label"))).isEmpty():
        near = sym.join(lab.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("best"))
        step = lab.select("node", "label").join(near, "node").select("node", "label", F.least("label", "best").alias("best"))
        root = step.groupBy(F.col("label").alias("node")).agg(F.min("best").alias("hooked"))
        new = stash(step.join(root, "node", "left").select("node", F.col("label").alias("old"), F.least("best", F.coalesce("hooked", "best")).alias("label")), "hooks")
        up = new.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        lab = stash(new.join(up, "label").select("node", F.col("higher").alias("label"), "old"), "labels")
    return lab.select("node", "label")


def second_pairs(prefixes: DataFrame, labels: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) of rows with a common leader that share an n-gram of the prefixes of their differences from it, may
    meet the bound by their sizes, and are not yet in one group.

    Only n-grams that two or more rows of different groups have are joined. The row that differs less from the leader
    must have the n-gram in its near prefix, and enough differences must follow it on both sides, were it the first
    that is shared. Where the differences alone are few enough, both link to the leader.
    """
    rows = prefixes.select(F.col("a").alias("lead"), "gram", F.col("b").alias("id"), "size", "off", "pos", "near")
    rows = rows.join(labels, F.col("id") == F.col("node"), "left").select("lead", "gram", "id", "size", "off", "pos", "near", F.coalesce("label", "id").alias("comp"))
    mixed = rows.groupBy("lead", "gram").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("near").alias("any_near")).filter("c0 <> c1 AND any_near").select("lead", "gram")
    rows = stash(rows.join(mixed, ["lead", "gram"]), "mixed")
    x = rows.filter("near").select("lead", "gram", *[F.col(c).alias(f"x_{c}") for c in ("id", "size", "off", "pos", "comp")])
    y = rows.select("lead", "gram", *[F.col(c).alias(f"y_{c}") for c in ("id", "size", "off", "pos", "comp")])
    most = (F.col("x_size") + F.col("y_size")) * (100 - pct) / (100 + pct)
    fits = (F.col("x_comp") != F.col("y_comp")) & (F.struct("x_off", "x_id") < F.struct("y_off", "y_id")) & (F.col("y_off") - F.col("x_off") <= most) & (100 * F.least("x_size", "y_size") >= pct * F.greatest("x_size", "y_size"))
    fits = fits & (2 * F.least(F.col("x_off") - F.col("x_pos"), F.col("y_off") - F.col("y_pos")) >= F.col("x_off") + F.col("y_off") - most)
    joined = x.join(y, (x["lead"] == y["lead"]) & (x["gram"] == y["gram"]) & fits)
    return joined.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def merged_columns(named: DataFrame) -> DataFrame:
    """(key, sizes, b, pos, size): the rows (key, sizes, b, pos, size, more) with one column for all those of one `sizes`
    that the same rows share. Its places are those in the first of them, which is the first that any two rows share of them."""
    one = ["sizes", "rows", "h1", "h2"]
    held = named.groupBy("key", "sizes").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("b")).alias("h1"), F.bit_xor(F.xxhash64("b", F.lit(1))).alias("h2"))
    held = stash(held, "column-rows")
    first = held.groupBy(*one).agg(F.min("key").alias("first"))
    keys = held.join(first, one).select("key", "sizes", "first")
    return named.join(keys, ["key", "sizes"]).groupBy(F.col("first").alias("key"), "sizes", "b").agg(F.min("pos").alias("pos"), F.min("size").alias("size"))


def folded(sets: DataFrame) -> DataFrame:
    """(node, fold) of rows (id, parity): the parity map, folded to MOST_FOLD_BITS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = (np.frombuffer(p, U) for p in batch.column(1).to_pylist())
            maps = (np.bitwise_xor.reduce(m.reshape(-1, min(len(m), MOST_FOLD_BITS // 64))).tobytes() for m in maps)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["node", "fold"])

    return sets.select("id", "parity").mapInArrow(run, "node long, fold binary")


def fold_levels(folds: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of words that maps have: the maps of as many words or more, folded to it, and the place of each row there."""
    words, out = np.array([len(f) // 8 for f in folds]), {}
    at, maps = np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=U)
    for w in np.unique(words)[::-1].tolist():
        own = np.flatnonzero(words == w)
        wider = np.bitwise_xor.reduce(maps.reshape(len(at), -1, w), axis=1) if len(at) else np.zeros((0, w), dtype=U)
        at, maps = np.r_[at, own], np.concatenate((wider, np.frombuffer(b"".join([folds[k] for k in own.tolist()]), U).reshape(-1, w)))
        place = np.zeros(len(folds), dtype=np.int64)
        place[at] = np.arange(len(at))
        out[w] = place, maps
    return out


def fold_bits_apart(levels: dict[int, tuple[np.ndarray, np.ndarray]], words: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The bits in which the maps of rows u and v differ, the longer of them folded to the shorter; some MB at a time."""
    out, least = np.zeros(len(u), dtype=np.int64), np.minimum(words[u], words[v])
    for w, (place, maps) in levels.items():
        at, some = np.flatnonzero(least == w), max(1, (4 << 20) // (8 * w))
        for i in range(0, len(at), some):
            k = at[i : i + some]
            out[k] = np.bitwise_count(maps[place[u[k]]] ^ maps[place[v[k]]]).sum(axis=1, dtype=np.int64)
    return out


def near_rows(group: np.ndarray, b: np.ndarray, pos: np.ndarray, size: np.ndarray, comp: np.ndarray, folds: list[bytes], pct: int, one: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group, rows of which follow each other, but of different components, that may meet the bound by their sizes,
    their places in the shared column and their folded parity maps; for `one`, of each row only that with the first such row before it."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    left = np.repeat(np.r_[starts[1:], len(group)], np.diff(np.r_[starts, len(group)])) - np.arange(len(group))
    found, free = [], np.ones(len(group), dtype=bool)
    levels, words = fold_levels(folds), np.array([len(f) // 8 for f in folds])
    for apart in range(int(left.max(initial=0)) - 1, 0, -1):
        x = np.flatnonzero(left > apart)
        y = x + apart
        both, most = size[x] + size[y], np.minimum(pos[x], pos[y]) + np.minimum(size[x] - pos[x], size[y] - pos[y])
        may = free[y] & (comp[x] != comp[y]) & (b[x] != b[y]) & ((100 + pct) * most >= pct * both) & (100 * np.minimum(size[x], size[y]) >= pct * np.maximum(size[x], size[y]))
        u, v = x[may], y[may]
        near = fold_bits_apart(levels, words, u, v) <= both[may] * (100 - pct) // (100 + pct)
        found.append(np.stack((b[u[near]], b[v[near]])))
        if one:
            free[v[near]] = False
    pairs = np.concatenate([np.zeros((2, 0), dtype=np.int64), *found], axis=1)
    return pairs.min(axis=0), pairs.max(axis=0)


def few_pairs(named: DataFrame, sets: DataFrame, pct: int, one: bool = False) -> DataFrame:
    """Pairs (a, b) of rows of different groups, of those (key, sizes, b, pos, size, comp) that share a column, that may
    meet the bound by their sizes, their places there and their folded parity maps; for `one`, a pair for each row of a
    column at most, with the smallest such row.

    Each row is shuffled once, with its map, and no pair is that fails; a column has at most FEW rows.
    """
    names = ["key", "sizes", "b", "pos", "size", "comp"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def paired(last: bool) -> Iterator[pa.RecordBatch]:
            """Pairs of the rows held so far, but for those of a group that may go on: they stay."""
            rows = pa.Table.from_batches(held).combine_chunks()
            key, sizes, b, pos, size, comp = (rows.column(c).to_numpy().astype(np.int64) for c in names)
            new = np.r_[True, (key[1:] != key[:-1]) | (sizes[1:] != sizes[:-1])]
            end = len(key) if last else int(np.flatnonzero(new)[-1])
            held[:] = rows.slice(end).to_batches()
            if end:
                pairs = near_rows(np.cumsum(new)[:end], b[:end], pos[:end], size[:end], comp[:end], rows.column("fold").slice(0, end).to_pylist(), pct, one)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in np.unique(np.stack(pairs), axis=1)], ["a", "b"])

        n = size = 0
        for batch in batches:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= PAIRED or size >= PAIRED_BYTES:
                yield from paired(False)
                n = size = 0
        if held:
            yield from paired(True)

    rows = named.join(folded(sets), F.col("b") == F.col("node")).select(*names, "fold")
    return rows.repartition("key", "sizes").sortWithinPartitions("key", "sizes", "b").mapInArrow(run, "a long, b long").distinct()


def _sized(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast only if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


SET = ["s1", "s2", "n_shingles"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))


def _repeated(rows: DataFrame) -> bool:
    """Whether an id has several rows, so that it does not tell rows apart."""
    return not rows.groupBy("id").count().filter("count > 1").isEmpty()


def _groups(rows: DataFrame, words: int, pct: int) -> DataFrame:
    """(id, n_shingles, component) of rows (id, text) of distinct ids. Copies are one row of the matrix."""
    marked = stash(document_sets(rows, words), "sets")
    levels = slot_levels(marked.filter("chunk IS NOT NULL").select("part", "chunk", "counts"))
    sets = marked.filter("chunk IS NULL").select("id", *SET, "parity")
    reps = sets.filter("n_shingles > 0").groupBy(*SET).agg(F.min("id").alias("rep"))
    member = stash(sets.join(reps, SET, "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("rep")), "members")
    copies = stash(member.filter("id <> rep").select("id").distinct(), "copies")
    alone = rows.join(_sized(copies), "id", "left_anti")

    marks = marked_columns(alone, words, pct, levels, mark_bits(sets, pct))
    held = repeated_columns(alone, words, pct, levels, marks)
    keys = stash(document_keys(alone, words, pct, levels, marks, held), "columns")
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stash(keys.join(often, "key"), "shared-columns")
    discard(keys)
    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    ranked = shared.join(weight, "id").select("key", F.struct("weight", (-F.col("id")).alias("id"), "pos", "size").alias("at"))
    leads = ranked.groupBy("key").agg(F.max("at").alias("lead"))
    leads = leads.select("key", (-F.col("lead.id")).alias("a"), F.col("lead.pos").alias("pos_a"), F.col("lead.size").alias("size_a"))
    led = shared.join(leads, "key").filter("id <> a").select("key", "a", F.col("id").alias("b"), "n", "pos", "size", _reachable(pct).alias("reachable"))
    led = stash(led, "led")
    discard(shared)
    pairs = led.groupBy("a", "b").agg(F.min("reachable").alias("reachable")).filter("reachable").select("a", "b")
    pairs = stash(within_reach(pairs, sets, pct), "pairs")
    texts = _texts(rows, pairs)
    first = stash(counted(pairs.withColumn("more", F.lit(False)), texts, words, pct), "counted")
    discard(texts)
    links = first.filter("linked").select("a", "b")
    labels = components(links)

    # others of one column are compared with each other only where rows of different groups have sizes that may fit
    step = F.floor(F.log(F.col("size").cast("double")) / F.lit(1.0001 * math.log(100 / pct)))
    named = led.join(labels, F.col("b") == F.col("node"), "left").select("key", "a", "b", "n", "pos", "size", F.coalesce("label", "b").alias("comp"), F.explode(F.array(step, step + 1)).alias("sizes"))
    mixed = named.groupBy("key", "sizes").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key", "sizes")
    named = stash(named.join(mixed, ["key", "sizes"], "left_semi"), "mixed-columns")
    discard(led)
    unclear = stash(named.filter(F.col("n") > FEW).select("a", "b").distinct(), "unclear")
    texts = _texts(rows, unclear)
    apart = stash(counted(unclear.withColumn("more", F.lit(True)), texts, words, pct).filter("gram IS NOT NULL"), "apart")
    discard(texts)
    few = stash(merged_columns(named.filter(F.col("n") <= FEW)), "few-rows")
    discard(named)
    tried = stash(few_pairs(_several(few, labels), sets, pct, one=True), "tried-pairs")
    texts = _texts(rows, tried)
    tested = stash(counted(tried.withColumn("more", F.lit(False)), texts, words, pct), "tested")
    discard(texts)
    links = links.unionByName(tested.filter("linked").select("a", "b"))
    labels = components(links)
    others = few_pairs(_several(few, labels), sets, pct).join(tried, ["a", "b"], "left_anti")
    again = second_pairs(apart, labels, pct).unionByName(others).distinct()
    again = stash(within_reach(again, sets, pct), "second-pairs")
    discard(marked, few, tried, apart)
    second = counted(again.withColumn("more", F.lit(False)), _texts(rows, again), words, pct)
    links = links.unionByName(second.filter("linked").select("a", "b"))
    labels = components(stash(links, "all-links"))
    return member.join(labels, F.col("rep") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("label", "rep").alias("component"))


def _several(few: DataFrame, labels: DataFrame) -> DataFrame:
    """Those rows (key, sizes, b, pos, size) with their comp, of columns that rows of several groups share."""
    named = few.join(labels, F.col("b") == F.col("node"), "left").select(*few.columns, F.coalesce("label", "b").alias("comp"))
    mixed = named.groupBy("key", "sizes").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key", "sizes")
    return named.join(mixed, ["key", "sizes"], "left_semi")


def _reachable(pct: int):
    """Whether two sets that share the columns at pos_a and pos can meet the bound: what comes before those places and
    what comes after them limits their overlap, and so do their sizes."""
    most = F.least("pos_a", "pos") + 1 + F.least(F.col("size_a") - F.col("pos_a"), F.col("size") - F.col("pos")) - 1
    return (100 * F.least("size_a", "size") >= pct * F.greatest("size_a", "size")) & ((100 + pct) * most >= pct * (F.col("size_a") + F.col("size")))


def _texts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the rows that the written `pairs` (a, b) name."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return stash(rows.join(_sized(stash(ids, "candidates")), "id", "left_semi").dropDuplicates(["id"]), "candidate-texts")


def _set_groups(rows: DataFrame, words: int, pct: int) -> DataFrame:
    """(id, s1, s2, n_shingles, label) of rows (id, text) of any ids: rows of the matrix are distinct sets, numbered
    apart from the ids, so every text of an id is joined. Sets without shingles have no label."""
    marked = stash(marked_rows(rows, words), "marked")
    sets = marked.filter("n_shingles > 0").dropDuplicates(SET).select(F.monotonically_increasing_id().alias("set"), *SET, "text")
    sets = stash(sets, "distinct-sets")
    labels = _groups(sets.select(F.col("set").alias("id"), "text"), words, pct).select(F.col("id").alias("set"), F.col("component").alias("label"))
    named = stash(sets.select("set", *SET).join(labels, "set").drop("set"), "set-labels")
    return stash(marked.select("id", *SET).join(_sized(named), SET, "left"), "set-members")


def _linked_by_id(members: DataFrame) -> DataFrame:
    """`members` with one label for all texts of an id; a null id links nothing."""
    of_id = stash(members.filter(F.col("label").isNotNull() & (F.col("id") != NO_ID)).groupBy("id").agg(F.min("label").alias("low"), F.max("label").alias("high")), "labels-of-ids")
    several = _sized(stash(of_id.filter("low <> high").select("id", "low"), "several"))
    edges = members.join(several, "id").filter("label <> low").select(F.col("low").alias("a"), F.col("label").alias("b")).distinct()
    joined = stash(components(stash(edges, "links-of-ids")).select(F.col("node").alias("label"), F.col("label").alias("joined")), "joined-labels")
    members = members.join(_sized(of_id.select("id", "low")), "id", "left").withColumn("label", F.coalesce("label", "low")).drop("low")
    return stash(members.join(_sized(joined), "label", "left").withColumn("label", F.coalesce("joined", "label")).drop("joined"), "linked-members")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, pct: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked where 100 * overlap >= pct * union of their shingle sets.

    No link is missed, whatever the sizes of groups: see the module's text. Null or empty texts have no shingles and link with nothing.
    Rows of equal id are one document, each with its own n_shingles; its texts link together. A null id tells nothing:
    such rows link by their texts only. A component is named by its smallest id, null if it has none. Ids must be whole
    numbers. Empty input gives no rows; other columns are ignored, whatever their names.
    """
    whole_ids(docs, id_col)
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    if _repeated(rows):
        members = _linked_by_id(_set_groups(rows, words, pct))
        least = stash(members.filter("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least")), "least-ids")
        out = members.join(_sized(least), "label", "left").select("id", "n_shingles", F.coalesce("least", "id").alias("component"))
    else:
        out = _groups(rows, words, pct)
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(null("id").alias("doc_id"), "n_shingles", null("component").alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, pct: int = 80) -> DataFrame:
    """One document of each group of texts linked as in `jaccard_groups`, that of the smallest id (null ids last).

    Here rows link by their texts only, so rows of equal or null id stay unless their texts are copies. Texts without
    shingles stay, one of each id; all of those of null id. Ids must be whole numbers. Empty input gives no rows; other
    columns may have any names.
    """
    whole_ids(docs, id_col)
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    if not _repeated(rows):
        gone = stash(_groups(rows, words, pct).filter("id <> component").select(F.col("id").alias("gone_id")), "gone")
        keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"))
        return keyed.join(_sized(gone), F.col("id") == F.col("gone_id"), "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    members = _set_groups(rows, words, pct).filter("label IS NOT NULL")
    first = stash(members.groupBy("label").agg(F.min(F.struct("id", *SET)).alias("top")).select("top.*"), "first-of-groups")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    keyed = stash(marked_rows(keyed, words).drop("text"), "marked-rows")
    bare = F.col("n_shingles") == 0
    once = keyed.filter(~bare).join(_sized(first), ["id", *SET], "left_semi").unionByName(keyed.filter(bare & (F.col("id") != NO_ID))).dropDuplicates(["id", *SET])
    return once.unionByName(keyed.filter(bare & (F.col("id") == NO_ID))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_ngram_join(spark, sf_dir):
    from .common import table

    return jaccard_groups(table(spark, sf_dir, "documents"))

"""Token ids in patched frame-of-reference blocks: encode, write in id order, read back."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters, default_path
from .common import new_path, small_batches, tidy, whole_ids

BLOCK = 1024
#: Share of a block's values that its packed width holds; the others are exceptions.
FITS = 0.97
#: A chunk is closed when it has this many ids.
CHUNK_IDS = 1 << 18
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIQI")
BLOCK_HEAD = struct.Struct("<IBHH")
CHUNKS = "part int, seq int, n_ids long, n_docs int, image binary"


def pack_block(values: np.ndarray) -> bytes:
    """Minimum, width, counts, packed low bits; then exceptions as positions and whole offsets from the minimum."""
    low = int(values.min())
    rest = (values - np.uint32(low)).astype(np.uint32)
    pivot = int(np.partition(rest, k := min(len(rest) - 1, int(FITS * len(rest))))[k])
    width = pivot.bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little") if width else rest[:0]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes() if width else b""
    return BLOCK_HEAD.pack(low, width, len(values), len(odd)) + packed + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


@lru_cache(maxsize=33)
def places(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte where each value of a block of this width starts, and the bits before it in that byte."""
    bit = np.arange(BLOCK) * width
    return bit // 8, (bit % 8).astype(np.uint64)


def unpack_block(image: memoryview, at: int) -> np.ndarray:
    low, width, n, n_odd = BLOCK_HEAD.unpack_from(image, at)
    at += BLOCK_HEAD.size
    size = (n * width + 7) // 8
    rest = np.zeros(n, dtype=np.uint32)
    if width:
        # a value starts within a byte, and the 8 bytes from there on hold all of it
        byte, shift = places(width)
        words = np.ndarray(size + 1, dtype="<u8", buffer=bytes(image[at : at + size]) + bytes(8), strides=(1,))
        rest = ((words[byte[:n]] >> shift[:n]) & np.uint64((1 << width) - 1)).astype(np.uint32)
    at += size
    rest[np.frombuffer(image, "<u2", n_odd, at).astype(np.int64)] = np.frombuffer(image, "<u4", n_odd, at + 2 * n_odd)
    return rest + np.uint32(low)


def pack(values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(block starts, blocks) of a sequence of unsigned 32-bit values."""
    blocks = [pack_block(values[i : i + BLOCK]) for i in range(0, len(values), BLOCK)]
    return np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8") if blocks else np.zeros(0, "<u8"), b"".join(blocks)


def chunk_image(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """Header; ids of the documents and which of them are null; tokens a document; index of block starts; blocks."""
    flat = np.concatenate(ids).astype(np.uint32)
    starts, blocks = pack(flat)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8")
    lengths = np.array([len(x) for x in ids], dtype="<u8")
    return HEAD.pack(MAGIC, len(doc_ids), len(flat), len(starts)) + names.tobytes() + known.tobytes() + lengths.tobytes() + starts.tobytes() + blocks


class Chunk:
    """A chunk image, read; ids(i, j) decodes only the blocks that hold ids i to j."""

    def __init__(self, image: bytes):
        self.view = memoryview(image)
        magic, n_docs, self.n_ids, n_blocks = HEAD.unpack_from(self.view)
        if magic != MAGIC:
            raise ValueError("not a chunk of token ids")
        at = HEAD.size
        names = np.frombuffer(self.view, "<i8", n_docs, at)
        known = np.frombuffer(self.view, np.uint8, n_docs, at + 8 * n_docs)
        at += 9 * n_docs
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known, strict=True)]
        self.lengths = np.frombuffer(self.view, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.starts = np.frombuffer(self.view, "<u8", n_blocks, at).astype(np.int64)
        self.blocks_at = at + 8 * n_blocks

    def ids(self, i: int = 0, j: int | None = None) -> np.ndarray:
        j = self.n_ids if j is None else min(j, self.n_ids)
        if j <= i:
            return np.zeros(0, dtype=np.uint32)
        some = range(i // BLOCK, (j - 1) // BLOCK + 1)
        flat = np.concatenate([unpack_block(self.view, self.blocks_at + int(self.starts[b])) for b in some])
        return flat[i - some[0] * BLOCK : j - some[0] * BLOCK]


#: ASCII white space as bytes, and other white space next to a blank.
WHITE = np.array([chr(b).isspace() and b < 128 for b in range(256)])
WIDE_PAIRS = [p for c in map(chr, range(128, 0x3001)) if c.isspace() for p in (f" {c}", f"{c} ")]
#: Pieces that an encoder keeps, and characters of texts that it takes at a time, so that equal pieces are looked up once.
KEPT, AT_ONCE = 120_000, 6 << 20
#: Ends of pieces that are pre-tokens of their own after letters.
TAILS = (",", ".")


def even_texts(texts: list[str]) -> list[bool]:
    """For each text whether every blank has characters other than white space on both sides."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"x".join([*raw, b""]), dtype=np.uint8)
    blank, white = data == 32, WHITE[data]
    bad = np.flatnonzero((blank[1:] & white[:-1]) | (white[1:] & blank[:-1]))
    uneven = set(np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), bad, side="right").tolist())
    return [i not in uneven and t[:1] not in ("", " ") and t[-1] != " " and (t.isascii() or not any(p in t for p in WIDE_PAIRS)) for i, t in enumerate(texts)]


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of `flat` with the numbers `at`, one after the other."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.arange(n.sum()) + np.repeat(begins[at] - ends + n, n)]


class Encoder:
    """Texts to ids by the tokenizers library, with a bounded memo of the pieces between single blanks.

    Where every blank has other characters on both sides, pre-tokens never cross one, so a piece with the blank before
    it has the same ids in every text. Pieces not met before are encoded together, as one text; as tokens with a
    leading blank start the pieces, the ids fall apart again. Other texts, and those with special strings, are encoded
    whole by the library.
    """

    def __init__(self, path: str):
        # tasks are the unit of parallel work; threads of the library's own would only compete with them
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        blank = byte_letters()[32]
        vocab = self.library.get_vocab()
        self.starts_piece = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.starts_piece[[i for t, i in vocab.items() if t.startswith(blank)]] = True
        self.tails = {t: vocab[t] for t in TAILS}
        self.at: dict[str, int] = {}
        self.flat, self.sizes, self.uses = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0)

    def whole(self, text: str) -> np.ndarray:
        # the batch call leaves offsets out
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids a piece)"""
        ids = self.whole(" " + " ".join(pieces))
        first = np.flatnonzero(self.starts_piece[ids])
        if len(first) != len(pieces):
            raise ValueError("the vocabulary joins pieces across blanks")
        return ids, np.diff(np.r_[first, len(ids)])

    def _encode_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode, of any number of pieces; those of letters and a tail are put together from their letters' ids."""
        tailed = [p[-1] in TAILS and p[:-1].isalpha() for p in pieces]
        bare = [p[:-1] if t else p for p, t in zip(pieces, tailed, strict=True)]
        stems = dict.fromkeys(bare)
        stems.update(zip(stems, range(len(stems))))
        names = list(stems)
        known = np.fromiter(map(self.at.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = [names[k] for k in np.flatnonzero(known < 0).tolist()]
        parts = [self._encode(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
        known[known < 0] = np.arange(len(self.sizes), len(self.sizes) + len(new))
        flat = np.concatenate([self.flat, *(p[0] for p in parts)])
        sizes = np.concatenate([self.sizes, *(p[1] for p in parts)])
        begins = np.cumsum(sizes) - sizes
        at = known[np.fromiter(map(stems.__getitem__, bare), dtype=np.int64, count=len(bare))]
        tail = np.array(tailed)
        n = sizes[at] + tail
        ends = np.cumsum(n)
        ids = flat[np.minimum(np.arange(ends[-1]) + np.repeat(begins[at] - ends + n, n), len(flat) - 1)]
        ids[ends[tail] - 1] = [self.tails[p[-1]] for p, t in zip(pieces, tailed, strict=True) if t]
        return ids, n

    def _find(self, pieces: list[str], uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each of the distinct pieces, all ids, ids a place); keeps the pieces used most, older uses counting half."""
        where = np.fromiter(map(self.at.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        flat, sizes, names = self.flat, self.sizes, []
        if len(new := np.flatnonzero(where < 0)):
            names = list(map(pieces.__getitem__, new.tolist()))
            ids, n = self._encode_all(names)
            where[new] = np.arange(len(sizes), len(sizes) + len(new))
            flat, sizes = np.concatenate([flat, ids]), np.concatenate([sizes, n])
        self.uses = np.concatenate([self.uses / 2, np.zeros(len(names))])
        self.uses[where] += uses
        if len(sizes) <= KEPT:
            self.at.update(zip(names, range(len(self.sizes), len(sizes))))
            self.flat, self.sizes = flat, sizes
        else:
            kept = np.sort(np.argpartition(-self.uses, KEPT)[:KEPT])
            names = [*self.at, *names]
            self.at = {names[k]: i for i, k in enumerate(kept.tolist())}
            self.flat, self.sizes, self.uses = gather(flat, np.cumsum(sizes) - sizes, sizes, kept), sizes[kept], self.uses[kept]
        return where, flat, sizes

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [e and not any(m in t for m in self.marks) for t, e in zip(texts, even_texts(texts), strict=True)]
        split = pc.split_pattern(pa.array([t for t, e in zip(texts, plain, strict=True) if e], pa.large_string()), " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        starts, names = edges[:-1], coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # the first piece has no blank before it and is encoded for itself
        first = iter(self.library.encode_batch_fast([names[c] for c in codes[starts].tolist()], add_special_tokens=False))
        rest = np.delete(codes, starts)
        uses = np.bincount(rest, minlength=len(names))
        used = np.flatnonzero(uses)
        body, ends = np.zeros(0, dtype=np.uint32), iter(())
        if len(used):
            place = np.zeros(len(names), dtype=np.int64)
            place[used], flat, sizes = self._find(list(map(names.__getitem__, used.tolist())), uses[used])
            at = place[rest]
            body = gather(flat, np.cumsum(sizes) - sizes, sizes, at)
            ends = iter(np.r_[0, np.cumsum(sizes[at])][edges[1:] - np.arange(1, len(edges))].tolist())
        out, done = [], 0
        for t, e in zip(texts, plain, strict=True):
            if not e:
                out.append(self.whole(t))
                continue
            end = next(ends, 0)
            out.append(np.concatenate((np.array(next(first).ids, dtype=np.uint32), body[done:end])))
            done = end
        return out


def together(batches: Iterator[pa.RecordBatch], size: int = AT_ONCE) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of `size` characters or little more; null texts are empty."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            n += len(texts[-1])
            if n >= size:
                yield ids, texts
                ids, texts, n = [], [], 0
    if texts:
        yield ids, texts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    return Encoder(path)


def write_tokens(docs: DataFrame, out_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, path: str | None = None, at_once: int = AT_ONCE) -> None:
    """Encode every text, end each with `end_id`, and write chunks in ascending id order (nulls first) to `out_path`.

    Spark's Parquet writer holds the chunk images, one a row with its place (part, seq): a lost task is written again
    as a whole, to any store Spark can write to. Null texts are empty, so they have the end id alone. Rows of equal id
    are ordered by text. Empty input writes no chunks. Ids must be whole numbers; other columns are ignored, whatever
    their names. A worker holds about `at_once` characters of text at a time, and its pieces.
    """
    whole_ids(docs, id_col)
    path = path or default_path()
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        names: list = []
        ids: list = []
        n = 0

        def chunk():
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([n], pa.int64()), "n_docs": pa.array([len(names)], pa.int32()), "image": pa.array([chunk_image(names, ids)], pa.binary())}
            )

        for doc_ids, texts in together(batches, at_once):
            for doc_id, tokens in zip(doc_ids, encode(texts), strict=True):
                names.append(doc_id)
                ids.append(np.append(tokens, np.uint32(end_id)))
                n += len(ids[-1])
                if n >= CHUNK_IDS:
                    yield chunk()
                    names, ids, n, seq = [], [], 0, seq + 1
        if names:
            yield chunk()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, CHUNKS).write.parquet(out_path)


def read_tokens(spark: SparkSession, in_path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the chunks at `in_path`, decoded. Null ids are read back as nulls, and no chunks give no rows.
    """
    chunks = spark.read.schema(CHUNKS).parquet(in_path)
    small_batches(spark)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.withColumn("part_start", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = chunks.select("part", "seq", "n_ids").join(parts.select("part", "part_start"), "part")
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("part", "seq", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(order), F.lit(0))).alias("chunk_start"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                chunk = Chunk(image)
                flat = chunk.ids().astype("<u4")
                ends = np.cumsum(chunk.lengths)
                starts = ends - chunk.lengths
                crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(crc)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part] * k, pa.int32()), "seq": pa.array([seq] * k, pa.int32()), "doc_id": pa.array(chunk.doc_ids, pa.int64()), "inner": pa.array(starts), "n_tokens": pa.array(chunk.lengths), "ids_crc32": pa.array(crc, pa.int64())}
                )

    read = chunks.select("part", "seq", "image").mapInArrow(run, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return read.join(heads, ["part", "seq"]).select("doc_id", (F.col("chunk_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_file(spark, sf_dir):
    from .common import table

    out = new_path(spark, "token-ids")
    write_tokens(table(spark, sf_dir, "documents"), out)
    return read_tokens(spark, out)

"""Token ids in patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Its ids are cut into blocks of BLOCK ids; each block
stores its smallest id, its other ids less that one in as many bits as PERCENTILE of them need, and the
few that need more as exceptions (place and value). An index of block starts lets a reader open any
block without the ones before. Layout, all little-endian:

    magic "TFB1" | ids u64 | documents u32 | blocks u32
    document ids i64[] | null marks u8[] | counts u32[]      one for each document, in file order
    block index: byte offset u32[] (blocks + 1) | minimum u32[] | width u8[] | exceptions u16[]
    body: for each block its packed bits, then exception places u16[] and values u32[]

Files travel as binary values of a Parquet table (part, seq, file), because the shared store may be one
that only Spark can write to. Null texts are empty; a null doc_id sorts first; repeated rows are written
one by one, in the order of their texts; an empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ragged, scratch, shuffle_partitions, sized_broadcast, text_slices
from tallyforge.llm.tokens import word_tokenizer

#: Text of one file, in bytes.
FILE_BYTES = 2 << 20
BLOCK = 1024
PERCENTILE = 95
_MAGIC = b"TFB1"


def pack_ids(ids: np.ndarray) -> tuple[list[np.ndarray], bytes]:
    """The index columns (offsets, minima, widths, exception counts) and the body of the blocks of ids."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = grid - low[:, None]
    need = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    place = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = np.partition(need, place, axis=1)[:, place] if blocks else np.empty(0, np.uint8)
    over = need > width[:, None]
    n_over = over.sum(axis=1).astype(np.uint16)
    packed = [b""] * blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(rest[rows].view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
            got = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            for r, g in zip(rows, got, strict=True):
                packed[r] = g.tobytes()
    block, at = np.nonzero(over)
    places, values = at.astype("<u2"), rest[block, at].astype("<u4")
    ends = np.concatenate([[0], np.cumsum(n_over.astype(np.int64))])
    body = [packed[i] + places[ends[i] : ends[i + 1]].tobytes() + values[ends[i] : ends[i + 1]].tobytes() for i in range(blocks)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype("<u4")
    return [offsets, low.astype("<u4"), width, n_over.astype("<u2")], b"".join(body)


def write_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    index, body = pack_ids(ids)
    head = _MAGIC + np.array([len(ids)], "<u8").tobytes() + np.array([len(doc_ids), len(index[1])], "<u4").tobytes()
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return b"".join([head, docs, counts.astype("<u4").tobytes(), *(x.tobytes() for x in index), body])


class TokenFile:
    """A reader of one file: doc_ids, counts, and the ids of any range, opened by the block index."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a token file")
        self.n = int(np.frombuffer(data, "<u8", 1, 4)[0])
        n_docs, blocks = (int(x) for x in np.frombuffer(data, "<u4", 2, 12))
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.counts = take("<u4", n_docs).astype(np.int64)
        self.offsets, self.low, self.width, self.n_over = take("<u4", blocks + 1), take("<u4", blocks), take("u1", blocks), take("<u2", blocks)
        self.body = np.frombuffer(data, np.uint8, -1, at)

    def read(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids start:end."""
        end = self.n if end is None else min(end, self.n)
        first, last = start // BLOCK, -(-end // BLOCK)
        out = np.zeros((max(last - first, 0), BLOCK), np.uint32)
        widths = self.width[first:last]
        for w in np.unique(widths):
            rows = np.flatnonzero(widths == w)
            size = BLOCK * int(w) // 8
            if size:
                packed = self.body[ragged(self.offsets[first + rows].astype(np.int64), np.full(len(rows), size))].reshape(len(rows), size)
                bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
                bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
                out[rows] = np.packbits(bits, axis=2, bitorder="little").reshape(len(rows), BLOCK * 4).view("<u4")
        for i in np.flatnonzero(self.n_over[first:last]):
            k, at = int(self.n_over[first + i]), int(self.offsets[first + i]) + BLOCK * int(self.width[first + i]) // 8
            places = self.body[at : at + 2 * k].tobytes()
            values = self.body[at + 2 * k : at + 6 * k].tobytes()
            out[i, np.frombuffer(places, "<u2")] = np.frombuffer(values, "<u4")
        out += self.low[first:last, None]
        return out.ravel()[start - first * BLOCK : end - first * BLOCK]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Writes the ids of docs(doc_id, text), end_id after each document, in ascending doc_id order.

    Partitions are ranges of doc_id (and of the text's hash, so that many rows of one id still spread);
    a part makes one file for every text slice of some megabytes.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokenizer = TaskContext.get().partitionId(), word_tokenizer(vocabulary)
        for seq, b in enumerate(text_slices(batches, FILE_BYTES)):
            flat, counts = tokenizer.encode(b.column(1).to_pylist())
            ends = np.cumsum(counts)
            ids = np.insert(flat, ends, np.uint32(end_id))
            data = write_file(b.column(0).to_pylist(), counts + 1, ids)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "file": pa.array([data], pa.binary())})

    rows.mapInArrow(run, "part int, seq int, n_ids long, file binary").write.option("compression", "zstd").parquet(path)


def read(files: DataFrame) -> DataFrame:
    """Per document: doc_id, part, seq, place (ids before it in the file), n_tokens, ids (binary, u32 little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                f = TokenFile(data)
                ids, ends = f.read().astype("<u4"), np.cumsum(f.counts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(f.doc_ids, pa.int64()), "part": pa.array([part] * len(ends), pa.int32()), "seq": pa.array([seq] * len(ends), pa.int32()),
                        "place": pa.array(ends - f.counts), "n_tokens": pa.array(f.counts), "ids": pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary()),
                    }
                )

    return files.select("part", "seq", "file").mapInArrow(run, "doc_id long, part int, seq int, place long, n_tokens long, ids binary")


def file_starts(files: DataFrame) -> DataFrame:
    """Per file: part, seq, first (ids of all files before it). Only one total for each part meets in one place."""
    from pyspark.sql.window import Window

    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return sizes.withColumn("inside", inside).join(base, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("first"))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes the files to the shared folder and reads them back: doc_id, start, n_tokens, ids."""
    spark = docs.sparkSession
    path = scratch(spark, "token-files")
    write(docs, path, vocabulary, end_id)
    files = spark.read.schema("part int, seq int, n_ids long, file binary").parquet(path)
    return read(files).join(sized_broadcast(file_starts(files), 1_000_000), ["part", "seq"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids")


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)

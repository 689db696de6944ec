"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Each task packs its own pieces best-fit (a window of pieces at a time, longest first) into bins of at
most `size` tokens. Nearly full bins are sequences at once. The underfull bins of FAN neighbouring
partitions then meet as items in one task, which packs them best-fit again, and so on up the tree.
All underfull bins go up to the root. If a task has more than CARRY of them, they go up in several lanes,
dealt in turn by their room, so that each lane holds bins of all kinds; equal lanes of neighbours meet. So no
task ever holds more than FAN * CARRY bins, whatever the input, and none is left out.

Null and empty texts make one piece, the end id. Rows that repeat are packed one by one. A document
longer than a sequence is cut into whole sequences, its first piece being the shorter rest. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import cut, lean, text_slices
from tallyforge.llm.tokens import byte_tokenizer

FAN = 8
CARRY = 4096
WINDOW = 8192
#: A bin with at most this share of its room left is a sequence at once.
NEARLY_FULL = 0.002


class BestFit:
    """Open bins by their room; put gives an item the bin with the least room that it fits into."""

    def __init__(self, size: int):
        self.size, self.mask = size, 0
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, name: int, room: int) -> None:
        self.by_room[room].append(name)
        self.mask |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin for an item of that length and its room before, or None; the bin is taken out."""
        fits = self.mask >> length
        if not fits:
            return None
        room = length + (fits & -fits).bit_length() - 1
        names = self.by_room[room]
        name = names.pop()
        if not names:
            self.mask ^= 1 << room
        return name, room

    def bins(self) -> Iterator[tuple[int, int]]:
        for room in range(self.size, -1, -1):
            for name in self.by_room[room]:
                yield name, room


def tokenise(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Pieces with their local bins: doc_id, piece, start, length, ids, bin, place, room (of the bin, on its first piece)."""
    slack = int(size * NEARLY_FULL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokenizer = TaskContext.get().partitionId(), byte_tokenizer(vocabulary)
        best, n_bins, held, n_held = BestFit(size), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_bins, held, n_held
            if not held:
                return
            rows = [np.concatenate(x) for x in zip(*(h[1:5] for h in held), strict=True)]
            doc, piece, start, length = np.concatenate([h[0] for h in held]), *rows[:3]
            ids = [i for h in held for i in h[5]]
            bins, place = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
            for i in np.argsort(-length, kind="stable").tolist():
                n = int(length[i])
                name, room = best.take(n) or (-1, size)
                if name < 0:
                    name, n_bins = part << 32 | n_bins, n_bins + 1
                bins[i], place[i] = name, size - room
                if room - n > slack:
                    best.add(name, room - n)
            null = rows[3]
            for a in range(0, len(doc), 1024):
                b = slice(a, a + 1024)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc[b], pa.int64(), mask=null[b]), "piece": pa.array(piece[b], pa.int32()), "start": pa.array(start[b]), "length": pa.array(length[b]),
                        "ids": pa.array(ids[b], pa.binary()), "bin": pa.array(bins[b]), "place": pa.array(place[b]), "room": pa.array(np.full(len(doc[b]), -1)),
                    }
                )
            held, n_held = [], 0

        for b in text_slices(batches):
            flat, counts = tokenizer.encode(b.column(1).to_pylist())
            ids, counts = np.insert(flat, np.cumsum(counts), np.uint32(end_id)).astype("<u4"), counts + 1
            pieces = -(-counts // size)
            owner = np.repeat(np.arange(len(counts)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            rest = (counts - (pieces - 1) * size)[owner]
            start = np.where(number == 0, 0, rest + (number - 1) * size)
            length = np.where(number == 0, rest, size)
            cuts = (np.cumsum(counts) - counts)[owner] + start
            nulls = b.column(0).is_null().to_numpy(zero_copy_only=False)[owner]
            doc = b.column(0).fill_null(0).to_numpy()[owner]
            held.append((doc, number, start, length, nulls, [x.tobytes() for x in np.split(ids, cuts[1:])]))
            n_held += len(owner)
            if n_held >= WINDOW:
                yield from flush()
        yield from flush()
        left = list(best.bins())
        for a in range(0, len(left), 10_000):
            names, rooms = zip(*left[a : a + 10_000], strict=True)
            n = len(names)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.nulls(n, pa.int64()), "piece": pa.nulls(n, pa.int32()), "start": pa.nulls(n, pa.int64()), "length": pa.nulls(n, pa.int64()),
                    "ids": pa.nulls(n, pa.binary()), "bin": pa.array(names, pa.int64()), "place": pa.nulls(n, pa.int64()), "room": pa.array(rooms, pa.int64()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run, byte_tokenizer), "doc_id long, piece int, start long, length long, ids binary, bin long, place long, room long")


def merge(bins: DataFrame, size: int, carry: int = CARRY) -> DataFrame:
    """One round: the bins (node, lane, bin, room, parts) of each lane of a node packed as items. parts: the local bins inside, with their places.

    Bins with done set are sequences; the others are the items of the next round.
    """

    def run(key: tuple, got: pa.Table) -> pa.Table:
        items = list(zip(*(got.column(c).to_pylist() for c in ("node", "lane", "bin", "room", "parts")), strict=True))
        items.sort(key=lambda x: (x[3], x[2]))
        best, inside = BestFit(size), {}
        for _, _, name, room, parts in items:
            found = best.take(size - room)
            if found is None:
                inside[name] = list(parts)
                best.add(name, room)
            else:
                host, free = found
                inside[host] += [{"bin": p["bin"], "place": p["place"] + size - free} for p in parts]
                best.add(host, free - (size - room))
        rooms = dict(best.bins())
        names = sorted(rooms, key=lambda x: (-rooms[x], x))
        slack = int(size * NEARLY_FULL)
        lanes = -(-sum(rooms[x] > slack for x in names) // carry)
        lane = [items[0][1] * FAN + i % max(lanes, 1) for i in range(len(names))]
        return pa.table(
            {
                "node": pa.array([items[0][0] // FAN] * len(names), pa.int64()), "lane": pa.array(lane, pa.int64()), "bin": pa.array(names, pa.int64()), "room": pa.array([rooms[x] for x in names], pa.int64()),
                "parts": pa.array([inside[x] for x in names], pa.list_(pa.struct([("bin", pa.int64()), ("place", pa.int64())]))), "done": pa.array([rooms[x] <= slack for x in names], pa.bool_()),
            }
        )

    return bins.groupBy("node", "lane").applyInArrow(run, "node long, lane long, bin long, room long, parts array<struct<bin:long,place:long>>, done boolean")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids (binary, u32 little-endian), sequence_id, offset."""
    rows = cut(tokenise(docs, vocabulary, end_id, size), "pieces")
    pieces, open_bins = rows.where("piece IS NOT NULL").drop("room"), rows.where("piece IS NULL")
    part = F.shiftright("bin", 32)
    top = open_bins.agg(F.max(part)).first()[0]
    if top is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    of_part = Window.partitionBy(part)
    rank, lanes = F.row_number().over(of_part.orderBy(F.desc("room"), "bin")) - 1, F.ceil(F.count("*").over(of_part) / CARRY)
    parts = F.array(F.struct("bin", F.lit(0).cast("long").alias("place"))).alias("parts")
    state = open_bins.select((part / FAN).cast("long").alias("node"), (rank % lanes).cast("long").alias("lane"), "bin", "room", parts)
    moved = []
    width = int(top) // FAN
    while True:
        state = cut(merge(state, size), "bins")
        last = width == 0
        moved.append(state if last else state.where("done"))
        if last:
            break
        state, width = state.where("NOT done").drop("done"), width // FAN
    placed = moved[0]
    for more in moved[1:]:
        placed = placed.unionByName(more)
    where = placed.select(F.col("bin").alias("sequence_id"), F.explode("parts").alias("p")).select("sequence_id", F.col("p.bin").alias("bin"), F.col("p.place").alias("before"))
    return pieces.join(where, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.coalesce("before", F.lit(0)) + F.col("place")).alias("offset")
    )


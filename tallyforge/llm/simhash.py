"""Near copies by 64-bit SimHash, found by exact comparison of tiles of fingerprints.

A text, A-Z in lower case, is cut into words [^\\x20\\x09-\\x0D]+ and 3-word shingles, repeats included, joined by
spaces (fewer words: the whole sequence). A fingerprint bit is 1 if set in more than half of the shingles' XXH64
(UTF-8, seed 42); without words the fingerprint is zero. Fingerprints link at RADIUS or fewer differing bits.

Each distinct fingerprint is compared once, whatever the number of its copies. Fingerprints differ in at least as
many bits as the population counts of any parts of theirs differ in sum, so those whose halves have the counts
(i, j) need only meet those of cells up to RADIUS steps away: each fingerprint goes to its own cell as a resident and
to half of the near cells as a guest, which makes every such pair meet once. Inside a task residents and guests
are sorted by the counts of their eight bytes and cut into tiles of TILE; tile pairs whose counts differ beyond
the radius are skipped, and the others are compared in full by exclusive-or and bit counts. The more fingerprints,
the narrower the tiles. A cell of more than CELL residents is dealt to several tasks, each with a
part of the residents that all guests and the other residents pass; guests stream, so memory has a bound. Tiles that
lie in one component already say nothing new. Links leave a task as trees (a fingerprint that has
partners sends one link for each batch), never as all pairs of a group.

Null and empty texts link with each other and with other fingerprints near zero. A null doc_id has its fingerprint
and component as any other row, but names no component; a component of such rows alone has a null
component_id. Repeated rows and rows of one doc_id are rows of their own. Other columns are not looked at. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, discard, shuffle_partitions, sized_broadcast, text_slices
from tallyforge.llm.jaccard_join import components

RADIUS = 3
WIDTH = 3
SEED = 42
TILE = 1024
#: Residents of a cell that a task holds at once.
CELL = 1 << 17
#: Fingerprints that a mapper deals out together.
LOT = 1 << 16
#: Linked fingerprints that may be broadcast; beyond it the join shuffles.
MOST_BROADCAST = 500_000


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], np.uint64)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, counted byte by byte over the values of a byte."""
    octets = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    if len(octets) < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(octets), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print, the fingerprint as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            texts = b.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(shingle_hashes(t.as_py())) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, print long")


def near_cells(radius: int) -> list[tuple[int, int]]:
    """Steps to one half of the cells up to radius away; the other half are their opposites."""
    return [(i, j) for i in range(radius + 1) for j in range(-radius, radius + 1) if (i, j) > (0, 0) and i + abs(j) <= radius]


def _halves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.bitwise_count(np.ascontiguousarray(prints).view("<u4").reshape(-1, 2)).astype(np.int64)
    return both[:, 0], both[:, 1]


class Tiles:
    """Fingerprints in the order of their bytes' counts, cut into tiles with the least and greatest counts of each."""

    def __init__(self, prints: np.ndarray):
        counts = np.bitwise_count(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8))
        order = np.lexsort((prints, *counts.T[::-1]))
        self.prints, counts = prints[order], counts[order].astype(np.int16)
        self.at = np.arange(0, len(prints), TILE)
        self.low, self.high = np.minimum.reduceat(counts, self.at), np.maximum.reduceat(counts, self.at)

    def near(self, other: Tiles, tile: int, radius: int) -> np.ndarray:
        """Tiles of other whose counts come within radius of this tile's."""
        gap = np.maximum(0, np.maximum(other.low - self.high[tile], self.low[tile] - other.high))
        return np.flatnonzero(gap.sum(axis=1) <= radius)


class Grove:
    """Which fingerprints hang together, as trees of numbers whose root is the least."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        top = self.up[of]
        while not np.array_equal(above := self.up[top], top):
            top = above
        self.up[of] = top
        return top

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def compare(home: Tiles, guest: Tiles, grove: Grove, shift: int, radius: int) -> None:
    """Joins in grove all near pairs of a home (numbers from 0) and a guest fingerprint (numbers from shift; 0 compares home with itself)."""
    for t, at in enumerate(guest.at):
        mine = guest.prints[at : at + TILE]
        own = np.arange(at, at + len(mine)) + shift
        for h in guest.near(home, t, radius):
            if not shift and h > t:
                continue
            to = int(home.at[h])
            theirs = home.prints[to : to + TILE]
            roots = grove.roots(own)
            if (roots == roots[0]).all() and (grove.roots(np.arange(to, to + len(theirs))) == roots[0]).all():
                continue
            x, y = np.nonzero(np.bitwise_count(mine[:, None] ^ theirs[None, :]) <= radius)
            grove.join(own[x], to + y)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links that hang together as all pairs of prints(print), distinct, of up to radius differing bits do."""
    spark, steps = prints.sparkSession, near_cells(radius)
    count = F.bit_count(F.col("print").bitwiseAND(F.lit(0xFFFFFFFF)))
    sizes = prints.groupBy(count.alias("i"), (F.bit_count("print") - count).alias("j")).agg(F.count("*").alias("n")).collect()  # 33 x 33 rows at most
    lots = {(r["i"], r["j"]): -(-r["n"] // CELL) for r in sizes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def dealt() -> pa.RecordBatch:
            p = np.sort(np.concatenate(held).view(np.uint64))
            held.clear()
            i, j = _halves(p)
            order = np.argsort(i * 64 + j, kind="stable")
            p, cell = p[order], (i * 64 + j)[order]
            rows = []
            at = np.flatnonzero(np.diff(cell, prepend=-1))
            for a, b in zip(at, np.append(at[1:], len(p)), strict=True):
                i, j, own = int(cell[a]) // 64, int(cell[a]) % 64, p[a:b]
                for k in range(n := lots[i, j]):
                    rows.append((i, j, k, 0, own[(own >> np.uint64(7)) % np.uint64(n) == k].tobytes()))
                    if n > 1:  # the rest of the cell passes as guests that this lot has not met yet
                        rows.append((i, j, k, 1, own[(own >> np.uint64(7)) % np.uint64(n) > k].tobytes()))
                for di, dj in steps:
                    for k in range(lots.get((i + di, j + dj), 0)):
                        rows.append((i + di, j + dj, k, 1, own.tobytes()))
            rows = [r for r in rows if r[4]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int32()] * 4, pa.binary()), strict=True)], names=["i", "j", "lot", "guest", "prints"])

        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, held)) >= LOT:
                yield dealt()
        if held:
            yield dealt()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(pairs: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(pairs[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pairs], names=["a", "b"])

        class Cell:
            def __init__(self) -> None:
                self.own: list[bytes] = []
                self.home: Tiles | None = None
                self.pending: list[bytes] = []

            def opened(self) -> None:
                self.home = Tiles(np.frombuffer(b"".join(self.own), np.uint64)) if self.own else None
                self.own = []
                if self.home:
                    self.grove = Grove(len(self.home.prints))
                    compare(self.home, self.home, self.grove, 0, radius)

            def passed(self) -> tuple[np.ndarray, np.ndarray]:
                """Compares the guests that wait; their links to the homes."""
                guests = Tiles(np.frombuffer(b"".join(self.pending), np.uint64))
                self.pending, n = [], len(self.home.prints)
                both = Grove(n + len(guests.prints))
                both.up[:n] = self.grove.up
                compare(self.home, guests, both, n, radius)
                root = both.roots(np.arange(len(both.up)))
                self.grove.up = root[:n].copy()
                met = np.flatnonzero(root[n:] < n)
                return guests.prints[met], self.home.prints[root[n:][met]]

            def closed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                if self.own:
                    self.opened()
                if self.home:
                    if self.pending:
                        yield self.passed()
                    root = self.grove.roots(np.arange(len(self.home.prints)))
                    tied = np.flatnonzero(root != np.arange(len(root)))
                    yield self.home.prints[tied], self.home.prints[root[tied]]

        now, cell = None, Cell()
        for b in batches:
            for i, j, lot, guest, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (i, j, lot) != now:
                    for pairs in cell.closed():
                        yield from told(pairs)
                    now, cell = (i, j, lot), Cell()
                if not guest:
                    cell.own.append(data)
                    continue
                if cell.own:
                    cell.opened()
                if cell.home:
                    cell.pending.append(data)
                    if sum(map(len, cell.pending)) >= 8 * LOT:
                        yield from told(cell.passed())
        for pairs in cell.closed():
            yield from told(pairs)

    dealt = prints.select("print").mapInArrow(deal, "i int, j int, lot int, guest int, prints binary")
    n = max(shuffle_partitions(spark), sum(lots.values()) // 16)
    return dealt.repartition(n, "i", "j", "lot").sortWithinPartitions("i", "j", "lot", "guest").mapInArrow(meet, "a long, b long")


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    rows = cut(fingerprints(docs), "prints")
    firsts = cut(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "firsts")
    found = cut(links(firsts, radius), "near")
    linked = components(found).join(firsts, F.col("node") == F.col("print")).select("print", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    tied = cut(linked.join(least, "root").select("print", "least"), "tied")
    discard(found)
    alone = firsts.join(sized_broadcast(tied, MOST_BROADCAST), "print", "left").select("print", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return rows.join(alone, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their group (rows without doc_id stay), with the columns of docs."""
    lesser = groups(docs, radius).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(sized_broadcast(lesser, MOST_BROADCAST), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

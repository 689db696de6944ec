"""Collocations of two to four words, mined for each language by counting arrays under a minimal perfect hash.

Lower-cased (A-Z) texts are split at [.,;:!?\\x0A-\\x0D] into pieces and those into words [^\\x20\\x09]+. A phrase that
occurs LEAST times has only parts that do, so candidates grow word by word: nominate() counts keys (40 bits of a
hash of language and words) of those windows whose parts may all be frequent. Mappers send their counts as sparse
arrays in key order, a range of keys is summed in one place, and what reaches LEAST sets a bit in a table of
at most 2 ** TABLE_BITS bits. The table is what travels back: it grows with the text up to that size, and bits that several keys
share only let more candidates through. Counts travel with the tag (8 bits of a hash) of one text that has the
window; a second table holds, for each key that may be frequent, one such tag, so that a common phrase is
taken from few texts, not from every task. candidates() takes the windows all of whose parts have their bit from texts with
that tag, each once. A minimal perfect hash over them and their parts gives every key a slot; keys are stored by slot, so a
window that is no candidate is told from one. Mappers count slots in arrays (bincount), the arrays are summed
block by block in a tree, and the counts of a phrase and of its parts are read by slot. The hash is built in
shards of about SHARD_KEYS keys; at most ROUND_SHARDS of them are broadcast at once, and further rounds over the
corpus count the others, so a broadcast has a bound and no candidate is left out.

Null texts are empty, a null lang is "und"; rows that repeat count again, whatever their doc_id (which is not
looked at, nor is any other column). A table without words gives no rows. Phrases are told apart by 64-bit
hashes. A text is held whole in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import LOWER, cut, discard, mix, prefix_hash, raw_text, shuffle_partitions, span_hash, text_slices, total_bytes, words_of

LEAST = 30
LONGEST = 4
KEPT = 2000
#: A longer candidate with so many hundredths of a phrase's count takes its place.
TAKES = 80
#: The largest table of keys that may be frequent has 2 ** 27 bits (16 MB), whatever the corpus; a range of keys has 2 ** 17 of them if it can.
TABLE_BITS = 27
RANGE_BITS = 17
#: Bits of a key that travel with its count.
KEY_BITS = 40
#: Bytes of text for each range of keys that is summed in one place.
RANGE_BYTES = 4 << 20
#: Windows whose keys a mapper holds before it sends their counts.
FULL = 2_000_000
#: Keys of a shard of the hash, and shards that are broadcast at once (about 10 MB each).
SHARD_KEYS = 1 << 20
ROUND_SHARDS = 8
#: Slots whose counts travel together, and mappers' blocks that are summed at once.
BLOCK = 1 << 15
TREE = 32

_ENDS = np.zeros(256, np.uint8)
_ENDS[[0x20, 0x09]] = 1
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def parts_of(size: int) -> list[tuple[int, int]]:
    """(start, length) of a window's proper parts, short ones first."""
    return [(at, n) for n in range(1, size) for at in range(size - n + 1)]


class Pieces:
    """The words of a slice of texts as hashes that include the language, and which of them stand in one piece."""

    def __init__(self, batch: pa.RecordBatch):
        import xxhash

        raw, offsets = raw_text(batch.column(1))
        self.raw = LOWER[raw]
        ends = _ENDS[self.raw]
        self.starts, self.ends, doc = words_of(self.raw, offsets, _ENDS > 0)
        known: dict[str, int] = {}
        of = np.fromiter((known.setdefault(x, xxhash.xxh3_64_intdigest(x)) for x in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
        letters = prefix_hash(self.raw + np.uint64(1))
        word = mix(span_hash(letters, self.starts, self.ends) ^ of[doc])
        self.piece = np.cumsum(ends == 2, dtype=np.int64)[self.starts] + doc
        self.doc, self.sums = doc, prefix_hash(word)
        self.tag = (span_hash(letters, offsets[:-1], offsets[1:]) >> np.uint64(56))[doc]

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (first words) and keys of the windows of size words inside a piece."""
        last = len(self.piece) - size + 1
        at = np.flatnonzero(self.piece[:last] == self.piece[size - 1 :]) if last > 0 else np.empty(0, np.int64)
        return at, span_hash(self.sums, at, at + size)

    def likely(self, tables: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, keys) of the windows of up to longest words; of those with a table (one for each size) only what it lets through,
        of longer ones those whose parts of one word less are let through."""
        before = np.ones(len(self.piece) + 1, np.bool_)
        for size in range(1, longest + 1):
            at, key = self.grams(size)
            safe = before[at] & before[at + 1] if size > 1 else np.ones(len(at), np.bool_)
            at, key = at[safe], key[safe]
            if size <= len(tables):
                there = has(tables[size - 1], key)
                at, key = at[there], key[there]
            before = np.zeros(len(self.piece) + 1, np.bool_)
            before[at] = True
            yield size, at, key


def _bits(table: np.ndarray) -> int:
    return (8 * len(table) - 1).bit_length()


def has(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bits of keys are set."""
    place = key >> np.uint64(64 - _bits(table))
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _short(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(64 - KEY_BITS)


def _told(short: np.ndarray, tag: np.ndarray, bits: int) -> np.ndarray:
    """The last so many bits of the place of a key and tag in a table."""
    return mix(short ^ (tag << np.uint64(KEY_BITS))) & np.uint64((1 << bits) - 1)


def _packed(short: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(short, "<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // KEY_BITS, 8), np.uint8)
    out[:, : KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BITS // 8)
    return out.view("<u8").ravel()


def witnessed(table: np.ndarray, key: np.ndarray, tag: np.ndarray, step: int) -> np.ndarray:
    """Whether keys are to be taken from texts with these tags; the first step bits of a key's place are its own."""
    rest = _bits(table) - step
    place = key >> np.uint64(64 - step) << np.uint64(rest) | _told(_short(key), tag, rest)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def nominate(docs: DataFrame, tables: list[bytes], sizes: range, least: int, ranges: int) -> tuple[bytes, bytes]:
    """The tables of the keys of windows of these sizes that may occur least times, and of their tags. tables are those of the sizes below."""
    spark, step = docs.sparkSession, int(ranges).bit_length() - 1
    wide = min(TABLE_BITS, step + RANGE_BITS)
    told, seen = spark.sparkContext.broadcast(tables), min(least, 255)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.frombuffer(t, np.uint8) for t in told.value]
        held: list[np.ndarray] = []
        tags: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            key, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            tag = np.concatenate(tags)[first]
            held.clear()
            tags.clear()
            n = np.minimum(n, seen).astype(np.uint8)  # what alone reaches least says no more by more
            at = np.append(np.flatnonzero(np.diff(key >> np.uint64(KEY_BITS - step), prepend=np.uint64(1 << 63))), len(key))
            spans = list(zip(at[:-1], at[1:], strict=True))
            return pa.RecordBatch.from_arrays([pa.array([int(key[a]) >> (KEY_BITS - step) for a, _ in spans], pa.int32()), pa.array([_packed(key[a:b]) for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([tag[a:b].tobytes() for a, b in spans], pa.binary())], names=["part", "keys", "counts", "tags"])

        for b in text_slices(batches):
            p = Pieces(b)
            for size, at, key in p.likely(known, sizes[-1]):
                if size in sizes:
                    held.append(_short(key))
                    tags.append(p.tag[at].astype(np.uint8))
            if sum(map(len, held)) > FULL:
                yield sent()
        if sum(map(len, held)):
            yield sent()

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(part: int, held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
            keys, counts, tags = (b"".join(x) for x in zip(*held, strict=True))
            key, n, tag = _unpacked(keys), np.frombuffer(counts, np.uint8), np.frombuffer(tags, np.uint8)
            order = np.argsort(key, kind="stable")
            key, n, tag = key[order], n[order], tag[order]
            first = np.flatnonzero(np.diff(key, prepend=np.uint64(1 << 63)))
            often = first[np.add.reduceat(n, first, dtype=np.int64) >= least]
            rest = wide - step
            out = [pa.array([part], pa.int32())]
            for place in (key[often] >> np.uint64(KEY_BITS - wide) & np.uint64((1 << rest) - 1), _told(key[often], tag[often].astype(np.uint64), rest)):
                table = np.zeros(1 << rest, np.bool_)
                table[place] = True
                out.append(pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary()))
            return pa.RecordBatch.from_arrays(out, names=["part", "bits", "told"])

        for part, rows in _runs(batches, 1):
            yield closed(part[0], rows)

    sums = _texts(docs).mapInArrow(tally, "part int, keys binary, counts binary, tags binary").repartition(max(shuffle_partitions(spark), ranges // 8), "part").sortWithinPartitions("part")
    both = np.zeros((2, ranges, 1 << (wide - step - 3)), np.uint8)
    for part, *got in sums.mapInArrow(bits, "part int, bits binary, told binary").collect():
        for table, part_bits in zip(both, got, strict=True):
            table[part] = np.frombuffer(part_bits, np.uint8)
    told.destroy()
    return both[0].tobytes(), both[1].tobytes()


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each run of equal first columns, in order."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:n_keys] != now:
                if held:
                    yield now, held
                now, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield now, held


def candidates(docs: DataFrame, tables: list[bytes], tags: list[bytes], ranges: int, longest: int = LONGEST) -> DataFrame:
    """Every window of two words or more that the tables let through, once: key, lang, phrase, size, keys (its own, then its parts').
    tags are the tables of tags for two words, three words and so on."""
    told, step = docs.sparkSession.sparkContext.broadcast((tables, tags)), int(ranges).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tagged = ([np.frombuffer(t, np.uint8) for t in x] for x in told.value)
        seen = np.empty(0, np.uint64)
        for b in text_slices(batches):
            p = Pieces(b)
            langs, text = b.column(0).to_pylist(), p.raw.tobytes()
            for size, at, key in p.likely(known, longest):
                if size == 1:
                    continue
                mine = witnessed(tagged[size - 2], key, p.tag[at], step)
                at, key = at[mine], key[mine]
                key, first = np.unique(key, return_index=True)
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key
                    key, first = key[new], first[new]
                if not len(key):
                    continue
                at = at[first]
                seen = np.union1d(seen, key)
                if len(seen) > FULL:
                    seen = np.empty(0, np.uint64)
                words = [[text[p.starts[a + i] : p.ends[a + i]] for i in range(size)] for a in at]
                parts = np.stack([key, *(span_hash(p.sums, at + i, at + i + n) for i, n in parts_of(size))], axis=1)
                offsets = pa.array(np.arange(len(at) + 1) * parts.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64)), pa.array([langs[d] for d in p.doc[at]], pa.string()), pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string()), pa.array(np.full(len(at), size, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(parts.astype(np.int64).ravel()))],
                    names=["key", "lang", "phrase", "size", "keys"],
                )

    rows = cut(_texts(docs).mapInArrow(run, "key long, lang string, phrase string, size int, keys array<long>").dropDuplicates(["key"]), "candidates")
    told.destroy()
    return rows


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys: on each level a key alone at its place stays, the others go down one.

    Keys are stored by slot; slots() of other keys are -1.
    """

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.keys, self.levels, n = keys, [], 0
        for bits in levels:
            full = np.unpackbits(bits, bitorder="little").astype(np.bool_)
            slot = np.where(full, np.cumsum(full, dtype=np.int32) - 1 + n, -1).astype(np.int32)
            self.levels.append(slot)
            n += int(np.count_nonzero(full))

    @staticmethod
    def _places(key: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(key + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, order = np.asarray(keys, np.uint64), [], []
        while len(left):
            size = -(-max(2 * len(left), 64) // 8) * 8
            place = cls._places(left, len(levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            full = np.zeros(size, np.bool_)
            full[place[alone]] = True
            order.append(left[alone][np.argsort(place[alone])])
            levels.append(np.packbits(full, bitorder="little"))
            left = left[~alone]
        return cls(levels, np.concatenate(order) if order else np.empty(0, np.uint64))

    def slots(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        for i, level in enumerate(self.levels):
            if not len(left):
                break
            slot = level[self._places(key[left], i, len(level))]
            out[left[slot >= 0]] = slot[slot >= 0]
            left = left[slot < 0]
        found = np.flatnonzero(out >= 0)
        out[found[self.keys[out[found]] != key[found]]] = -1
        return out


def hash_shards(keys: DataFrame, shards: int) -> DataFrame:
    """shard, levels, keys of the perfect hash over keys(key), a shard for each range of them; built one shard in a task."""
    step = shards.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in _runs(batches, 1):
            made = PerfectHash.build(np.unique(np.array([k for (k,) in rows], np.int64).view(np.uint64)))
            levels = [np.packbits(level >= 0, bitorder="little").tobytes() for level in made.levels]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([levels], pa.list_(pa.binary())), pa.array([made.keys.tobytes()], pa.binary())], names=["shard", "levels", "keys"])

    part = F.shiftrightunsigned("key", 64 - step) if step else F.lit(0).cast("long")
    rows = keys.select(part.cast("long").alias("shard"), "key").repartition(shards, "shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, "shard long, levels array<binary>, keys binary")


def _loaded(rows: list) -> dict[int, PerfectHash]:
    return {r[0]: PerfectHash([np.frombuffer(x, np.uint8) for x in r[1]], np.frombuffer(r[2], np.uint64)) for r in rows}


def _shard_of(key: np.ndarray, step: int) -> np.ndarray:
    return (key >> np.uint64(64 - step)).astype(np.int64) if step else np.zeros(len(key), np.int64)


def _round(docs: DataFrame, rows: list, step: int, tables: list[bytes], longest: int) -> dict[int, np.ndarray]:
    """How often each key of these shards occurs, by shard and slot."""
    told = docs.sparkSession.sparkContext.broadcast((tables, [tuple(r) for r in rows]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = [np.frombuffer(t, np.uint8) for t in told.value[0]], _loaded(told.value[1])
        counts = {s: np.zeros(len(h.keys), np.int64) for s, h in hashes.items()}
        for b in text_slices(batches):
            for _, _, key in Pieces(b).likely(known, longest):
                shard = _shard_of(key, step)
                for s, h in hashes.items():
                    slot = h.slots(key[shard == s] if step else key)
                    counts[s] += np.bincount(slot[slot >= 0], minlength=len(h.keys))
        spans = [(s, at) for s, c in counts.items() for at in range(0, len(c), BLOCK) if c[at : at + BLOCK].any()]
        tag = TaskContext.get().partitionId()
        for s, at in spans:
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([at // BLOCK], pa.int64()), pa.array([tag], pa.int64()), pa.array([counts[s][at : at + BLOCK].tobytes()], pa.binary())], names=["shard", "block", "tag", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now = None, None
        for b in batches:
            for *key, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    if total is not None:
                        yield _block(now, total)
                    now, total = key, np.zeros(len(data) // 8, np.int64)
                total += np.frombuffer(data, np.int64)
        if total is not None:
            yield _block(now, total)

    def _block(key: list, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([total.tobytes()], pa.binary())], names=["shard", "block", "tag", "counts"])

    kind = "shard long, block long, tag long, counts binary"
    sums = _texts(docs).mapInArrow(count, kind)
    for fan in (TREE, 1):  # the leaves of a block are summed in TREE places, and those sums in one
        by = sums.withColumn("tag", F.pmod("tag", F.lit(fan)))
        sums = by.repartition(shuffle_partitions(docs.sparkSession), "shard", "block", "tag").sortWithinPartitions("shard", "block", "tag").mapInArrow(add, kind)
    out = {r["shard"]: np.zeros(len(r["keys"]) // 8, np.int64) for r in rows}
    for r in sums.collect():
        got = np.frombuffer(r["counts"], np.int64)
        out[r["shard"]][r["block"] * BLOCK : r["block"] * BLOCK + len(got)] = got
    told.destroy()
    return out


def counted(docs: DataFrame, found: DataFrame, tables: list[bytes], longest: int = LONGEST) -> DataFrame:
    """found (as of candidates()) with f: how often the phrase and each of its parts occur, in the order of keys."""
    spark = docs.sparkSession
    keys = found.select(F.explode("keys").alias("key")).distinct()
    keys = cut(keys, "keys")
    shards = 1 << max(0, (-(-keys.count() // SHARD_KEYS) - 1).bit_length())
    step = shards.bit_length() - 1
    hashes = cut(hash_shards(keys, shards), "hashes")
    rows = found.withColumn("f", F.transform("keys", lambda _: F.lit(0).cast("long")))
    for at in range(0, shards, ROUND_SHARDS):
        some = hashes.where((F.col("shard") >= at) & (F.col("shard") < at + ROUND_SHARDS)).collect()
        counts = _round(docs, some, step, tables, longest)
        told = spark.sparkContext.broadcast(([tuple(r) for r in some], {s: c.tobytes() for s, c in counts.items()}))

        def read(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            made, sums = _loaded(told.value[0]), {s: np.frombuffer(c, np.int64) for s, c in told.value[1].items()}
            for b in batches:
                lists = b.column(4).combine_chunks() if isinstance(b.column(4), pa.ChunkedArray) else b.column(4)
                key, f = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64), np.array(b.column(5).flatten(), np.int64)
                shard = _shard_of(key, step)
                for s, h in made.items():
                    own = np.flatnonzero(shard == s)
                    slot = h.slots(key[own])
                    f[own[slot >= 0]] = sums[s][slot[slot >= 0]]
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.ListArray.from_arrays(offsets, pa.array(f))], names=["key", "lang", "phrase", "size", "keys", "f"])

        rows = cut(rows.mapInArrow(read, "key long, lang string, phrase string, size int, keys array<long>, f array<long>"), "counts")
        told.destroy()
    discard(keys, hashes)
    return rows


def _cuts(size: int) -> Column:
    """The lowest-scoring cut of a phrase of size words: score, k, l, r; the first of equals."""
    at = {p: i + 1 for i, p in enumerate(parts_of(size))}
    f = lambda *p: F.col("f")[at[p]]
    wide = lambda c: c.cast("decimal(20,0)")
    ways = []
    for k in range(1, size):
        left, right = f(0, k), f(k, size - k)
        product, both = F.lit(2_000_000).cast("decimal(8,0)") * wide(F.col("f")[0]), wide(left) + wide(right)
        ways.append(F.struct(((product - product % both) / both).cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*ways))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, kept: int = KEPT) -> DataFrame:
    """The first kept phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    docs has lang and text. Score: 2,000,000 a / (l + r), floored, of the cut where that is least. A phrase
    inside a longer candidate with TAKES hundredths of its count or more is left out.
    """
    ranges = 1 << max(6, (total_bytes(docs) // RANGE_BYTES).bit_length())
    ranges = min(ranges, 1 << 16)
    tables, tags = [nominate(docs, [], range(1, 2), least, ranges)[0]], []
    for sizes in (range(2, 3), range(3, longest + 1)):  # longer windows are few after two tables, so they are counted together
        if sizes:
            table, tag = nominate(docs, tables, sizes, least, ranges)
            tables += [table] * len(sizes)
            tags += [tag] * len(sizes)
    found = candidates(docs, tables, tags, ranges, longest)
    rows = counted(docs, found, tables, longest).where(F.col("f")[0] >= least).withColumn("a", F.col("f")[0])
    inside = F.lit(None)
    for size in range(longest, 2, -1):
        inner = [i + 1 for i, (_, n) in enumerate(parts_of(size)) if n > 1]
        inside = F.when(F.col("size") == size, F.array(*(F.col("keys")[i] for i in inner))).otherwise(inside)
    if longest > 2:
        longer = rows.where("size > 2").select(F.explode(inside).alias("key"), "a").groupBy("key").agg(F.max("a").alias("above"))
        rows = rows.join(longer, "key", "left").where(F.col("above").isNull() | (100 * F.col("above") < TAKES * F.col("a")))
    best = F.lit(None)
    for size in range(2, longest + 1):
        best = F.when(F.col("size") == size, _cuts(size)).otherwise(best)
    total = docs.groupBy(F.coalesce("lang", F.lit("und")).cast("string").alias("lang")).agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t.,;:!?\n\x0B\f\r]+"))).cast("long").alias("n"))
    rows = rows.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod("key", F.lit(64)).alias("share"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    rows = rows.withColumn("rank", rank("lang", "share")).where(F.col("rank") <= kept).withColumn("rank", rank("lang")).where(F.col("rank") <= kept)
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

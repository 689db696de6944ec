"""Removal of repeated passages by prefix-free parsing of the corpus.

Every byte covered by a LENGTH-byte string that also starts earlier in the corpus (smaller doc_id, or
the same document before) goes; strings are judged on the input and don't cross documents.

Triggers: in each window of LENGTH bytes the GRAM-byte gram with the least rolling hash (the first of
equals) is the trigger; so equal windows have equal triggers at equal places, and no window is without.
Phrases: the consecutive windows of one trigger, with the bytes that they cover, make a phrase; phrases
overlap by LENGTH - 1 bytes, so none is a proper prefix of another's place in the parse.
Parse: the phrases of all documents meet by their trigger. Of equal phrases the first in corpus order
stays in the dictionary, and all windows of the others start earlier, whatever else the corpus holds.
Highly repetitive text thus shrinks to its dictionary before any suffix is looked at. Dictionary phrases
of a trigger that no other phrase has are unlike all others.
Suffixes: the other dictionary phrases (near the ends of repeated passages) are compared suffix by
suffix: their suffixes, cut off at LENGTH bytes, are sorted as strings, ties in corpus order, within
buckets of a common core that every one of them contains. Within a run of equal suffixes all but the
first start earlier. Where more than HOT dictionary phrases have one trigger (at the ends of a passage that
very many documents share), no bucket could hold their suffixes: those meet by 128-bit hashes of the
suffixes, spread by the hash, and a minimum takes the first.

Null and empty texts have no bytes. A null doc_id comes before all others. Rows of one doc_id are
documents of their own in the order of a hash of their texts; equal rows of one doc_id don't repeat
each other, but both lose what starts before. Whole texts of any length are parsed, long ones block by
block. Other columns are left as they are; dedupe() replaces those named like its results. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import as_bytes, cut, lean, mix, pack6, powers, prefix_hash, ragged, raw_text, shuffle_partitions, sized_broadcast, span_hash, text_slices, unpack6
from tallyforge.llm.jaccard_join import bucket_names

LENGTH = 100
GRAM = 32
#: Sub-ranges of a phrase's windows by their distance to the trigger; each has a core of LENGTH - STEP + 1 bytes.
STEP = 23
#: A text is parsed in blocks of so many bytes.
BLOCK = 1 << 20
#: Phrases of one trigger that a task sends to the parse (2 at least, so that the parse sees that there are several); others of it go to the suffixes directly.
MANY = 16
#: Dictionary phrases of one trigger beyond which suffixes meet by their hashes.
HOT = 4096
#: Ids that may be broadcast; beyond it the join shuffles.
MOST_BROADCAST = 500_000
_NO_ID = -(1 << 63)


def windows_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of the texts: first and last window start (in raw), trigger place, text; and the prefix hash of raw."""
    n, size = len(raw), np.diff(offsets)
    sums = prefix_hash(raw + np.uint64(1))
    many = np.maximum(size - LENGTH + 1, 0)
    if not many.any():
        none = np.empty(0, np.int64)
        return none, none, none, none, sums
    at = np.arange(n - GRAM + 1)
    low = np.uint64((1 << max(22, n.bit_length())) - 1)
    key = span_hash(sums, at, at + GRAM) & ~low | at.astype(np.uint64)
    width = 1
    while 2 * width <= LENGTH - GRAM + 1:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = LENGTH - GRAM + 1 - width
    least = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
    starts = ragged(offsets[:-1], many)
    trigger = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.diff(trigger, prepend=-1))
    last = np.append(new[1:], len(trigger)) - 1
    text = np.repeat(np.arange(len(size)), many)[new]
    return starts[new], starts[last], trigger[new], text, sums


_PACKED = "place int, bucket int, key binary, doc binary, spot binary, n binary, rel binary"


def _packed(names: list[int], bucket: int, key: np.ndarray, doc: np.ndarray, spot: np.ndarray, n: np.ndarray, rel: np.ndarray) -> pa.RecordBatch:
    blobs = (key.tobytes(), doc.astype("<i8").tobytes(), spot.astype("<i8").tobytes(), n.astype("u1").tobytes(), rel.astype("u1").tobytes())
    place = names[bucket if bucket >= 0 else (-1 - bucket) % len(names)]
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=["place", "bucket", "key", "doc", "spot", "n", "rel"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(raw, offsets, doc, print, offset in the document) of pieces of text, whole texts or blocks of long ones."""
    for b in text_slices(batches):
        doc = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        raw, offsets = raw_text(b.column(1))
        if len(raw) <= 2 * BLOCK:
            yield raw, offsets, doc, text_prints(raw, offsets), np.zeros(len(doc), np.int64)
        else:  # a single long text
            tp = text_prints(raw, offsets)
            for at in range(0, max(len(raw) - LENGTH + 1, 1), BLOCK):
                part = raw[at : at + BLOCK + LENGTH - 1]
                yield part, np.array([0, len(part)]), doc, tp, np.array([at])


def text_prints(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """31 bits of each text, by blocks, so that long texts need little memory."""
    out = np.empty(len(offsets) - 1, np.int64)
    if len(raw) <= 2 * BLOCK:
        sums = prefix_hash(raw + np.uint64(1))
        return (span_hash(sums, offsets[:-1], offsets[1:]) >> np.uint64(33)).astype(np.int64)
    h = np.uint64(len(raw))
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        h = mix(np.array([h]) + span_hash(prefix_hash(part + np.uint64(1)), np.array([0]), np.array([len(part)])))[0]
    out[:] = int(h >> np.uint64(33))
    return out


def _parse(batches: Iterator[pa.RecordBatch], names: list[int]) -> Iterator[pa.RecordBatch]:
    """Phrases packed by the bucket of their trigger; those known to repeat (bucket below 0, odd) or to be compared by suffix (even)."""
    held: list[tuple[np.ndarray, ...]] = []
    many = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, many
        if not held:
            return
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        held, many = [], 0
        repeat, edge, keep = _settle(cols, MANY)
        for odd, rows in ((1, repeat), (0, edge)):
            for i in range(0, len(rows), 200_000):
                r = rows[i : i + 200_000]
                key = np.frombuffer(pack6(cols[0][r]), np.uint8) if not odd else np.empty(0, np.uint8)
                yield _packed(names, -1 - (2 * int(cols[2][r[0]] % len(names)) + odd), key, *(x[r] for x in cols[2:]))
        bucket = (cols[0][keep] % np.uint64(len(names))).astype(np.int64)
        keep = keep[np.lexsort((cols[3][keep], cols[2][keep], bucket))]
        edges = np.searchsorted((cols[0][keep] % np.uint64(len(names))).astype(np.int64), np.arange(len(names) + 1))
        for k in np.flatnonzero(np.diff(edges)):
            r = keep[edges[k] : edges[k + 1]]
            both = np.frombuffer(pack6(cols[0][r]) + pack6(cols[1][r]), np.uint8)
            yield _packed(names, int(k), both, *(x[r] for x in cols[2:]))

    for raw, offsets, doc, tp, before in _blocks(batches):
        first, last, trigger, text, sums = windows_of(raw, offsets)
        if not len(first):
            continue
        gram = span_hash(sums, trigger, trigger + GRAM)
        phrase = mix(span_hash(sums, first, last + LENGTH) + (trigger - first).astype(np.uint64) * np.uint64(131))
        bits = np.uint64((1 << 48) - 1)
        spot = (tp[text] << 32) + before[text] + first - offsets[text]
        held.append((mix(gram) & bits, phrase & bits, doc[text], spot, (last - first + 1), (trigger - first)))
        many += len(first)
        if many > 300_000:
            yield from flush()
    yield from flush()


def _settle(cols: list[np.ndarray], most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, phrase, doc, spot, ..) that repeat an earlier equal phrase; that share their key with another phrase; the rest.

    With most, rows beyond so many phrases of a key count as the second kind; the third holds those up to it.
    Without, the third holds what is alone with its key.
    """
    key, phrase, doc, spot = cols[:4]
    order = np.lexsort((spot, doc, phrase, key))
    key, phrase, doc, spot = key[order], phrase[order], doc[order], spot[order]
    new_key = np.ones(len(key), np.bool_)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= phrase[1:] != phrase[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    same_place = (doc == doc[lead]) & (spot == spot[lead])
    repeat = ~new & ~same_place
    group = np.cumsum(new_key) - 1
    phrases = np.bincount(group, new)
    if most is None:
        shared = new & (phrases[group] > 1)
        return order[repeat], order[shared], order[new & ~shared]
    rank = np.cumsum(new) - 1
    rank -= rank[np.maximum.accumulate(np.where(new_key, np.arange(len(key)), 0))]
    return order[repeat], order[new & (rank >= most)], order[new & (rank < most)]


_MET = "kind int, doc long, spot long, n int, rel int, key long"


def _met(kind: int, doc: np.ndarray, spot: np.ndarray, n: np.ndarray, rel: np.ndarray, key: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(doc), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc[s]), kind), pa.int32()), pa.array(doc[s], pa.int64()), pa.array(spot[s], pa.int64()), pa.array(n[s].astype(np.int32)), pa.array(rel[s].astype(np.int32)), pa.nulls(len(doc[s]), pa.int64()) if key is None else pa.array(key[s], pa.int64())],
            names=["kind", "doc", "spot", "n", "rel", "key"],
        )


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: phrases that repeat an earlier one; 1: phrases whose suffixes are to be compared."""
    held: list[tuple] = []
    now = None

    def of() -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        repeat, shared, _ = _settle(cols, None)
        for kind, rows in ((0, repeat), (1, shared)):
            yield from _met(kind, *(x[rows] for x in cols[2:]), cols[0][rows].astype(np.int64) if kind else None)

    for b in batches:
        for bucket, key, *rest in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            doc, spot, n, rel = (np.frombuffer(x, k) for x, k in zip(rest, ("<i8", "<i8", "u1", "u1"), strict=True))
            if bucket < 0:
                odd = (-1 - bucket) % 2
                yield from _met(0 if odd else 1, doc, spot, n, rel, None if odd else unpack6(key).astype(np.int64))
                continue
            if bucket != now and held:
                yield from of()
                held.clear()
            now = bucket
            half = len(key) // 2
            held.append((unpack6(key[:half]), unpack6(key[half:]), doc, spot, n, rel))
    if held:
        yield from of()


_ENTRY = "place int, core long, doc long, spot long, first int, bytes binary"


def _sub_ranges(rows: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Of phrases (first window, windows, trigger's distance): number of the sub-range, place of its core, first and last window."""
    for start, n, rel in rows:
        trigger, end = start + rel, start + n - 1
        for j in range(-(-(LENGTH - GRAM + 1) // STEP)):
            lo, hi = max(start, trigger - STEP * j - STEP + 1), min(end, trigger - STEP * j)
            if lo <= hi:
                yield j, trigger - STEP * j, lo, hi


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the hot phrases (doc, text, spans) by their hashes."""
    for b in text_slices(batches):
        raw, offsets = raw_text(b.column(1))
        tp = text_prints(raw, offsets)
        for i, (doc, spans) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            rows = [(x["spot"] & 0xFFFFFFFF, x["n"]) for x in spans if x["hot"] and x["spot"] >> 32 == tp[i]]
            if not rows:
                continue
            first, n = np.array(rows).T
            at = ragged(first, n)
            for a in range(0, len(at), 20_000):
                some = at[a : a + 20_000]
                window = np.lib.stride_tricks.sliding_window_view(raw[offsets[i] : offsets[i + 1]], LENGTH)[some].astype(np.uint64) + np.uint64(1)
                two = [mix((mix(window + np.uint64(k)) * powers(LENGTH)[0]).sum(axis=1, dtype=np.uint64)).view(np.int64) for k in (1 << 20, 3 << 20)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, two), pa.array(np.full(len(some), doc)), pa.array((int(tp[i]) << 32) + some)], names=["h", "g", "doc", "spot"])


def _suffixes(batches: Iterator[pa.RecordBatch], names: list[int]) -> Iterator[pa.RecordBatch]:
    """The bytes of each phrase's windows by sub-range (doc, text, spans), with the hash of their core; equal ones of a task once.

    Entries that repeat an earlier one of the task come with core -1 and the number of their windows as first.
    """
    held: dict[bytes, tuple[int, int]] = {}
    gone: list[tuple[int, int, int]] = []
    full = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal full
        rows = [(int.from_bytes(k[:8], "little", signed=True), *v, k[8], k[9:]) for k, v in held.items()] + [(-1, d, s, n, b"") for d, s, n in gone]
        held.clear()
        gone.clear()
        full = 0
        for i in range(0, len(rows), 20_000):
            core, doc, spot, first, data = zip(*rows[i : i + 20_000], strict=True)
            place = [names[(c if c >= 0 else d) % len(names)] for c, d in zip(core, doc, strict=True)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((place, core, doc, spot, first, data), kinds, strict=True)], names=["place", "core", "doc", "spot", "first", "bytes"])

    for b in text_slices(batches):
        raw, offsets = raw_text(b.column(1))
        tp = text_prints(raw, offsets)
        docs = b.column(0).to_pylist()
        for i, (doc, spans) in enumerate(zip(docs, b.column(2).to_pylist(), strict=True)):
            base = int(offsets[i])
            text = raw[base : int(offsets[i + 1])].tobytes()
            rows = sorted((x["spot"] & 0xFFFFFFFF, x["n"], x["rel"]) for x in spans if not x["hot"] and x["spot"] >> 32 == tp[i])
            for j, at, lo, hi in _sub_ranges(rows):
                core = text[at : at - STEP + 1 + LENGTH]
                h = (hash_bytes(core) ^ j) & ((1 << 63) - 1)
                name = h.to_bytes(8, "little") + bytes([at - lo]) + text[lo : hi + LENGTH]
                mine = (doc, (int(tp[i]) << 32) + lo)
                had = held.get(name)
                if had is None:
                    held[name] = mine
                    full += len(name)
                elif had != mine:
                    if mine < had:
                        held[name], mine = mine, had
                    gone.append((*mine, hi - lo + 1))
            if full > 12 << 20 or len(gone) > 200_000:
                yield from flush()
    yield from flush()


def hash_bytes(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def _sorted_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that start earlier: doc, spot, n (runs of window starts). Rows come sorted by core."""
    held: list[tuple] = []
    size = 0

    def of() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        rows = sorted(held, key=lambda x: (x[1], x[2]))
        held, size = [], 0
        n = np.array([len(r[4]) - LENGTH + 1 for r in rows])
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        starts = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        owner = np.repeat(np.arange(len(rows)), n)
        at = ragged(starts, n)
        rel = np.array([r[3] for r in rows])[owner] - (at - starts[owner])
        core = np.array([r[0] for r in rows])[owner]
        suffix = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]
        # the core's number and place first: only suffixes of one core can be equal
        full = np.concatenate([np.ascontiguousarray(core, "<i8").view(np.uint8).reshape(-1, 8), rel.astype(np.uint8)[:, None], suffix], axis=1)
        _, first, same = np.unique(np.ascontiguousarray(full).view(f"V{LENGTH + 9}").ravel(), return_index=True, return_inverse=True)
        doc, spot = np.array([r[1] for r in rows])[owner], np.array([r[2] for r in rows])[owner] + (at - starts[owner])
        lead = first[same]
        late = np.flatnonzero((doc != doc[lead]) | (spot != spot[lead]))
        if len(late):
            new = np.flatnonzero(np.diff(late, prepend=-2) != 1) if len(late) else late
            new = np.union1d(new, np.flatnonzero(np.diff(owner[late], prepend=-1)))
            count = np.diff(new, append=len(late))
            yield from _met(0, doc[late[new]], spot[late[new]], count, count * 0)

    group: list[tuple] = []
    for b in batches:
        for core, doc, spot, first, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if core < 0:
                yield from _met(0, np.array([doc]), np.array([spot]), np.array([first]), np.array([0]))
                continue
            if group and group[0][0] != core:
                if len(group) > 1:
                    held += group
                    size += sum(len(x[4]) for x in group)
                group = []
                if size > 1 << 20:
                    yield from of()
            group.append((core, doc, spot, first, data))
    if len(group) > 1:
        held += group
    if held:
        yield from of()


def repeats(docs: DataFrame) -> DataFrame:
    """doc (doc_id, the least long for null) and spans (spot: 31 bits of the text's print and the first window start; n: windows)."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    names = bucket_names(spark, n)
    texts = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    parsed = texts.mapInArrow(lean(lambda it: _parse(it, names)), _PACKED).repartition(n, "place").drop("place").sortWithinPartitions("bucket")
    met = cut(parsed.mapInArrow(lean(_dictionary), _MET), "dictionary")
    edge = met.where("kind = 1")
    hot = cut(edge.groupBy("key").agg(F.count("*").alias("often")).where(F.col("often") > HOT).select("key", F.lit(True).alias("hot")), "hot")
    marked = edge.join(sized_broadcast(hot, MOST_BROADCAST), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    edges = marked.groupBy("doc").agg(F.collect_list(F.struct("spot", "n", "rel", "hot")).alias("spans"))
    with_edges = texts.join(sized_broadcast(edges.select("doc"), MOST_BROADCAST), "doc", "left_semi").join(edges, "doc").select("doc", "text", "spans")
    entries = with_edges.mapInArrow(lean(lambda it: _suffixes(it, names)), _ENTRY).repartition(n, "place").drop("place").sortWithinPartitions("core")
    late = cut(entries.mapInArrow(lean(_sorted_suffixes), _MET), "suffixes")
    spans = met.where("kind = 0").unionByName(late).select("doc", "spot", "n")
    if hot.limit(1).count():
        windows = cut(with_edges.where(F.exists("spans", lambda x: x["hot"])).mapInArrow(lean(_hashed), "h long, g long, doc long, spot long"), "windows")
        first = cut(windows.groupBy("h", "g").agg(F.min(F.struct("doc", "spot")).alias("m"), F.count("*").alias("c")).where("c > 1").select("h", "g", "m"), "first")
        again = windows.join(first, ["h", "g"]).where(F.struct("doc", "spot") != F.col("m")).select("doc", "spot", F.lit(1).alias("n"))
        spans = spans.unionByName(again)
    return spans.groupBy("doc").agg(F.collect_list(F.struct("spot", "n")).alias("spans"))


RESULTS = ("n_bytes", "n_removed", "spans", "kept")


def dedupe(docs: DataFrame) -> DataFrame:
    """docs with n_bytes, n_removed, spans (array of start and end of the removed runs, in bytes) and kept (the other bytes)."""
    return _deduped(docs).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in RESULTS), *RESULTS)


def _deduped(docs: DataFrame) -> DataFrame:
    """_row (the columns of docs) and the results of dedupe."""
    spans = cut(repeats(docs), "repeats")
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    ids = sized_broadcast(spans.select(F.col("doc").alias("_doc")), MOST_BROADCAST)
    hit = rows.join(ids, "_doc", "left_semi").join(spans.select(F.col("doc").alias("_doc"), F.col("spans").alias("_spans")), "_doc")
    row_type = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            raw, offsets = raw_text(b.column(1))
            tp = text_prints(raw, offsets)
            texts, sizes, removed, runs, kept = as_bytes(b.column(1)), [], [], [], []
            for i, (text, found) in enumerate(zip(texts, b.column(3).to_pylist(), strict=True)):
                edge = np.zeros(len(text) + 1, np.int32)
                mine = [(x["spot"] & 0xFFFFFFFF, x["n"]) for x in found if x["spot"] >> 32 == tp[i]]
                if mine:
                    a, k = np.array(mine).T
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + k - 1 + LENGTH, -1)
                off = np.cumsum(edge[:-1]) > 0
                change = np.flatnonzero(np.diff(off, prepend=False, append=False)).reshape(-1, 2)
                sizes.append(len(text))
                removed.append(int(off.sum()))
                runs.append([{"start": int(x), "end": int(y)} for x, y in change])
                kept.append(np.frombuffer(text, np.uint8)[~off].tobytes())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], names=["_row", "n_bytes", "n_removed", "spans", "kept"])

    done = hit.select("_doc", "_text", "_row", "_spans").mapInArrow(lean(run), f"_row {row_type}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    whole = rows.join(ids, "_doc", "left_anti").select(
        "_row", F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.col("_text").cast("binary").alias("kept")
    )
    return done.unionByName(whole)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages taken out of text (a character goes if all its bytes do) and n_chars, if there, counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(as_bytes(b.column(0).fill_null("")), b.column(1).to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans:
                    a, z = s["start"], s["end"]
                    while a < len(text) and text[a] & 0xC0 == 0x80:
                        a += 1
                    while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
                        z -= 1
                    parts.append(text[at:a])
                    at = max(a, z)
                out.append(b"".join([*parts, text[at:]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(2)], names=["_new", "_row"])

    packed = _deduped(docs).select(F.col("_row.text").alias("text"), "spans", "_row")
    new = packed.mapInArrow(lean(run), f"_new string, _row {packed.schema['_row'].dataType.simpleString()}")
    changed = {"text": F.when(F.col("_row.text").isNotNull(), F.col("_new")).alias("text"), "n_chars": F.length("_new").cast("long").alias("n_chars")}
    return new.select(*(changed.get(c, F.col(f"_row.`{c}`").alias(c)) for c in docs.columns))

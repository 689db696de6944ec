"""Set similarity join of word n-gram sets by universe partitions, and the groups that its links form.

Two texts link when the Jaccard similarity of their sets of word 5-grams is at least PERCENT / 100. Such
sets differ in at most H = (|X| + |Y|) * (100 - P) / (100 + P) elements, so at most 2|Y| (100 - P) / (100 + P)
for the larger one, Y. The universe of shingles is hashed into segments, their number chosen by size
band; by the pigeonhole principle some segment is equal in both sets as soon as the larger one has more
than H filled segments, so sets that link share the signature of a segment. Sets near the lower end of a
band's size range also sign in the band below it, so that pairs across a border meet.

Allocation by cost: a segment shared by more than HOT groups of near copies is no evidence and gets
budget 0. A set whose filled segments of budget 1 don't exceed H signs again in the next scheme: first
the same segments with their one-deletion neighbourhoods (budget 2: a segment may then differ by one
element), then ever finer segments. A pair meets where one of its sets first has budget enough; the
other one signs there too, as it has
not enough either; if it has, the pair meets in an earlier scheme by the same argument. Sets that no
scheme gives enough budget (most of their shingles are in many unrelated texts) are joined by the rarest
elements of both (prefix filtering), without a limit. Candidates are verified exactly on the sets.

Groups of copies: equal sets are one set throughout. Near copies are first gathered into stars (a leader
and sets with a verified link to it, found by minimum hashes), and in a signature's group each star is
seen once, so candidates are pairs of stars. Of two stars the members of the smaller one meet the leader
P of the larger one. They first meet by their sketches (counts and sums of the shingles in hash ranges,
some four to a range), which bound their difference from below; only pairs that may still matter bring
their sets together. With D(x) the symmetric difference of x and P, members x of P's star and the others y
satisfy |x & y| = |P| - |P - x| - |P - y| + |D(x) & D(y)|, so if y doesn't link with P, a link of x and y
needs a common element of D(x) and D(y), and that number of them decides. Those pairs are found by prefix
filtering on the differences (rarest elements first), so no members are paired for being in one star. Links
inside a star need no check: its members are in one component already.

Null, empty and blank texts have no shingles and link with nothing, not even with each other. A text of
1 to 4 words is one shingle. Rows with one doc_id count as one document's texts, and each row is
returned; a row without doc_id is in no pair and has no component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import binary_rows, cut, discard, lean, mix, pack6, ragged, raw_text, shingle_sets, shuffle_partitions, sized_broadcast, text_slices, unpack6

PERCENT = 75
#: Distinct stars of a signature beyond which it counts as no evidence.
HOT = 8
#: Ratio of a size band's ends, and signing schemes after the first.
BAND = 2.0
SCHEMES = 4
MINHASHES = 6
#: Rows of two ids that may be broadcast; beyond it the join shuffles.
MOST_BROADCAST = 500_000
#: Signatures that a task holds before it deals them: what bounds a worker's memory there.
MOST_HELD = 200_000
#: Signatures of a bucket that are compared at once (all those of a value, however many), and bytes of text that are signed at once.
MOST_COMPARED = 400_000
SIGNED_BYTES = 1 << 18
#: Elements to a range of a sketch.
RANGE = 4


def most_different(size: np.ndarray, percent: int) -> np.ndarray:
    """H for pairs whose larger set has that size."""
    return 2 * size * (100 - percent) // (100 + percent)


def bands() -> np.ndarray:
    """Lower ends of the size bands: 1, 2, 4, ..."""
    return np.unique((BAND ** np.arange(40)).astype(np.int64))


def segments(upper: int, percent: int, scheme: int) -> int:
    """How many segments a band with sets of up to upper elements uses."""
    need = int(most_different(np.array(upper), percent)) + 1
    m = need
    while m * (1 - np.exp(-upper / m)) < need * 1.04 + 2 * np.sqrt(need) * 0.35 and m < 4 * upper:
        m += max(1, m // 25)
    return m * (4 ** (scheme - 1) if scheme > 1 else 1)


def need(size: np.ndarray, percent: int, largest: np.ndarray | None = None) -> np.ndarray:
    """The most that a set of that size can differ from a partner (of at most largest elements)."""
    partner = 100 * size // percent
    return (size + (partner if largest is None else np.minimum(partner, largest))) * (100 - percent) // (100 + percent)


def signatures(sets: list[np.ndarray], percent: int, scheme: int) -> tuple[np.ndarray, ...]:
    """Of each signature: its set (index), its value, its role (0: own band, 1: next band). Then of each set its slack
    in both roles: the budget of its segments less what it needs to have more than (a large number where it has no part).

    scheme 0: segments; 1: segments with one-deletion neighbourhoods; 2 and more: finer segments.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(size) - size
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    low = bands()
    own = np.searchsorted(low, size, "right") - 1
    filled, reach = np.flatnonzero(size), np.flatnonzero((size > 0) & (100 * size >= percent * low[own + 1]))
    who, band = np.concatenate([filled, reach]), np.concatenate([own[filled], own[reach] + 1])
    role = (np.arange(len(who)) >= len(filled)).astype(np.int64)
    counts = {int(b): segments(int(low[b + 1]) - 1, percent, scheme) for b in np.unique(band)}
    count = np.array([counts[int(b)] for b in band], np.int64)
    each = size[who]
    row = np.repeat(np.arange(len(who)), each)
    item = flat[ragged(starts[who], each)]
    part = ((mix(item ^ np.uint64(0xA5A5A5A5)) >> np.uint64(32)) * count[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    first = np.cumsum(count) - count
    slot = first[row] + part
    order = np.argsort(slot, kind="stable")
    slot, item, row = slot[order], mix(item[order] + np.uint64(0x9E37)), row[order]
    edge = np.flatnonzero(np.diff(slot, prepend=-1))
    n_in = np.diff(edge, append=len(slot))
    sums = np.add.reduceat(item, edge) if len(edge) else np.empty(0, np.uint64)
    seg_row = row[edge]
    tag = mix((band[seg_row].astype(np.uint64) << np.uint64(40)) + (slot[edge] - first[seg_row]).astype(np.uint64) * np.uint64(64) + np.uint64(scheme))
    value = mix(sums + tag)
    budget = np.bincount(seg_row, np.where(n_in > 1, 2, 1) if scheme == 1 else None, len(who)).astype(np.int64)
    asked = np.where(role == 0, need(each, percent, low[band + 1] - 1), need(each, percent))
    slack = np.full((len(sets), 2), 1 << 30)
    slack[who, role] = budget - asked
    if scheme != 1:
        return who[seg_row], value, role[seg_row], slack
    seg = np.repeat(np.arange(len(edge)), n_in)
    some = np.flatnonzero(n_in[seg] > 1)
    gone = mix(sums[seg[some]] - item[some] + tag[seg[some]])
    return np.concatenate([who[seg_row], who[row[some]]]), np.concatenate([value, gone]), np.concatenate([role[seg_row], role[row[some]]]), slack


def documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, print (128 bits of the set), keys (MINHASHES minimum hashes), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            sets = shingle_sets(*raw_text(b.column(1)))
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            at = np.concatenate([[0], np.cumsum(size)])
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(k)))]) for k in (1, 2)]
            prints = np.stack([mix(x[at[1:]] - x[at[:-1]] + size.astype(np.uint64)) for x in sums], axis=1)
            filled = np.flatnonzero(size)
            keys = np.zeros((len(sets), MINHASHES), np.uint64)
            if len(filled):
                for k in range(MINHASHES):
                    keys[filled, k] = np.minimum.reduceat(mix(flat ^ np.uint64(0xD1B54A32 * (k + 1))), at[filled])
            lists = pa.FixedSizeListArray.from_arrays(pa.array((keys >> np.uint64(1)).astype(np.int64).ravel()), MINHASHES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), binary_rows(list(prints), "<u8"), lists, binary_rows(sketches(flat, size), "u1")], names=["doc_id", "n_shingles", "print", "keys", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, print binary, keys array<long>, sketch binary")


def sketches(flat: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """For each set the counts, then the sums modulo 256, of its elements in a power of two of hash ranges."""
    bits = np.maximum(np.log2(np.maximum(size, 1) / RANGE).astype(np.int64), 0)
    ranges = np.where(size > 0, 1 << bits, 0)
    first = np.cumsum(ranges) - ranges
    owner = np.repeat(np.arange(len(size)), size)
    place = first[owner] + np.where(bits[owner] > 0, flat >> (64 - bits[owner]).astype(np.uint64) % np.uint64(64), 0).astype(np.int64)
    total = int(ranges.sum())
    count = np.minimum(np.bincount(place, minlength=total), 255).astype(np.uint8)
    value = (np.bincount(place, (mix(flat) & np.uint64(255)).astype(np.float64), total).astype(np.int64) & 255).astype(np.uint8)
    return [np.concatenate([count[a : a + k], value[a : a + k]]) for a, k in zip(first, ranges, strict=True)]


def least_different(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets by their sketches; the finer one is folded."""
    x, y = x.reshape(2, -1).astype(np.int64), y.reshape(2, -1).astype(np.int64)
    while x.shape[1] > y.shape[1]:
        x = x.reshape(2, -1, 2).sum(axis=2)
    while y.shape[1] > x.shape[1]:
        y = y.reshape(2, -1, 2).sum(axis=2)
    gap = np.abs(x[0] - y[0])
    # ranges of equal counts but other sums differ by one element on each side
    return int(gap.sum() + 2 * np.count_nonzero((gap == 0) & ((x[1] - y[1]) & 255 != 0)))


def lacking(a_only: np.ndarray, b_only: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """What the elements that only a or only b has cost, less what a set a of that size allows: at most 0 if the two link."""
    return 100 * a_only + percent * b_only - (100 - percent) * size


def likely(pairs: DataFrame, ends: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b, wide) that may lack wide at most, by sizes and sketches; ends: node, n_shingles, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide, n, m = (b.column(i).to_numpy() for i in (2, 3, 4))
            low = [least_different(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)]
            low = np.maximum(np.array(low, np.int64), np.abs(n - m))
            yield b.filter(pa.array(lacking(low + n - m, low + m - n, 2 * n, percent) <= 2 * wide)).select(["a", "b", "wide"])

    end = lambda c, n, x: ends.select(F.col("node").alias(c), F.col("n_shingles").alias(n), F.col("sketch").alias(x))
    both = pairs.join(end("a", "n", "x"), "a").join(end("b", "m", "y"), "b")
    return both.select("a", "b", "wide", "n", "m", "x", "y").mapInArrow(lean(run), "a long, b long, wide long")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, items (the set as sorted u64) of the nodes of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), binary_rows(shingle_sets(*raw_text(b.column(1))), "<u8")], names=["node", "items"])

    wanted = sized_broadcast(ids.select(F.col("node").alias("doc_id")).distinct(), MOST_BROADCAST)
    return docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text").mapInArrow(lean(run), "node long, items binary")


def verify(pairs: DataFrame, docs: DataFrame, ends: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b, wide) those that lack wide at most: with size (of a), lack, a_only and b_only (numbers) and, where
    wide is not 0 or the two link, delta (the elements that only one of them has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for wide, x, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                twice = both[1:] == both[:-1]
                same = int(np.count_nonzero(twice))
                lack = int(lacking(len(x) - same, len(y) - same, len(x), percent))
                single = ~(np.append(twice, False) | np.append(False, twice)) if lack <= wide else None
                got.append((len(x), lack, len(x) - same, len(y) - same, None if single is None else both[single].view("<i8")))
            cols = list(zip(*got, strict=True)) or [[]] * 5
            kinds = (*[pa.int64()] * 4, pa.list_(pa.int64()))
            found = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["a", "b", "wide", "size", "lack", "a_only", "b_only", "delta"])
            yield found.filter(pa.array([x[4] is not None for x in got], pa.bool_()))

    pairs = cut(likely(pairs, ends, percent), "pairs")
    sets = cut(sets_of(docs, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))), "sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "wide", "x", "y")
    found = cut(both.mapInArrow(lean(run), "a long, b long, wide long, size long, lack long, a_only long, b_only long, delta array<long>"), "verified")
    discard(sets, pairs)
    return found


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of the nodes of links(a, b), by large-star and small-star rounds."""

    def told(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    links = cut(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "links")
    now = told(links)
    while True:
        few = F.broadcast if 2 * now[0] <= MOST_BROADCAST else (lambda df: df)
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = cut(both.join(few(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(few(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "small")
        discard(large, links)
        before, now, links = now, told(new), new
        if before == now:
            return links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def bucket_names(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions a number that lands there, so that as many buckets fill all partitions alike."""
    rows = spark.range(40 * n + 400).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), F.col("id")).groupBy("p").agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in rows]


def _first_of_stars(value: np.ndarray, nodes: np.ndarray, stars: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in the order of value and star, one for each star (its smallest node), with the row's rank within its value.

    roles are bits (1: own band, 2: next band); a star's row has those of all its members.
    """
    order = np.argsort(value, kind="stable")
    value, nodes, stars, roles = value[order], nodes[order], stars[order], roles[order]
    same = value[1:] == value[:-1]
    again = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if len(again):
        inner = again[np.lexsort((nodes[again], stars[again], value[again]))]
        nodes[again], stars[again], roles[again] = nodes[inner], stars[inner], roles[inner]
    new = np.ones(len(value), np.bool_)
    new[1:] = ~same | (stars[1:] != stars[:-1])
    if len(value):
        roles = np.bitwise_or.reduceat(roles, np.flatnonzero(new))
    value, nodes, stars = value[new], nodes[new], stars[new]
    edge = np.flatnonzero(np.diff(value.view(np.int64), prepend=-1))
    rank = np.arange(len(value)) - np.repeat(edge, np.diff(edge, append=len(value)))
    return value, nodes, stars, roles, rank


_PACKED = "place int, bucket int, told boolean, value binary, node binary, run binary, star binary, role binary"


def _lost(stars: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stars of rows of hot values, with the number of rows of each in both roles."""
    star, slot = np.unique(stars, return_inverse=True)
    lost = np.stack([np.bincount(slot.ravel(), roles & 1, len(star)), np.bincount(slot.ravel(), roles >> 1, len(star))], axis=1)
    return star, lost.astype(np.int64)


def _packed(names: list[int], bucket: int, value: np.ndarray, node: np.ndarray, star: np.ndarray, role: np.ndarray, told: bool = True) -> pa.RecordBatch:
    """One row of rows: six bytes a value, one a role; of a run of one node the node and the run's length, and the stars only if some differ from the nodes."""
    edge = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (star[1:] != star[:-1]))) if len(node) else np.empty(0, np.int64)
    heads = star[edge]
    blobs = (pack6(value), node[edge].astype("<i8").tobytes(), np.diff(edge, append=len(node)).astype("<u4").tobytes(), b"" if (heads == node[edge]).all() else heads.astype("<i8").tobytes(), role.astype("u1" if bucket >= 0 else "<i4").tobytes())
    place = names[bucket if bucket >= 0 else -1 - bucket]
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([bucket], pa.int32()), pa.array([told]), *(pa.array([x], pa.binary()) for x in blobs)], names=["place", "bucket", "told", "value", "node", "run", "star", "role"])


def _unpacked(bucket: int, node: bytes, run: bytes, star: bytes, role: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, star and role as _packed got them."""
    n, run = np.frombuffer(node, "<i8"), np.frombuffer(run, "<u4")
    heads = np.frombuffer(star, "<i8") if star else n
    return np.repeat(n, run), np.repeat(heads, run), np.frombuffer(role, "u1" if bucket >= 0 else "<i4").astype(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch], percent: int, scheme: int, names: list[int], hot: int) -> Iterator[pa.RecordBatch]:
    """Signatures of (node, star, text), packed by bucket: of a value each star once, and few more stars than make it hot.

    Rows of bucket -1 - b tell bucket b the slack of nodes (value empty, role the slack of both roles by turns);
    those not told (of no node) say how many hot values a star has that were left out.
    """
    held: list[tuple[np.ndarray, ...]] = []
    many = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, many
        if not held:
            return
        value, nodes, stars, roles, rank = _first_of_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held, many = [], 0
        if (over := np.flatnonzero(rank >= hot + 2)).size:
            star, lost = _lost(stars[over], roles[over])
            yield _packed(names, -1 - int(star[0] % len(names)), np.empty(0, np.uint64), star * 0, star, lost.ravel(), told=False)
            few = rank < hot + 2
            value, nodes, stars, roles = value[few], nodes[few], stars[few], roles[few]
        bucket = (value % np.uint64(len(names))).astype(np.int64)
        order = np.argsort(bucket * (1 << 40) + (nodes & ((1 << 40) - 1)), kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(len(names) + 1))
        for k in np.flatnonzero(np.diff(edges)):
            r = order[edges[k] : edges[k + 1]]
            yield _packed(names, int(k), value[r], nodes[r], stars[r], roles[r])

    for b in text_slices(batches, SIGNED_BYTES, column=2):
        node, star = b.column(0).to_numpy(), b.column(1).to_numpy()
        who, value, role, slack = signatures(shingle_sets(*raw_text(b.column(2))), percent, scheme)
        held.append((value & np.uint64((1 << 48) - 1), node[who], star[who], 1 << role))
        many += len(value)
        yield _packed(names, -1 - int(node[0] % len(names)), np.empty(0, np.uint64), node, star, np.clip(slack, -1, 1 << 30).ravel())
        if many > MOST_HELD:
            yield from flush()
    yield from flush()


def _candidates(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """kind 0: pairs (a, b) of different stars with a common value; 1: slack (b, c) of node a in star d; 2: lost budget (b, c) of star a."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 100_000):
            cols = [np.ascontiguousarray(x[i : i + 100_000], np.int64) for x in (a, b, c, d)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind), pa.int32()), *map(pa.array, cols)], names=["kind", "a", "b", "c", "d"])

    def lot(packed: list[tuple], k: int, lots: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of stars, and rows of a hot star with its lost budget, of the k-th of lots of a bucket's values."""
        held = []
        for bucket, value, *rest in packed:
            value = unpack6(value)
            mine = np.flatnonzero(mix(value) % np.uint64(lots) == k)
            held.append((value[mine], *(x[mine] for x in _unpacked(bucket, *rest))))
        value, nodes, stars, roles, _ = _first_of_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        edge = np.flatnonzero(np.diff(value.view(np.int64), prepend=-1))
        size = np.diff(edge, append=len(value))
        usual = (size > 1) & (size <= hot)
        pairs = [np.empty((0, 2), np.int64)]
        for n in np.unique(size[usual]):
            rows = edge[usual & (size == n)]
            left, right = np.triu_indices(int(n), 1)
            pairs.append(np.sort(np.stack([stars[(rows[:, None] + left).ravel()], stars[(rows[:, None] + right).ravel()]], axis=1), axis=1))
        star, lost = _lost(*(x[np.repeat(size > hot, size)] for x in (stars, roles)))
        return np.unique(np.concatenate(pairs), axis=0), np.column_stack([star, lost])

    def of(packed: list[tuple]) -> Iterator[pa.RecordBatch]:
        """What a bucket's rows give, compared in lots of its values, so that memory doesn't grow with the bucket."""
        lots = max(1, -(-sum(len(x[1]) // 6 for x in packed) // MOST_COMPARED))
        pairs, over = zip(*(lot(packed, k, lots) for k in range(lots)), strict=True)
        pair = np.unique(np.concatenate(pairs), axis=0)
        yield from out(0, pair[:, 0], pair[:, 1], pair[:, 0] * 0, pair[:, 0] * 0)
        gone = np.concatenate(over)
        star, at = np.unique(gone[:, 0], return_inverse=True)
        own, up = (np.bincount(at.ravel(), gone[:, i], len(star)).astype(np.int64) for i in (1, 2))
        yield from out(2, star, own, up, star * 0)

    held: list[tuple] = []
    now = None
    for b in batches:
        for bucket, told, value, *rest in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if bucket < 0:
                node, star, role = _unpacked(bucket, *rest)
                two = role.reshape(-1, 2)
                if told:
                    yield from out(1, node, two[:, 0], two[:, 1], star)
                else:
                    yield from out(2, star, two[:, 0], two[:, 1], star * 0)
                continue
            if bucket != now and held:
                yield from of(held)
                held = []
            now = bucket
            held.append((bucket, value, *rest))
    if held:
        yield from of(held)


def _meet(nodes: DataFrame, percent: int, scheme: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of the stars of nodes(node, star, text) under a scheme, and the nodes whose budget there is not enough."""
    spark = nodes.sparkSession
    n = shuffle_partitions(spark)
    names = bucket_names(spark, n)
    packed = nodes.select("node", "star", "text").mapInArrow(lean(lambda it: _buckets(it, percent, scheme, names, hot)), _PACKED)
    dealt = packed.repartition(n, "place").drop("place").sortWithinPartitions("bucket")
    found = cut(dealt.mapInArrow(lean(lambda it: _candidates(it, hot)), "kind int, a long, b long, c long, d long"), "met")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    lost = found.where("kind = 2").groupBy(F.col("a").alias("star")).agg(F.sum("b").alias("lost_own"), F.sum("c").alias("lost_up"))
    have = found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("own"), F.col("c").alias("up"), F.col("d").alias("star"))
    each = 2 if scheme == 1 else 1
    left = have.join(lost, "star", "left")
    short = left.where((F.col("own") - each * F.coalesce("lost_own", F.lit(0)) <= 0) | (F.col("up") - each * F.coalesce("lost_up", F.lit(0)) <= 0))
    return pairs, short.select("node").distinct()


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    rows = cut(documents(docs), "prints")
    filled = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = cut(filled.groupBy("print").agg(F.min(F.struct("doc_id", "n_shingles", "keys", "sketch")).alias("m")).select("print", F.col("m.doc_id").alias("node"), "m.n_shingles", "m.keys", "m.sketch"), "same")
    ends = same.select("node", "n_shingles", "sketch")

    # ids with several texts stay stars of their own, and their sets meet one by one
    single = same.groupBy("node").agg(F.count("*").alias("n"), F.first("keys").alias("keys")).where("n = 1")
    keys = single.select("node", F.posexplode("keys").alias("k", "key"))
    leaders = keys.groupBy("k", "key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    met = keys.join(leaders, ["k", "key"]).where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    nearest = met.where("n > 1").groupBy("node").agg(F.array_distinct(F.array(F.min("leader"), F.max_by("leader", F.struct("n", -F.col("leader"))))).alias("leaders"))
    tested = verify(nearest.select(F.explode("leaders").alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("wide")), docs, ends, percent)
    linked = tested.groupBy("b").agg(F.min(F.struct("a", "a_only", "b_only", "delta")).alias("m"))
    member = cut(same.select("node").distinct().join(linked.select(F.col("b").alias("node"), "m.*"), "node", "left").select("node", F.coalesce("a", "node").alias("star"), "a_only", "b_only", "delta"), "members")
    stars = member.select("node", "star")

    todo, met_stars = stars, None
    for scheme in range(SCHEMES + 1):
        if scheme < SCHEMES:
            texts = docs.select(F.col("doc_id").alias("node"), "text").join(sized_broadcast(todo, MOST_BROADCAST), "node")
            pairs, short = _meet(texts, percent, scheme)
        else:
            pairs, short = _prefix_pairs(sets_of(docs, todo), todo, percent), None
        met_stars = pairs if met_stars is None else met_stars.unionByName(pairs)
        if short is None:
            break
        todo = cut(todo.join(short, "node", "left_semi"), "short")
        if not todo.limit(1).count():
            break
    tested = verify(_outside(met_stars, member, percent), docs, ends, percent)
    links = member.where("node <> star").select(F.col("star").alias("a"), F.col("node").alias("b"))
    links = links.unionByName(tested.where("lack <= 0").select("a", "b"))
    links = links.unionByName(_by_difference(tested.where("lack > 0"), member, percent)).unionByName(_of_one_id(filled, same))
    roots = components(links)
    mine = same.select("print", "node").join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("root"))
    return rows.join(mine, "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def _of_one_id(filled: DataFrame, same: DataFrame) -> DataFrame:
    """Links between the sets of one doc_id: each with that of the least print."""
    several = filled.groupBy("doc_id").agg(F.min("print").alias("least"), F.max("print").alias("print")).where("least <> print").select("doc_id", "least")
    node = lambda c, n: same.select(F.col("print").alias(c), F.col("node").alias(n))
    return filled.select("doc_id", "print").join(several, "doc_id").join(node("print", "a"), "print").join(node("least", "b"), "least").where("a <> b").select("a", "b").distinct()


def _prefix_pairs(sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Pairs of stars of the last sets, whose shingles are nearly all common: those that share one of the rarest of both.

    With the elements in one order (rarest first), the smaller set X and the larger set Y of a link share one among
    the first |X| - ceil(2 P |X| / (100 + P)) + 1 of X and the first |Y| - ceil(P |Y| / 100) + 1 of Y, and what is left
    behind it must suffice for the common elements that a link needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(items, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node)), pa.array(x), pa.array(np.full(len(x), len(x)))], names=["node", "item", "n"])

    rows = cut(sets.mapInArrow(lean(run), "node long, item long, n long"), "elements")
    often = rows.groupBy("item").agg(F.count("*").alias("df"))
    first = F.row_number().over(Window.partitionBy("node").orderBy("df", "item"))
    size, place = F.col("n"), F.col("k")
    prefix = rows.join(often, "item").withColumn("k", first).where(place <= size - F.ceil(size * percent / 100) + 1)
    less = F.max(place <= size - F.ceil(2 * percent * size / (100 + percent)) + 1)
    found = prefix.where("df > 1").join(stars, "node").groupBy("item", "star").agg(less.alias("less"), F.min(size).alias("low"), F.max(size).alias("high"), F.max(size - place + 1).alias("rest"))
    one = cut(found, "prefixes")
    other = one.select("item", *(F.col(c).alias(f"b_{c}") for c in ("star", "low", "high", "rest")))
    fits = (F.col("star") != F.col("b_star")) & (F.col("low") <= F.col("b_high")) & (percent * F.col("b_low") <= 100 * F.col("high"))
    enough = (100 + percent) * F.least("rest", "b_rest") >= percent * (F.col("low") + F.col("b_low"))
    pairs = one.where("less").join(other, "item").where(fits & enough)
    return pairs.select(F.least("star", "b_star").alias("a"), F.greatest("star", "b_star").alias("b")).distinct()


def _outside(met: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Of met stars (a, b) not in one component already: pairs of the larger one's leader a and the other's members b, with wide,
    the most that a set may lack to link with a and still link with a member of a's star."""
    wide = F.coalesce(F.max(percent * F.col("a_only") + 100 * F.col("b_only")), F.lit(0)).cast("long")
    size = cut(member.groupBy("star").agg(F.count("*").alias("n"), wide.alias("wide"), F.max(F.when(F.col("node") == F.col("star"), 1)).alias("own")), "sizes")
    end = lambda c: size.select(F.col("star").alias(c), F.col("n").alias(f"{c}_n"), F.col("wide").alias(f"{c}_wide"))
    chained = size.where("own IS NULL").select(F.col("star").alias("node"))
    above = cut(member.join(chained, "node").where("node <> star").select("node", F.col("star").alias("up")), "above")
    few = sized_broadcast(above, MOST_BROADCAST)
    both = met.distinct().join(end("a"), "a").join(end("b"), "b")
    for c in "ab":
        both = both.join(few.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")), c, "left")
    top = lambda c: F.coalesce(f"{c}_up", c)
    both = both.where(top("a") != top("b"))
    larger = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    turned = both.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("star"), F.when(larger, F.col("a_wide")).otherwise(F.col("b_wide")).alias("wide"))
    return turned.join(member.select(F.col("node").alias("b"), "star"), "star").where("a <> b").select("a", "b", "wide").distinct()


def _by_difference(far: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Links of sets b that lack something to link with a leader a, and members of a's star, by their differences to a."""
    inside = member.where("node <> star").join(far.select(F.col("a").alias("star")).distinct(), "star", "left_semi")
    inside = inside.select(F.col("star").alias("a"), F.col("node").alias("x"), (100 * F.col("a_only") + percent * F.col("b_only")).alias("cost"), F.col("delta").alias("inner"))
    per = 100 + percent
    often = inside.select("a", F.explode("inner").alias("item")).groupBy("a", "item").agg(F.count("*").alias("df"))

    def rarest(rows: DataFrame, node: str, delta: str, least: F.Column) -> DataFrame:
        """The elements of which two sets with least common ones share one."""
        each = rows.select("a", node, (F.size(delta) - F.ceil(least / per) + 1).alias("most"), F.explode(delta).alias("item")).join(often, ["a", "item"], "left")
        order = Window.partitionBy("a", node).orderBy(F.coalesce("df", F.lit(0)), "item")
        return each.withColumn("k", F.row_number().over(order)).where("k <= most AND df IS NOT NULL").select("a", "item", node)

    outer = far.select("a", F.xxhash64("b", "delta").alias("y"), "b", "lack", "delta")
    met = rarest(inside, "x", "inner", F.col("cost") + 1).join(rarest(outer, "y", "delta", F.col("lack") + percent), ["a", "item"]).select("a", "x", "y").distinct()
    both = met.join(inside, ["a", "x"]).join(outer, ["a", "y"])
    return both.where(per * F.size(F.array_intersect("inner", "delta")) >= F.col("cost") + F.col("lack")).select(F.col("x").alias("a"), "b").distinct()


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their group (rows without doc_id stay), with the columns of docs."""
    lesser = groups(docs, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(sized_broadcast(lesser, MOST_BROADCAST), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

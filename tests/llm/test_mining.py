"""Collocations, SimHash and turn repair against brute force, with nulls, empties, ties, repeats, clashing columns and empty tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tallyforge.llm import collocations, decontamination, jaccard_join, ordinal_quality, packing, simhash, token_blocks, turn_repair
from tallyforge.llm.queries import vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- collocations -----------------------------------------------------------------------------------------------------


def mined(rows, least, kept=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                f.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    inside = defaultdict(int)
    for (lang, w), a in cands.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(inside[lang, w[i:j]], a)
    for (lang, w), a in cands.items():
        if 100 * inside[lang, w] >= 80 * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, got in out.items() for i, (s, a, p, left, right) in enumerate(sorted(got)[:kept], 1)}


def sentences(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéZ#") for _ in range(rng.randint(1, 4))) for _ in range(25)]
    phrases = [[rng.choice(words) for _ in range(rng.randint(2, 5))] for _ in range(6)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.choice([0, 1, 5, 40])):
            out += rng.choice(phrases) if rng.random() < 0.4 else [rng.choice(words)]
            out.append(rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r", "\x0b"]))
        rows.append((i, " ".join(x.strip(" ") or x for x in out), rng.choice(["en", "de", None])))
    return [*rows, (n, None, "en"), (n + 1, "", None), (n + 2, " ,;\n", "fr"), (None, rows[0][1], "en"), (0, rows[0][1], rows[0][2]), (n + 3, "a " * 3000, "en")]


def asked(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("least,kept,full", [(5, 2000, 2_000_000), (3, 7, 50)])
def test_collocations(spark, least, kept, full, monkeypatch):
    monkeypatch.setattr(collocations, "FULL", full)
    rows = sentences(least, 120)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, KEY int, phrase string").repartition(5)
    want = mined(rows, least, kept)
    assert len(want) > 10
    assert asked(collocations.mine(docs, least, kept=kept)) == want


def test_collocations_in_rounds_of_shards(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_KEYS", 40)
    monkeypatch.setattr(collocations, "ROUND_SHARDS", 2)
    monkeypatch.setattr(collocations, "BLOCK", 16)
    rows = sentences(9, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert asked(collocations.mine(docs, 4)) == mined(rows, 4)


def test_collocations_of_tables_without_words(spark):
    for rows in ([], [(1, None, None), (2, ". , !", "en")]):
        assert collocations.mine(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() == []


def test_perfect_hash_is_minimal_and_tells_other_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    made = collocations.PerfectHash.build(keys[::2])
    assert sorted(made.slots(keys[::2])) == list(range(len(keys[::2])))
    assert (made.slots(keys[1::2]) == -1).all()
    assert (made.keys[made.slots(keys[::2])] == keys[::2]).all()
    assert len(collocations.PerfectHash.build(np.empty(0, np.uint64)).slots(keys)) == len(keys)


# -- SimHash ----------------------------------------------------------------------------------------------------------


def print_of(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, radius=3):
    """Least doc_id by fingerprint, over all pairs."""
    values = sorted({p for _, p in prints})
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[top(b)] = top(a)
    least = {}
    for d, p in prints:
        if d is not None:
            least[top(p)] = min(least.get(top(p), d), d)
    return {p: least.get(top(p)) for p in values}


def test_simhash_groups(spark):
    rng = random.Random(4)
    words = [f"Wört{i}" for i in range(400)]
    rows = []
    for i in range(200):
        if i % 3 and rows:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 60, 300]))]
        rows.append((i, rng.choice([" ", "\n", "\x0b "]).join(w)))
    rows += [(200, None), (201, ""), (None, rows[0][1]), (None, "alone in the world it stands"), (5, rows[3][1]), (202, "x " * 9000)]
    docs = spark.createDataFrame([(d, t, 0, "k") for d, t in rows], "doc_id long, text string, Print int, fingerprint string").repartition(4)
    prints = [(d, print_of(t)) for d, t in rows]
    of = linked(prints)
    assert len(set(of.values())) < len(of)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(docs).collect()), key=str)
    assert got == sorted(((d, f"{p:016x}", of[p]) for d, p in prints), key=str)


@pytest.mark.parametrize("tile,cell,lot", [(1024, 1 << 17, 1 << 16), (4, 8, 16)])
def test_tiles_find_every_near_pair(spark, tile, cell, lot, monkeypatch):
    for name, value in (("TILE", tile), ("CELL", cell), ("LOT", lot)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(tile)
    base = rng.getrandbits(64)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    values = {0, (1 << 64) - 1, base, *(flip(base, rng.randint(1, 9)) for _ in range(500)), *(rng.getrandbits(64) for _ in range(300))}
    for v in list(values)[:100]:
        values |= {flip(v, 3), flip(v, 4)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "print long").repartition(3)
    links = simhash.links(frame).collect()
    assert len(links) < 30 * len(values)
    parent = {v: v for v in signed}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() > 0
        parent[max(top(a), top(b))] = min(top(a), top(b))
    want = linked([(i, v) for i, v in enumerate(sorted(values))])
    ours = defaultdict(set)
    for v in values:
        ours[top(v - (1 << 64) if v >> 63 else v)].add(v)
    theirs = defaultdict(set)
    for v in values:
        theirs[want[v]].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_of_an_empty_table_and_keep_one(spark):
    kind = "doc_id long, text string, KEPT int"
    assert simhash.groups(spark.createDataFrame([], kind)).collect() == []
    rows = [(3, "a b c d", 1), (1, "A b C d", 2), (None, "a b c d", 3), (2, "q r s t u v w", 4)]
    got = simhash.keep_one(spark.createDataFrame(rows, kind))
    assert got.columns == ["doc_id", "text", "KEPT"]
    assert sorted(r.KEPT for r in got.collect()) == [2, 3, 4]


# -- turn repair ------------------------------------------------------------------------------------------------------

BLANK = " \t\n\x0b\f\r"


def planted(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(roles, gone, late):
    """Least (cost, audit) by search in that order over all edits; roles: initials."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(roles) and last in ("", "a"):
            return cost, audit, made
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt[last], (*made, (None, nxt[last]))))
        if i < len(roles):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, made))
            if not gone[i]:
                if roles[i] == nxt[last] or (roles[i] == "s" and not last):
                    heapq.heappush(heap, (cost + late[i], audit + "K", i + 1, roles[i], (*made, (i, None))))
                heapq.heappush(heap, (cost + 2 + late[i], audit + "R", i + 1, nxt[last], (*made, (i, nxt[last]))))
    raise AssertionError


def repairs(rows):
    live, out = defaultdict(list), {}
    for r in planted(rows):
        live[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        mine = sorted(live[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        turns = {r[1] for r in mine if r[1] is not None}
        seen, counts, gone, late = set(), Counter(), [], []
        for _, _, role, text in mine:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            gone.append(fault in ("blank", "duplicate"))
            late.append(int(fault == "truncated"))
        initials = [r[2][:1] for r in mine]
        cost, audit, made = cheapest(initials, gone, late)
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[r] if r else mine[i][2]}:{mine[i][3] if i is not None else ''}" for i, r in made]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant", None, "Uncle", "ursula"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(["Yes.", "No!", "so\n", " \t", "", None, "a\nb?", "long. text", "é…", "x!\x0b "])))
    return [*rows, *((None, t, r, "fine.") for t, r in enumerate(["user", "assistant"])), *[rows[0]] * 3, *((n, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(300))]


def result(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_turn_repair(spark, seed):
    rows = talks(seed, 150)
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, Place int, signs string").repartition(5)
    assert result(turn_repair.repaired(turn_repair.damaged(frame))) == repairs(rows)


def test_turn_repair_of_dropped_and_empty_conversations(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    kind = "conv_id long, turn long, role string, text string"
    got = result(turn_repair.repaired(turn_repair.damaged(spark.createDataFrame([(lost, 0, "user", "Hi.")], kind))))
    assert got == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert result(turn_repair.repaired(turn_repair.damaged(spark.createDataFrame([], kind)))) == {}


def test_turn_repair_takes_one_layer_for_each_shared_prefix(monkeypatch):
    calls = []
    plain = turn_repair.grown
    monkeypatch.setattr(turn_repair, "grown", lambda layer, sign: calls.append(sign) or plain(layer, sign))
    trie = turn_repair.Trie()
    signs = sorted(["suaua", "suaua", "suauX", "sua", "uaoA", "uaoo", ""])
    for s in signs:
        trie.enter(s)
    prefixes = {s[:i] for s in signs for i in range(len(s) + 1)}
    assert len(calls) == len(prefixes)


# -- the same cases for operators of earlier rounds -------------------------------------------------------------------

ODD = "doc_id long, text string, N_TOKENS int, ids string, Start string, item_id long, expected_grade string, g string, w string, h string"


def odd(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", "s", 9, "e", "g", "w", "h") for r in rows], ODD).repartition(2)


def test_leaks_of_clashing_columns_repeated_rows_and_empty_tables(spark):
    item = "one two three four five six seven eight"
    rows = [(1, f"before {item} after"), (1, f"before {item} after"), (1, "nothing else"), (None, item), (2, None), (3, ""), (4, item.upper())]
    docs, items = odd(spark, rows), spark.createDataFrame([(7, item, "x"), (7, item, "x"), (8, None, "x"), (None, item, "x")], "item_id long, text string, DOC_ID string")
    assert sorted(tuple(r) for r in decontamination.leaks(docs, items.drop("DOC_ID")).collect()) == [(1, 7, 4, 4), (4, 7, 4, 4)]
    got = decontamination.clean(docs, items)
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, item), (2, None), (3, "")], key=str)
    assert decontamination.leaks(docs.limit(0), items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0
    assert decontamination.clean(docs, items.limit(0)).count() == len(rows)
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_grades_of_clashing_columns_and_repeated_rows(spark):
    rows = [(i, f"good words number {i} and more of them") for i in range(30)] + [(None, None), (3, "good words"), (3, "good words")]
    docs = odd(spark, rows)
    ratings = spark.createDataFrame([(i, i % 3, "z") for i in range(30)] + [(3, 0, "z"), (None, 1, "z")], "doc_id long, grade int, TEXT string")
    got = ordinal_quality.score(docs, ordinal_quality.fit(docs, ratings.drop("TEXT"))).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((d for d, _ in rows), key=str)
    assert len({r.expected_grade for r in got if r.doc_id == 3}) <= 2 and all(0 <= r.expected_grade <= 2 for r in got)


def test_token_files_and_packing_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "no name"), (None, None), (2, "twice"), (2, "twice"), (2, "another"), (1, "")]
    docs = odd(spark, rows)
    back = token_blocks.round_trip(docs, vocabulary("word_bpe_49k.json")).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, None, 1, 2, 2, 2] and [r.start for r in back] == list(np.cumsum([0, *(r.n_tokens for r in back)])[:-1])
    packed = packing.pack(docs, vocabulary("byte_bpe_50k.json"), size=8).collect()
    assert sorted((r.doc_id for r in packed if r.piece == 0), key=str) == sorted((d for d, _ in rows), key=str)
    held = defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 8 and [o for o, _ in sorted(x)] == list(np.cumsum([0, *(n for _, n in sorted(x))])[:-1]) for x in held.values())

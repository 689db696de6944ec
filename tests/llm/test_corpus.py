"""The corpus operators against brute force on small tables with nulls, empties, ties, copies and clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyforge.llm import decontamination, html_text, jaccard_join, ordinal_quality, packing, quality_rules, sharding, suffix_dedup, token_blocks, tokens, toxicity
from tallyforge.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        kind = rng.randint(0, 6)
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 30, 200])))
        if kind == 1 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 2 and rows:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(max(1, len(w) // 60)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        elif kind == 3:
            text = f"{text}\n{passage}\n{text[::-1]}"
        rows.append((i, text, rng.choice(["en", "de", None]), "s", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \n\t ", "en", "s", 4), (n + 3, "x" * 350, "en", "s", 350), (n + 4, "A b C d", "en", "s", 7), (n + 5, "a B c D", "en", "s", 7)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows, percent=75):
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


@pytest.mark.parametrize("hot", [8, 1])
def test_jaccard_groups(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join._meet, "__defaults__", (hot,))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(docs).collect()}
    assert got == groups(corpus())


def _met(monkeypatch, rows, hot):
    """kind and columns of what _candidates finds of rows (node, star, role) that share one value."""
    import pyarrow as pa

    node, star, role = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    monkeypatch.setattr(jaccard_join, "signatures", lambda *_: (np.arange(len(node)), np.full(len(node), 7, np.uint64), role, np.ones((len(node), 2), np.int64)))
    batch = pa.RecordBatch.from_arrays([pa.array(node), pa.array(star), pa.array(["a"] * len(node))], names=["node", "star", "text"])
    packed = [b.drop_columns(["place"]) for b in jaccard_join._buckets(iter([batch]), 75, 0, [0], hot)]
    return [tuple(r.values()) for b in jaccard_join._candidates(iter(packed), hot) for r in b.to_pylist()]


@pytest.mark.parametrize("others", [[11], [1, 2, 3]])
@pytest.mark.parametrize("roles", [(1, 0), (0, 1)])
def test_lost_budget_counts_for_both_sides_of_a_band_border(monkeypatch, others, roles):
    rows = [(10, 10, roles[0]), (12, 10, roles[1]), *((k, k, 0) for k in others)]
    lost = {a: (b, c) for kind, a, b, c, _ in _met(monkeypatch, rows, 1) if kind == 2}
    assert lost == {10: (1, 1)} | {k: (1, 0) for k in others}


def test_slack_of_negative_ids_is_told(monkeypatch):
    rows = [(-5, -5, 0), (3, 3, 0), (4, 4, 0), (6, 6, 0)]
    met = _met(monkeypatch, rows, 1)
    assert sorted(a for kind, a, *_ in met if kind == 1) == [-5, 3, 4, 6]
    assert {a: (b, c) for kind, a, b, c, _ in met if kind == 2} == {a: (1, 0) for a in (-5, 3, 4, 6)}


@pytest.mark.parametrize("edits", ["words", "cuts", "both"])
def test_jaccard_of_one_large_group_of_near_copies(spark, edits, monkeypatch):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    same = [word() for _ in range(3)]
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        w = list(base)
        if edits != "cuts":
            for _ in range(rng.randint(1, 9)):
                w[rng.randrange(120)] = rng.choice([word(), *same])
        if edits != "words":
            w = w[rng.randint(0, 40) :] if i % 2 else w[: 120 - rng.randint(0, 40)]
        rows.append((i, " ".join(w)))
    rows += [(300 + i, " ".join([word() for _ in range(60)] + base[: rng.randint(30, 110)])) for i in range(60)]
    rows += [(400 + i, " ".join(word() for _ in range(rng.randint(1, 90)))) for i in range(60)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)


def test_jaccard_of_null_ids_and_of_two_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (5, a), (5, b), (2, a + " end"), (7, b), (9, c), (None, c), (9, None), (8, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 26, None), (5, 26, 2), (5, 26, 2), (2, 27, 2), (7, 26, 2), (9, 26, 9), (None, 26, None), (9, 0, 9), (8, 0, 8)], key=str)


def test_jaccard_keep_one_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 1, 2, 3), (2, "a b c d e f g", 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long, n_shingles long, node long")
    assert [tuple(r) for r in jaccard_join.keep_one(docs).collect()] == rows[:1]


def test_jaccard_of_nothing(empty):
    assert jaccard_join.groups(empty).count() == 0


def test_enough_segments_settle_every_pair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * rng.uniform(0.8, 1))), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 6)), dtype=np.int64).astype(np.uint64)]))
        if 100 * len(np.intersect1d(x, y)) < 75 * len(np.union1d(x, y)):
            continue
        for scheme in range(jaccard_join.SCHEMES):
            who, value, _, slack = jaccard_join.signatures([x, y], 75, scheme)
            if (slack[0] > 0).all() or (slack[1] > 0).all():
                assert set(value[who == 0]) & set(value[who == 1])


def brute_repeats(rows):
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        mark = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                mark[s : s + 100] = True
            seen.add(data[s : s + 100])
        runs = np.flatnonzero(np.diff(mark, prepend=False, append=False)).reshape(-1, 2).tolist()
        out[doc_id] = (len(data), int(mark.sum()), runs, np.frombuffer(data, np.uint8)[~mark].tobytes())
    return out


@pytest.mark.parametrize(("many", "hot"), [(16, 4096), (2, 4096), (16, 2)])
def test_suffix_dedup(docs, many, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, [[s.start, s.end] for s in r.spans], bytes(r.kept)) for r in suffix_dedup.dedupe(docs).collect()}
    assert got == brute_repeats(corpus())


def test_suffix_dedup_of_null_and_equal_ids(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcd ") for _ in range(150))
    rows = [(None, passage), (1, "x" + passage), (1, "y" + passage), (2, None), (2, passage)]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 150, 0), (1, 151, 150), (1, 151, 150), (2, 0, 0), (2, 150, 150)]


def test_suffix_dedup_of_clashing_columns(spark):
    rows = [(1, "a" * 50, 9, "s", 8, "k", "r"), (2, "b" * 350, 9, "s", 8, "k", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Bytes long, spans string, n_removed long, KEPT string, _row string")
    got = [tuple(r) for r in suffix_dedup.keep_first(docs).orderBy("doc_id").collect()]
    assert got == [rows[0], (2, "b", *rows[1][2:])]
    out = suffix_dedup.dedupe(docs)
    assert out.columns == ["doc_id", "text", "_row", "n_bytes", "n_removed", "spans", "kept"] and out.count() == 2


def test_suffix_dedup_long_text_by_blocks(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("ab ") for _ in range(9000))
    rows = [(1, text + text[:700]), (2, text[300:5000] + "zz" * 40)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, [[s.start, s.end] for s in r.spans], bytes(r.kept)) for r in suffix_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows)


def test_suffix_dedup_keeps_columns_and_characters(docs, empty):
    out = suffix_dedup.keep_first(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_dedup.keep_first(empty).count() == 0


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, corpus()[10][1] or "q w e r t z"), (2, "nothing of this is anywhere in there"), (3, ""), (4, None), (5, "a b c d"), (None, "a b c d")], "item_id long, text string")
    want = set()
    for item in items.collect():
        s = shingles(item.text)
        for r in corpus():
            if item.item_id is not None and s and 100 * len(s & shingles(r[1])) >= 75 * len(s):
                want.add((r[0], item.item_id))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert got == want
    assert {r.doc_id for r in decontamination.clean(docs, items).collect()} == {r[0] for r in corpus()} - {d for d, _ in want}


def test_sharding(spark, docs, tmp_path):
    root = str(tmp_path / "store")
    assert sorted(map(str, sharding.stored(docs, root).collect())) == sorted(map(str, docs.collect()))
    store = sharding.ShardStore(spark, root, docs.schema)
    version = store.version()
    store.append(docs)
    assert store.read(version + 1).count() == 2 * docs.count() and store.read(version).count() == docs.count()
    with pytest.raises(sharding.CommitConflict):
        store._commit(version, [])
    assert sharding.ShardStore(spark, str(tmp_path / "none"), docs.schema).read().count() == 0


def test_sharding_of_clashing_columns_and_null_ids(spark, tmp_path):
    rows = [(None, "a", 1, None), (None, "b", None, "x"), (3, None, 2, "y"), (3, None, 2, "y")] + [(None, str(i), i, "z") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Arrival int, _ARRIVAL string")
    store = sharding.ShardStore(spark, str(tmp_path / "s"), docs.schema)
    store.append_all(docs, 4)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert len(store.manifest()["runs"]) == 4
    store.append(docs.limit(0))
    assert store.read().count() == len(rows)


def test_sharding_tiers_sizes_and_retained_versions(spark, tmp_path):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "sha2(CAST(id AS STRING), 512) AS text")
    store = sharding.ShardStore(spark, str(tmp_path / "s"), docs.schema, target_bytes=300_000)
    for i in range(5):
        store.append(docs.where(f"doc_id % 5 = {i}").coalesce(2))
    before = store.version()
    after = store.compact()
    runs = store.manifest()["runs"]
    assert after > before and len(runs) < sharding.FAN
    assert all(r["largest"] <= 2 * 300_000 for r in runs) and sum(r["files"] for r in runs) >= 8
    assert store.read(before).count() == store.read(after).count() == 40_000  # readers of the version before go on
    assert store.vacuum() > 0 and store.read().count() == 40_000
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        store.read(before).count()


def test_sharding_survives_dying_writers(spark, docs, tmp_path):
    root = tmp_path / "s"
    store = sharding.ShardStore(spark, str(root), docs.schema)
    version = store.append(docs)
    docs.write.parquet(str(root / "runs" / "dead"))  # a job that died before its commit
    (root / "manifest" / f"v{version + 1:08d}.json").write_text('999\n{"version"')  # and one that died in it
    assert store.version() == version and store.read().count() == docs.count()
    assert store.sweep(older_than_s=3600) == 0 and store.sweep(older_than_s=-60) == 1
    assert store.read().count() == docs.count()
    with pytest.raises(sharding.CommitConflict):  # so fresh a manifest may still be being written
        store.append(docs)
    late = sharding.ShardStore(spark, str(root), docs.schema, stale_s=-60)
    assert late.append(docs) == version + 2 and late.versions() == [version, version + 2]
    assert late.append(docs) == version + 3 and late.read().count() == 3 * docs.count()
    body = json.dumps({"version": version + 1, "base": version, "runs": []})  # the writer was slow, not dead
    (root / "manifest" / f"v{version + 1:08d}.json").write_text(f"{len(body)}\n{body}")
    assert late.versions() == [version, version + 2, version + 3] and late.read().count() == 3 * docs.count()
    late.sweep(older_than_s=-60)
    assert not (root / "manifest" / f"v{version + 1:08d}.json").exists() and late.vacuum() == 0 and late.read().count() == 3 * docs.count()


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint32)
    ids[rng.random(n) < 0.02] = 2**32 - 1
    f = token_blocks.TokenFile(token_blocks.write_file([5, None], np.array([n, 0]), ids))
    assert f.doc_ids == [5, None] and (f.read() == ids).all()
    assert (f.read(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def _own(name, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]


ODD = ["", "  a  b", "\n\n x", "Ünïcode ÀÉ straße ﬁ Σ ς İ", "don't we'll '", "a b c", "<|endoftext|> x", "日本語 text", "é né", "1234 a1b2 $$%%", "<|startoftext|>a"]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", tokens.ByteTokenizer), ("word_bpe_49k.json", tokens.WordTokenizer)])
def test_tokenizers_agree(name, kind):
    texts = [r[1] or "" for r in corpus()] + ODD
    flat, counts = kind(vocabulary(name)).encode(texts)
    want = _own(name, texts)
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]


def test_token_files(docs, empty):
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_blocks.round_trip(docs, vocabulary("word_bpe_49k.json")).collect())
    start, want = 0, []
    for r, ids in zip(corpus(), _own("word_bpe_49k.json", [r[1] or "" for r in corpus()]), strict=True):
        ids = np.array([*ids, 1], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_blocks.round_trip(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_packing(docs, empty):
    size = 64
    want = {r[0]: [*ids, 0] for r, ids in zip(corpus(), _own("byte_bpe_50k.json", [r[1] or "" for r in corpus()]), strict=True)}
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json"), size=size).collect()
    bins, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.piece, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    assert {k: [i for p in sorted(v) for i in p[2]] for k, v in whole.items()} == want
    assert all(len(v) == max(1, -(-len(want[k]) // size)) for k, v in whole.items())
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) <= 1.05 * sum(map(len, want.values())) / size + 2
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_in_lanes_leaves_no_bin_out(spark):
    rows = [(i % 2, 0, i, 24 if i % 2 else 40, [(i, 0)]) for i in range(60)]
    bins = spark.createDataFrame(rows, "node long, lane long, bin long, room long, parts array<struct<bin:long,place:long>>")
    first = packing.merge(bins, 64, carry=8).cache()  # small bins pair, 15 and 30 are left
    assert first.where("done").count() == 0 and first.count() == 45
    assert max(r["count"] for r in first.groupBy("lane").count().collect()) <= 2 * 8
    second = packing.merge(first.drop("done"), 64, carry=8).collect()
    assert sorted(p.bin for r in second for p in r.parts) == list(range(60))
    assert len(second) == 45 and len({r.lane for r in second}) > 4
    assert all(sorted(p.place for p in r.parts) in ([0], [0, 24]) for r in second)


def test_quality_rules(docs, empty):
    for r in quality_rules.score(docs, vocabulary("piece_bpe_32k.model")).collect():
        text = dict((x[0], x[1]) for x in corpus())[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        twice = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(words) < 10 or 100 * len(twice) > 20 * len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.keep_good(docs, vocabulary("piece_bpe_32k.model")).columns == docs.columns
    assert quality_rules.score(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def test_quality_bands_reject_junk_by_each_measure(spark):
    rng = random.Random(4)
    words = "the of and river house morning people water small letter garden window between without number country other winter story teacher".split()
    words += ["".join(w) for w in zip([rng.choice(words) for _ in range(400)], [rng.choice(["", "s", "ing", "er"]) for _ in range(400)])]
    clean = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, clean(rng.choice([40, 80, 200, 400])), "en") for i in range(600)]
    short = [(1000 + i, clean(30) + " 5555-2748", "en") for i in range(20)]
    symbols = [(2000 + i, " ".join(rng.choice(words) + "#$%&|<>"[k % 7] * 3 for k in range(200)), "en") for i in range(10)]
    glyphs = [(3000 + i, clean(150) + " " + " ".join(chr(0x13000 + rng.randrange(900)) for _ in range(30)), "en") for i in range(10)]
    few = [rng.choice(words) for _ in range(12)]
    dull = [(4000 + i, " ".join(rng.choice(few) for _ in range(200)), "en") for i in range(10)]
    rare = [(5000 + i, clean(60), "sv") for i in range(5)]
    docs = spark.createDataFrame([*rows, *short, *symbols, *glyphs, *dull, *rare], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.score(docs, vocabulary("piece_bpe_32k.model")).collect()}
    assert all(got[r[0]].few_chars and not got[r[0]].kept for r in symbols)
    assert all(got[r[0]].many_bytes and not got[r[0]].kept for r in glyphs)
    assert all(got[r[0]].low_entropy and not got[r[0]].base_failed for r in dull)
    assert all(got[r[0]].kept for r in [*short, *rare])
    assert sum(got[r[0]].kept for r in rows) >= 0.98 * len(rows)


def _labelled(spark, n=900):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [(-1, None), (-2, "")], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(words) for _ in range(60)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["fopwit", "Fopwit!", "grobbler", "you", "GROBBLER"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, empty):
    docs, labels = _labelled(spark)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in truth)
    assert sum(got[k].predicted == truth[k] for k in held) >= 0.95 * len(held)
    assert 0 <= got[-1].score <= 1 and 0 <= got[-2].score <= 1
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_ordinal_quality(spark, empty):
    docs, labels = _labelled(spark)
    ratings = labels.selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS grade")
    model = ordinal_quality.fit(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in ordinal_quality.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    low = np.mean([got[k].expected_grade for k in truth if truth[k]])
    assert low < np.mean([got[k].expected_grade for k in truth if not truth[k]]) - 0.3 and -1 in got
    assert ordinal_quality.score(empty, ordinal_quality.fit(empty, ratings.limit(0))).count() == 0


PAGE = "<html><head><title>t</title><script>var a='</p>'</script></head><body><div class=top-menu>Menu</div><div>Site slogan</div><h1>Title {i}</h1><div><p>Body  of {i}\n&amp; more<p>Second&nbsp;{i}</div><div class='cookie-notice'>We use</div><section id=comments><p>Nice!</section><div>All rights</div></body></html>"


def test_html_differencing(spark):
    rows = [(i, f"https://h.example/en/{i}", PAGE.replace("{i}", str(i))) for i in range(5)]
    rows += [(10, "https://h.example/de/1", "<nav>x</nav><article><h1>A</h1><p>b<br>c</p></article><footer>f</footer>"), (11, None, None), (12, "http://[bad", "<p>lone &lt; text"), (13, "https://h.example/en/1", "")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i].text == f"Title {i}\n\nBody of {i} & more\n\nSecond {i}", got[i].text
    assert got[10].text == "A\n\nb c" and got[11].text == "" and got[12].text == "lone < text" and got[13].n_chars == 0


def test_html_differencing_of_pages_with_articles(spark):
    page = "<div>Slogan</div><div>Headline {i}</div><article><p>Teaser {i}</p><p>Both say this</p></article><article class='comment' id='comment-{i}'><p>Nice {i}!</p></article><div>Rights</div>"
    rows = [(i, f"https://a.example/{i}", page.replace("{i}", str(i))) for i in range(4)]
    rows += [(9, "https://alone.example/1", page.replace("{i}", "9")), (10, "https://p.example/1", "<article class='post has-comments'><p>Post</p></article>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == f"Headline {i}\n\nTeaser {i}\n\nBoth say this"
    assert got[9] == "Slogan\n\nHeadline 9\n\nTeaser 9\n\nBoth say this\n\nRights" and got[10] == "Post"


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert int(html_text.common_lines(a, b).sum()) == best[-1][-1]
    a = np.arange(50_000, dtype=np.uint64)
    assert html_text.common_lines(a, np.delete(a, [7, 30_000])).sum() == 49_998


def test_html_of_equal_alone_and_long_pages(spark):
    page = "<div>Slogan</div><p>Body {i}</p><div>Rights</div>"
    rows = [(1, "https://e.example/1", page), (1, "https://e.example/1", page), (2, "https://e.example/2", page), (3, "https://f.example/1", page), (4, "https://f.example/1", page + "<p>new")]
    rows += [(5, "https://g.example/1", ""), (6, "https://g.example/2", page.replace("{i}", "6")), (7, "https://g.example/3", page.replace("{i}", "7"))]
    rows += [(8, "https://l.example/1", "".join(f"<p>line {i}" for i in range(50_000))), (9, "https://l.example/2", "<p>line 9<p>own")]
    got = sorted((r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    whole, long = "Slogan\n\nBody {i}\n\nRights", "\n\n".join(f"line {i}" for i in range(50_000))
    assert got == [(1, whole), (1, whole), (2, whole), (3, whole), (4, whole + "\n\nnew"), (5, ""), (6, "Body 6"), (7, "Body 7"), (8, long), (9, "line 9\n\nown")]


def _texts(spark, *pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    return [r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_html_reads_attributes_as_names_and_values(spark):
    page = """<div style="overflow:hidden">Body <a href="/the-hidden-lake">the lake</a> ends.</div><p class='hidden-gem'>Gem</p><p title='a hidden cost' data-x=hidden>Cost</p><p title="class='ad'">Title</p>
    <p hidden>no</p><p HIDDEN="">no</p><p style="color:red;display : none">no</p><p aria-hidden="true">no</p><p aria-hidden=false>Yes</p><span hidden>no</span>"""
    assert _texts(spark, ("https://x.example/1", page)) == ["Body the lake ends.\n\nGem\n\nCost\n\nTitle\n\nYes"]


def test_html_copies_of_a_page_and_shared_quotes_lose_nothing(spark):
    body = "<h1>Headline</h1>" + "".join(f"<p>Paragraph {i} says what there is to say.</p>" for i in range(6))
    copies = _texts(spark, ("https://n.example/story", body + "<p>version 1</p>"), ("https://n.example/story-print", body + "<p>version 2</p>"))
    assert [x.split("\n\n")[0] for x in copies] == ["Headline"] * 2 and all(x.count("Paragraph") == 6 for x in copies)
    pages = [(f"https://q.example/{i}", f"<div>Slogan</div><h1>Title of {i}</h1><p>Own text number {i} which is long.</p>{'<p>A quote</p>' if i < 2 else ''}<p>More of {i}, and some more.</p><div>Rights</div>") for i in range(5)]
    for n in (2, 5):
        for i, text in enumerate(_texts(spark, *pages[:n])):
            assert ("A quote" in text) == (i < 2) and "Slogan" not in text and "Rights" not in text and text.count(f"{i}") == 3


def test_html_boxes_in_articles_go_if_near_pages_have_them(spark):
    page = "<article><h1>Title {i}</h1><p>Text of {i}, long enough to be the text.</p>{own}<div class='reader-comments'><p>Reader {i} says this.</p></div><ul class=comment-list id=c{i}><li>And {i} that</ul><div class='ad-slot'>Buy {i}</div><div class='share-box'>Share</div></article>"
    own = {2: "<section class='related-work'><p>Work of others</p></section>", 4: "<div class='hidden-notice'>A notice of old</div>"}
    pages = [(f"https://b.example/{i}", page.replace("{own}", own.get(i, "")).replace("{i}", str(i))) for i in range(6)]
    got = _texts(spark, *pages)
    extra = {2: "\n\nWork of others", 4: "\n\nA notice of old"}
    assert got == [f"Title {i}\n\nText of {i}, long enough to be the text.{extra.get(i, '')}" for i in range(6)]


def test_html_differencing_inside_articles(spark):
    page = "<article><p>Text {i}</p><p class='related-work'>Work {i}</p><p>Follow us</p><div class='ad'>Buy</div></article>"
    rows = [(i, f"https://h.example/{i}", page.replace("{i}", str(i))) for i in range(60)] + [(109, "https://two.example/1", page), (110, "https://two.example/2", page.replace("Text", "Two"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), inside_articles=True).collect()}
    assert all(got[i] == f"Text {i}\n\nWork {i}" for i in range(60)), got
    assert got[109] == "Text {i}\n\nWork {i}\n\nFollow us" and got[110].startswith("Two")


def test_html_of_an_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string, shared int")).count() == 0


def test_pipeline_runs_through(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    assert hashlib.sha256(str(sorted(rows)).encode()).hexdigest()


def _clean_corpus():
    """Clean texts with copies, near copies, a shared passage, benchmark text, junk, nulls and empty texts, and the benchmark."""
    rng = random.Random(12)
    words = "the of and river house morning people water small letter garden window between without number country other winter story teacher".split()
    words += [rng.choice(words) + rng.choice(["s", "ing", "er", "ly"]) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.choice([60, 120, 400])) for _ in range(70)]
    texts += [texts[3], texts[3], texts[9], " ".join([*texts[11].split()[:-2], "end", "here"])]
    passage, item = prose(60), prose(20)
    texts += [f"{prose(80)} {passage} {prose(70)}" for _ in range(3)] + [f"{prose(50)} {item} {prose(50)}", item.upper() + " " + prose(40)]
    texts += ["too short", "", None, "la la la la la " * 30, "x" * 3000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, prose(50), None, None, None), (3, texts[3], "en", "s", 1)], [(1, item), (2, prose(30)), (3, None), (4, "")]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows, items = _clean_corpus()
    docs = spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA + ", NODE string, Spans int").repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now, texts = docs, lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    was = texts(now)
    for name, stage in corpus_pipeline.STAGES:
        new = corpus_pipeline.cut(stage(spark, now, str(tmp_path)), name)
        if name == "packing":
            break
        assert new.columns == docs.columns
        got = texts(new)
        if name == "quality_rules":
            words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

            def repeats(w):
                five = defaultdict(list)
                for i in range(len(w) - 4):
                    five[tuple(w[i : i + 5])].append(i)
                return len({i + k for at in five.values() if len(at) > 1 for i in at for k in range(5)})

            assert got == [(d, t) for d, t in was if len(w := words(t)) >= 10 and 100 * repeats(w) <= 20 * len(w)]  # the bands reject none of these
        elif name == "near_duplicates":
            of = groups([x for x in was if x[0] is not None])
            assert got == [(d, t) for d, t in was if d is None or of[d][1] == d] and len(got) < len(was)
        elif name == "suffix_dedup":
            assert len({d for d, _ in was}) + 1 == len(was)  # the doubled row of document 3 is left by the stage before
            want = brute_repeats([(-1 if d is None else d, t) for d, t in was if d != 3])
            assert {(-1 if d is None else d): t.encode() for d, t in got if d != 3} == {d: kept for d, (_, _, _, kept) in want.items()}
        else:
            sets = [shingles(t) for i, t in items if shingles(t)]
            assert got == [(d, t) for d, t in was if not any(100 * len(s & shingles(t)) >= 75 * len(s) for s in sets)] and len(got) < len(was)
        now, was = new, got
    encode = tokens.byte_tokenizer(vocabulary("byte_bpe_50k.json")).own.encode
    ids = sorted(([*encode(t, add_special_tokens=False).ids, 0] for _, t in was), key=str)
    pieces = sorted(new.collect(), key=lambda r: (str(r.doc_id), r.start))
    assert sum(r.length for r in pieces) == sum(map(len, ids))
    whole = {r.ids_crc32 for r in pieces if r.piece == 0}
    assert {zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids if len(x) <= 2048} <= whole
    places = defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= 2048
    end = corpus_pipeline.run(spark, str(tmp_path)).collect()
    digest = lambda rs: sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs), key=str)
    assert digest(end) == digest(pieces)


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

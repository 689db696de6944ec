"""What keeps the audit queries' work in proportion to their tables: tables written once, sums in 64 bits, no look-up for cells that agree."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.llm import common, jaccard_join
from tallyforge.llm.common import unpack6
from tallyforge.operators import components, ledger, proof, scoring, verify
from tallyforge.plans import proof_queries, queries, run_queries
from tallyforge.plans.derived import KEPT, TABLES, Derived

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_rows_are_a_table_of_columns(spark):
    df = components.kept(spark.createDataFrame([(1, "a", [2]), (2, None, None)], "x long, y string, z array<int>"))
    assert sorted(tuple(r) for r in df.select("x", F.coalesce("y", F.lit("-")), F.size(F.coalesce("z", F.array().cast("array<int>")))).collect()) == [(1, "a", 1), (2, "-", 0)]
    assert "ReadSchema: struct<x:bigint>" in plan(df.select("x"))


def test_findings_do_not_make_the_derived_tables_again(spark):
    """The plan reads what is written; on sf0.001 it had 384 file scans before, counting those inside cached tables."""
    d = Derived(spark, SF)
    text = plan(run_queries._run_findings(d))
    assert "orders.parquet" not in text and "InMemoryRelation" not in text
    for name in KEPT:
        assert "Exchange" not in plan(getattr(d, name)), name
    assert queries._moves(d) is queries._moves(d)


def test_terms_hash_sums_in_halves(spark):
    terms = [(f"C{i % 3}", i, "payment", f"P{i}", -i) for i in range(50)]
    got = {r.credit_id: r for r in proof.terms_hash(spark.createDataFrame(terms, "credit_id string, pos long, type string, id string, signed_paise long")).collect()}
    for c in ("C0", "C1", "C2"):
        own = [t for t in terms if t[0] == c]
        hashed = [hashlib.sha256(f"{p}|{k}|{i}|{s}".encode()).hexdigest() for _, p, k, i, s in own]
        sums = ",".join(str(sum(int(h[12 * i : 12 * i + 12], 16) for h in hashed)) for i in range(5))
        assert (got[c].terms_hash, got[c].n_terms, got[c].sum_paise) == (hashlib.sha256(sums.encode()).hexdigest(), len(own), sum(t[4] for t in own))


def test_cells_that_agree_are_not_looked_up(spark):
    cells = spark.createDataFrame([("a", "fee", 1, 1), ("b", "fee", 2, 1), ("b", "fee", 1, 1), ("c", "fee", 2, 1), ("d", "tax", 3, 1), ("e", "fee", None, 1)], "cell string, kind string, reported_paise long, recomputed_paise long")
    evidence = spark.createDataFrame([("b", "fee_line", "F1"), ("c", "fee_line", "F2"), ("d", "fee_line", "F1"), ("a", "fee_line", "F1")], "cell string, type string, id string")
    items = spark.createDataFrame([("I1", "fee_overcharge"), ("I2", "tax_miscalculation")], "item string, class string")
    records = spark.createDataFrame([("I1", "fee_line", "F1"), ("I2", "fee_line", "F2")], "item string, type string, id string")
    points = scoring.cell_points(cells, evidence, items, records)
    n = {r.label: r["count"] for r in points.groupBy("label").count().collect()}
    assert n == {True: 3, False: 2, None: 1}  # a and b twice; c and d are of other kinds; e is unknown
    assert points.select(F.countDistinct("source")).first()[0] == 1


def test_residuals_read_only_what_no_proof_by_key_claims(spark):
    """Neither terms in order nor hashes are made for them; before, two tables of the whole ledger were written and dealt by record."""
    d = Derived(spark, SF)
    text = plan(proof_queries._open_pool(d))
    assert {"unsettled", "open_by_key"} <= set(d._made) and not {"cascade_by_key", "cascade"} & set(d._made)
    n, left = d.moves.count(), d._made["unsettled"].count()
    assert 0 < 3 * left < n and "LeftAnti" not in text
    claimed = queries._matched(d).where("settlement_id IS NOT NULL").select("settlement_id")
    assert left == d.moves.join(claimed, "settlement_id", "left_anti").count()


def test_batches_are_made_of_the_movements(spark):
    """The ledger's records are put together once; before, the batches joined fee and tax lines with payments again."""
    d = Derived(spark, SF)
    assert "Join" not in plan(d.ledger)
    want = {(r.type, r.id): (r.settlement_id, r.signed_paise, r.day) for r in spark_ledger(d).collect()}
    got = {(r.type, r.id): (r.settlement_id, r.signed_paise, r.day) for r in d.ledger.collect()}
    assert got == want and d.ledger.count() == len(want)


def spark_ledger(d):
    sql = TABLES["ledger"]
    for t in ("tagged", "payments", "refunds", "chargebacks", "adjustments", "fee_lines", "tax_lines"):
        getattr(d, t).createOrReplaceTempView(f"growth_{t}")
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t} ", f"{word} growth_{t} ").replace(f"{word} {t}\n", f"{word} growth_{t}\n")
    return d.spark.sql(sql)


def test_tax_lines_that_name_their_unit(spark):
    """One join finds the payments of fee and tax lines; a tax line without a unit is looked up by its fee line as before."""
    day = "DATE '2026-01-01'"
    pay = spark.sql(f"SELECT * FROM VALUES ('P1', 'S1', 'M', 10L, {day}), ('P2', NULL, 'M', 20L, {day}) t(id, settlement_id, merchant_id, amount_paise, day)")
    fees = spark.createDataFrame([("F1", "P1", 3), ("F2", "P2", 4), ("F3", "P9", 5)], "id string, applies_to_id string, amount_paise long")
    taxes = spark.createDataFrame([("T1", "F1", "P1", 1), ("T2", "F2", "P2", 2), ("T3", "F3", "P9", 2)], "id string, applies_to_fee_id string, unit_id string, amount_paise long")
    none = pay.limit(0).withColumn("kind", F.lit(""))
    rows = [sorted(tuple(r) for r in ledger.movements(pay, none, none, none, fees, t).select("type", "id", "unit_id", F.coalesce("settlement_id", F.lit("-")), "signed_paise").collect()) for t in (taxes, taxes.drop("unit_id"))]
    assert rows[0] == rows[1] and len(rows[0]) == 6 and ("tax_line", "T2", "P2", "-", -2) in rows[0]


def test_checks_deal_a_large_ledger_over_more_tasks(spark, monkeypatch):
    """A task sorts and groups so many rows at most on average; before, the session's partitions were all, whatever the size."""
    d = Derived(spark, SF)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert components.parts(spark, 0) == usual == components.parts(spark, usual * components.ROWS_A_TASK) and components.parts(spark, usual * components.ROWS_A_TASK + 1) == usual + 1
    monkeypatch.setattr(components, "ROWS_A_TASK", 1 + d.moves.count() // 40)
    for made in (run_queries.proof_checks, proof_queries.proof_faults):
        text = made(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [credit_id" in text and "RepartitionByExpression [type" in text and ", 40" in text


def test_signatures_are_dealt_before_many_are_held(monkeypatch):
    """However many texts a task has, it deals what it holds from MOST_HELD signatures on; nothing is lost by it. (Before, 600,000 in any case.)"""
    texts = [" ".join(f"w{(i * 31 + k) % 997}" for k in range(40)) for i in range(300)]
    ids = pa.array(range(300), pa.int64())
    batches = [pa.RecordBatch.from_arrays([ids[a : a + 10], ids[a : a + 10], pa.array(texts[a : a + 10])], names=["node", "star", "text"]) for a in range(0, 300, 10)]

    def dealt(most):
        monkeypatch.setattr(jaccard_join, "MOST_HELD", most)
        rows = [r for b in jaccard_join._buckets(iter(batches), 75, 0, [0, 1], 1000) for r in b.to_pylist() if r["bucket"] >= 0]
        got = sorted((r["bucket"], int(v), int(n)) for r in rows for v, n in zip(unpack6(r["value"]), jaccard_join._unpacked(r["bucket"], r["node"], r["run"], r["star"], r["role"])[0], strict=True))
        return len(rows), got

    (few_rows, one), (many_rows, several) = dealt(1 << 30), dealt(500)
    assert one == several and few_rows == 2 and many_rows > 10


def test_a_bucket_is_compared_in_lots_of_its_values(monkeypatch):
    """What a task unpacks and sorts at once doesn't grow with its bucket, and the lots give what the whole gives. (Before, a bucket was compared whole.)"""
    texts = [" ".join(f"w{(i // 3 * 31 + k) % 997}" for k in range(40 + i % 3)) for i in range(300)]
    ids = pa.array(range(300), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["node", "star", "text"])
    packed = [b.drop_columns(["place"]) for b in jaccard_join._buckets(iter([batch]), 75, 0, [0], 2)]
    sizes = []
    first = jaccard_join._first_of_stars
    monkeypatch.setattr(jaccard_join, "_first_of_stars", lambda value, *x: sizes.append(len(value)) or first(value, *x))

    def met(most):
        monkeypatch.setattr(jaccard_join, "MOST_COMPARED", most)
        sizes.clear()
        rows = sorted(tuple(r.values()) for b in jaccard_join._candidates(iter(packed), 2) for r in b.to_pylist())
        return rows, max(sizes)

    (one, whole), (several, largest) = met(1 << 30), met(200)
    assert one == several and {r[0] for r in one} == {0, 1, 2} and largest < 400 < whole


def test_a_worker_lets_go_of_what_other_stages_loaded(monkeypatch):
    """Before, each Python worker held the vocabularies of all stages that it had served, until the session's end."""
    made = []
    monkeypatch.setattr(common, "_LOADED", [])
    mine, other = (common.per_worker(lambda n, k=k: made.append(k) or n) for k in "mo")
    run = lambda it: (b for b in it if mine(1) == 1)
    mine(1), other(1)
    assert list(common.lean(run, mine)(iter([1, 2]))) == [1, 2] and made == ["m", "o"]
    mine(1), other(1)
    assert made == ["m", "o", "o"]
    list(common.lean(iter)(iter([])))
    mine(1)
    assert made == ["m", "o", "o", "m"]


def test_findings_write_only_cells_that_differ(spark):
    """Before, every cell of every payment was written and read again for the few that differ."""
    d = Derived(spark, SF)
    apart = queries._apart(d)
    findings = {tuple(r) for r in queries._findings(d).collect()}
    assert not d.has("cells") and apart.where("fee_delta = 0 AND tax_delta = 0").count() == 0
    other = Derived(spark, SF)
    every = queries._cells(other)
    want = {tuple(r) for r in every.where("fee_delta <> 0 OR tax_delta <> 0").collect()}
    assert want and {tuple(r) for r in apart.collect()} == want == {tuple(r) for r in queries._apart(other).collect()} and every.count() > len(want)
    assert {tuple(r) for r in verify.findings(every, queries._payments(other)).collect()} == findings
    assert "Exchange" not in plan(queries._apart(other))


def test_sums_are_those_of_the_movements(spark):
    """Of payments with equal ids each gets all lines, a line of no payment none, an orphan's sums stay apart; the lines are joined once."""
    day = lambda n: f"DATE '2026-01-0{n}'"
    pay = spark.sql(f"SELECT * FROM VALUES ('P1', 'S1', 'M', 10L, {day(1)}), ('P1', 'S2', 'M', 11L, {day(2)}), ('P2', NULL, 'M', 20L, {day(3)}), ('P3', 'S1', 'M', NULL, {day(4)}) t(id, settlement_id, merchant_id, amount_paise, day)")
    back = spark.sql(f"SELECT * FROM VALUES ('R1', 'S1', 4L, {day(5)}), ('R2', 'S3', 5L, NULL) t(id, settlement_id, amount_paise, day)")
    added = back.withColumn("kind", F.lit("manual_debit"))
    fees = spark.createDataFrame([("F1", "P1", 3, 1), ("F2", "P1", 4, None), ("F3", "P2", 5, 2), ("F4", "P9", 6, 3)], "id string, applies_to_id string, amount_paise long, tax_paise long")
    taxes = fees.select(F.concat(F.lit("T"), "id").alias("id"), F.col("id").alias("applies_to_fee_id"), F.col("applies_to_id").alias("unit_id"), F.col("tax_paise").alias("amount_paise"))
    want = ledger.sums(ledger.movements(pay, back, back, added, fees.drop("tax_paise"), taxes))
    got = ledger.charged_sums(pay, back, back, added, fees.drop("id"))
    key = lambda df: sorted(map(repr, df.select("settlement_id", "type", "signed_paise", "n", "day").collect()))
    assert key(got) == key(want) and len(key(got)) == 15
    assert plan(got).count("Join [applies_to_id") == 1


def test_score_cards_write_neither_movements_nor_lines(spark):
    """Sums by settlement are enough for them; before, prices, fee lines and the whole ledger were written and read again."""
    d = Derived(spark, SF)
    conserved = {tuple(r) for r in queries._conserved(d).collect()}
    assert {"tagged", "sums", "batches"} <= set(d._made) and not {"priced", "fee_lines", "moves"} & set(d._made)
    assert {tuple(r) for r in d.sums.collect()} == {tuple(r) for r in ledger.sums(d.moves).collect()}
    assert conserved == {tuple(r) for r in verify.conservation(queries._matched(d), queries._ledger(d)).collect()} and conserved
    assert "CASE WHEN" not in plan(d.tagged) and d.payments.columns == d.tagged.columns[:-1]


def test_queries_that_need_movements_sum_those(spark, monkeypatch):
    """They write them before the batches are made, so that the lines aren't priced and joined for the sums too."""
    monkeypatch.setattr(ledger, "charged_sums", None)
    monkeypatch.setattr(queries.decompose, "searched", lambda rest, units: rest.limit(1))
    monkeypatch.setattr(proof, "cascade", lambda *tables: tables)
    monkeypatch.setattr(proof, "unsealed", lambda credits, matched, found, records: credits)
    for asked in (queries._searched, proof_queries.by_key, proof_queries.cascade, lambda d: proof_queries._open_proofs(d, "x", proof_queries._unsearched(d))):
        d = Derived(spark, SF)
        asked(d)
        assert {"moves", "sums", "by_key"} <= set(d._made)

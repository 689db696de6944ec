"""The audit engine: hand-computed money, searches against brute force, and queries against their SQL in DuckDB."""

import itertools
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import money
from tallyforge.operators import contract, decompose, evaluate, ingest, ledger, search, verify
from tallyforge.plans import queries as audit
from tallyforge.plans import run_queries  # noqa: F401  registers its queries with the others
from tallyforge.plans.derived import RULES
from tallyforge.sources import run_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("paise", "bps", "want"), [(150000, 180, 2700), (150000, 195, 2925), (2925, 1800, 527), (1275, 1800, 230), (500000, 160, 8000), (-2925, 1800, -527), (0, 180, 0)])
def test_apply_bps_half_up(spark, paise, bps, want):
    assert spark.range(1).select(money.apply_bps(F.lit(paise), F.lit(bps))).first()[0] == want


def test_rounding_modes(spark):
    row = spark.range(1).select(*(money.apply_bps(F.lit(5), F.lit(5000), m).alias(m) for m in money.ROUNDING)).first()
    assert row.asDict() == {"half_up": 3, "half_even": 2, "down": 2, "up": 3}


def test_rupees(spark):
    rows = spark.createDataFrame([("12.345",), ("x",), ("-0.05",)], "t string").select(money.from_rupees(F.col("t")).alias("p"))
    assert [r.p for r in rows.collect()] == [1235, None, -5]
    assert [r[0] for r in spark.createDataFrame([(-5,), (123456,)], "p long").select(money.to_rupees(F.col("p"))).collect()] == ["-0.05", "1234.56"]


@pytest.mark.parametrize(("gross", "method", "card", "day", "parts"), [(150000, "card", "credit", "1997-12-31", [2700]), (150000, "card", "credit", "1998-01-01", [2925]), (2000000, "card", "debit", "1997-01-01", [7000]), (50000, "upi", None, "1997-01-01", [200]), (200000, "netbanking", None, "1997-01-01", [1000, 3500])])
def test_prices(spark, gross, method, card, day, parts):
    p = spark.createDataFrame([("P", method, card, False, gross, day)], "id string, method string, card_type string, is_international boolean, amount_paise long, d string").withColumn("day", F.to_date("d"))
    assert sorted(r.fee_paise for r in contract.price(p, spark.sql(RULES)).collect()) == sorted(parts)


def test_rules_do_not_overlap(spark):
    assert contract.overlaps(spark.sql(RULES)).count() == 0


def test_subset_sum_is_exhaustive():
    rng = random.Random(1)
    for _ in range(300):
        nets = [rng.randint(-20, 40) for _ in range(rng.randint(1, 9))]
        target = rng.randint(-20, 80)
        every = [c for k in range(1, len(nets) + 1) for c in itertools.combinations(range(len(nets)), k) if sum(nets[i] for i in c) == target]
        state, ways = search.subset_sum(nets, target)
        assert (state == "found") == bool(every)
        assert len(ways) == min(len(every), search.MOST_WITNESSES) and set(ways) <= set(every)
    assert search.subset_sum([1] * 41, 3)[0] == "too_many_units"


def test_assignment_is_least():
    rng = random.Random(2)
    for _ in range(200):
        rows, cols = rng.randint(1, 4), rng.randint(1, 4)
        cost = [[rng.randint(0, 9) for _ in range(cols)] for _ in range(rows)]
        if rows <= cols:
            totals = [sum(cost[r][c] for r, c in enumerate(p)) for p in itertools.permutations(range(cols), rows)]
        else:
            totals = [sum(cost[r][c] for c, r in enumerate(p)) for p in itertools.permutations(range(rows), cols)]
        chosen, total = search.assign(cost)
        assert total == min(totals) and len({c for c in chosen if c >= 0}) == min(rows, cols)
        if rows <= cols and len(totals) > 1 and len(set(totals)) > 0:
            tie = totals.count(min(totals)) > 1
            assert (search.margin(cost, chosen) == 0) == tie
            assert search.margin(cost, chosen) == sorted(totals)[1] - total


def test_structural_reasons(spark):
    credits = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "B"), ("4", ""), ("5", "Z"), ("6", "D")], "id string, utr string")
    batches = spark.createDataFrame([("S1", "A"), ("S2", "B"), ("S4", "D"), ("S5", "D")], "id string, utr string")
    got = {r.id: (r.settlement_id, r.reason) for r in decompose.structural(credits, batches).collect()}
    assert got == {"1": ("S1", None), "2": (None, "structural_key_shared"), "3": (None, "structural_key_shared"), "4": (None, "no_structural_key"), "5": (None, "structural_key_not_found"), "6": (None, "structural_key_ambiguous")}


def test_split_credits_resolve(spark):
    from datetime import date

    credits = spark.createDataFrame([("C1", "M", 800, date(2026, 7, 3)), ("C2", "M", 360, date(2026, 7, 3))], "id string, merchant_id string, amount_paise long, value_date date")
    units = spark.createDataFrame([(f"U{i}", "M", n, date(2026, 7, 1)) for i, n in enumerate((500, 300, 250, 110))], "id string, merchant_id string, net_paise long, day date")
    got = {r.credit_id: (r.outcome, sorted(r.unit_ids), r.residual_paise) for r in decompose.searched(credits, units).collect()}
    assert got == {"C1": ("resolved", ["U0", "U1"], 0), "C2": ("resolved", ["U2", "U3"], 0)}


def test_assignment_by_narration_alone(spark):
    from datetime import date

    names = ["alpha", "beta", "gamma"]
    for order in itertools.permutations(range(3)):
        credits = spark.createDataFrame([(f"C{i}", "M", 905, date(2026, 7, 3), f"NEFT {names[k]}") for i, k in enumerate(order)], "id string, merchant_id string, amount_paise long, value_date date, narration string")
        units = spark.createDataFrame([(f"U{k}", "M", 900, date(2026, 7, 1), f"U{k} {names[k]}") for k in range(3)], "id string, merchant_id string, net_paise long, day date, text string")
        unlike = [[int((10_000 - (10_000 // 3 if names[k] == names[u] else 0)) * 5_000 // 10_000) for u in range(3)] for k in order]
        best = min(itertools.permutations(range(3)), key=lambda p: sum(unlike[i][p[i]] for i in range(3)))
        got = {r.credit_id: (r.tier, r.outcome, r.unit_ids, r.residual_paise) for r in decompose.searched(credits, units).collect()}
        assert got == {f"C{i}": ("assignment", "resolved", [f"U{best[i]}"], 5) for i in range(3)}


def test_ids_of_findings_beyond_999_differ(spark):
    from tallyforge.operators import verify

    n = 1005
    cells = spark.range(n).select(F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("payment_id"), F.lit("rate").alias("fee_type"), F.lit(5).cast("long").alias("fee_delta"), F.lit(0).cast("long").alias("tax_delta"))
    payments = cells.select(F.col("payment_id").alias("id"), F.lit("S").alias("settlement_id"), F.lit(100).cast("long").alias("amount_paise"))
    found = verify.findings(cells, payments)
    assert {r.id for r in found.select("id").collect()} == {f"FND-S-{i:03d}" for i in range(1, n + 1)}
    posted = spark.createDataFrame([], "idempotency_key string")
    assert verify.journal_entries(found, "h", posted).count() == n


def test_conflicting_records_fail(spark):
    rows = spark.createDataFrame([("payment", "1", 5), ("payment", "1", 5), ("refund", "1", 5)], "type string, id string, amount long")
    assert ledger.deduplicated(rows).count() == 2
    with pytest.raises(Exception, match="conflicting record"):
        ledger.deduplicated(rows.union(rows.selectExpr("type", "id", "amount + 1"))).count()


def test_isotonic_and_bounds(spark):
    points = spark.createDataFrame([(1000, 0, "a"), (2000, 1, "a"), (3000, 0, "a"), (4000, 1, "a")], "confidence_bps int, correct int, source string")
    assert evaluate.isotonic_breakpoints(points) == [(1000, 0), (2000, 5000), (3000, 5000), (4000, 10000)]
    assert evaluate.clopper_pearson_upper_bps(0, 59) in range(490, 505)
    assert evaluate.auto_threshold(points) is None


def test_run_directory_round_trip(spark, tmp_path):
    m = lambda p: {"paise": p, "currency": "INR"}
    when = "2026-07-01T10:00:00+05:30"
    (tmp_path / "r1").mkdir()
    files = {
        "ledger.json": {"payments": [{"id": "PAY-1", "merchant_id": "M", "amount": m(500), "method": "upi", "network": None, "card_type": None, "is_international": False, "mcc": "5211", "captured_at": when, "settlement_id": "S"}], "refunds": [], "chargebacks": [], "adjustments": []},
        "settlement_report.json": {"fee_lines": [{"id": "F", "applies_to_id": "PAY-1", "applies_to_type": "payment", "fee_type": "fixed", "computed_amount": m(200), "rule_id": "upi"}], "tax_lines": [], "batches": []},
        "bank_statement.json": {"bank_credits": [{"id": "BC-1", "utr": "U", "amount": m(300), "value_date": "2026-07-03", "narration": "n"}]},
    }
    for name, data in files.items():
        (tmp_path / "r1" / name).write_text(json.dumps(data))
    tables = run_dir.read(spark, str(tmp_path / "r1"))
    assert tables["payments"].first()["amount_paise"] == 500 and tables["payments"].first()["run"] == "r1"
    assert tables["fee_lines"].first()["amount_paise"] == 200
    assert tables["refunds"].count() == 0
    out = str(tmp_path / "out")
    run_dir.write_result({"credits": tables["bank_credits"]}, out)
    assert run_dir.read_result(spark, out)["credits"].count() == 1


def test_posting_stream_writes_each_key_once(spark, tmp_path):
    from tallyforge.streaming.posting import post

    src, journal = str(tmp_path / "src"), str(tmp_path / "journal")
    rows = spark.createDataFrame([("k1", 1), ("k2", 2), ("k1", 1)], "idempotency_key string, amount long")
    for part in (rows, rows.where("amount = 2")):
        part.write.mode("append").parquet(src)
        post(spark.readStream.schema(rows.schema).parquet(src), journal, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.idempotency_key for r in spark.read.parquet(journal).collect()) == ["k1", "k2"]


def _rows(cols, rows):
    return sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(audit.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "events", "region", "nation"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = audit.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(audit.oracle_sql()[name])
    assert sorted(want.columns) == cols
    picked = [want.columns.index(c) for c in cols]
    assert _rows(cols, got.select(*cols).collect()) == _rows(cols, [[r[i] for i in picked] for r in want.fetchall()])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert os.path.isdir(SF) and __spark_entry__.entry(spark).count() > 0


def test_gross_tax_once_for_each_rule(spark):
    p = spark.createDataFrame([("P", "netbanking", None, False, 200000, "1997-01-01")], "id string, method string, card_type string, is_international boolean, amount_paise long, d string").withColumn("day", F.to_date("d"))
    treatments = spark.createDataFrame([("netbanking", "gst", 1800, "fee_amount"), ("netbanking", "tds", 100, "transaction_gross")], "rule_id string, tax_type string, rate_bps int, base string")
    got = sorted((r.tax_type, r.on_fee_type, r.tax_paise) for r in contract.taxes(p, spark.sql(RULES), treatments).collect())
    assert got == [("gst", "fixed", 180), ("gst", "mdr", 630), ("tds", None, 2000)]


@pytest.mark.parametrize(("a", "b", "want"), [("57*", "5712", True), ("57*", "5*", True), ("57*", "5211", False), ("5211", "5211", True), ("5211", "5212", False), (None, "5211", True)])
def test_mcc_patterns_meet(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(contract.mcc_meet(F.col("a"), F.col("b")), contract.mcc_meet(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (want, want)


@pytest.mark.parametrize(("explained", "residual", "want"), [(-500, -1000, 5000), (-1500, -1000, 10000), (500, -1000, 0), (0, -1000, 0), (5, 0, 0), (1, 3, 3333)])
def test_coverage(spark, explained, residual, want):
    assert spark.range(1).select(verify.coverage_bps(F.lit(explained), F.lit(residual))).first()[0] == want


def test_a_source_without_points_above_a_threshold_risks_nothing(spark):
    points = spark.createDataFrame([("a", 9000, 1)] * 800 + [("b", 100, 0)] * 5, "source string, confidence_bps long, correct long")
    assert evaluate.auto_threshold(points) == 9000


def test_escalate_threshold(spark):
    points = spark.createDataFrame([(100, 0), (200, 1), (300, 1), (400, 0), (500, 1)], "confidence_bps long, correct long")
    assert evaluate.escalate_threshold(points).first()[0] == 400
    assert evaluate.escalate_threshold(points.where("correct = 1")).first()[0] == 0


def test_scores_of_no_findings(spark):
    truth = spark.createDataFrame([("P", "c", "fee_overcharge")], "payment_id string, code string, class string")
    none = spark.createDataFrame([], "id string, payment_id string, class string")
    rows = evaluate.class_rows(evaluate.full_confusion(none, truth))
    assert [(r["class"], r.tp, r.fp, r.fn, r.f1) for r in rows.collect()] == [("fee_overcharge", 0, 0, 1, 0.0)]
    assert {r.average: r.recall for r in evaluate.averages(rows).collect()} == {"macro": 0.0, "micro": 0.0}
    assert {r.average: r.f1 for r in evaluate.averages(rows.where("false")).collect()} == {"macro": 0.0, "micro": 0.0}


def test_proof_of_another_outcome_carries_nothing(spark):
    proofs = spark.createDataFrame([("C1", "subset_sum", "ambiguous", None, None, 5, 0, 5), ("C2", "subset_sum", "unresolved", "none", None, 5, 0, 5), ("C3", "structural", "resolved", None, "S", 5, 0, 5)], "credit_id string, tier string, outcome string, reason string, settlement_id string, credit_paise long, sum_paise long, residual_paise long")
    terms = spark.createDataFrame([("C2", 1, "refund", "R", -5)], "credit_id string, pos int, type string, id string, signed_paise long")
    credits = spark.createDataFrame([("C1", 5, ""), ("C2", 6, "")], "id string, amount_paise long, utr string")
    records = spark.createDataFrame([("payment", "P", "S", 5)], "type string, id string, settlement_id string, signed_paise long")
    batches = spark.createDataFrame([("S", "U")], "id string, utr string")
    got = sorted(tuple(r) for r in verify.proof_failures(proofs, terms, credits, records, batches).collect())
    assert got == [("C1", "reason_lacks"), ("C2", "answer_without_resolution"), ("C2", "credit_differs"), ("C2", "term_unknown"), ("C3", "credit_unknown"), ("C3", "no_single_batch")]


def test_settlements_of_no_row_and_without_money(spark):
    recon = spark.createDataFrame([("S1", 5), ("S1", 3), ("S2", 4), (None, 1)], "settlement_id string, created_at long")
    settlements = spark.createDataFrame([("S1", "processed"), ("S2", None), ("S3", "processed")], "id string, status string")
    got = sorted((r.id, r.cycle_start, r.cycle_end, r.reason) for r in ingest.settlement_spans(recon, settlements).collect())
    assert got == [("S1", 3, 5, None), ("S2", 4, 4, "settlement_not_processed")]


def test_pairs_of_credits_that_share_no_unit_are_judged_apart():
    tie = [{"A": 5, "B": 5}, {"A": 5, "B": 5}]
    assert search.pair_up([*tie, {"C": 7, "D": 9}, {}])[2:] == [("C", False), (None, False)]
    assert [t for _, t in search.pair_up(tie)] == [True, True]
    assert search.pair_up([{"A": 1}, {"A": 9}]) == [("A", False), (None, False)]
    rng = random.Random(5)
    for _ in range(100):
        costs = [{u: rng.randint(0, 6) for u in "ABC" if rng.random() < 0.6} for _ in range(3)]
        ways = [w for w in itertools.product(*([None, *c] for c in costs)) if len({u for u in w if u}) == sum(u is not None for u in w)]
        dear = lambda w: sum(1_000 if u is None else c[u] for u, c in zip(w, costs, strict=True))  # noqa: B023, E731
        least = min(map(dear, ways))
        best = [w for w in ways if dear(w) == least]
        got = search.pair_up(costs)
        assert tuple(u for u, _ in got) in best
        assert any(t for _, t in got) == (len(best) > 1)


def _moves_of_split(spark):
    from datetime import date

    d = date(2026, 7, 1)
    pay = spark.createDataFrame([("P1", "S1", "M", d, 500, "INR"), ("P2", "S1", "M", d, 300, "INR"), ("P3", None, "M", d, 77, "INR"), ("P4", "S2", "M", d, 40, "INR"), ("P5", "S3", "M", d, 10, "INR"), ("P6", "S3", "M", d, 10, "USD")], "id string, settlement_id string, merchant_id string, day date, amount_paise long, currency string")
    fees = spark.createDataFrame([("F1", "P1", 10, "INR"), ("F4", "P4", 4, "INR")], "id string, applies_to_id string, amount_paise long, currency string")
    taxes = spark.createDataFrame([("T1", "F1", 2, "INR")], "id string, applies_to_fee_id string, amount_paise long, currency string")
    other = spark.createDataFrame([("R1", "S1", d, 50, "INR", "x")], "id string, settlement_id string, day date, amount_paise long, currency string, kind string")
    batches = spark.createDataFrame([("S1", "U1", "M", d), ("S2", "U2", "M", d), ("S3", "U3", "M", d)], "id string, utr string, merchant_id string, day date")
    credits = spark.createDataFrame([("C1", "M", "U1", 488, date(2026, 7, 3), "INR"), ("C2", "M", "U1", 250, date(2026, 7, 3), "INR"), ("C3", "M", "lost", 77, date(2026, 7, 3), "INR"), ("C4", "M", "U2", 36, date(2026, 7, 3), "INR"), ("C5", "M", "off", 20, date(2026, 7, 3), "USD")], "id string, merchant_id string, utr string, amount_paise long, value_date date, currency string")
    return ledger.movements(pay, other, other.limit(0), other.limit(0), fees, taxes), batches, credits


def test_split_batches_and_orphans_are_units(spark):
    moves, batches, credits = _moves_of_split(spark)
    matched = decompose.structural(credits, batches)
    units = decompose.units(moves, batches, matched)
    got = {r.id: (r.merchant_id, r.net_paise, r.n_records, r.text) for r in units.collect()}
    # P1 with its fee and tax; the refund alone; S2 is taken by key; S3 has two currencies
    assert got == {"P1": ("M", 488, 3, "F1 P1 T1"), "P2": ("M", 300, 1, "P2"), "R1": ("M", -50, 1, "R1"), "P3": ("M", 77, 1, "P3")}
    found = decompose.searched(matched.where("settlement_id IS NULL").drop("settlement_id", "reason"), units)
    assert {r.credit_id: (r.outcome, sorted(r.unit_ids)) for r in found.where("outcome = 'resolved'").collect()} == {"C1": ("resolved", ["P1"]), "C2": ("resolved", ["P2", "R1"]), "C3": ("resolved", ["P3"])}
    terms = decompose.search_terms(found, moves)
    assert {(r.credit_id, r.type, r.id, r.signed_paise) for r in terms.collect()} == {("C1", "payment", "P1", 500), ("C1", "fee_line", "F1", -10), ("C1", "tax_line", "T1", -2), ("C2", "payment", "P2", 300), ("C2", "refund", "R1", -50), ("C3", "payment", "P3", 77)}
    assert {r.id for r in ledger.left_by_cascade(moves, matched, terms).collect()} == {"P5", "P6"}


def test_search_claims_each_record_once_and_adds_up(spark):
    from tallyforge.plans import queries
    from tallyforge.plans.derived import Derived

    got = audit.queries()["search_sums"](spark, SF).collect()
    assert got and all(r.terms_paise + r.residual_paise == r.amount_paise for r in got)
    d = Derived(spark, SF)
    terms = decompose.search_terms(queries._searched(d), queries._moves(d))
    assert terms.groupBy("type", "id").count().where("count > 1").count() == 0
    every, left = queries._moves(d).count(), {r.type: r.n for r in audit.queries()["cascade_unclaimed"](spark, SF).collect()}
    by_key = queries._moves(d).join(queries._matched(d).select("settlement_id"), "settlement_id", "left_semi").count()
    assert sum(left.values()) == every - by_key - terms.count()

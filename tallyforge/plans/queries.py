"""The registered audit queries over the derived ledger, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import money
from tallyforge.operators import contract, decompose, evaluate, ingest, ledger, scoring, verify
from tallyforge.plans.derived import Derived, _bps, derived, with_tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Callable[[Derived], DataFrame]], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable[[Derived], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(derived(spark, sf_dir))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = with_tables(sql)
        return run

    return add


def _payments(d: Derived) -> DataFrame:
    return d.tagged.withColumn("settlement_id", F.when(F.col("defect") != "orphan", F.col("stl")))


def _long_ledger(d: Derived) -> DataFrame:
    own = lambda t: getattr(d, t).withColumnRenamed("stl", "settlement_id")
    return ledger.long_ledger(_payments(d), own("refunds"), own("chargebacks"), own("adjustments"), d.fee_lines.drop("k"), d.tax_lines)


def _ledger(d: Derived) -> DataFrame:
    """The long ledger's rows, read from the movements that are written once."""
    return _moves(d).select("type", "id", "settlement_id", "signed_paise")


def _matched(d: Derived) -> DataFrame:
    return decompose.structural(d.bank_credits, d.batches.select("id", "utr"))


_MATCHED = """m AS (SELECT c.*, CASE WHEN trim(c.utr) = '' THEN 'no_structural_key' WHEN n.n > 1 THEN 'structural_key_shared' WHEN b.id IS NULL THEN 'structural_key_not_found' END AS reason,
 CASE WHEN n.n = 1 THEN b.id END AS settlement_id FROM bank_credits c JOIN (SELECT utr, count(*) AS n FROM bank_credits GROUP BY utr) n ON n.utr = c.utr LEFT JOIN batches b ON b.utr = c.utr)"""
_SUM = "CAST(sum({}) AS BIGINT) AS {}"


@_query("SELECT id, rule_id, part, fee_type, fee_paise FROM priced")
def fee_recompute(d: Derived) -> DataFrame:
    return contract.price(d.tagged, d.rules).select("id", "rule_id", "part", "fee_type", "fee_paise")


@_query(f"SELECT fee_type, method, CAST(sum({_bps('fee_paise', '1800')}) AS BIGINT) AS tax_paise, count(*) AS n FROM priced GROUP BY ALL")
def tax_on_fee(d: Derived) -> DataFrame:
    return contract.price(d.payments, d.rules).groupBy("fee_type", "method").agg(F.sum("tax_paise").alias("tax_paise"), F.count("*").alias("n"))


@_query("SELECT id, uncapped, fee_paise FROM priced WHERE part = 'adval' AND uncapped > fee_paise")
def cap_binding(d: Derived) -> DataFrame:
    return contract.price(d.payments, d.rules).where("part = 'adval' AND uncapped > fee_paise").select("id", "uncapped", "fee_paise")


@_query("""SELECT CAST(sum((v - v % 10000) // 10000 + CASE WHEN v % 10000 >= 5000 THEN 1 ELSE 0 END) AS BIGINT) AS half_up, CAST(sum((v - v % 10000) // 10000) AS BIGINT) AS down,
 CAST(sum((v - v % 10000) // 10000 + CASE WHEN v % 10000 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(sum((v - v % 10000) // 10000 + CASE WHEN v % 10000 > 5000 OR (v % 10000 = 5000 AND (v // 10000) % 2 = 1) THEN 1 ELSE 0 END) AS BIGINT) AS half_even
 FROM (SELECT amount_paise * 195 AS v FROM payments)""")
def rounding_modes(d: Derived) -> DataFrame:
    return d.payments.agg(*(F.sum(money.apply_bps(F.col("amount_paise"), F.lit(195), m)).alias(m) for m in money.ROUNDING))


@_query("SELECT id, amount_paise FROM payments WHERE method = 'wallet'")
def contract_gaps(d: Derived) -> DataFrame:
    return contract.gaps(d.payments, d.rules.where("rule_id <> 'wallet'")).select("id", "amount_paise")


@_query("SELECT p.pattern, count(*) AS n FROM payments JOIN (VALUES ('57*', '57'), ('5*', '5'), ('5211', '5211')) p(pattern, head) ON CASE WHEN pattern LIKE '%*' THEN starts_with(mcc, head) ELSE mcc = pattern END GROUP BY ALL")
def mcc_prefix_match(d: Derived) -> DataFrame:
    patterns = d.spark.createDataFrame([("57*",), ("5*",), ("5211",)], "pattern string")
    return d.payments.join(F.broadcast(patterns), contract.mcc_matches(F.col("pattern"), F.col("mcc"))).groupBy("pattern").agg(F.count("*").alias("n"))


_EXTRA = "SELECT 'x.card.any' AS rule_id, 'mdr' AS fee_type, 'card' AS method, CAST(NULL AS STRING) AS card_type, CAST(NULL AS BOOLEAN) AS is_international, 100000 AS amount_min, 300000 AS amount_max, DATE '1996-01-01' AS effective_from, CAST(NULL AS DATE) AS effective_to, 170 AS rate_bps, 0 AS fixed_fee, CAST(NULL AS BIGINT) AS cap"
#: Whether rule r applies to payment p.
_APPLIES = """r.method = p.method AND (r.card_type IS NULL OR r.card_type = p.card_type) AND (r.is_international IS NULL OR r.is_international = p.is_international) AND p.amount_paise >= r.amount_min AND (r.amount_max IS NULL OR p.amount_paise < r.amount_max)
 AND p.day >= r.effective_from AND (r.effective_to IS NULL OR p.day < r.effective_to)"""


def shared_payments(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """pairs(rule_a, rule_b) with n_payments: how many of hits(id, rule_id) both rules apply to. A payment has few rules, so they are paired payment by payment."""
    both = hits.groupBy("id").agg(F.array_sort(F.collect_set("rule_id")).alias("r")).where(F.size("r") > 1)
    met = both.select(F.explode("r").alias("rule_a"), "r").select("rule_a", F.explode("r").alias("rule_b")).where("rule_a < rule_b").groupBy("rule_a", "rule_b").agg(F.count("*").alias("n_payments"))
    return pairs.join(met, ["rule_a", "rule_b"], "left").na.fill(0, ["n_payments"])


@_query(f"""WITH rr AS (SELECT rule_id, fee_type, method, card_type, is_international, amount_min, amount_max, effective_from, effective_to, rate_bps, fixed_fee FROM rules UNION ALL SELECT rule_id, fee_type, method, card_type, is_international, amount_min, amount_max, effective_from, effective_to, rate_bps, fixed_fee FROM ({_EXTRA}) e),
 r AS (SELECT *, is_international AS i, amount_min AS lo, coalesce(amount_max, 4611686018427387904) AS hi, effective_from AS f, coalesce(effective_to, DATE '9999-12-31') AS t FROM rr), h AS (SELECT p.id, r.rule_id FROM payments p JOIN rr r ON {_APPLIES}),
 n AS (SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, count(*) AS n FROM h a JOIN h b ON a.id = b.id AND a.rule_id < b.rule_id GROUP BY ALL)
 SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, coalesce(n.n, 0) AS n_payments FROM r a JOIN r b ON a.rule_id < b.rule_id AND ((a.fee_type = b.fee_type AND a.rate_bps > 0 AND b.rate_bps > 0) OR (a.fixed_fee > 0 AND b.fixed_fee > 0)) AND a.method = b.method AND (a.card_type IS NULL OR b.card_type IS NULL OR a.card_type = b.card_type) AND (a.i IS NULL OR b.i IS NULL OR a.i = b.i)
 AND greatest(a.lo, b.lo) < least(a.hi, b.hi) AND greatest(a.f, b.f) < least(a.t, b.t) LEFT JOIN n ON n.rule_a = a.rule_id AND n.rule_b = b.rule_id""")
def rule_overlap_pairs(d: Derived) -> DataFrame:
    """Rules that could charge one payment twice, and how many payments of the table they do charge twice."""
    rules = d.rules.unionByName(d.spark.sql(_EXTRA))
    return shared_payments(contract.overlaps(rules), contract.match(d.payments, rules).select("id", F.col("r_rule_id").alias("rule_id")))


@_query("""WITH g AS (SELECT fee_type, method, card_type, CAST(coalesce(reach, 0) AS BIGINT) AS gap_from, CAST(amount_min AS BIGINT) AS gap_to FROM (SELECT *, max(coalesce(amount_max, 4611686018427387904)) OVER (PARTITION BY fee_type, method, card_type ORDER BY amount_min, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
 FROM rules WHERE rule_id NOT LIKE '%tier2') WHERE coalesce(reach, 0) < amount_min)
 SELECT g.*, (SELECT count(*) FROM payments p WHERE p.method = g.method AND (g.card_type IS NULL OR p.card_type = g.card_type) AND p.amount_paise >= g.gap_from AND p.amount_paise < g.gap_to) AS n_payments FROM g""")
def rule_amount_gaps(d: Derived) -> DataFrame:
    """Amounts that a scope's rules leave out, and how many payments have such an amount."""
    gaps = contract.amount_gaps(d.rules.where("rule_id NOT LIKE '%tier2'"))
    p = d.payments.select(F.col("method").alias("of"), F.col("card_type").alias("kind"), F.col("amount_paise").alias("paise"))
    inside = (F.col("of") == F.col("method")) & (F.col("card_type").isNull() | (F.col("kind") == F.col("card_type"))) & (F.col("paise") >= F.col("gap_from")) & (F.col("paise") < F.col("gap_to"))
    return gaps.join(p, inside, "left").groupBy(*gaps.columns).agg(F.count("paise").alias("n_payments"))


@_query("SELECT m AS method, (SELECT count(*) FROM payments p WHERE p.method = v.m) AS n_payments FROM (VALUES ('card'), ('upi'), ('netbanking'), ('wallet'), ('emi')) v(m) WHERE m NOT IN (SELECT method FROM rules WHERE method <> 'wallet')")
def uncovered_methods(d: Derived) -> DataFrame:
    """Methods that no rule (but wallet's, left out) names, and how many payments are made by them."""
    n = d.payments.groupBy("method").agg(F.count("*").alias("n_payments"))
    return contract.uncovered(d.rules.where("method <> 'wallet'"), "method", contract.METHODS).join(n, "method", "left").na.fill(0)


@_query("SELECT id, CAST(max(r.effective_from) AS STRING) AS version_from FROM payments LEFT JOIN (SELECT DISTINCT effective_from FROM rules) r ON r.effective_from <= day GROUP BY id")
def rate_version_asof(d: Derived) -> DataFrame:
    return contract.version_as_of(d.payments.select("id", "day"), d.rules, "day").select("id", F.col("version_from").cast("string"))


@_query("SELECT type, count(*) AS n, CAST(sum(signed_paise) AS BIGINT) AS signed_paise FROM ledger GROUP BY type")
def ledger_signed(d: Derived) -> DataFrame:
    return _long_ledger(d).groupBy("type").agg(F.count("*").alias("n"), F.sum("signed_paise").alias("signed_paise"))


@_query("SELECT 'lineitem' AS type, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, count(*) AS n_variants FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) GROUP BY ALL HAVING count(*) > 1")
def ledger_duplicates(d: Derived) -> DataFrame:
    lines = d.spark.read.parquet(f"{d.sf_dir}/lineitem.parquet")
    return ledger.conflicts(lines.select(F.lit("lineitem").alias("type"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_partkey", "l_quantity"))


@_query("""SELECT f.applies_to_id AS id, count(*) AS n_fees, CAST(sum(f.amount_paise) AS BIGINT) AS fee_paise, CAST(sum(t.amount_paise) AS BIGINT) AS tax_paise
 FROM fee_lines f LEFT JOIN tax_lines t ON t.applies_to_fee_id = f.id GROUP BY 1""")
def fee_tax_chain(d: Derived) -> DataFrame:
    return ledger.fee_chain(d.payments, d.fee_lines, d.tax_lines)


@_query("SELECT id AS settlement_id, net_paise, n_records FROM batches JOIN (SELECT settlement_id, count(*) AS n_records FROM ledger GROUP BY 1) n ON n.settlement_id = id")
def batch_net(d: Derived) -> DataFrame:
    return ledger.batch_net(_long_ledger(d))


@_query("WITH " + _MATCHED + " SELECT id, settlement_id, reason FROM m")
def structural_match(d: Derived) -> DataFrame:
    return _matched(d).select("id", "settlement_id", "reason")


@_query("SELECT utr, count(*) AS n_credits FROM bank_credits GROUP BY utr HAVING count(*) > 1")
def shared_utr(d: Derived) -> DataFrame:
    return d.bank_credits.groupBy("utr").agg(F.count("*").alias("n_credits")).where("n_credits > 1")


@_query("WITH " + _MATCHED + " SELECT m.id, b.id AS unit_id, abs(m.amount_paise - b.net_paise) AS gap_paise FROM m JOIN batches b ON b.merchant_id = m.merchant_id AND b.cycle_end >= m.value_date - 5 AND b.cycle_end < m.value_date + 5 WHERE m.settlement_id IS NULL")
def candidate_window(d: Derived) -> DataFrame:
    rest = _matched(d).where("settlement_id IS NULL").drop("settlement_id", "reason")
    near = decompose.candidates(rest, d.batches.select("id", "merchant_id", "net_paise", F.col("cycle_end").alias("day")))
    return near.select("id", "unit_id", F.abs(F.col("amount_paise") - F.col("unit_paise")).alias("gap_paise"))


@_query("""WITH t AS (SELECT c.id, list_distinct(regexp_extract_all(lower(c.narration), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(concat(b.id, ' ', b.utr)), '[a-z0-9]+')) AS x FROM bank_credits c JOIN batches b ON b.merchant_id = c.merchant_id AND b.cycle_end + 2 = c.value_date)
 SELECT id, CAST(10000 * len(list_intersect(a, x)) // (len(a) + len(x) - len(list_intersect(a, x))) AS BIGINT) AS jaccard_bps FROM t""")
def token_jaccard(d: Derived) -> DataFrame:
    b = d.batches.select(F.concat_ws(" ", "id", "utr").alias("text"), "merchant_id", F.date_add("cycle_end", 2).alias("value_date"))
    return d.bank_credits.join(b, ["merchant_id", "value_date"]).select("id", decompose.jaccard_bps(decompose.tokens(F.col("narration")), decompose.tokens(F.col("text"))).alias("jaccard_bps"))


@_query("WITH " + _MATCHED + """, t AS (SELECT m.id, b.id AS unit_id, list_distinct(regexp_extract_all(lower(m.narration), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(concat(b.id, ' ', b.utr)), '[a-z0-9]+')) AS x, abs(date_diff('day', b.cycle_end + 2, m.value_date)) AS days, abs(m.amount_paise - b.net_paise) AS gap
 FROM m JOIN batches b ON b.merchant_id = m.merchant_id AND b.cycle_end >= m.value_date - 5 AND b.cycle_end < m.value_date + 5 WHERE m.settlement_id IS NULL)
 SELECT id, unit_id, CAST(days * 1000 + least(gap // 100, 1000000) + ((10000 - 10000 * len(list_intersect(a, x)) // (len(a) + len(x) - len(list_intersect(a, x)))) * 5000) // 10000 AS BIGINT) AS cost FROM t""")
def pair_cost(d: Derived) -> DataFrame:
    rest = _matched(d).where("settlement_id IS NULL").drop("settlement_id", "reason")
    near = decompose.candidates(rest, d.batches.select("id", "merchant_id", "net_paise", F.col("cycle_end").alias("day")))
    near = near.join(d.batches.select(F.col("id").alias("unit_id"), F.concat_ws(" ", "id", "utr").alias("text")), "unit_id")
    return near.select("id", "unit_id", decompose.pair_cost(F.col("value_date"), F.col("amount_paise"), F.col("narration"), F.col("unit_day"), F.col("unit_paise"), F.col("text")).alias("cost"))


def _moves(d: Derived) -> DataFrame:
    """Queries that need them ask for them before the batches, whose sums are then read from them."""
    return d.moves


def _by_key(d: Derived) -> DataFrame:
    return d.keep("by_key", lambda: _matched(d))


def _units(d: Derived) -> DataFrame:
    """Batches that no credit has by key, the records of split batches with their lines, and those of no settlement."""
    return decompose.units(_moves(d), d.batches.withColumnRenamed("cycle_end", "day"), _by_key(d))


@_query("WITH " + _MATCHED + """, s AS (SELECT b.id FROM batches b WHERE b.utr IN (SELECT utr FROM m WHERE reason = 'structural_key_shared')),
 v AS (SELECT l.*, (settlement_id IS NOT NULL AND settlement_id NOT IN (SELECT id FROM s)) AS whole, CASE type WHEN 'fee_line' THEN substr(id, 5, 14) WHEN 'tax_line' THEN substr(id, 9, 14) ELSE id END AS unit FROM ledger l
 WHERE settlement_id IS NULL OR settlement_id NOT IN (SELECT settlement_id FROM m WHERE settlement_id IS NOT NULL))
 SELECT v.key AS id, coalesce(b.merchant_id, 'M-' || substr(min(v.settlement_id), 5, 2), min(p.merchant_id)) AS merchant_id, CAST(sum(signed_paise) AS BIGINT) AS net_paise, count(*) AS n_records, CAST(coalesce(b.cycle_end, min(v.day)) AS STRING) AS day
 FROM (SELECT *, CASE WHEN whole THEN settlement_id ELSE unit END AS key FROM v) v LEFT JOIN batches b ON b.id = v.key LEFT JOIN payments p ON p.id = v.key GROUP BY v.key, b.merchant_id, b.cycle_end""")
def unit_nets(d: Derived) -> DataFrame:
    return _units(d).select("id", "merchant_id", "net_paise", "n_records", F.col("day").cast("string"))


def _searched(d: Derived) -> DataFrame:
    units = _units(d)
    rest = _by_key(d).where("settlement_id IS NULL").drop("settlement_id", "reason")
    return d.keep("searched", lambda: decompose.searched(rest, units))


@_query()
def search_resolve(d: Derived) -> DataFrame:
    return _searched(d)


@_query()
def search_sums(d: Derived) -> DataFrame:
    """Each credit that the search resolves, with what the records of its units come to and the residual; the two make the credit."""
    found = _searched(d)
    sums = decompose.search_terms(found, _moves(d)).groupBy("credit_id").agg(F.sum("signed_paise").alias("terms_paise"), F.count("*").alias("n_terms"))
    own = d.bank_credits.select(F.col("id").alias("credit_id"), "amount_paise")
    return sums.join(found.select("credit_id", "residual_paise"), "credit_id").join(own, "credit_id").select("credit_id", "amount_paise", "terms_paise", "n_terms", "residual_paise")


@_query()
def cascade_unclaimed(d: Derived) -> DataFrame:
    """What neither proofs by key nor those by search claim, by type."""
    moves = _moves(d)
    left = ledger.left_by_cascade(moves, _by_key(d), decompose.search_terms(_searched(d), moves))
    return left.groupBy("type").agg(F.count("*").alias("n"), F.sum("signed_paise").alias("unclaimed_paise"))


@_query()
def cascade_outcomes(d: Derived) -> DataFrame:
    """How many credits each tier resolves or leaves, why, and what stays unexplained of them."""
    found = _searched(d)
    key = _conserved(d).select(F.lit("structural").alias("tier"), F.lit("resolved").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.col("unexplained_paise").alias("residual_paise"))
    rows = key.unionByName(found.select("tier", "outcome", "reason", "residual_paise"))
    return rows.groupBy("tier", "outcome", "reason").agg(F.count("*").alias("n"), F.sum("residual_paise").alias("unexplained_paise"))


@_query("WITH " + _MATCHED + """ SELECT m.id AS credit_id, m.settlement_id, count(*) AS n_terms, sha256(concat_ws('|', m.id, m.settlement_id, string_agg(concat_ws(':', l.type, l.id, CAST(l.signed_paise AS STRING)), ',' ORDER BY l.type, l.id))) AS proof_hash
 FROM m JOIN ledger l ON l.settlement_id = m.settlement_id GROUP BY m.id, m.settlement_id""")
def proof_hash(d: Derived) -> DataFrame:
    records = _ledger(d)
    return decompose.proofs(_matched(d), records)


def _conserved(d: Derived) -> DataFrame:
    return d.keep("conserved", lambda: verify.conservation(_by_key(d), d.sums))


_CASE = "CAST(sum(CASE WHEN l.type = '{}' THEN l.signed_paise ELSE 0 END) AS BIGINT) AS {}"
_CONSERVED = _MATCHED + ", c AS (SELECT m.id AS credit_id, m.settlement_id, m.amount_paise, " + ", ".join(_CASE.format(*x) for x in (("payment", "payments"), ("refund", "refunds"), ("chargeback", "chargebacks"), ("adjustment", "adjustments"), ("fee_line", "fees"), ("tax_line", "taxes"))) + ", CAST(m.amount_paise - sum(l.signed_paise) AS BIGINT) AS unexplained_paise FROM m JOIN ledger l ON l.settlement_id = m.settlement_id GROUP BY m.id, m.settlement_id, m.amount_paise)"


@_query("WITH " + _CONSERVED + " SELECT * FROM c")
def conservation(d: Derived) -> DataFrame:
    return _conserved(d)


@_query("WITH " + _CONSERVED + " SELECT credit_id, unexplained_paise = 0 AS balances FROM c")
def conservation_balances(d: Derived) -> DataFrame:
    return _conserved(d).select("credit_id", (F.col("unexplained_paise") == 0).alias("balances"))


@_query("WITH " + _MATCHED + " SELECT l.type, l.id, l.signed_paise FROM ledger l WHERE l.settlement_id IS NULL OR l.settlement_id NOT IN (SELECT settlement_id FROM m WHERE settlement_id IS NOT NULL)")
def unclaimed_records(d: Derived) -> DataFrame:
    return ledger.unsettled(_ledger(d), _matched(d)).select("type", "id", "signed_paise")


@_query("WITH " + _MATCHED + " SELECT l.type, CAST(sum(l.signed_paise) AS BIGINT) AS unclaimed_paise, count(*) AS n FROM ledger l WHERE l.settlement_id IS NULL OR l.settlement_id NOT IN (SELECT settlement_id FROM m WHERE settlement_id IS NOT NULL) GROUP BY ROLLUP (l.type)")
def unclaimed_total(d: Derived) -> DataFrame:
    return ledger.unsettled(d.sums, _matched(d)).rollup("type").agg(F.sum("signed_paise").alias("unclaimed_paise"), F.sum("n").alias("n"))


def _compared(d: Derived) -> DataFrame:
    settled = _payments(d).where("settlement_id IS NOT NULL")
    return verify.cells(d.fee_lines, d.tax_lines, contract.price(settled, d.rules))


def _cells(d: Derived) -> DataFrame:
    """Written once, for what reads also the cells that agree."""
    return d.keep("cells", lambda: _compared(d))


def _apart(d: Derived) -> DataFrame:
    """The few cells that differ, written alone: findings and what scores them need no others. Read from all cells if those are written."""
    return d.keep("apart", lambda: (_cells(d) if d.has("cells") else _compared(d)).where("fee_delta <> 0 OR tax_delta <> 0"))


_CELLS = f"""x AS (SELECT coalesce(a.id, b.id) AS payment_id, coalesce(a.fee_type, b.fee_type) AS fee_type, CAST(coalesce(b.fee, 0) - coalesce(a.fee, 0) AS BIGINT) AS fee_delta, CAST(coalesce(b.tax, 0) - coalesce(a.tax, 0) AS BIGINT) AS tax_delta
 FROM (SELECT id, fee_type, sum(fee_paise) AS fee, sum({_bps('fee_paise', '1800')}) AS tax FROM priced WHERE defect <> 'orphan' GROUP BY 1, 2) a
 FULL JOIN (SELECT f.applies_to_id AS id, f.fee_type, sum(f.amount_paise) AS fee, sum(t.amount_paise) AS tax FROM fee_lines f JOIN tax_lines t ON t.applies_to_fee_id = f.id GROUP BY 1, 2) b ON a.id = b.id AND a.fee_type = b.fee_type)"""


@_query("WITH " + _CELLS + " SELECT * FROM x")
def fee_tax_cells(d: Derived) -> DataFrame:
    return _cells(d)


def _findings(d: Derived) -> DataFrame:
    return d.keep("findings", lambda: verify.findings(_apart(d), _payments(d)))


_FINDINGS = _CELLS + """, y AS (SELECT x.*, p.stl AS settlement_id, p.amount_paise AS gross_paise FROM x JOIN tagged p ON p.id = x.payment_id WHERE p.defect <> 'orphan'),
 z AS (SELECT settlement_id, payment_id, fee_type, 0 AS rnk, CASE WHEN fee_delta < 0 THEN 'fee_undercharge' ELSE 'fee_overcharge' END AS class, abs(fee_delta) AS impact_paise, fee_delta AS delta_paise, gross_paise FROM y WHERE fee_delta <> 0 UNION ALL SELECT settlement_id, payment_id, fee_type, 1, 'tax_miscalculation', abs(tax_delta), tax_delta, gross_paise FROM y WHERE tax_delta <> 0),
 zn AS (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY rnk, payment_id, fee_type) AS nn FROM z),
 f AS (SELECT concat('FND-', settlement_id, '-', CASE WHEN nn < 1000 THEN lpad(CAST(nn AS STRING), 3, '0') ELSE CAST(nn AS STRING) END) AS id, settlement_id, payment_id, fee_type, class, impact_paise, delta_paise, gross_paise FROM zn)"""


@_query("WITH " + _FINDINGS + " SELECT * FROM f")
def findings_all(d: Derived) -> DataFrame:
    return _findings(d)


@_query("""SELECT id, payment_id, amount_paise FROM (SELECT id, payment_id, amount_paise, row_number() OVER (PARTITION BY amount_paise ORDER BY id) AS nth FROM chargebacks WHERE stage = 'won') c
 WHERE nth > (SELECT count(*) FROM adjustments a WHERE a.amount_paise = c.amount_paise)""")
def reversal_match(d: Derived) -> DataFrame:
    return verify.reversal_findings(d.chargebacks, d.adjustments)


@_query("WITH " + _CONSERVED + " SELECT credit_id, refund_id, refund_paise FROM (SELECT c.credit_id, r.id AS refund_id, r.amount_paise AS refund_paise, count(*) OVER (PARTITION BY credit_id) AS n FROM c JOIN refunds r ON r.stl = c.settlement_id AND r.amount_paise = -c.unexplained_paise) WHERE n = 1")
def refund_duplicate(d: Derived) -> DataFrame:
    return verify.refund_findings(_conserved(d), d.refunds.withColumnRenamed("stl", "settlement_id"))


def _clusters(d: Derived) -> DataFrame:
    rule = d.fee_lines.groupBy(F.col("applies_to_id").alias("payment_id"), "fee_type").agg(F.min("rule_id").alias("rule_id"))
    return verify.clusters(_findings(d), rule)


_CLUSTERS = _FINDINGS + """, u AS (SELECT f.*, r.rule_id, ((abs(impact_paise) * 10000 // gross_paise + 25) // 50) * 50 AS bucket_bps FROM f LEFT JOIN (SELECT applies_to_id, fee_type AS ft, min(rule_id) AS rule_id FROM fee_lines GROUP BY 1, 2) r ON r.applies_to_id = f.payment_id AND r.ft = f.fee_type),
 g AS (SELECT class, rule_id, bucket_bps, count(*) AS n_findings, CAST(sum(impact_paise) AS BIGINT) AS impact_paise, min(id) AS first_finding, concat('CLU-', substr(sha256(concat_ws('|', class, coalesce(rule_id, '-'), coalesce(CAST(bucket_bps AS STRING), '-'))), 1, 12)) AS cluster_id FROM u GROUP BY class, rule_id, bucket_bps)"""


@_query("WITH " + _CLUSTERS + " SELECT * FROM g")
def clusters_ranked(d: Derived) -> DataFrame:
    return _clusters(d).orderBy(F.desc("impact_paise"), "cluster_id")


@_query("WITH " + _CLUSTERS + " SELECT cluster_id, impact_paise FROM g ORDER BY impact_paise DESC, cluster_id LIMIT 10")
def top10_clusters(d: Derived) -> DataFrame:
    return _clusters(d).orderBy(F.desc("impact_paise"), "cluster_id").limit(10).select("cluster_id", "impact_paise")


@_query("WITH " + _CLUSTERS + " SELECT cluster_id, CAST(10000 * abs(impact_paise) // sum(abs(impact_paise)) OVER () AS BIGINT) AS share_bps FROM g")
def cluster_shares(d: Derived) -> DataFrame:
    rows = _clusters(d).select("cluster_id", F.abs("impact_paise").alias("size"))
    total = rows.agg(F.sum("size").alias("total"))
    return rows.join(F.broadcast(total)).select("cluster_id", ((10_000 * F.col("size") - (10_000 * F.col("size")) % F.col("total")) / F.col("total")).cast("long").alias("share_bps"))


def _confident(d: Derived) -> DataFrame:
    return _findings(d).withColumn("raw_bps", (F.abs("impact_paise") % 10_001).cast("long"))


def _breakpoints(d: Derived) -> DataFrame:
    return d.spark.createDataFrame([(1000, 500), (4000, 3500), (7000, 9000), (9000, 9900)], "raw_bps long, calibrated_bps long")


_LANES = _FINDINGS + """, l AS (SELECT id, impact_paise, raw, CASE WHEN raw < 1000 THEN 500 WHEN raw < 4000 THEN 500 + (raw - 1000) * 3000 // 3000 WHEN raw < 7000 THEN 3500 + (raw - 4000) * 5500 // 3000 WHEN raw < 9000 THEN 9000 + (raw - 7000) * 900 // 2000 ELSE 9900 END AS calibrated_bps FROM (SELECT *, abs(impact_paise) % 10001 AS raw FROM f)),
 n AS (SELECT *, CASE WHEN calibrated_bps >= 9500 THEN 'auto' WHEN calibrated_bps <= 3830 THEN 'escalate' ELSE 'propose' END AS lane FROM l)"""


def _lanes(d: Derived) -> DataFrame:
    return verify.calibrated(_confident(d), "raw_bps", _breakpoints(d)).withColumn("lane", verify.lane(F.col("calibrated_bps"), 9500, 3830))


@_query("WITH " + _LANES + " SELECT id, CAST(calibrated_bps AS BIGINT) AS calibrated_bps, lane FROM n")
def lane_calibrated(d: Derived) -> DataFrame:
    return _lanes(d).select("id", "calibrated_bps", "lane")


@_query("WITH " + _LANES + " SELECT v.lane, count(n.id) AS n, CAST(coalesce(sum(abs(impact_paise)), 0) AS BIGINT) AS paise FROM (VALUES ('auto'), ('propose'), ('escalate')) v(lane) LEFT JOIN n ON n.lane = v.lane GROUP BY 1")
def lane_buckets(d: Derived) -> DataFrame:
    lanes = d.spark.createDataFrame([("auto",), ("propose",), ("escalate",)], "lane string")
    return lanes.join(_lanes(d), "lane", "left").groupBy("lane").agg(F.count("id").alias("n"), F.coalesce(F.sum(F.abs("impact_paise")), F.lit(0)).alias("paise"))


@_query("WITH " + _LANES + ", k AS (SELECT id, sha256(concat('input:', id)) AS idempotency_key, abs(impact_paise) AS amount_paise, row_number() OVER (ORDER BY id) AS r FROM n WHERE lane = 'auto') SELECT idempotency_key, concat('JNL-', substr(idempotency_key, 1, 8)) AS id, id AS finding_id, 'settlement_receivable' AS debit_account, 'gateway_dispute' AS credit_account, amount_paise FROM k WHERE right(id, 1) <> '2'")
def journal_idempotent(d: Derived) -> DataFrame:
    auto = _lanes(d).where("lane = 'auto'")
    posted = auto.where("right(id, 1) = '2'").select(F.sha2(F.concat(F.lit("input:"), "id"), 256).alias("idempotency_key"))
    return verify.journal_entries(auto.unionByName(auto), "input", posted)


def _truth(d: Derived) -> DataFrame:
    cls = F.when(F.col("defect") == "tax_on_gross", "tax_miscalculation").when(F.col("defect") == "orphan", "missing_transaction").when((F.col("defect") == "stale_rate") & (F.col("card_type") == "credit"), "fee_undercharge").otherwise("fee_overcharge")
    return d.tagged.where("defect <> 'none'").select(F.col("id").alias("payment_id"), F.col("defect").alias("code"), cls.alias("class"))


_TRUTH = "t AS (SELECT id AS payment_id, defect AS code, CASE WHEN defect = 'tax_on_gross' THEN 'tax_miscalculation' WHEN defect = 'orphan' THEN 'missing_transaction' WHEN defect = 'stale_rate' AND card_type = 'credit' THEN 'fee_undercharge' ELSE 'fee_overcharge' END AS class FROM tagged WHERE defect <> 'none')"


@_query("WITH " + _FINDINGS + ", " + _TRUTH + """, h AS (SELECT t.payment_id, max(CASE WHEN f.class = t.class THEN 1 ELSE 0 END) AS ok FROM t JOIN f ON f.payment_id = t.payment_id GROUP BY 1)
 SELECT code, count(*) AS planted, CAST(sum(coalesce(ok, 0)) AS BIGINT) AS detected, count(CASE WHEN ok = 0 THEN 1 END) AS misclassified FROM t LEFT JOIN h ON h.payment_id = t.payment_id GROUP BY code""")
def detection_by_code(d: Derived) -> DataFrame:
    return evaluate.by_code(_findings(d), _truth(d))


@_query("WITH " + _FINDINGS + ", " + _TRUTH + " SELECT coalesce(t.class, 'none') AS true_class, f.class, count(*) AS n FROM f LEFT JOIN t ON t.payment_id = f.payment_id GROUP BY 1, 2")
def confusion_matrix(d: Derived) -> DataFrame:
    return evaluate.confusion(_findings(d), _truth(d))


@_query("WITH " + _FINDINGS + ", " + _TRUTH + """, a AS (SELECT f.class, count(CASE WHEN t.class = f.class THEN 1 END) AS tp, count(CASE WHEN t.class IS NULL OR t.class <> f.class THEN 1 END) AS fp FROM f LEFT JOIN t ON t.payment_id = f.payment_id GROUP BY 1),
 b AS (SELECT class, count(*) AS items, count(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.payment_id = t.payment_id AND f.class = t.class) THEN 1 END) AS hits FROM t GROUP BY 1)
 SELECT coalesce(a.class, b.class) AS class, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(items, 0) - coalesce(hits, 0) AS fn, CASE WHEN tp + fp > 0 THEN 10000 * tp // (tp + fp) ELSE 0 END AS precision_bps, CASE WHEN items > 0 THEN 10000 * hits // items ELSE 0 END AS recall_bps FROM a FULL JOIN b ON a.class = b.class""")
def class_prf(d: Derived) -> DataFrame:
    return evaluate.class_scores(_findings(d), _truth(d))


def _points(d: Derived) -> DataFrame:
    o = evaluate.outcomes(_confident(d), _truth(d))
    return o.select(F.col("raw_bps").alias("confidence_bps"), (F.col("verdict") == "true_positive").cast("long").alias("correct"), F.lit("verify_deterministic").alias("source"))


_POINTS = _FINDINGS + ", " + _TRUTH + ", p AS (SELECT abs(f.impact_paise) % 10001 AS c, CASE WHEN t.class = f.class THEN 1 ELSE 0 END AS ok FROM f LEFT JOIN t ON t.payment_id = f.payment_id)"


@_query("WITH " + _POINTS + " SELECT least(c // 1000, 9) AS bin, count(*) AS n, CAST(sum(c) AS BIGINT) AS sum_bps, CAST(sum(ok) AS BIGINT) AS n_correct FROM p GROUP BY 1")
def reliability_bins(d: Derived) -> DataFrame:
    return evaluate.reliability(_points(d))


@_query("WITH " + _POINTS + " SELECT CAST(sum((10000 * ok - c) * (10000 * ok - c)) AS BIGINT) AS brier_sum, count(*) AS n, (SELECT CAST(sum(abs(s - 10000 * k)) AS BIGINT) FROM (SELECT sum(c) AS s, sum(ok) AS k FROM p GROUP BY least(c // 1000, 9))) AS ece_sum_bps FROM p")
def ece_brier(d: Derived) -> DataFrame:
    p = _points(d)
    off = 10_000 * F.col("correct") - F.col("confidence_bps")
    ece = evaluate.reliability(p).agg(F.sum(F.abs(F.col("sum_bps") - 10_000 * F.col("n_correct"))).alias("ece_sum_bps"))
    return p.agg(F.sum(off * off).alias("brier_sum"), F.count("*").alias("n")).join(F.broadcast(ece))


@_query()
def isotonic_fit(d: Derived) -> DataFrame:
    return d.spark.createDataFrame(evaluate.isotonic_breakpoints(_points(d)), "raw_bps long, calibrated_bps long")


@_query()
def clopper_pearson_auto(d: Derived) -> DataFrame:
    return scoring.auto_threshold(_points(d).select("source", F.col("confidence_bps").alias("calibrated_bps"), (F.col("correct") == 1).alias("label")))


@_query("WITH " + _FINDINGS + " SELECT p.method, f.class, count(*) AS n, CAST(sum(f.impact_paise) AS BIGINT) AS paise FROM f JOIN payments p ON p.id = f.payment_id GROUP BY ROLLUP (p.method, f.class)")
def evidence_rollup(d: Derived) -> DataFrame:
    return _findings(d).join(d.payments.select(F.col("id").alias("payment_id"), "method"), "payment_id").rollup("method", "class").agg(F.count("*").alias("n"), F.sum("impact_paise").alias("paise"))


@_query("SELECT method, card_type, mcc, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS paise FROM payments GROUP BY GROUPING SETS ((method), (card_type), (mcc), ())")
def summary_grouping_sets(d: Derived) -> DataFrame:
    return d.payments.groupingSets([["method"], ["card_type"], ["mcc"], []], "method", "card_type", "mcc").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("paise"))


@_query("SELECT r.id, p.stl AS payment_stl, r.stl AS refund_stl FROM refunds r JOIN payments p ON p.id = r.payment_id WHERE r.stl IS DISTINCT FROM p.stl")
def cross_cycle_refunds(d: Derived) -> DataFrame:
    p = d.payments.select(F.col("id").alias("payment_id"), F.col("stl").alias("payment_stl"))
    return d.refunds.join(p, "payment_id").where("NOT (stl <=> payment_stl)").select("id", "payment_stl", F.col("stl").alias("refund_stl"))


@_query("WITH " + _CONSERVED + " SELECT CAST(b.value_date AS STRING) AS value_date, count(*) AS n_credits, CAST(sum(c.amount_paise) AS BIGINT) AS amount_paise, CAST(sum(c.unexplained_paise) AS BIGINT) AS unexplained_paise FROM c JOIN bank_credits b ON b.id = c.credit_id GROUP BY 1")
def settlement_timeline(d: Derived) -> DataFrame:
    days = d.bank_credits.select(F.col("id").alias("credit_id"), F.col("value_date").cast("string"))
    return _conserved(d).join(days, "credit_id").groupBy("value_date").agg(F.count("*").alias("n_credits"), F.sum("amount_paise").alias("amount_paise"), F.sum("unexplained_paise").alias("unexplained_paise")).orderBy("value_date")


@_query("WITH " + _CONSERVED + " SELECT CAST((SELECT sum(amount_paise) FROM bank_credits) AS BIGINT) AS volume_paise, CAST(sum(amount_paise) AS BIGINT) AS matched_paise, least(10000, greatest(0, CAST(10000 * count(CASE WHEN unexplained_paise = 0 THEN 1 END) // count(*) AS BIGINT))) AS balanced_bps FROM c")
def score_cards(d: Derived) -> DataFrame:
    balanced, n = F.count(F.when(F.col("unexplained_paise") == 0, 1)), F.count("*")
    bps = ((10_000 * balanced - (10_000 * balanced) % n) / n).cast("long")
    volume = d.bank_credits.agg(F.sum("amount_paise").alias("volume_paise"))
    return _conserved(d).agg(F.sum("amount_paise").alias("matched_paise"), F.least(F.lit(10_000).cast("long"), F.greatest(F.lit(0).cast("long"), bps)).alias("balanced_bps")).join(F.broadcast(volume))


_RECON = """rc AS (SELECT p.id AS entity_id, CASE WHEN k % 211 = 7 THEN 'transfer' ELSE 'payment' END AS type, p.amount_paise AS amount, f.fee, f.tax, p.amount_paise - f.fee - f.tax + CASE WHEN k % 223 = 9 THEN 1 ELSE 0 END AS credit, k % 227 <> 11 AS settled, p.stl AS settlement_id, k
 FROM payments p JOIN (SELECT k AS fk, CAST(sum(fee_paise) AS BIGINT) AS fee, CAST(sum(CAST((fee_paise * 1800 + 5000 - (fee_paise * 1800 + 5000) % 10000) / 10000 AS BIGINT)) AS BIGINT) AS tax FROM priced GROUP BY 1) f ON f.fk = p.k)"""


def _recon(d: Derived) -> DataFrame:
    fees = contract.price(d.payments, d.rules).groupBy("id").agg(F.sum("fee_paise").alias("fee"), F.sum("tax_paise").alias("tax"))
    k = F.col("k")
    return d.payments.join(fees, "id").select(
        F.col("id").alias("entity_id"), F.when(k % 211 == 7, "transfer").otherwise("payment").alias("type"), F.col("amount_paise").alias("amount"), "fee", "tax",
        (F.col("amount_paise") - F.col("fee") - F.col("tax") + F.when(k % 223 == 9, 1).otherwise(0)).alias("credit"), (k % 227 != 11).alias("settled"), F.col("stl").alias("settlement_id"), "k",
    )


@_query("WITH " + _RECON + " SELECT n_excludes, n_includes, CASE WHEN n_includes > n_excludes THEN 'fee_includes_tax' ELSE 'fee_excludes_tax' END AS convention FROM (SELECT count(CASE WHEN credit = amount - fee - tax THEN 1 END) AS n_excludes, count(CASE WHEN credit = amount - fee THEN 1 END) AS n_includes FROM rc WHERE type = 'payment' AND tax <> 0) v")
def fee_convention(d: Derived) -> DataFrame:
    return ingest.fee_convention(_recon(d))


_FLAGGED = _RECON + ", q AS (SELECT rc.*, CASE WHEN type = 'transfer' THEN 'unsupported_type' WHEN NOT settled THEN 'unsettled' WHEN settlement_id LIKE 'STL-03%' OR settlement_id NOT IN (SELECT id FROM batches) THEN 'settlement_without_credit' WHEN k % 229 = 13 THEN 'missing_payment_detail' WHEN credit <> amount - fee - tax THEN 'credit_does_not_reconcile' END AS reason FROM rc)"


def _flagged(d: Derived) -> DataFrame:
    return ingest.quarantine(_recon(d), d.batches.where("id NOT LIKE 'STL-03%'"), d.payments.where("k % 229 <> 13").select("id", "method"))


@_query("WITH " + _FLAGGED + " SELECT reason, count(*) AS n, CAST(sum(amount) AS BIGINT) AS paise FROM q WHERE reason IS NOT NULL GROUP BY 1")
def quarantine_reasons(d: Derived) -> DataFrame:
    return _flagged(d).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"), F.sum("amount").alias("paise")).orderBy(F.desc("n"), "reason")


@_query("WITH " + _FLAGGED + " SELECT entity_id, settlement_id FROM q WHERE reason IS NULL AND settlement_id NOT IN (SELECT settlement_id FROM q WHERE reason IS NOT NULL)")
def quarantine_survivors(d: Derived) -> DataFrame:
    return ingest.complete(_flagged(d)).select("entity_id", "settlement_id")


@_query("""SELECT o AS l_orderkey, i AS line, CAST(fl + CASE WHEN rk <= amount - sf THEN 1 ELSE 0 END AS BIGINT) AS share FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY rest DESC, i) AS rk, sum(fl) OVER (PARTITION BY o) AS sf
 FROM (SELECT o, i, amount, amount * w % tw AS rest, (amount * w - amount * w % tw) // tw AS fl FROM (SELECT *, CAST(sum(w) OVER (PARTITION BY o) AS BIGINT) AS tw FROM (SELECT l_orderkey AS o, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS i, CAST(l_quantity AS BIGINT) AS w, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey))))""")
def split_largest_remainder(d: Derived) -> DataFrame:
    from pyspark.sql.window import Window

    lines = d.spark.read.parquet(f"{d.sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orders = d.spark.read.parquet(f"{d.sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = lines.withColumn("line", F.row_number().over(order).cast("long")).join(orders, "l_orderkey").withColumn("weight", F.col("l_quantity").cast("long"))
    return money.split_largest_remainder(rows, "l_orderkey", "line", "amount", "weight").select("l_orderkey", "line", "share")


@_query("SELECT id, concat(CASE WHEN signed_paise < 0 THEN '-' ELSE '' END, CAST(abs(signed_paise) // 100 AS STRING), '.', lpad(CAST(abs(signed_paise) % 100 AS STRING), 2, '0')) AS rupees FROM ledger WHERE type IN ('refund', 'payment')")
def money_format(d: Derived) -> DataFrame:
    return _ledger(d).where("type IN ('refund', 'payment')").select("id", money.to_rupees(F.col("signed_paise")).alias("rupees"))


@_query("SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n, CAST(sum(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS paise FROM events WHERE event_type = 'purchase' GROUP BY 1")
def daily_volume(d: Derived) -> DataFrame:
    from tallyforge.streaming.posting import daily_volume as volume

    rows = d.spark.read.parquet(f"{d.sf_dir}/events.parquet").where("event_type = 'purchase'").select(F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("paise"))
    return volume(rows, "ts", "paise").select(F.col("day").cast("date").cast("string").alias("day"), "n", "paise")


#: What a fingerprint covers of each table that the audit reads.
_PRINTED = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "CAST(ROUND(o_totalprice * 100) AS BIGINT)", "CAST(o_orderdate AS DATE)"),
    "customer": ("c_custkey", "c_nationkey", "c_mktsegment"),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS BIGINT)"),
    "events": ("event_type", "CAST(ROUND(value * 100) AS BIGINT)"),
}


def _printed(hashed: str, digits: str) -> str:
    """A row for each table: how many rows, and sums of parts of their rows' hashes, which no order of rows or files changes."""
    text = lambda c: f"coalesce(CAST({c} AS STRING), '-')"
    one = "SELECT '{0}' AS name, count(*) AS n_rows, " + ", ".join(f"CAST(sum({digits.format(1 + 8 * i)}) AS BIGINT) AS h{i}" for i in range(3)) + " FROM (SELECT {1} AS x FROM {0}) q_{0}"
    return " UNION ALL ".join(one.format(t, hashed.format("concat_ws('|', " + ", ".join(map(text, cols)) + ")")) for t, cols in _PRINTED.items())


@_query(_printed("sha256({})", "CAST('0x' || substr(x, {}, 8) AS BIGINT)"))
def input_fingerprint(d: Derived) -> DataFrame:
    sql = _printed("sha2({}, 256)", "CAST(conv(substr(x, {}, 8), 16, 10) AS BIGINT)")
    for t in _PRINTED:
        getattr(d, t).createOrReplaceTempView(f"tallyforge_{t}")
        sql = sql.replace(f"FROM {t})", f"FROM tallyforge_{t})")
    return d.spark.sql(sql)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""More registered audit queries: a whole run's findings and proofs, rule scopes, taxes by rule, scoring. Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators import contract, evaluate, ingest, ledger, verify
from tallyforge.operators.components import parts
from tallyforge.plans.derived import Derived, _bps
from tallyforge.plans.queries import _CELLS, _CONSERVED, _FINDINGS, _MATCHED, _POINTS, _RECON, _TRUTH, _apart, _confident, _conserved, _findings, _ledger, _matched, _payments, _points, _query, _recon, _truth, shared_payments

#: Rules with networks, merchant codes and revisions; s2 leaves a gap of days, s6 changes its scope.
SCOPED = """SELECT * FROM (VALUES
 ('s1', 'mdr', 'card', 'visa', CAST(NULL AS STRING), CAST(NULL AS BOOLEAN), '57*', 0, CAST(NULL AS BIGINT), DATE '1990-01-01', DATE '1996-01-01', 150, 0, CAST(NULL AS BIGINT), CAST(NULL AS STRING)),
 ('s2', 'mdr', 'card', 'visa', NULL, NULL, '57*', 0, NULL, DATE '1996-02-01', NULL, 155, 0, NULL, 's1'),
 ('s3', 'mdr', 'card', NULL, 'debit', NULL, '5*', 0, 500000, DATE '1990-01-01', NULL, 90, 0, NULL, NULL),
 ('s4', 'mdr', 'card', 'rupay', NULL, FALSE, '5211', 0, NULL, DATE '1990-01-01', DATE '1997-01-01', 60, 0, NULL, NULL),
 ('s5', 'mdr', 'card', 'rupay', NULL, FALSE, '5211', 0, NULL, DATE '1997-01-01', NULL, 65, 0, NULL, 's4'),
 ('s6', 'mdr', 'card', 'amex', NULL, NULL, '5046', 0, NULL, DATE '1997-01-01', NULL, 210, 0, NULL, 's4'),
 ('s7', 'mdr', 'upi', NULL, NULL, NULL, NULL, 0, NULL, DATE '1990-01-01', NULL, 0, 100, NULL, NULL)
) AS t(rule_id, fee_type, method, network, card_type, is_international, mcc_pattern, amount_min, amount_max, effective_from, effective_to, rate_bps, fixed_fee, cap, supersedes)"""

_NETWORK = "CASE WHEN method = 'card' THEN CASE k % 4 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'rupay' ELSE 'amex' END END"


def _scoped(d: Derived) -> DataFrame:
    return d.spark.sql(SCOPED)


def _hits(d: Derived) -> DataFrame:
    """Which scoped rules apply to which payments."""
    return contract.match(d.payments.withColumn("network", F.expr(_NETWORK)), _scoped(d)).select("id", F.col("r_rule_id").alias("rule_id"))


_HITS = """SELECT p.id, s.rule_id FROM {p} p JOIN {s} s ON s.method = p.method AND (s.network IS NULL OR s.network = p.network) AND (s.card_type IS NULL OR s.card_type = p.card_type) AND (s.is_international IS NULL OR s.is_international = p.is_international)
 AND (s.mcc_pattern IS NULL OR p.mcc LIKE replace(s.mcc_pattern, '*', '%')) AND p.amount_paise >= s.amount_min AND (s.amount_max IS NULL OR p.amount_paise < s.amount_max) AND p.day >= s.effective_from AND (s.effective_to IS NULL OR p.day < s.effective_to)"""


@_query(f"""WITH s AS ({SCOPED}), p AS (SELECT *, {_NETWORK} AS network FROM payments)
 SELECT p.id, s.rule_id FROM p JOIN s ON s.method = p.method AND (s.network IS NULL OR s.network = p.network) AND (s.card_type IS NULL OR s.card_type = p.card_type) AND (s.is_international IS NULL OR s.is_international = p.is_international)
 AND (s.mcc_pattern IS NULL OR p.mcc LIKE replace(s.mcc_pattern, '*', '%')) AND p.amount_paise >= s.amount_min AND (s.amount_max IS NULL OR p.amount_paise < s.amount_max) AND p.day >= s.effective_from AND (s.effective_to IS NULL OR p.day < s.effective_to)""")
def rule_scope_match(d: Derived) -> DataFrame:
    return contract.match(d.payments.withColumn("network", F.expr(_NETWORK)), _scoped(d)).select("id", F.col("r_rule_id").alias("rule_id"))


@_query(f"""WITH s AS (SELECT *, coalesce(amount_max, 4611686018427387904) AS hi, coalesce(effective_to, DATE '9999-12-31') AS until, replace(mcc_pattern, '*', '') AS stem FROM ({SCOPED}) q)
, hp AS (SELECT *, {_NETWORK} AS network FROM payments), h AS ({_HITS.format(s='s', p='hp')}), n AS (SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, count(*) AS n FROM h a JOIN h b ON a.id = b.id AND a.rule_id < b.rule_id GROUP BY ALL)
 SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, coalesce(n.n, 0) AS n_payments FROM s a JOIN s b ON a.rule_id < b.rule_id AND ((a.fee_type = b.fee_type AND a.rate_bps > 0 AND b.rate_bps > 0) OR (a.fixed_fee > 0 AND b.fixed_fee > 0)) AND a.method = b.method AND coalesce(a.network = b.network, TRUE) AND coalesce(a.card_type = b.card_type, TRUE) AND coalesce(a.is_international = b.is_international, TRUE)
 AND coalesce(a.mcc_pattern = b.mcc_pattern OR (a.mcc_pattern LIKE '%*' AND starts_with(b.stem, a.stem)) OR (b.mcc_pattern LIKE '%*' AND starts_with(a.stem, b.stem)), TRUE)
 AND greatest(a.amount_min, b.amount_min) < least(a.hi, b.hi) AND greatest(a.effective_from, b.effective_from) < least(a.until, b.until) LEFT JOIN n ON n.rule_a = a.rule_id AND n.rule_b = b.rule_id""")
def rule_scope_overlaps(d: Derived) -> DataFrame:
    """Scoped rules that could meet on a payment, and on how many of the table they do."""
    return shared_payments(contract.overlaps(_scoped(d)), _hits(d))


@_query(f"""WITH s AS ({SCOPED}), hp AS (SELECT *, {_NETWORK} AS network FROM payments), h AS ({_HITS.format(s='s', p='hp')})
 SELECT n.rule_id, n.supersedes, (SELECT count(*) FROM h WHERE h.rule_id = n.rule_id) AS n_payments, CASE WHEN o.effective_to IS DISTINCT FROM n.effective_from THEN 'not_contiguous' ELSE 'scope_changed' END AS fault FROM s n JOIN s o ON o.rule_id = n.supersedes
 WHERE o.effective_to IS DISTINCT FROM n.effective_from OR o.network IS DISTINCT FROM n.network OR o.card_type IS DISTINCT FROM n.card_type OR o.is_international IS DISTINCT FROM n.is_international OR o.mcc_pattern IS DISTINCT FROM n.mcc_pattern""")
def rule_supersession(d: Derived) -> DataFrame:
    """Rules whose hand-over is not right, and how many payments are charged by them."""
    n = _hits(d).groupBy("rule_id").agg(F.count("*").alias("n_payments"))
    return contract.supersession_faults(_scoped(d)).join(n, "rule_id", "left").na.fill(0, ["n_payments"])


_TREATMENTS = "SELECT * FROM (VALUES ('upi', 'gst', 1800, 'fee_amount'), ('netbanking', 'gst', 1800, 'fee_amount'), ('netbanking', 'tds', 100, 'transaction_gross'), ('card.international', 'cess', 50, 'fee_amount')) AS t(rule_id, tax_type, rate_bps, base)"


@_query(f"""WITH w AS ({_TREATMENTS}) SELECT p.id, p.rule_id, w.tax_type, p.fee_type AS on_fee_type, CAST(p.fee_paise AS BIGINT) AS base_paise, {_bps('p.fee_paise', 'w.rate_bps')} AS tax_paise FROM priced p JOIN w ON w.rule_id = p.rule_id AND w.base = 'fee_amount'
 UNION ALL SELECT p.id, r.rule_id, w.tax_type, NULL, p.amount_paise, {_bps('p.amount_paise', 'w.rate_bps')} FROM payments p JOIN rules r ON r.method = p.method AND p.day >= r.effective_from JOIN w ON w.rule_id = r.rule_id AND w.base = 'transaction_gross'""")
def taxes_by_rule(d: Derived) -> DataFrame:
    return contract.taxes(d.payments, d.rules, d.spark.sql(_TREATMENTS))


def _proven(d: Derived) -> DataFrame:
    return _matched(d).where("settlement_id IS NOT NULL").select(F.col("id").alias("credit_id"), "settlement_id")


def _run_findings(d: Derived) -> DataFrame:
    own = lambda t: getattr(d, t).withColumnRenamed("stl", "settlement_id")
    return verify.run_findings("RUN", _apart(d), _payments(d), _proven(d), _conserved(d), own("chargebacks"), d.adjustments, own("refunds"))


_SIDE = "SELECT m.id AS credit_id, 0 AS kind, x.payment_id AS ref_id, {side} AS side, {cls} AS class, x.fee_type, abs({delta}) AS impact_paise, p.amount_paise AS gross_paise FROM x JOIN tagged p ON p.id = x.payment_id AND p.defect <> 'orphan' JOIN m ON m.settlement_id = p.stl WHERE {delta} <> 0"
_RUN = (
    _CONSERVED + ", " + _CELLS + ", rf AS (" + _SIDE.format(side=0, cls="CASE WHEN fee_delta < 0 THEN 'fee_undercharge' ELSE 'fee_overcharge' END", delta="fee_delta") + " UNION ALL " + _SIDE.format(side=1, cls="'tax_miscalculation'", delta="tax_delta")
    + """ UNION ALL SELECT credit_id, 1, id, 0, 'chargeback_amount_mismatch', NULL, amount_paise, NULL FROM (SELECT cb.id, cb.amount_paise, m.id AS credit_id, row_number() OVER (PARTITION BY cb.amount_paise ORDER BY m.id, cb.id) AS nth FROM chargebacks cb JOIN m ON m.settlement_id = cb.stl WHERE cb.stage = 'won') w
 WHERE nth > (SELECT count(*) FROM adjustments a WHERE a.amount_paise = w.amount_paise)
 UNION ALL SELECT credit_id, 2, id, 0, 'refund_amount_mismatch', NULL, amount_paise, NULL FROM (SELECT c.credit_id, r.id, r.amount_paise, count(*) OVER (PARTITION BY credit_id) AS n FROM c JOIN refunds r ON r.stl = c.settlement_id AND r.amount_paise = -c.unexplained_paise) v WHERE n = 1),
 rg AS (SELECT *, row_number() OVER (PARTITION BY credit_id ORDER BY kind, ref_id, side, fee_type) AS n FROM rf),
 rn AS (SELECT concat('FND-RUN-', credit_id, '-', CASE WHEN n < 1000 THEN lpad(CAST(n AS STRING), 3, '0') ELSE CAST(n AS STRING) END) AS id, credit_id, class, ref_id, fee_type, CAST(impact_paise AS BIGINT) AS impact_paise, CAST(gross_paise AS BIGINT) AS gross_paise FROM rg)"""
)


@_query("WITH " + _RUN + " SELECT * FROM rn")
def run_findings(d: Derived) -> DataFrame:
    return _run_findings(d)


_MEMBERS = _RUN + """, rc AS (SELECT rn.*, r.rule_id, ((impact_paise * 10000 // gross_paise + 25) // 50) * 50 AS bucket_bps FROM rn LEFT JOIN (SELECT applies_to_id, fee_type AS ft, arg_min(rule_id, id) AS rule_id FROM fee_lines GROUP BY 1, 2) r ON r.applies_to_id = rn.ref_id AND r.ft = rn.fee_type),
 rm AS (SELECT id, impact_paise, concat_ws('-', 'CLU-RUN', class, coalesce(rule_id, 'none'), coalesce(CAST(bucket_bps AS STRING), 'none')) AS cluster_id FROM rc)"""


def _members(d: Derived) -> DataFrame:
    return verify.cluster_members("RUN", _run_findings(d), d.fee_lines)


@_query("WITH " + _MEMBERS + " SELECT cluster_id, id AS finding_id FROM rm")
def cluster_findings(d: Derived) -> DataFrame:
    return _members(d).select("cluster_id", F.col("id").alias("finding_id"))


@_query("WITH " + _MEMBERS + " SELECT cluster_id, count(*) AS n_findings, CAST(sum(impact_paise) AS BIGINT) AS impact_paise FROM rm GROUP BY 1")
def run_clusters(d: Derived) -> DataFrame:
    return _members(d).groupBy("cluster_id").agg(F.count("*").alias("n_findings"), F.sum("impact_paise").alias("impact_paise")).orderBy(F.desc("impact_paise"), "cluster_id")


@_query("WITH " + _MATCHED + " SELECT l.type, l.id, m.id AS credit_id FROM ledger l JOIN m ON m.settlement_id = l.settlement_id")
def record_claims(d: Derived) -> DataFrame:
    """Which proof claims each record."""
    return _ledger(d).join(_proven(d), "settlement_id").select("type", "id", "credit_id")


_B = "CAST(substr({}, 4, 6) AS BIGINT)"


@_query("WITH " + _CONSERVED + f""", o AS (SELECT l.*, m.id AS credit_id, {_B.format('m.id')} AS b, row_number() OVER (PARTITION BY m.id ORDER BY l.type, l.id) AS nth, count(*) OVER (PARTITION BY m.id) AS n FROM ledger l JOIN m ON m.settlement_id = l.settlement_id),
 kept AS (SELECT credit_id, b, n, count(*) AS kept, sum(signed_paise) AS recomputed FROM o WHERE NOT (b % 7 = 1 AND nth = 1) GROUP BY ALL),
 w AS (SELECT c.credit_id, {_B.format('c.credit_id')} AS b, c.amount_paise - c.unexplained_paise AS total, coalesce(kept.recomputed, 0) AS recomputed, coalesce(kept.kept, 0) AS kept FROM c LEFT JOIN kept ON kept.credit_id = c.credit_id)
 SELECT credit_id, 'sum_differs' AS failure FROM w WHERE recomputed <> total + CASE WHEN b % 5 = 0 THEN 1 ELSE 0 END
 UNION ALL SELECT credit_id, 'residual_differs' FROM w WHERE b % 5 = 0
 UNION ALL SELECT credit_id, 'not_the_batch' FROM w WHERE b % 7 = 1
 UNION ALL SELECT credit_id, 'term_differs' FROM w WHERE b % 11 = 2 AND kept > 0
 UNION ALL SELECT credit_id, 'term_repeated' FROM w WHERE b % 13 = 3 AND kept > 0
 UNION ALL SELECT credit_id, 'reason_of_resolved' FROM w WHERE b % 19 = 5""")
def proof_checks(d: Derived) -> DataFrame:
    """The structural proofs with planted faults, by the number in the credit's id, and what the checks say."""
    b = F.expr(_B.format("credit_id"))
    records, conserved = _ledger(d), _conserved(d)
    total = F.col("amount_paise") - F.col("unexplained_paise")
    proofs = conserved.select(
        "credit_id", F.lit("structural").alias("tier"), F.lit("resolved").alias("outcome"), F.when(b % 19 == 5, "key_shared").alias("reason"), "settlement_id",
        F.col("amount_paise").alias("credit_paise"), (total + F.when(b % 5 == 0, 1).otherwise(0)).alias("sum_paise"), F.col("unexplained_paise").alias("residual_paise"),
    )
    rows = records.join(_proven(d), "settlement_id").repartition(parts(d.spark, records.count()), "credit_id")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("credit_id").orderBy("type", "id"))).where(~((b % 7 == 1) & (F.col("pos") == 1)))
    first = F.col("pos") == F.when(b % 7 == 1, 2).otherwise(1)
    rows = rows.withColumn("signed_paise", F.col("signed_paise") + F.when((b % 11 == 2) & first, 1).otherwise(0))
    rows = rows.withColumn("copy", F.explode(F.when((b % 13 == 3) & first, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return verify.proof_failures(proofs, rows.select("credit_id", (F.col("pos") * 2 + F.col("copy")).alias("pos"), "type", "id", "signed_paise"), d.bank_credits, records, d.batches)


@_query("WITH " + _MATCHED + " SELECT 'structural' AS tier, CASE WHEN settlement_id IS NULL THEN 'left' ELSE 'resolved' END AS outcome, reason, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS paise FROM m GROUP BY ALL")
def decomposition_stats(d: Derived) -> DataFrame:
    outcome = F.when(F.col("settlement_id").isNull(), "left").otherwise("resolved")
    return _matched(d).groupBy(F.lit("structural").alias("tier"), outcome.alias("outcome"), "reason").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("paise"))


@_query("WITH " + _CONSERVED + """ SELECT CAST(resolved + other AS BIGINT) AS unexplained_paise, CAST(unclaimed AS BIGINT) AS unclaimed_paise, CAST(resolved + other + unclaimed AS BIGINT) AS unaccounted_paise
 FROM (SELECT (SELECT sum(unexplained_paise) FROM c) AS resolved, (SELECT sum(amount_paise) FROM m WHERE settlement_id IS NULL) AS other, (SELECT sum(signed_paise) FROM ledger WHERE settlement_id IS NULL OR settlement_id NOT IN (SELECT settlement_id FROM m WHERE settlement_id IS NOT NULL)) AS unclaimed) s""")
def run_totals(d: Derived) -> DataFrame:
    """Unexplained (a credit without a proof counts whole), unclaimed, and their sum."""
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    matched = _matched(d)
    own = _conserved(d).agg(zero("unexplained_paise", "resolved"))
    other = matched.where("settlement_id IS NULL").agg(zero("amount_paise", "other"))
    left = ledger.unsettled(d.sums, matched).agg(zero("signed_paise", "unclaimed_paise"))
    rows = own.join(F.broadcast(other)).join(F.broadcast(left))  # three rows of one
    unexplained = F.col("resolved") + F.col("other")
    return rows.select(unexplained.alias("unexplained_paise"), "unclaimed_paise", (unexplained + F.col("unclaimed_paise")).alias("unaccounted_paise"))


@_query("WITH " + _CONSERVED + """, s AS (SELECT 'credits_decomposed' AS card, count(CASE WHEN settlement_id IS NOT NULL THEN 1 END) AS part, count(*) AS whole FROM m UNION ALL SELECT 'clean_credits', count(CASE WHEN unexplained_paise = 0 THEN 1 END), count(*) FROM c),
 r AS (SELECT card, CASE WHEN whole = 0 THEN 10000 ELSE greatest(0, least(10000, 10000 * part // whole)) END AS value_bps FROM s) SELECT card, CAST(value_bps AS BIGINT) AS value_bps, CASE WHEN value_bps >= 8000 THEN 'strong' WHEN value_bps >= 4000 THEN 'moderate' ELSE 'weak' END AS strength FROM r""")
def card_strengths(d: Derived) -> DataFrame:
    done = _matched(d).agg(F.lit("credits_decomposed").alias("card"), F.count("settlement_id").alias("part"), F.count("*").alias("whole"))
    clean = _conserved(d).agg(F.lit("clean_credits").alias("card"), F.count(F.when(F.col("unexplained_paise") == 0, 1)).alias("part"), F.count("*").alias("whole"))
    product = 10_000 * F.col("part")
    bps = F.when(F.col("whole") == 0, 10_000).otherwise(F.least(F.lit(10_000), ((product - product % F.col("whole")) / F.col("whole")).cast("long"))).cast("long")
    return done.unionByName(clean).select("card", bps.alias("value_bps"), verify.strength(bps).alias("strength"))


@_query("WITH " + _CONSERVED + """, e AS (SELECT c.credit_id, c.unexplained_paise AS residual_paise, CAST(coalesce(sum(r.signed_paise), 0) AS BIGINT) AS explained_paise FROM c LEFT JOIN ledger r ON r.settlement_id = c.settlement_id AND r.type = 'refund' WHERE c.unexplained_paise <> 0 GROUP BY 1, 2)
 SELECT *, CASE WHEN explained_paise <> 0 AND (explained_paise > 0) = (residual_paise > 0) THEN CAST(10000 * least(abs(explained_paise), abs(residual_paise)) // abs(residual_paise) AS BIGINT) ELSE 0 END AS coverage_bps FROM e""")
def citation_coverage(d: Derived) -> DataFrame:
    """How far each residual's refunds, cited for it, explain it."""
    cited = d.sums.where("type = 'refund'").groupBy("settlement_id").agg(F.sum("signed_paise").alias("explained_paise"))
    rows = _conserved(d).where("unexplained_paise <> 0").join(cited, "settlement_id", "left").select("credit_id", F.col("unexplained_paise").alias("residual_paise"), F.coalesce("explained_paise", F.lit(0)).cast("long").alias("explained_paise"))
    return rows.withColumn("coverage_bps", verify.coverage_bps(F.col("explained_paise"), F.col("residual_paise")))


_EVERY = _FINDINGS + ", " + _TRUTH + ", j AS (SELECT f.id, f.class, t.class AS true_class, t.payment_id AS item FROM f LEFT JOIN t ON t.payment_id = f.payment_id), q AS (SELECT coalesce(true_class, 'no_discrepancy') AS true_class, class, count(*) AS n FROM j GROUP BY 1, 2 UNION ALL SELECT class, 'not_detected', count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.payment_id = t.payment_id AND f.class = t.class) GROUP BY 1)"
_ROWS = _EVERY + """, k AS (SELECT true_class AS class FROM q UNION SELECT class FROM q), cr AS (SELECT k.class, coalesce(sum(CASE WHEN q.true_class = k.class AND q.class = k.class THEN n END), 0) AS tp, coalesce(sum(CASE WHEN q.true_class <> k.class AND q.class = k.class THEN n END), 0) AS fp, coalesce(sum(CASE WHEN q.true_class = k.class AND q.class <> k.class THEN n END), 0) AS fn
 FROM k CROSS JOIN q WHERE k.class NOT IN ('no_discrepancy', 'not_detected') GROUP BY 1), ra AS (SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall FROM cr),
 rb AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ra)"""


@_query("WITH " + _EVERY + " SELECT * FROM q")
def confusion_sentinels(d: Derived) -> DataFrame:
    return evaluate.full_confusion(_findings(d), _truth(d))


def _pooled_rows(d: Derived) -> DataFrame:
    """Each merchant's payments as a run of its own; the runs' counts are added."""
    run = d.tagged.select(F.col("id").alias("payment_id"), F.col("merchant_id").alias("run"))
    runs = evaluate.full_confusion(_findings(d).join(run, "payment_id"), _truth(d).join(run, "payment_id"), "run")
    return evaluate.class_rows(evaluate.pooled(runs))


@_query("WITH " + _ROWS + " SELECT class, tp, fp, fn, CAST(round(10000 * precision) AS BIGINT) AS precision_bps, CAST(round(10000 * recall) AS BIGINT) AS recall_bps, CAST(round(10000 * f1) AS BIGINT) AS f1_bps FROM rb")
def pooled_class_rows(d: Derived) -> DataFrame:
    return _pooled_rows(d).select("class", "tp", "fp", "fn", *(F.round(10_000 * F.col(c)).cast("long").alias(f"{c}_bps") for c in ("precision", "recall", "f1")))


@_query("WITH " + _ROWS + """, mi AS (SELECT CAST(sum(tp) AS DOUBLE) / sum(tp + fp) AS p, CAST(sum(tp) AS DOUBLE) / sum(tp + fn) AS r FROM rb)
 SELECT 'macro' AS average, CAST(round(10000 * avg(precision)) AS BIGINT) AS precision_bps, CAST(round(10000 * avg(recall)) AS BIGINT) AS recall_bps, CAST(round(10000 * avg(f1)) AS BIGINT) AS f1_bps FROM rb
 UNION ALL SELECT 'micro', CAST(round(10000 * p) AS BIGINT), CAST(round(10000 * r) AS BIGINT), CAST(round(10000 * 2 * p * r / (p + r)) AS BIGINT) FROM mi""")
def macro_micro(d: Derived) -> DataFrame:
    return evaluate.averages(_pooled_rows(d)).select("average", *(F.round(10_000 * F.col(c)).cast("long").alias(f"{c}_bps") for c in ("precision", "recall", "f1")))


@_query("WITH " + _FINDINGS + ", " + _TRUTH + ", h AS (SELECT count(*) AS planted, count(CASE WHEN payment_id IN (SELECT payment_id FROM f) THEN 1 END) AS touched FROM t) SELECT *, 10000 * touched // planted AS recall_bps FROM h")
def recall_by_record(d: Derived) -> DataFrame:
    return evaluate.recall_by_record(_findings(d), _truth(d))


@_query("WITH " + _FINDINGS + ", " + _TRUTH + ", h AS (SELECT t.code, t.payment_id, max(CASE WHEN f.class = t.class THEN 1 ELSE 0 END) AS ok FROM t LEFT JOIN f ON f.payment_id = t.payment_id GROUP BY 1, 2) SELECT h.code, count(*) AS planted, CAST(sum(p.amount_paise) AS BIGINT) AS planted_paise FROM h JOIN payments p ON p.id = h.payment_id GROUP BY 1 HAVING max(ok) = 0")
def undetected_codes(d: Derived) -> DataFrame:
    return evaluate.undetected(_findings(d), _truth(d).join(d.payments.select(F.col("id").alias("payment_id"), "amount_paise"), "payment_id"))


@_query("WITH " + _POINTS + " SELECT CAST(coalesce(max(CASE WHEN 2 * ok <= n THEN c END), 0) AS BIGINT) AS escalate_max_bps FROM (SELECT DISTINCT c, count(*) OVER (ORDER BY c) AS n, sum(ok) OVER (ORDER BY c) AS ok FROM p) s")
def escalate_threshold(d: Derived) -> DataFrame:
    return evaluate.escalate_threshold(_points(d))


@_query("WITH " + _FINDINGS + ", " + _TRUTH + """, j AS (SELECT abs(f.impact_paise) % 10001 AS raw, f.class, CASE WHEN t.class = f.class THEN 1 ELSE 0 END AS ok FROM f LEFT JOIN t ON t.payment_id = f.payment_id),
 v AS (SELECT 'baseline' AS variant, ok FROM j UNION ALL SELECT 'fixed_threshold', ok FROM j WHERE raw >= 9000 UNION ALL SELECT 'fees_only', ok FROM j WHERE class <> 'tax_miscalculation'),
 g AS (SELECT variant, count(*) AS n_findings, CAST(sum(ok) AS BIGINT) AS n_right FROM v GROUP BY 1) SELECT g.*, g.n_right - b.n_right AS delta_right FROM g, (SELECT n_right FROM g WHERE variant = 'baseline') b""")
def ablation_deltas(d: Derived) -> DataFrame:
    """Scores of filtered findings beside all: those from a confidence of 0.9 on, and those on fees alone. One pass over the scored findings."""
    rows = evaluate.outcomes(_confident(d), _truth(d)).withColumn("ok", (F.col("verdict") == "true_positive").cast("long"))
    variants = F.array(F.lit("baseline"), F.when(F.col("raw_bps") >= 9000, "fixed_threshold"), F.when(rows["class"] != "tax_miscalculation", "fees_only"))
    sums = rows.withColumn("variant", F.explode(F.filter(variants, lambda v: v.isNotNull()))).groupBy("variant").agg(F.count("*").alias("n_findings"), F.sum("ok").alias("n_right"))
    return sums.withColumn("delta_right", F.col("n_right") - F.max(F.when(F.col("variant") == "baseline", F.col("n_right"))).over(Window.partitionBy(F.lit(1))))  # three rows


_DETAIL = f"SELECT id, CASE WHEN k % 233 = 15 THEN 'emi' ELSE method END AS method, is_international AS international, CASE WHEN k % 12 = 3 THEN 'diners' ELSE {_NETWORK} END AS network, CASE WHEN k % 7 = 4 THEN NULL ELSE card_type END AS card_type FROM payments"


@_query("WITH " + _RECON + f""", dt AS ({_DETAIL}), q AS (SELECT rc.*, CASE WHEN type = 'transfer' THEN 'unsupported_type' WHEN NOT settled THEN 'unsettled' WHEN settlement_id NOT IN (SELECT id FROM batches) THEN 'settlement_without_credit' WHEN credit <> amount - fee - tax THEN 'credit_does_not_reconcile'
 WHEN dt.international OR dt.method = 'emi' THEN 'multi_component_fee' WHEN dt.method = 'card' AND (dt.network IS NULL OR dt.network = 'diners') THEN 'unrepresentable_card_network' WHEN dt.method = 'card' AND dt.card_type IS NULL THEN 'unrepresentable_card_type' END AS reason FROM rc JOIN dt ON dt.id = rc.entity_id)
 SELECT reason, count(*) AS n, CAST(sum(amount) AS BIGINT) AS paise FROM q WHERE reason IS NOT NULL GROUP BY 1""")
def quarantine_details(d: Derived) -> DataFrame:
    d.payments.createOrReplaceTempView("tallyforge_payments")
    details = d.spark.sql(_DETAIL.replace("FROM payments", "FROM tallyforge_payments"))
    return ingest.quarantine(_recon(d), d.batches, details).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"), F.sum("amount").alias("paise"))


_STATUS = "CASE WHEN b % 9 = 4 THEN 'failed' ELSE 'processed' END"


@_query(f"SELECT x.id, CAST(min(p.day) AS STRING) AS cycle_start, CAST(max(p.day) AS STRING) AS cycle_end, CASE WHEN {_STATUS.replace('b %', 'x.b %')} = 'failed' THEN 'settlement_not_processed' END AS reason FROM batches x JOIN payments p ON p.stl = x.id WHERE p.k % 3 = 0 GROUP BY x.id, x.b")
def settlement_spans(d: Derived) -> DataFrame:
    recon = d.payments.where("k % 3 = 0").select(F.col("stl").alias("settlement_id"), F.col("day").alias("created_at"))
    rows = ingest.settlement_spans(recon, d.batches.select("id", F.expr(_STATUS).alias("status")))
    return rows.select("id", F.col("cycle_start").cast("string"), F.col("cycle_end").cast("string"), "reason")


@_query("SELECT arg_min(merchant_id, id) AS merchant_id FROM payments")
def inferred_merchant(d: Derived) -> DataFrame:
    return ingest.merchant_of(d.payments)

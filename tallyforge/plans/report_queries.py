"""Registered queries on what a report shows: headline, score cards, dispute packets, lanes by source. Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import ingest, ledger, packets, proof, verify
from tallyforge.plans.derived import Derived
from tallyforge.plans.proof_queries import _EVIDENCE, _LABELS, _cited, _items, _labels, _rows, _verdicts, by_key
from tallyforge.plans.queries import _CONSERVED, _RECON, _ledger, _matched, _query, _recon
from tallyforge.plans.run_queries import _MEMBERS

_SUMS = _CONSERVED + """, tt AS (SELECT (SELECT CAST(sum(payments) AS BIGINT) FROM c) AS gross, (SELECT count(*) FROM m) AS n_credits, (SELECT count(*) FROM c) AS n_resolved, (SELECT count(*) FROM c WHERE unexplained_paise = 0) AS n_clean,
 CAST((SELECT sum(unexplained_paise) FROM c) + (SELECT coalesce(sum(amount_paise), 0) FROM m WHERE settlement_id IS NULL) AS BIGINT) AS unexplained,
 (SELECT CAST(coalesce(sum(signed_paise), 0) AS BIGINT) FROM ledger WHERE settlement_id IS NULL OR settlement_id NOT IN (SELECT settlement_id FROM m WHERE settlement_id IS NOT NULL)) AS unclaimed)"""


def _bps(part: Column, whole: Column) -> Column:
    """part of whole in ten-thousandths, floored and kept within 0 and 10,000; all of nothing."""
    product = (10_000 * part).cast("decimal(38,0)")
    down = ((product - product % whole) / whole).cast("long")
    return F.when(whole == 0, 10_000).otherwise(F.greatest(F.lit(0), F.least(F.lit(10_000), down))).cast("long")


def _totals(d: Derived) -> DataFrame:
    """One row of sums over the proofs by key: gross, credits, resolved and clean ones, unexplained and unclaimed money."""
    conserved = proof.conserved(*by_key(d))
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    resolved = F.col("outcome") == "resolved"
    ours = conserved.agg(zero("payments", "gross"), F.count("*").alias("n_credits"), F.count(F.when(resolved, 1)).alias("n_resolved"), F.count(F.when(resolved & (F.col("unexplained_paise") == 0), 1)).alias("n_clean"), zero("unexplained_paise", "unexplained"))
    left = ledger.unsettled(d.sums, _matched(d)).agg(zero("signed_paise", "unclaimed"))
    return ours.join(F.broadcast(left))  # two rows of one


@_query("WITH " + _SUMS + """ SELECT gross AS settled_gross_paise, unexplained AS unexplained_paise, unclaimed AS unclaimed_paise, unexplained + unclaimed AS unaccounted_paise, gross - abs(unexplained + unclaimed) AS verified_paise,
 CASE WHEN gross = 0 THEN 10000 ELSE CAST(greatest(0, least(10000, 10000 * abs(unexplained + unclaimed) // gross)) AS BIGINT) END AS unaccounted_bps, n_credits AS credit_count, n_resolved AS credits_resolved FROM tt""")
def headline_view(d: Derived) -> DataFrame:
    t, off = _totals(d), F.col("unexplained") + F.col("unclaimed")
    return t.select(
        F.col("gross").alias("settled_gross_paise"), F.col("unexplained").alias("unexplained_paise"), F.col("unclaimed").alias("unclaimed_paise"), off.alias("unaccounted_paise"), (F.col("gross") - F.abs(off)).alias("verified_paise"),
        _bps(F.abs(off), F.col("gross")).alias("unaccounted_bps"), F.col("n_credits").alias("credit_count"), F.col("n_resolved").alias("credits_resolved"),
    )


@_query("WITH " + _SUMS + """, s AS (SELECT 'verified_value' AS card, gross - abs(unexplained + unclaimed) AS part, gross AS whole FROM tt UNION ALL SELECT 'credits_decomposed', n_resolved, n_credits FROM tt UNION ALL SELECT 'clean_credits', n_clean, n_credits FROM tt),
 r AS (SELECT card, CAST(CASE WHEN whole = 0 THEN 10000 WHEN part < 0 THEN 0 ELSE least(10000, 10000 * part // whole) END AS BIGINT) AS value_bps FROM s) SELECT card, value_bps, CASE WHEN value_bps >= 8000 THEN 'strong' WHEN value_bps >= 4000 THEN 'moderate' ELSE 'weak' END AS strength FROM r""")
def report_cards(d: Derived) -> DataFrame:
    card = lambda name, part, whole: F.struct(F.lit(name).alias("card"), part.cast("long").alias("part"), F.col(whole).cast("long").alias("whole"))
    verified = F.col("gross") - F.abs(F.col("unexplained") + F.col("unclaimed"))
    rows = _totals(d).select(F.explode(F.array(card("verified_value", verified, "gross"), card("credits_decomposed", F.col("n_resolved"), "n_credits"), card("clean_credits", F.col("n_clean"), "n_credits"))).alias("c")).select("c.*")
    rows = rows.withColumn("value_bps", _bps(F.greatest("part", F.lit(0)), F.col("whole")))
    return rows.select("card", "value_bps", verify.strength(F.col("value_bps")).alias("strength"))


def _cluster_members(d: Derived) -> DataFrame:
    return verify.cluster_members("RUN", _rows(d), d.fee_lines)


_CLUSTERED = _MEMBERS.replace("rm AS (SELECT id,", "rm AS (SELECT id, class, rule_id,")


@_query("WITH " + _CLUSTERED + """, g AS (SELECT cluster_id, class, rule_id, count(*) AS n_findings, CAST(sum(impact_paise) AS BIGINT) AS impact_paise, min(id) AS first_finding, arg_min(impact_paise, id) AS first_impact_paise FROM rm GROUP BY 1, 2, 3)
 SELECT g.*, CAST(r.rate_bps AS BIGINT) AS rate_bps, CAST(r.fixed_fee AS BIGINT) AS fixed_fee, concat(CAST(impact_paise // 100 AS VARCHAR), '.', lpad(CAST(impact_paise % 100 AS VARCHAR), 2, '0'), ' ', class, ' across ', CAST(n_findings AS VARCHAR), CASE WHEN n_findings = 1 THEN ' finding' ELSE ' findings' END) AS claim FROM g LEFT JOIN rules r ON r.rule_id = g.rule_id""")
def dispute_packets(d: Derived) -> DataFrame:
    return packets.packets(_cluster_members(d), d.rules)


@_query("WITH " + _EVIDENCE + _CLUSTERED[_CLUSTERED.index(", rc AS"):] + """, ce AS (SELECT rm.cluster_id, ev.type, ev.id, min(ev.finding_id) AS cited_by FROM rm JOIN ev ON ev.finding_id = rm.id GROUP BY 1, 2, 3)
 SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY type, id) AS nth, type, id, row_number() OVER (PARTITION BY cluster_id ORDER BY cited_by, type, id) AS seen FROM ce""")
def packet_evidence(d: Derived) -> DataFrame:
    return packets.packet_evidence(_cluster_members(d), _cited(d))


@_query("WITH " + _RECON + """, cv AS (SELECT count(CASE WHEN credit = amount - fee THEN 1 END) > count(CASE WHEN credit = amount - fee - tax THEN 1 END) AS inside FROM rc WHERE type = 'payment' AND tax <> 0)
 SELECT entity_id, CASE WHEN inside THEN fee - tax ELSE fee END AS fee_paise, tax AS tax_paise FROM rc, cv""")
def recon_fee_split(d: Derived) -> DataFrame:
    """Each row's fee and tax by the convention that its file is found to keep."""
    rows = _recon(d)
    found = ingest.fee_convention(rows).select((F.col("convention") == "fee_includes_tax").alias("inside"))
    inside, plain = (ingest.fee_and_tax(F.col("fee"), F.col("tax"), x)[0] for x in (True, False))
    return rows.join(F.broadcast(found)).select("entity_id", F.when(F.col("inside"), inside).otherwise(plain).alias("fee_paise"), F.col("tax").alias("tax_paise"))  # found is one row


@_query("WITH " + _LABELS + """, ln AS (SELECT source, CASE WHEN raw_bps >= 9500 THEN 'auto' WHEN raw_bps <= 3830 THEN 'escalate' ELSE 'propose' END AS lane, label FROM pt)
 SELECT source, lane, count(*) AS n, count(CASE WHEN label THEN 1 END) AS n_right, CAST(10000 * count(*) // sum(count(*)) OVER (PARTITION BY source) AS BIGINT) AS share_bps FROM ln GROUP BY 1, 2""")
def lanes_by_source(d: Derived) -> DataFrame:
    """Labelled points by source and lane, and each lane's share of its source."""
    from pyspark.sql.window import Window

    rows = _labels(d).withColumn("lane", verify.lane(F.col("raw_bps"), 9500, 3830)).groupBy("source", "lane").agg(F.count("*").alias("n"), F.count(F.when(F.col("label"), 1)).alias("n_right"))
    whole = F.sum("n").over(Window.partitionBy("source"))  # three rows for each source
    return rows.withColumn("share_bps", _bps(F.col("n"), whole))


@_query("WITH " + _EVIDENCE + """, hit AS (SELECT DISTINCT pr.item FROM planted_records pr JOIN ev ON ev.type = pr.type AND ev.id = pr.id)
 SELECT count(*) AS planted, count(hit.item) AS touched, CAST(10000 * count(hit.item) // count(*) AS BIGINT) AS recall_bps FROM planted p LEFT JOIN hit ON hit.item = p.item""")
def evidence_recall(d: Derived) -> DataFrame:
    """The share of planted items that some finding shares a record with, whatever its class."""
    items, records = _items(d)
    cited = _cited(d).select("type", "id").distinct()
    hit = records.join(cited, ["type", "id"], "left_semi").select("item").distinct().withColumn("hit", F.lit(1))
    return items.join(hit, "item", "left").agg(F.count("*").alias("planted"), F.count("hit").alias("touched")).withColumn("recall_bps", _bps(F.col("touched"), F.col("planted")))


@_query("WITH " + _EVIDENCE + """, ab AS (SELECT unnest(['baseline', 'structural_only', 'without_chargebacks', CASE WHEN impact_paise >= 1000 THEN 'over_ten_rupees' END]) AS variant, vd.* FROM vd),
 g AS (SELECT variant, count(*) AS findings, count(CASE WHEN verdict = 'true_positive' THEN 1 END) AS right, CAST(coalesce(sum(CASE WHEN verdict = 'true_positive' THEN impact_paise END), 0) AS BIGINT) AS right_paise FROM ab WHERE variant IS NOT NULL AND NOT (variant = 'without_chargebacks' AND class = 'chargeback_amount_mismatch') GROUP BY 1)
 SELECT g.*, g.right - b.right AS delta_right, g.right_paise - b.right_paise AS delta_paise FROM g, (SELECT * FROM g WHERE variant = 'baseline') b""")
def evidence_ablation(d: Derived) -> DataFrame:
    """Scores by shared records of findings filtered by tier, class and size, beside all."""
    from pyspark.sql.window import Window

    tier = F.lit("structural_only")  # these findings are all of proofs by key
    variants = F.array(F.lit("baseline"), tier, F.when(F.col("class") != "chargeback_amount_mismatch", "without_chargebacks"), F.when(F.col("impact_paise") >= 1000, "over_ten_rupees"))
    right = F.col("verdict") == "true_positive"
    sums = _verdicts(d).withColumn("variant", F.explode(F.array_compact(variants))).groupBy("variant").agg(F.count("*").alias("findings"), F.count(F.when(right, 1)).alias("right"), F.coalesce(F.sum(F.when(right, F.col("impact_paise"))), F.lit(0)).cast("long").alias("right_paise"))
    base = lambda c: F.max(F.when(F.col("variant") == "baseline", F.col(c))).over(Window.partitionBy(F.lit(1)))  # noqa: E731  four rows
    return sums.select("*", (F.col("right") - base("right")).alias("delta_right"), (F.col("right_paise") - base("right_paise")).alias("delta_paise"))

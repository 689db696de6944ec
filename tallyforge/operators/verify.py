"""Conservation, reported against recomputed fees and taxes, findings, clusters, lanes, journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators.components import parts


def conservation(matched: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per credit with a batch: its records' sum by type and the unexplained rest."""
    bucket = lambda *types: F.sum(F.when(F.col("type").isin(*types), F.col("signed_paise")).otherwise(0))
    sums = ledger.groupBy("settlement_id").agg(
        bucket("payment").alias("payments"), bucket("refund").alias("refunds"), bucket("chargeback").alias("chargebacks"), bucket("adjustment").alias("adjustments"), bucket("fee_line").alias("fees"), bucket("tax_line").alias("taxes"), F.sum("signed_paise").alias("net_paise")
    )
    return matched.where("settlement_id IS NOT NULL").join(sums, "settlement_id").select(F.col("id").alias("credit_id"), "settlement_id", "amount_paise", "payments", "refunds", "chargebacks", "adjustments", "fees", "taxes", (F.col("amount_paise") - F.col("net_paise")).alias("unexplained_paise"))


def cells(reported_fees: DataFrame, reported_taxes: DataFrame, priced: DataFrame) -> DataFrame:
    """Reported less recomputed totals by payment and fee type; a missing side is 0. Rows without a difference are kept."""
    zero = F.lit(0).cast("long")
    cols = ("payment_id", "fee_type")
    a = reported_fees.select(F.col("applies_to_id").alias("payment_id"), "fee_type", F.col("amount_paise").alias("fee"), zero.alias("tax"))
    b = reported_taxes.select("payment_id", "fee_type", zero.alias("fee"), F.col("amount_paise").alias("tax"))
    c = priced.select(F.col("id").alias("payment_id"), "fee_type", (-F.col("fee_paise")).alias("fee"), (-F.col("tax_paise")).alias("tax"))
    return a.unionByName(b).unionByName(c).groupBy(*cols).agg(F.sum("fee").alias("fee_delta"), F.sum("tax").alias("tax_delta"))


def findings(cell_rows: DataFrame, payments: DataFrame) -> DataFrame:
    """One finding for each fee or tax difference of a payment's fee type, numbered within its settlement; impact is the size of the difference, delta has its sign."""
    own = payments.select(F.col("id").alias("payment_id"), "settlement_id", F.col("amount_paise").alias("gross_paise"))
    kinds = F.array(
        F.struct(F.lit(0).alias("rank"), F.when(F.col("fee_delta") < 0, "fee_undercharge").when(F.col("fee_delta") > 0, "fee_overcharge").alias("class"), F.col("fee_delta").alias("delta_paise")),
        F.struct(F.lit(1).alias("rank"), F.when(F.col("tax_delta") != 0, "tax_miscalculation").alias("class"), F.col("tax_delta").alias("delta_paise")),
    )
    rows = cell_rows.where("fee_delta <> 0 OR tax_delta <> 0").join(own, "payment_id").where("settlement_id IS NOT NULL").withColumn("f", F.explode(F.filter(kinds, lambda k: k["class"].isNotNull())))
    seq = F.row_number().over(Window.partitionBy("settlement_id").orderBy("f.rank", "payment_id", "fee_type"))
    return rows.select(F.concat(F.lit("FND-"), "settlement_id", F.lit("-"), F.when(seq < 1000, F.lpad(seq.cast("string"), 3, "0")).otherwise(seq.cast("string"))).alias("id"), "settlement_id", "payment_id", "fee_type", "f.class", F.abs("f.delta_paise").alias("impact_paise"), "f.delta_paise", "gross_paise")


def reversal_findings(chargebacks: DataFrame, credits: DataFrame) -> DataFrame:
    """Won chargebacks without a manual credit of their amount, each credit used once, in the order of ids."""
    pool = credits.where("kind = 'manual_credit'").groupBy("amount_paise").agg(F.count("*").alias("n_credits"))
    rank = F.row_number().over(Window.partitionBy("amount_paise").orderBy("id"))
    won = chargebacks.where("stage = 'won'").withColumn("k", rank).join(pool, "amount_paise", "left")
    return won.where(F.col("k") > F.coalesce("n_credits", F.lit(0))).select("id", "payment_id", "amount_paise")


def refund_findings(conserved: DataFrame, refunds: DataFrame) -> DataFrame:
    """Credits whose shortfall equals exactly one of their own refunds."""
    hit = conserved.where("unexplained_paise < 0").join(refunds.select(F.col("settlement_id"), F.col("id").alias("refund_id"), F.col("amount_paise").alias("refund_paise")), "settlement_id").where("refund_paise = -unexplained_paise")
    return hit.withColumn("n", F.count("*").over(Window.partitionBy("credit_id"))).where("n = 1").select("credit_id", "refund_id", "refund_paise")


def run_findings(run_id: str, cell_rows: DataFrame, payments: DataFrame, proven: DataFrame, conserved: DataFrame, chargebacks: DataFrame, adjustments: DataFrame, refunds: DataFrame) -> DataFrame:
    """Every finding of the resolved credits, proven(credit_id, settlement_id), numbered within its credit.

    Order: each payment's fees and then its taxes by fee type, won chargebacks without a reversal, the
    refund that a shortfall equals. Reversals are used up in the order of credits and chargebacks, within
    a run where chargebacks and adjustments have one.
    id, credit_id, class, ref_id (payment, chargeback or refund), fee_type, impact_paise, gross_paise.
    """
    credit = proven.select("credit_id", "settlement_id")
    none = F.lit(None)
    own = payments.where("settlement_id IS NOT NULL").select(F.col("id").alias("payment_id"), "settlement_id", F.col("amount_paise").alias("gross_paise"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.when(F.col("fee_delta") < 0, "fee_undercharge").when(F.col("fee_delta") > 0, "fee_overcharge").alias("class"), F.abs("fee_delta").alias("impact")),
        F.struct(F.lit(1).alias("side"), F.when(F.col("tax_delta") != 0, "tax_miscalculation").alias("class"), F.abs("tax_delta").alias("impact")),
    )
    off = cell_rows.where("fee_delta <> 0 OR tax_delta <> 0").join(own, "payment_id").join(credit, "settlement_id").withColumn("s", F.explode(F.filter(sides, lambda s: s["class"].isNotNull())))
    rows = off.select("credit_id", F.lit(0).alias("kind"), F.col("payment_id").alias("ref_id"), "s.side", "s.class", "fee_type", F.col("s.impact").alias("impact_paise"), "gross_paise")

    like = ["amount_paise", *(c for c in ("run",) if c in chargebacks.columns and c in adjustments.columns)]
    pool = adjustments.where("kind = 'manual_credit'").groupBy(*like).agg(F.count("*").alias("n_credits"))
    nth = F.row_number().over(Window.partitionBy(*like).orderBy("credit_id", "id"))
    won = chargebacks.where("stage = 'won'").join(credit, "settlement_id").withColumn("nth", nth).join(pool, like, "left").where(F.col("nth") > F.coalesce("n_credits", F.lit(0)))
    short = refund_findings(conserved, refunds).select("credit_id", F.col("refund_id").alias("id"), F.col("refund_paise").alias("amount_paise"))
    for df, kind, name in ((won, 1, "chargeback_amount_mismatch"), (short, 2, "refund_amount_mismatch")):
        rows = rows.unionByName(df.select("credit_id", F.lit(kind).alias("kind"), F.col("id").alias("ref_id"), F.lit(0).alias("side"), F.lit(name).alias("class"), none.cast("string").alias("fee_type"), F.col("amount_paise").alias("impact_paise"), none.cast("long").alias("gross_paise")))
    n = F.row_number().over(Window.partitionBy("credit_id").orderBy("kind", "ref_id", "side", "fee_type"))
    number = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    return rows.withColumn("id", F.concat(F.lit(f"FND-{run_id}-"), "credit_id", F.lit("-"), number)).select("id", "credit_id", "class", "ref_id", "fee_type", "impact_paise", "gross_paise")


def finding_evidence(finding_rows: DataFrame, fee_lines: DataFrame, tax_lines: DataFrame) -> DataFrame:
    """The records that findings of run_findings() cite: finding_id, type, id. Fees cite the payment's lines of the fee type, taxes the tax lines on those."""
    lines = fee_lines.select(F.col("applies_to_id").alias("ref_id"), "fee_type", F.col("id").alias("fee_id"))
    own = finding_rows.select(F.col("id").alias("finding_id"), "class", "ref_id", "fee_type")
    met = own.join(lines, ["ref_id", "fee_type"])
    fees = met.where("class IN ('fee_overcharge', 'fee_undercharge')").select("finding_id", F.lit("fee_line").alias("type"), F.col("fee_id").alias("id"))
    taxes = met.where("class = 'tax_miscalculation'").join(tax_lines.select(F.col("applies_to_fee_id").alias("fee_id"), "id"), "fee_id").select("finding_id", F.lit("tax_line").alias("type"), "id")
    kind = F.when(F.col("class") == "chargeback_amount_mismatch", "chargeback").when(F.col("class") == "refund_amount_mismatch", "refund")
    return fees.unionByName(taxes).unionByName(own.select("finding_id", kind.alias("type"), F.col("ref_id").alias("id")).where("type IS NOT NULL"))


def cluster_members(run_id: str, finding_rows: DataFrame, fee_lines: DataFrame) -> DataFrame:
    """run_findings() with rule_id, bucket_bps and cluster_id: one row for each finding, so no list grows with a cluster.

    The rule is that of the first fee line (by id) of the payment and fee type; other findings have none.
    """
    rule = fee_lines.groupBy(F.col("applies_to_id").alias("ref_id"), "fee_type").agg(F.min_by("rule_id", "id").alias("rule_id"))
    rows = finding_rows.join(rule, ["ref_id", "fee_type"], "left").withColumn("bucket_bps", delta_bucket(F.col("impact_paise"), F.col("gross_paise")))
    name = F.concat_ws("-", F.lit(f"CLU-{run_id}"), "class", F.coalesce("rule_id", F.lit("none")), F.coalesce(F.col("bucket_bps").cast("string"), F.lit("none")))
    return rows.withColumn("cluster_id", name)


def coverage_bps(explained: Column, residual: Column) -> Column:
    """What part of a residual cited records explain: 0 without a residual or with the wrong sign, 10,000 at most."""
    size = F.abs(residual)
    product = 10_000 * F.least(F.abs(explained), size)
    agrees = (residual != 0) & (explained != 0) & ((explained > 0) == (residual > 0))
    return F.when(agrees, ((product - product % size) / size).cast("long")).otherwise(0).cast("long")


def strength(bps: Column) -> Column:
    return F.when(bps >= 8000, "strong").when(bps >= 4000, "moderate").otherwise("weak")


def delta_bucket(impact: Column, gross: Column) -> Column:
    """The difference in basis points of the gross amount, to the nearest 50; null without a gross amount."""
    product = F.abs(impact) * 10_000
    raw = ((product - product % gross) / gross).cast("long") + 25
    return F.when(gross != 0, ((raw - raw % 50) / 50).cast("long") * 50)


def proof_failures(proofs: DataFrame, terms: DataFrame, credits: DataFrame, ledger: DataFrame, batches: DataFrame) -> DataFrame:
    """What is wrong with proofs, told from the ledger alone: credit_id, failure; nothing for a sound proof.

    proofs: credit_id, tier, outcome, reason, settlement_id, credit_paise, sum_paise, residual_paise;
    terms: credit_id, pos, type, id, signed_paise. A term that comes twice counts once in the sum. Each
    check is a join or an aggregate on (type, id) or credit_id; no proof is held whole in one task. The number
    of rows of the ledger decides over how many tasks they are dealt.
    """
    n = parts(ledger.sparkSession, ledger.count())
    own = credits.select(F.col("id").alias("credit_id"), F.col("amount_paise").alias("is_paise"), "utr")
    p = proofs.join(own, "credit_id", "left")
    by_place = Window.partitionBy("credit_id").orderBy("pos")
    key = F.struct("type", "id")
    t = terms.repartition(n, "credit_id").withColumn("before", F.lag(key).over(by_place)).withColumn("out_of_order", F.col("before") > key)
    once = t.groupBy("credit_id", "type", "id").agg(F.count("*").alias("n"), F.min_by("signed_paise", "pos").alias("says_paise"), F.max("out_of_order").alias("out_of_order"))
    real = ledger.select("type", "id", F.col("signed_paise").alias("is_paise"), F.col("settlement_id").alias("of"))
    met = once.repartition(n, "type", "id").join(real.repartition(n, "type", "id"), ["type", "id"], "left")
    owner = batches.where("trim(utr) <> ''").groupBy("utr").agg(F.count("*").alias("n_batches"), F.min("id").alias("of_batch"))
    p = p.join(owner, "utr", "left")
    size = real.where("of IS NOT NULL").groupBy(F.col("of").alias("of_batch")).agg(F.count("*").alias("n_members"))
    sums = met.join(p.select("credit_id", "of_batch"), "credit_id", "left").groupBy("credit_id").agg(
        F.sum("is_paise").alias("recomputed"), F.count("*").alias("n_terms"), F.count(F.when(F.col("of") == F.col("of_batch"), 1)).alias("n_own"),
        F.max((F.col("n") > 1).cast("int")).alias("repeated"), F.max(F.col("is_paise").isNull().cast("int")).alias("unknown"),
        F.max((F.col("is_paise") != F.col("says_paise")).cast("int")).alias("differs"), F.max(F.col("out_of_order").cast("int")).alias("disordered"),
    )
    all_ = p.join(sums, "credit_id", "left").join(size, "of_batch", "left").na.fill(0, ["recomputed", "n_terms", "n_own", "repeated", "unknown", "differs", "disordered", "n_members"])
    resolved = F.col("outcome") == "resolved"
    by_key = resolved & (F.col("tier") == "structural")
    checks = {
        "credit_unknown": F.col("is_paise").isNull(),
        "credit_differs": F.col("is_paise") != F.col("credit_paise"),
        "term_repeated": F.col("repeated") == 1,
        "term_unknown": F.col("unknown") == 1,
        "term_differs": F.col("differs") == 1,
        "terms_disordered": F.col("disordered") == 1,
        "sum_differs": F.col("recomputed") != F.col("sum_paise"),
        "residual_differs": F.col("sum_paise") + F.col("residual_paise") != F.col("credit_paise"),
        "answer_without_resolution": ~resolved & (F.col("n_terms") > 0),
        "reason_lacks": ~resolved & F.col("reason").isNull(),
        "reason_of_resolved": resolved & F.col("reason").isNotNull(),
        "no_single_batch": by_key & (F.coalesce("n_batches", F.lit(0)) != 1),
        "not_the_batch": by_key & (F.col("n_batches") == 1) & ((F.col("n_own") != F.col("n_terms")) | (F.col("n_own") != F.col("n_members"))),
    }
    found = F.filter(F.array(*(F.when(c, n) for n, c in checks.items())), lambda x: x.isNotNull())
    return all_.select("credit_id", F.explode(found).alias("failure"))


def clusters(finding_rows: DataFrame, rule_of: DataFrame) -> DataFrame:
    """Findings by class, rule and size of the difference, the largest sums first. rule_of: payment_id, fee_type, rule_id."""
    rows = finding_rows.join(rule_of, ["payment_id", "fee_type"], "left").withColumn("bucket_bps", delta_bucket(F.col("impact_paise"), F.col("gross_paise")))
    out = rows.groupBy("class", "rule_id", "bucket_bps").agg(F.count("*").alias("n_findings"), F.sum("impact_paise").alias("impact_paise"), F.min("id").alias("first_finding"))
    name = F.concat(F.lit("CLU-"), F.substring(F.sha2(F.concat_ws("|", "class", F.coalesce("rule_id", F.lit("-")), F.coalesce(F.col("bucket_bps").cast("string"), F.lit("-"))), 256), 1, 12))
    return out.withColumn("cluster_id", name)


def calibrated(rows: DataFrame, raw: str, breakpoints: DataFrame) -> DataFrame:
    """Adds calibrated_bps: linear between breakpoints(raw_bps, calibrated_bps), clipped at both ends, floored."""
    order = Window.orderBy("raw_bps")
    spans = breakpoints.select(F.col("raw_bps").alias("lo"), F.col("calibrated_bps").alias("lo_value"), F.lead("raw_bps").over(order).alias("hi"), F.lead("calibrated_bps").over(order).alias("hi_value"), F.row_number().over(order).alias("k"))
    inside = (F.col(raw) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(raw) < F.col("hi")))
    below = (F.col("k") == 1) & (F.col(raw) < F.col("lo"))
    product = (F.col(raw) - F.col("lo")) * (F.col("hi_value") - F.col("lo_value"))
    run = F.col("hi") - F.col("lo")
    value = F.when(F.col("hi").isNull() | (F.col(raw) < F.col("lo")), F.col("lo_value")).otherwise(F.col("lo_value") + ((product - F.pmod(product, run)) / run).cast("long"))
    return rows.join(F.broadcast(spans), inside | below).select(*rows.columns, value.cast("long").alias("calibrated_bps"))


def lane(confidence: Column, auto_from: int | None, escalate_to: int) -> Column:
    """AUTO from a threshold (None: never), ESCALATE up to one, else PROPOSE."""
    out = F.when(confidence <= escalate_to, "escalate").otherwise("propose")
    return out if auto_from is None else F.when(confidence >= auto_from, "auto").otherwise(out)


def journal_entries(finding_rows: DataFrame, input_hash: str, posted: DataFrame) -> DataFrame:
    """Entries of AUTO findings under their idempotency keys, each key once, none that is posted already."""
    key = F.sha2(F.concat(F.lit(f"{input_hash}:"), "id"), 256)
    rows = finding_rows.withColumn("idempotency_key", key).dropDuplicates(["idempotency_key"]).join(posted.select("idempotency_key"), "idempotency_key", "left_anti")
    return rows.select("idempotency_key", F.concat(F.lit("JNL-"), F.substring("idempotency_key", 1, 8)).alias("id"), F.col("id").alias("finding_id"), F.lit("settlement_receivable").alias("debit_account"), F.lit("gateway_dispute").alias("credit_account"), F.abs("impact_paise").alias("amount_paise"))

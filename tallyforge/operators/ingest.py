"""Gateway rows to ledger rows: the fee convention, quarantine reasons, settlements that drop whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Payment methods that the ledger knows.
METHODS = ("card", "upi", "netbanking", "wallet", "emi")
NETWORKS = ("visa", "mastercard", "rupay", "amex")
CARD_TYPES = ("credit", "debit", "prepaid")


def fee_convention(recon: DataFrame) -> DataFrame:
    """One row: whether reported fees exclude tax, by which identity more rows with a tax satisfy (a tie: excludes)."""
    pays = recon.where("type = 'payment' AND tax <> 0")
    out = F.count(F.when(F.col("credit") == F.col("amount") - F.col("fee") - F.col("tax"), 1))
    inside = F.count(F.when(F.col("credit") == F.col("amount") - F.col("fee"), 1))
    return pays.agg(out.alias("n_excludes"), inside.alias("n_includes")).withColumn("convention", F.when(F.col("n_includes") > F.col("n_excludes"), "fee_includes_tax").otherwise("fee_excludes_tax"))


def fee_and_tax(fee: Column, tax: Column, includes: bool) -> tuple[Column, Column]:
    return (fee - tax, tax) if includes else (fee, tax)


def quarantine(recon: DataFrame, settlements: DataFrame, details: DataFrame, includes: bool = False) -> DataFrame:
    """recon with reason: the first rule that a row fails, null if it is fine.

    details may have international, network and card_type; then fees of several parts (international or
    EMI) and cards of an unknown network or type are reasons too.
    """
    more = [c for c in ("international", "network", "card_type") if c in details.columns]
    creditable = settlements.select(F.col("id").alias("settlement_id"), F.lit(True).alias("has_credit")).distinct()
    known = details.select(F.col("id").alias("entity_id"), F.col("method").alias("d_method"), *(F.col(c).alias(f"d_{c}") for c in more), F.lit(True).alias("has_detail")).dropDuplicates(["entity_id"])
    rows = recon.join(creditable, "settlement_id", "left").join(known, "entity_id", "left")
    net = F.col("amount") - F.col("fee") - (F.lit(0) if includes else F.col("tax"))
    reason = (
        F.when(~F.col("type").isin("payment", "refund", "adjustment"), "unsupported_type")
        .when(~F.col("settled"), "unsettled")
        .when(F.col("has_credit").isNull(), "settlement_without_credit")
        .when((F.col("type") == "payment") & F.col("has_detail").isNull(), "missing_payment_detail")
        .when((F.col("type") == "payment") & (F.col("credit") != net), "credit_does_not_reconcile")
        .when((F.col("type") == "payment") & ~F.coalesce(F.col("d_method").isin(*METHODS), F.lit(False)), "unsupported_method")
    )
    pays, card = F.col("type") == "payment", F.lower("d_method") == "card"
    known_one = lambda c, values: F.coalesce(F.lower(c).isin(*values), F.lit(False))
    if "international" in more:
        reason = reason.when(pays & (F.coalesce("d_international", F.lit(False)) | (F.lower("d_method") == "emi")), "multi_component_fee")
    if "network" in more:
        reason = reason.when(pays & card & ~known_one("d_network", NETWORKS), "unrepresentable_card_network")
    if "card_type" in more:
        reason = reason.when(pays & card & ~known_one("d_card_type", CARD_TYPES), "unrepresentable_card_type")
    return rows.select(*recon.columns, reason.alias("reason"))


def complete(flagged: DataFrame) -> DataFrame:
    """The fine rows of settlements without any bad row; one bad row drops its whole settlement."""
    bad = flagged.where("reason IS NOT NULL AND settlement_id IS NOT NULL").select("settlement_id").distinct()
    return flagged.where("reason IS NULL").join(bad, "settlement_id", "left_anti")


def settlement_spans(recon: DataFrame, settlements: DataFrame) -> DataFrame:
    """Settlements that some row names, with the first and last created_at of their rows; reason if no money moved."""
    spans = recon.where("settlement_id IS NOT NULL").groupBy(F.col("settlement_id").alias("id")).agg(F.min("created_at").alias("cycle_start"), F.max("created_at").alias("cycle_end"))
    return settlements.join(spans, "id").withColumn("reason", F.when(~F.col("status").eqNullSafe(F.lit("processed")), "settlement_not_processed"))


def merchant_of(payments: DataFrame) -> DataFrame:
    """One row: the merchant of the payment with the lowest id (null without payments)."""
    return payments.agg(F.min_by("merchant_id", "id").alias("merchant_id"))

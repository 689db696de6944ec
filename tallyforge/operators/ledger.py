"""The long ledger: signed records, duplicates, batches' nets, chains of fees and taxes, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each record type counts toward a batch's net.
SIGNS = {"payment": 1, "refund": -1, "chargeback": -1, "fee_line": -1, "tax_line": -1}
ADJUSTMENT_SIGNS = {"reserve_hold": -1, "reserve_release": 1, "manual_credit": 1, "manual_debit": -1, "fee_waiver": 1}


def signed(type_: Column, kind: Column, amount: Column) -> Column:
    """An amount with its sign; a type or kind that doesn't contribute is an error."""
    out = F.raise_error(F.concat(F.lit("no contribution: "), F.coalesce(type_, F.lit("null"))))
    for k, s in ADJUSTMENT_SIGNS.items():
        out = F.when((type_ == "adjustment") & (kind == k), amount * s).otherwise(out)
    for t, s in SIGNS.items():
        out = F.when(type_ == t, amount * s).otherwise(out)
    return out.cast("long")


def long_ledger(payments: DataFrame, refunds: DataFrame, chargebacks: DataFrame, adjustments: DataFrame, fee_lines: DataFrame, tax_lines: DataFrame) -> DataFrame:
    """type, id, settlement_id, signed_paise. Fee and tax lines take the settlement of what they are charged on."""

    def rows(df: DataFrame, type_: str, kind: Column | None = None) -> DataFrame:
        return df.select(F.lit(type_).alias("type"), "id", "settlement_id", signed(F.lit(type_), kind if kind is not None else F.lit(None), F.col("amount_paise")).alias("signed_paise"))

    own = payments.select(F.col("id").alias("applies_to_id"), "settlement_id")
    fees = fee_lines.join(own, "applies_to_id")
    taxes = tax_lines.join(fees.select(F.col("id").alias("applies_to_fee_id"), "settlement_id"), "applies_to_fee_id")
    out = rows(payments, "payment")
    for df, type_ in ((refunds, "refund"), (chargebacks, "chargeback"), (fees, "fee_line"), (taxes, "tax_line")):
        out = out.unionByName(rows(df, type_))
    return out.unionByName(rows(adjustments, "adjustment", F.col("kind")))


def movements(payments: DataFrame, refunds: DataFrame, chargebacks: DataFrame, adjustments: DataFrame, fee_lines: DataFrame, tax_lines: DataFrame) -> DataFrame:
    """type, id, unit_id, settlement_id, merchant_id, day, signed_paise (and currency, where payments have one).

    The unit of a fee or tax line is the payment that it is charged on, whose settlement, merchant and
    day it takes; other records are units of their own. Tables without a merchant give none. Tax lines that name
    their unit_id themselves are not looked up by their fee line.
    """
    held = [c for c in ("currency",) if c in payments.columns]

    def rows(df: DataFrame, type_: str, kind: Column | None = None) -> DataFrame:
        merchant = F.col("merchant_id") if "merchant_id" in df.columns else F.lit(None).cast("string").alias("merchant_id")
        unit = F.col("unit_id") if "unit_id" in df.columns else F.col("id").alias("unit_id")
        return df.select(F.lit(type_).alias("type"), "id", unit, "settlement_id", merchant, "day", signed(F.lit(type_), kind if kind is not None else F.lit(None), F.col("amount_paise")).alias("signed_paise"), *held)

    own = payments.select(F.col("id").alias("unit_id"), "settlement_id", "merchant_id", "day")
    charged = fee_lines.select("id", "amount_paise", F.col("applies_to_id").alias("unit_id"), *held)
    taxed = tax_lines if "unit_id" in tax_lines.columns else tax_lines.join(charged.select(F.col("id").alias("applies_to_fee_id"), "unit_id"), "applies_to_fee_id")
    line = lambda df, type_: df.select(F.lit(type_).alias("type"), "id", "unit_id", signed(F.lit(type_), F.lit(None), F.col("amount_paise")).alias("signed_paise"), *held)
    lines = line(charged, "fee_line").unionByName(line(taxed, "tax_line")).join(own, "unit_id")  # one join for both
    out = rows(payments, "payment")
    for df, type_ in ((refunds, "refund"), (chargebacks, "chargeback")):
        out = out.unionByName(rows(df, type_))
    return out.unionByName(rows(adjustments, "adjustment", F.col("kind"))).unionByName(lines)


def sums(movements: DataFrame) -> DataFrame:
    """settlement_id, type, signed_paise, n and day (the last) of movements, those of no settlement too."""
    return movements.groupBy("settlement_id", "type").agg(F.sum("signed_paise").alias("signed_paise"), F.count("*").alias("n"), F.max("day").alias("day"))


def charged_sums(payments: DataFrame, refunds: DataFrame, chargebacks: DataFrame, adjustments: DataFrame, charged: DataFrame) -> DataFrame:
    """What sums() gives of the movements, without making them: charged(applies_to_id, amount_paise, tax_paise) has a fee line's tax beside it.

    One narrow join finds the settlement of a fee line and of its tax.
    """

    def rows(df: DataFrame, type_: str, kind: Column | None = None) -> DataFrame:
        return df.select("settlement_id", F.lit(type_).alias("type"), signed(F.lit(type_), kind if kind is not None else F.lit(None), F.col("amount_paise")).alias("signed_paise"), "day")

    out = rows(payments, "payment")
    for df, type_ in ((refunds, "refund"), (chargebacks, "chargeback")):
        out = out.unionByName(rows(df, type_))
    own = payments.select(F.col("id").alias("applies_to_id"), "settlement_id", "day")
    lines = charged.join(own, "applies_to_id").groupBy("settlement_id").agg(F.sum("amount_paise").alias("fee_line"), F.sum("tax_paise").alias("tax_line"), F.count("*").alias("n"), F.max("day").alias("day"))
    both = F.explode(F.array(*(F.struct(F.lit(t).alias("type"), (F.col(t) * SIGNS[t]).alias("signed_paise")) for t in ("fee_line", "tax_line"))))  # the join is made once for the two
    return sums(out.unionByName(rows(adjustments, "adjustment", F.col("kind")))).unionByName(lines.select("settlement_id", both.alias("c"), "n", "day").select("settlement_id", "c.type", "c.signed_paise", "n", "day"))


def deduplicated(records: DataFrame) -> DataFrame:
    """Equal records once; records of one (type, id) that differ end the job."""
    once = records.dropDuplicates()
    counts = once.groupBy("type", "id").agg(F.count("*").alias("n"))
    checked = counts.select("type", "id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting record "), "type", F.lit(" "), "id"))).otherwise(F.lit(True)).alias("fine"))
    return once.join(checked.where("fine"), ["type", "id"], "left_semi")


def conflicts(records: DataFrame) -> DataFrame:
    return records.dropDuplicates().groupBy("type", "id").agg(F.count("*").alias("n_variants")).where("n_variants > 1")


def batch_net(ledger: DataFrame) -> DataFrame:
    return ledger.where("settlement_id IS NOT NULL").groupBy("settlement_id").agg(F.sum("signed_paise").alias("net_paise"), F.count("*").alias("n_records"))


def fee_chain(payments: DataFrame, fee_lines: DataFrame, tax_lines: DataFrame) -> DataFrame:
    """Per payment: what its fee lines and their tax lines come to."""
    taxes = tax_lines.groupBy("applies_to_fee_id").agg(F.sum("amount_paise").alias("tax"))
    lines = fee_lines.join(taxes, fee_lines["id"] == taxes["applies_to_fee_id"], "left").groupBy("applies_to_id").agg(F.count("*").alias("n_fees"), F.sum("amount_paise").alias("fee_paise"), F.sum("tax").alias("tax_paise"))
    return payments.select("id").join(lines, payments["id"] == lines["applies_to_id"]).select("id", "n_fees", "fee_paise", "tax_paise")


def unclaimed(ledger: DataFrame, claims: DataFrame) -> DataFrame:
    """Contributing records that no proof claims."""
    return ledger.join(claims.select("type", "id").distinct(), ["type", "id"], "left_anti")


def unsettled(ledger: DataFrame, matched: DataFrame) -> DataFrame:
    """Contributing records of no settlement that a credit has by key: orphans, and those whose settlement no credit has.

    A proof by key claims whole settlements, so settlement ids are enough; the ledger is made once.
    """
    return ledger.join(matched.where("settlement_id IS NOT NULL").select("settlement_id").distinct(), "settlement_id", "left_anti")


def left_by_cascade(moves: DataFrame, matched: DataFrame, terms: DataFrame) -> DataFrame:
    """Contributing records that neither a proof by key (whole settlements) nor one by search (terms) claims."""
    return unclaimed(unsettled(moves, matched), terms)

"""What stays open after the proofs, as cases: what it is, how much, and which records could explain it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators.components import kept

#: Fixed value: records that a case offers at most, the first in the order of type and id.
MOST_RECORDS = 25


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The first most of each case's distinct records, numbered. The rank's limit is applied before the shuffle, so that no pool is held whole."""
    order = Window.partitionBy("residual_id").orderBy("type", "id")
    return rows.distinct().withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= most).select("residual_id", "nth", "type", "id")


def pools(proofs: DataFrame, terms: DataFrame, competing: DataFrame, moves: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """residual_id, nth, type, id: the records that may be cited for each case.

    An ambiguous credit offers the records of the sets that it could be, but for those that some proof has claimed.
    An unclaimed record offers itself, a payment also its fee and tax lines.
    """
    units = proofs.where("outcome = 'ambiguous' AND residual_paise <> 0").select("credit_id").join(competing, "credit_id").select("credit_id", F.explode("unit_ids").alias("unit")).distinct()
    open_ = moves.join(terms.select("type", "id"), ["type", "id"], "left_anti")
    named = open_.withColumn("unit", F.explode(F.array_compact(F.array_distinct(F.array("settlement_id", "unit_id")))))
    could = named.join(units, "unit").select(F.concat(F.lit("RES-"), "credit_id").alias("residual_id"), "type", "id")
    case = F.concat(F.lit("RES-UNCLAIMED-"), "id").alias("residual_id")
    itself = open_.select(case, "type", "id")
    of_payment = open_.where("type = 'payment'").select(case, F.col("id").alias("unit_id"))
    lines = moves.where("type IN ('fee_line', 'tax_line')").select("unit_id", "type", "id").join(of_payment, "unit_id").select("residual_id", "type", "id")
    return _first(could.unionByName(itself).unionByName(lines), most)


def cases(proofs: DataFrame, terms: DataFrame, moves: DataFrame, pool: DataFrame) -> DataFrame:
    """residual_id, kind, credit_id, residual_paise, context, n_pool. A credit's residual for which pool has nothing is kind skipped: there is nothing to cite."""
    n = pool.groupBy("residual_id").agg(F.count("*").alias("n_pool"))
    said = F.concat_ws(",", "tier", "outcome", "reason", F.col("n_candidates").cast("string"))
    credits = proofs.where("residual_paise <> 0").select(F.concat(F.lit("RES-"), "credit_id").alias("residual_id"), "credit_id", "residual_paise", said.alias("context"))
    credits = credits.withColumn("kind", F.lit("decomposition_residual"))
    open_ = moves.join(terms.select("type", "id"), ["type", "id"], "left_anti")
    records = open_.select(F.concat(F.lit("RES-UNCLAIMED-"), "id").alias("residual_id"), F.lit(None).cast("string").alias("credit_id"), F.col("signed_paise").alias("residual_paise"), F.col("type").alias("context"), F.lit("unclaimed_record").alias("kind"))
    rows = credits.unionByName(records).join(n, "residual_id", "left")
    kind = F.when(F.col("credit_id").isNotNull() & F.col("n_pool").isNull(), "skipped").otherwise(F.col("kind"))
    return rows.select("residual_id", kind.alias("kind"), "credit_id", "residual_paise", "context", F.coalesce("n_pool", F.lit(0)).cast("long").alias("n_pool"))


def batches_of(case_rows: DataFrame, size: int = 8) -> DataFrame:
    """case_rows that have something to cite, with batch: size of them at a time in the order of their ids (credits first).

    The number in order comes from the sizes of sorted ranges, so no task holds or counts all cases.
    """
    asked = case_rows.where("kind <> 'skipped'")
    ranged = asked.withColumn("late", F.col("credit_id").isNull()).repartitionByRange("late", "residual_id").sortWithinPartitions("late", "residual_id").withColumn("place", F.monotonically_increasing_id())
    placed = kept(ranged.withColumn("part", F.shiftright("place", 33)).withColumn("at", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")  # a row for each range
    number = F.col("before") + F.col("at")
    return placed.join(F.broadcast(before), "part").withColumn("batch", ((number - number % size) / size).cast("long")).select(*case_rows.columns, "batch")

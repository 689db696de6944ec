"""Dispute packets: what a cluster of findings claims, by which rule, and the records that show it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import money


def packets(members: DataFrame, rules: DataFrame) -> DataFrame:
    """Of cluster_members(): cluster_id, class, rule_id, claim, rate_bps, fixed_fee, n_findings, impact_paise, first_finding, first_impact_paise.

    A cluster without a rule has no arithmetic. The representative is the first finding by id.
    """
    sums = members.groupBy("cluster_id", "class", "rule_id").agg(
        F.count("*").alias("n_findings"), F.sum("impact_paise").alias("impact_paise"), F.min("id").alias("first_finding"), F.min_by("impact_paise", "id").alias("first_impact_paise")
    )
    claim = F.concat(money.to_rupees(F.col("impact_paise")), F.lit(" "), "class", F.lit(" across "), F.col("n_findings").cast("string"), F.when(F.col("n_findings") == 1, " finding").otherwise(" findings"))
    own = rules.select("rule_id", F.col("rate_bps").cast("long").alias("rate_bps"), F.col("fixed_fee").cast("long").alias("fixed_fee"))
    return sums.join(own, "rule_id", "left").withColumn("claim", claim)


def packet_evidence(members: DataFrame, evidence: DataFrame) -> DataFrame:
    """cluster_id, nth, type, id, seen: each record that a cluster's findings cite, once, in canonical order, with the place at which it is first cited when
    findings are read by id. Records are rows, so no packet's list is held."""
    cited = members.select("cluster_id", F.col("id").alias("finding_id")).join(evidence, "finding_id").groupBy("cluster_id", "type", "id").agg(F.min("finding_id").alias("by"))
    of = Window.partitionBy("cluster_id")
    nth = F.row_number().over(of.orderBy("type", "id")).cast("long")
    seen = F.row_number().over(of.orderBy("by", "type", "id")).cast("long")
    return cited.select("cluster_id", nth.alias("nth"), "type", "id", seen.alias("seen"))

"""Findings scored against planted items by the records that both name; labelled points and the thresholds that they carry.

Tables: findings(id, class, impact_paise), evidence(finding_id, type, id), items(item, code, class,
impact_paise), records(item, type, id). A finding touches the items that share a record with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators.components import few

#: A finding on nothing, an item that no finding is right about.
NOTHING = "no_discrepancy"
MISSED = "not_detected"
#: What proofs and cells say of themselves in ten-thousandths, and the classes of items that spoil a proof or a cell.
CONFIDENCE = {"structural": 10_000, "subset_sum": 8_000, "assignment": 6_000}
CELL_CONFIDENCE = 10_000
SPOIL_PROOFS = ("missing_transaction", "duplicate_settlement")
SPOIL_CELLS = {"fee": ("fee_overcharge", "fee_undercharge"), "tax": ("tax_miscalculation",)}


def verdicts(findings: DataFrame, evidence: DataFrame, items: DataFrame, records: DataFrame) -> DataFrame:
    """findings with item, true_class and verdict: an item of its own class that it touches (true_positive), else the first that it
    touches (misclassified), else none (false_positive). Items come in the order of their names.

    A record keeps its first item of each class, so one that many items and findings name gives few rows.
    """
    firsts = records.join(items.select("item", F.col("class").alias("true_class")), "item").groupBy("type", "id", "true_class").agg(F.min("item").alias("item"))
    met = evidence.join(firsts, ["type", "id"]).join(findings.select(F.col("id").alias("finding_id"), "class"), "finding_id")
    order = F.struct((F.col("class") != F.col("true_class")).alias("other"), "item", "true_class")
    picked = met.groupBy(F.col("finding_id").alias("id")).agg(F.min(order).alias("pick"))
    verdict = F.when(F.col("pick").isNull(), "false_positive").when(F.col("pick.other"), "misclassified").otherwise("true_positive")
    return findings.join(picked, "id", "left").select(*findings.columns, F.col("pick.item").alias("item"), F.col("pick.true_class").alias("true_class"), verdict.alias("verdict"))


def detected(judged: DataFrame, items: DataFrame) -> DataFrame:
    """items with found: whether a finding of verdicts() is right about it."""
    right = judged.where("verdict = 'true_positive'").select("item").distinct().withColumn("found", F.lit(True))
    return items.join(right, "item", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def confusion(judged: DataFrame, items: DataFrame) -> DataFrame:
    """true_class, class, n: each finding once, and each item that no finding is right about as MISSED."""
    missed = detected(judged, items).where("NOT found").select(F.col("class").alias("true_class"), F.lit(MISSED).alias("class"))
    rows = judged.select(F.coalesce("true_class", F.lit(NOTHING)).alias("true_class"), "class").unionByName(missed)
    return rows.groupBy("true_class", "class").agg(F.count("*").alias("n"))


def by_code(judged: DataFrame, items: DataFrame) -> DataFrame:
    """Per code its classes, how many items were planted, found and missed, and their money."""
    paid = lambda c: F.coalesce(F.sum(F.when(c, F.col("impact_paise"))), F.lit(0)).cast("long")
    return detected(judged, items).groupBy("code").agg(
        F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"), F.count("*").alias("support"), F.count(F.when(F.col("found"), 1)).alias("tp"), F.count(F.when(~F.col("found"), 1)).alias("fn"),
        paid(F.lit(True)).alias("planted_paise"), paid(F.col("found")).alias("detected_paise"),
    )


def totals(judged: DataFrame, items: DataFrame) -> DataFrame:
    """One row: findings by verdict with the money of the wrong ones, planted and detected money."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    paid = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("impact_paise"))), F.lit(0)).cast("long")
    ours = judged.agg(
        F.count("*").alias("findings"), n("true_positive").alias("true_positives"), n("misclassified").alias("misclassified"), n("false_positive").alias("false_positives"),
        paid("misclassified").alias("misclassified_paise"), paid("false_positive").alias("false_positive_paise"),
    )
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("impact_paise"))), F.lit(0)).cast("long")
    theirs = detected(judged, items).agg(F.count("*").alias("planted"), F.count(F.when(F.col("found"), 1)).alias("detected"), money(F.lit(True)).alias("planted_paise"), money(F.col("found")).alias("detected_paise"))
    return ours.join(F.broadcast(theirs))  # two rows of one


def proof_points(proofs: DataFrame, terms: DataFrame, items: DataFrame, records: DataFrame) -> DataFrame:
    """source, raw_bps, label for each proof(credit_id, tier, outcome): right if it is resolved and neither its terms nor its credit
    belong to an item that spoils record sets."""
    spoilt = few(records.join(items.where(F.col("class").isin(*SPOIL_PROOFS)).select("item"), "item", "left_semi").select("type", "id").distinct())
    own = proofs.select("credit_id", F.lit("bank_credit").alias("type"), F.col("credit_id").alias("id"))
    touched = terms.select("credit_id", "type", "id").unionByName(own).join(spoilt, ["type", "id"], "left_semi").select("credit_id").distinct().withColumn("spoilt", F.lit(True))
    confidence = F.coalesce(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[F.col("tier")], F.lit(0))
    resolved = F.col("outcome") == "resolved"
    rows = proofs.join(touched, "credit_id", "left")
    return rows.select(F.concat(F.lit("decompose_"), "tier").alias("source"), F.when(resolved, confidence).otherwise(0).cast("long").alias("raw_bps"), (resolved & F.col("spoilt").isNull()).alias("label"))


def cell_points(cells: DataFrame, evidence: DataFrame, items: DataFrame, records: DataFrame) -> DataFrame:
    """source, raw_bps, label for each cell(cell, kind, reported_paise, recomputed_paise): right if the two agree, or if one of its
    evidence(cell, type, id) belongs to a planted item of the kind's classes."""
    kind = F.create_map(*(F.lit(x) for k, names in SPOIL_CELLS.items() for name in names for x in (name, k)))
    planted = records.join(items.select("item", kind[F.col("class")].alias("kind")).where("kind IS NOT NULL"), "item").select("type", "id", "kind").distinct()
    differs = F.coalesce(F.col("reported_paise") != F.col("recomputed_paise"), F.lit(False))
    off = cells.where(differs).select("cell", "kind")
    hit = planted.join(evidence, ["type", "id"]).join(off, ["cell", "kind"], "left_semi").select("cell").distinct().withColumn("hit", F.lit(True))
    point = lambda label: (F.lit("verify_deterministic").alias("source"), F.lit(CELL_CONFIDENCE).cast("long").alias("raw_bps"), label.alias("label"))
    agree = cells.where(~differs).select(*point(F.col("reported_paise") == F.col("recomputed_paise")))  # most cells; nothing is looked up for them
    return agree.unionByName(off.join(hit, "cell", "left").select(*point(F.col("hit").isNotNull())))


def beta_below(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of a Beta(a, b) distribution below x, by its continued fraction (on the side where it converges fast)."""
    from math import lgamma

    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    log = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(x) + b * np.log1p(-x))
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.maximum(np.abs(1 - (a + b) * x / (a + 1)), tiny) * np.sign(1 - (a + b) * x / (a + 1) + tiny)
    out = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    below = front * out / a
    return np.where(turned, 1 - below, below)


def error_bounds(failures: np.ndarray, trials: np.ndarray, level: float) -> np.ndarray:
    """One-sided upper bounds of error rates: the Beta(failures + 1, trials - failures) quantile at level; 1 without trials or without a right one."""
    failures, trials = np.asarray(failures, float), np.asarray(trials, float)
    sure = failures >= trials
    a, b = failures + 1, np.where(sure, 1.0, trials - failures)
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        middle = (lo + hi) / 2
        under = beta_below(a, b, middle) < level
        lo, hi = np.where(under, middle, lo), np.where(under, hi, middle)
    return np.where(sure, 1.0, hi)


def error_bound(failures: Column, trials: Column, level_bps: int) -> Column:
    @F.pandas_udf("double")
    def bound(f: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(error_bounds(f.to_numpy(), n.to_numpy(), level_bps / 10_000))

    return bound(failures, trials)


def auto_threshold(points: DataFrame, target_bps: int = 50, level_bps: int = 9_500) -> DataFrame:
    """One row, auto_min_bps: the lowest value of points(source, calibrated_bps, label) from which every source's own error bound is
    within target_bps; 10,001 if there is none. A source without points from there on risks nothing.

    Counts by source and value (10,001 of a source at most) are summed downwards by a window; a source's sum at one of its
    values holds for thresholds down to its next lower value. Where it is too bad, these thresholds are out; a sweep
    over the ends of all such spans finds the lowest value in none.
    """
    counts = points.groupBy("source", "calibrated_bps").agg(F.count("*").alias("n"), F.count(F.when(~F.col("label"), 1)).alias("wrong"))
    by = Window.partitionBy("source").orderBy(F.desc("calibrated_bps"))
    upward = Window.partitionBy("source").orderBy("calibrated_bps")
    sums = counts.select("calibrated_bps", F.sum("n").over(by).alias("n"), F.sum("wrong").over(by).alias("wrong"), F.coalesce(F.lag("calibrated_bps").over(upward), F.lit(-1)).alias("below"))
    bad = sums.where(error_bound(F.col("wrong"), F.col("n"), level_bps) > target_bps / 10_000)
    spans = bad.select(F.explode(F.array(F.struct((F.col("below") + 1).alias("at"), F.lit(1).alias("step")), F.struct((F.col("calibrated_bps") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e")).select("e.at", "e.step", F.lit(0).alias("is_value"))
    values = counts.select(F.col("calibrated_bps").alias("at"), F.lit(0).alias("step"), F.lit(1).alias("is_value")).distinct()
    upto = Window.orderBy("at", "is_value")  # bounded: three rows for each source and value
    swept = spans.unionByName(values).withColumn("open", F.sum("step").over(upto))
    return swept.where("is_value = 1 AND open = 0").agg(F.coalesce(F.min("at"), F.lit(10_001)).cast("long").alias("auto_min_bps"))

"""Findings scored against planted truth, calibration fits and their thresholds."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators import scoring


def outcomes(finding_rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Per finding: what it touches in truth(payment_id, code, class): true_positive, misclassified or false_positive."""
    rows = finding_rows.join(truth.withColumnRenamed("class", "true_class"), "payment_id", "left")
    verdict = F.when(F.col("code").isNull(), "false_positive").when(F.col("class") == F.col("true_class"), "true_positive").otherwise("misclassified")
    return rows.withColumn("verdict", verdict)


def by_code(finding_rows: DataFrame, truth: DataFrame) -> DataFrame:
    hits = outcomes(finding_rows, truth).where("verdict <> 'false_positive'").groupBy("payment_id").agg(F.max((F.col("verdict") == "true_positive").cast("int")).alias("right"))
    rows = truth.join(hits, "payment_id", "left")
    return rows.groupBy("code").agg(F.count("*").alias("planted"), F.sum(F.coalesce("right", F.lit(0))).alias("detected"), F.count(F.when(F.col("right") == 0, 1)).alias("misclassified"))


def confusion(finding_rows: DataFrame, truth: DataFrame) -> DataFrame:
    return outcomes(finding_rows, truth).groupBy(F.coalesce("true_class", F.lit("none")).alias("true_class"), "class").agg(F.count("*").alias("n"))


def full_confusion(finding_rows: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """true_class by class with both sentinels: no_discrepancy (a finding on nothing) and not_detected (planted, no finding is right about it).

    by: columns of both sides that tell runs apart. Pool runs with pooled().
    """
    found = outcomes(finding_rows.drop(*by), truth.drop(*by)) if by else outcomes(finding_rows, truth)
    if by:
        found = found.join(finding_rows.select("id", *by), "id")
    right = finding_rows.select("payment_id", "class").distinct()
    missed = truth.join(right, ["payment_id", "class"], "left_anti").select(*by, F.col("class").alias("true_class"), F.lit("not_detected").alias("class"))
    rows = found.select(*by, F.coalesce("true_class", F.lit("no_discrepancy")).alias("true_class"), "class").unionByName(missed)
    return rows.groupBy(*by, "true_class", "class").agg(F.count("*").alias("n"))


def pooled(confusions: DataFrame) -> DataFrame:
    """Runs put together by adding counts, never by averaging rates."""
    return confusions.groupBy("true_class", "class").agg(F.sum("n").alias("n"))


def class_rows(confusion_rows: DataFrame) -> DataFrame:
    """Per class support, tp, fp, fn, precision, recall and F1 (0 without a denominator); the sentinels are no classes."""
    same = F.col("true_class") == F.col("class")
    sides = confusion_rows.select(F.explode(F.array(F.struct(F.col("true_class").alias("name"), F.lit(True).alias("planted")), F.struct(F.col("class").alias("name"), F.lit(False).alias("planted")))).alias("s"), same.alias("same"), "n")
    add = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0))
    sums = sides.where("s.name NOT IN ('no_discrepancy', 'not_detected')").groupBy(F.col("s.name").alias("class")).agg(
        add(F.col("same") & F.col("s.planted")).alias("tp"), add(~F.col("same") & ~F.col("s.planted")).alias("fp"), add(~F.col("same") & F.col("s.planted")).alias("fn")
    )
    return _rates(sums.withColumn("support", F.col("tp") + F.col("fn")))


def _rates(rows: DataFrame) -> DataFrame:
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows = rows.withColumn("precision", part(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", part(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averages(rows: DataFrame) -> DataFrame:
    """One row for each of macro (mean over classes planted or predicted) and micro (over all counts): precision, recall, f1."""
    rates = ("precision", "recall", "f1")
    macro = rows.where("support > 0 OR tp > 0 OR fp > 0").agg(*(F.coalesce(F.avg(r), F.lit(0.0)).alias(r) for r in rates)).withColumn("average", F.lit("macro"))
    micro = _rates(rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))).select(*rates, F.lit("micro").alias("average"))
    return macro.unionByName(micro)


def recall_by_record(finding_rows: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: planted items, those that any finding touches, their share in bps."""
    hit = truth.join(finding_rows.select("payment_id").distinct().withColumn("hit", F.lit(1)), "payment_id", "left")
    counts = hit.agg(F.count("*").alias("planted"), F.count("hit").alias("touched"))
    product = 10_000 * F.col("touched")
    return counts.withColumn("recall_bps", F.when(F.col("planted") > 0, ((product - product % F.col("planted")) / F.col("planted")).cast("long")).otherwise(0).cast("long"))


def undetected(finding_rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Codes of which nothing was found right, the most planted money first. truth has amount_paise."""
    money = truth.groupBy("code").agg(F.sum("amount_paise").alias("planted_paise"))
    return by_code(finding_rows, truth.drop("amount_paise")).where("detected = 0").join(money, "code").select("code", "planted", "planted_paise").orderBy(F.desc("planted_paise"), "code")


def escalate_threshold(points: DataFrame) -> DataFrame:
    """One row: the highest confidence up to which no more than half are right (0 if none). The window runs over counts by value, 10,001 rows at most."""
    counts = points.groupBy("confidence_bps").agg(F.count("*").alias("n"), F.sum("correct").alias("right"))
    upto = Window.orderBy("confidence_bps")
    rows = counts.select("confidence_bps", F.sum("n").over(upto).alias("n"), F.sum("right").over(upto).alias("right"))
    return rows.agg(F.coalesce(F.max(F.when(2 * F.col("right") <= F.col("n"), F.col("confidence_bps"))), F.lit(0)).cast("long").alias("escalate_max_bps"))


def class_scores(finding_rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class true and false positives, missed items; precision and recall in bps, floored (0 without a denominator)."""
    o = outcomes(finding_rows, truth)
    tp = o.groupBy("class").agg(F.count(F.when(F.col("verdict") == "true_positive", 1)).alias("tp"), F.count(F.when(F.col("verdict") != "true_positive", 1)).alias("fp"))
    found = o.where("verdict = 'true_positive'").select("payment_id", "class").distinct().withColumn("hit", F.lit(1))
    items = truth.join(found, ["payment_id", "class"], "left").groupBy("class").agg(F.count("*").alias("items"), F.count("hit").alias("hits"))
    rows = tp.join(items, "class", "full_outer").na.fill(0)
    bps = lambda a, b: F.when(b > 0, ((10_000 * a - (10_000 * a) % b) / b).cast("long")).otherwise(0).cast("long")
    return rows.select("class", "tp", "fp", (F.col("items") - F.col("hits")).alias("fn"), bps(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_bps"), bps(F.col("hits"), F.col("items")).alias("recall_bps"))


def reliability(points: DataFrame) -> DataFrame:
    """points(confidence_bps, correct) in ten bins: count, sum of confidence, correct ones."""
    c = F.col("confidence_bps")
    return points.groupBy(F.least(((c - c % 1000) / 1000).cast("long"), F.lit(9).cast("long")).alias("bin")).agg(F.count("*").alias("n"), F.sum("confidence_bps").alias("sum_bps"), F.sum("correct").alias("n_correct"))


def isotonic_breakpoints(points: DataFrame) -> list[tuple[int, int]]:
    """Breakpoints (raw, calibrated) of the non-decreasing fit; only counts by raw value (10,001 at most) reach the driver."""
    rows = points.groupBy("confidence_bps").agg(F.count("*").alias("n"), F.sum("correct").alias("right")).orderBy("confidence_bps").collect()
    blocks: list[list[int]] = []
    for r in rows:
        blocks.append([r["confidence_bps"], r["confidence_bps"], r["n"], int(r["right"])])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            lo, hi, n, right = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + n, blocks[-1][3] + right]
    return [(x, 10_000 * right // n) for lo, hi, n, right in blocks for x in dict.fromkeys((lo, hi))]


def clopper_pearson_upper_bps(errors: int, n: int, level_bps: int = 9500) -> int:
    """The one-sided upper bound of an error rate, in bps rounded up, by bisection on the binomial tail."""
    if n == 0 or errors >= n:
        return 10_000
    alpha = 1 - level_bps / 10_000
    lo, hi = 0.0, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        tail = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(errors + 1)) if n <= 1000 else _tail(errors, n, p)
        lo, hi = (p, hi) if tail > alpha else (lo, p)
    return min(10_000, int(hi * 10_000) + 1)


def _tail(errors: int, n: int, p: float) -> float:
    from math import exp, lgamma, log

    return sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)) for k in range(errors + 1))


def auto_threshold(points: DataFrame, target_bps: int = 50) -> int | None:
    """scoring.auto_threshold() of points(source, confidence_bps, correct) as a number (None: unreachable)."""
    rows = points.select("source", F.col("confidence_bps").alias("calibrated_bps"), (F.col("correct") == 1).alias("label"))
    found = scoring.auto_threshold(rows, target_bps).first()["auto_min_bps"]
    return None if found > 10_000 else found

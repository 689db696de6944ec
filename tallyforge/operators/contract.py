"""Contract rules: matching, pricing, gaps and the checks of a rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.money import apply_bps

METHODS = ("card", "upi", "netbanking", "wallet", "emi")
CARD_TYPES = ("credit", "debit", "prepaid")
GST_BPS = 1800
#: A contract has dozens of rules; a larger table is joined without a broadcast.
MOST_RULES = 10_000


def mcc_matches(pattern: Column, mcc: Column) -> Column:
    """A pattern is a code or a prefix with *; null matches any code."""
    prefix = F.startswith(mcc, F.rtrim(pattern, F.lit("*")))
    return pattern.isNull() | F.when(F.endswith(pattern, F.lit("*")), prefix).otherwise(mcc == pattern)


def mcc_meet(a: Column, b: Column) -> Column:
    """Whether some code matches both patterns."""
    stem = lambda p: F.rtrim(p, F.lit("*"))
    reaches = lambda p, q: F.endswith(p, F.lit("*")) & F.startswith(stem(q), stem(p))
    return a.isNull() | b.isNull() | (a == b) | reaches(a, b) | reaches(b, a)


def _small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(MOST_RULES + 1).count() <= MOST_RULES else rules


def match(payments: DataFrame, rules: DataFrame) -> DataFrame:
    """payments joined with every rule that applies. The method is an equi key (a rule for any method is expanded), the rest filters.

    rules may have columns network and mcc_pattern; then payments have network and mcc.
    """
    methods = F.when(F.col("method").isNull(), F.array(*map(F.lit, METHODS))).otherwise(F.array("method"))
    r = rules.withColumn("method", F.explode(methods)).select(*(F.col(c).alias(f"r_{c}") for c in rules.columns))
    on = (
        (F.col("method") == F.col("r_method"))
        & (F.col("r_card_type").isNull() | (F.col("r_card_type") == F.col("card_type")))
        & (F.col("r_is_international").isNull() | (F.col("r_is_international") == F.col("is_international")))
        & (F.col("amount_paise") >= F.col("r_amount_min")) & (F.col("r_amount_max").isNull() | (F.col("amount_paise") < F.col("r_amount_max")))
        & (F.col("day") >= F.col("r_effective_from")) & (F.col("r_effective_to").isNull() | (F.col("day") < F.col("r_effective_to")))
    )
    if "network" in rules.columns:
        on &= F.col("r_network").isNull() | (F.col("r_network") == F.col("network"))
    if "mcc_pattern" in rules.columns:
        on &= mcc_matches(F.col("r_mcc_pattern"), F.col("mcc"))
    return payments.join(_small(r), on)


def price(payments: DataFrame, rules: DataFrame) -> DataFrame:
    """Fee components with their tax: one row for each payment, rule and part that charges.

    The cap holds for the ad-valorem part alone; a cap that brings it to nothing leaves a component of
    0, a fee that rounds to nothing leaves none; the fixed fee comes on top.
    """
    m = match(payments, rules)
    raw = apply_bps(F.col("amount_paise"), F.col("r_rate_bps"))
    adval = F.struct(F.lit("adval").alias("part"), F.col("r_fee_type").alias("fee_type"), F.when(F.col("r_cap").isNotNull(), F.least(raw, F.col("r_cap"))).otherwise(raw).alias("fee_paise"), raw.alias("uncapped"), (raw > 0).alias("emit"))
    fixed = F.struct(F.lit("fixed").alias("part"), F.lit("fixed").alias("fee_type"), F.col("r_fixed_fee").cast("long").alias("fee_paise"), F.col("r_fixed_fee").cast("long").alias("uncapped"), (F.col("r_fixed_fee") > 0).alias("emit"))
    parts = m.withColumn("c", F.explode(F.filter(F.array(adval, fixed), lambda c: c["emit"])))
    return parts.select(*payments.columns, F.col("r_rule_id").alias("rule_id"), F.col("r_cap").alias("cap"), "c.part", "c.fee_type", "c.fee_paise", "c.uncapped").withColumn("tax_paise", apply_bps(F.col("fee_paise"), F.lit(GST_BPS)))


def taxes(payments: DataFrame, rules: DataFrame, treatments: DataFrame) -> DataFrame:
    """Taxes by treatments(rule_id, tax_type, rate_bps, base): id, rule_id, tax_type, on_fee_type, base_paise, tax_paise.

    A tax on fee_amount is charged for each component of its rule, one on transaction_gross once for
    each rule that applies, whatever components that gives; its on_fee_type is null.
    """
    t = _small(treatments)
    fee = price(payments, rules).select("id", "rule_id", F.col("fee_type").alias("on_fee_type"), F.col("fee_paise").alias("base_paise")).join(t.where("base = 'fee_amount'"), "rule_id")
    gross = match(payments, rules).select("id", F.col("r_rule_id").alias("rule_id"), F.lit(None).cast("string").alias("on_fee_type"), F.col("amount_paise").alias("base_paise")).join(t.where("base = 'transaction_gross'"), "rule_id")
    return fee.unionByName(gross).select("id", "rule_id", "tax_type", "on_fee_type", "base_paise", apply_bps(F.col("base_paise"), F.col("rate_bps")).alias("tax_paise"))


def supersession_faults(rules: DataFrame) -> DataFrame:
    """Rules whose hand-over from the rule they supersede is not right, with the first fault: rule_id, supersedes, fault."""
    scope = [c for c in ("method", "network", "card_type", "is_international", "mcc_pattern", "amount_min", "amount_max") if c in rules.columns]
    before = rules.select(F.col("rule_id").alias("supersedes"), *(F.col(c).alias(f"b_{c}") for c in (*scope, "fee_type", "effective_to")), F.lit(True).alias("known"))
    equal = F.lit(True)
    for c in scope:
        equal &= F.col(c).eqNullSafe(F.col(f"b_{c}"))
    fault = (
        F.when(F.col("known").isNull(), "unknown_rule")
        .when(~F.col("b_effective_to").eqNullSafe(F.col("effective_from")), "not_contiguous")
        .when(~equal, "scope_changed")
        .when(F.col("b_fee_type") != F.col("fee_type"), "fee_type_changed")
    )
    rows = rules.where("supersedes IS NOT NULL").join(before, "supersedes", "left")
    return rows.select("rule_id", "supersedes", fault.alias("fault")).where("fault IS NOT NULL")


def gaps(payments: DataFrame, rules: DataFrame) -> DataFrame:
    """Payments that no rule applies to."""
    return payments.join(match(payments, rules).select("id").distinct(), "id", "left_anti")


def emitted(rate: Column, fee_type: Column, fixed: Column) -> Column:
    """The fee types that a rule can charge: its own if it has a rate, fixed if it has a fixed part."""
    return F.array_compact(F.array(F.when(rate > 0, fee_type), F.when(fixed > 0, "fixed")))


def overlaps(rules: DataFrame) -> DataFrame:
    """Pairs of rules that could charge one payment the same fee type; by what they emit, where rules have a rate and a fixed part."""
    a, b = (rules.select(*(F.col(c).alias(f"{x}_{c}") for c in rules.columns)) for x in "ab")
    same = lambda c: F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull() | (F.col(f"a_{c}") == F.col(f"b_{c}"))
    meets = lambda lo, hi, top: F.greatest(f"a_{lo}", f"b_{lo}") < F.least(F.coalesce(f"a_{hi}", top), F.coalesce(f"b_{hi}", top))
    alike = F.col("a_fee_type") == F.col("b_fee_type")
    if {"rate_bps", "fixed_fee"} <= set(rules.columns):
        alike = F.arrays_overlap(*(emitted(F.col(f"{x}_rate_bps"), F.col(f"{x}_fee_type"), F.col(f"{x}_fixed_fee")) for x in "ab"))
    on = (F.col("a_rule_id") < F.col("b_rule_id")) & alike & same("method") & same("card_type") & same("is_international")
    on &= meets("amount_min", "amount_max", F.lit((1 << 62))) & meets("effective_from", "effective_to", F.lit("9999-12-31").cast("date"))
    if "network" in rules.columns:
        on &= same("network")
    if "mcc_pattern" in rules.columns:
        on &= mcc_meet(F.col("a_mcc_pattern"), F.col("b_mcc_pattern"))
    return a.join(b, on).select(F.col("a_rule_id").alias("rule_a"), F.col("b_rule_id").alias("rule_b"))


def amount_gaps(rules: DataFrame) -> DataFrame:
    """Amounts that no rule of a scope covers: from what the rules below reach to where the next begins."""
    before = Window.partitionBy("fee_type", "method", "card_type").orderBy("amount_min", "rule_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.coalesce("amount_max", F.lit(1 << 62))).over(before), F.lit(0))
    return rules.withColumn("gap_from", reach.cast("long")).where(F.col("gap_from") < F.col("amount_min")).select("fee_type", "method", "card_type", "gap_from", F.col("amount_min").cast("long").alias("gap_to"))


def uncovered(rules: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Values that no rule names, unless a rule takes any."""
    known = rules.select(F.explode(F.when(F.col(column).isNull() & (F.lit(column) == "method"), F.array(*map(F.lit, values))).otherwise(F.array(column))).alias(column))
    every = rules.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(known, column, "left_anti")


def version_as_of(events: DataFrame, rules: DataFrame, at: str) -> DataFrame:
    """For each event the latest effective_from of the rules that is not after it (null if none)."""
    versions = rules.select("effective_from").where("effective_from IS NOT NULL").distinct()
    known = [r[0] for r in versions.limit(MOST_RULES + 1).collect()]
    if len(known) <= MOST_RULES:  # so few that each event finds its own among them, without a join
        every = F.array(*map(F.lit, known)) if known else F.array().cast("array<date>")
        return events.withColumn("version_from", F.array_max(F.filter(every, lambda v: v <= F.col(at))))
    return events.join(versions, F.col("effective_from") <= F.col(at), "left").groupBy(*events.columns).agg(F.max("effective_from").alias("version_from"))

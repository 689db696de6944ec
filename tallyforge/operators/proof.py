"""One table of proofs and one of their terms for all tiers of the cascade, and the checks that take nothing on trust.

proofs: credit_id, credit_paise, currency, tier, attempted, declined (reasons of the tiers before, in order),
outcome, reason, settlement_id (by key), n_terms, sum_paise, residual_paise, n_competing, confidence, subset_size,
n_candidates, proof_hash. terms: credit_id, pos, type, id, signed_paise. competing: credit_id, nth, unit_ids, sum_paise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators.components import kept, parts
from tallyforge.operators.decompose import search_terms
from tallyforge.operators.scoring import CONFIDENCE

#: The names of reasons in reports, by what the tiers call them.
REASONS = {
    "no_structural_key": "no_structural_key",
    "structural_key_not_found": "structural_key_not_found",
    "structural_key_ambiguous": "structural_key_ambiguous",
    "structural_key_shared": "credit_shares_structural_key",
    "no_units": "no_candidates_in_window",
    "too_many_units": "too_many_candidates",
    "none": "no_subset_sums_to_credit",
    "several_subsets": "multiple_subsets_match",
    "node_budget": "node_budget_exhausted",
    "assignment_tie": "assignment_tie",
    "no_assignment_feasible": "no_assignment_feasible",
    "currency_mismatch": "currency_mismatch",
}
TIERS = ("structural", "subset_sum", "assignment")


def _named(reason: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))[reason]


def proof_records(matched: DataFrame, found: DataFrame, moves: DataFrame) -> DataFrame:
    """The records of resolved proofs: by key the whole settlement, by search the units' records. credit_id, type, id, signed_paise."""
    by_key = matched.where("settlement_id IS NOT NULL").select(F.col("id").alias("credit_id"), "settlement_id")
    return moves.join(by_key, "settlement_id").select("credit_id", "type", "id", "signed_paise").unionByName(search_terms(found, moves))


def proof_terms(matched: DataFrame, found: DataFrame, moves: DataFrame) -> DataFrame:
    """proof_records() in canonical order. credit_id, pos, type, id, signed_paise.

    Positions come from a window over each credit, which a hot settlement streams through one task without being held.
    """
    rows = proof_records(matched, found, moves).repartition(parts(moves.sparkSession, moves.count()), "credit_id")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("credit_id").orderBy("type", "id")).cast("long")).select("credit_id", "pos", "type", "id", "signed_paise")


def competing(found: DataFrame) -> DataFrame:
    """The sets of units that an ambiguous credit could be: credit_id, nth, unit_ids, sum_paise."""
    return found.select("credit_id", F.posexplode("competing").alias("nth", "c")).select("credit_id", "nth", "c.unit_ids", "c.sum_paise")


def _hash_sums() -> list[Column]:
    """A row's hash as five numbers of 12 hex digits; their sums over rows don't depend on an order, and no row list is held.

    Each number is summed as two halves of 24 bits, which stay in 64 bits for 2**39 rows.
    """
    row = F.concat_ws("|", F.col("pos").cast("string"), "type", "id", F.col("signed_paise").cast("string"))
    numbers = [F.conv(F.substring(F.sha2(row, 256), 1 + 12 * i, 12), 16, 10).cast("long") for i in range(5)]
    return [F.sum(half).alias(f"h{2 * i + k}") for i, x in enumerate(numbers) for k, half in enumerate((F.shiftright(x, 24), x.bitwiseAND(F.lit((1 << 24) - 1))))]


def _hash_of_sums() -> Column:
    whole = [(F.col(f"h{2 * i}").cast("decimal(20,0)") * (1 << 24) + F.col(f"h{2 * i + 1}")).cast("decimal(38,0)").cast("string") for i in range(5)]
    return F.sha2(F.concat_ws(",", *whole), 256)


def terms_hash(terms: DataFrame) -> DataFrame:
    """credit_id, n_terms, sum_paise and terms_hash, from one pass over terms."""
    sums = terms.groupBy("credit_id").agg(F.count("*").alias("n_terms"), F.sum("signed_paise").alias("sum_paise"), *_hash_sums())
    return sums.select("credit_id", "n_terms", "sum_paise", _hash_of_sums().alias("terms_hash"))


#: What a proof's hash covers beside its terms; how long the search took is not among it.
_HASHED = ("credit_id", "credit_paise", "currency", "tier", "attempted", "declined", "outcome", "reason", "settlement_id", "sum_paise", "residual_paise", "confidence", "subset_size")


def _hash(rows: DataFrame) -> Column:
    part = lambda c: F.concat_ws("+", c) if c in ("attempted", "declined") else F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.sha2(F.concat_ws("|", *(part(c) for c in _HASHED), F.coalesce("terms_hash", F.lit("-"))), 256)


def check_currency(matched: DataFrame, batch_currency: DataFrame) -> DataFrame:
    """matched (with currency) where a credit by key whose settlement has another currency, or several (null in batch_currency), loses its answer: reason currency_mismatch."""
    rows = matched.join(batch_currency.select("settlement_id", F.col("currency").alias("_coin")), "settlement_id", "left")
    off = F.col("settlement_id").isNotNull() & ~F.col("currency").eqNullSafe(F.col("_coin"))
    changed = {"settlement_id": F.when(~off, F.col("settlement_id")), "reason": F.when(off, "currency_mismatch").otherwise(F.col("reason"))}
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in matched.columns))


def sealed(proof_rows: DataFrame, terms: DataFrame) -> DataFrame:
    """proof_rows with proof_hash, made of their fields and of terms."""
    return _sealed(proof_rows.drop("proof_hash").join(terms_hash(terms).select("credit_id", "terms_hash"), "credit_id", "left"))


def _sealed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("proof_hash", _hash(rows)).drop("terms_hash")


def proofs(credits: DataFrame, matched: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """A proof for every credit; those that found has no row for end with their match by key."""
    return _sealed(_stated(credits, matched, found, terms_hash(terms)))


def unsealed(credits: DataFrame, matched: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """proofs() without proof_hash, from records that need no order."""
    sums = records.groupBy("credit_id").agg(F.count("*").alias("n_terms"), F.sum("signed_paise").alias("sum_paise"))
    return _stated(credits, matched, found, sums.withColumn("terms_hash", F.lit(None).cast("string"))).drop("terms_hash")


def _stated(credits: DataFrame, matched: DataFrame, found: DataFrame, sums: DataFrame) -> DataFrame:
    """What proofs say, with terms_hash; sums as of terms_hash()."""
    currency = F.col("currency") if "currency" in credits.columns else F.lit("INR")
    own = credits.select(F.col("id").alias("credit_id"), F.col("amount_paise").alias("credit_paise"), currency.alias("currency"))
    key = matched.select(F.col("id").alias("credit_id"), "settlement_id", F.col("reason").alias("key_reason"))
    search = found.select("credit_id", F.col("tier").alias("s_tier"), F.col("outcome").alias("s_outcome"), F.col("reason").alias("s_reason"), "subset_reason", "unit_ids", "n_candidates", F.size("competing").cast("long").alias("n_competing"))
    rows = own.join(key, "credit_id").join(search, "credit_id", "left").join(sums, "credit_id", "left")
    by_key = F.col("settlement_id").isNotNull() | F.col("s_tier").isNull()
    tier = F.when(by_key, "structural").otherwise(F.col("s_tier"))
    outcome = F.when(F.col("settlement_id").isNotNull(), "resolved").when(by_key, "unresolved").otherwise(F.col("s_outcome"))
    attempted = F.slice(F.array(*map(F.lit, TIERS)), 1, F.when(tier == "structural", 1).when(tier == "subset_sum", 2).otherwise(3))
    declined = F.when(tier == "structural", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(_named(F.col("key_reason")), F.when(tier == "assignment", _named(F.col("subset_reason"))))))
    reason = F.when(outcome == "resolved", F.lit(None)).when(by_key, _named(F.col("key_reason"))).otherwise(_named(F.col("s_reason")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    resolved = outcome == "resolved"
    confidence = F.when(resolved, F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[tier]).otherwise(0).cast("long")
    size = F.when(resolved & (tier != "structural"), F.size("unit_ids")).when(resolved, 1).otherwise(0).cast("long")
    return rows.select(
        "credit_id", "credit_paise", "currency", tier.alias("tier"), attempted.alias("attempted"), declined.alias("declined"), outcome.alias("outcome"), reason.alias("reason"), "settlement_id", zero("n_terms").alias("n_terms"),
        zero("sum_paise").alias("sum_paise"), (F.col("credit_paise") - zero("sum_paise")).alias("residual_paise"), zero("n_competing").alias("n_competing"), confidence.alias("confidence"), size.alias("subset_size"), zero("n_candidates").alias("n_candidates"), "terms_hash",
    )


def may_go_on(matched: DataFrame) -> DataFrame:
    """The credits without an answer by key that the search takes, without the columns of the match."""
    return matched.where("settlement_id IS NULL AND NOT reason <=> 'currency_mismatch'").drop("settlement_id", "reason")


def failures(proof_rows: DataFrame, terms: DataFrame, credits: DataFrame, ledger: DataFrame, batches: DataFrame, n_rows: int | None = None) -> DataFrame:
    """What is wrong with proofs, told from the ledger alone: credit_id, failure; nothing for a sound proof.

    A term that comes twice counts once in the sum. ledger may have a currency. Each check is a join or an aggregate on
    (type, id) or credit_id; no proof is held whole in one task. n_rows, the size of the ledger (counted if not given),
    decides over how many tasks its rows are dealt.
    """
    n = parts(ledger.sparkSession, ledger.count() if n_rows is None else n_rows)
    money = "currency" in credits.columns
    own = credits.select(F.col("id").alias("credit_id"), F.col("amount_paise").alias("is_paise"), "utr", (F.col("currency") if money else F.lit("INR")).alias("is_currency"))
    p = proof_rows.join(own, "credit_id", "left")
    key = F.struct("type", "id")
    t = terms.repartition(n, "credit_id").withColumn("out_of_order", F.lag(key).over(Window.partitionBy("credit_id").orderBy("pos")) > key)
    once = t.groupBy("credit_id", "type", "id").agg(F.count("*").alias("n"), F.min_by("signed_paise", "pos").alias("says_paise"), F.max("out_of_order").alias("out_of_order"))
    real = ledger.select("type", "id", F.col("signed_paise").alias("is_paise"), F.col("settlement_id").alias("of"), (F.col("currency") if "currency" in ledger.columns else F.lit("INR")).alias("coin"))
    owner = batches.where("trim(utr) <> ''").groupBy("utr").agg(F.count("*").alias("n_batches"), F.min("id").alias("of_batch"))
    p = p.join(owner, "utr", "left")
    size = real.where("of IS NOT NULL").groupBy(F.col("of").alias("of_batch")).agg(F.count("*").alias("n_members"))
    met = once.repartition(n, "type", "id").join(real.repartition(n, "type", "id"), ["type", "id"], "left").join(p.select("credit_id", "of_batch", "is_currency"), "credit_id", "left")
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    sums = met.groupBy("credit_id").agg(
        F.sum("is_paise").alias("recomputed"), F.count("*").alias("n_found"), F.count(F.when(F.col("of") == F.col("of_batch"), 1)).alias("n_own"), flag(F.col("n") > 1).alias("repeated"), flag(F.col("is_paise").isNull()).alias("unknown"),
        flag(F.col("is_paise") != F.col("says_paise")).alias("differs"), flag(F.col("out_of_order")).alias("disordered"), flag(F.col("coin") != F.col("is_currency")).alias("foreign"),
    )
    hashed = terms_hash(terms).select("credit_id", "terms_hash")
    every = p.join(sums, "credit_id", "left").join(size, "of_batch", "left").join(hashed, "credit_id", "left").na.fill(0, ["recomputed", "n_found", "n_own", "repeated", "unknown", "differs", "disordered", "foreign", "n_members"])
    resolved, ambiguous = F.col("outcome") == "resolved", F.col("outcome") == "ambiguous"
    by_key = resolved & (F.col("tier") == "structural")
    checks = {
        "credit_unknown": F.col("is_paise").isNull(),
        "credit_differs": F.col("is_paise") != F.col("credit_paise"),
        "currency_differs": F.col("is_currency") != F.col("currency"),
        "term_repeated": F.col("repeated") == 1,
        "term_unknown": F.col("unknown") == 1,
        "term_differs": F.col("differs") == 1,
        "term_of_other_currency": F.col("foreign") == 1,
        "terms_disordered": F.col("disordered") == 1,
        "sum_differs": F.col("recomputed") != F.col("sum_paise"),
        "residual_differs": F.col("sum_paise") + F.col("residual_paise") != F.col("credit_paise"),
        "answer_without_resolution": ~resolved & (F.col("n_found") > 0),
        "reason_lacks": ~resolved & F.col("reason").isNull(),
        "reason_of_resolved": resolved & F.col("reason").isNotNull(),
        "competitors_lack": ambiguous & ((F.col("n_competing") == 0) | ((F.col("reason") == REASONS["several_subsets"]) & (F.col("n_competing") < 2))),
        "no_single_batch": by_key & (F.coalesce("n_batches", F.lit(0)) != 1),
        "not_the_batch": by_key & (F.col("n_batches") == 1) & ((F.col("n_own") != F.col("n_found")) | (F.col("n_own") != F.col("n_members"))),
        "hash_differs": F.col("proof_hash") != _hash(every),
    }
    found = F.filter(F.array(*(F.when(c, n) for n, c in checks.items())), lambda x: x.isNotNull())
    return every.select("credit_id", F.explode(found).alias("failure"))


def cascade(credits: DataFrame, matched: DataFrame, found: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proofs and terms of all tiers, both kept, so that what reads them doesn't search again."""
    terms = kept(proof_terms(matched, found, moves))
    return kept(proofs(credits, matched, found, terms)), terms


def conserved(proof_rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Per credit, whatever its tier: the sums of its terms by type and what stays unexplained (the whole credit, without an answer)."""
    bucket = lambda *types: F.coalesce(F.sum(F.when(F.col("type").isin(*types), F.col("signed_paise"))), F.lit(0)).cast("long")
    sums = terms.groupBy("credit_id").agg(*(bucket(t).alias(n) for t, n in (("payment", "payments"), ("refund", "refunds"), ("chargeback", "chargebacks"), ("adjustment", "adjustments"), ("fee_line", "fees"), ("tax_line", "taxes"))))
    names = ("payments", "refunds", "chargebacks", "adjustments", "fees", "taxes")
    rows = proof_rows.select("credit_id", "tier", "outcome", F.col("credit_paise").alias("amount_paise"), F.col("residual_paise").alias("unexplained_paise")).join(sums, "credit_id", "left").na.fill(0, list(names))
    return rows.select("credit_id", "tier", "outcome", "amount_paise", *names, "unexplained_paise")


def unclaimed(moves: DataFrame, terms: DataFrame) -> DataFrame:
    """Contributing records that no proof has among its terms."""
    return moves.join(terms.select("type", "id"), ["type", "id"], "left_anti")


def statistics(proof_rows: DataFrame) -> DataFrame:
    """Per tier, outcome and reason: how many credits, their money and what stays unexplained of it."""
    return proof_rows.groupBy("tier", "outcome", "reason").agg(F.count("*").alias("n"), F.sum("credit_paise").alias("paise"), F.sum("residual_paise").alias("unexplained_paise"))

"""Which records make up each bank credit: by key, by subset sum, by assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators import search
from tallyforge.operators.components import connected, few, kept

LAG_DAYS = 2


def structural(credits: DataFrame, batches: DataFrame) -> DataFrame:
    """Per credit: settlement_id and reason. A UTR is a key only if one credit and one batch carry it.

    Pure joins: credits that are left have UTRs of their own, and a batch has one UTR, so no claim can clash.
    """
    many = credits.where("trim(utr) <> ''").groupBy("utr").agg(F.count("*").alias("n_credits"))
    owners = batches.groupBy("utr").agg(F.count("*").alias("n_batches"), F.min("id").alias("batch_id"))
    joined = credits.join(many, "utr", "left").join(owners, "utr", "left")
    reason = (
        F.when(F.coalesce(F.trim("utr"), F.lit("")) == "", "no_structural_key")
        .when(F.col("n_credits") > 1, "structural_key_shared")
        .when(F.col("n_batches").isNull(), "structural_key_not_found")
        .when(F.col("n_batches") > 1, "structural_key_ambiguous")
    )
    return joined.select(*credits.columns, reason.alias("reason"), F.when(reason.isNull(), F.col("batch_id")).alias("settlement_id"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def jaccard_bps(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens, in ten-thousandths, floored; 0 for two empty sets."""
    every = F.size(F.array_union(a, b))
    product = (10_000 * F.size(F.array_intersect(a, b))).cast("long")
    return F.when(every == 0, 0).otherwise(((product - product % every) / every).cast("long")).cast("long")


def candidates(credits: DataFrame, units: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """Credits with the units of their merchant whose day is in [value_date - before, value_date + after).

    A text of the units comes along as unit_text. Where both have a currency, it must be the same. The band is an equi join on day buckets of the window's width, so a long history doesn't meet itself.
    """
    width = before + after
    same = "currency" in credits.columns and "currency" in units.columns
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / width)
    c = credits.withColumn("_slot", F.explode(F.sequence(bucket(F.date_sub("value_date", before)), bucket(F.date_add("value_date", after)))))
    u = units.select(F.col("id").alias("unit_id"), "merchant_id", F.col("net_paise").alias("unit_paise"), F.col("day").alias("unit_day"), bucket(F.col("day")).alias("_slot"), *([F.col("text").alias("unit_text")] if "text" in units.columns else []), *(["currency"] if same else []))
    on = ["merchant_id", "_slot", *(["currency"] if same else [])]
    return c.join(u, on).where((F.col("unit_day") >= F.date_sub("value_date", before)) & (F.col("unit_day") < F.date_add("value_date", after))).drop("_slot")


def pair_cost(value_date: Column, amount: Column, narration: Column, unit_day: Column, unit_paise: Column, unit_text: Column) -> Column:
    """Days off the usual lag, then the gap in money, then how unlike the narration is."""
    days = F.abs(F.datediff(value_date, F.date_add(unit_day, LAG_DAYS))).cast("long")
    gap = F.abs(amount - unit_paise)
    unlike = (10_000 - jaccard_bps(tokens(narration), tokens(unit_text))) * 5_000
    return days * 1_000 + F.least(((gap - gap % 100) / 100).cast("long"), F.lit(1_000_000).cast("long")) + ((unlike - unlike % 10_000) / 10_000).cast("long")


def units(moves: DataFrame, batches: DataFrame, matched: DataFrame) -> DataFrame:
    """What the search may put together: id, merchant_id, net_paise, n_records, day, text (and currency).

    moves as of ledger.movements(); batches: id, utr, merchant_id, day; matched as of structural(). A batch
    is one unit, but one whose UTR several credits share falls apart into its records, each payment with
    its fee and tax lines; records of no settlement are units likewise. Batches that a credit has by key
    are left out, and so are units whose records have several currencies. Ids of records and batches must
    differ. The text of a batch is its id and UTR, that of other units their records' ids.
    """
    shared = matched.where("reason = 'structural_key_shared'").select("utr").distinct()
    split = batches.join(shared, "utr", "left_semi").select(F.col("id").alias("settlement_id"), F.col("merchant_id").alias("owner"))
    taken = matched.where("settlement_id IS NOT NULL").select("settlement_id").distinct()
    left = moves.join(taken, "settlement_id", "left_anti").join(split.withColumn("is_split", F.lit(True)), "settlement_id", "left")
    whole = F.col("settlement_id").isNotNull() & F.col("is_split").isNull()
    sums = [F.sum("signed_paise").alias("net_paise"), F.count("*").alias("n_records"), F.min("day").alias("own_day"), F.min(F.coalesce("owner", "merchant_id")).alias("own_merchant"), F.array_sort(F.collect_set(F.when(~whole, F.col("id")))).alias("ids")]
    if coined := "currency" in moves.columns:
        sums += [F.min("currency").alias("currency"), F.max("currency").alias("other")]
    parts = left.groupBy(F.when(whole, F.col("settlement_id")).otherwise(F.col("unit_id")).alias("unit"), whole.alias("whole")).agg(*sums)
    parts = parts.where("currency = other") if coined else parts
    of = batches.select(F.col("id").alias("unit"), "utr", F.col("merchant_id").alias("batch_merchant"), F.col("day").alias("batch_day"), F.lit(True).alias("whole"))
    rows = parts.join(of, ["unit", "whole"], "left").where(~F.col("whole") | F.col("batch_day").isNotNull())
    text = F.when(F.col("whole"), F.concat_ws(" ", "unit", "utr")).otherwise(F.array_join("ids", " "))
    return rows.select(F.col("unit").alias("id"), F.coalesce("batch_merchant", "own_merchant").alias("merchant_id"), "net_paise", "n_records", F.coalesce("batch_day", "own_day").alias("day"), text.alias("text"), *(["currency"] if coined else []))


def search_terms(found: DataFrame, moves: DataFrame) -> DataFrame:
    """The records behind what searched() resolved: credit_id, type, id, signed_paise. A unit names its records by their settlement or by their unit."""
    took = few(found.where("outcome = 'resolved'").select("credit_id", F.explode("unit_ids").alias("unit")))
    keyed = moves.withColumn("unit", F.explode(F.array_compact(F.array("settlement_id", "unit_id"))))
    return keyed.join(took, "unit").select("credit_id", "type", "id", "signed_paise")


_SOLVED = "credit_id string, tier string, outcome string, reason string, subset_reason string, unit_ids array<string>, residual_paise long, n_candidates long, competing array<struct<unit_ids:array<string>,sum_paise:bigint>>"


def _solve(credits: list[dict]) -> list[tuple]:
    """Subset sums in the order of credit ids with growing claims, then one assignment of the rest. credits carry their units,
    the cheapest ones if most (n_units) would not do."""
    units: dict[str, tuple] = {}
    for c in credits:
        for u in c["units"]:
            units[u["unit_id"]] = (u["unit_id"], int(u["unit_paise"]), u["unit_day"])
    claimed: set[str] = set()
    out, rest = [], []
    for c in sorted(credits, key=lambda x: x["id"]):
        near = sorted(u["unit_id"] for u in c["units"] if u["unit_id"] not in claimed)
        n = c["n_units"] - len(c["units"]) + len(near)
        state, ways = search.subset_sum([units[k][1] for k in near], c["amount_paise"]) if c["n_units"] == len(c["units"]) else ("too_many_units", [])
        if not c["n_units"] and c["foreign"]:
            out.append((c["id"], "subset_sum", "unresolved", "currency_mismatch", None, [], c["amount_paise"], 0, []))
        elif state == "found" and len(ways) == 1:
            took = [near[i] for i in ways[0]]
            claimed.update(took)
            out.append((c["id"], "subset_sum", "resolved", None, None, took, 0, n, []))
        elif state == "found":
            out.append((c["id"], "subset_sum", "ambiguous", "several_subsets", None, [], c["amount_paise"], n, [([near[i] for i in w], c["amount_paise"]) for w in ways]))
        elif state == "node_budget":
            out.append((c["id"], "subset_sum", "unresolved", "node_budget", None, [], c["amount_paise"], n, []))
        else:
            rest.append((c, "too_many_units" if state == "too_many_units" else "none" if n else "no_units", n))
    costs = [{u["unit_id"]: int(u["cost"]) for u in c["units"] if u["unit_id"] not in claimed} for c, _, _ in rest]
    for i, ((c, state, n), (unit, tied)) in enumerate(zip(rest, search.pair_up(costs), strict=True)):
        if unit is not None and not tied:
            out.append((c["id"], "assignment", "resolved", None, state, [unit], c["amount_paise"] - units[unit][1], n, []))
        elif unit is not None:
            names = [x for x in (unit, search.rival(costs, i, unit)) if x]
            out.append((c["id"], "assignment", "ambiguous", "assignment_tie", state, [], c["amount_paise"], n, [([x], units[x][1]) for x in names]))
        else:
            reason = "no_assignment_feasible" if costs[i] or c["units"] else "none"
            out.append((c["id"], "assignment" if costs[i] or c["units"] else "subset_sum", "unresolved", reason, state, [], c["amount_paise"], n, []))
    return out


def _reach(n_credits: Column) -> Column:
    """How many of its cheapest units a credit needs in a group of so many: the others claim up to search.MOST_UNITS each by subset
    sums and one by assignment, and one more shows a tie; with more than that left it is over the limit of subset sums anyway."""
    return (search.MOST_UNITS + 1) * n_credits + 1


def grouped(credits: DataFrame, met: DataFrame) -> DataFrame:
    """id, amount_paise, value_date, component and n_credits: which credits hang together by units of met(id, unit_id), and with how many."""
    edges = met.select(F.concat(F.lit("c"), "id").alias("a"), F.concat(F.lit("u"), "unit_id").alias("b"))
    parts = connected(edges).where("node LIKE 'c%'").select(F.substring("node", 2, 1 << 30).alias("id"), "component")
    rows = credits.join(parts, "id", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("c"), "id")))
    return rows.withColumn("n_credits", F.count("*").over(Window.partitionBy("component"))).select("id", "amount_paise", "value_date", "component", "n_credits")


def searched(credits: DataFrame, units: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """credits without a key solved by search: credit_id, tier, outcome, reason, subset_reason (why subset sums gave up on what assignment
    looked at), unit_ids, residual_paise, n_candidates, competing (sets of units that do as well).

    The assignment's cost is pair_cost(); a credit without narration and a unit without text are unlike all others.

    Claims only meet between credits that share a unit of their windows, directly or through others, so
    each component of that graph is a group of its own. A window's units are counted and ranked by cost
    before any are gathered, and a credit brings only as many as its group can make it need.
    """
    met = candidates(credits, units, before, after)
    says = lambda c: F.coalesce(c, F.lit("")) if c in met.columns else F.lit("")
    cost = pair_cost(F.col("value_date"), F.col("amount_paise"), says("narration"), F.col("unit_day"), F.col("unit_paise"), says("unit_text"))
    met = kept(met.select("id", "unit_id", "unit_paise", "unit_day", cost.alias("cost")))
    group = kept(grouped(credits, met))
    foreign = F.lit(False)
    if "currency" in credits.columns and "currency" in units.columns:  # is it the currency alone that leaves a credit without units?
        alone = credits.join(met.select("id").distinct(), "id", "left_anti").drop("currency")
        group = group.join(candidates(alone, units.drop("currency"), before, after).select("id").distinct().withColumn("other", F.lit(True)), "id", "left")
        foreign = F.coalesce("other", F.lit(False))
    of = Window.partitionBy("id")
    ranked = met.withColumn("n_units", F.count("*").over(of)).withColumn("nth", F.row_number().over(of.orderBy("cost", "unit_id"))).join(group.select("id", "n_credits"), "id").where(F.col("nth") <= _reach(F.col("n_credits")))
    near = ranked.groupBy("id").agg(F.collect_list(F.struct("unit_id", "unit_paise", "unit_day", "cost")).alias("units"), F.first("n_units").alias("n_units"))
    ready = group.join(near, "id", "left").select("component", "id", "amount_paise", "value_date", foreign.alias("foreign"), F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("units", F.array().cast("array<struct<unit_id:string,unit_paise:bigint,unit_day:date,cost:bigint>>")).alias("units"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r | {"amount_paise": int(r["amount_paise"]), "n_units": int(r["n_units"]), "units": list(r["units"])} for r in pdf.to_dict("records")]
        names = [x.split()[0] for x in _SOLVED.split(", ")]
        solved = [(*r[:-1], [{"unit_ids": u, "sum_paise": s} for u, s in r[-1]]) for r in _solve(rows)]
        return pd.DataFrame(solved, columns=names)

    parts = int(credits.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, long work: not to be put together in one task
    return ready.repartition(parts, "component").groupBy("component").applyInPandas(run, _SOLVED)


def proofs(matched: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per resolved credit its terms in canonical order, and a hash of what they say."""
    terms = ledger.groupBy("settlement_id").agg(F.array_sort(F.collect_list(F.struct("type", "id", "signed_paise"))).alias("terms"))
    rows = matched.where("settlement_id IS NOT NULL").join(terms, "settlement_id")
    text = F.concat_ws("|", "id", "settlement_id", F.concat_ws(",", F.transform("terms", lambda t: F.concat_ws(":", t["type"], t["id"], t["signed_paise"].cast("string")))))
    return rows.select(F.col("id").alias("credit_id"), "settlement_id", F.size("terms").cast("long").alias("n_terms"), F.sha2(text, 256).alias("proof_hash"))

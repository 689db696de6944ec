"""The audit of run directories: many runs in one plan, written phase by phase, resumed, replayed and looked up.

Ids of a run are only unique in it, so every id is led by its run ("run/id"); then the operators' joins keep runs
apart by themselves. A run's records belong to the merchant of its payments.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.dates import with_day
from tallyforge.operators import contract, decompose, ledger, proof, verify
from tallyforge.operators.components import kept
from tallyforge.sources.run_dir import table_hash

_KEYS = {
    "payments": ("id", "settlement_id", "merchant_id"), "refunds": ("id", "settlement_id", "payment_id"), "chargebacks": ("id", "settlement_id", "payment_id"), "adjustments": ("id", "settlement_id"),
    "fee_lines": ("id", "applies_to_id"), "tax_lines": ("id", "applies_to_fee_id"), "batches": ("id", "merchant_id", "utr"), "bank_credits": ("id", "utr"),
}

Tables = dict[str, DataFrame]


def run_of(key: Column) -> Column:
    return F.substring_index(key, "/", 1)


def scoped(tables: Tables) -> Tables:
    """The tables of run_dir.read() with ids led by their run, days, and the run's merchant on every record."""
    merchants = tables["payments"].groupBy("run").agg(F.min_by("merchant_id", "id").alias("merchant_id")).select("run", F.concat_ws("/", "run", "merchant_id").alias("of_run"))
    out = {}
    for name, df in tables.items():
        for c in _KEYS[name]:
            df = df.withColumn(c, F.when(F.trim(F.col(c)) != "", F.concat_ws("/", "run", c)).otherwise(F.col(c)))
        if name in ("refunds", "chargebacks", "adjustments", "bank_credits"):
            df = df.join(F.broadcast(merchants), "run", "left").withColumnRenamed("of_run", "merchant_id")  # a row for each run
        out[name] = with_day(df) if name in ("payments", "refunds", "chargebacks", "adjustments", "batches") else df
    return out


def decomposed(tables: Tables) -> Tables:
    """Phase one, of scoped() tables: which records make up each credit. moves, matched, proofs, terms, competing."""
    t = tables
    fees = t["fee_lines"].where("applies_to_type = 'payment'")
    moves = kept(ledger.movements(*(t[x] for x in ("payments", "refunds", "chargebacks", "adjustments")), fees, t["tax_lines"]))
    coins = moves.where("settlement_id IS NOT NULL").groupBy("settlement_id").agg(F.min("currency").alias("low"), F.max("currency").alias("currency")).select("settlement_id", F.when(F.col("low") == F.col("currency"), F.col("currency")).alias("currency"))
    matched = kept(proof.check_currency(decompose.structural(t["bank_credits"], t["batches"].select("id", "utr")), coins))
    units = decompose.units(moves, t["batches"], matched)
    found = kept(decompose.searched(proof.may_go_on(matched), units))
    proofs, terms = proof.cascade(t["bank_credits"], matched, found, moves)
    return {"moves": moves, "proofs": proofs, "terms": terms, "competing": proof.competing(found)}


def verified(tables: Tables, rules: DataFrame, done: Tables) -> Tables:
    """Phase two: conserved, unclaimed, gaps, cells and findings of what phase one has resolved."""
    proofs, terms, moves = (done[x] for x in ("proofs", "terms", "moves"))
    conserved = proof.conserved(proofs, terms)
    of = terms.select("credit_id", "type", F.col("id").alias("ref"))
    taken = lambda name, type_: tables[name].drop("settlement_id").join(of.where(F.col("type") == type_).select(F.col("credit_id").alias("settlement_id"), F.col("ref").alias("id")), "id")
    payments = taken("payments", "payment")
    gaps = contract.gaps(payments, rules)
    payments = payments.join(gaps.select("id"), "id", "left_anti")
    lines = tables["fee_lines"].join(payments.select(F.col("id").alias("applies_to_id")), "applies_to_id", "left_semi")
    taxes = tables["tax_lines"].join(lines.select(F.col("id").alias("applies_to_fee_id"), F.col("applies_to_id").alias("payment_id"), "fee_type"), "applies_to_fee_id")
    cells = kept(verify.cells(lines, taxes, contract.price(payments, rules)))
    proven = proofs.where("outcome = 'resolved'").select("credit_id", F.col("credit_id").alias("settlement_id"))
    found = verify.run_findings("AUD", cells, payments, proven, conserved.where("outcome = 'resolved'").withColumn("settlement_id", F.col("credit_id")), taken("chargebacks", "chargeback"), tables["adjustments"], taken("refunds", "refund"))
    found = kept(found.withColumn("run", run_of(F.col("credit_id"))))
    return {"conserved": conserved, "unclaimed": proof.unclaimed(moves, terms), "gaps": gaps.select("id", "amount_paise"), "cells": cells, "findings": found, "evidence": verify.finding_evidence(found, tables["fee_lines"], tables["tax_lines"])}


def reported(tables: Tables, done: Tables) -> Tables:
    """Phase three: clusters of each run's findings, and one row of totals for each run."""
    members = verify.cluster_members("AUD", done["findings"], tables["fee_lines"])
    clusters = members.groupBy("run", "cluster_id").agg(F.count("*").alias("n_findings"), F.sum("impact_paise").alias("impact_paise"))
    open_ = done["conserved"].groupBy(run_of(F.col("credit_id")).alias("run")).agg(F.count("*").alias("n_credits"), F.sum("unexplained_paise").alias("unexplained_paise"))
    left = done["unclaimed"].groupBy(run_of(F.col("id")).alias("run")).agg(F.sum("signed_paise").alias("unclaimed_paise"))
    hits = done["findings"].groupBy("run").agg(F.count("*").alias("n_findings"), F.sum("impact_paise").alias("impact_paise"))
    totals = open_.join(left, "run", "left").join(hits, "run", "left").na.fill(0)
    return {"clusters": clusters, "totals": totals.withColumn("unaccounted_paise", F.col("unexplained_paise") + F.col("unclaimed_paise"))}


class CheckpointConflict(RuntimeError):
    """What is stored is of other inputs or another contract, or has changed since."""


class Phases:
    """Phases of an audit in a folder that all executors share.

    A phase's tables are Parquet; its manifest, written last, names their hashes, those of the inputs and
    the contract, and its own. A phase with a valid manifest is read back, not run again, once the hashes
    of its rows agree; one without (its job died) is written anew. Only hashes come to the driver.
    """

    def __init__(self, spark: SparkSession, root: str, inputs: str, contract_hash: str):
        self.spark, self.root, self.made = spark, root.rstrip("/"), []
        self.head = {"inputs": inputs, "contract": contract_hash}

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def manifest(self, phase: str) -> dict | None:
        fs, path = self._path(f"{phase}.json")
        if not fs.exists(path):
            return None
        text = self.spark.read.text(f"{self.root}/{phase}.json", wholetext=True).first()
        try:
            got = json.loads(text[0])
        except (TypeError, ValueError):  # empty or cut short: the job died while it wrote
            return None
        if got.pop("hash", None) != _sealed(got):
            raise CheckpointConflict(f"the manifest of {phase} has changed")
        for what, value in self.head.items():
            if got[what] != value:
                raise CheckpointConflict(f"{phase} is of another {what}: {got[what][:12]} instead of {value[:12]}")
        return got

    def read(self, phase: str, check: bool = True) -> Tables | None:
        got = self.manifest(phase)
        if got is None:
            return None
        out = {name: self.spark.read.parquet(f"{self.root}/{phase}/{name}") for name in got["tables"]}
        for name, df in out.items():
            if check and table_hash(df) != got["tables"][name]:
                raise CheckpointConflict(f"{name} of {phase} has changed")
        return out

    def run(self, phase: str, make: Callable[[], Tables]) -> Tables:
        if (stored := self.read(phase)) is not None:
            return stored
        self.made.append(phase)
        hashes = {}
        for name, df in make().items():
            df.write.mode("overwrite").parquet(f"{self.root}/{phase}/{name}")
            hashes[name] = table_hash(self.spark.read.parquet(f"{self.root}/{phase}/{name}"))
        body = self.head | {"phase": phase, "tables": hashes}
        fs, path = self._path(f"{phase}.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(body | {"hash": _sealed(body)}, sort_keys=True).encode()))
        out.close()
        return self.read(phase, check=False)


def _sealed(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def inputs_hash(tables: Tables) -> str:
    """A hash of all input rows, whatever files they stand in."""
    return hashlib.sha256("|".join(f"{n}:{table_hash(df)}" for n, df in sorted(tables.items())).encode()).hexdigest()


PHASES = ("decompose", "verify", "report")


def audit(spark: SparkSession, root: str, tables: Tables, rules: DataFrame, phases: Phases | None = None) -> tuple[Tables, str]:
    """All tables of the audit of run_dir.read() tables, and the hash of its report; resumed from root as far as it went there."""
    phases = phases or Phases(spark, root, inputs_hash(tables), table_hash(rules))
    own = scoped(tables)
    done = phases.run("decompose", lambda: decomposed(own))
    done |= phases.run("verify", lambda: verified(own, rules, done))
    done |= phases.run("report", lambda: reported(own, done))
    return done, report_hash(phases)


def report_hash(phases: Phases) -> str:
    return _sealed({p: phases.manifest(p)["tables"] for p in PHASES})


#: The columns that tell a table's rows apart.
ROW_KEYS = {
    "moves": ("type", "id"), "proofs": ("credit_id",), "terms": ("credit_id", "pos"), "competing": ("credit_id", "nth"), "conserved": ("credit_id",), "unclaimed": ("type", "id"), "gaps": ("id",),
    "cells": ("payment_id", "fee_type"), "findings": ("id",), "evidence": ("finding_id", "type", "id"), "clusters": ("run", "cluster_id"), "totals": ("run",),
}


def differences(stored: DataFrame, again: DataFrame, keys: tuple[str, ...], ranges: int = 256) -> DataFrame:
    """keys and side (stored, again or both, where a row has changed) of the rows in which two tables differ.

    Rows are summed up by ranges of their keys' hash first, and only ranges whose sums differ are compared row by row.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(stored.columns)), {"ignoreNullFields": "false"}), 256)
    name = F.xxhash64(*keys)
    marked = [df.select(*keys, F.pmod(name, F.lit(ranges)).alias("_range"), row.alias("_row")) for df in (stored, again.select(*stored.columns))]
    part = lambda i: F.sum(F.conv(F.substring("_row", i, 12), 16, 10).cast("decimal(38,0)"))
    sums = [df.groupBy("_range").agg(F.struct(F.count("*"), part(1), part(13)).alias(x)) for df, x in zip(marked, "ab", strict=True)]
    off = sums[0].join(sums[1], "_range", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("_range")
    left, right = (df.join(F.broadcast(off), "_range", "left_semi").drop("_range") for df in marked)  # at most ranges rows
    met = left.withColumnRenamed("_row", "_a").join(right.withColumnRenamed("_row", "_b"), list(keys), "full_outer")
    side = F.when(F.col("_b").isNull(), "stored").when(F.col("_a").isNull(), "again").otherwise("both")
    return met.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, side.alias("side"))


def replay(spark: SparkSession, root: str, tables: Tables, rules: DataFrame, scratch: str) -> tuple[bool, DataFrame]:
    """Whether an audit made anew from the inputs (in scratch, reading nothing that is stored) gives the stored report, and the rows
    that don't agree: tab, row (its keys), side."""
    stored = Phases(spark, root, inputs_hash(tables), table_hash(rules))
    fresh = Phases(spark, scratch, stored.head["inputs"], stored.head["contract"])
    audit(spark, scratch, tables, rules, fresh)
    rows = spark.createDataFrame([], "tab string, row string, side string")
    for phase in PHASES:
        was, now = stored.manifest(phase)["tables"], fresh.manifest(phase)["tables"]
        kept_rows, made_rows = stored.read(phase, check=False), fresh.read(phase, check=False)
        for name in now:
            if was.get(name) != now[name] or table_hash(kept_rows[name]) != now[name]:
                keys = ROW_KEYS[name]
                rows = rows.unionByName(differences(kept_rows[name], made_rows[name], keys).select(F.lit(name).alias("tab"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("row"), "side"))
    return rows.isEmpty(), rows


def write_lookup(done: Tables, path: str, parts: int = 32) -> None:
    """What explain() reads: a line for each thing to say of a record, in folders by ranges of (type, id), with the ends of each range beside them."""
    moves, proofs = done["moves"], done["proofs"]
    said = lambda df, section, *cols: df.select("type", "id", F.lit(section).alias("section"), F.to_json(F.struct(*cols)).alias("says"))
    claims = done["terms"].select("type", "id", "credit_id").join(proofs.select("credit_id", "tier", "outcome", "reason", "confidence", "proof_hash"), "credit_id")
    cells = done["cells"].select(F.lit("payment").alias("type"), F.col("payment_id").alias("id"), "fee_type", "fee_delta", "tax_delta")
    cited = done["evidence"].join(done["findings"].select(F.col("id").alias("finding_id"), "class", "impact_paise", "fee_type"), "finding_id")
    rows = said(moves, "record", "settlement_id", "merchant_id", "day", "signed_paise", "currency").unionByName(said(claims, "proof", "credit_id", "tier", "outcome", "reason", "confidence", "proof_hash"))
    rows = rows.unionByName(said(cells, "cell", "fee_type", "fee_delta", "tax_delta")).unionByName(said(cited, "finding", "finding_id", "class", "impact_paise", "fee_type"))
    rows = rows.unionByName(said(done["unclaimed"].select("type", "id", "signed_paise"), "unclaimed", "signed_paise"))
    ranged = rows.repartitionByRange(parts, "type", "id").sortWithinPartitions("type", "id", "section").withColumn("part", F.spark_partition_id())
    ranged.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    ends = rows.sparkSession.read.parquet(f"{path}/rows").groupBy("part").agg(F.min(F.struct("type", "id")).alias("low"), F.max(F.struct("type", "id")).alias("high"))
    ends.coalesce(1).write.mode("overwrite").parquet(f"{path}/ends")


def explain(spark: SparkSession, path: str, type_: str, id_: str) -> DataFrame:
    """section and says (JSON) of what the audit knows of one record; only the folders whose range can hold it are read."""
    key = F.struct(F.lit(type_).alias("type"), F.lit(id_).alias("id"))
    parts = [r["part"] for r in spark.read.parquet(f"{path}/ends").where((F.col("low") <= key) & (F.col("high") >= key)).select("part").collect()]  # one, or two at a border
    return spark.read.parquet(f"{path}/rows").where(F.col("part").isin(parts) & (F.col("type") == type_) & (F.col("id") == id_)).select("section", "says").orderBy("section", "says")

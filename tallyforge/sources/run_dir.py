"""Run directories: the JSON inputs of one audit, their fingerprints, and results with a read-back check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = "id string, {}, amount struct<paise:long,currency:string>, settlement_id string"
#: The arrays of each input file and their fields.
SCHEMAS = {
    "ledger.json": {
        "payments": _OWN.format("merchant_id string, method string, network string, card_type string, is_international boolean, mcc string, captured_at timestamp"),
        "refunds": _OWN.format("payment_id string, is_partial boolean, created_at timestamp"),
        "chargebacks": _OWN.format("payment_id string, reason_code string, stage string, raised_at timestamp, resolved_at timestamp"),
        "adjustments": _OWN.format("kind string, reason string, created_at timestamp"),
    },
    "settlement_report.json": {
        "fee_lines": "id string, applies_to_id string, applies_to_type string, fee_type string, computed_amount struct<paise:long,currency:string>, rule_id string",
        "tax_lines": "id string, applies_to_fee_id string, tax_type string, rate_bps int, base_amount struct<paise:long,currency:string>, amount struct<paise:long,currency:string>",
        "batches": "id string, merchant_id string, cycle_start timestamp, cycle_end timestamp, expected_credit struct<paise:long,currency:string>, utr string, status string",
    },
    "bank_statement.json": {"bank_credits": "id string, utr string, amount struct<paise:long,currency:string>, value_date date, narration string"},
}


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The record tables of a run directory (or of several, by a glob), with money as bigint paise and run, the directory."""
    out = {}
    for file, arrays in SCHEMAS.items():
        schema = ", ".join(f"{name} array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _fields(kinds))}>>" for name, kinds in arrays.items())
        whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/{file}").withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
        for name, kinds in arrays.items():
            rows = whole.select("run", F.explode(name).alias("r")).select("run", "r.*")
            for f in _fields(kinds):
                column, kind = f.strip().split(" ", 1)
                if kind.startswith("struct<paise"):
                    rows = rows.withColumn(column.replace("computed_amount", "amount") + "_paise", F.col(f"{column}.paise")).withColumn("currency", F.col(f"{column}.currency")).drop(column)
            out[name] = rows
    return out


def _fields(kinds: str) -> list[str]:
    """The fields of a schema text, split at the commas outside angle brackets."""
    parts, depth, now = [], 0, ""
    for ch in kinds:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += ch
    return [*parts, now]


def _documents(tables: dict[str, DataFrame], file: str) -> DataFrame:
    """run and text: the JSON document of each run for one of the input files. The format has one document for a run, so its rows meet in one row."""
    out = None
    for name, kinds in SCHEMAS[file].items():
        parts = []
        for f in _fields(kinds):
            column, kind = f.strip().split(" ", 1)
            money = F.struct(F.col(column.replace("computed_amount", "amount") + "_paise").alias("paise"), "currency") if kind.startswith("struct<paise") else None
            parts.append((F.col(column) if money is None else money).alias(column))
        rows = tables[name].groupBy("run").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias(name))
        out = rows if out is None else out.join(rows, "run", "full_outer")
    every = [F.coalesce(n, F.array().cast(out.schema[n].dataType)).alias(n) for n in SCHEMAS[file]]
    return out.select("run", F.to_json(F.struct(*every)).alias("text"))


def write(tables: dict[str, DataFrame], path: str, quarantined: DataFrame | None = None) -> None:
    """Writes the tables of read() as run directories under path, with quarantined.json (rows of quarantined(run, reason, ...)) and
    manifest.json (how many records and quarantined rows a run has). A run's files appear under their names once all its documents are written."""
    spark = next(iter(tables.values())).sparkSession
    texts = None
    for file in SCHEMAS:
        rows = _documents(tables, file).withColumn("file", F.lit(file))
        texts = rows if texts is None else texts.unionByName(rows)
    counts = None
    for df in tables.values():
        counts = df.select("run") if counts is None else counts.unionByName(df.select("run"))
    counts = counts.groupBy("run").agg(F.count("*").alias("records"))
    if quarantined is not None:
        held = quarantined.groupBy("run").agg(F.to_json(F.collect_list(F.struct(*(c for c in quarantined.columns if c != "run")))).alias("text"), F.count("*").alias("n"))
        texts = texts.unionByName(held.select("run", "text", F.lit("quarantined.json").alias("file")))
        counts = counts.join(held.select("run", F.col("n").alias("quarantined")), "run", "left").na.fill(0)
    texts = texts.unionByName(counts.select("run", F.to_json(F.struct(*(c for c in counts.columns))).alias("text"), F.lit("manifest.json").alias("file")))
    texts.repartition("run", "file").write.mode("overwrite").partitionBy("run", "file").text(f"{path}/_parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(conf)
    for run in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_parts/run=*")):  # names only: a few files for each run
        own = jvm.org.apache.hadoop.fs.Path(f"{path}/{run.getPath().getName().removeprefix('run=')}")
        fs.mkdirs(own)
        for file in fs.listStatus(run.getPath()):
            part = next(s.getPath() for s in fs.listStatus(file.getPath()) if s.getPath().getName().startswith("part-"))
            to = jvm.org.apache.hadoop.fs.Path(own, file.getPath().getName().removeprefix("file="))
            fs.delete(to, False)
            fs.rename(part, to)
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_parts"), True)


def fingerprints(spark: SparkSession, *paths: str) -> DataFrame:
    """name and SHA-256 of the bytes of each file."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def table_hash(df: DataFrame) -> str:
    """A hash of a table's rows that does not depend on their order: sums of row hashes, and the count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(38,0)"))
    got = df.agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"), part(25).alias("c")).first()
    import hashlib

    return hashlib.sha256("|".join(str(x) for x in got).encode()).hexdigest()


def write_result(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """The result tables as Parquet, with their hashes beside them; read_result() refuses a table whose hash differs."""
    hashes = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        hashes[name] = table_hash(df.sparkSession.read.parquet(f"{path}/{name}"))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(sorted(hashes.items()), "name string, hash string").coalesce(1).write.mode("overwrite").json(f"{path}/hashes")
    return hashes


def read_result(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    out = {}
    for r in spark.read.schema("name string, hash string").json(f"{path}/hashes").collect():
        df = spark.read.parquet(f"{path}/{r['name']}")
        if table_hash(df) != r["hash"]:
            raise ValueError(f"{r['name']} has changed since it was written")
        out[r["name"]] = df
    return out

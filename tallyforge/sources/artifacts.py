"""Small documents that an audit is pinned to: compiled contracts and calibrations, with their own hash in canonical JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A contract has dozens of rules and a calibration 10,001 breakpoints at most; a larger table is no artifact.
MOST_ROWS = 20_000


class ArtifactError(ValueError):
    """The file is no artifact, is of another kind, or has changed."""


def canonical(row: Column | list[str]) -> Column:
    """Canonical JSON of columns: names in order, no spaces, nulls kept."""
    return F.to_json(F.struct(*sorted(row)) if isinstance(row, list) else row, {"ignoreNullFields": "false"})


def _hash(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(rows: DataFrame, path: str, kind: str, order: list[str], **about: str) -> str:
    """Writes rows in order, with what is said about them, and returns their hash (the version of a contract)."""
    lines = rows.orderBy(*order).select(canonical(rows.columns).alias("line")).limit(MOST_ROWS + 1).collect()
    if len(lines) > MOST_ROWS:
        raise ArtifactError(f"an artifact has at most {MOST_ROWS} rows")
    body = {"kind": kind, "about": about, "schema": json.loads(rows.schema.json()), "rows": [json.loads(r["line"]) for r in lines]}
    fs, p = _fs(rows.sparkSession, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(body | {"sha256": _hash(body)}, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
    return _hash(body)


def load(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, dict]:
    """The rows and what is said about them, with sha256; ArtifactError for a file that is missing, broken, of another kind or changed."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise ArtifactError(f"there is no artifact at {path}")
    try:
        body = json.loads(spark.read.text(path, wholetext=True).first()[0])
        told = body.pop("sha256")
        schema = StructType.fromJson(body["schema"])
    except (TypeError, ValueError, KeyError, AttributeError) as e:
        raise ArtifactError(f"{path} is no artifact") from e
    if body.get("kind") != kind:
        raise ArtifactError(f"{path} is a {body.get('kind')}, not a {kind}")
    if _hash(body) != told:
        raise ArtifactError(f"{path} has changed since it was written")
    lines = spark.createDataFrame([(json.dumps(r),) for r in body["rows"]], "line string")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*"), body["about"] | {"sha256": told}


def seed_of(spark: SparkSession, path: str) -> int:
    """The seed that a run's manifest names; 0 if there is none to be read."""
    fs, p = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        return 0
    try:
        return int(json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])["seed"])
    except (TypeError, ValueError, KeyError, IndexError):
        return 0

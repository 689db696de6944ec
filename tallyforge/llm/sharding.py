"""Size-tiered compaction of immutable Parquet runs under a versioned manifest.

Arrivals are appended as small runs that are never changed. Runs of about the same size form a tier;
when a tier has FAN runs, they are merged into one run of target-sized files (split by bytes a row, as
written). A manifest names the runs of a version. It is committed by creating its file, which the file system
must refuse if the name is there (HDFS and local disks do, object stores with conditional writes do; on others
one writer at a time must commit), so two writers cannot both commit the same version. A manifest says its own
length first: one that is cut short by a dying writer is no version. Once such a one is older than STALE_S, the
next writer passes over its number; a manifest names the version that it follows, so one that a slow writer ends
after all is in no chain of versions, and that writer gets a CommitConflict. A job that dies before it commits leaves
the last version as it was, and folders that no manifest names; sweep() removes those, and cut manifests, once they are old.
Merged runs stay until vacuum() finds that none of the versions to retain names them, so readers of those
versions go on. Only the manifest's entries (one for each run) come to the driver.

Nulls, empty texts, repeated rows and other columns are stored as they come; a null doc_id is dealt by all its
row. A run without rows is recorded with no files. Reading a store without runs gives no rows of the schema
that the store was made with.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN = 4
TARGET_BYTES = 64 << 20
#: Seconds after which a manifest that is cut short is taken for a dead writer's.
STALE_S = 600.0


class CommitConflict(RuntimeError):
    """Another writer has committed that version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = TARGET_BYTES, fan: int = FAN, stale_s: float = STALE_S):
        self.spark, self.root, self.schema, self.target_bytes, self.fan, self.stale_s = spark, root.rstrip("/"), schema, target_bytes, fan, stale_s
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        """The numbers that have a manifest, whole or cut short, in order."""
        fs, folder = self._fs(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def versions(self) -> list[int]:
        """The committed versions, oldest first: the last whole manifest, the one that it follows, and so on as far as they are kept."""
        numbers, found = self._numbers(), []
        at = len(numbers) - 1
        while at >= 0 and (got := self._read(numbers[at])) is None:
            at -= 1
        while at >= 0 and got is not None:
            found.append(numbers[at])
            base = got.get("base", numbers[at] - 1)
            at = numbers.index(base) if base in numbers else -1
            got = self._read(base) if at >= 0 else None
        return found[::-1]

    def version(self) -> int:
        """The last committed version, 0 if none."""
        return (self.versions() or [0])[-1]

    def _read(self, version: int) -> dict | None:
        data = self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json", wholetext=True).first()
        size, _, body = (data[0] if data else "").partition("\n")
        return json.loads(body) if size.isdigit() and int(size) == len(body) else None

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "runs": []}
        if (got := self._read(version)) is None:
            raise ValueError(f"version {version} is not committed")
        return got

    def _age_s(self, number: int) -> float:
        """Seconds since a manifest was last written, by the clock of the file system's server as far as it tells."""
        return time.time() - self._fs().getFileStatus(self._path(f"manifest/v{number:08d}.json")).getModificationTime() / 1000

    def _commit(self, base: int, runs: list[dict]) -> int:
        from py4j.protocol import Py4JJavaError

        later = [n for n in self._numbers() if n > base]
        for n in later:
            if self._read(n) is not None or self._age_s(n) < self.stale_s:
                raise CommitConflict(f"version {n} is there already or is being written")
        number = max([base, *later]) + 1
        fs, final = self._fs(), self._path(f"manifest/v{number:08d}.json")
        body = json.dumps({"version": number, "base": base, "runs": runs})
        try:
            out = fs.create(final, False)
        except Py4JJavaError as e:
            if fs.exists(final):
                raise CommitConflict(f"version {number} is there already") from e
            raise
        out.write(bytearray(f"{len(body)}\n{body}".encode()))
        out.close()
        if number not in self.versions():
            raise CommitConflict(f"version {number} came so late that it was passed over")
        return number

    def _run(self, name: str) -> dict:
        """The entry of a written run."""
        fs, folder = self._fs(), self._path(name)
        sizes = [s.getLen() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".parquet")] if fs.exists(folder) else []
        return {"path": name, "bytes": sum(sizes), "files": len(sizes), "largest": max(sizes, default=0)}

    def _tier(self, run: dict) -> int:
        return int(math.log(max(run["bytes"], 1), self.fan))

    def append(self, rows: DataFrame) -> int:
        """One arrival as one run; returns the new version."""
        old, name = self.manifest(), f"runs/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return self._commit(old["version"], [*old["runs"], self._run(name)])

    def append_all(self, rows: DataFrame, arrivals: int) -> int:
        """Several arrivals written by one pass over rows (those of one hash of doc_id arrive together), committed one by one."""
        name, by = f"runs/{uuid.uuid4().hex}", "arrival"
        while by in {n.lower() for n in self.schema.names}:  # Spark's names don't differ by case
            by = f"_{by}"
        key = F.when(F.col("doc_id").isNull(), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))).otherwise(F.xxhash64("doc_id"))
        rows.withColumn(by, F.pmod(key, F.lit(arrivals))).write.partitionBy(by).parquet(f"{self.root}/{name}")
        for i in range(arrivals):
            old = self.manifest()
            if (run := self._run(f"{name}/{by}={i}"))["files"]:
                self._commit(old["version"], [*old["runs"], run])
        return self.version()

    def compact(self) -> int:
        """Merges tiers with FAN runs or more until none is left; returns the version."""
        while True:
            old = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for run in old["runs"]:
                tiers.setdefault(self._tier(run), []).append(run)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fan]
            if not full:
                return old["version"]
            merged, name = tiers[full[0]][: self.fan], f"runs/{uuid.uuid4().hex}"
            size, rows = sum(r["bytes"] for r in merged), self._rows(merged)
            files, n = max(1, -(-size // self.target_bytes)), rows.count() if size > self.target_bytes else 0
            # coalesce evens out what it is given only roughly, so no file takes more rows than a target's share
            rows.coalesce(files).write.option("maxRecordsPerFile", max(1, -(-n // files)) if n else 0).parquet(f"{self.root}/{name}")
            self._commit(old["version"], [r for r in old["runs"] if r not in merged] + [self._run(name)])

    def vacuum(self, retain: int = 1) -> int:
        """Deletes manifests but the last retain ones, and the runs that only those named; returns how many runs."""
        versions = self.versions()
        old, kept = versions[:-retain], versions[-retain:]
        live = {r["path"] for v in kept for r in self.manifest(v)["runs"]}
        gone = {r["path"] for v in old for r in self.manifest(v)["runs"]} - live
        for v in old:
            self._fs().delete(self._path(f"manifest/v{v:08d}.json"), False)
        for path in gone:
            self._fs().delete(self._path(path), True)
        return len(gone)

    def sweep(self, older_than_s: float = 7 * 86400) -> int:
        """Deletes folders of runs that no version names and nobody has touched for so long (jobs that died), and cut manifests below the last version; returns how many folders."""
        fs, folder = self._fs(), self._path("runs")
        committed = self.versions()
        for n in self._numbers():
            if committed and n < committed[-1] and n not in committed and self._age_s(n) >= max(older_than_s, self.stale_s):
                fs.delete(self._path(f"manifest/v{n:08d}.json"), False)
        live = {r["path"].split("/")[1] for v in committed for r in self.manifest(v)["runs"]}
        gone = 0
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName() not in live and s.getModificationTime() / 1000 <= time.time() - older_than_s:
                gone += bool(fs.delete(s.getPath(), True))
        return gone

    def _rows(self, runs: list[dict]) -> DataFrame:
        paths = [f"{self.root}/{r['path']}" for r in runs if r["files"]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["runs"])


def stored(docs: DataFrame, root: str, arrivals: int = 8) -> DataFrame:
    """docs appended in several arrivals, compacted, and read back by the last manifest."""
    store = ShardStore(docs.sparkSession, root, docs.schema)
    store.append_all(docs, arrivals)
    store.compact()
    store.vacuum()
    return store.read()

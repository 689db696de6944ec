"""Which nodes of a graph hang together, and rows kept so that a long plan starts anew from them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []
#: Rows that a task sorts or groups at once, and rows of a side that may be broadcast.
ROWS_A_TASK = 250_000
MOST_BROADCAST = 500_000


def parts(spark: SparkSession, rows: int) -> int:
    """In how many partitions to deal so many rows, so that a task's share doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def few(df: DataFrame) -> DataFrame:
    """df marked for broadcast if a count shows that it has at most MOST_BROADCAST rows, else as it is."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode an own one where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not named and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyforge-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return (named or now.get()).rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder; what follows doesn't make them again, whatever executors are lost.

    They are read back as a table of columns: what follows reads only those that it names, and knows how large they are
    (packed ids would look small enough to broadcast). The folder is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyforge-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove, spark)
    _MADE.append(path)
    df.write.option("compression", "none").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _MADE:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder is the cluster's to clean
        return


def connected(edges: DataFrame) -> DataFrame:
    """node and component (the least node that can be reached) of the nodes of edges(a, b), both of one type.

    Every node points to a node that is not greater. A round lets a node and what it points to take the
    least pointer of a pointer among their neighbours, so trees shrink as fast as they are joined; the
    rounds grow with the logarithm of a component's length. No node's neighbours are gathered.
    """
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    up = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
    told = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "up").cast("decimal(38,0)")).alias("h")).first()
    before = told(up)
    while True:
        top = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "up", "top")
        near = both.join(top.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("low"))
        met = top.join(near, "node").select("node", "up", F.least("top", "low").alias("low"))
        offers = met.select("node", "low").unionByName(met.select(F.col("up").alias("node"), "low"))
        up = kept(offers.groupBy("node").agg(F.min("low").alias("up")))
        now = told(up)
        if now == before:
            return up.withColumnRenamed("up", "component")
        before = now

"""Posting as a stream: entries arrive in files, each idempotency key is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def post(entries: DataFrame, journal: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of journal entries to the Parquet folder journal, whatever is sent or retried twice.

    A batch goes to a folder of its own, overwritten if the batch runs again, and leaves out keys that
    earlier batches have posted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["idempotency_key"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(journal)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            posted = spark.read.parquet(journal).where(F.col("batch") != number).select("idempotency_key")
            rows = rows.join(posted, "idempotency_key", "left_anti")
        rows.write.mode("overwrite").parquet(f"{journal}/batch={number}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_volume(events: DataFrame, at: str, amount: str, late: str = "10 days") -> DataFrame:
    """Tumbling daily counts and sums; rows later than the watermark no longer count. Works on streams and tables."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum(amount).alias("paise")).select(F.col("w.start").alias("day"), "n", "paise")

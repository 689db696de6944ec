"""Streams whose events come late or in any order: reversals matched by keyed state, and two streams joined on an interval of days."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OPEN = "amount_paise long, version long, n_credits long, open array<string>"
_STATE = "version long, n_credits long, won array<string>, credits array<string>"


def open_reversals(events: DataFrame) -> DataFrame:
    """A stream of events(kind: chargeback or credit, id, amount_paise) to, for each amount that a batch touches, its version and the won
    chargebacks that are left without a credit of that amount: the last in the order of ids.

    The state of an amount is the ids seen of both kinds, each once, so events may come twice and in any order; the
    highest version of an amount is what stands. Keys are amounts: a state is as large as an amount's events.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, _, won, credits = state.get if state.exists else (0, 0, [], [])
        seen = {"chargeback": set(won), "credit": set(credits)}
        for b in batches:
            for kind, i in zip(b["kind"], b["id"], strict=True):
                seen[kind].add(i)
        won, credits = sorted(seen["chargeback"]), sorted(seen["credit"])
        state.update((version + 1, len(credits), won, credits))
        yield pd.DataFrame({"amount_paise": [key[0]], "version": [version + 1], "n_credits": [len(credits)], "open": [won[len(credits) :]]})

    rows = events.where("kind IN ('chargeback', 'credit')").select("amount_paise", "kind", "id")
    return rows.groupBy("amount_paise").applyInPandasWithState(run, _OPEN, _STATE, "update", GroupStateTimeout.NoTimeout)


def write_open_reversals(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes open_reversals() by batch; a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return open_reversals(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(rows: DataFrame) -> DataFrame:
    """What the last version of each amount says: amount_paise, id of each chargeback without a reversal."""
    last = rows.groupBy("amount_paise").agg(F.max_by("open", "version").alias("open"))
    return last.select("amount_paise", F.explode("open").alias("id"))


def near_in_time(credits: DataFrame, units: DataFrame, before: int = 5, after: int = 5, late: str = "10 days") -> DataFrame:
    """Credits(id, merchant_id, value_date) with units(id, merchant_id, day), both streams or tables, whose day is in [value_date - before,
    value_date + after): id, unit_id, merchant_id.

    Both sides have a watermark, so a row leaves the state once the other side's watermark has passed its interval; rows that
    come later than the watermark are dropped and counted (dropped()).
    """
    c = credits.select("id", F.col("merchant_id").alias("of"), F.col("value_date").cast("timestamp").alias("at")).withWatermark("at", late)
    u = units.select(F.col("id").alias("unit_id"), "merchant_id", F.col("day").cast("timestamp").alias("on")).withWatermark("on", late)
    inside = F.expr(f"merchant_id = of AND on >= at - INTERVAL {int(before)} DAYS AND on < at + INTERVAL {int(after)} DAYS")
    return c.join(u, inside).select("id", "unit_id", "merchant_id")


def dropped(query: StreamingQuery) -> int:
    """How many rows came too late for the query's state, of the progress that is kept."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])

"""Streaming additions: idempotent appends and incremental index maintenance by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.snapshots import diff


def first_writes(events: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Keyed transactions of a stream, once each (type, account_id, request_id); keys are forgotten after the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["type", "account_id", "request_id"])


def balances_by_window(events: DataFrame, time: str = "ts", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Net amount of each account and window of time; late rows beyond the delay don't count."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), "account_id").agg(F.sum("amount").alias("net"), F.count("*").alias("n"))


def maintain_index(current: Callable[[], DataFrame], apply: Callable[[DataFrame], None], keys: list[str], state: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch is a new snapshot; its difference to the current one goes to `apply`."""

    def batch(df: DataFrame, _: int) -> None:
        apply(diff(current(), df, keys, state).filter("action <> 'unchanged'"))

    return batch

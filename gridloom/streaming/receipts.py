"""Structured Streaming: resumable ingest with receipts, late rows aside, and event-time windows.

The reference semantics are batch; these are the same rules for a stream, labelled extensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def source(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder, `files` to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def _timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """Times without a zone are the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def first_receipts(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each receipt once, however often it is sent within the delay."""
    return _timed(events, ts, delay).dropDuplicatesWithinWatermark(keys)


def accept(batch: DataFrame, known: DataFrame, key: str = "url", identity: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """Rows of a batch that are new, and those whose identity differs from the receipt at hand: the
    first are taken, the second refused; rows that are known already are in neither."""
    met = batch.join(known.select(key, F.col(identity).alias("__known")), key, "left")
    return met.where("__known IS NULL").drop("__known"), met.where(F.col("__known") != F.col(identity)).drop("__known")


def split_late(events: DataFrame, cutoff: str, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows up to a retrieval time, and those published after it, whose state is unknown."""
    at = F.lit(cutoff).cast("timestamp")
    return events.where(F.col(ts) <= at), events.where(F.col(ts) > at)


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "2 hours", ts: str = "ts") -> DataFrame:
    out = _timed(events, ts, delay).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", delay: str = "2 hours", ts: str = "ts") -> DataFrame:
    out = _timed(events, ts, delay).groupBy(F.window(ts, width, step), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours", ts: str = "ts") -> DataFrame:
    out = _timed(events, ts, delay).groupBy(F.session_window(ts, gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def running_state(events: DataFrame) -> DataFrame:
    """For each user the number of events so far and the largest value, kept between batches."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, float("-inf"))
        for pdf in frames:
            n, top = n + len(pdf), max(top, float(pdf["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, n bigint, top double", "n bigint, top double", "update", GroupStateTimeout.NoTimeout)


#: What a delivery of a payload can come to; one that repeats the receipt at hand comes to nothing.
ACCEPTED, OTHER_IDENTITY, OVER_ALLOWANCE = "accepted", "refused: another identity", "refused: over the allowance"


def _receipts(allowance: int):
    """Keeps a receipt for each key as state: the identity and size of the first payload within the allowance.
    Keys come to Python many to a batch, with their states, not by a call for each."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(frames)).sort_values(["place", "identity"], kind="stable")  # of one key and batch, without payloads
        known = state.get[0] if state.exists else None
        out = []
        for place, identity, size in zip(arrived["place"].tolist(), arrived["identity"].tolist(), arrived["size_"].tolist()):
            if known == identity:
                continue
            outcome = OTHER_IDENTITY if known is not None else OVER_ALLOWANCE if size > allowance else ACCEPTED
            if outcome == ACCEPTED:
                known = identity
                state.update((identity, int(size)))
            out.append((key[0], place, identity, size, outcome))
        yield pd.DataFrame(out, columns=["key", "place", "identity", "size", "outcome"])

    return update


def received(deliveries: DataFrame, allowance: int, key: str = "url", place: str = "seq", identity: str = "sha256", size: str = "bytes") -> DataFrame:
    """(key, place, identity, size, outcome) of a stream of deliveries: the first payload of a key within
    the allowance is accepted, others of another identity are refused, and repeats leave no trace. What
    is known of a key survives restarts from the checkpoint. In a batch a key's deliveries count by
    `place`; those without a key or an identity are left out."""
    own = deliveries.select(F.col(key).alias("key"), F.col(place).cast("long").alias("place"), F.col(identity).cast("string").alias("identity"), F.col(size).cast("long").alias("size_"))
    own = own.where("key IS NOT NULL AND identity IS NOT NULL")
    kind = own.schema["key"].dataType.simpleString()
    rows, kept = f"key {kind}, place bigint, identity string, size bigint, outcome string", "identity string, size bigint"
    return own.groupBy("key").applyInPandasWithState(_receipts(allowance), rows, kept, "append", GroupStateTimeout.NoTimeout)

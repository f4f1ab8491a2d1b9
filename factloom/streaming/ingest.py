"""The ingestion stages over streams: the same per-record logic as in batch, with state where a stage remembers.

An addition of ours: event-time watermarks bound that state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.ingestion import CANDIDATE_STEPS


def read(spark: SparkSession, folder: str, file_glob: str, schema) -> DataFrame:
    """A stream over the Parquet files of a folder that match a pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def source_dedup(stream: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """One candidate for each (source, record key, version); with a watermark (column, delay) old keys are forgotten."""
    key = ["source_id", "record_key", "version"]
    if watermark is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, size: str, delay: str, *keys: str) -> DataFrame:
    """Records in event-time windows, late ones beyond the watermark left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Each event with the state before it; an event that isn't allowed leaves the state as it was."""
    before = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, to in zip(rows["seq"], rows["state"]):
        good = to == "received" if before is None else to in CANDIDATE_STEPS.get(before, ())
        out.append((key[0], int(seq), before, to, good))
        before = to if good else before
    if before is not None:
        state.update((before,))
    yield pd.DataFrame(out, columns=["candidate", "seq", "before", "state", "allowed"])


def transitions(stream: DataFrame) -> DataFrame:
    """The candidate state machine over a stream (candidate, seq, state)."""
    schema = "candidate string, seq bigint, before string, state string, allowed boolean"
    return stream.select("candidate", "seq", "state").groupBy("candidate").applyInPandasWithState(_judge, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything that is there and returns what it wrote to a new table under ``folder``."""
    place = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/table")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/table")


def run_complete(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an aggregation over everything that is there; the whole result is written to a new table under ``folder``."""
    place = f"{folder}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/table")

    query = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/table")

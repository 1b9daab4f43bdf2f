"""The fetch log as a stream: host throttling with state, and windowed counts with late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webloom.operators.state import LEAST, MOST, PENALTY, RELAX

#: What a stream of state needs set.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _multiplier() -> StatefulProcessor:
    """A host's spacing: doubled by complaints, relaxed by clean responses.

    A local class travels by value: the runner of stateful processors imports none of the application's modules.
    """

    class Multiplier(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.value = handle.getValueState("multiplier", "m double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
            m = self.value.get()[0] if self.value.exists() else LEAST
            batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
            for bad in batch["bad"]:
                m = min(MOST, m * PENALTY) if bad else max(LEAST, m / RELAX)
            self.value.update((m,))
            yield pd.DataFrame({"host": [key[0]], "multiplier": [m], "n": [len(batch)]})

        def close(self) -> None:
            pass

    return Multiplier()


def throttle(log: DataFrame) -> DataFrame:
    """A stream of (host, multiplier, n) after each batch from a stream (host, ts, event_id, bad). Rows of a batch are taken by time."""
    return log.groupBy("host").transformWithStateInPandas(_multiplier(), outputStructType="host string, multiplier double, n long", outputMode="Update", timeMode="None")


def outcome_counts(log: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and kind of a stream (ts, event_id, event_type), each event once, rows later than ``late`` left out."""
    once = log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    one = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet")
    return one.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over what there is and stop; exactly once by its checkpoint beside ``path``."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}-checkpoint").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_updates(stream: DataFrame, path: str) -> None:
    """The same for streams that update their rows: each batch is written under its number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()

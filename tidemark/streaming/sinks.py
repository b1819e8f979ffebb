"""Running streams: callbacks on closed bars, periodic micro-batches, and stored results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk with changelogs; arbitrary state needs this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def on_batch(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 5) -> StreamingQuery:
    """Call back with every micro-batch, each ``seconds``; the checkpoint makes a restart go on where it stopped."""
    return stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run over all that is there now and append the results as parquet, exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

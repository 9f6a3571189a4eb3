"""The two inputs that only grow, as streams: files for the index and the feedback log. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans import index
from tessera.sources.files import FEEDBACK


def index_stream(texts: DataFrame, at: str, checkpoint: str, **options) -> StreamingQuery:
    """A stream of texts (path, hash, text) into the chunk table. A batch that comes again, after a failure, overwrites its own folder."""

    def load(batch: DataFrame, number: int) -> None:
        index.chunk_texts(batch.dropDuplicates(["path", "hash"]), **options).write.mode("overwrite").parquet(f"{at}/batch={number}")

    return texts.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_windows(spark: SparkSession, at: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Searches and poor results by mode in windows of time; rows later than ``late`` no longer count."""
    log = spark.readStream.schema(FEEDBACK).json(at).where("mode IS NOT NULL").withColumn("at", F.try_to_timestamp("timestamp"))
    return log.withWatermark("at", late).groupBy(F.window("at", width), "mode").agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("num_results") < 3).alias("low_results"))

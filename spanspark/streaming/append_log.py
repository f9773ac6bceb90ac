"""An append-and-flush log of raw responses as a stream: files in, kept lines and raw records out, restartable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanspark.functions import text as T

RECORD = "batch_idx int, model string, sampled_formulas array<string>, response string"


def incoming(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RECORD).json(path)


def kept_lines(records: DataFrame) -> DataFrame:
    """(batch_idx, line, reason) of each response line; reason null: kept."""
    each = records.select("batch_idx", F.explode(F.split("response", "\n")).alias("line")).withColumn("line", T.strip_numbering(F.trim("line"))).where("line <> ''")
    return each.withColumn("reason", T.reject_reason(F.col("line")))


def follow(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes kept lines and raw records of each micro-batch; a batch that is replayed overwrites its own files."""

    def store(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").json(f"{out}/raw/epoch={epoch}")
        kept_lines(batch).where("reason is null").select("batch_idx", "line").write.mode("overwrite").parquet(f"{out}/kept/epoch={epoch}")
        batch.unpersist()

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, window, n): event-time sessions with a watermark; an extension, for event streams."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("window")).agg(F.count(F.lit(1)).alias("n"))

"""Streaming ingest, an extension of the batch funnel: each batch drops what an accepted-hash table already holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(stream: DataFrame, accepted: str, checkpoint: str, text: str = "text", order: str = "doc_id") -> StreamingQuery:
    """Appends to the Parquet table `accepted` each text of the stream that it does not hold yet, the first by order.

    A batch is written under its own number, so one that runs again after a failure replaces itself."""
    def settle(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("sha256", F.sha2(text, 256))
        firsts = rows.groupBy("sha256").agg(F.min(order).alias(order))
        new = rows.join(firsts, ["sha256", order], "left_semi").dropDuplicates(["sha256"])
        spark = batch.sparkSession
        try:
            held = spark.read.parquet(accepted).filter(F.col("batch") != number).select("sha256")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = None
        kept = new if held is None else new.join(held, "sha256", "left_anti")
        kept.write.mode("overwrite").parquet(f"{accepted}/batch={number}")

    return stream.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

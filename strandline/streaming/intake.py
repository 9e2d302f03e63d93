"""Facts as a stream: each micro-batch of edge or symbol rows is appended once, by batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline import schema


def stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.readStream.schema(schema.FACTS[table]).parquet(f"{folder}/{table}")


def append(rows: DataFrame, out: str, checkpoint: str):
    """A query that writes what has arrived and then stops; run again for what arrives later. A repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Request log as a stateless append stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files

REQUEST_SCHEMA = (
    "request_id bigint, ts string, db_id string, mode string, status string, "
    "total_ms double, generation_ms double, execution_ms double"
)


def request_stream(spark: SparkSession, path: str, schema: T.StructType | str = REQUEST_SCHEMA) -> DataFrame:
    """Requests as they arrive as JSON-lines files."""
    return spark.readStream.schema(schema).json(path)


def log_record(requests: DataFrame) -> DataFrame:
    """The record that is kept for one request."""
    return requests.select(
        "request_id", "ts", "db_id", "mode", "status",
        *[F.round(c, 3).alias(c) for c in ("total_ms", "generation_ms", "execution_ms")],
        F.when(F.col("status") != "success", F.col("status")).alias("error_type"),
    )


def write_log(records: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append every record once; the checkpoint lets a restarted query go on where it was."""
    writer = (
        records.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()


def save_batch(batch: DataFrame, number: int, path: str) -> bool:
    """Write one micro-batch as JSON lines, once: a number that the ledger has appends nothing.

    The ledger entry follows the data. A run that broke off between the two writes the same folder
    again, so the data stand there once either way.
    """
    spark = batch.sparkSession
    if files.exists(spark, f"{path}/ledger/{number:012}"):
        return False
    batch.write.mode("overwrite").json(f"{path}/data/batch={number}")
    return files.create_once(spark, f"{path}/ledger/{number:012}", f"{number}\n")


def append_batches(records: DataFrame, path: str, checkpoint: str):
    """The same through ``foreachBatch`` with a ledger of batch numbers; read it with
    ``logged_batches``. A log belongs to one checkpoint, which numbers its batches."""
    return (
        records.writeStream.foreachBatch(lambda batch, number: save_batch(batch, number, path) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def logged_batches(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of all batches that the ledger has, with their batch number."""
    if not files.exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("bigint"))
    done = spark.read.schema("batch bigint").csv(f"{path}/ledger")
    data = spark.read.schema(schema).json(f"{path}/data")
    return data.withColumn("batch", F.col("batch").cast("bigint")).join(done, "batch", "left_semi")

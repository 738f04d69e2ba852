"""Running a stream over what a folder holds now, and where its files go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickweave.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the cluster names."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def use_rocksdb(spark: SparkSession) -> None:
    """State with several named variables needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_folder(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of files.

    The path is given as a pattern that only it matches, since a stream takes a plain path for a folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available now into files and read them back; a restart continues from the checkpoint."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stage(df: DataFrame, name: str) -> str:
    """Write a batch result as the folder a stream reads from."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return folder

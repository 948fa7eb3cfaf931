"""The same operators on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T


def arriving(spark: SparkSession, folder: str, pattern: str = "*.txt", per_batch: int = 1000) -> DataFrame:
    """path, arrived, content of new files in a folder, at most per_batch of them in a micro-batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select("path", F.col("modificationTime").alias("arrived"), "content")


def cleaned(files: DataFrame) -> DataFrame:
    """path, arrived, text: decoded, without invisible characters, lines tidied."""
    return files.select("path", "arrived", T.clean_lines(T.without_invisible(T.decoded(F.col("content")))).alias("text"))


def first_copies(texts: DataFrame, delay: str = "1 day") -> DataFrame:
    """texts without those whose content came already within the delay; state is kept no longer than that."""
    hashed = texts.withColumn("hash", F.sha2("text", 256)).withWatermark("arrived", delay)
    return hashed.dropDuplicatesWithinWatermark(["hash"])


def counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """start, keys, n for windows of time; rows later than the delay are left out."""
    own = events.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").alias("start"), *keys, "n")

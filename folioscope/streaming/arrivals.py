"""Production as records arrive: counts per window of loading time, late records included up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_arrivals(spark: SparkSession, directory: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of records as a stream, in the order they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def arrivals_per_window(records: DataFrame, key: str, id_col: str = "eid", time_col: str = "loaded_at", window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Records per window of `time_col` and `key`; a record that comes again within the watermark counts once.

    State is held only as long as the watermark asks; records later than it are left out of windows that are closed. Rows with a
    null time or id are left out, null keys are counted as such.
    """
    known = records.where(F.col(time_col).isNotNull() & F.col(id_col).isNotNull()).withWatermark(time_col, late)
    once = known.dropDuplicatesWithinWatermark([id_col])
    counted = once.groupBy(F.window(time_col, window).alias("w"), key).agg(F.count(F.lit(1)).alias("records"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "records")

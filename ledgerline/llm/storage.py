"""Tables written in the session's shared folder to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.shared import new_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 4 << 20) -> None:
    """Bound the Arrow batches that tasks get, in rows and bytes, so that a batch of long texts fits a worker's memory.

    Spark reads these two settings of the session when a query runs, so they stay; a tighter one is kept as it is.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < _plain(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def _plain(setting: str) -> int:
    """A size that may end in a unit, as a number."""
    digits = setting.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    return int(digits.rstrip("kmg")) << unit

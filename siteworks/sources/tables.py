"""Typed scans of the input tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SITE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("gps_height", T.IntegerType()),
        T.StructField("population", T.IntegerType()),
        T.StructField("construction_year", T.IntegerType()),
        T.StructField("date_recorded", T.DateType()),
        T.StructField("funder", T.StringType()),
        T.StructField("scheme_name", T.StringType()),
        T.StructField("permit", T.BooleanType()),
    ]
)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema: no inference pass, empty field is null."""
    return spark.read.schema(schema).option("header", True).option("emptyValue", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def first_existing(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Complete file, else progress file, else table, else an empty frame."""
    for path in paths:
        if path_exists(spark, path):
            return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def merge_by_priority(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of the first source that knows a key win; of several there, the smallest as a whole.

    The minimum combines on the map side, so a key with very many copies sends one
    row per task to the shuffle.
    """
    names = sources[0].columns
    payload = [c for c in names if c != key]
    tagged = None
    for priority, source in enumerate(sources):
        part = source.select(key, F.struct(*payload).alias("payload"), F.lit(priority).alias("priority"))
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy(key).agg(F.min(F.struct("priority", "payload")).alias("best"))
    return best.select(key, "best.payload.*", F.col("best.priority").cast("int").alias("priority"))

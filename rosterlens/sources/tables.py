"""Reading and writing the tables of the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.operators.skew import detach
from rosterlens.session import stage

ROWS_PER_FILE = 1_000_000


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; a missing one is empty when its schema is given."""
    if schema is not None and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def write_by_site(df: DataFrame, path: str, order: list[str] | None = None, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Replace the partitions of the sites in ``df`` and leave the other sites alone.

    Rows are staged first, as ``df`` may be computed from the table it replaces. A site gets as many
    files, and tasks that write them, as its rows need: a small one has one, a very large one many.
    """
    rows = stage(df, "replacement")
    sizes = rows.groupBy("site_id").agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    sized = rows.join(detach(sizes), "site_id")
    spread = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.col("_files"))
    out = sized.repartition("site_id", spread).drop("_files")
    if order:
        out = out.sortWithinPartitions("site_id", *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site_id").parquet(path)


def bucket_of(site_id: Column, buckets: int) -> Column:
    """The folder of a site: a hash, so that the number of folders does not grow with the sites."""
    return F.pmod(F.xxhash64(site_id), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, numbers: list[int] | None = None) -> DataFrame:
    """A table laid out by bucket; only the folders in ``numbers`` are read, if given."""
    rows = read_table(spark, path, T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
    return (rows if numbers is None else rows.where(F.col("bucket").isin(numbers))).drop("bucket")


def write_buckets(df: DataFrame, path: str, buckets: int, order: list[str], mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Replace (or with ``append`` extend) the buckets of the sites in ``df``; other buckets stay.

    A bucket has as many files, and tasks that write them, as its rows need. Files are sorted by
    site first, so that their statistics tell which sites they hold.
    """
    rows = stage(df.withColumn("bucket", bucket_of(F.col("site_id"), buckets)), "replacement")
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    sized = rows.join(detach(sizes), "bucket")
    spread = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.col("_files"))
    out = sized.repartition("bucket", spread).drop("_files").sortWithinPartitions("bucket", "site_id", *order)
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_whole(df: DataFrame, path: str) -> None:
    """Replace a whole table that ``df`` may be computed from."""
    stage(df, "replacement").write.mode("overwrite").parquet(path)


def assert_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Fail when a key occurs twice; the tables of the model have unique keys."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"{name}: key {keys} is not unique, e.g. {twice.first()}")
    return df


def assert_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    bad = df.where(~F.col(column).isin(allowed)).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"{column}: {bad.first()[column]!r} is not one of {allowed}")
    return df

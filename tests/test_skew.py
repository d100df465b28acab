"""A hot key is split at run time, and results stay whole."""

from pyspark.sql import functions as F

from rosterlens.operators.registry import dedupe_registry
from rosterlens.operators.skew import detach

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.shuffle.partitions": "16",
}


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    try:
        for k, v in SMALL.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        rows = spark.range(0, 200000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20000).alias("k"), F.md5(F.col("id").cast("string")).alias("v")
        )
        joined = rows.join(detach(rows.groupBy("k").agg(F.min("v").alias("m"))), "k")
        assert "skew=true" in executed_plan(joined.select("v", "m"))

        pages = spark.range(0, 60000, 1, 8).select(
            F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 9000)).alias("staff_directory"),
            F.concat(F.lit("https://b"), F.col("id") % 2).alias("base_url"), F.when(F.col("id") % 9 == 0, F.md5(F.col("id").cast("string"))).otherwise("").alias("ipeds"),
        )
        hot = dedupe_registry(pages).where("staff_directory = 'hot'")
        # The first row has an id; all others with an id and the other base URL stay.
        assert hot.count() == 1 + pages.where("ord % 9 = 0 and ord % 2 = 1").count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)

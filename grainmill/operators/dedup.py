"""Keep-first dedup with a log, refusal of conflicts, merged provenance, first source wins, agreement or deferral."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first_log(df: DataFrame, same: Column, key: str) -> DataFrame:
    """key, kept_key, dropped for every row."""
    rows = df.select(key, same.alias("_same"))
    first = rows.groupBy("_same").agg(F.min(key).alias("kept_key"), F.count("*").alias("_n")).where("_n > 1").drop("_n")  # partial minima, no window over a hot text
    first = first.withColumnRenamed("_same", "_other")
    out = rows.join(first, F.col("_same").eqNullSafe(F.col("_other")), "left").select(key, F.coalesce("kept_key", F.col(key)).alias("kept_key"))
    return out.withColumn("dropped", F.col(key) != F.col("kept_key"))


def refuse_conflicts(df: DataFrame, same: Column, answer: str, key: str) -> DataFrame:
    """One row a group whose answers agree: smallest key and answer. Groups with different answers are refused whole."""
    g = df.groupBy(same.alias("same")).agg(F.min(key).alias(key), F.min(answer).alias(answer), F.max(answer).alias("other"), F.count("*").alias("n"))
    return g.where(F.col(answer) == F.col("other")).drop("other", "same")


def merge_provenance(df: DataFrame, key: str, source: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("sources"))


def prefer_source(parts: list[DataFrame], key: str) -> DataFrame:
    """Union; of rows with one key that of the first part stays."""
    tagged = [p.withColumn("priority", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return out.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("priority"))).where("rn = 1").drop("rn")


def agree_or_defer(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value (null if several), status."""
    g = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    one = F.col("lo") == F.col("hi")
    return g.select(key, F.when(one, F.col("lo")).alias(value), F.when(one, "agreed").otherwise("deferred").alias("status"))

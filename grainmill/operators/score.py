"""Scores and statistics: collapsed macros, robust groups, paired deltas, seed summaries, distributions, fences, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators import select


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float], nearest: bool = False) -> DataFrame:
    """groups, n (values that are not null) and a column for each share: the quantile on the line between its neighbours, or if nearest the
    value at the share's rank. Equal values are counted first and running counts are made by buckets, so that no task holds a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    sizes = counts.groupBy(*(F.col(g).alias(f"_s{i}") for i, g in enumerate(groups))).agg(F.sum("_c").alias("_n"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_s{i}"))
    told = select.running_sum(counts, groups, "_v", "_c", "_upto").join(F.broadcast(sizes), same)  # a row a group
    at = lambda place: F.max(F.when((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")), F.col("_v")))
    out = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_n") - 1)
        if nearest:
            out.append(at(F.greatest(F.ceil(F.lit(share) * F.col("_n")), F.lit(1)) - 1).alias(name))
        else:
            low, high = at(F.floor(place)).cast("double"), at(F.ceil(place)).cast("double")
            out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return told.groupBy(*groups).agg(F.max("_n").alias("n"), *out)


def collapsed_macro(df: DataFrame, group: str, category: str, credit: Column) -> DataFrame:
    """Mean of the category means of each group, from integer sums."""
    inner = df.groupBy(group, category).agg(F.sum(credit).alias("s"), F.count("*").alias("n")).withColumn("m", F.col("s").cast("double") / F.col("n"))
    return inner.groupBy(group).agg(F.round(F.avg("m"), 6).alias("macro"), F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.count("*").alias("categories"))


def robust_groups(df: DataFrame, group: str, credit: Column, least_rows: int, least_right: int) -> DataFrame:
    g = df.groupBy(group).agg(F.sum(credit).alias("right"), F.count("*").alias("n")).where(F.col("n") >= least_rows)
    return g.agg(F.count("*").alias("groups"), F.sum((F.col("right") >= least_right).cast("long")).alias("robust"))


def tukey(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, adjacent values (furthest within 1.5 interquartile ranges) and outliers of every group."""
    q = quantiles(df, [group], value, {"q1": 0.25, "q3": 0.75}).drop("n")
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(lo, hi)
    return df.join(q, group).groupBy(group, "q1", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.sum((~inside).cast("long")).alias("outliers"))


def histogram_mode(df: DataFrame, group: str, value: str, width: float) -> DataFrame:
    """The fullest bin of each group, the lowest of equals."""
    bins = df.groupBy(group, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    return bins.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "bin"))).where("rn = 1").drop("rn")


def distribution(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, least, greatest and four quantiles of the values of each group that are finite."""
    p = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    finite = df.where(F.abs(F.col(value).cast("double")) < float("inf"))
    q = quantiles(finite, [group], value, {"lo": 0.0, "hi": 1.0, **p})
    kind = df.schema[value].dataType
    return q.select(group, "n", F.col("lo").cast(kind).alias("lo"), F.col("hi").cast(kind).alias("hi"), *(F.round(k, 6).alias(k) for k in p))


def islands(df: DataFrame, group: str, position: str) -> DataFrame:
    """Maximal runs of consecutive positions: group, first, last, n."""
    w = Window.partitionBy(group).orderBy(position)
    return df.select(group, position).distinct().withColumn("g", F.col(position) - F.row_number().over(w)).groupBy(group, "g").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("g")

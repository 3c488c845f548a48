"""Trims, peaks, offsets and windows over grouped measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigma_trim(df: DataFrame, group: str, value: str, sigmas: float, least: int = 25, share: float = 0.3, smallest: int = 50) -> DataFrame:
    """Rows within `sigmas` population deviations of their group's mean, and n; groups below `smallest` rows, or of which fewer than
    max(least, share * n) rows would stay, are whole. Two aggregates and a join, so a hot group is never in one task."""
    stats = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_d"), F.count("*").alias("n"))
    near = F.abs(F.col(value) - F.col("_m")) <= sigmas * F.col("_d")
    inside = df.join(stats, group).groupBy(group).agg(F.first("_m").alias("_m"), F.first("_d").alias("_d"), F.first("n").alias("n"), F.count_if(near).alias("_in"))
    trim = (F.col("n") >= smallest) & (F.col("_in") >= F.greatest(F.lit(least), share * F.col("n")))
    return df.join(inside, group).where(~trim | near).drop("_m", "_d", "_in")


def peaks(df: DataFrame, group: str, slot: Column, k: int) -> DataFrame:
    """group, peak, second: the largest and the k-th largest count of rows in one slot; the k-th is null where there are fewer slots."""
    counts = df.groupBy(group, slot.alias("_slot")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy(F.desc("_n"), "_slot")
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(group).agg(F.max("_n").alias("peak"), F.max(F.when(F.col("_r") == k, F.col("_n"))).alias("second"))


def storms(df: DataFrame, at: str, who: str, width: str, step: str, least: int) -> DataFrame:
    """start, n, n_users: hopping windows in which at least `least` different keys have rows. Keys are counted before windows meet."""
    hops = df.groupBy(F.window(at, width, step)["start"].alias("start"), who).agg(F.count("*").alias("n"))
    found = hops.groupBy("start").agg(F.sum("n").alias("n"), F.count(who).alias("n_users")).where(F.col("n_users") >= least)
    return found.select(F.col("start").cast(df.schema[at].dataType).alias("start"), "n", "n_users")


def best_offset(series: DataFrame, key: str, at: str, value: str, reach: int, least: int) -> DataFrame:
    """key, lag, gap: the shift other than 0 in [-reach, reach] at which a key's series lies nearest to itself (mean gap, rounded down, the
    smaller lag at ties), among shifts with at least `least` positions in both."""
    w = Window.partitionBy(key).orderBy(at)
    gaps = [F.struct(F.lit(s * i).alias("lag"), F.abs(F.col(value) - (F.lag if s < 0 else F.lead)(value, i).over(w)).alias("gap")) for s in (-1, 1) for i in range(1, reach + 1)]
    met = series.select(key, F.array(*gaps).alias("_g")).select(key, F.inline("_g")).where("gap IS NOT NULL")
    mean = met.groupBy(key, "lag").agg(F.expr("sum(gap) div count(*)").alias("gap"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return mean.groupBy(key).agg(F.min(F.struct("gap", "lag")).alias("_b")).select(key, "_b.lag", "_b.gap")


def unique_argmin(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """group, least, key: the row with the smallest value; no key where several rows share it."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"), F.min(key).alias("_k"))
    low = counts.groupBy(group).agg(F.min(F.struct(F.col(value), "_n", "_k")).alias("_b"))
    return low.select(group, F.col(f"_b.{value}").alias("least"), F.when(F.col("_b._n") == 1, F.col("_b._k")).alias(key))


def trimmed_boxes(points: DataFrame, group: str, axes: list[str], tail: float, least: int) -> DataFrame:
    """Per group of at least `least` points: n, median centre, extent between the tails on each axis, and points inside all of them."""
    at = {f: [F.percentile(c, q).alias(f"_{c}{f}") for c in axes] for f, q in (("m", 0.5), ("0", tail), ("1", 1 - tail))}
    box = points.groupBy(group).agg(F.count("*").alias("n"), *at["m"], *at["0"], *at["1"]).where(F.col("n") >= least)
    held = F.lit(True)
    for c in axes:
        held = held & F.col(c).between(F.col(f"_{c}0"), F.col(f"_{c}1"))
    inside = points.join(box, group).groupBy(group).agg(F.count_if(held).alias("inside"))
    sizes = [F.round(F.col(f"_{c}1") - F.col(f"_{c}0"), 6).alias(f"d{c}") for c in axes]
    return box.join(inside, group).select(group, "n", *(F.round(f"_{c}m", 6).alias(f"c{c}") for c in axes), *sizes, "inside")

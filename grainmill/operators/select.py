"""Deterministic selection: hash ranks, round robin, quotas, mixes, best of n. Every order ends in a unique key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.scalar import digest


def hash_ranked(df: DataFrame, stratum: list[str], key: str, seed: str, name: str = "rn") -> DataFrame:
    """Rank of each row in its stratum by the digest of (seed, key)."""
    w = Window.partitionBy(*stratum).orderBy(digest(F.lit(seed), F.col(key)), F.col(key))
    return df.withColumn(name, F.row_number().over(w))


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str, bucket: Column | None = None) -> DataFrame:
    """Rank of each row in its group, from 1, without a task that has to hold a group.

    bucket rises with the order (by default the first digits of the first column's hexadecimal digest, or, if that is a number, its place
    between the least and the greatest): rows are ranked within their bucket, and the buckets' counts, a small table, give what comes before."""
    first = df.select(order[0].alias("o")).schema["o"].dataType
    if bucket is None and isinstance(first, T.StringType):
        bucket = F.substring(order[0], 1, 3)
    elif bucket is None:
        ends = df.agg(F.min(order[0]).cast("double").alias("_lo"), F.max(order[0]).cast("double").alias("_hi"))  # one row
        df = df.crossJoin(F.broadcast(ends))
        bucket = F.floor((order[0].cast("double") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1.0)) * 1023)
    return _running(df.withColumn("_bucket", bucket).drop("_lo", "_hi"), groups, order, F.lit(1), name)


def running_sum(df: DataFrame, groups: list[str], order: str, weight: str, name: str) -> DataFrame:
    """Sum of the weights up to each row in its group, by a numeric column, without a task that has to hold a group."""
    ends = df.agg(F.min(order).cast("double").alias("_lo"), F.max(order).cast("double").alias("_hi"))  # one row
    bucket = F.floor((F.col(order).cast("double") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) * 1023)
    rows = df.crossJoin(F.broadcast(ends)).withColumn("_bucket", bucket).drop("_lo", "_hi")
    return _running(rows, groups, [F.col(order)], F.col(weight), name)


def _running(rows: DataFrame, groups: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """rows(_bucket): sums within buckets, and the buckets' sums, a small table, for what comes before."""
    sizes = rows.groupBy(*groups, "_bucket").agg(F.sum(weight).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    upto = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_inside", F.sum(weight).over(upto))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    told = inside.join(base, same).withColumn(name, F.col("_inside") + F.col("_before"))
    return told.drop("_bucket", "_b", "_inside", "_before", *(f"_g{i}" for i in range(len(groups))))


def balanced_topk(df: DataFrame, stratum: list[str], key: str, k: int, seed: str) -> DataFrame:
    """k rows of every stratum."""
    return hash_ranked(df, stratum, key, seed).where(F.col("rn") <= k)


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows, one of every stratum in turn."""
    few = hash_ranked(df, [stratum], key, seed).where(F.col("rn") <= n)
    return few.orderBy("rn", stratum, key).limit(n)


def nested_round_robin(df: DataFrame, stratum: str, inner: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows: strata in turn, within a stratum its inner groups in turn."""
    few = hash_ranked(df, [stratum, inner], key, seed, "rn_inner").where(F.col("rn_inner") <= n)
    w = Window.partitionBy(stratum).orderBy("rn_inner", inner, key)
    return few.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).orderBy("rn", stratum, key).limit(n)


def best_of(df: DataFrame, group: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The k first rows of each group by order, which has to end in a unique key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= k)


def largest_remainder(weights: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """weights(key, weight) -> key, quota: n seats in proportion, left-over seats by largest remainder, then by key. Integer arithmetic."""
    all_ = Window.partitionBy()  # one row a stratum, so a small table
    base = weights.withColumn("total", F.sum(weight).over(all_)).withColumn("floor", F.expr(f"({n} * {weight}) div total")).withColumn("rest", F.expr(f"({n} * {weight}) % total"))
    left = F.lit(n) - F.sum("floor").over(all_)
    return base.withColumn("quota", F.col("floor") + (F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), key)) <= left).cast("long")).select(key, "quota")


def share_cap(df: DataFrame, capped: Column, key: str, part: int, whole: int, seed: str) -> DataFrame:
    """All other rows, and of the capped ones at most part/whole of the others' number, by hash rank."""
    others = df.where(~capped).agg(F.count("*").alias("others"))
    each = ranked(df.where(capped), [], [digest(F.lit(seed), F.col(key)), F.col(key)], "rn")
    kept = each.crossJoin(F.broadcast(others)).where(F.col("rn") * whole <= F.col("others") * part).drop("rn", "others")  # one row beside it
    return df.where(~capped).unionByName(kept)


def ratio_mix(df: DataFrame, part: Column, shares: dict[str, int], key: str, seed: str) -> DataFrame:
    """The largest mix of the named parts in the given proportion, without replacement."""
    rows = df.withColumn("part", part).where(F.col("part").isin(*shares))
    share = F.element_at(F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(v)))), F.col("part"))
    units = rows.groupBy("part").agg(F.expr("count(*)").alias("c")).withColumn("u", F.expr("c") / share).agg(F.floor(F.min("u")).alias("units"), F.count("*").alias("parts"))
    each = ranked(rows, ["part"], [digest(F.lit(seed), F.col(key)), F.col(key)], "rn").withColumn("share", share)
    return each.crossJoin(F.broadcast(units)).where((F.col("parts") == len(shares)) & (F.col("rn") <= F.col("share") * F.col("units"))).drop("share", "units", "parts", "rn")


def capped_greedy(df: DataFrame, order: str, key: str, caps: dict[str, int], n: int, block_rows: int = 100_000) -> DataFrame:
    """Rows in order (a hexadecimal digest, then key) while no cap on a column's value is exceeded, up to n.

    Caps interact, so the scan is sequential, but in blocks of about block_rows rows: each block is read without the values whose cap is
    full, scanned by one task that knows what was taken before, and the scan ends when n rows are taken. The driver holds what is taken."""
    spark, columns = df.sparkSession, list(caps)
    bucket, taken = F.substring(order, 1, 3), []
    sizes = df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # 4,096 rows at most
    used: dict[tuple, int] = {}
    schema = T.StructType([df.schema[key], *(df.schema[c] for c in columns)])
    at = 0
    while at < len(sizes) and len(taken) < n:
        first, held = at, 0
        while at < len(sizes) and (at == first or held + sizes[at]["n"] <= block_rows):
            held, at = held + sizes[at]["n"], at + 1
        part = df.where(bucket.between(sizes[first]["b"], sizes[at - 1]["b"]))
        for c in columns:
            full = [v for (k, v), m in used.items() if k == c and m >= caps[c] and v is not None]
            part = part.where(F.col(c).isNull() | ~F.col(c).isin(full)) if full else part
        scan = _greedy_scan(dict(used), caps, n - len(taken))
        for row in part.select(key, *columns, order).orderBy(order, key).coalesce(1).mapInPandas(scan, schema).collect():  # n rows at most
            taken.append(row[key])
            for c in columns:
                used[c, row[c]] = used.get((c, row[c]), 0) + 1
    chosen = spark.createDataFrame([(k,) for k in taken], T.StructType([df.schema[key]]))
    return df.join(F.broadcast(chosen), key)


def _greedy_scan(used: dict[tuple, int], caps: dict[str, int], n: int):
    def scan(batches):
        taken, seen = 0, dict(used)
        for batch in batches:
            keep = []
            for i, row in enumerate(batch[list(caps)].itertuples(index=False)):
                keys = [(c, None if v != v else v) for c, v in zip(caps, row, strict=True)]
                if taken < n and all(seen.get(k, 0) < caps[k[0]] for k in keys):
                    taken += 1
                    keep.append(i)
                    for k in keys:
                        seen[k] = seen.get(k, 0) + 1
            yield batch.iloc[keep, : 1 + len(caps)]

    return scan


def shrinking_select(df: DataFrame, order: str, key: str, caps_of: Callable[[int], dict[str, int]], n: int) -> DataFrame:
    """capped_greedy with caps that depend on the wanted number of rows: where fewer are found, that number is wanted, until all are found."""
    total = min(n, df.count())
    while total:
        got = capped_greedy(df, order, key, caps_of(total), total)
        found = got.count()
        if found == total:
            return got
        total = found
    return df.limit(0)


def with_endpoints(df: DataFrame, keys: list[str], at: str, best: list[Column], k: int) -> DataFrame:
    """Every group's first and last row by `at`, and the k best rows between them."""
    group = Window.partitionBy(*keys)
    end = (F.col(at) == F.min(at).over(group)) | (F.col(at) == F.max(at).over(group))
    each = df.withColumn("_end", end).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_end").orderBy(*best, at)))
    return each.where(F.col("_end") | (F.col("_r") <= k)).drop("_end", "_r")


def evenly_spaced(df: DataFrame, group: str, at: str, k: int) -> DataFrame:
    """k rows of every group at the places i (n - 1) div (k - 1) of its order, first and last included; fewer where places fall together."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (k - 1)))
    each = ranked(df, [group], [F.col(at)], "_i").withColumn("_i", F.col("_i") - 1)
    return each.join(sizes.select(group, places.alias("_p")), group).where(F.array_contains("_p", F.col("_i").cast("long"))).drop("_i", "_p")

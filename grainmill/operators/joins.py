"""Joins beyond equality: tolerant interval match, as-of, nearest value, exact-set reconciliation, call and response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import scalar as fn


def interval_match(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, eps: int) -> DataFrame:
    """Pairs of equal keys with |lt - rt| <= eps (integers): equality on buckets of eps, each left row in three of them, then the residual."""
    r = right.withColumn("_b", F.expr(f"{rt} div {eps}"))
    x = left.withColumn("_b", F.explode(F.expr(f"array({lt} div {eps} - 1, {lt} div {eps}, {lt} div {eps} + 1)")))
    return x.join(r, [*keys, "_b"]).where(F.abs(F.col(lt) - F.col(rt)) <= eps).drop("_b")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, value: str) -> DataFrame:
    """For every left row the value of the latest right row of its keys with rt <= lt, by one sort of the union; no pair is ever built."""
    lcols = [c for c in left.columns]
    u = left.select(*lcols, F.col(lt).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[rt].dataType).alias("_rt"))
    empty = [F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols]
    r = right.groupBy(*keys, rt).agg(F.max(value).alias(value)).select(*empty, F.col(rt).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(rt).alias("_rt"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = u.unionByName(r).withColumns({"matched": F.last("_v", True).over(w), "matched_at": F.last("_rt", True).over(w)})
    return both.where("_side = 1").select(*lcols, "matched", "matched_at")


def nearest_fill(df: DataFrame, group: str, order: list[str], value: str, reach: int) -> DataFrame:
    """Nulls take the mean of the nearest values within `reach` rows on either side, or the one there is."""
    w = Window.partitionBy(group).orderBy(*order)
    back, fore = F.last(value, True).over(w.rowsBetween(-reach, -1)), F.first(value, True).over(w.rowsBetween(1, reach))
    return df.withColumn("filled", F.coalesce(F.col(value), (back + fore) / 2, back, fore))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """state (both, left only, right only), n: over the distinct keys of both sides."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    state = F.when(F.col("r").isNull(), "left only").when(F.col("l").isNull(), "right only").otherwise("both")
    return a.join(b, key, "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def _grams(words: Column, n: int) -> Column:
    """Hashes of the runs of n words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + (k - 1)) for k in range(n))))


def contained(documents: DataFrame, passages: DataFrame, found: Column, n: int = 4) -> DataFrame:
    """documents(doc_id, t, ...) and passages(item_id, p, ...) where `found`, which implies that p is within t, holds.

    Words of a passage but its first and last are whole words of every text that holds it, so a passage is looked up by one run of n of
    them, or if it is short by one of them: an equality join, after which only the pairs it gives are compared. Only passages of one or
    two words are compared with every text, and only if there are any."""
    words = F.split(F.trim("p"), r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    keyed = passages.withColumns({"_in": inner}).withColumn("_n", F.when(F.size("_in") >= n, n).when(F.size("_in") > 0, 1).otherwise(0))
    keys = keyed.select("item_id", F.when(F.col("_n") == n, F.array_min(_grams(F.col("_in"), n))).when(F.col("_n") == 1, F.array_min(_grams(F.col("_in"), 1))).alias("_k"), "_n").where("_n > 0")
    mine = documents.select("doc_id", F.split(F.trim("t"), r"\s+").alias("_w"))  # once a text, not once a run
    sizes = sorted(r[0] for r in keyed.select("_n").distinct().collect())  # three at most
    each = F.concat(*(_grams(F.col("_w"), k) for k in sizes if k)) if any(sizes) else F.array().cast("array<bigint>")
    met = mine.select("doc_id", F.explode(F.array_distinct(each)).alias("_k")).join(keys.select("item_id", "_k"), "_k").select("doc_id", "item_id").distinct()
    out = documents.join(met, "doc_id").join(passages, "item_id").where(found)
    if 0 in sizes:
        short = keyed.where("_n = 0").drop("_in", "_n")
        out = out.unionByName(documents.join(short, found))
    return out


def citation_tiers(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id, tier: how a passage is found in a text: exact, with white space collapsed (spaces), or in normal form C as well (nfc)."""
    forms = lambda c: {"c": fn.one_spaced(F.col(c)), "n": fn.nfc(fn.one_spaced(F.col(c)))}
    d = documents.where("text IS NOT NULL").select("doc_id", F.col("text").alias("raw"), *(v.alias({"c": "tc", "n": "t"}[k]) for k, v in forms("text").items()))
    b = passages.where("text <> ''").select("item_id", F.col("text").alias("praw"), *(v.alias({"c": "pc", "n": "p"}[k]) for k, v in forms("text").items()))
    exact, spaces, same = F.contains(F.col("raw"), F.col("praw")), F.contains(F.col("tc"), F.col("pc")), F.contains(F.col("t"), F.col("p"))
    return contained(d, b, exact | spaces | same).select("doc_id", "item_id", F.when(exact, "exact").when(spaces, "spaces").otherwise("nfc").alias("tier"))

"""Joins that assert something: exclusion, one-to-one pairing, ordered equality, two hops, cascades; unions, rewrites, replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclude(df: DataFrame, blocked: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose value of no named column is among the blocked ones: one anti join a list."""
    for values, column in blocked:
        df = df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_anti")
    return df


def flagged(df: DataFrame, lists: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A flag for each list (a one-column frame, and the column it is about): whether the row's value is in it. Rows stay as many."""
    for name, (values, column) in lists.items():
        known = values.select(F.col(values.columns[0]).alias(column)).distinct().withColumn(name, F.lit(True))
        df = df.join(known, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def pairing_census(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, lefts, rights, state: paired (one of each), left only, right only, repeated. Counts are made before the sides meet."""
    a, b = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((left, "lefts"), (right, "rights")))
    both = a.join(b, key, "full").na.fill(0, ["lefts", "rights"])
    state = F.when((F.col("lefts") == 1) & (F.col("rights") == 1), "paired").when(F.col("rights") == 0, "left only").when(F.col("lefts") == 0, "right only").otherwise("repeated")
    return both.withColumn("state", state)


def same_order(left: DataFrame, right: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, n_left, n_right, first_difference (position of the first unequal value, from 1; null if both sides are equal in order)."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select(group, F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("at"), F.col(value).alias(name))

    both = numbered(left, "l").join(numbered(right, "r"), [group, "at"], "full")
    return both.groupBy(group).agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.min(F.when(~F.col("l").eqNullSafe(F.col("r")), F.col("at"))).cast("long").alias("first_difference"))


def two_hops(slots: DataFrame, first: DataFrame, second: DataFrame, key: str, through: str, to: str) -> DataFrame:
    """slots with `to`, looked up by key in first(key, through) and by that in second(through, to); status says which hop failed. A
    repeated entry fails too: nothing is ever found by position."""
    def once(df: DataFrame, k: str, v: str, n: str) -> DataFrame:
        return df.groupBy(k).agg(F.min(v).alias(v), F.count("*").alias(n))

    out = slots.join(once(first, key, through, "_n1"), key, "left").join(once(second, through, to, "_n2"), through, "left")
    status = F.when(F.col("_n1").isNull(), "no index").when(F.col("_n1") > 1, "repeated index").when(F.col("_n2").isNull(), "no position").when(F.col("_n2") > 1, "repeated position").otherwise("found")
    return out.withColumn("status", status).withColumn(to, F.when(F.col("status") == "found", F.col(to))).drop("_n1", "_n2")


def label_cascade(queries: DataFrame, labels: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """queries(query), labels(label) -> query, label, tier: all labels of the first tier that has any: 1 equal, 2 one within the other,
    3 a synonym's label or one within it, 4 a common word of three letters or more. labels is a vocabulary, whose size does not grow with the data."""
    q = queries.select(F.lower(F.trim("query")).alias("query")).where("query <> ''").distinct()
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin("the", "and"))
    within = lambda a, b: F.contains(a, b) | F.contains(b, a)
    known = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if synonyms else F.lit(None).cast("map<string,array<string>>")
    named = q.withColumn("_syn", F.coalesce(F.element_at(known, F.col("query")), F.array().cast("array<string>")))
    l = labels.select("label").distinct()
    tier = (
        F.when(F.col("query") == F.col("label"), 1)
        .when(within(F.col("query"), F.col("label")), 2)
        .when(F.exists("_syn", lambda s: within(s, F.col("label"))), 3)
        .when(F.arrays_overlap(words(F.col("query")), words(F.col("label"))), 4)
    )
    met = named.join(F.broadcast(l), tier.isNotNull()).withColumn("tier", tier)
    best = met.groupBy("query").agg(F.min("tier").alias("tier"))
    return met.join(best, ["query", "tier"]).select("query", "label", "tier")


def disjoint_union(parts: list[DataFrame], key: str) -> DataFrame:
    """The union; a key that more than one row has stops the query when it is read."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    twice = out.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("int").alias("_e"))
    return out.join(twice, key, "left").where(F.col("_e").isNull()).drop("_e")


def carried(base: DataFrame, wider: DataFrame, key: str, digest: str) -> DataFrame:
    """state, n: of the base's rows how many are in the wider set with the same digest, changed, or missing; and how many are new."""
    b, w = base.select(key, F.col(digest).alias("b")), wider.select(key, F.col(digest).alias("w"))
    state = F.when(F.col("b").isNull(), "new").when(F.col("w").isNull(), "missing").when(F.col("b") == F.col("w"), "carried").otherwise("changed")
    return b.join(w, key, "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def replayed(stored: DataFrame, again: DataFrame) -> DataFrame:
    """side, n: rows of one side that the other has not, each counted as often as it is too many: a digest of the rows is counted on both sides."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        return df.groupBy(row.alias("row")).agg(F.count("*").alias(name))

    both = counted(stored, "a").join(counted(again, "b"), "row", "full").na.fill(0, ["a", "b"])
    return both.select(F.explode(F.array(F.struct(F.lit("stored only").alias("side"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("k")), F.struct(F.lit("again only").alias("side"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("k")))).alias("x")).groupBy("x.side").agg(F.sum("x.k").alias("n"))


def table_digest(df: DataFrame, *order: str) -> DataFrame:
    """One row (n, digest) that does not depend on the order of rows: sums of four parts of every row's digest."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), F.concat_ws(":", *(part(i).cast("string") for i in range(4))).alias("digest"))


def markdown_rows(lines: Column) -> Column:
    """Cells of the rows of a markdown table, without its header and rule."""
    rows = F.filter(lines, lambda x: x.rlike(r"^\s*\|.*\|\s*$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\s*\|\s*|\s*\|\s*$", ""), r"\s*\|\s*"), lambda c: F.trim(c))  # noqa: E731  F.trim alone would get the index as the characters to trim
    return F.when(F.size(rows) > 2, F.transform(F.slice(rows, 3, F.size(rows)), cells)).otherwise(F.array().cast("array<array<string>>"))


def quotas(capacity: dict[str, int], weights: dict[str, int], budget: int) -> dict[str, int]:
    """Seats for each kind in proportion to its weight, none beyond its capacity: full kinds leave, and the rest is shared again; what
    whole shares leave over goes by largest remainder, then in the order given."""
    out, open_ = dict.fromkeys(weights, 0), [k for k in weights if capacity.get(k, 0) > 0]
    left = min(budget, sum(capacity.get(k, 0) for k in open_))
    while left and open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] // total >= capacity[k]]
        if not full:
            whole = {k: left * weights[k] // total for k in open_}
            extra = sorted(open_, key=lambda k: (-(left * weights[k] % total), list(weights).index(k)))[: left - sum(whole.values())]
            return out | {k: n + (k in extra) for k, n in whole.items()}
        out |= {k: capacity[k] for k in full}
        left -= sum(capacity[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return out

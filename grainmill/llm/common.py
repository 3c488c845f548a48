"""What the operators of this subpackage share: tables in the shared folder, Arrow plumbing, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of files up to which a stashed table may be broadcast; beyond it joins shuffle. Rows of edges, which are two numbers, alike.
BROADCAST_BYTES, BROADCAST_ROWS = 1 << 22, 1_000_000
#: Bytes of text that a vectorised step holds at once.
BLOCK_BYTES = 1 << 20
#: Bytes of text that a classifier is fitted on at most.
TRAIN_BYTES = 1 << 26
#: Keys of more rows than this are joined apart from the others; there are at most rows / HOT_ROWS of them.
HOT_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="grainmill-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Tables that stash() has written and nobody has deleted yet, in order.
_written: list[str] = []
#: Spark's own removal of a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a reader of it: cuts lineage and survives lost executors.

    The written table replaces the shuffle files of the query that made it, so Spark is told to remove these when the write ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grainmill/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)  # Spark's Python API has no call that deletes a folder
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _written:
            _written.remove(path)


def release(spark: SparkSession, *stashed: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    _delete(spark, [df._stash_path for df in stashed])


def written() -> int:
    """How many stashed tables there are: a mark for release_since()."""
    return len(_written)


def release_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the tables stashed since the mark, but for those given. What a query returns reads its tables until the caller has stored it."""
    _delete(spark, [p for p in _written[mark:] if p not in {df._stash_path for df in keep}])


def bounded(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Mark df for broadcast if the stashed table that it is, or is made of, is small by the size of its files; else leave the join to Spark."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path((of or df)._stash_path)
    size = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def join_by_size(left: DataFrame, right: DataFrame, keys: list[str], size: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right on keys (inner or left). right has one row a key and in `size` the number of left's rows with it.

    The rows of hot keys stay where they are and meet the few hot rows of right by broadcast, if these are as few as bounded() asks;
    all other keys are shuffled, and none of them fills a task. Both sides are read twice, so they should be stashed tables."""
    hot = stash(right.where(F.col(size) > hot_rows), "hot")
    if hot.isEmpty():
        return left.join(right, keys, how)
    rest = left.join(bounded(hot.select(*keys), hot), keys, "left_anti").join(right.where(F.col(size) <= hot_rows), keys, how)
    return left.join(bounded(hot), keys).unionByName(rest)


def map_arrow(df: DataFrame, func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(func, schema)


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without copying, and each row's bounds in them."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def blocks(bounds: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold at most so many bytes together; a longer row stands alone."""
    first = 0
    for i in range(1, len(bounds)):
        if bounds[i] - bounds[first] > most and i - 1 > first:
            yield first, i - 1
            first = i - 1
    if len(bounds) - 1 > first:
        yield first, len(bounds) - 1


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """The column as text, null as empty."""
    return df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows, and at most TRAIN_BYTES of text, for which `train` holds: the same rows whatever
    the partitioning. A single task can therefore hold the sample.

    Ids repeated in labels count once with their largest label, ids repeated in docs with their smallest text; rows without id or label and
    texts of more than a sixteenth of TRAIN_BYTES are not used."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )  # at most `most` rows, so this side may be broadcast
    found = with_text(docs.select("doc_id", "text")).where(F.octet_length("text") <= TRAIN_BYTES // 16).join(F.broadcast(chosen), "doc_id")
    sample = stash(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), "labelled")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over at most `most` lengths
    fits = sample.select("doc_id", F.sum(F.octet_length("text")).over(before).alias("bytes")).where(F.col("bytes") <= TRAIN_BYTES)
    return sample.join(F.broadcast(fits.select("doc_id")), "doc_id")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), root being the smallest node that links reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014) on tables in the shared folder; no component is ever held in one task,
    as a node's neighbours are only aggregated to their minimum."""
    spark = edges.sparkSession

    def store(df: DataFrame) -> tuple[DataFrame, int, object]:
        """The stashed edges, their number and a sum over them, both observed while they are written."""
        seen = Observation()
        out = stash(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        return out, seen.get["n"], seen.get["sum"]

    now, n, total = store(edges.select("a", "b").where("a <> b").distinct())
    while n:
        few = F.broadcast if 2 * n <= BROADCAST_ROWS else (lambda df: df)  # a minimum for each of at most 2 n nodes
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour is tied to the smallest one
        large = both.where("b > a").join(few(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself are tied to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(few(least), "a")
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after, n_after, total_after = store(small)
        release(spark, now)
        same = (n, total) == (n_after, total_after)
        now, n, total = after, n_after, total_after
        if same:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._stash_path = now._stash_path
    return out

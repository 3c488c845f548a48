"""Readers: Parquet tables, strict JSON lines, exact-header CSV, hash-pinned files; write-once sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.jsons import duplicate_keys


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table; only the named columns are scanned."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines of a closed schema. strict: malformed lines, lines with other keys than the schema's, keys repeated at any depth and
    numbers that are not finite raise when they are read."""
    if not strict:
        return spark.read.schema(schema).json(path)
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    rows = spark.read.text(path).where("trim(value) <> ''")
    keys = F.json_object_keys("value")
    faults = duplicate_keys(F.col("value"))
    same = (F.array_sort(keys) == F.array(*(F.lit(n) for n in sorted(fields.fieldNames())))) & F.coalesce((faults[0] == 0) & (faults[1] == 0), F.lit(False))
    checked = rows.select(F.when(same, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("unexpected keys or numbers in: "), F.col("value")))).alias("value"))
    return checked.select(F.from_json("value", fields, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_csv_exact(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """CSV whose header is exactly `header`; all columns are strings."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if df.columns != header:
        raise ValueError(f"{path}: header is {df.columns}, expected {header}")
    return df


def read_pinned(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """Files under path joined with pins(name, sha256, size); `ok` tells whether bytes and size agree. A name is a path below the folder, so
    files of one base name in several folders are told apart. Pins without a file have ok = false."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring_index("path", f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    files = files.select(below.alias("name"), F.sha2("content", 256).alias("found"), F.col("length").alias("found_size"))
    return pins.join(files, "name", "left").withColumn("ok", F.coalesce((F.col("found") == F.col("sha256")) & (F.col("found_size") == F.col("size")), F.lit(False)))


def read_snapshot(spark: SparkSession, path: str, pattern: str, cutoff) -> DataFrame:
    """Names, lengths and times of the files not changed after cutoff whose name matches pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return files.where((F.col("modificationTime") <= F.lit(cutoff)) & F.element_at(F.split("path", "/"), -1).rlike(pattern))


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_sharded(df: DataFrame, path: str, key: str, prefix: int = 2) -> None:
    """Parquet folders by the first hex digits of the key's SHA-256."""
    df.withColumn("shard", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, prefix)).write.partitionBy("shard").mode("errorifexists").parquet(path)


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """path, line, ts, rotation, translation of trajectory files: seven fields a line, blank lines left out. A line of another form, a
    number that is not finite, or a time that does not rise within its file stops the query. A file is one row until its lines part."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("at", "text"))
    fields = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    rows = lines.where("trim(text) <> ''").select("path", (F.col("at") + 1).alias("line"), fields.alias("f"))
    numbers = F.transform(F.slice("f", 2, 6), lambda x: x.try_cast("double"))
    rows = rows.select("path", "line", F.size("f").alias("n"), F.get("f", F.lit(0)).try_cast("decimal(28,9)").alias("ts"), numbers.alias("v"))
    before = F.lag("ts").over(Window.partitionBy("path").orderBy("line"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = (F.col("n") == 7) & F.col("ts").isNotNull() & finite & (F.col("before").isNull() | (F.col("ts") > F.col("before")))
    wrong = F.raise_error(F.concat(F.lit("malformed trajectory line "), F.col("line"), F.lit(" of "), F.col("path"))).cast("array<double>")
    checked = rows.withColumn("before", before).withColumn("v", F.when(sound, F.col("v")).otherwise(wrong))
    return checked.select("path", "line", "ts", F.slice("v", 1, 3).alias("rotation"), F.slice("v", 4, 3).alias("translation"))

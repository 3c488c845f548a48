"""Files beyond tables: line indexes, membership documents, attempt trees, binary arrays and meshes; archives, shards, manifests, journals."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.operators import select


def read_line_index(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), offset, length and sha256 of every line's bytes, its line feed included; text without it. A file is read by one task."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, content, at = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), 0
                rows: list[tuple] = []
                for n, line in enumerate(content.splitlines(keepends=True) if b"\r" not in content else _by_feed(content), 1):
                    rows.append((name, n, at, len(line), hashlib.sha256(line).hexdigest(), line.rstrip(b"\n").decode("utf-8", "replace")))
                    at += len(line)
                    if len(rows) == 10_000:
                        yield _lines(rows)
                        rows = []
                yield _lines(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, line long, offset long, length long, sha256 string, text string")


def _by_feed(content: bytes) -> list[bytes]:
    parts = content.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds, strict=True)], ["path", "line", "offset", "length", "sha256", "text"])


#: The keys under which membership documents list their ids, in order of preference.
MEMBER_KEYS = ("qids_int_sorted", "qids", "question_ids", "members", "membership", "questions", "items", "rows", "data")


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """qid, category of membership documents: a list of ids or of objects with one, such a list under one of MEMBER_KEYS, or lists by
    category. Repeated ids, no ids, and categories that list other ids than the list stop the query."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("doc"))
    lists = [F.try_variant_get("doc", "$", "array<variant>"), *(F.try_variant_get("doc", f"$.{k}", "array<variant>") for k in MEMBER_KEYS)]
    groups = F.try_variant_get("doc", "$.qids_by_category", "map<string, array<variant>>")
    told = text.select("path", F.coalesce(*lists).alias("listed"), groups.alias("groups"))
    one = lambda v: F.coalesce(*(F.try_variant_get(v, f"$.{k}", "long") for k in ("qid", "id", "question_id")), F.try_variant_get(v, "$", "long"))
    by_group = told.where("groups IS NOT NULL").select("path", F.explode("groups").alias("category", "ids")).select("path", F.explode("ids").alias("v"), "category").select("path", one(F.col("v")).alias("qid"), "category")
    plain = told.where("listed IS NOT NULL").select("path", F.explode("listed").alias("v")).select("path", one(F.col("v")).alias("qid"), F.lit(None).cast("string").alias("category"))
    both = plain.withColumn("l", F.lit(1)).withColumn("g", F.lit(0)).unionByName(by_group.withColumn("l", F.lit(0)).withColumn("g", F.lit(1)))
    forms = told.select("path", F.col("listed").isNotNull().alias("has_list"), F.col("groups").isNotNull().alias("has_groups"))
    each = both.groupBy("path", "qid").agg(F.max("category").alias("category"), F.sum("l").alias("l"), F.sum("g").alias("g")).join(forms, "path", "right")
    sound = F.col("qid").isNotNull() & (F.col("l") == F.col("has_list").cast("int")) & (F.col("g") == F.col("has_groups").cast("int"))
    wrong = F.raise_error(F.concat(F.lit("unsound membership: "), F.col("path"))).cast("long")
    return each.select("path", F.when(sound, F.col("qid")).otherwise(wrong).alias("qid"), "category")


def read_attempts(spark: SparkSession, root: str) -> DataFrame:
    """qid, budget, path, sha256 of the files root/<qid>/b<budget>/finalized/<qid>/trace_<qid>.json; other layouts are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.sha2("content", 256).alias("sha256"))
    pattern = r"/([^/]+)/b(\d+)/finalized/([^/]+)/trace_([^/]+)\.json$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    found = files.select(part(1).alias("qid"), part(2).try_cast("int").alias("budget"), "path", "sha256", part(3).alias("_a"), part(4).alias("_b"))
    return found.where("qid <> '' AND qid = _a AND qid = _b").drop("_a", "_b")


def read_arrays(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path, row, values: the rows of one array of every .npz file, as doubles."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    a = np.atleast_1d(held[name]).astype(np.float64)
                a = a.reshape(len(a), -1)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(a)), pa.array(np.arange(len(a))), pa.array(a.tolist(), pa.list_(pa.float64()))], ["path", "row", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row long, values array<double>")


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """path, face, corners (nine doubles) of the triangles of binary little-endian STL files: 80 bytes of header, a count, 50 bytes a face.
    A file whose size is not that of its count stops the query."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = struct.unpack_from("<I", content, 80)[0] if len(content) >= 84 else -1
                if len(content) != 84 + 50 * n:
                    raise ValueError(f"{p} is not a mesh of {n} faces")
                faces = np.frombuffer(content, np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("more", "<u2")]), n, 84)["corners"].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array(np.arange(n)), pa.array(faces.tolist(), pa.list_(pa.float64()))], ["path", "face", "corners"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, face long, corners array<double>")


def harvested_ids(text, pattern: str):
    """The distinct ids that a pattern finds anywhere in a text, JSON or not, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})")))


# ---- sinks


def write_shards(df: DataFrame, path: str, key: str, rows: int) -> DataFrame:
    """JSON lines in folders of `rows` rows each, in order of key; (shard, n, sha256 over the rows' digests) of each is returned."""
    ranked = select.ranked(df, [], [F.col(key)], "_rank")
    line = F.to_json(F.struct(*df.columns))
    told = ranked.select(F.expr(f"(_rank - 1) div {rows}").alias("shard"), F.col(key).alias("_key"), line.alias("value"))
    told.repartition("shard").sortWithinPartitions("shard", "_key").select("shard", "value").write.partitionBy("shard").mode("errorifexists").text(path)
    digests = F.transform(F.array_sort(F.collect_list(F.struct("_key", F.sha2("value", 256).alias("h")))), lambda x: x["h"])
    return told.groupBy("shard").agg(F.count("*").alias("n"), F.sha2(F.array_join(digests, ""), 256).alias("sha256"))  # a shard has a bounded number of rows


def merged_shards(parts: list[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """The union of parts that together have every key of whole once; anything else stops the query."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    count = union.groupBy(key).agg(F.count("*").alias("_n")).join(whole.select(key).distinct().withColumn("_w", F.lit(1)), key, "full")
    wrong = count.where("_n IS NULL OR _n > 1 OR _w IS NULL").select(F.col(key), F.raise_error(F.concat(F.lit("no exact cover at "), F.col(key).cast("string"))).cast("int").alias("_e"))
    return union.join(wrong, key, "full").where("_e IS NULL").drop("_e")


def packed(df: DataFrame, order: str, size: str, most_bytes: int, most_rows: int | None = None) -> DataFrame:
    """df with `archive`: rows in order fill archives up to most_bytes and most_rows; a row larger than that has one alone.

    Where an archive ends depends on all rows before it, but only through what the open archive holds, so rows are taken in ranges of the
    order: each range begins a new archive, and has at most 100,000 rows."""
    ranked = select.ranked(df, [], [F.col(order)], "_rank").withColumn("_range", F.expr("(_rank - 1) div 100000"))

    def fill(frame):
        frame = frame.sort_values("_rank")
        number, held, rows, out = 0, 0, 0, []
        for n in frame[size]:
            if rows and (held + n > most_bytes or (most_rows and rows >= most_rows)):
                number, held, rows = number + 1, 0, 0
            held, rows = held + n, rows + 1
            out.append(number)
        frame["archive"] = [f"{r:06d}-{a:06d}" for r, a in zip(frame["_range"], out, strict=True)]
        return frame.drop(columns=["_rank", "_range"])

    schema = T.StructType([*df.schema.fields, T.StructField("archive", T.StringType())])
    return ranked.groupBy("_range").applyInPandas(fill, schema)


def write_archives(df: DataFrame, archive: str, name: str, content: str) -> DataFrame:
    """archive, data, sha256, members (name, offset, length): one tar an archive, members in order of name, offsets of their bytes."""

    def build(key, frame):
        import pandas as pd

        out, members = io.BytesIO(), []
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            for r in frame.sort_values(name).itertuples(index=False):
                info = tarfile.TarInfo(getattr(r, name))
                info.size = len(getattr(r, content))
                tar.addfile(info, io.BytesIO(getattr(r, content)))
                members.append((info.name, tar.offset - info.size - (-info.size % 512), info.size))
        data = out.getvalue()
        return pd.DataFrame({"archive": [key[0]], "data": [data], "sha256": [hashlib.sha256(data).hexdigest()], "members": [members]})

    return df.select(archive, name, content).groupBy(archive).applyInPandas(build, "archive string, data binary, sha256 string, members array<struct<name: string, offset: long, length: long>>")


def manifest(tables: dict[str, DataFrame], config: str) -> DataFrame:
    """name, n, digest of every table, and the configuration's digest."""
    from grainmill.operators.reconcile import table_digest

    out = None
    for name, df in tables.items():
        row = table_digest(df).select(F.lit(name).alias("name"), "n", "digest", F.sha2(F.lit(config), 256).alias("config"))
        out = row if out is None else out.unionByName(row)
    return out


def targets(df: DataFrame, forms: dict[str, Callable]) -> DataFrame:
    """A row for every form of every row: form, and what its function makes of the row's columns."""
    return df.withColumn("_f", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), f().alias("target")) for k, f in forms.items())))).select("*", "_f.*").drop("_f")


def append_journal(events: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends events as JSON lines and never rewrites a file; every event is there once, as the sink keeps a log."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

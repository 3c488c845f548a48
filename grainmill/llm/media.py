"""Media columns with content-defined payload chunks.

A text becomes the payload of an 8-bit mono PCM file (a 44-byte RIFF header, then one sample a byte). A rolling gear hash cuts payloads
into chunks; chunk digests meet in Spark joins, so that every distinct chunk is stored once. A stored medium is its header, the ordered list
of its chunks' digests, and the bytes of those chunks that no other medium stores. Reading puts every medium together by its list, from its
own chunks and from those that others store, and checks every digest; only media that share chunks move between executors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import bounded, join_by_size, map_arrow, raw, release, stash

UNIT, RATE = 192, 8_000
SMALLEST, LARGEST, MASK_BITS = 512, 8_192, 11
GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)
RECIPE = "doc_id long, tag long, n_bytes long, recipe binary, payload_bytes long, chunks array<binary>"
STORED = "recipe binary, head binary, chunks array<binary>, data array<binary>"
READ = "recipe binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def header_of(n: int) -> bytes:
    """RIFF/WAVE header of n 8-bit mono samples; its sizes have 32 bits, which Spark's longest string does not reach."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] modulo 2^32, for all i at once by doubling the window to 32 bytes."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks; a cut falls where the top bits of the hash are zero, within the size limits."""
    if len(data) <= SMALLEST:
        return [len(data)]
    found = []
    for at in range(0, len(data), 1 << 20):  # blocks with the window before them
        low = max(0, at - 31)
        h = gear_hash(data[low : at + (1 << 20)])[at - low :]
        found.append(np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + at + 1)
    marks, out, last, k = np.concatenate(found), [], 0, 0
    while len(data) - last > SMALLEST:
        k = int(np.searchsorted(marks, last + SMALLEST))
        end = int(marks[k]) if k < len(marks) else len(data)
        last = min(end, last + LARGEST, len(data))
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def chunked(payload: bytes) -> list[bytes]:
    ends = cuts(np.frombuffer(payload, np.uint8))
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def recipe_of(head: bytes, digests: list[bytes]) -> bytes:
    return digest(b"".join([head, *digests]))


def feature_of(payload: bytes) -> str:
    """Length, mean, deviation, entropy and turns through the middle of the samples, as text."""
    data = np.frombuffer(payload, np.uint8)
    n, count = len(data), np.bincount(data, minlength=256)
    value = np.arange(256)
    mean = int((count * value).sum()) / n
    spread = (int((count * value * value).sum()) / n - mean * mean) ** 0.5
    p = count[count > 0] / n
    turns = int(np.count_nonzero(np.diff(data >= 128)))
    return f"ms={n * 1000 // RATE};mean={mean:.4f};dev={spread:.4f};entropy={-float((p * np.log2(p)).sum()):.4f};turns={turns};peak={int(data.max())}"


def rebuilt(recipe: bytes, head: bytes, order: list[bytes], held: dict[bytes, bytes]) -> tuple:
    """The columns of a medium, put together by its ordered list from the chunks held; raises where a digest does not hold."""
    for name in set(order):
        if digest(held[name]) != name:
            raise ValueError("a stored chunk does not match its digest")
    if recipe_of(head, order) != recipe:
        raise ValueError("header and list are not those of the recorded medium")
    payload = b"".join(held[name] for name in order)
    media = hashlib.sha256(head)
    media.update(payload)
    return recipe, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(head) + len(payload), media.hexdigest(), feature_of(payload)


def _described(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


def _payloads(column: pa.Array) -> Iterable[bytes]:
    data, bounds = raw(column)
    for i in range(len(column)):
        yield payload_of(data[bounds[i] : bounds[i + 1]].tobytes())


def _recipes(batches):
    for batch in batches:
        _, bounds = raw(batch.column(2))
        lists = []
        sizes = []
        for p in _payloads(batch.column(2)):
            sizes.append(len(p))
            lists.append([digest(c) for c in chunked(p)])
        recipes = [recipe_of(header_of(n), x) for n, x in zip(sizes, lists, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(recipes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.binary()))], [x.split()[0] for x in RECIPE.split(", ")])


def _store(batches):
    """Columns: text, write (false for copies), skip (places of chunks that another medium stores). A chunk that a medium has twice is
    stored at its first place."""
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    for batch in batches:
        rows, held = [], 0
        write, skip = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i, p in enumerate(_payloads(batch.column(0))):
            if write[i] is False:
                continue
            parts, head = chunked(p), header_of(len(p))
            names, seen, data = [digest(c) for c in parts], set(), []
            for k, name in enumerate(names):
                data.append(None if name in seen or k in (skip[i] or ()) else parts[k])
                seen.add(name)
            rows.append((recipe_of(head, names), head, names, data))
            held += len(p)
            if held > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], STORED_NAMES)
                rows, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds, strict=True)], STORED_NAMES)


STORED_NAMES = ["recipe", "head", "chunks", "data"]


def _read(batches):
    """Rows (recipe, head, chunks, data) and, where others store some chunks, more: a list of (key, data)."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            order = batch.column(2)[i].as_py()
            held = {k: d for k, d in zip(order, batch.column(3)[i].as_py(), strict=True) if d is not None}
            if batch.num_columns > 4:
                held |= {x["key"]: x["data"] for x in batch.column(4)[i].as_py()}
            rows.append(rebuilt(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), order, held))
        yield _described(rows)


def write_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recipes, store) of docs(doc_id, text), both written to the shared folder. recipes: a row for every row of docs; store: STORED."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    recipes = stash(map_arrow(rows, _recipes, RECIPE), "recipes")
    # one owner a recipe; of its chunks those that other recipes have too are stored by the smallest of these
    who = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tag"]
    owners = stash(recipes.groupBy("recipe").agg(F.min(F.struct(*who)).alias("owner"), F.count("*").alias("copies")).select("recipe", "owner.*", "copies"), "owners")
    told, key = recipes.select("recipe", *who, "chunks"), ["recipe", "no_id", "id", "tag"]
    owned = told.join(owners.drop("copies"), key, "left_semi")
    parts = stash(owned.dropDuplicates(["recipe"]).select("recipe", "no_id", "id", "tag", F.posexplode("chunks").alias("seq", "key")), "chunks")
    shared = parts.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("recipe", "seq")).alias("keeper")).where("n > 1")
    shared = stash(shared.select("key", "n", F.col("keeper.recipe").alias("in"), F.col("keeper.seq").alias("at")), "shared")
    elsewhere = F.when(F.col("in") != F.col("recipe"), F.col("seq"))
    mixed = join_by_size(parts, shared, ["key"], "n").groupBy("no_id", "id", "tag").agg(F.lit(True).alias("write"), F.collect_list(elsewhere).alias("skip"))
    copies = told.drop("chunks").join(owners.select(*key), key, "left_anti")
    copies = copies.select("no_id", "id", "tag", F.lit(False).alias("write"), F.array().cast("array<int>").alias("skip")).distinct()
    special = stash(mixed.unionByName(copies), "special")
    flagged = rows.select(*who, "text").join(bounded(special), ["no_id", "id", "tag"], "left")
    store = stash(map_arrow(flagged.select("text", "write", "skip"), _store, STORED), "store")
    release(docs.sparkSession, owners, parts, shared, special)
    return recipes, store


def read_media(store: DataFrame) -> DataFrame:
    """A row (READ) for every recipe, from the stored bytes alone."""
    own = F.transform(F.filter(F.arrays_zip("chunks", "data"), lambda x: x["data"].isNotNull()), lambda x: x["chunks"])
    missing = F.array_except("chunks", own)
    alone = map_arrow(store.where(F.size(missing) == 0).select(*STORED_NAMES), _read, READ)
    asked = stash(store.where(F.size(missing) > 0).dropDuplicates(["recipe"]).select("recipe", F.explode(missing).alias("key")), "asked")
    wanted = stash(asked.groupBy("key").agg(F.count("*").alias("n")), "wanted")
    pieces = store.select(F.explode(F.arrays_zip("chunks", "data")).alias("x")).select(F.col("x.chunks").alias("key"), F.col("x.data").alias("data")).where("data IS NOT NULL")
    given = stash(pieces.join(bounded(wanted), "key").dropDuplicates(["key"]), "given")
    more = join_by_size(asked, given, ["key"], "n").groupBy("recipe").agg(F.collect_list(F.struct("key", "data")).alias("more"))
    joined = store.where(F.size(missing) > 0).join(more, "recipe").select(*STORED_NAMES, "more")
    return alone.unionByName(map_arrow(joined, _read, READ)).dropDuplicates(["recipe"])


def media_columns(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes and what reading the stored media back gives; one row for every row.

    Null text is empty, an empty payload is 192 spaces; very long texts are stored and read whole. Rows with equal payloads share one stored
    medium, whatever their ids; null and repeated ids are kept. Other columns are not read or returned; an empty table gives no rows."""
    recipes, store = write_media(docs)
    copies = recipes.groupBy("recipe").agg(F.count("*").alias("copies"))
    found = stash(read_media(store).join(copies, "recipe"), "media")
    out = join_by_size(recipes.select("doc_id", "n_bytes", "recipe"), found, ["recipe"], "copies")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

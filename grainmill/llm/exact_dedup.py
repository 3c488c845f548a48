"""Exact dedup by a log-structured merge index of text digests.

Map side: every input partition fills a memtable and flushes it as a sorted run whenever it is full, so that a text repeated in a third of
all rows leaves one entry a run. Each digest shard then keeps its own index: memtables flushed as sorted runs with Bloom filters, levels
compacted when they hold `FANOUT` runs, entries of one digest folded to the smallest identifier. An arriving digest is a hit if the memtable
has it, or a run whose filter lets it through; no other run is read. Rows of digests that were hit have their bytes compared with those of
the row that stays; digests under which bytes differ are grouped again by the whole text.
"""

from __future__ import annotations

import heapq
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import bounded, join_by_size, map_arrow, stash, with_text

MEMTABLE_ROWS, FANOUT, BITS_PER_KEY, PROBES = 100_000, 8, 10, 4
RECORD = struct.Struct("<32s?qqq?")  # digest, id is null, identifier, rows, rows with that identifier, the digest was hit
ENTRY = "digest binary, no_id boolean, ident long, n long, n_ident long, hit boolean"


class Filter:
    """Bloom filter over digests, which are random already: each 8 bytes are one probe."""

    def __init__(self, digests: list[bytes]):
        self.size = max(64, len(digests) * BITS_PER_KEY)
        self.bits = np.zeros(self.size, bool)
        if digests:
            self.bits[np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, :PROBES] % np.uint64(self.size)] = True

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        """Flags of the digests, given as rows of four 64-bit numbers."""
        return self.bits[digests[:, :PROBES] % np.uint64(self.size)].all(1)


def merged(entries: Iterable[tuple]) -> Iterator[tuple]:
    """Entries sorted by digest, those of one digest folded: smallest identifier (ids before no ids), rows added up."""
    for digest, same in groupby(entries, itemgetter(0)):
        no_id, ident, n, k, hit, first = True, None, 0, 0, False, True
        for _, o, i, m, j, h in same:
            hit, first = hit or h or not first, False
            if ident is None or (o, i) < (no_id, ident):
                no_id, ident, k = o, i, j
            elif (o, i) == (no_id, ident):
                k += j
            n += m
        yield digest, no_id, ident, n, k, hit


class Run:
    """A sorted run in a file of fixed-size records."""

    def __init__(self, path: str, entries: Iterable[tuple]):
        self.path, digests = path, []
        with open(path, "wb") as f:
            for e in entries:
                f.write(RECORD.pack(*e))
                digests.append(e[0])
        self.n, self.filter = len(digests), Filter(digests)

    def __iter__(self) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            while part := f.read(RECORD.size * 4096):
                yield from RECORD.iter_unpack(part)

    def holds(self, digests: np.ndarray) -> np.ndarray:
        """Which digests the run has; only those that its filter lets through are looked up."""
        out = self.filter.may_hold(digests)
        if out.any():
            with open(self.path, "rb") as f:
                for i in np.flatnonzero(out):
                    out[i] = self._find(f, digests[i].tobytes())
        return out

    def _find(self, f, digest: bytes) -> bool:
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            f.seek(mid * RECORD.size)
            here = f.read(32)
            if here == digest:
                return True
            low, high = (mid + 1, high) if here < digest else (low, mid)
        return False


class LsmIndex:
    """One shard. Runs lie in a temporary folder of the task, which is done again from its input if its executor is lost."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        self.table: dict[bytes, tuple] = {}
        self.levels: list[list[Run]] = [[]]
        self.rows, self.fanout, self.made = memtable_rows, fanout, 0
        self.folder = tempfile.TemporaryDirectory(prefix="lsm-")

    def put(self, entries: list[tuple]) -> None:
        """Add a batch. Entries whose digest the index has already, in the memtable or in a run, are marked as hit."""
        if not entries:
            return
        digests = np.frombuffer(b"".join(e[0] for e in entries), "<u8").reshape(-1, 4)
        stored = np.zeros(len(entries), bool)
        for level in self.levels:
            for run in level:
                stored |= run.holds(digests)
        for e, s in zip(entries, stored, strict=True):
            old, new = self.table.get(e[0]), (*e[:5], e[5] or bool(s))
            self.table[e[0]] = new if old is None else next(merged([old, new]))
        if len(self.table) >= self.rows:
            self.flush()

    def _run(self, entries: Iterable[tuple]) -> Run:
        self.made += 1
        return Run(os.path.join(self.folder.name, f"{self.made}.run"), entries)

    def flush(self) -> None:
        if self.table:
            self.levels[0].append(self._run(sorted(self.table.values(), key=itemgetter(0))))
            self.table = {}
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                self.compact(k)

    def compact(self, k: int) -> None:
        runs, self.levels[k] = self.levels[k], []
        if k + 1 == len(self.levels):
            self.levels.append([])
        self.levels[k + 1].append(self._run(merged(heapq.merge(*runs, key=itemgetter(0)))))
        for r in runs:
            os.remove(r.path)

    def entries(self) -> Iterator[tuple]:
        """All entries, folded, by digest."""
        self.flush()
        yield from merged(heapq.merge(*(r for level in self.levels for r in level), key=itemgetter(0)))

    def close(self) -> None:
        self.folder.cleanup()


def _batches(entries: Iterable[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    names, kinds = ["digest", "no_id", "ident", "n", "n_ident", "hit"], [pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    for e in entries:
        part.append(e)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds, strict=True)], names)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds, strict=True)], names)


def _flush_runs(memtable_rows: int):
    def run(batches):
        table: dict[bytes, tuple] = {}
        for batch in batches:
            for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                old = table.get(e[0])
                table[e[0]] = e if old is None else next(merged([old, e]))
                if len(table) >= memtable_rows:
                    yield from _batches(sorted(table.values(), key=itemgetter(0)))
                    table = {}
        yield from _batches(sorted(table.values(), key=itemgetter(0)))

    return run


def _index_shard(memtable_rows: int, fanout: int):
    def run(batches):
        index = LsmIndex(memtable_rows, fanout)
        try:
            for batch in batches:
                index.put(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            yield from _batches(index.entries())
        finally:
            index.close()

    return run


def build_index(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT) -> DataFrame:
    """rows(digest, no_id, ident, n, n_ident, hit) -> one folded entry a digest, hit if it came more than once. An earlier index may be among the rows: indexes merge."""
    runs = map_arrow(rows, _flush_runs(memtable_rows), ENTRY)
    return map_arrow(runs.repartition("digest"), _index_shard(memtable_rows, fanout), ENTRY)


def exact_dedup(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT) -> DataFrame:
    """docs(doc_id, text, ...) with keep_id, group_size, kept and digest added; every row is returned and other columns stay as they are.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the smallest (or `largest`) doc_id stays; rows without
    doc_id stay only where no row of the group has one, keep_id then being null. Of rows that repeat both text and doc_id exactly one is
    kept. Very long texts are compared whole. Columns of the input that have the names of those added are replaced. An empty table gives an
    empty result. digest_bytes shortens the digest, for tests of collisions."""
    names = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "digest")]
    clash = {c: f"_in_{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}
    spark = docs.sparkSession
    # equal bytes have equal digests at any length; the record wants 32 bytes
    digest = F.rpad(F.substring(F.unhex(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)), 1, digest_bytes), 32, F.lit(b"\0"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(a) for c, a in clash.items())).withColumn("digest", digest)
    order = F.col("doc_id") if keep == "smallest" else F.bitwise_not("doc_id")
    entries = rows.select("digest", F.col("doc_id").isNull().alias("no_id"), F.coalesce(order, F.lit(0)).alias("ident"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("n_ident"), F.lit(False).alias("hit"))
    back = F.col("ident") if keep == "smallest" else F.bitwise_not("ident")
    index = stash(build_index(entries, memtable_rows, fanout).select("digest", F.when(~F.col("no_id"), back).alias("keep_id"), "n", "n_ident", "hit"), "digests")
    groups = stash(index.where("hit").drop("hit"), "groups")
    # hits: the bytes of each row of a group against those of the row that stays
    texts = with_text(rows.select("digest", "doc_id", "text"))
    members = texts.join(bounded(groups), "digest")
    stays = members.where("doc_id <=> keep_id").groupBy("digest", "n").agg(F.min("text").alias("stays"))
    differ = join_by_size(members.select("digest", "text"), stash(stays, "stays"), ["digest"], "n")
    differ = stash(differ.where("text <> stays").select("digest").distinct(), "collisions")
    mixed = not differ.isEmpty()
    out = join_by_size(rows, index.drop("hit"), ["digest"], "n", "left")
    if mixed:
        best = (F.min if keep == "smallest" else F.max)("doc_id")
        by_text = texts.join(differ, "digest").groupBy("digest", F.col("text").alias("_t")).agg(best.alias("_keep"), F.count("*").alias("_n"))
        by_text = by_text.withColumn("_k", F.lit(2).cast("long"))  # repeated ids among them are settled below
        out = out.withColumn("_t", F.coalesce("text", F.lit(""))).join(by_text, ["digest", "_t"], "left")
        hit = F.col("_n").isNotNull()
        out = out.withColumns({"keep_id": F.when(hit, F.col("_keep")).otherwise(F.col("keep_id")), "n": F.coalesce("_n", "n"), "n_ident": F.coalesce("_k", "n_ident")})
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    group = [F.col("digest"), F.coalesce("text", F.lit(""))] if mixed else [F.col("digest")]
    if mixed or not groups.where("n_ident > 1").isEmpty():  # the same id and text more than once: one row of them stays
        from pyspark.sql import Window

        twice = F.col("kept") & (F.col("n_ident") > 1)
        first = out.where(twice).withColumn("kept", F.row_number().over(Window.partitionBy(*group).orderBy(F.lit(1))) == 1)
        out = out.where(~twice).unionByName(first)
    return out.select("doc_id", "text", *(F.col(a).alias(c) for c, a in clash.items()), "keep_id", F.col("n").alias("group_size"), "kept", "digest")

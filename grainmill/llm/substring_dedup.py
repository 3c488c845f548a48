"""Suffix-array dedup of substrings over a whole corpus, sharded by content.

Every window of `length` bytes goes to the shard named by its smallest GRAM-byte hash, so equal windows meet wherever they are.
Consecutive windows with the same name form a segment (at most RUN windows). Segments are compared by digests of their bytes (64 and 32 bits,
besides the 48 of the name and the 32 of the hashes beside the gram): of
equal ones all but those of the smallest document are removed as a whole, most of them already in the task that reads them, so that a
passage that very many documents have leaves few rows. Segments that occur in one document only, which are nearly all, are dropped by one
window aggregate. A common window has the naming gram at one place, and half of its other bytes before or after it; segments of a group that
agree with no other one in these bytes (by 16-bit hashes, which only ever keep too many) are dropped too. What is left of groups that hold
different segments goes, one copy of each, through a Burrows-Wheeler transform (bwt.py) that finds their common windows. A group of more rows than HOT_ROWS is dealt out by the windows' own hashes. Only bytes of such segments and spans of
removed bytes are ever shuffled beside the texts, which are joined by document twice.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.bwt import shared_windows
from grainmill.llm.common import bounded, map_arrow, raw, release, stash
from grainmill.llm.wordhash import BASE, OTHER_VALUES, VALUES, mix, prefix, spans

LENGTH, GRAM, RUN, HOT_ROWS = 50, 16, 64, 50_000
BLOCK, SHARD_BYTES, TAGS = 1 << 15, 1 << 17, 1 << 23
PLACE = np.uint64(16)  # bits of a place in a block


def names(data: np.ndarray, length: int) -> np.ndarray:
    """For every window of `length` bytes the smallest hash of the grams in it (48 bits) and the first place that has it (16 bits)."""
    gram = min(GRAM, length)
    h, have = VALUES[data], 1
    while have < gram:  # hash of have + step bytes from two overlapping or touching ones
        step = min(have, gram - have)
        h = mix(h[: len(h) - step] * BASE + h[step:]) if step < have else h[: len(h) - step] * (BASE + np.uint64(2 * have)) + h[step:]
        have += step
    h = mix(h) >> PLACE << PLACE | np.arange(len(h), dtype=np.uint64)
    wide, have = length - gram + 1, 1
    while have < wide:
        step = min(have, wide - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return h


def _sides(h: np.ndarray, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """For the segments of the windows lo .. hi-1 two 16-bit hashes, of the bytes before and after the gram that names them, such that
    segments with a common window agree in one of them. 0 where no window has so many bytes there; both 0 where the windows of a segment have
    the gram at several places."""
    gram = min(GRAM, length)
    before = (length - gram + 1) // 2
    after = length - gram + 1 - before
    at = (h[lo] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    out = np.zeros((2, len(lo)), np.uint64)
    one = h[lo] == h[hi - 1]
    for side, ok, start, end in ((0, at - lo >= before, at - before, at), (1, hi - 1 > at - before, at + gram, at + gram + after)):
        ok = ok & one
        out[side, ok] = np.maximum(spans(sums, start[ok], end[ok]) >> np.uint64(48), 1)
    return out[0] << PLACE | out[1]


def segments(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(name, content hash, _sides and another content hash, position, bytes) of the segments of one text; each window belongs to one segment."""
    out = []
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        h = names(part, length)
        name = h >> PLACE
        turn = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1, [len(h)]])
        size = np.diff(turn)
        if size.max() > RUN:  # long runs of one name are cut; the windows stay the same
            n = -(-size // RUN)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            lo = np.repeat(turn[:-1], n) + k * RUN
            hi = np.minimum(lo + RUN, np.repeat(turn[1:], n))
        else:
            lo, hi = turn[:-1], turn[1:]
        end = hi + length - 1
        sums = prefix(part, VALUES)
        other = spans(prefix(part, OTHER_VALUES), lo, end) >> np.uint64(32) | _sides(h, sums, lo, hi, length) << np.uint64(32)
        out.append((name[lo].view(np.int64), spans(sums, lo, end).view(np.int64), other.view(np.int64), lo + at, end - lo))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _settled(h: np.ndarray, s: np.ndarray, s2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which segments equal one of a smaller document among these rows."""
    key = mix(s.view(np.uint64) ^ mix(h.view(np.uint64)))
    order = np.argsort(key)
    k = key[order]
    start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[order][1:] != s[order][:-1]) | (s2[order][1:] != s2[order][:-1]) | (h[order][1:] != h[order][:-1])]))
    least = np.repeat(np.minimum.reduceat(doc[order], start), np.diff(np.append(start, len(k))))
    out = np.empty(len(h), bool)
    out[order] = doc[order] > least
    return out


def _segment_rows(length: int):
    """(doc, tag, text) -> (h, s, s2, doc, at). at: tag, position and size; negative where the segment is settled, which then has a name of its own."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            data, bounds = raw(batch.column(2))
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part, held = [], 0
            for i in range(batch.num_rows):
                if bounds[i + 1] - bounds[i] >= length:
                    h, s, s2, pos, size = segments(data[bounds[i] : bounds[i + 1]], length)
                    part.append((h, s, s2, np.full(len(h), doc[i]), pos << 8 | size | int(tag[i]) << 40))
                    held += len(h)
                if part and (held > 200_000 or i == batch.num_rows - 1):
                    h, s, s2, d, at = (np.concatenate(x) for x in zip(*part, strict=True))
                    done = _settled(h, s, s2, d)
                    h = np.where(done, mix(d.view(np.uint64) * BASE + at.view(np.uint64)).view(np.int64), h)
                    at = np.where(done, at | np.int64(-1 << 63), at)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, s, s2, d, at)], ["h", "s", "s2", "doc", "at"])
                    part, held = [], 0

    return run


def _cut_segments(length: int):
    """(text, [(h, s, s2, doc, at, hot)]) -> rows of shard key, h, s, s2, offset of the piece in its segment, owner, bytes."""

    def run(batches):
        for batch in batches:
            data, bounds = raw(batch.column(0))
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                text = data[bounds[i] : bounds[i + 1]]
                for e in batch.column(1)[i].as_py():
                    pos, size = (e["at"] >> 8) & 0xFFFFFFFF, e["at"] & 0xFF
                    piece = text[pos : pos + size]
                    if e["hot"]:
                        k = np.arange(size - length + 1)
                        own = mix(spans(prefix(piece), k, k + length) ^ np.uint64(e["h"] & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
                        rows += [(int(g), e["h"], e["s"], e["s2"], int(o), e["doc"], piece[o : o + length].tobytes()) for o, g in zip(k, own, strict=True)]
                    else:
                        rows.append((e["h"], e["h"], e["s"], e["s2"], 0, e["doc"], piece.tobytes()))
                if len(rows) > 20_000:
                    yield _pieces(rows)
                    rows = []
            yield _pieces(rows)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], ["g", "h", "s", "s2", "o", "owner", "piece"])


def _find(length: int):
    """Rows sorted by shard key; whole groups are gathered up to SHARD_BYTES and searched together."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        found = shared_windows([r[6] for r in rows], np.array([r[5] for r in rows], np.int64), length)
        out = [(*rows[k][1:4], rows[k][4] + a, rows[k][4] + b - 1 + length) for k, a, b in found]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 5)], ["h", "s", "s2", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD_BYTES and r[0] != held[-1][0]:
                    yield search(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield search(held)

    return run


def _remove(batches):
    """text, spans -> kept bytes, removed bytes, maximal removed runs."""
    for batch in batches:
        data, bounds = raw(batch.column(1))
        doc, kept, removed, runs, size, held = batch.column(0), [], [], [], [], 0
        first = 0
        for i in range(batch.num_rows):
            text = data[bounds[i] : bounds[i + 1]]
            at = batch.column(2)[i].as_py()
            n = k = 0
            if at:
                gone = np.zeros(len(text) + 1, np.int32)
                lo, hi = np.array([x["lo"] for x in at]), np.array([x["hi"] for x in at])
                np.add.at(gone, lo, 1)
                np.add.at(gone, hi, -1)
                out = np.cumsum(gone[:-1]) > 0
                n, k = int(out.sum()), int(np.count_nonzero(np.diff(np.concatenate([[False], out]).astype(np.int8)) == 1))
                text = text[~out]
            kept.append(text.tobytes()), removed.append(n), runs.append(k), size.append(int(bounds[i + 1] - bounds[i]))
            held += len(text)
            if held > 1 << 23 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([doc.slice(first, len(kept)), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])
                first, kept, removed, runs, size, held = i + 1, [], [], [], [], 0


def removed_spans(keyed: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """keyed(doc_id, tag, text) -> (doc, tag, spans) of the documents that lose bytes; written to the shared folder."""
    spark = keyed.sparkSession
    rows = keyed.where("doc_id is not null")
    found = map_arrow(rows.select("doc_id", "tag", "text"), _segment_rows(length), "h long, s long, s2 long, doc long, at long")
    group, content = Window.partitionBy("h"), Window.partitionBy("h", "l", "s", "s2")
    apart = lambda k: (F.col(k) != 0) & (F.min("first").over(Window.partitionBy("h", k)) < F.max("first").over(Window.partitionBy("h", k)))
    met = (
        found.repartition("h").withColumns({"l": F.shiftrightunsigned("s2", 48), "r": F.shiftrightunsigned("s2", 32).bitwiseAND(0xFFFF)})
        .sortWithinPartitions("h", "l", "s", "s2")  # one sort for all windows but the last
        .withColumns({"least": F.min("doc").over(group), "most": F.max("doc").over(group), "mixed": F.min("s").over(group) < F.max("s").over(group), "hot": F.count("*").over(group) > hot_rows, "any": F.max((F.col("l") == 0) & (F.col("r") == 0)).over(group)})
        .where("least < most or at < 0")
        .withColumn("first", F.min("doc").over(content))
        .where("mixed or doc > first or at < 0")
        .withColumn("by_l", apart("l"))
        .withColumn("mixed", F.col("mixed") & (F.col("any") | F.col("by_l") | apart("r")))
        .where("mixed or doc > first or at < 0")
        .select("h", "s", "s2", "doc", "at", "first", "mixed", "hot")
    )
    met = stash(met, "segments")
    size, pos, tag = F.col("at").bitwiseAND(0xFF), F.shiftright("at", 8).bitwiseAND(0xFFFFFFFF), F.shiftright("at", 40).bitwiseAND(TAGS - 1)
    whole = met.where("doc > first or at < 0").select("doc", tag.alias("tag"), pos.alias("lo"), (pos + size).alias("hi"))
    reps = met.where("doc = first and mixed and at >= 0")
    one = reps.groupBy("h", "s", "s2").agg(F.min(F.struct("doc", "at", "hot")).alias("x")).select("h", "s", "s2", "x.doc", "x.at", "x.hot")
    # each of these steps is stored, so that its shuffle files go before the next one writes its own
    wanted = stash(one.withColumn("tag", tag).groupBy("doc", "tag").agg(F.collect_list(F.struct("h", "s", "s2", "doc", "at", "hot")).alias("cut")), "cuts")
    pieces = map_arrow(rows.join(wanted, (F.col("doc_id") == F.col("doc")) & (rows["tag"] == wanted["tag"])).select("text", "cut"), _cut_segments(length), "g long, h long, s long, s2 long, o int, owner long, piece binary")
    hits = stash(map_arrow(pieces.repartition("g").sortWithinPartitions("g"), _find(length), "h long, s long, s2 long, lo long, hi long"), "hits")
    part = reps.select("h", "s", "s2", "doc", tag.alias("tag"), pos.alias("pos")).join(hits, ["h", "s", "s2"]).select("doc", "tag", (F.col("pos") + F.col("lo")).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi"))
    out = stash(whole.unionByName(part).groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    release(spark, met, wanted, hits)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with doc_id as long, text as bytes (null: empty), and tag: a number for each text of an id that has several, 0 elsewhere."""
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("binary"), F.lit(b""))})
    texts = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.sha2("text", 256).alias("_sha"))
    several = texts.groupBy("_id").agg(F.min("_sha").alias("x"), F.max("_sha").alias("y")).where("x < y").select("_id")
    several = stash(several, "several")
    if several.isEmpty():
        return rows.withColumn("tag", F.lit(0).cast("long"))
    order = Window.partitionBy("_id").orderBy("_sha")
    told = stash(texts.join(bounded(several), "_id").distinct().withColumn("_tag", F.row_number().over(order).cast("long")), "tags")
    told = bounded(told)
    return rows.join(told, (F.col("doc_id") == F.col("_id")) & (F.sha2("text", 256) == F.col("_sha")), "left").withColumn("tag", F.coalesce("_tag", F.lit(0))).drop("_id", "_sha", "_tag")


def substring_dedup(docs: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs(doc_id, text) -> row (doc_id), n_bytes, n_removed, n_spans, kept: one row for every row.

    Removes each byte covered by a `length`-byte string that also starts in a document with a smaller doc_id; texts are UTF-8 bytes, null is
    empty. Rows with equal ids do not remove each other's bytes; rows without an id neither lose bytes nor cause losses. Texts shorter than
    `length` are kept whole. Other columns are not returned (see replace_text)."""
    keyed = _keyed(docs.select("doc_id", "text"))
    gone = removed_spans(keyed, length, hot_rows).select("doc", F.col("tag").alias("t"), "spans")
    joined = keyed.join(gone, (F.col("doc_id") == F.col("doc")) & (F.col("tag") == F.col("t")), "left")
    return map_arrow(joined.select("doc_id", "text", "spans"), _remove, "row long, n_bytes long, n_removed long, n_spans long, kept binary")


def replace_text(docs: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with the kept bytes as text, in the same columns: rows that lose nothing are as before, null texts too. Where a removal cuts a
    character of several bytes in two, its remaining bytes go as well. n_chars, if there is one, is the new text's length. Columns may have
    any names."""
    names = docs.columns
    inner = {c: f"in_{i}" for i, c in enumerate(names)}  # names that clash with none used here
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(k) for c, k in inner.items())).alias("row"), "doc_id", "text")
    keyed = _keyed(rows)
    gone = removed_spans(keyed.select("doc_id", "tag", "text"), length, hot_rows).select("doc", F.col("tag").alias("t"), "spans")
    joined = keyed.join(gone, (F.col("doc_id") == F.col("doc")) & (F.col("tag") == F.col("t")), "left")
    at = names.index("text")

    def cut(batches):
        for batch in batches:
            spans_of, column = batch.column(batch.num_columns - 1), batch.column(at)
            out, sizes = [], []
            for i in range(batch.num_rows):
                x = spans_of[i].as_py()
                if not x:
                    out.append(column[i].as_py())
                    sizes.append(None)
                    continue
                part = pa.RecordBatch.from_arrays([pa.array([0]), column.slice(i, 1).cast(pa.binary()), spans_of.slice(i, 1)], ["row", "text", "spans"])
                out.append(next(_remove([part])).column(4)[0].as_py().decode("utf-8", "ignore"))
                sizes.append(len(out[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 : -1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "n_left"])

    flat = joined.select("row.*", "spans")
    done = map_arrow(flat, cut, ", ".join(f"{inner[f.name]} {f.dataType.simpleString()}" for f in docs.schema) + ", n_left long")
    size = lambda c: F.coalesce(F.col("n_left").cast(docs.schema[c].dataType), F.col(inner[c]))
    return done.select(*((size(c) if c == "n_chars" else F.col(k)).alias(c) for c, k in inner.items()))

"""Similarity join of documents on word n-grams by rare-first prefix filtering.

Every document's n-grams are put in one global order, rare ones first (by counts of n-gram buckets over all documents, a table of fixed
size). Documents that reach the threshold share an n-gram of their prefixes, so prefixes are joined. Where two prefixes first meet, a pair
passes a length, a positional and a suffix filter: what follows in either set is counted by ranges of the n-gram hash, and the
differences of these counts are the fewest elements by which the suffixes can differ. Surviving pairs are verified on whole sets, each once.

Groups of copies never give all their pairs. Documents with the same set are one node. First every node is looked at in its longest list
only, and of the pairs of a block of CELL members those of a spanning forest, nearest first, are verified; blocks of longer lists are
dealt anew for a second time. After that only lists whose members are not all connected are looked at, and in them pairs of different
components: first those of one spanning forest of the components, then of eight, then all. A list is done with when it is connected or
each of its pairs has been verified, so no connection is lost: two documents that link are in one list, and are either connected or paired
there. Lists of one component are looked at together, so that a pair is named once and not by every list it is in.

Links lie within components, so they are counted there: each pair of different sets of a component is compared on whole sets,
components of more than LINK_CELL sets as pairs of blocks. Copies count by the size of their class and are not paired.

Hashes of n-grams have 128 bits wherever sets are compared: 64 order them, 64 more have to agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import bounded, components, join_by_size, map_arrow, raw, release, stash, with_text
from grainmill.llm.wordhash import LOWER, OTHER_VALUES, VALUES, mix, word_values, words

WORDS, PERCENT, BUCKET_BITS, RANGES, CELL, ROUNDS, LINK_CELL, FAN = 4, 85, 18, 64, 2_000, 2, 1_000, 64
#: Lists of up to so many members are looked at together with others of their component.
SHORT = 200
#: How many spanning forests the rounds across components verify; a last round verifies what is left.
FORESTS = (1, 8)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
PLACES = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xDB4F0B9175AE2165, 0xBBE0563303A4615F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
BLOCK = 1 << 18


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every word, A-Z as a-z; long texts in blocks cut between words."""
    out, at = [(np.zeros(0, np.uint64),) * 2], 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            gap = np.flatnonzero(~IS_WORD[data[at:end]])
            while not len(gap) and end < len(data):  # a word longer than a block
                end += BLOCK
                gap = np.flatnonzero(~IS_WORD[data[at:end]])
            end = at + int(gap[-1]) + 1 if len(gap) else len(data)
        part = LOWER[data[at:end]]
        bounds = words(part, IS_WORD)
        out.append((word_values(part, *bounds, VALUES), word_values(part, *bounds, OTHER_VALUES)))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gram_set(data: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as (sorted hashes, their second hashes); of fewer words the whole sequence as one."""
    both = word_hashes(data)
    k = min(n, len(both[0]))
    if not k:
        return both
    out = []
    for w in both:
        total = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            total += w[i : len(w) - k + 1 + i] * PLACES[i]
        out.append(mix(total))
    first, at = np.unique(out[0], return_index=True)
    return first, out[1][at]


def signature(s: tuple[np.ndarray, np.ndarray]) -> bytes:
    return hashlib.blake2b(s[0].tobytes() + s[1].tobytes(), digest_size=16).digest()


def shared(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two n-gram sets."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    return int(np.count_nonzero(x[1][i] == y[1][j]))


def least_shared(a: int, b: int, percent: int) -> int:
    """Smallest intersection with which sets of a and b elements reach the threshold: 100 x >= percent (a + b - x)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _rows(column: pa.Array) -> Iterable[np.ndarray]:
    data, bounds = raw(column)
    for i in range(len(column)):
        yield data[bounds[i] : bounds[i + 1]]


def _count_buckets(n: int):
    def run(batches):
        count = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for text in _rows(batch.column(0)):
                np.add.at(count, (gram_set(text, n)[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], ["bucket", "n"])

    return run


def by_range(s: np.ndarray) -> np.ndarray:
    """How many elements fall in each of the RANGES ranges of the hash."""
    return np.bincount((s & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES)


def _prefixes(n: int, percent: int, order):
    def run(batches):
        count = order.value
        for batch in batches:
            size, sig, heads, parts = [], [], [], []
            for text in _rows(batch.column(1)):
                both = gram_set(text, n)
                s = both[0]
                size.append(len(s))
                sig.append(signature(both))
                head = s[np.lexsort((s, count[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))][: prefix_length(len(s), percent)] if len(s) else s
                heads.append(head.view(np.int64))
                parts.append(by_range(s).astype(np.uint16).tobytes() if len(s) < 1 << 16 else np.minimum(by_range(s), 65535).astype(np.uint16).tobytes())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int32()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64))), pa.array(parts, pa.binary())],
                ["doc_id", "n", "sig", "head", "parts"],
            )

    return run


def _suffixes(batches):
    """(h, size, rep, n, pos, head, parts) -> the same with `suffix`: elements after pos by range, at most 255 each, in place of head and parts."""
    for batch in batches:
        pos, heads = batch.column(4).to_numpy().astype(np.int64), batch.column(5)
        data, bounds = raw(batch.column(6))
        total = data[bounds[0] : bounds[-1]].view(np.uint16).reshape(batch.num_rows, RANGES).astype(np.int64)
        # the n-grams up to pos of every row, end to end
        row = np.repeat(np.arange(batch.num_rows), pos + 1)
        at = np.arange(len(row)) - np.repeat(np.cumsum(pos + 1) - pos - 1, pos + 1) + np.repeat(heads.offsets.to_numpy()[:-1].astype(np.int64), pos + 1)
        place = heads.values.to_numpy()[at].view(np.uint64) & np.uint64(RANGES - 1)
        before = np.bincount(row * RANGES + place.astype(np.int64), minlength=batch.num_rows * RANGES).reshape(-1, RANGES)
        suffix = np.clip(total - before, 0, 255).astype(np.uint8).tobytes()
        out = [suffix[i : i + RANGES] for i in range(0, len(suffix), RANGES)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], ["h", "size", "rep", "n", "pos", "suffix"])


def _verify(n: int, percent: int):
    """Rows (a, salt, b, text) sorted by a and salt, rows of a itself (b null) first: the pairs that reach the threshold. An id may have
    several texts; each is compared."""

    def run(batches):
        last, kept = None, []
        for batch in batches:
            a, salt, b, good = (*(batch.column(i).to_pylist() for i in range(3)), [])
            for i, text in enumerate(_rows(batch.column(3))):
                if (a[i], salt[i]) != last:
                    last, kept = (a[i], salt[i]), []
                s = gram_set(text, n)
                if b[i] is None:
                    kept.append(s)
                    continue
                for k in kept:
                    if len(k[0]) and len(s[0]) and 100 * (both := shared(k, s)) >= percent * (len(k[0]) + len(s[0]) - both):
                        good.append(i)
                        break
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    return run


def forest(u: np.ndarray, v: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Indices of the edges (u, v) of a minimum spanning forest by Boruvka's steps; edges of equal length count in their order."""
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, n = place[: len(u)], place[len(u) :], np.arange(len(names))
    label, live, chosen = n, np.arange(len(u)), [np.zeros(0, np.int64)]
    while True:
        a, b = label[u[live]], label[v[live]]
        between = a != b
        live, a, b = live[between], a[between], b[between]
        if not len(live):
            return np.unique(np.concatenate(chosen))
        here, to, edge = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([live, live])
        order = np.lexsort((edge, far[edge], here))
        best = order[np.concatenate([[True], here[order][1:] != here[order][:-1]])]
        chosen.append(edge[best])
        up = n.copy()
        up[here[best]] = to[best]
        up = np.where((up[up] == n) & (n < up), n, up)  # of two that chose each other the smaller one is the root
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _pairs(percent: int, forests: int | None, one_list: bool):
    """Rows (h, cell, side, rep, n, pos, label, suffix), each cell of a list in one run -> (a, b, None): pairs of different labels that pass
    all filters; if forests is not None, only those of so many spanning forests of the labels, nearest first, over the cells looked at
    together. Lists with a pair that was left out follow as (None, None, h). one_list: rows are there in one of their lists only."""

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        h, cell, side, rep, n, pos, label, suffix = cols
        out: list[tuple[np.ndarray, ...]] = []
        live = np.arange(len(h) - 1)
        for d in range(1, len(h)):
            live = live[live + d < len(h)]
            live = live[(h[live] == h[live + d]) & (cell[live] == cell[live + d])]
            if not len(live):
                break
            x, y = live, live + d
            ok = (label[x] != label[y]) & ((side[x] != side[y]) | (side[x] < 0))
            x, y = x[ok], y[ok]
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            # of all lists: as if the pair met here first; if it met before, it passes in that list. Of one list: it may have met before
            met = np.minimum(pos[x], pos[y]) if one_list else 0
            ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (met + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1 >= need)
            x, y, need = x[ok], y[ok], need[ok]
            apart = np.abs(pos[x] - pos[y]) if one_list else pos[x] + pos[y]
            apart = apart + np.abs(suffix[x] - suffix[y]).sum(1, dtype=np.int64)
            ok = apart <= n[x] + n[y] - 2 * need
            if ok.any():
                out.append((x[ok], y[ok], apart[ok]))
        if not out:
            return pa.RecordBatch.from_arrays([pa.nulls(0, pa.int64())] * 3, ["a", "b", "h"])
        x, y, apart = (np.concatenate(c) for c in zip(*out, strict=True))
        pairs, at, of = np.unique(np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])]), axis=1, return_index=True, return_inverse=True)
        kept = np.full(len(at), forests is None)
        if forests:
            far = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(far, of.ravel(), apart)
            for _ in range(forests):
                rest = np.flatnonzero(~kept)
                if not len(rest):
                    break
                kept[rest[forest(label[x[at[rest]]], label[y[at[rest]]], far[rest])]] = True
        left = np.unique(h[x[~kept[of.ravel()]]])
        a, b = pairs[:, kept]
        none = lambda k: pa.nulls(k, pa.int64())
        columns = [pa.chunked_array([pa.array(a), none(len(left))]), pa.chunked_array([pa.array(b), none(len(left))]), pa.chunked_array([none(len(a)), pa.array(left)])]
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], ["a", "b", "h"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            data, bounds = raw(batch.column(7))
            cols = [batch.column(i).to_numpy() for i in range(7)]
            cols.append(data[bounds[0] : bounds[-1]].reshape(batch.num_rows, -1).astype(np.int16))
            held.append(cols)
            size += batch.num_rows
            if size > 4 * CELL:  # all but the last list, which the next batch may go on with
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
                cut = int(np.flatnonzero(last)[0])
                if cut:
                    yield found([c[:cut] for c in cols])
                held, size = [[c[cut:] for c in cols]], len(last) - cut
        if size:
            yield found([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def verified(docs: DataFrame, pairs: DataFrame, tried: DataFrame | None, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(those of pairs(a, b) that link, all pairs looked at so far); pairs that were tried before are not tried again.

    A pair carries the text of b; that of a goes once to each of the at most FAN groups that its pairs are dealt into."""
    new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if tried is not None:
        new = new.join(tried, ["a", "b"], "left_anti")
    new = stash(new, "candidates")
    told = new.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(FAN)).cast("int"))
    ends = told.select(F.col("a").alias("rep"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct().union(told.select(F.col("b").alias("rep"), "a", "salt", "b"))
    asked = stash(ends.select("rep").distinct(), "asked")
    texts = with_text(docs.select(F.col("doc_id").cast("long").alias("rep"), "text")).join(bounded(asked), "rep", "left_semi")
    rows = ends.join(texts, "rep").select("a", "salt", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    out = stash(map_arrow(rows, _verify(n, percent), "a long, b long").distinct(), "links")
    release(docs.sparkSession, asked)
    return out, (new if tried is None else tried.union(new))


def _links(n: int, percent: int, counted: bool):
    """Rows (root, cell, side, sig, copies, text) sorted by root and cell -> pairs (a, b) of signatures whose sets link; if counted,
    (sig, linked): how many rows have the sets that link with this one in the cell. Texts of other sets, as ids may repeat, are left out."""

    def found(members: dict[bytes, tuple]) -> pa.RecordBatch:
        sig = sorted(members, key=lambda k: (len(members[k][2][0]), k))
        side, copies = (np.array([members[k][i] for k in sig], np.int64) for i in (0, 1))
        size = np.array([len(members[k][2][0]) for k in sig], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        one, other = (np.concatenate([members[k][2][i] for k in sig]) for i in (0, 1))
        known, first, ids = np.unique(one, return_index=True, return_inverse=True)
        if (other != other[first][ids]).any():  # equal first hashes of different n-grams
            known, ids = np.unique(np.stack([one, other]), axis=1, return_inverse=True)
            known, ids = known[0], ids.ravel()
        mine, linked, out = np.zeros(len(known), np.uint8), np.zeros(len(sig), np.int64), []
        for i in range(len(sig) - 1):
            end = int(np.searchsorted(percent * size, 100 * size[i], side="right"))  # larger ones cannot link
            if end <= i + 1:
                continue
            mine[ids[at[i] : at[i + 1]]] = 1
            both = np.add.reduceat(mine[ids[at[i + 1] : at[end]]], at[i + 1 : end] - at[i + 1], dtype=np.int64)
            mine[ids[at[i] : at[i + 1]]] = 0
            ok = (100 * both >= percent * (size[i] + size[i + 1 : end] - both)) & ((side[i + 1 : end] != side[i]) | (side[i] < 0))
            near = i + 1 + np.flatnonzero(ok)
            linked[i] += copies[near].sum()
            linked[near] += copies[i]
            if not counted:
                out += [(sig[i], sig[j]) for j in near]
        if counted:
            return pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(linked)], ["sig", "linked"])
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        last, members = None, {}
        for batch in batches:
            root, cell, side, sig, copies = (batch.column(i).to_pylist() for i in range(5))
            for i, text in enumerate(_rows(batch.column(5))):
                if (root[i], cell[i]) != last:
                    if len(members) > 1:
                        yield found(members)
                    last, members = (root[i], cell[i]), {}
                if sig[i] not in members:
                    s = gram_set(text, n)
                    if signature(s) == sig[i]:
                        members[sig[i]] = (side[i], copies[i], s)
        if len(members) > 1:
            yield found(members)

    return run


def _in_cells(df: DataFrame, most: int, key: str, *columns: str) -> DataFrame:
    """df(size, key, columns) -> columns, cell, side. A group of up to `most` members is one cell; of more, every pair of blocks is one,
    block pairs (i, i) compared within."""
    blocks = F.ceil(F.col("size") / most).cast("int")
    df = df.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64(key), blocks).cast("int")})
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct((F.least(k, F.col("own")) * 65536 + F.greatest(k, F.col("own"))).alias("cell"), F.when(k == F.col("own"), -1).otherwise(F.col("own")).alias("side")))
    return df.select(*columns, F.explode(cells).alias("c")).select(*columns, "c.cell", "c.side")


def _across(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """labelled(size, place, columns) -> columns, cell, side, place. A list of up to CELL members is one cell. In a larger one the members of its
    most frequent label are dealt into blocks, and those of other labels meet every block, and each other in pairs of blocks; each of these
    cells is a place of its own."""
    small = labelled.where(F.col("size") <= CELL).select(*columns, F.lit(0).cast("long").alias("cell"), F.lit(-1).alias("side"), "place")
    large = labelled.where(F.col("size") > CELL)
    if large.isEmpty():
        return small
    each = large.groupBy("h", "label").agg(F.count("*").alias("m"))
    top = stash(each.groupBy("h").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.max("m").alias("m"), F.sum("m").alias("all")), "top")
    large = large.drop("size", "place").join(bounded(top), "h").withColumn("blocks", F.ceil(F.col("m") / CELL))
    first = F.col("label") == F.col("top")
    of_top = large.where(first).select(*columns, F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("cell"), F.lit(0).alias("side"))
    others = large.where(~first).withColumn("size", F.col("all") - F.col("m"))
    beside = others.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("cell"), F.lit(1).alias("side"))
    among = _in_cells(others, CELL, "rep", *columns).select(*columns, (-1 - F.col("cell").cast("long")).alias("cell"), F.col("side").cast("int").alias("side"))
    return small.unionByName(of_top.unionByName(beside).unionByName(among).withColumn("place", F.xxhash64("h", "cell")))


def _open_lists(told: DataFrame) -> DataFrame:
    """Of told(h, label, ...) the lists with several labels, with `place`: lists of up to SHORT members that share their smallest label are
    looked at together, those of a label with more than CELL rows in places of about as many; a longer list has a place of its own."""
    several = stash(told.groupBy("h").agg(F.min("label").alias("g"), F.max("label").alias("y"), F.count("*").alias("m")).where("g < y").select("h", "g", "m"), "open")
    short = F.col("m") <= SHORT
    wide = stash(several.where(short).groupBy("g").agg(F.ceil(F.sum("m") / CELL).alias("parts")).where("parts > 1"), "wide")
    part = F.pmod(F.xxhash64("h"), F.coalesce("parts", F.lit(1)))
    placed = several.join(bounded(wide), "g", "left").select("h", F.when(short, F.xxhash64("g", part)).otherwise(F.xxhash64("h")).alias("place"))
    out = stash(told.join(bounded(placed, several), "h"), "open-lists")
    release(told.sparkSession, several, wide)
    return out


def _join(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sets(doc_id, n, sig), nodes(sig, rep, copies) and components(node, root) of their representatives."""
    spark = docs.sparkSession
    rows = with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counted = map_arrow(rows.select("text"), _count_buckets(n), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 2**BUCKET_BITS rows at most
    count = np.zeros(1 << BUCKET_BITS, np.int64)
    count[counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    order = spark.sparkContext.broadcast(count)
    whole = stash(map_arrow(rows, _prefixes(n, percent, order), "doc_id long, n int, sig binary, head array<long>, parts binary"), "sets")
    classes = whole.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("n", "head", "parts"), "doc_id").alias("x"))
    nodes = stash(classes.select("sig", "rep", "copies", "x.n", "x.head", "x.parts"), "nodes")
    sets = stash(whole.select("doc_id", "n", "sig"), "sets")  # heads and parts are on disk once, and only until the lists are made
    release(spark, whole)

    # lists of an n-gram with several members; those of more than CELL are few and are gathered without a shuffle by the n-gram
    heads = nodes.select("sig", F.posexplode("head").alias("pos", "h"))  # this is the largest shuffle: rep and n come with the join below
    met = stash(heads.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "met")
    entries = stash(join_by_size(heads, met, ["h"], "size", hot_rows=CELL), "entries")
    lists = entries.join(nodes.select("sig", "rep", "n", "head", "parts"), "sig").select("h", "size", "rep", "n", "pos", "head", "parts")
    lists = stash(map_arrow(lists, _suffixes, "h long, size long, rep long, n int, pos int, suffix binary"), "lists")
    named = stash(nodes.select("sig", "rep", "copies"), "nodes")
    release(spark, met, entries, nodes)
    nodes = named

    columns = ["h", "rep", "n", "pos", "label", "suffix"]

    def looked_at(placed: DataFrame, forests: int | None, one_list: bool) -> DataFrame:
        placed = placed.select("h", "cell", "side", "rep", "n", "pos", "label", "suffix", "place").repartition("place").sortWithinPartitions("place", "h", "cell", "n", "rep")
        return stash(map_arrow(placed.drop("place"), _pairs(percent, forests, one_list), "a long, b long, h long"), "pairs")

    def in_blocks(labelled: DataFrame, k: int) -> DataFrame:  # by another hash every round, compared within
        block = F.pmod(F.xxhash64("rep", F.lit(k)), F.ceil(F.col("size") / CELL)).cast("long")
        return labelled.withColumns({"cell": block, "side": F.lit(-1)}).withColumn("place", F.xxhash64("h", "cell"))

    longest = lists.groupBy("rep").agg(F.max(F.struct("size", "h", "n", "pos", "suffix")).alias("x")).select("rep", "x.*")
    seen = looked_at(in_blocks(longest.withColumn("label", F.col("rep")), 0), 1, True)
    links, tried = verified(docs, seen.where("a is not null"), None, n, percent)
    k, turns = 1, list(FORESTS) + [None]
    while True:
        joined = components(links)
        told = lists.join(bounded(joined.select(F.col("node").alias("rep"), "root"), joined), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")
        open_lists = _open_lists(told)
        blocks = k < ROUNDS and not open_lists.where(F.col("size") > CELL).isEmpty()
        k += 1
        forests = 1 if blocks else turns.pop(0)
        seen = looked_at(in_blocks(open_lists, k - 1) if blocks else _across(open_lists, columns), forests, False)
        release(spark, open_lists)
        new, tried = verified(docs, seen.where("a is not null"), tried, n, percent)
        links = stash(links.union(new).distinct(), "links")
        if blocks:  # members of different blocks have not met
            continue
        left = stash(seen.where("h is not null").select("h").distinct(), "left")
        if forests is None or left.isEmpty():
            break
        fewer = stash(lists.join(bounded(left), "h", "left_semi"), "lists")
        release(spark, lists)
        lists = fewer
    same_id = nodes.select("sig", "rep")  # rows of one id with several sets are tied below
    ties = sets.where("n > 0 and doc_id is not null").join(same_id, "sig").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    twice = sets.where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("sig").alias("k")).where("k > 1").select(F.col("doc_id").alias("a"))
    every = links.union(ties.join(twice, "a").distinct())
    release(spark, lists)
    return sets, nodes, components(every)


def _labelled(sets: DataFrame, nodes: DataFrame, final: DataFrame, *more: str) -> DataFrame:
    """A row for every row of sets; nodes(sig, rep, copies, more)."""
    rooted = nodes.select("sig", "rep", "copies", *more).join(bounded(final.select(F.col("node").alias("rep"), "root"), final), "rep", "left")
    rooted = stash(rooted.select("sig", F.coalesce("root", "rep").alias("root"), "copies", *more), "rooted")
    out = join_by_size(sets.select("sig", "doc_id", "n"), rooted, ["sig"], "copies", "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), root.alias("component_id"), *more)


def _linked_sets(docs: DataFrame, nodes: DataFrame, final: DataFrame, n: int, percent: int, counted: bool) -> DataFrame:
    """What _links finds in the components of several sets; written to the shared folder."""
    spark = docs.sparkSession
    members = nodes.select("sig", "rep", "copies").join(bounded(final.select(F.col("node").alias("rep"), "root"), final), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sizes = stash(members.groupBy("root").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    asked = stash(members.join(bounded(sizes), "root"), "asked")
    texts = stash(with_text(docs.select(F.col("doc_id").cast("long").alias("rep"), "text")).join(bounded(asked), "rep"), "texts")
    release(spark, sizes, asked)
    placed = _in_cells(texts, LINK_CELL, "sig", "root", "sig", "copies", "text").select("root", "cell", "side", "sig", "copies", "text")
    placed = placed.repartition("root", "cell").sortWithinPartitions("root", "cell")
    out = stash(map_arrow(placed, _links(n, percent, counted), "sig binary, linked long" if counted else "a binary, b binary"), "set-links")
    release(spark, texts)
    return out


def near_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: one row for every row.

    Sets are the distinct n-word shingles of the words between ASCII white space, A-Z lower-cased; fewer words give one shingle, none an
    empty set, which links with nothing. Two documents link when 100 * intersection >= percent * union; component_id is the smallest doc_id
    that links reach. Rows that share a doc_id are one document and linked; rows without doc_id link with nothing and have a null
    component_id. Other columns are not returned."""
    return _labelled(*_join(docs, n, percent))


def near_links(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> a, b: a row for every two different sets that link, as in near_components, each set named by the smallest
    doc_id that has it; a <= b, equal only where one doc_id has both."""
    _, nodes, final = _join(docs, n, percent)
    links = _linked_sets(docs, nodes, final, n, percent, counted=False)
    reps = lambda k: nodes.select(F.col("sig").alias(k), F.col("rep").alias(f"rep_{k}"))
    named = links.join(reps("a"), "a").join(reps("b"), "b")
    return named.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def near_join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """near_components with n_links: how many other rows, copies included, have sets that link with the row's; 0 for rows without doc_id,
    which are not counted either."""
    sets, nodes, final = _join(docs, n, percent)
    linked = _linked_sets(docs, nodes, final, n, percent, counted=True).groupBy("sig").agg(F.sum("linked").alias("linked"))
    counted = nodes.select("sig", "rep", "copies").join(linked, "sig", "left")
    counted = counted.withColumn("n_links", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).cast("long"))
    out = _labelled(sets, counted, final, "n_links")
    return out.withColumn("n_links", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long"))

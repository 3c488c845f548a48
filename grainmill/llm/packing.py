"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Variables are patterns (multisets of lengths that fit a sequence); multiplicative weights on the lengths price them, a knapsack dynamic
program finds the dearest pattern of each round. The fractional solution is scaled and rounded down; what it leaves is packed from the
histogram too, longest length first, each gap filled by the longest length that fits. Only the histogram (at most `capacity` counts) and
the list of patterns (at most ROUNDS + capacity) reach the driver; pieces get their places by rank within their length.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import blocks, bounded, map_arrow, raw, stash, with_text
from grainmill.llm.tokens import text_encoder, texts_of

CAPACITY, END_ID, ROUNDS, RATE, STEP = 1024, 2, 300, 2.0, 0.5


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the pattern by which the tokenizers library's ByteLevel splits texts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself if it prints, else the next one from U+0100 on."""
    from tokenizers import pre_tokenizers

    prints = sorted(ord(c) for c in pre_tokenizers.ByteLevel.alphabet() if ord(c) < 256)
    moved = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(moved)}


def _ranks(model: dict, special: set[str]) -> dict[bytes, int]:
    byte = _byte_of()
    return {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in special}


@lru_cache(maxsize=2)
def merges_are_ranks(path: str) -> bool:
    """Whether merging by ranks, as tiktoken does, gives the ids of the file's BPE model for every text that both split alike.

    So it is if ids rise in the order of the merges and every merged token, put together from bytes by the lower ranks alone, comes down to
    the two parts that its merge names: then no other two neighbours can ever make that token. Looked at once, for the whole vocabulary."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    same_split = (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
    special = {t["content"] for t in file.get("added_tokens", [])}
    if not (plain and same_split and file.get("normalizer") is None and all(t["special"] for t in file.get("added_tokens", []))):
        return False
    byte, ranks = _byte_of(), _ranks(model, special)
    pairs = [tuple(bytes(byte[c] for c in w) for w in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    ids = [ranks.get(x + y, -1) for x, y in pairs]
    letters = {ranks.get(bytes([b]), -1) for b in range(256)}
    if -1 in ids or -1 in letters or ids != sorted(set(ids)) or max(letters) > min(ids, default=256) or len(ranks) != 256 + len(ids):
        return False
    for (x, y), rank in zip(pairs, ids, strict=True):
        parts = [bytes([b]) for b in x + y]
        while len(parts) > 2:
            low, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if low >= rank:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if tuple(parts) != (x, y):
            return False
    return True


@lru_cache(maxsize=1)
def _unsettled() -> np.ndarray:
    """Flags of the characters that libraries of different Unicode versions may count as letters, numbers or white space differently: those
    that came to or left these classes since version 3.2, and those not assigned yet."""
    old, out = unicodedata.ucd_3_2_0.category, np.zeros(0x110000, bool)
    for c in range(0x110000):
        now, then = unicodedata.category(chr(c)), old(chr(c))[0]
        out[c] = now == "Cn" or (now[0] in "LN" and now[0] != then) or (now[0] not in "LN" and then in "LN")
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, 0x200B]] = True
    return out


def _has_unsettled(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in "\x1c\x1d\x1e\x1f")
    return bool(_unsettled()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())


@lru_cache(maxsize=2)
def vocabulary(path: str, quick: bool):
    """Encoder of lists of texts into the ids of the tokenizers file. If quick, which merges_are_ranks() has to allow, merges are done by
    tiktoken at a fraction of the time; texts with characters that the two may split differently are left to tokenizers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    slow = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    if not quick or public_tokenizers.PATTERN != BYTE_LEVEL:
        return slow
    ranks = _ranks({"vocab": t.get_vocab(with_added_tokens=False)}, {x.content for x in t.get_added_tokens_decoder().values()})
    encoding = tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    fast = text_encoder(encoding, lambda chunk: slow([chunk])[0])

    def ids(texts: list[str]) -> list[list[int]]:
        odd = [i for i, x in enumerate(texts) if _has_unsettled(x)] if _has_unsettled("\n".join(texts)) else []
        if not odd:
            return fast(texts)
        out, left = fast(["" if i in set(odd) else x for i, x in enumerate(texts)]), slow([texts[i] for i in odd])
        for i, x in zip(odd, left, strict=True):
            out[i] = x
        return out

    return ids


def bundles(lengths: np.ndarray, limit: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(index, copies): each length's pieces that fit and are there, in bundles of 1, 2, 4 .. copies, any number of which can be put together."""
    out = []
    for i, length in enumerate(lengths):
        left, size = min(int(limit[i]), capacity // int(length)), 1
        while left > 0:
            size = min(size, left)
            out.append((i, size))
            left, size = left - size, size * 2
    return out


def dearest(lengths: np.ndarray, prices: np.ndarray, items: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """The pattern of the highest price that fits, made of bundles of copies: a bounded knapsack, so no length is used more often than it is there."""
    best, taken = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for k, (i, n) in enumerate(items):
        w = n * int(lengths[i])
        with_it = best[: capacity + 1 - w] + n * prices[i]
        np.greater(with_it, best[w:], out=taken[k, w:])
        np.maximum(best[w:], with_it, out=best[w:])
    used: dict[int, int] = {}
    c = capacity
    for k in range(len(items) - 1, -1, -1):
        if taken[k, c]:
            i, n = items[k]
            used[i] = used.get(i, 0) + n
            c -= n * int(lengths[i])
    return used


def relaxed(lengths: np.ndarray, count: np.ndarray, capacity: int, rounds: int) -> tuple[dict[tuple, float], np.ndarray]:
    """Amounts of patterns, and how much of each length they cover: multiplicative weights. Every round takes the dearest pattern until a
    share STEP of its scarcest length is covered, and lowers the prices of what it holds."""
    prices, covered = lengths / capacity, np.zeros(len(lengths))
    amounts: dict[tuple, float] = {}
    items = bundles(lengths, count, capacity)
    for _ in range(rounds):
        pattern = dearest(lengths, prices, items, capacity)
        step = STEP * min(count[i] / n for i, n in pattern.items())
        amounts[key] = amounts.get(key := tuple(sorted(pattern.items())), 0.0) + step
        for i, n in pattern.items():
            covered[i] += step * n / count[i]
            prices[i] *= np.exp(-RATE * step * n / count[i])
    return amounts, covered


def rounded(lengths: np.ndarray, count: np.ndarray, capacity: int, amounts: dict[tuple, float], scale: float) -> list[tuple[dict[int, int], int]]:
    """The amounts divided by scale and rounded down; what is left goes longest first, gaps filled by the longest length that fits."""
    left, plan = count.copy(), []
    for key, x in sorted(amounts.items(), key=lambda a: -a[1] * sum(lengths[i] * n for i, n in a[0])):
        times = min(int(x / scale), *(int(left[i] // n) for i, n in key))
        # a pattern with a gap that left-over pieces could fill is left to the second part
        if times and sum(lengths[i] * n for i, n in key) >= capacity - 1:
            plan.append(({int(lengths[i]): n for i, n in key}, times))
            for i, n in key:
                left[i] -= n * times
    while left.any():
        room, pattern = capacity, {}
        i = int(np.flatnonzero(left)[-1])
        while i >= 0:
            n = min(room // int(lengths[i]), int(left[i]))
            if n:
                pattern[i] = n
                room -= n * int(lengths[i])
            i = min(i, int(np.searchsorted(lengths, room, side="right"))) - 1
        times = min(int(left[i] // n) for i, n in pattern.items())
        plan.append(({int(lengths[i]): n for i, n in pattern.items()}, times))
        for i, n in pattern.items():
            left[i] -= n * times
    return plan


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """[(pattern: length -> times, sequences)] that hold exactly the histogram's pieces: the best of several roundings of the program's solution."""
    lengths = np.array(sorted(histogram), np.int64)
    count = np.array([histogram[int(x)] for x in lengths], np.int64)
    if not len(lengths):
        return []
    amounts, covered = relaxed(lengths, count, capacity, rounds)
    most, mean = float(covered.max()), float(np.average(covered, weights=lengths * count))
    plans = [rounded(lengths, count, capacity, amounts, scale) for scale in (mean, most, 2 * most, 4 * most, 16 * most)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces a sequence, first sequence, offset in the sequence)."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            out.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def cuts(n: int, capacity: int, short_first: bool) -> list[int]:
    """Bounds of the pieces of n ids; what full pieces leave over comes first or last."""
    first = n % capacity if short_first else 0
    return sorted({0, *range(first, n, capacity), n})


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int, short_first: bool = False) -> DataFrame:
    """One row a piece; `task` and `nth` number the pieces of a length within an input partition."""
    quick = merges_are_ranks(vocabulary_path)

    def run(batches: Iterable[pa.RecordBatch]):
        encode, seen, task = vocabulary(vocabulary_path, quick), {}, TaskContext.get().partitionId()
        for batch in batches:
            _, bounds = raw(batch.column(1))
            for first, last in blocks(bounds):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).slice(first, last - first).to_pylist(), encode(texts_of(batch.column(1), first, last)), strict=True):
                    ids = np.array([*ids, END_ID], "<u4").tobytes()
                    bounds_of = cuts(len(ids) // 4, capacity, short_first)
                    for piece, (at, end) in enumerate(zip(bounds_of, bounds_of[1:])):
                        n = end - at
                        seen[n] = seen.get(n, -1) + 1
                        rows.append((doc, piece, at, n, zlib.crc32(ids[4 * at : 4 * end]), task, seen[n]))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return map_arrow(with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def best_fit_packing(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, short_first: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row a piece.

    Every row counts as a document, also with a null or repeated doc_id; null text is empty and has only the end id. Documents of more than
    `capacity` ids are cut into full pieces and a last shorter one, or with `short_first` a first shorter one. Other columns are not returned; no rows give no pieces."""
    pieces = stash(token_pieces(docs, vocabulary_path or default_vocabulary(), capacity, short_first), "pieces")
    each = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = slots(solve(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = stash(each.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")  # a row a task and length
    ranked = pieces.join(bounded(base), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    held = pieces.sparkSession.sparkContext.broadcast(places)  # at most (ROUNDS + capacity) patterns

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                t = held.value[int(n)]
                row = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""Byte-level BPE by tiktoken with a local rank file. Long texts are cut before spaces that follow a character other than white space,
where no match of the split pattern can reach across. Decoding joins the raw bytes of the ids."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from grainmill.llm.common import blocks, map_arrow, raw, with_text

#: Characters of the parts of long texts, and of a run from which on matches are merged with a heap.
LONG_TEXT, LONG_PIECE = 100_000, 1_024
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def safe_chunks(text: str) -> list[str]:
    """text in parts that are encoded apart as they are together: cut before a space whose left neighbour is no white space."""
    parts = text.split(" ")
    out, held = [], parts[0]
    for p in parts[1:]:
        if held and not held[-1].isspace():
            out.append(held)
            held = " " + p
        else:
            held += " " + p
    if held:
        out.append(held)
    return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges of one long match with a heap, lowest rank and then leftmost first, in n log n."""
    n = len(piece)
    end, prev, nxt, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop or end[i] >= stop:
            continue
        j = nxt[i]
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


def text_encoder(enc, long_text):
    """A function from texts to lists of ids. Long texts are cut into parts at safe places, and parts with a run
    of LONG_PIECE characters that one match may cover go to long_text, which splits by the pattern first."""

    def parts(text: str) -> Iterable[str]:
        held, size = [], 0
        for chunk in safe_chunks(text):
            held.append(chunk)
            size += len(chunk)
            if size >= LONG_TEXT:
                yield "".join(held)
                held, size = [], 0
        yield "".join(held)

    def whole(text: str) -> list[int]:
        if len(text) < LONG_PIECE:
            return enc.encode_ordinary(text)
        if len(text) > 2 * LONG_TEXT:
            return [i for p in parts(text) for i in part(p)]
        return part(text)

    def part(text: str) -> list[int]:
        if longest_run(text) < LONG_PIECE:
            return enc.encode_ordinary(text)
        return [i for c in safe_chunks(text) for i in (enc.encode_ordinary(c) if len(c) < LONG_PIECE else long_text(c))]

    return lambda texts: [whole(t) for t in texts]


def longest_run(text: str) -> int:
    """Bytes of the longest run of ASCII white space or of other bytes."""
    turns = np.flatnonzero(np.diff(SPACE[np.frombuffer(text.encode(), np.uint8)]))
    return int(np.diff(np.concatenate([[-1], turns, [len(text.encode()) - 1]])).max())


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str):
    """(function from texts to ids, tiktoken encoding) of a local rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc, split = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)

    def long_text(chunk: str) -> list[int]:
        out: list[int] = []
        for m in split.findall(chunk):
            out += enc.encode_ordinary(m) if len(m) < LONG_PIECE else merge_long(m.encode(), ranks)
        return out

    return text_encoder(enc, long_text), enc


def texts_of(column: pa.Array, first: int, last: int) -> list[str]:
    return column.slice(first, last - first).to_pylist()


def bpe_round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>, decoded binary: one row for every input row.

    Null text counts as empty and gives no ids; the other columns are not returned."""
    return _encode(docs, ranks, pattern, digests=False)


def bpe_digests(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """As bpe_round_trip, with counts and digests in place of ids and bytes."""
    return _encode(docs, ranks, pattern, digests=True)


def _encode(docs: DataFrame, ranks: str | None, pattern: str | None, digests: bool) -> DataFrame:
    import public_tokenizers

    ranks, pattern = ranks or default_ranks(), pattern or public_tokenizers.PATTERN

    def run(batches: Iterable[pa.RecordBatch]):
        encode, enc = rank_encoder(ranks, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            _, bounds = raw(batch.column(1))
            for first, last in blocks(bounds):
                ids = encode(texts_of(batch.column(1), first, last))
                back = [enc.decode_bytes(x) for x in ids]
                doc = batch.column(0).slice(first, last - first)
                if digests:
                    listed = [hashlib.sha256(",".join([names[i] for i in x]).encode()).hexdigest() for x in ids]
                    yield pa.RecordBatch.from_arrays([doc, pa.array([len(x) for x in ids], pa.int64()), pa.array(listed, pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    from pyspark.sql import functions as F

    return map_arrow(with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), run, schema)

"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over the whole document (WIDTH bytes, every STRIDE), and activations are max-pooled over
overlapping chunks: blocks of BLOCK positions, each chunk two neighbouring blocks. Every chunk's pooled vector and its fill go through a
small hidden layer; the largest and the mean of the hidden values over all chunks give one probability. Nothing is cut off: a document of any length is
read in full, a block of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import blocks, labelled_sample, map_arrow, raw, stash, with_text

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN, BLOCK = 6, 8, 2, 32, 16, 128
TRAIN_ROWS, EPOCHS, BATCH, RATE = 5_000, 6, 32, 0.004
STEP_POSITIONS = 1 << 15


def start(seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    norm = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
    return {
        "embed": norm(257, EMBED, by=0.5),
        "conv": norm(WIDTH * EMBED, FILTERS, by=(2 / (WIDTH * EMBED)) ** 0.5),
        "conv_b": np.zeros(FILTERS, np.float32),
        "hide": norm(FILTERS + 1, HIDDEN, by=(2 / FILTERS) ** 0.5),
        "hide_b": np.zeros(HIDDEN, np.float32),
        "out": norm(2 * HIDDEN, by=HIDDEN**-0.5),
        "out_b": np.zeros(1, np.float32),
    }


def convolve(p: dict, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(max of every block, position of the max in the block) of one text; bytes beyond its end are the value 256."""
    n = max(1, -(-len(text) // STRIDE))
    n_blocks = -(-n // BLOCK)
    padded = np.full(n_blocks * BLOCK * STRIDE + WIDTH - 1, 256, np.int16)
    padded[: len(text)] = text
    top, where = np.empty((n_blocks, FILTERS), np.float32), np.empty((n_blocks, FILTERS), np.int32)
    per = STEP_POSITIONS // BLOCK
    for b in range(0, n_blocks, per):
        last = min(n_blocks, b + per)
        e = p["embed"][padded[b * BLOCK * STRIDE : last * BLOCK * STRIDE + WIDTH - 1]]
        windows = np.lib.stride_tricks.as_strided(e, ((last - b) * BLOCK, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
        a = (windows @ p["conv"]).reshape(last - b, BLOCK, FILTERS)
        if last == n_blocks and n % BLOCK:
            a[-1, n % BLOCK :] = -np.inf
        where[b:last] = a.argmax(1) if p.get("train") else 0
        top[b:last] = a.max(1)
    return np.maximum(top + p["conv_b"], 0), where


def chunks(top: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(pooled vectors of the chunks with their fill, which block of the two had the maximum)."""
    if len(top) == 1:
        pooled, second = top, np.zeros(top.shape, bool)
    else:
        second = top[1:] > top[:-1]
        pooled = np.maximum(top[1:], top[:-1])
    fill = np.ones((len(pooled), 1), np.float32)
    fill[-1, 0] = np.log1p(n_bytes - (len(pooled) - 1) * BLOCK * STRIDE) / np.log1p(2 * BLOCK * STRIDE)
    return np.hstack([pooled, fill]), second


def forward(p: dict, text: np.ndarray) -> tuple[float, tuple]:
    top, where = convolve(p, text)
    x, second = chunks(top, len(text))
    h = np.maximum(x @ p["hide"] + p["hide_b"], 0)
    best = h.argmax(0)
    doc = np.concatenate([h.max(0), h.mean(0)])
    return float(doc @ p["out"] + p["out_b"][0]), (top, where, x, second, h, best, doc)


def backward(p: dict, g: dict, text: np.ndarray, kept: tuple, d: float) -> None:
    top, where, x, second, h, best, doc = kept
    g["out"] += d * doc
    g["out_b"] += d
    dh = np.repeat((d * p["out"][HIDDEN:] / len(h))[None], len(h), 0)
    dh[best, np.arange(HIDDEN)] += d * p["out"][:HIDDEN]
    dh *= h > 0
    g["hide"] += x.T @ dh
    g["hide_b"] += dh.sum(0)
    dx = (dh @ p["hide"].T)[:, :FILTERS]
    dtop = np.zeros_like(top)
    if len(top) == 1:
        dtop += dx
    else:
        dtop[:-1] += dx * ~second
        dtop[1:] += dx * second
    dtop *= top > 0
    b, f = np.nonzero(dtop)
    v = dtop[b, f]
    at = (b * BLOCK + where[b, f]) * STRIDE
    padded = np.full(at.max(initial=0) + WIDTH, 256, np.int64)
    n = min(len(padded), len(text))
    padded[:n] = text[:n]
    bytes_at = padded[at[:, None] + np.arange(WIDTH)]
    e = p["embed"][bytes_at].reshape(len(at), WIDTH * EMBED)
    np.add.at(g["conv_b"], f, v)
    dw = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
    np.add.at(dw, f, e * v[:, None])
    g["conv"] += dw.T
    de = (p["conv"].T[f] * v[:, None]).reshape(len(at), WIDTH, EMBED)
    np.add.at(g["embed"], bytes_at, de)


def fit(rows: list[tuple[float, np.ndarray]], epochs: int = EPOCHS, seed: int = 11) -> dict[str, np.ndarray]:
    """Adam on the log loss, rows in a fixed order. Without rows the untrained network is returned."""
    p = start(seed)
    moment, square, step = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2)), None, 0
    moment, square = moment
    r = np.random.default_rng(seed)
    if rows:
        rate = float(np.clip(np.mean([y for y, _ in rows]), 0.01, 0.99))
        p["out_b"][0] = np.log(rate / (1 - rate))
    total = epochs * -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            g = {k: np.zeros_like(v) for k, v in p.items()}
            part = order[at : at + BATCH]
            for k in part:
                y, text = rows[k]
                s, kept = forward(p | {"train": True}, text)
                backward(p, g, text, kept, (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(part))
            step += 1
            lr = RATE * (1 - step / (total + 1))
            for k in p:
                moment[k] = 0.9 * moment[k] + 0.1 * g[k]
                square[k] = 0.999 * square[k] + 0.001 * g[k] ** 2
                p[k] -= (lr * moment[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return p


def train(sample: DataFrame) -> dict[str, np.ndarray]:
    """sample(doc_id, text, y), of bounded size, fitted in one task."""
    shapes = {k: v.shape for k, v in start().items()}

    def one(batches: Iterable[pa.RecordBatch]):
        rows = []
        for batch in batches:
            data, bounds = raw(batch.column(1))
            rows += [(doc, y, data[bounds[i] : bounds[i + 1]].copy()) for i, (doc, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))]
        rows.sort(key=lambda r: (r[0], len(r[2])))
        p = fit([(y, text) for _, y, text in rows])
        yield pa.RecordBatch.from_arrays([pa.array(list(p)), pa.array([v.ravel().tolist() for v in p.values()], pa.list_(pa.float32()))], ["name", "v"])

    got = map_arrow(sample.select("doc_id", "text", "y").repartition(1), one, "name string, v array<float>").collect()
    return {r["name"]: np.array(r["v"], np.float32).reshape(shapes[r["name"]]) for r in got} or start()


def quality_scores(docs: DataFrame, model: dict[str, np.ndarray], only_score: bool = True) -> DataFrame:
    """docs(text, ...) -> the same rows with a score in 0 .. 1 (only doc_id and score if only_score). Null text is scored as empty text.

    An input column named score is replaced; no rows give no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") if only_score else docs.drop("score")
    at = rows.columns.index("text")
    read = rows.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_read"))

    def score(batches):
        p = held.value
        for batch in batches:
            data, bounds = raw(batch.column(batch.num_columns - 1))
            out = [forward(p, data[bounds[i] : bounds[i + 1]])[0] for i in range(batch.num_rows)]
            s = pa.array(1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30))))
            keep = [0] if only_score else range(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), s], [*(batch.schema.names[i] for i in keep), "score"])

    del at
    kept = "doc_id long" if only_score else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(read, score, kept + ", score double")


def quality(docs: DataFrame, labels: DataFrame, train_rows_if, most: int = TRAIN_ROWS, only_score: bool = True) -> DataFrame:
    """Fit on at most `most` labelled rows for which train_rows_if holds, then score all of docs."""
    sample = stash(labelled_sample(docs, labels, "quality", train_rows_if, most), "quality-sample")
    return quality_scores(docs, train(sample), only_score)

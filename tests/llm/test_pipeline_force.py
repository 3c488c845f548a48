"""run() against brute force, stage by stage, on a table with nulls, empty texts, ties, repeated rows and other columns, and on an empty one."""

import array
import random
import re
import zlib

import corpus_pipeline
from test_contract import WORDS, components_by_force

from grainmill.llm import packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _read long, spans string"


def make():
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))
    base, passage = prose(60), prose(14)
    texts = [prose(r.randrange(3, 80)) for _ in range(220)]
    texts += [base, base, base.replace("of", "or", 1), base + " end", passage, prose(9) + " " + passage + " " + prose(9), "head " + passage, "", None, " \n", "one two", "x " * 1400]
    texts += [" ".join(w.upper() + "!!" for w in prose(30).split()) for _ in range(150)]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id here at all"), (None, base), (None, None), (-3, base + " end")]


def by_force(rows, labels):
    told = [(i, t) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 5]
    sample = sorted({i: min((t or "") for j, t in told if j == i) for i, _ in told}.items())
    import numpy as np

    bytes_of = lambda t: np.frombuffer((t or "").encode(), np.uint8)
    p = quality.fit([(float(labels[i]), bytes_of(t)) for i, t in sample])
    good = [(i, t) for i, t in rows if 1 / (1 + np.exp(-quality.forward(p, bytes_of(t))[0])) >= 0.3]
    sizes = [len(good)]
    seen, kept = {}, []
    for i, t in sorted(good, key=lambda x: (x[0] is None, x[0] or 0)):
        if (t or "") not in seen:
            seen[t or ""] = i
            kept.append((i, t))
    sizes.append(len(kept))
    root = {x[0]: x[2] for x in components_by_force(kept, 5, 80)}
    near = [(i, t) for i, t in kept if i is None or root[i] == i]
    sizes.append(len(near))
    first: dict = {}
    for i, t in near:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    cut = []
    for i, t in near:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        cut.append((i, bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore") if sum(gone) else t or ""))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    tok.encode_special_tokens = True
    out = []
    for i, t in cut:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        bounds = packing.cuts(len(ids), 1024, True)
        out += [(i, n, a, b - a, zlib.crc32(array.array("I", ids[a:b]).tobytes())) for n, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    return sizes, sorted(out, key=str)


def test_run_by_force(spark, tmp_path):
    rows = make()
    labels = {i: int(not re.search("!!", t or "")) for i, t in rows if i is not None and i % 4}
    spark.createDataFrame([(i, t, "en", None, 7, "k", 1, "s") for i, t in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels.items()] + [(None, 1, 0), (10**6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes, want = by_force(rows, labels)
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] > 30  # every stage decides something
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == want
    filled: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

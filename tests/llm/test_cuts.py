"""Long documents are cut so that the first piece is the shorter one, in op7 and in the pipeline's last stage."""

import array
import zlib

import corpus_pipeline
from grainmill.llm import packing, queries


def test_the_first_piece_is_the_shorter_one(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    texts = ["", "one two", "x y " * 1500, " ".join(f"w{i}" for i in range(2000))] + ["a " * n for n in (1022, 1023, 1024, 2047)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids + [2]
        at, end, piece = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want.append((i, piece, at, end - at, zlib.crc32(array.array("I", ids[at:end]).tobytes())))
            at, end, piece = end, end + 1024, piece + 1
    for got in (queries.op7_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, docs, str(tmp_path))):
        assert sorted(tuple(r)[:5] for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(want)

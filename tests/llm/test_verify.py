import pyarrow as pa

from grainmill.llm import jaccard_join


def test_each_text_of_a_repeated_id_is_judged_by_itself():
    first, second = (" ".join(f"{k}{i}" for i in range(60)) for k in "pq")
    rows = [(1, -1, None, first), (1, -1, None, second), (1, -1, 2, first + " more"), (1, -1, 3, second + " more"), (1, -1, 4, "else " * 9), (5, 0, None, first), (5, 0, 6, first), (5, 1, 7, first)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["a", "salt", "b", "text"])
    out = pa.Table.from_batches(jaccard_join._verify(4, 85)([batch])).to_pylist()
    assert sorted((r["a"], r["b"]) for r in out) == [(1, 2), (1, 3), (5, 6)]


def test_words_built_to_collide_do_not_link(spark):
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(1, word), (2, word.translate({97: 98, 98: 97})), (3, word)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.near_join(docs).collect()) == [(1, 1, 1, 1), (2, 1, 2, 0), (3, 1, 1, 1)]


def test_no_pair_is_verified_twice(spark, monkeypatch):
    asked = []
    real = jaccard_join.verified

    def counted(docs, pairs, tried, n, percent):
        out, seen = real(docs, pairs, tried, n, percent)
        asked.append(seen.count())
        assert seen.distinct().count() == asked[-1]
        return out, seen

    monkeypatch.setattr(jaccard_join, "verified", counted)
    words = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(words[:40] + [f"x{k}{j}" for j in range(9)] + words[40 + k :])) for k in range(12)]
    assert jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).count() == 12
    assert asked

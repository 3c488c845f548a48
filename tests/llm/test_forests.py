"""Components of near copies are joined by spanning forests: the pairs looked at do not grow with the square of a group."""

import pytest

from grainmill.llm import common, jaccard_join


@pytest.mark.parametrize("copies", [96, 192])
def test_pairs_of_components_grow_with_the_members(spark, monkeypatch, copies):
    asked, real = [], jaccard_join.verified

    def counted(docs, pairs, tried, n, percent):
        out, seen = real(docs, pairs, tried, n, percent)
        asked.append(seen.count())
        return out, seen

    monkeypatch.setattr(jaccard_join, "verified", counted)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "CELL", copies // 8)  # the first round leaves eight components
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(k, f"{base} x{k}") for k in range(copies)], "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.near_components(docs).collect()} == {(k, 58, 0) for k in range(copies)}
    assert copies - 1 <= asked[-1] <= 10 * copies


def test_prefixes_are_on_disk_once_and_not_after_the_lists(spark, monkeypatch):
    heads, real, mark = {}, jaccard_join.stash, common.written()

    def seen(df, name):
        heads[name] = sum("head" in spark.read.parquet(path).columns for path in common._written[mark:])
        return real(df, name)

    monkeypatch.setattr(jaccard_join, "stash", seen)
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i % 2}") for i in range(6)], "doc_id long, text string")
    assert jaccard_join.near_components(docs).count() == 6
    assert heads["entries"] == 1 and heads["candidates"] == 0


def test_long_lists_are_looked_at_alone(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 100)
    monkeypatch.setattr(jaccard_join, "SHORT", 10)
    rows = [(h, label) for h in range(30) for label in range(5)] + [(h, label) for h in range(30, 40) for label in range(60)] + [(99, 7), (99, 7)]
    told = spark.createDataFrame(rows, "h long, label long")
    seen = {}
    for r in jaccard_join._open_lists(told).collect():
        seen.setdefault(r.place, []).append(r.h)
    lists = {place: set(hs) for place, hs in seen.items()}
    assert sorted(h for hs in lists.values() for h in hs) == list(range(40)) and sum(map(len, seen.values())) == 750
    assert all(len(hs) == 1 for hs in lists.values() if max(hs) >= 30)
    assert sum(max(hs) < 30 for hs in lists.values()) in (1, 2)

"""Links of the similarity join against brute force: none is lost within a component, and copies count."""

import itertools
import re

import pytest
from test_contract import ROWS, docs, listed  # noqa: F401

from grainmill.llm import jaccard_join


def sets_of(rows, n):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def links_by_force(rows, n, percent):
    sets = sets_of(rows, n)
    near = lambda x, y: x and y and 100 * len(x & y) >= percent * len(x | y)
    counts = [(i, sum(j != k and rows[j][0] is not None and bool(near(sets[k], sets[j])) for j in range(len(rows))) if i is not None else 0) for k, (i, _) in enumerate(rows)]
    rep: dict = {}
    for (i, _), s in zip(rows, sets):
        if i is not None and s:
            rep[s] = min(i, rep.get(s, i))
    pairs = [tuple(sorted((rep[x], rep[y]))) for x, y in itertools.combinations(rep, 2) if near(x, y)]
    return sorted(counts, key=str), sorted(pairs, key=str)


@pytest.mark.parametrize("cell", [1000, 3])
def test_every_link_is_found(docs, monkeypatch, cell):  # noqa: F811
    monkeypatch.setattr(jaccard_join, "LINK_CELL", cell)
    counts, pairs = links_by_force(ROWS, 4, 85)
    assert len(pairs) > 20
    assert listed(jaccard_join.near_join(docs), "doc_id", "n_links") == counts
    if cell == 3:
        assert listed(jaccard_join.near_links(docs), "a", "b") == pairs


def test_prefixes_travel_without_what_their_set_knows(spark, monkeypatch):
    columns, real = {}, jaccard_join.stash

    def seen(df, name):
        columns[name] = set(df.columns)
        return real(df, name)

    monkeypatch.setattr(jaccard_join, "stash", seen)
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i % 2}") for i in range(6)], "doc_id long, text string")
    assert jaccard_join.near_components(docs).count() == 6
    assert columns["entries"] == {"h", "sig", "pos", "size"}

"""Segments that only share the gram that names them never reach the transform; those that share a window always do."""

import numpy as np

from grainmill.llm import substring_dedup


def by_force(texts, length):
    seen, out = set(), {}
    for i, x in enumerate(texts):
        gone = [False] * len(x)
        starts = [x[k : k + length] for k in range(len(x) - length + 1)]
        for k, w in enumerate(starts):
            if w in seen:
                gone[k : k + length] = [True] * length
        seen.update(starts)
        out[i] = (sum(gone), bytes(c for c, g in zip(x, gone, strict=True) if not g))
    return out


def test_common_grams_without_common_windows_are_not_cut(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    phrase = word(24)
    texts = [" ".join(word(30) + phrase + word(30) for _ in range(4)) for _ in range(30)]
    count, real = {}, substring_dedup.stash

    def counted(df, name):
        out = real(df, name)
        count[name] = out.count()
        return out

    monkeypatch.setattr(substring_dedup, "stash", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {0} and count["cuts"] == 0


def test_shared_windows_of_all_kinds(spark):
    rng = np.random.default_rng(9)
    word = lambda n, letters="abcdef": "".join(rng.choice(list(letters), n))
    pool = [word(n) for n in (49, 50, 51, 60, 90, 200)] + ["ab" * 40, "x" * 120, (word(20) + " ") * 8, word(17) * 6, word(33) * 4]
    texts = []
    for _ in range(120):
        parts = [pool[k] for k in rng.integers(0, len(pool), 3)]
        cut = [(p[int(rng.integers(0, 20)) :] if rng.random() < 0.5 else p[: len(p) - int(rng.integers(0, 20))]) for p in parts]
        texts.append(word(int(rng.integers(0, 40))).join(cut).encode())
    docs = spark.createDataFrame([(i, x.decode()) for i, x in enumerate(texts)], "doc_id long, text string")
    for length in (50, 16, 17, 31):
        got = {r.row: (r.n_removed, bytes(r.kept)) for r in substring_dedup.substring_dedup(docs, length).collect()}
        assert got == by_force(texts, length), length

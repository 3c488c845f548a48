"""Notices beside, around and inside each other, and spread out: every one is found, once."""

import itertools
import re

from grainmill.llm import license_scan


def grams(t):
    w = re.findall("[a-z0-9]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def exact(rows):
    wanted = {name: grams(t) for name, t in license_scan.TEMPLATES.items()}
    return sorted((i, name, len(g & all_)) for i, t in rows for all_ in [grams(t)] for name, g in wanted.items() if len(g & all_) >= 0.8 * len(g))


def test_notices_beside_each_other(spark):
    notices = list(license_scan.TEMPLATES.values())
    rows = [(k, "zz " * n + x + " " + y) for k, ((x, y), n) in enumerate(itertools.product(itertools.permutations(notices, 2), range(0, 64, 3)))]
    rows += [(10**6 + k, " ".join(notices[k:] + notices[:k])) for k in range(len(notices))]
    rows += [(2 * 10**6 + k, re.sub(r"((?:\S+ ){%d})" % (9 + k), r"\1" + "qq " * 200, x)) for k, x in enumerate(notices)]
    rows += [(3 * 10**6 + k, " ".join(w if i % 40 != 20 else "other" for i, w in enumerate(x.split()))) for k, x in enumerate(notices)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert sorted(tuple(r) for r in got.select("doc_id", "license", "n_found").collect()) == exact(rows)

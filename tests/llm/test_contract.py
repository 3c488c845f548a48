"""The corpus operators against brute force, over a small table with nulls, empty and long texts, ties, repeated rows and other columns."""

import array
import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from grainmill.llm import exact_dedup, jaccard_join, license_scan, media, packing, quality, substring_dedup, tokens, toxicity, warc

WORDS = "ab cde fgh ijkl mno über été pq rst uvw xyz the of and naïve 日本 can't x1 22 333".split()
SCHEMA = "doc_id long, text string, lang string, kept string, score string, n long, h long, spans string"


def make():
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))
    texts = [prose(r.randrange(1, 120)) for _ in range(40)]
    base = prose(100)
    passage = prose(15)
    texts += [base, base, base + " more", base.upper(), base.replace("the", "that"), passage, "lead " + passage + " tail", "other " + passage]
    for _ in range(12):  # near copies that link in chains
        w = base.split()
        for _ in range(r.randrange(1, 3)):
            w[r.randrange(len(w))] = "changed" + str(r.randrange(9))
        texts.append(" ".join(w))
    texts += ["", None, " \t\n", "one", "one two three", "ONE two three", "a" * 3000, "a" * 3000 + "b", " " * 1500, "é" * 700, "x y " * 3000, "日本語" * 600 + "  q", prose(4000)]
    texts += ["Released under the MIT License.", "See: licensed under the Apache License, version 2.0. " + prose(5)]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "without id"), (None, base), (None, None), (-7, base)]
    return rows


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i and i % 3 else "en", "k", "s", 1, 2, "z") for i, t in ROWS], SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert license_scan.license_scan(empty).count() == 0
    assert quality.quality(empty, labels, labels.doc_id > 0).count() == 0
    assert toxicity.toxicity(empty, labels, labels.doc_id > 0).count() == 0
    assert media.media_columns(empty).count() == 0
    assert jaccard_join.near_components(empty).count() == 0
    assert packing.best_fit_packing(empty).count() == 0
    assert tokens.bpe_digests(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert substring_dedup.replace_text(empty).columns == empty.columns
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(pages)).count() == 0


def test_license_scan(docs):
    def grams(t):
        w = re.findall("[a-z0-9]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = []
    for (i, t), (name, notice) in itertools.product(sorted(set(ROWS), key=str), license_scan.TEMPLATES.items()):
        g, all_ = grams(notice), grams(t or "")
        if len(g & all_) >= 0.8 * len(g):
            want.append((i, name, len(g & all_)))
    assert want and listed(license_scan.license_scan(docs), "doc_id", "license", "n_found") == sorted(want, key=str)
    assert 1 - (1 - license_scan.CONTAINED) ** license_scan.bands_for() >= license_scan.PROBABLE


def test_quality_and_toxicity_learn(spark, docs):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        words = [r.choice(WORDS) for _ in range(r.randrange(5, 200))]
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        rows.append((i, text + (" vilest" if i % 5 == 0 else "")))
        labels.append((i, int(not bad), int(i % 5 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    tags = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    train = tags.doc_id % 3 != 1
    for op, column, at in ((quality.quality, 1, 0.5), (toxicity.toxicity, 2, 0.5)):
        got = {x["doc_id"]: x["score"] for x in op(d, tags, train).collect()}
        assert len(got) == 300 and all(0 <= s <= 1 for s in got.values())
        assert np.mean([(got[i[0]] >= at) == bool(i[column]) for i in labels if i[0] % 3 == 1]) > 0.95
    # every kind of row gets a score, extra columns or not
    model = quality.train(d.limit(0).selectExpr("doc_id", "text", "1D y"))
    assert quality.quality_scores(docs, model).count() == len(ROWS)
    out = quality.quality_scores(docs, model, only_score=False)
    assert out.count() == len(ROWS) and out.columns.count("score") == 1
    assert toxicity.toxicity_scores(docs, (np.zeros(0, int), np.zeros(0))).where("score = 0.5").count() == len(ROWS)



def test_media(docs):
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        m = media.header_of(len(p)) + p
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), media.feature_of(p)))
    got = media.media_columns(docs)
    assert listed(got, *got.columns) == sorted(want, key=str)


def test_media_stores_shared_chunks_once(spark):
    r = np.random.default_rng(0)
    shared = "".join(map(chr, r.integers(97, 123, 40_000)))
    rows = [(i, "".join(map(chr, r.integers(97, 123, 3000))) + shared) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    recipes, store = media.write_media(d)
    stored = store.selectExpr("explode(data) AS data").selectExpr("sum(length(data))").first()[0]
    held = store.selectExpr("explode(arrays_zip(chunks, data)) AS x").where("x.data IS NOT NULL").groupBy("x.chunks").count()
    assert stored < sum(len(t) for _, t in rows) / 2 and held.where("count > 1").isEmpty()
    assert {x["payload_sha256"] for x in media.read_media(store).collect()} == {hashlib.sha256(media.payload_of(t.encode())).hexdigest() for _, t in rows}


def test_media_are_what_list_and_header_say(spark):
    rows = [(1, "".join(chr(97 + k * k % 23) for k in range(30_000))), (2, "x" * 100)]
    _, store = media.write_media(spark.createDataFrame(rows, "doc_id long, text string"))
    turned = store.selectExpr("recipe", "head", "reverse(chunks) AS chunks", "reverse(data) AS data")
    other = store.selectExpr("recipe", "concat(head, X'00') AS head", "chunks", "data")
    for broken in (turned, other):
        with pytest.raises(Exception, match="recorded medium"):
            media.read_media(broken).collect()


def test_gear_hash_rolls():
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog" * 3, np.uint8)
    h = 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        assert int(media.gear_hash(data)[i]) == h


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/1", "same"), (1, "http://a/ 2\n", "same"), (2, None, None), (9, "u", ""), (4, "u", "WARC/1.1\r\n\r\nx"), (5, "u", "z" * 600_000), (None, "u", "same"), (None, "u", "only"), (9, "u", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    bundles = warc.write_bundles(pages, frame_bytes=64)
    got = listed(warc.read_bundles(bundles), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = [(i, len(h or ""), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if first.get(h or "", i) == i else ("revisit", first[h or ""]))) for i, _, h in rows]
    assert got == sorted(want, key=str)
    import json

    import zstandard

    one = warc.record_id(5, warc.payload_digest(b"z" * 600_000))
    got = warc.find_records(bundles, spark.createDataFrame([(one,), ("none",)], "record_id string")).collect()
    assert [(r["record_id"], bytes(r["payload"]), r["header"]["X-Page-ID"]) for r in got] == [(one, b"z" * 600_000, "5")]
    for name in warc.export_bundles(bundles, str(tmp_path)):  # any Zstandard reader skips the seek table
        with open(name, "rb") as f:
            assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.1\r\n")
        with open(name, "rb") as f, open(f"{name}.idx.jsonl") as index:
            reader = warc.BundleReader(f.read())
            for e in map(json.loads, index):
                assert warc.read_record(reader.record(e["frame"], e["offset"], e["length"]))[0]["WARC-Record-ID"] == e["record_id"]


def components_by_force(rows, n, percent):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if rows[a][0] is None or rows[b][0] is None:
            continue
        both = len(sets[a] & sets[b])
        if (sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)) or rows[a][0] == rows[b][0]:
            root[find(a)] = find(b)
    low = {}
    for k in sets:
        if rows[k][0] is not None:
            low[find(k)] = min(rows[k][0], low.get(find(k), rows[k][0]))
    return sorted(((i, len(sets[k]), low.get(find(k)) if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("cell", [4000, 3])
def test_jaccard_join(docs, monkeypatch, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    assert listed(jaccard_join.near_components(docs), "doc_id", "n_shingles", "component_id") == components_by_force(ROWS, 4, 85)


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    got = packing.best_fit_packing(docs).toPandas()
    want = sorted((zlib.crc32(array.array("I", ids[a : a + 1024]).tobytes()), a, len(ids[a : a + 1024])) for ids in (t.encode(x or "", add_special_tokens=False).ids + [2] for _, x in ROWS) for a in range(0, len(ids), 1024))
    assert sorted(zip(got.ids_crc32, got.start, got.length)) == want
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all()
    used = s.groupby("sequence_id").length.sum()
    assert used.max() <= 1024 and len(used) <= -(-used.sum() // 1024) + 1


def test_configuration_program_is_near_its_bound():
    r = np.random.default_rng(3)
    for hist in ({400: 1000, 300: 1000, 324: 1000}, {512: 10}, {1024: 3, 1: 5}, dict(zip(*(x.tolist() for x in np.unique(np.clip(r.lognormal(5.5, 0.7, 50_000).astype(int), 1, 1024), return_counts=True))))):
        plan = packing.solve(hist)
        held: dict = {}
        for pattern, times in plan:
            assert sum(k * n for k, n in pattern.items()) <= 1024
            for k, n in pattern.items():
                held[k] = held.get(k, 0) + n * times
        assert held == hist
        assert sum(t for _, t in plan) <= 1.01 * sum(k * n for k, n in hist.items()) / 1024 + 1
    assert packing.solve({}) == []


def test_bpe(docs):
    import public_tokenizers as P
    import tiktoken

    with open(tokens.default_ranks(), "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = []
    for i, t in ROWS:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = tokens.bpe_digests(docs)
    assert listed(got, *got.columns) == sorted(want, key=str)
    back = tokens.bpe_round_trip(docs).select("doc_id", "decoded").collect()
    assert sorted((str(r[0]), bytes(r[1])) for r in back) == sorted((str(i), (t or "").encode()) for i, t in ROWS)


@pytest.mark.parametrize("keep,digest_bytes,memtable", [("largest", 32, 100_000), ("smallest", 32, 3), ("smallest", 1, 100_000), ("largest", 0, 2)])
def test_exact_dedup(docs, keep, digest_bytes, memtable):
    groups: dict = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    pick = lambda ids: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None)
    out = exact_dedup.exact_dedup(docs, keep, digest_bytes, memtable, 2)
    got = out.select("doc_id", "text", "keep_id", "group_size", "kept").collect()
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((i, pick(groups[t or ""]), len(groups[t or ""])) for i, t in ROWS), key=str)
    kept = [r for r in got if r[4]]
    assert sorted(r[1] or "" for r in kept) == sorted(groups) and all(r[0] == r[2] for r in kept)
    assert set(docs.columns) - {"kept"} <= set(out.columns)


@pytest.mark.parametrize("hot", [50_000, 2])
def test_substring_dedup(docs, hot):
    first: dict = {}
    for i, t in ROWS:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    want, texts = [], []
    for i, t in ROWS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept.hex()))
        texts.append((i, kept.decode("utf-8", "ignore") if sum(gone) else t))
    got = [(r[0], r[1], r[2], r[3], bytes(r[4]).hex()) for r in substring_dedup.substring_dedup(docs, 50, hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert listed(substring_dedup.replace_text(docs, 50, hot), "doc_id", "text") == sorted(texts, key=str)


def test_hits_come_from_runs_that_their_filters_let_through(monkeypatch):
    digest = lambda k: hashlib.sha256(bytes([k])).digest()
    entries = [(digest(k % 7), False, k, 1, 1, False) for k in range(20)]

    def hits():
        index = exact_dedup.LsmIndex(memtable_rows=2, fanout=3)
        for e in entries[:3] + entries[7:9]:
            index.put([e])
        index.put([])
        out = {e[0] for level in index.levels for r in level for e in r if e[5]} | {k for k, e in index.table.items() if e[5]}
        index.close()
        return out

    assert hits() == {digest(0), digest(1)}
    read = []
    real = exact_dedup.Run._find
    monkeypatch.setattr(exact_dedup.Run, "_find", lambda self, f, d: read.append(d) or real(self, f, d))
    assert hits() == {digest(0), digest(1)} and set(read) == {digest(0), digest(1)}
    monkeypatch.setattr(exact_dedup.Filter, "may_hold", lambda self, d: np.zeros(len(d), bool))
    assert hits() == set()


def test_long_texts_have_the_features_of_their_whole_word_sequence(monkeypatch):
    import pyarrow as pa

    r = random.Random(9)
    words = [r.choice(WORDS).replace("'", "") + str(r.randrange(99)) for _ in range(3000)]
    for between in (" ", "\n", "\t-", ". "):
        texts = [between.join(words), "x", "", between.join(words[:5]), "y" * 9000]
        whole = list(toxicity.features(pa.array(texts)))
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", 700)
        cut = [(first, last, row, f) for first, last, row, f in toxicity.features(pa.array(texts))]
        monkeypatch.undo()
        flat = lambda parts: sorted((first + int(x), int(y)) for first, _, row, f in parts for x, y in zip(row, f))
        assert flat(whole) == flat(cut)
        # the words and pairs are those of a plain split
        listed_ = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", texts[3])
        each = [toxicity.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])) for w in listed_]
        row, one, _, cut = (np.concatenate(x) for x in zip(*each))
        want = toxicity.grams(np.full(len(one), 3), one, np.full(len(cut), 3), cut)
        assert sorted(y for x, y in flat(whole) if x == 3) == sorted(map(int, want[1]))


def test_ftrl_by_plain_loops(monkeypatch):
    r = np.random.default_rng(2)
    sample = [(float(k % 2), np.unique(r.integers(0, 40, 6) + 40 * (k % 2 and k % 3))) for k in range(60)]
    at, w = toxicity.fit(sample)
    z, n = {}, {}
    top = 1 << toxicity.BITS
    weigh = lambda i: 0.0 if abs(z.get(i, 0.0)) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for k in np.random.default_rng(5).permutation(len(sample)):
            y, f = sample[k]
            f = [*map(int, f), top]
            ws = {i: weigh(i) for i in f}
            g = 1 / (1 + np.exp(-sum(ws.values()))) - y
            for i in f:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before**0.5) / toxicity.ALPHA * ws[i]
    want = {i: weigh(i) for i in z if weigh(i)}
    assert set(map(int, at)) == set(want) and all(abs(want[int(i)] - x) < 1e-6 for i, x in zip(at, w))


def test_network_by_plain_loops_and_differences():
    p = {k: v.astype(np.float64) for k, v in quality.start(3).items()}
    r = np.random.default_rng(4)
    for size in (0, 5, 40, 700, 1500):
        text = r.integers(0, 256, size).astype(np.uint8)
        n = max(1, -(-size // quality.STRIDE))
        at = lambda i: p["embed"][text[i] if i < size else 256]
        acts = [np.maximum(sum(at(k * quality.STRIDE + j) @ p["conv"].reshape(quality.WIDTH, quality.EMBED, -1)[j] for j in range(quality.WIDTH)) + p["conv_b"], 0) for k in range(n)]
        blocks = [np.max(acts[i : i + quality.BLOCK], axis=0) for i in range(0, n, quality.BLOCK)]
        pooled = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:])] or blocks
        fill = [1.0] * (len(pooled) - 1) + [np.log1p(size - (len(pooled) - 1) * quality.BLOCK * quality.STRIDE) / np.log1p(2 * quality.BLOCK * quality.STRIDE)]
        h = np.array([np.maximum(np.append(v, f) @ p["hide"] + p["hide_b"], 0) for v, f in zip(pooled, fill)])
        want = float(np.concatenate([h.max(0), h.mean(0)]) @ p["out"] + p["out_b"][0])
        single = {k: v.astype(np.float32) for k, v in p.items()}
        assert abs(quality.forward(single, text)[0] - want) < 1e-3
    text = r.integers(97, 123, 600).astype(np.uint8)
    single = quality.start(3)
    s, kept = quality.forward(single | {"train": True}, text)
    g = {k: np.zeros_like(v) for k, v in single.items()}
    quality.backward(single, g, text, kept, 1.0)
    for name, v in single.items():
        for i in np.argsort(-np.abs(g[name]).ravel())[:3]:
            moved = {k: x.copy() for k, x in single.items()}
            moved[name].ravel()[i] += 1e-2
            rise = (quality.forward(moved, text)[0] - s) / 1e-2
            assert abs(rise - g[name].ravel()[i]) < 0.05 + 0.1 * abs(g[name].ravel()[i]), name


def test_encoders_are_proved_equal_or_not_used(tmp_path):
    import json

    path = packing.default_vocabulary()
    assert packing.merges_are_ranks(path)
    with open(path) as f:
        told = json.load(f)
    told["model"]["merges"][-1], told["model"]["merges"][-2] = told["model"]["merges"][-2], told["model"]["merges"][-1]
    (tmp_path / "late.json").write_text(json.dumps(told))
    assert not packing.merges_are_ranks(str(tmp_path / "late.json"))
    texts = ["plain", "new letters Ᲊ \U00010d50 and Ƛ", "a\x1cb", "<|endoftext|> 12 34"]
    assert packing.vocabulary(path, True)(texts) == packing.vocabulary(path, False)(texts)


def test_the_dearest_pattern_uses_no_length_more_often_than_it_is_there():
    r = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.sort(r.choice(np.arange(1, 12), 4, replace=False))
        prices, limit = r.random(4), r.integers(1, 4, 4)
        got = packing.dearest(lengths, prices, packing.bundles(lengths, limit, 20), 20)
        best = max(sum(n * p for n, p in zip(c, prices)) for c in itertools.product(*(range(m + 1) for m in limit)) if sum(n * k for n, k in zip(c, lengths)) <= 20)
        assert all(n <= limit[i] for i, n in got.items()) and sum(n * lengths[i] for i, n in got.items()) <= 20
        assert abs(sum(n * prices[i] for i, n in got.items()) - best) < 1e-9


def test_substring_tags_tell_texts_of_one_id_apart(spark):
    passage = "this passage of more than fifty bytes stands in several documents"
    rows = [(1, passage), (2, "a " + passage), (2, passage + " b"), (2, "short"), (3, passage), (3, passage)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["row"], bytes(r["kept"]).decode()) for r in got) == [(1, passage), (2, " b"), (2, "a "), (2, "short"), (3, ""), (3, "")]

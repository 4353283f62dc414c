"""Each operator against a plain version of what it computes, with nulls, ties, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import align, common, counts, idstore, licenses, maxent, mixing, packing, quality, setsketch, tokens, urlrules, vamana, variants, warc
from tidegrid.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """rows of (doc_id, text, source); two more columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x") for i, t, s in rows], DOCS)


def corpus(seed=0, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)] + ["The", "Än", "'s", "日本", "a,b"]
    rows = []
    for i in range(n):
        rows.append((i, "\n".join(" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(rng.integers(1, 5))), f"s{i % 4}"))
    rows += [(100, None, None), (101, "", "s1"), (102, " \n\t ", None), (103, rows[3][1], "s1"), (104, rows[3][1] + " more", "s2"), (None, rows[5][1], "s0"), (105, rows[7][1], "s0"), (105, rows[7][1], "s0")]
    rows.append((106, " ".join(f"long{k % 5000}" for k in range(20_000)), "s3"))
    return rows


def components(ids, links):
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b in links:
            low = min(new[a], new[b])
            new[a] = new[b] = low
        if new == label:
            return label
        label = new


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 60), (60, 60), (99, 98)]
    df = spark.createDataFrame([*links, (None, 3), *links[:3]], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = components({x for p in links for x in p}, links)
    assert got == want
    assert connected_components(df.where("a < 0")).count() == 0


def test_sample_is_of_least_hashes(spark):
    df = spark.range(4000).withColumn("h", F.xxhash64("id"))
    want = sorted((r["h"], r["id"]) for r in df.collect())[:1000]
    for parts in (1, 7):
        got = common.hashed_sample(df.repartition(parts, F.col("id") % 13), 1000, "id").collect()
        assert sorted((r["h"], r["id"]) for r in got) == want


def test_op1_links(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    vecs = [b + rng.normal(size=16) * 0.15 for b in base for _ in range(int(rng.integers(1, 30)))] + list(rng.normal(size=(200, 16)))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vecs)]
    rows += [(9000, None, "x"), (9001, [0.0] * 16, "x"), (9002, [math.nan] * 16, "x"), (9003, [None, *[1.0] * 15], "x"), (9004, (np.array(vecs[0]) * 3).tolist(), "x"), (9005, vecs[5].tolist(), "x"), (9006, [1.0, 2.0], "x"), (9007, [2.0, 4.0], "x"), (None, vecs[0].tolist(), "x"), (9008, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = {r["vec_id"]: r for r in vamana.near_vectors(df).collect()}
    unit = {i: vamana.unit(v) for i, v, _ in rows if i is not None}
    ids = [i for i in unit if unit[i] is not None and len(unit[i]) == 16]
    m = np.stack([unit[i] for i in ids])
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))] + [(9006, 9007)]
    want = components([r[0] for r in rows if r[0] is not None], links)
    count = collections.Counter(a for a, _ in links)
    found, true = sum(r["n_links"] for r in got.values()), sum(count.values()) + 1
    assert 0.99 * true <= found <= true and {i: got[i]["component_id"] for i in want} == want
    assert all(got[i]["n_links"] <= count[i] + (i == 9007) for i in want) and got[None]["component_id"] is None and got[None]["kept"]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for i, r in got.items() if i is not None)
    assert vamana.near_vectors(df.where("vec_id < 0")).count() == 0 and vamana.near_vectors(df.where("vec_id = 9000")).count() == 1


def test_op1_audit_is_by_query(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    vecs = [*(b + rng.normal(size=16) * 0.02 for b in base for _ in range(2)), *(base[0] + rng.normal(size=(60, 16)) * 0.02), *rng.normal(size=(300, 16))]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vecs)]
    unit = np.stack([vamana.unit(v) for v in vecs])
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    true = {i: int(k) for i, k in enumerate(near.sum(axis=1)) if k}
    classes = spark.createDataFrame([(i, 1000 if i in (0, 1) else 1, unit[i].tobytes()) for i in range(len(vecs))], "rep long, w long, vec binary")
    # Only the hot group's links were found: most of all links, few of the queries.
    hot = {i: k for i, k in true.items() if k > 10}
    links = spark.createDataFrame([(i, k, k) for i, k in hot.items()], "rep long, n long, k long")
    assert sum(hot.values()) > 0.9 * sum(true.values())
    recall, linked, drawn = vamana.audit(classes, links, 16, 0.9, queries=40, linked=10**6)
    assert recall == pytest.approx(len(hot) / len(true)) and linked == len(true) and drawn == len(vecs)
    assert vamana.audit(classes.where("rep >= 400"), links, 16, 0.9)[0] is None
    # A search that finds nothing gives way to the comparison of all pairs.
    empty = (links.where("rep < 0"), links.where("rep < 0").select(F.col("rep").alias("a"), F.col("n").alias("b")))
    monkeypatch.setattr(vamana, "_search_links", lambda *a: empty)
    monkeypatch.setattr(vamana, "EXACT_BLOCK", 200)
    out = vamana.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string"))
    got = {r["vec_id"]: r for r in out.collect()}
    assert {i: r["n_links"] for i, r in got.items() if r["n_links"]} == true and out._tidegrid_recall[16][0] == 1.0
    assert {i: r["component_id"] for i, r in got.items()} == components(list(got), list(zip(*(x.tolist() for x in np.nonzero(near)))))


def test_op1_searches_cross_shards(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(500, 16))
    vecs = np.concatenate([base[k] + rng.normal(size=(int(rng.integers(1, 12)), 16)) * 0.12 for k in range(500)] + [base[0] + rng.normal(size=(400, 16)) * 0.15])
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    monkeypatch.setattr(vamana, "SHARD_ROWS", 150)  # some 24 clusters
    monkeypatch.setattr(vamana, "SHARD_MOST", 250)  # of which the dense one is dealt
    monkeypatch.setattr(vamana, "REGION_MOST", 1500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>").repartition(5)
    out = vamana.near_vectors(df)
    got = {r["vec_id"]: r for r in out.collect()}
    found, true = np.array([got[i]["n_links"] for i in range(len(vecs))]), near.sum(axis=1)
    assert out._tidegrid_recall[16][0] >= 0.99 and (found <= true).all() and found.sum() >= 0.99 * true.sum()
    linked = true > 0
    assert np.mean(found[linked] / true[linked]) >= 0.99
    want = components(range(len(vecs)), list(zip(*(x.tolist() for x in np.nonzero(near)))))
    assert np.mean([got[i]["component_id"] == want[i] for i in want]) >= 0.99


def test_op1_all_equal(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 2.0]) for i in range(50)], "vec_id long, embedding array<double>")
    assert {(r["n_links"], r["component_id"], r["kept"]) for r in vamana.near_vectors(df).collect()} == {(49, 0, True), (49, 0, False)}


def test_op1_sends_few_copies_of_vectors(spark, monkeypatch):
    """Regions read the index: no node is sent to each region that holds it, and floats travel as floats."""
    monkeypatch.setattr(vamana, "SHARD_ROWS", 150)  # some 20 clusters
    rng = np.random.default_rng(8)
    vecs = np.repeat(rng.normal(size=(1500, 64)), 2, axis=0).astype(np.float32)
    vecs[1::2] += rng.normal(size=(1500, 64)).astype(np.float32) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = shuffled()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vamana.near_vectors(df).collect()}
    assert sum(v for k, v in shuffled().items() if k not in before) < 5 * vecs.nbytes
    assert got == {i: (1, i - i % 2) for i in range(3000)}


def test_op1_search_of_a_dense_group():
    rng = np.random.default_rng(2)
    center = rng.normal(size=32)
    v = np.concatenate([center + rng.normal(size=(300, 32)) * 0.2, rng.normal(size=(700, 32))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q, x = vamana.Searcher(v, vamana.build_graph(v)).within(v, 0.9)
    true = v @ v.T >= 0.9
    assert true[q, x].all() and len(q) >= 0.98 * true.sum() and len(set(zip(q.tolist(), x.tolist()))) == len(q)


def test_op2_licenses(spark):
    rows = [(1, "Hello\nLicensed under the Apache License, Version 2.0.\nbye bye now", "s"), (2, "released UNDER the mit-license", "s"), (3, None, "s"), (4, "", "s"), (5, "word " * 30_000, "s"), (6, "This program is free", "s"), (1, "x", "s"), (7, licenses.TEMPLATES[7].text.replace("charge", "money"), "s")]
    got = [tuple(r) for r in licenses.scan_licenses(docs(spark, rows)).orderBy("doc_id", "n_lines").collect()]

    def plain(text):
        lines = [] if text is None else text.split("\n")
        units = [(k + 1, x) for k, x in enumerate(lines)] + ([(0, text)] if len(lines) > 1 else [])
        best = None
        for at, u in units:
            p = set(licenses.template_pairs(u))
            for i, t in enumerate(licenses.TEMPLATES):
                q = set(licenses.template_pairs(t.text))
                d = 2 * len(p & q) / (len(p) + len(q))
                if p and d >= 0.8 and (best is None or (d, -at, -i) > best):
                    best = (d, -at, -i)
        return len(lines), best

    want = []
    for i, t, _ in sorted(rows, key=lambda r: (r[0], len((r[1] or "").split("\n")))):
        n, b = plain(t)
        want.append((i, n, licenses.TEMPLATES[-b[2]].name if b else None, b[0] if b else None, -b[1] if b else None, -b[2] if b else None))
    assert got == want
    for n in (2, 9, 40):
        lo, hi = licenses.size_bounds(n, 0.8)
        assert all((2 * min(n, k) >= 0.8 * (n + k)) == (lo <= k <= hi) for k in range(1, 4 * n))


def test_op2_notices_in_longer_texts(spark):
    prose = " ".join(f"word{k} stone{k}" for k in range(150))
    rows, want = [], {}
    for i, t in enumerate(licenses.TEMPLATES):
        wrapped = "\n".join(" * " + " ".join(t.text.split()[k : k + 9]) for k in range(0, len(t.text.split()), 9))
        rows += [(2 * i, f"{prose}\n\n{prose}\n{wrapped}\n{prose}\n" * 2, "s"), (2 * i + 1, f"{prose}\n{prose} {t.text} {prose}", "s")]
        want |= {2 * i: (t.name, 4), 2 * i + 1: (t.name, 2)}
    rows += [(100, f"{prose}\npermission license redistribution\n{prose}", "s")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    for i, (name, line) in want.items():
        assert got[i]["license"] == name and got[i]["line"] == line and got[i]["dice"] >= 0.8, (i, got[i])
    assert got[100]["license"] is None and got[100]["n_lines"] == 3


def test_op3_archives(spark):
    big = "<p>same</p>" * 20
    rows = [(5, "http://a/\r\nX: y z", big, "d"), (3, None, big, "d"), (9, "http://b/é", big, "d"), (4, "u", None, "d"), (6, "u", "", "d"), (7, "u", "short", "d"), (8, "u", "short", "d"), (10, "u", "日本" * 30_000, "d"), (None, "u", big, "d"), (3, None, big, "d")]
    rows += [(100 + k, f"http://c/{k}", f"<html>{k}</html>" * (k % 50), "d") for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = common.new_path(spark, "warc")
    got = [r.asDict() for r in warc.read_archives(spark, path, warc.write_archives(df, path), payloads=True).collect()]
    assert len(got) == len(rows)
    by = {}
    for i, _, h, _ in rows:
        by.setdefault((h or "").encode(), []).append(i)
    for r in got:
        payload = next(p for p, ids in by.items() if r["page_id"] in ids and hashlib.sha256(p).hexdigest() == r["payload_digest"])
        first = min(i for i in by[payload] if i is not None)
        again = len(payload) >= 100 and r["page_id"] != first
        assert r["payload_bytes"] == len(payload) and r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (first if again else None)
        assert r["payload"] == (None if again else payload)
    assert warc.archive_and_read_back(df.where("page_id < 0")).count() == 0
    raw = warc.record_bytes(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    for bad in (raw.replace(b"abc", b"abd"), raw[:-1], raw.replace(b"WARC-Date", b"WARC-Dat"), b"HTTP/1.1 200"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_op4_rules(spark):
    rng = np.random.default_rng(3)
    good = [f"good{k}" for k in range(200)]
    rows = [(i, " ".join(rng.choice(good, 80)), "s") for i in range(80)] + [(i, " ".join(f"{w}###" for w in rng.choice(good, 80)), "s") for i in range(80, 160)]
    rows += [(200, None, "s"), (201, "", "s"), (202, "a b c d e f g h " * 10 + "x", "s"), (203, "one line\n\none line\n \nother", "s"), (204, "q\u00a0r\u2003s " * 30, "s"), (None, rows[0][1], "s"), (205, "word " * 40_000, "s")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(80, 140)] + [(None, 1, 0), (5, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    got = {r["doc_id"]: r for r in quality.judge(df, labels).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        c = collections.Counter(win)
        cover = {k + j for k, x in enumerate(win) if c[x] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and (not r["base_failed"] or not r["kept"])
    assert all(got[i]["kept"] for i in range(80)) and not any(got[i]["kept"] for i in range(80, 160))
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.judge(df, labels.where("doc_id < 0")).where("kept <> (NOT base_failed)").count() == 0
    assert quality.judge(df.where("doc_id < 0"), labels).count() == 0


def near_copies(seed=5):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(12):
        base = [f"v{g}x{k}" for k in rng.integers(0, 300, 120)]
        for _ in range(int(rng.integers(1, 40)) if g else 90):
            t = list(base)
            for k in rng.choice(len(t), int(rng.integers(0, 14)), replace=False):
                t[k] = f"n{rng.integers(0, 10**6)}"
            rows.append((i, " ".join(t), "s"))
            i += 1
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_op5_near_duplicates(spark, k):
    rows = near_copies() + [(1000 + i if i is not None else None, t, s) for i, t, s in corpus(n=20)] + [(2000, "One", "s"), (2001, "one ", "s"), (2002, "two", "s")]
    df = docs(spark, rows)
    got = {r["doc_id"]: r for r in setsketch.near_duplicates(df, k=k).collect()}
    sets = {i: setsketch.shingle_set(common.byte_words(t), k) for i, t, _ in rows}
    ids = [i for i in sets if i is not None]
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and setsketch.similar(sets[a], sets[b], 80)]
    want = components(ids, links)
    assert {i: got[i]["component_id"] for i in ids} == want and {i: got[i]["n_shingles"] for i in ids} == {i: len(sets[i]) for i in ids}
    assert got[None]["component_id"] is None and got[None]["kept"] and got[2001]["component_id"] == 2000
    if k == 5:
        kept = setsketch.keep_one(df, k=k)
        assert kept.columns == df.columns and kept.where("doc_id IS NOT NULL").count() == len(set(want.values()))
        assert setsketch.near_duplicates(df.where("doc_id < 0")).count() == 0


def test_op5_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 600, dtype=np.uint64)
    a, b = x[:500], x[60:]
    assert (np.maximum(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(x)).all()
    j = len(np.intersect1d(a, b)) / len(x)
    est = setsketch.joint_estimate(setsketch.registers(a)[None], setsketch.registers(b)[None], np.array([500.0]), np.array([540.0]))[0]
    assert abs(est - j) < 0.15


def test_op5_links_among_rows():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(4)]
    sets = [np.unique(np.r_[b[: int(rng.integers(200, len(b) + 1))], rng.integers(0, 2**63, int(rng.integers(0, 60)), dtype=np.uint64)]) for b in base for _ in range(25)]
    sets += [np.array([7], np.uint64)] * 2
    labels = np.array([i if i % 3 else 0 for i in range(len(sets))])
    true = [(i, j) for i in range(len(sets)) for j in range(i) if setsketch.similar(set(sets[i].tolist()), set(sets[j].tolist()), 80)]
    same = [(i, 0) for i in range(len(sets)) if labels[i] == 0]
    found = setsketch.links_among(labels, sets, 80)
    found = [x for x in found if tuple(sorted(x, reverse=True)) in set(true)]  # the others miss it by a few members
    assert len(found) < len(sets)
    assert components(range(len(sets)), found + same) == components(range(len(sets)), true + same)


@pytest.mark.parametrize("rows, turns", [(12, 3), (6, 1), (4, 0)])
def test_op5_large_buckets_are_dealt(spark, monkeypatch, rows, turns):
    monkeypatch.setattr(setsketch, "TURNS", turns)
    docs_ = near_copies(9)
    # One passage that all hold: buckets of documents that aren't similar.
    shared = " ".join(f"s{k}" for k in range(150))
    docs_ += [(5000 + i, f"{shared} " + " ".join(f"u{i}x{k}" for k in range(90 + i % 7)), "s") for i in range(60)]
    docs_ += [(6000 + i, docs_[-1 - 2 * i][1] + " tail", "s") for i in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(docs(spark, docs_), k=2, bucket_rows=rows).collect()}
    sets = {i: setsketch.shingle_set(common.byte_words(t), 2) for i, t, _ in docs_}
    ids = list(sets)
    assert got == components(ids, [(a, b) for x, a in enumerate(ids) for b in ids[:x] if setsketch.similar(sets[a], sets[b], 80)])


@pytest.mark.parametrize("head", [1 << 18, 50])
def test_op6_scores(spark, head):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"p{(k * 7 + int(rng.integers(0, 2))) % 90}" for k in range(i % 5, 200 + i % 7)), "s") for i in range(120)] + corpus(n=10)[-9:]
    rows = [(i + 500 if i is not None and i >= 100 and len(t or "") < 10**6 and k >= 120 else i, t, s) for k, (i, t, s) in enumerate(rows)]
    df = docs(spark, rows)
    got = sorted((tuple(r) for r in maxent.score_documents(df, head=head).collect()), key=str)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = [(i, [*common.byte_words(t), b" "]) for i, t, _ in rows]
    c = collections.Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in toks), key=str)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2]))):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out) and all(r[6] < 0 for r in got)
    assert maxent.score_documents(df.where("doc_id < 0"), head=head).count() == 0


def test_op6_probabilities_sum_to_one(spark):
    df = docs(spark, [(i, f"a b a c d {i % 3} e", "s") for i in range(40)])
    counts = common.written(maxent.count_tokens(df.select("text")), "counts")
    model = maxent.train(df.select("text"), maxent.start_model(counts))
    places = dict(zip("acd", model.places(pa.array(["a", "c", "d"], pa.large_string())).tolist()))
    rare = (0.5 / (model.rare_total + 0.5 * (model.distinct - model.n_model + 1)))
    for before in ([], [places["a"]], [places["c"], places["d"]]):
        p = [maxent.log_probabilities(model, np.array([*before, w]), np.array([0]))[-1] for w in range(model.n_model)]
        unknown = maxent.log_probabilities(model, np.array([*before, -1]), np.array([0]))[-1]
        assert sum(10**x for x in p) + 10**unknown * rare == pytest.approx(1, abs=1e-4)


def test_op6_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20, 21, 500):
        mass = rng.integers(1, 1000, n).astype(float)
        nodes, digits, outcomes = maxent.tree(mass, 5)
        paths = [tuple((a, d) for a, d in zip(x, y) if a >= 0) for x, y in zip(nodes.tolist(), digits.tolist())]
        assert len(set(paths)) == n and all(p[0][0] == 0 for p in paths)
        for p, m in zip(paths, mass):
            assert outcomes[p[-1][0], p[-1][1]] == m
            for (a, d), (b, _) in zip(p, p[1:]):
                assert outcomes[a, d] == pytest.approx(outcomes[b].sum())
        assert outcomes[0].sum() == pytest.approx(mass.sum())
        assert max(mass) == 0 or len(paths[int(mass.argmax())]) == min(map(len, paths))


def test_op6_same_weights_in_any_layout(spark):
    df = docs(spark, corpus(n=60)).select("text")
    counts = common.written(maxent.count_tokens(df), "counts")
    one, two = (maxent.train(df.repartition(3, "text").sortWithinPartitions("text"), maxent.start_model(counts), task_tokens=n).table for n in (1500, 1500))
    assert (one == two).all() and np.abs(one).sum() > 0


def test_op6_changes_travel_in_blocks():
    rng = np.random.default_rng(3)
    words, n = pa.array(["a", "b", " "], pa.large_string()), 1 << 13
    model = lambda: maxent.Model("m", type("Sent", (), {"value": words}), 3, 1, np.zeros(3), 1, 3, True, 3, 0, np.zeros((4, 1), np.int32), np.arange(4, dtype=np.int8)[:, None], np.zeros((1, maxent.WIDTH), np.float32), np.zeros((n, maxent.WIDTH), np.float32))
    assert model().places(pa.array(["b", "x", "a", "b"], pa.large_string())).tolist() == [1, -1, 0, 1]
    seen, total, sent = np.zeros(n), np.zeros((n, maxent.WIDTH)), []
    for _ in range(3):
        t = maxent.Trainer(model())
        for _ in range(2):  # a step sums gradients of equal rows, alone or many
            rows, g = np.r_[np.zeros(500, np.int64), rng.integers(0, 3000, 1500)], rng.random((2000, maxent.WIDTH), dtype=np.float32)
            table, squares, sums = t.model.table.copy(), t.squares.copy(), np.zeros((n, maxent.WIDTH))
            np.add.at(sums, rows, g)
            count = np.bincount(rows, minlength=n)
            squares += (sums**2).sum(axis=1) / np.sqrt(np.maximum(count, 1))
            t._step(rows, g)
            assert t.model.table == pytest.approx(table - maxent.RATE * sums / np.sqrt(squares)[:, None], abs=1e-4)
            seen += count
        total += t.model.table * t.seen[:, None]
        sent += t.changes()
    assert sum(b.num_rows for b in sent) <= 3 * -(-3000 // maxent.BLOCK)
    (got,) = maxent.averaged(iter(sent[::-1]))
    mean = np.zeros((n, maxent.WIDTH))
    mean.reshape(-1, maxent.BLOCK, maxent.WIDTH)[got["block"].to_numpy()] = np.frombuffer(b"".join(got["change"].to_pylist()), "<f2").reshape(-1, maxent.BLOCK, maxent.WIDTH)
    assert mean == pytest.approx(total / np.maximum(seen, 1)[:, None], abs=2e-3) and np.abs(mean).sum() > 0


def test_op6_whole_head_has_paths(spark):
    words = [f"w{i}" for i in range(9000)]
    df = docs(spark, [(i, " ".join(words[i::30]) + " a b" * 10, "s") for i in range(30)])
    counts = common.written(maxent.count_tokens(df.select("text")), "counts")
    model = maxent.train(df.select("text"), maxent.start_model(counts), task_tokens=2500)
    ids = np.arange(model.n_head)
    assert model.n_model == model.n_head == model.distinct == 9003 and model.rare_total == 0
    assert len(set(zip(model.nodes[ids, 0].tolist(), map(tuple, model.nodes[ids].tolist()), map(tuple, model.digits[ids].tolist())))) == 9003
    assert len(set(maxent._context(ids, np.array([0]), model.n_model)[0].tolist())) == 9003
    p = maxent.log_probabilities(model, np.r_[ids, -1], np.arange(len(ids) + 1))  # each at a document's start
    assert (10 ** p[:-1]).sum() + 10 ** p[-1] * 0.5 / 0.5 == pytest.approx(1, abs=1e-4)
    assert np.abs(model.table).sum() and len(maxent.score_documents(df).collect()) == 30
    assert [maxent.slices_of(n) for n in (0, 3_000_000, 9_000_000, 96_000_000)] == [(1, 1), (1, 1), (2, 2), (6, 6)]


def encoded(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*x.ids, 2], "<u4") for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXTS = ["", " ", "a  b", " a b ", "x\n y", "x \ny", "a\x1c b", "it's a 'tis I'LL", "<|endoftext|> a <|endoftext|>", "Á é ́x ΑΣ ΟΔΟΣ b", "日本 語 123 4567", "a\tb  c\n\n d", "İI x ﬁ", "\u200b a\u200b b", "\x85 a \x85", "a" * 500 + " b", "THE the The the", None, "First.\n\nSecond", "a\r\nb\r\n\r\nc", "x\n\n\ny", "a <|endoftext|><|startoftext|>b", "<|EndOfText|> a", ".\nB\nc\n\nd"]
#: What fuzzed texts are made of.
BITS = ["\n", "\n\n", "\r\n", " ", "  ", "\t", "\x0b", "\x1f", "\x1c", "\x85", "\u2028", "a", "b", "I", "Hello", "it's", "'ll", "'S", ".", ",", "!", "1", "23", "é", "e\u0301", "日本", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "-", "\u0338", "the", "The", "\u200b", "İ", "\u3000"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_is_exact(name):
    e = tokens.Encoder(public_tokenizers.path(name), cache_items=5)
    texts = TEXTS + [t for _, t, _ in corpus(n=15)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x[:-1].tolist() for x in encoded(name, texts)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("plain", [False, True])
def test_encoding_of_fuzzed_texts_is_exact(name, plain):
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(BITS, rng.integers(0, 14))) for _ in range(20_000)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = plain
    e = tokens.Encoder(public_tokenizers.path(name), cache_items=3000, plain_specials=plain)
    for k in range(0, len(texts), 500):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts[k : k + 500])] == [x.ids for x in t.encode_batch(texts[k : k + 500], add_special_tokens=False)]


def test_encoder_holds_few_strings_and_goes_with_other_tasks(monkeypatch):
    monkeypatch.setattr(tokens, "_STRINGS", 50)
    monkeypatch.setattr(tokens, "_TABLE", 70)
    path, held = public_tokenizers.path("byte_bpe_50k.json"), []
    e, whole = tokens.encoder(path), tokens.Encoder._encoded
    monkeypatch.setattr(tokens.Encoder, "_encoded", lambda self, pieces: held.append(len(pieces)) or whole(self, pieces))
    texts = [" ".join(f"few{k % 97}x{k}" for k in range(i, i + 300)) for i in (0, 200, 0)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x[:-1].tolist() for x in encoded("byte_bpe_50k.json", texts)]
    assert max(held) <= 50 and sum(held) <= len(e.known) > 70  # each once
    common.release_memory()
    assert tokens.encoder(path) is e
    common.release_memory(others=True)
    assert tokens.encoder.cache_info().currsize == 0


def test_op7_packing(spark):
    rows = [*corpus(n=80), *((1000 + k, t, "s1") for k, t in enumerate(TEXTS))]
    got = packing.pack_documents(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 2, 256, block_items=40).toPandas()
    ids = encoded("byte_bpe_50k.json", [t for _, t, _ in rows])
    want = collections.Counter()
    for (i, _, _), x in zip(rows, ids):
        for piece, start, n in packing.cut(len(x), 256):
            want[(i, piece, start, n, zlib.crc32(x[start : start + n].tobytes()))] += 1
    mine = collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert mine == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.cumsum([0, *g["length"]])[:-1]).all() and g["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 256) + 4
    assert packing.pack_documents(docs(spark, rows).where("doc_id < 0"), public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


def test_op7_evolution_never_loses_to_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(5):
        sizes = np.sort(rng.integers(150, 600, 200))[::-1].copy()
        first = packing.seeds(sizes, 1000, 6, rng)
        best = packing.evolve(first, sizes, 1000, 30, rng)[0]
        assert best.max() <= first[0].max() and len(best) == 200 and packing.bin_fills(best, sizes).min() > 0 and packing.bin_fills(best, sizes).max() <= 1000


def triplets(n, capacity, rng):
    """Sizes that fill n bins by threes, without a rest."""
    out = []
    for _ in range(n):
        a = int(rng.integers(int(0.38 * capacity), int(0.49 * capacity)))
        b = int(rng.integers(capacity // 4, (capacity - a) // 2 + 1))
        out += [a, b, capacity - a - b]
    return np.sort(out)[::-1].copy()


def test_op7_evolution_beats_best_fit(spark):
    rng = np.random.default_rng(2)
    for n in (20, 40, 80):
        sizes = triplets(n, 1000, rng)
        first = packing.seeds(sizes, 1000, packing.POPULATION, rng)
        best = packing.evolve(first, sizes, 1000, packing.GENERATIONS, rng)[0]
        assert best.max() + 1 <= n + 1 < min(p.max() + 1 for p in first) and packing.bin_fills(best, sizes).max() <= 1000
    # Islands: the elite of one comes to the next, so more epochs are never worse.
    pieces = spark.createDataFrame([(k, 0, 0, int(x), 0, k) for k, x in enumerate(triplets(60, 1000, rng))], packing._PIECES)
    count = [packing.pack(pieces, 1000, epochs=e, generations=4).select("sequence_id").distinct().count() for e in (1, 4)]
    assert count[1] <= count[0] < 68


def test_op7_fills_as_far_as_can_be():
    sizes = np.array([7, 5, 4, 3, 3])
    for room in range(25):
        best = max(sum(sizes[k] for k in range(5) if m >> k & 1) for m in range(32) if sum(sizes[k] for k in range(5) if m >> k & 1) <= room)
        assert sizes[packing.fullest(list(range(5)), sizes, room)].sum() == best


def test_op8_mix(spark):
    rows = corpus(n=200) + [(300 + k, "few words here", "tiny") for k in range(2)]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total, by = sum(size), collections.Counter()
    for (_, _, s), n in zip(rows, size):
        by[s] += n
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [s for s in by if s is None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, {s for s in order if by[s]}
    while True:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * by[s]}
        if not over:
            break
        target |= {s: 3.0 * by[s] for s in over}
        open_ -= over
    target |= {s: level * w[s] for s in open_} | {s: 0.0 for s in order if not by[s]}
    taken = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 12 for s in order), (taken, target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    out = mixing.mixed_documents(df).collect()
    assert sum(len(WORD.findall(r["text"])) for r in out) == sum(taken.values()) and set(out[0].asDict()) == set(df.columns)
    assert mixing.mix(df.where("doc_id < 0")).count() == 0 and mixing.mix(df.where("text IS NULL OR text = ''")).agg(F.sum("taken")).first()[0] == 0


def test_op8_highest_quotients(spark):
    rng = np.random.default_rng(0)
    for votes, seats in (([100, 80, 30, 20], 8), ([5, 5, 5], 7), (rng.integers(1, 1000, 50).tolist(), 137), ([3.0], 4)):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "i int, votes double")
        got = {r["i"]: r["quota"] for r in mixing.sainte_lague(df, seats, order=("i",)).collect()}
        quota = [0] * len(votes)
        for _ in range(seats):
            quota[max(range(len(votes)), key=lambda i: (votes[i] / (2 * quota[i] + 1), -i))] += 1
        assert list(got.values()) == quota


def test_op9_store(spark):
    rows = corpus(n=60) + [(-5, "first", "s"), (10**12, "last", "s"), *((1000 + k, t, "s1") for k, t in enumerate(TEXTS)), *((None, f"no id {k}", "s") for k in range(3000))]
    df = docs(spark, rows)
    path = common.new_path(spark, "ids")
    manifest = idstore.write_ids(df, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    got = sorted(idstore.read_ids(spark, path, manifest).collect(), key=lambda r: r["start"])
    ids = encoded("word_bpe_49k.json", [t for _, t, _ in rows])
    at, crc = 0, collections.defaultdict(list)
    for (i, _, _), x in zip(rows, ids):
        crc[i].append((len(x), zlib.crc32(x.tobytes())))
    for r in got:
        crc[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        assert r["start"] == at
        at += r["n_tokens"]
    assert not any(crc.values()) and [r["doc_id"] for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
    first = manifest.orderBy("number", "first").first()
    assert idstore.read_one(path, first["file"], 1).tolist() in [x.tolist() for (i, _, _), x in zip(rows, ids) if i is None]
    where, folder = common.filesystem(path)
    with pytest.raises(ValueError):
        list(idstore._read_block(where, folder, first["file"], 0, 1, b"another dictionary"))
    assert idstore.encode_and_read_back(df.where("doc_id < -10"), public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


def test_op10_urls(spark):
    from tidegrid.llm.queries import URL_RULES

    urls = ["http://a.example.com/en/7?x", "http://EXAMPLE.com/en/8#y", "https://com/en/", "http://xcom/en/", "http://b.net/de/8/1", "http://example.net/de/81", "http://x.org/es/", "http://org?/es/", "x.com/en/", None, "", "http://u:p@a.b.c.com/en/x?y://z", "a://b://c.com/en/", "http://net/DE/"]
    rows = [(k, u, "h") for k, u in enumerate(urls)] + [(3, urls[3], "h"), (None, urls[0], "h"), (None, None, "h"), (None, None, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")

    def plain(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
        fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    want = sorted(((i, *plain(u)) for i, u, _ in rows), key=str)
    rules = spark.createDataFrame([(*r, "x") for r in URL_RULES], "host string, path string, verdict string, page_id string")
    for most in (50_000, 0):
        got = sorted((tuple(r)[:5] for r in urlrules.judge_urls(pages, rules, broadcast_rules=most).collect()), key=str)
        assert got == want
    assert urlrules.judge_urls(pages.where("page_id < 0"), rules).count() == 0 and urlrules.judge_urls(pages, rules.where("false")).where("rule IS NOT NULL").count() == 0


def test_op10_rules_of_the_contract(spark, tmp_path):
    from tidegrid.llm import queries

    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{v} {h}{p}" for h, p, v in queries.URL_RULES) == contract
    spark.createDataFrame([(1, "http://b.net/de/7"), (2, "http://example.net/de/8"), (3, "http://example.com/en/71")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op10_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("example.com/en/7", "allow")}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    rows = [(i, t + " " + t.replace("v", "u"), f"s{i % 5}") for i, t, _ in near_copies(6)[:120]] + [(500 + i, " ".join(f"{w}$$$" for w in rng.choice(300, 60)), "s1") for i in range(40)]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 500), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality_rules(spark, df, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in rows if i < 500}
    one = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path))
    sets = {i: setsketch.shingle_set(common.byte_words(t), 5) for i, t, _ in rows if i < 500}
    ids = list(sets)
    want = components(ids, [(a, b) for x, a in enumerate(ids) for b in ids[:x] if setsketch.similar(sets[a], sets[b], 80)])
    assert {r["doc_id"] for r in one.collect()} == set(want.values())
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    mixed = mixing.mixed_documents(one).toPandas()
    pieces = out.groupby("doc_id")["length"].sum().to_dict()
    true = collections.Counter()
    for i, x in zip(mixed["doc_id"], encoded("byte_bpe_50k.json", mixed["text"].tolist())):
        true[i] += len(x)
    assert pieces == dict(true)


def test_op4_score_is_the_ratio(spark):
    """The score against the formula over exact buckets, and the same verdicts under another layout, with more labels than the bound."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.choice([f"{'g' if i % 2 else 'b'}{k}" for k in range(60)] + [f"c{k}" for k in range(60)], 60)), "s") for i in range(300)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(260)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    half = lambda i: zlib.crc32(str(i).encode()) % 2 == 0
    raw, trusted = collections.Counter(), collections.Counter()
    for i, t, _ in rows:
        b = quality.buckets_of(t, quality.BUCKETS).tolist()
        raw.update(b)
        if i < 260 and i % 2 and half(i):
            trusted.update(b)
    n, m, size = sum(raw.values()), sum(trusted.values()), quality.BUCKETS
    for i, t, _ in rows[:20]:
        b = quality.buckets_of(t, size).tolist()
        want = sum(math.log((trusted[x] + 1) / (m + size)) - math.log((raw[x] + 1) / (n + size)) for x in b) / len(b)
        assert model.score(t) == pytest.approx(want, abs=1e-5)
    few = [quality.fit(df.repartition(k, "text"), labels.repartition(k, "doc_id"), labelled=40) for k in (4, 7)]
    assert few[0].threshold == few[1].threshold and (few[0].ratio == few[1].ratio).all()


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "s"), (1, text, "s"), (2, text + " more", None), (None, " ".join(f"x{k}" for k in range(50)), "s"), (3, None, "s"), (4, "", "t"), (5, "few words", "t")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, rep long, label string, kept string"
    full = spark.createDataFrame([(i, t, "en", s, len(t or ""), 0, "x", "x") for i, t, s in rows], kind)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for df, n in ((full, 2), (full.where("false"), 0)):
        kept = corpus_pipeline.quality_rules(spark, df, str(tmp_path))
        assert kept.columns == df.columns and kept.where("text IS NULL OR length(text) < 20").count() == 0
        one = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path))
        assert one.columns == df.columns and one.where("doc_id IS NOT NULL").count() == (1 if n else 0) and one.count() == n
        mixed = corpus_pipeline.mix_sources(spark, one, str(tmp_path))
        assert mixed.columns == df.columns and (mixed.count() > 0) == (n > 0)
        assert (corpus_pipeline.pack_sequences(spark, mixed, str(tmp_path)).count() > 0) == (n > 0)


def piece_ids(texts):
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode([t or "" for t in texts])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_op13_counts(spark, monkeypatch, name):
    rng = np.random.default_rng(3)
    rows = [*corpus(n=40), *((1000 + k, t, "s1") for k, t in enumerate(TEXTS)), (2000, "日本語" * 2000, "s"), (2001, "a \u2581 b \u2581\u2581c " * 300, "s"), (2002, "one <|endoftext|> two  three\n\nfour " * 400, "s")]
    rows += [(3000 + k, "".join(rng.choice(BITS, rng.integers(0, 60))), "s") for k in range(400)]
    texts = [t for _, t, _ in rows]
    path = public_tokenizers.path(name)
    sizes = [len(x) for x in piece_ids(texts)] if name.endswith(".model") else [len(x.ids) for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    want = collections.Counter((i, len((t or "").encode()), n, n > 500) for (i, t, _), n in zip(rows, sizes))
    assert collections.Counter(tuple(r) for r in counts.count_tokens(docs(spark, rows), path, limit=500).collect()) == want
    assert counts.count_tokens(docs(spark, rows).where("doc_id < 0"), path).count() == 0
    # In one process, with small pieces and batches, split at every boundary that is looked for.
    monkeypatch.setattr(counts, "KEPT_STRETCHES", 50)
    own = counts.PieceCounter(path) if name.endswith(".model") else tokens.Encoder(path, cache_items=50)
    for t, n in zip(texts, sizes):
        parts = counts.split_text(t or "", 7)
        assert "".join(parts) == (t or "")
        if not (name.endswith(".model") and "\u2581" in (t or "")):
            parts = [p[1:] if k and name.endswith(".model") else p for k, p in enumerate(parts)]
            assert own.count_column(pa.array(parts)).sum() == n
    assert own.count_column(pa.array([None, "", "a"], pa.string())).tolist()[:2] == [0, 0]


def test_op13_batches_are_balanced():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 3000):
        sizes = rng.integers(0, 5000, n)
        runs = counts.balanced(sizes, 100_000)
        assert [k for a, b in runs for k in range(a, b)] == list(range(n))
        assert all(sizes[a:b].sum() <= 105_000 for a, b in runs)


def brute_alignment(texts):
    """By the bytes of whole texts: a's and b's ranges, groups between common ends, all overlapping pairs."""
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_name, of = {i: t for t, i in a_tok.get_vocab().items()}, align.byte_of_char()
    out, count = [], collections.Counter()
    for t in texts:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        a_bytes = [bytes(of[c] for c in a_name[i]) for i in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        whole = (" " + t).encode() if t else b""
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links = [(i, j) for i, e, x in zip(a, a_ends, a_bytes) for j, f, y in zip(b, b_ends, b_bytes) if e - len(x) < f and f - len(y) < e]
        cuts = sorted(set(a_ends) & set(b_ends))
        at, groups = 0, []
        for c in cuts:
            groups.append(",".join(str(i) for i, e in zip(a, a_ends) if at < e <= c) + "|" + ",".join(str(i) for i, e in zip(b, b_ends) if at < e <= c))
            at = c
        out.append((len(a), len(b), len(groups), links, ";".join(groups)))
        count.update(links)
    best = {}
    for (i, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(a, b, g, len(l), sum(count[x] == best[x[1]] for x in l), sum(count[x] for x in l), hashlib.sha256(s.encode()).hexdigest() if s else "") for a, b, g, l, s in out]


def test_op12_alignment(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [r for r in corpus(n=30) if r[0] != 106] + [(1000 + k, t, "s1") for k, t in enumerate(TEXTS)]
    rows += [(2000, "日本語" * 20, "s"), (2001, "a \u2581 b, c", "s"), (2002, "\u2581", "s"), (2003, "aaaaaaaaaaaaaaaaaaaaa" * 9, "s"), (2004, "Élan,été.\nÀ la;x\nz", "s"), (2005, "<0x0A> <unk></s> 😀😀 ×, a×,", "s"), (2006, "\x00 a\x00", "s")]
    rows += [(3000 + k, "".join(rng.choice([*BITS, "É", "×", "\u2581", "😀", "ing", "tion"], rng.integers(0, 40), p=[0.98 / (len(BITS) + 5)] * len(BITS) + [0.98 / (len(BITS) + 5)] * 2 + [0.02] + [0.98 / (len(BITS) + 5)] * 3)), "s") for k in range(300)]
    want = collections.Counter((i, *x) for (i, _, _), x in zip(rows, brute_alignment([t or "" for _, t, _ in rows])))
    df = docs(spark, rows)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    done = align.align(df, *paths, block_bytes=2000)
    got = done.documents()
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(align, "PAIRS_SENT", 5)  # links and counts are shuffled
    shown = done.documents(with_groups=True).collect()
    assert collections.Counter(tuple(r)[:8] for r in shown) == want
    assert all((hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"] for r in shown)
    assert align.align_documents(df.where("doc_id < 0"), *paths).count() == 0


def edits(w, alphabet):
    """All strings one inserted, deleted or replaced code point away."""
    out = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in alphabet} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in alphabet}
    return out - {w}


def brute_variants(counts):
    alphabet = sorted({c for w in counts for c in w})
    near = {w: [x for x in edits(w, alphabet) if x in counts] for w in counts}
    best = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= 2 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def test_op11_near_words(spark):
    rng = np.random.default_rng(6)
    words = {"".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(600)}
    words |= {"".join(rng.choice(list("abcdefgh"), rng.integers(9, 13))) for _ in range(300)}
    long = "".join(rng.choice(list("abcdefghijk"), 400))
    words |= {long, long[1:], long[:-1], long[:200] + "z" + long[200:], long[:200] + "z" + long[201:], long[:47], long[:48], long[:49], "a" * 50, "a" * 51, "a" * 52, "b" + "a" * 50}
    words |= {w for x in sorted(words)[::7] for w in sorted(edits(x, "aé"))[::5]}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = [tuple(r) for r in variants.near_words(df).collect()]
    alphabet = sorted({c for w in words for c in w})
    want = {(w, x) for w in words for x in edits(w, alphabet) if x in words and w < x}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_op11_variants(spark):
    rng = np.random.default_rng(7)
    # Chains of forms, ties of n, and words on the least counts.
    base = ["".join(rng.choice(list("abcdé"), rng.integers(5, 9))) for _ in range(60)]
    counts = collections.Counter({w: int(2 ** rng.integers(1, 9)) + 1 for w in base})
    for w in base:
        for x in rng.choice(sorted(edits(w, "abé")), 6):
            if len(x) >= 5:
                counts[str(x)] = int(rng.choice([3, 4, 8, 16, 17, 33]))
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    assert {tuple(r) for r in variants.group_variants(df).collect()} == brute_variants(counts)
    assert variants.group_variants(df.where("n < 0")).count() == 0


def test_op11_words_of_documents(spark):
    rows = corpus(n=40) + [(500 + k, t, "s") for k, t in enumerate(["Hello, HELLO hello-hellO", "École école ÉCOLE x", "xÀÿ×÷abcd", "helloworldhelloworld " * 50, "", None, "日本hello日本"] * 3)] + [(None, "nulls nulls nulls Nulls", "s")] * 40
    words = collections.Counter()
    for i, t, _ in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}
    df = docs(spark, rows)
    assert {r["word"]: r["n"] for r in variants.count_words(variants.occurrences(df)).collect()} == want
    assert {tuple(r) for r in variants.spelling_variants(df).collect()} == brute_variants(want)
    plain = {r["word"] for r in variants.occurrences(df, every=0).collect()}
    assert "hello" in plain and None not in plain
    assert variants.spelling_variants(df.where("doc_id < 0")).count() == 0

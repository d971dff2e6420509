import math
import random
import re
from collections import Counter

import numpy as np

from tideline.llm import neardup as N
from tideline.llm.components import components
from tideline.plans.shared import Scratch

SCHEMA = "doc_id long, text string, class_id string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def weighted(texts):
    out, df = [], Counter()
    for t in texts:
        w = words(t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        df.update(c.keys())
        out.append(c)
    n = sum(t is not None for t in texts)
    idf = {s: N.IDF_LEAST + (1 - N.IDF_LEAST) * min(1.0, max(0.0, math.log(max(k - 1, 1e-9) / n) / math.log(N.RARE))) for s, k in df.items()}
    return [{s: (1 + math.log(m)) * idf[s] for s, m in c.items()} for c in out]


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def brute(rows):
    vecs = weighted([t for _, t, *_ in rows])
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if vecs[i] and vecs[j] and (rows[i][1] == rows[j][1] or jaccard(vecs[i], vecs[j]) >= 0.8):
                parent[root(i)] = root(j)
    out = {}
    for k, (d, *_) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        out[k] = min(own) if vecs[k] and own else d
    return sorted(((rows[k][0], c) for k, c in out.items()), key=str)


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, " ".join(w) + rng.choice(["", ".", " !"]), "x"))
            n += 1
    rows += [(n, None, "x"), (n + 1, None, "x"), (n + 2, "", "x"), (n + 3, "?!", "x"), (n + 4, "?!", "x"), (n + 5, "A b", "x"), (n + 6, "a B!", "x"), (None, rows[0][1], "x"), (n + 7, "again " * 300, "x"), (n + 8, "again " * 300, "x"), (n + 8, "again " * 300, "x")]
    return rows


def classes(spark, rows, parts):
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    return sorted(((r.doc_id, r.class_id) for r in got), key=str)


def test_brute_force_however_the_rows_are_dealt(spark):
    rows = corpus(1)
    want = brute(rows)
    assert classes(spark, rows, 3) == want and classes(spark, rows, 1) == want


def chain():
    rng = random.Random(5)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for d in range(60):  # neighbours are near, the ends are far from each other
        w = list(base)
        for k in range(0, d * 2, 3):
            w[k % 120] = f"x{k}"
        rows.append((d, " ".join(w), "x"))
    rng.shuffle(rows)
    return rows


def test_open_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 2000)
    rows = chain()
    assert classes(spark, rows, 2) == brute(rows)


def test_large_buckets_have_several_leads(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAD_TEXTS", 2)
    rows = chain() + [(100 + k, " ".join(f"y{j}" for j in range(80)) + f" end{k}", "x") for k in range(40)]
    assert classes(spark, rows, 2) == brute(rows)


def test_blocks_link_what_all_pairs_link():
    rng = np.random.default_rng(11)
    base = np.unique(rng.integers(0, 1 << 32, 200, dtype=np.int64).astype(np.uint32))
    vecs = []
    for _ in range(60):
        u = np.unique(np.where(rng.random(len(base)) < rng.choice([0.03, 0.1, 0.3]), rng.integers(0, 1 << 32, len(base), dtype=np.int64).astype(np.uint32), base))
        vecs.append((u, rng.choice([0.6, 1.0, 1.7], len(u)).astype(np.float32) if rng.random() < 0.3 else np.ones(len(u), np.float32)))
    for i, (u, w) in enumerate(vecs):  # the definition
        for v, x in vecs[:i]:
            a, b = dict(zip(u.tolist(), w.tolist(), strict=True)), dict(zip(v.tolist(), x.tolist(), strict=True))
            assert abs(N.similarity(u, w, v, x) - jaccard(a, b)) < 1e-6

    def closed(links):
        of = list(range(60))
        for a, b in links:
            of = [min(of[a], of[b]) if x in (of[a], of[b]) else x for x in of]
        return of

    want = closed([(i, j) for i in range(60) for j in range(i) if N.similarity(*vecs[i], *vecs[j]) >= 0.8])
    every = np.ones(60, bool)
    assert 1 < len(set(want)) < 55
    assert closed(N.block_links(vecs, [f"c{k:02}" for k in range(60)], every, every, 0.8)) == want


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["ab", "cde", "fghij"]) + str(rng.randrange(300)) for _ in range(5000)).encode()
    (whole,) = N.shingles_of([text])
    assert (np.sort(N.shingles_of([text, b"x"])[0]) == np.sort(whole)).all()
    assert (N.word_hashes(text, 100) == N.word_hashes(text)).all() and (N.word_hashes(b"a" * 1000 + b" b", 100) == N.word_hashes(b"a" * 1000 + b" b")).all()
    u, tf = np.unique(whole, return_counts=True)
    docs = [(u, 1 + np.log(tf)), (u[::2], np.ones(len(u[::2])))]
    once = N.sample(docs)
    monkeypatch.setattr(N, "SAMPLE_AT_ONCE", 700)
    assert (N.sample(docs) == once).all()


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    hits, want = [], []
    for _ in range(60):
        u = np.unique(rng.integers(0, 1 << 63, 120, dtype=np.int64).astype(np.uint64))
        wa, wb = rng.choice([0.0, 0.7, 1.0, 1.7], len(u)), rng.choice([0.0, 0.7, 1.0, 1.7], len(u))
        a, b = wa > 0, wb > 0
        s = N.sample([(u[a], wa[a]), (u[b], wb[b])])
        hits.append((s[0] == s[1]).mean())
        want.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(hits) - np.mean(want)) < 0.03


def test_dropping_keeps_one_of_each_class(spark):
    rows = corpus(2, 5)
    kept = N.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [d for d, c in brute(rows) if d == c]
    assert sorted((r.doc_id for r in kept), key=str) == sorted(want, key=str) and kept[0].__fields__ == ["doc_id", "text", "class_id"]


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dropping_decides_by_row(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"u{rng.randrange(5000)}" for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    near = b + " more"
    rows = [(1, a), (None, a), (None, c), (None, d), (None, d), (None, None), (None, "?!"), (7, b), (8, e), (8, near), (9, e + " end"), (10, c + " x y"), (10, text())]
    got = N.drop_near_duplicates(spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA).repartition(3)).collect()
    gone = [(None, a), (None, c), (8, near), (9, e + " end")]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted((r for r in rows if r not in gone), key=str)
    # one id on two texts of one class: one of them stays
    got = N.drop_near_duplicates(spark.createDataFrame([(3, b, "x"), (3, near, "x"), (4, b, "x")], SCHEMA)).collect()
    assert len(got) == 1 and got[0].doc_id == 3


def test_counts_do_not_depend_on_the_dealing(spark, monkeypatch):
    monkeypatch.setattr(N, "RARE", 0.02)
    common = "in very many documents stands"
    rows = [(f"a{k} b{k} c{k} d{k} e{k} " + (common if k % 15 == 0 or k == 301 else ""),) for k in range(300)]
    rows += [(f"a{k} b{k} c{k} d{k} e{k} " + (common if k == 301 else ""),) for k in range(300, 600)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "text string")
    for dealt in (docs, docs.coalesce(1)):
        w = N.corpus_weights(dealt)
        (h,) = N.shingles_of([common.encode()])[0]
        want = N.IDF_LEAST + (1 - N.IDF_LEAST) * math.log(20 / 600) / math.log(0.02)
        assert h in w.hashes and abs(w.of(np.array([h], np.uint64))[0] - want) < 1e-9


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (5, 5), (300, 300), (None, 7), (8, None)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()
    want = {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").collect() == []

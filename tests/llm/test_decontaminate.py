import hashlib
import random
import re

import duckdb
import pytest

from tideline.llm import decontaminate as D

SCHEMA = "doc_id long, text string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, window=10):
    out = []
    for d, t in docs:
        w, hit, items, best = words(t), set(), [], 0
        for i, b in bench:
            v = words(b)
            k, found = min(window, len(v)), False
            for a in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[a : a + k]:
                        hit.update(range(p, p + k))
                        found, n = True, k
                        while p + n < len(w) and a + n < len(v) and w[p + n] == v[a + n]:
                            n += 1
                        best = max(best, n)
            if found:
                items.append(str(i))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit), best))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "ab", "É", "7", "Long" * 5, "longlonglonglonglong"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(10, text(14)), (2, "B ab"), (3, None), (4, "!!"), (5, text(11)), (5, "zz yy xx"), (9, "7")]
    docs = [(i, text(rng.randrange(40))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "x " + bench[0][1].upper() + " y. " + bench[4][1]), (102, "x"), (None, "B,AB")]
    return docs, bench


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"window": 3, "shard_bytes": 64}), (3, {"window": 3, "block_bytes": 8}), (4, {"window": 1})])
def test_brute_force(spark, seed, options):
    docs, bench = case(seed)
    d = spark.createDataFrame([(*x, 0) for x in docs], SCHEMA + ", n_hit int").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = D.decontaminate(d, b, **options).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest_match) for r in got), key=str)
    assert got == brute(docs, bench, options.get("window", 10))


def test_empty_tables(spark):
    docs, bench = case(5)
    none_d, none_b = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(none_d, spark.createDataFrame(bench, "item_id long, text string")).collect() == []
    assert not any(r.contaminated for r in D.decontaminate(spark.createDataFrame(docs, SCHEMA), none_b).collect())


def test_removal(spark):
    docs, bench = case(6)
    b = spark.createDataFrame(bench, "item_id long, text string")
    kept = D.remove_contaminated(spark.createDataFrame(docs, SCHEMA), b, shard_bytes=100)
    bad = [(r[0], r[1]) for r in brute(docs, bench) if r[5]]
    want = [x for x in docs if (x[0], len(words(x[1]))) not in bad]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    assert kept.columns == ["doc_id", "text"]


def test_sql_agrees(spark):
    docs, bench = case(7)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", bench)
    assert sorted(con.execute(D.OP8_SQL).fetchall(), key=str) == [r[:6] for r in brute(docs, bench)]

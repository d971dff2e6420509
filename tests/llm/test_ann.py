import duckdb
import numpy as np
from pyspark.sql import functions as F

from tideline.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, rank string"


def inner(x, y):
    out = 0.0
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        out += a * b  # sum() would compensate
    return out


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 5 == 0:
            got = sorted((-inner(x, y), i) for i, y in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in got]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(100, None), (105, [0.0] * 6), (110, [1.0] * 5), (111, [float("nan")] * 6), (112, [float("inf")] + [1.0] * 5), (115, [None] + [1.0] * 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    for options in ({}, {"query_block": 4}, {"k": 3}, {"k": 200}):
        k = options.get("k", 20)
        got = {}
        for r in A.search(df, F.col("vec_id") % 5 == 0, **options).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        want = brute(rows, k)
        assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == want
        assert all([r for r, *_ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_the_layout_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=12).tolist(), "x") for i in range(900)] + [(5, rng.normal(size=12).tolist(), "x")]
    answers = []
    for dealt in (rows, rows[::-1]):
        df = spark.createDataFrame(dealt, "vec_id long, embedding array<double>, rank string").repartition(1 if dealt is rows else 7)
        answers.append(sorted(map(tuple, A.search(df, F.col("vec_id") % 5 == 0, k=5, rerank=5).collect())))
    assert answers[0] == answers[1] and len(answers[0]) == 180 * 5


def test_a_very_common_vector_gives_its_least_ids():
    approx = np.array([1.0, 5, 5, 2, 5, 5, 0])
    assert sorted(A._best(approx, 3).tolist()) == [1, 2, 4] and sorted(A._best(approx, 5).tolist()) == [1, 2, 3, 4, 5]


def test_parallel_residuals_cost_more():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    aware = A.fit(x)
    plain = A.Quantiser(aware.centres, 32, 1.0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(q):
        c = q.codes(x)
        back = np.stack([aware.centres[s][c[:, s]] for s in range(len(aware.centres))], 1).reshape(len(x), -1)[:, :32]
        return (((x - back) * unit).sum(axis=1) ** 2).mean()

    assert along(aware) < 0.9 * along(plain)


def test_recall_and_sql(spark):
    sf = "/root/testdata/sf0.1"
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in A.op7_search(spark, sf).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = {(q, r): (v, s) for q, r, v, s in con.execute(A.OP7_SQL).fetchall()}
    assert got.keys() == want.keys()
    near = {}
    for (q, _), (v, _) in want.items():
        near.setdefault(q, set()).add(v)
    hits = sum(v in near[q] for (q, _), (v, _) in got.items())
    assert hits >= 0.97 * len(want), hits / len(want)
    truth = {(q, v): s for (q, _), (v, s) in want.items()}
    assert all(s == truth[(q, v)] for (q, _), (v, s) in got.items() if (q, v) in truth)


def test_empty(spark):
    assert A.search(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    assert A.search(spark.createDataFrame([(1, [1.0, 2.0], "x")], SCHEMA), F.lit(True)).collect() == []
    assert A.search(spark.createDataFrame([(1, [1.0, 2.0], "x")], SCHEMA), F.lit(None).cast("boolean")).collect() == []

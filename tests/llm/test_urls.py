import random

import numpy as np

from tideline.llm import trees
from tideline.llm import urls as U

SCHEMA = "page_id long, url string"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in U.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


URLS = [None, "", "no scheme.com/en/", "http://", "http://COM/x", "http://a.com", "http://a.com?x=/en/", "http://xcom/", "HTTP://WWW.Example.COM/en/1#top", "http://m.example.com/en/?a=1&b=2", "http://myexample.com/en/", "https://b.net/es/1", "https://b.net/es", "https://net/fr/", "x://y://z.com/fr/#q?", "http://É.com/Ä/\nb", "http://a.org/" + "p/" * 5000, "://c.com/"]


def test_rules_by_brute_force(spark):
    rng = random.Random(3)
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.', 'WWW.'])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(99)}{rng.choice(['', '?a=1', '#top'])}" for _ in range(300)]
    rows = [(k, u) for k, u in enumerate(URLS + made)]
    got = U.judge(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", host string, path2 int").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(dict(rows)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(4)
    url = lambda bad: f"http://{'cheap' if bad else 'news'}{rng.randrange(99)}.{'xyz' if bad and rng.random() < 0.8 else 'org'}/a/{''.join(rng.choice('0123456789') for _ in range(40 if bad else 3))}"
    rows = [(url(k % 3 == 0), k % 3 == 0) for k in range(900)]
    model = U.train(spark.createDataFrame([*rows[:600], (None, True), ("http://q.org/", None)], "url string, block boolean"))
    test = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[600:])], SCHEMA)
    got = {r.page_id: r.verdict == "block" for r in U.judge(test, model, rules=()).collect()}
    assert sum(got[k] == bad for k, (_, bad) in enumerate(rows[600:])) > 0.95 * 300


def test_statistics_cover_all_labelled_urls(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"http://h{rng.randrange(60)}.{'bad' if k % 2 else 'good'}.{rng.choice(['org', 'xyz'])}/p{k}", k % 2 == 1) for k in range(800)]
    df = spark.createDataFrame([*rows, (None, True)], "url string, block boolean")
    model = U.train(df, sample_rows=80)
    want = {}
    for u, b in rows:
        labels = u.split("/")[2].split(".")
        for k in (1, 2):
            n, s = want.get(f"{k}/{'.'.join(labels[-k:])}", (0, 0.0))
            want[f"{k}/{'.'.join(labels[-k:])}"] = n + 1, s + b
    assert model.held == want
    pages = spark.createDataFrame([(k, f"http://new{k}.{'bad' if k % 2 else 'good'}.org/{k}") for k in range(50)] + [(99, None)], SCHEMA)
    held = {r.page_id: (r.verdict, r.block_score) for r in U.judge(pages, model, rules=()).collect()}
    assert all(held[k][0] == ("block" if k % 2 else "allow") for k in range(50))
    monkeypatch.setattr(U, "MAP_ROWS", 2)
    joined = U.UrlModel(model.boosted, model.counts, model.overall)
    assert joined.held is None and {r.page_id: (r.verdict, r.block_score) for r in U.judge(pages, joined, rules=()).collect()} == held


def test_sql_equals_arrays(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k long, a double, b double, c double")
    for model in (trees.boost(x, y), trees.forest(x, y)):
        got = {r.k: r.p for r in df.selectExpr("k", f"{model.sql(['a', 'b', 'c'])} AS p").collect()}
        assert np.allclose([got[k] for k in range(400)], model.probability(x))
        assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_empty_and_one_class(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    only = U.judge(spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (2, "ftp://b.org/")], SCHEMA)).collect()
    assert [r.verdict for r in only] == ["allow"] * 3

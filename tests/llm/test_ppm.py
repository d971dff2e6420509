import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.llm import ppm as P

SCHEMA = "doc_id long, text string, learn boolean, score int"


def rows_of(seed):
    rng = random.Random(seed)
    made = [(k, " ".join(rng.choice(["The", "then", "é", "ab\tc", "x\n", "QQ", "\x0b7"]) for _ in range(rng.randrange(30))), rng.random() < 0.6, 0) for k in range(40)]
    return made + [(50, None, True, 0), (51, "", False, 0), (52, "日本 zz\x00", False, 0), (None, "the then", True, 0), (53, "same", True, 0), (53, "same", True, 0), (54, "x" * 3000, None, 0)]


def brute(rows):
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]
    c, trie = Counter(), P.AdaptiveTrie()
    for _, t, learn, _ in rows:
        if learn:
            c.update(tokens(t))
            trie.code(t or "")
    n, v = sum(c.values()), len(c)
    out = []
    for d, t, learn, _ in rows:
        w = tokens(t)
        out.append((d, bool(learn), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), trie.code(t or "", learn=False)))
    return out


@pytest.mark.parametrize("seed,shard,part", [(1, 200, 300), (2, 1 << 20, 1 << 20), (3, 1, 40)])
def test_brute_force(spark, seed, shard, part):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, P.score(df, F.col("learn"), shard_bytes=shard, part_bytes=part).collect()), key=str)
    for g, w in zip(got, sorted(brute(rows), key=str), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], abs=1e-9)


def test_long_texts_are_cut_into_pieces(monkeypatch):
    raws = [b"", b"abcdefgh" * 20, b"x", b"yz" * 50]
    whole = [(c.tolist(), o.tolist()) for c, o in P._grams(raws)]
    monkeypatch.setattr(P, "CHUNK", 7)
    parts = [(c.tolist(), o.tolist()) for c, o in P._grams(raws)]
    assert len(parts) > 5
    assert [x for c, _ in whole for x in c] == [x for c, _ in parts for x in c]
    assert [x for _, o in whole for x in o] == [x for _, o in parts for x in o]


def test_probabilities_add_up():
    trie = P.AdaptiveTrie()
    trie.code("abracadabra, abracadabra")
    for context in (b"\xff" * 5, b"cabra", b"zzzra", b"zzzzz", b"racad"):
        assert sum(10 ** trie.log10(context, b) for b in range(256)) == pytest.approx(1)


def test_held_out_text_of_the_corpus_is_predicted_better_than_by_words(spark):
    got = P.op10_ppm(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.score(none, F.lit(True)).collect() == []
    r = P.score(spark.createDataFrame([(1, "ab", False, 0)], SCHEMA), F.lit(False)).first()
    assert r.score == pytest.approx(-3 * math.log10(256)) and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0
    assert P.adaptive_scores(spark.createDataFrame([(1, "abab", False, 0)], SCHEMA)).first().score == pytest.approx(P.AdaptiveTrie().code("abab"))

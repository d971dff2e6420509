import random

import pytest

from tideline.llm import lines as L

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least):
    """Every pair of places: the maximal run from there; later copies of runs that count go."""
    docs = sorted({(d if d is not None else 1 << 63, t) for d, t, *_ in rows if t is not None}, key=lambda x: x[0])
    seqs = [[(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" ")] for _, t in docs]
    flat = [(a, i) for a, s in enumerate(seqs) for i in range(len(s))]
    gone = [set() for _ in docs]
    for p, (a, i) in enumerate(flat):
        for b, j in flat[:p]:
            n = words = 0
            while i + n < len(seqs[a]) and j + n < len(seqs[b]) and seqs[a][i + n][1] == seqs[b][j + n][1]:
                words += len(seqs[a][i + n][1].strip(" ").split(" "))
                n += 1
            if words >= least:
                gone[a].update(seqs[a][i + k][0] for k in range(n))
    return {k: "\n".join(x for n, x in enumerate(k[1].split("\n")) if n not in g) for k, g in zip(docs, gone, strict=True)}


def corpus(seed):
    rng = random.Random(seed)
    pool = ["a", "b c", "d e f", "", "g h i j k", "l", "m n o p q r s t", "é ñ"]
    rows = []
    for d in range(25):
        body = [rng.choice(pool) if rng.random() < 0.7 else f"only {d} {k}" for k in range(rng.randrange(14))]
        rows.append((d, "\n".join(body), "x"))
    return rows + [(50, rows[3][1], "x"), (51, rows[3][1] + "\nnew", None), (52, None, "x"), (53, "", "x"), (None, rows[5][1], "x"), (54, "\n".join(["u v w"] * 9), "x")]


@pytest.mark.parametrize("seed,least", [(1, 4), (2, 1), (3, 7), (4, 20), (5, 3)])
def test_brute_force(spark, seed, least):
    rows = corpus(seed)
    got = L.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), min_words=least).collect()
    want = brute(rows, least)
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if text[r.doc_id] is None:
            assert r.text is None and r.n_deleted == r.n_lines == 0
        else:
            assert r.text == want[(r.doc_id if r.doc_id is not None else 1 << 63, text[r.doc_id])], r
            assert r.n_lines == len(text[r.doc_id].split("\n"))


def test_shortest():
    rng = random.Random(1)
    for _ in range(300):
        words, least = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 12)
        for start, n in enumerate(L.shortest(words, least)):
            assert n == next((k for k in range(1, len(words) - start + 1) if sum(words[start : start + k]) >= least), 0)


@pytest.mark.parametrize("seed,rows_a_block,parts", [(6, 1, 7), (7, 3, 5), (8, 17, 2)])
def test_intervals_across_blocks(spark, seed, rows_a_block, parts):
    """A passage in most of the documents, in blocks of a few suffixes."""
    rng = random.Random(seed)
    passage = [f"line {k} of it" for k in range(11)]
    rows = corpus(seed) + [(100 + d, "\n".join([f"own {d}", *passage[rng.randrange(3) : rng.randrange(6, 12)]]), "x") for d in range(30)]
    old = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(old, (rows_a_block, parts, "false"), strict=True):
            spark.conf.set(c, v)
        got = {(r.doc_id, r.n_chars): r.text for r in L.dedup_lines(spark.createDataFrame([(d, t, len(t or "")) for d, t, _ in rows], "doc_id long, text string, n_chars int"), min_words=9).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    want = brute(rows, 9)
    for d, t, _ in rows:
        assert t is None or got[(d, len(t))] == want[(d if d is not None else 1 << 63, t)]


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c d", 7), (1, "a b c d", 7), (2, "x\na b c d", 8)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int"), min_words=3).collect()
    assert sorted((r.doc_id, r.text, r.n_deleted) for r in got) == [(1, "a b c d", 0), (1, "a b c d", 0), (2, "x", 1)]
    assert got[0].__fields__ == ["doc_id", "text", "n_lines", "n_deleted"]


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scripts_without_spaces_tabs_and_frequent_lines(spark):
    cjk, tabs, plain = "汉字文本没有空格" * 6, "\t".join(f"c{k}" for k in range(25)), "x" * 250
    nine = "this nine word line stands in very many documents"
    rows = [(k, f"{x}\nown {k}", "x") for k, x in enumerate((cjk, cjk, tabs, tabs, plain, plain))]
    rows += [(100 + k, f"{nine}\nown {k}\na b c d", "x") for k in range(L.OFTEN)]
    rows += [(1000 + k, f"{nine} twice\nown {k + 500}", "x") for k in range(2)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all(got[k] == f"own {k}" for k in (1, 3, 5)) and all(got[k] == rows[k][1] for k in (0, 2, 4))
    assert got[100] == rows[6][1] and all(got[100 + k] == f"own {k}\na b c d" for k in range(1, L.OFTEN))
    assert all(got[1000 + k] == f"{nine} twice\nown {k + 500}" for k in range(2))

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm import test_decontaminate, test_lines, test_neardup
from tideline.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in ("ther", "ing", "onst", "ble", "wh") for b in ("at", "en", "ow", "ish", "ould", "a", "e")]
    other = ["der", "und", "nicht", "schön", "für", "über", "keit", "heit", "zung", "ßer"]
    line = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    texts = [("\n".join(line(v, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6))), lang) for v, lang in ((vocab, "en"), (other, "de")) for _ in range(25)]
    texts += [(texts[0][0] + "\n" + line(vocab, 12), "en"), (texts[1][0], "en"), (texts[30][0].upper(), None), ("123 --", None), (None, "en"), ("", None)]
    base = line(vocab, 150).split()
    texts += [(" ".join(base[:k] + ["zz"] + base[k:]), "en") for k in (10, 75, 140)]
    bench = [(1, line(vocab, 12)), (2, line(other, 30))]
    texts += [(line(vocab, 30) + " " + bench[0][1] + " end", "en"), (bench[1][1][20:], "de")]
    return [(k, t, lang, "s", len(t) if t else None) for k, (t, lang) in enumerate(texts)], bench


def test_stages_by_brute_force(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # 4: the model is the operator's own; what it rejects goes
    classify = langid.train(docs.where(~langid.is_held_out(docs.doc_id))).classifier()
    judged = {r[0]: classify(r[1]) for r in rows}
    stays = [r for r in rows if judged[r[0]][0] != "und" and not (judged[r[0]][1] < langid.MARGIN and judged[r[0]][2] < langid.MARGIN_BYTES)]
    step = C.identify_language(spark, docs, str(tmp_path))
    assert sorted(map(tuple, step.collect())) == sorted(stays) and step.columns == list(C.COLUMNS)
    assert len(stays) >= len(rows) - 5
    # 3
    new = test_lines.brute(stays, 20)
    stays = [(d, t if new[(d, t)] == t else new[(d, t)], lang, s, n if new[(d, t)] == t else len(new[(d, t)])) for d, t, lang, s, n in stays if new[(d, t)] == t or new[(d, t)].strip()]
    step = C.dedup_lines(spark, step, str(tmp_path))
    assert sorted(map(tuple, step.collect())) == sorted(stays)
    # 2
    keep = {d for d, c in test_neardup.brute(stays) if d == c}
    stays = [r for r in stays if r[0] in keep]
    step = C.drop_near_duplicates(spark, step, str(tmp_path))
    assert sorted(map(tuple, step.collect())) == sorted(stays)
    # 8
    bad = {r[0] for r in test_decontaminate.brute([r[:2] for r in stays], bench) if r[5]}
    assert bad
    stays = [r for r in stays if r[0] not in bad]
    step = C.remove_benchmark(spark, step, str(tmp_path))
    assert sorted(map(tuple, step.collect())) == sorted(stays)
    # 9, and the whole run
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = C.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {r[0]: len(tok.encode(r[1], add_special_tokens=False).ids) + 1 for r in stays}
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]

import random
import unicodedata
import zlib

import pytest
import zstandard

from tideline.llm import langid as L

VOCAB = {"aa": "the and of to in that with from this have", "bb": "der die und nicht ein mit auf für ist zu", "cc": "el los de que en por con para una del"}


def sentence(lang, n, rng):
    return " ".join(rng.choice(VOCAB[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    rows = [(sentence(lang, 60, rng), lang) for lang in VOCAB for _ in range(30)] + [(None, "aa"), ("x y", None), ("", "bb")]
    return L.train(spark.createDataFrame(rows, "text string, lang string"))


def test_accuracy_and_whole_text(spark, model):
    rng = random.Random(1)
    rows = [(k, sentence(lang, n, rng), lang) for k, (lang, n) in enumerate((lang, n) for lang in VOCAB for n in (8, 40, 3000))]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {k: lang for k, _, lang in rows}
    assert all(0 <= r.score <= 1 and not r.rejected for r in got)
    # the end of a text counts as its start does
    mixed = sentence("aa", 10, rng) + " " + sentence("cc", 4000, rng)
    assert L.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().lang_pred == "cc"


def test_no_letters_nulls_and_ties(spark, model):
    rows = [(1, None), (2, ""), (3, "12 -- 3_4 ½ ²"), (4, "zqzq"), (4, "zqzq"), (None, VOCAB["bb"])]
    got = sorted(L.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect(), key=str)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (1, 2, 3))
    assert by[4].lang_pred in VOCAB and by[None].lang_pred == "bb" and len(got) == 6


def test_empty(spark, model):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.identify(docs, model).collect() == []
    none = L.train(spark.createDataFrame([], "text string, lang string"))
    assert L.identify(spark.createDataFrame([(1, "the")], "doc_id long, text string"), none).first().lang_pred == "und"


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    got = L.op4_language(spark, sf)
    held = {r.doc_id: r for r in got.where("held_out").collect()}
    assert all(zlib.crc32(str(d).encode()) % 3 == 1 for d in held)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").collect() if r.doc_id in held}
    assert sum(held[d].lang_pred == lang for d, lang in truth.items()) >= 0.97 * len(truth)


def test_narrow_margins_are_rejected(spark, model):
    rng = random.Random(3)
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(250)) for _ in range(40)]
    mixed = [sentence("aa", n, rng) + " " + sentence("bb", 1200 - n, rng) for n in range(300, 900, 3)]
    clear = [sentence("bb", n, rng) for n in range(20, 2000, 50)]
    classify = model.classifier()
    for texts, share in ((letters, 0.5), (mixed, 0.01), (clear, 0)):
        judged = [classify(t) for t in texts]
        got = {r.doc_id: r.rejected for r in L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
        assert all(got[k] == (score < L.MARGIN) for k, (_, score) in enumerate(judged))
        assert sum(got.values()) >= share * len(texts) and (share or not any(got.values()))


def brute(model, text):
    letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
    if not letters:
        return "und", 0.0
    raw = f" {' '.join(letters)} ".encode()

    def size(lang, data):
        c = zstandard.ZstdCompressor(level=8, dict_data=zstandard.ZstdCompressionDict(dict(model.content)[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        return sum(len(c.compress(data[a : a + 4096])) for a in range(0, len(data), 4096))

    n = {lang: size(lang, raw) for lang in model.languages}
    low = min(n.values())
    best = [lang for lang in n if n[lang] == low]
    if len(best) > 1:
        n = {lang: size(lang, raw * 3) for lang in best}
    first, second = sorted((v, k) for k, v in n.items())[:2]
    return first[1], 1 - first[0] / second[0]


def test_brute_force(spark, model):
    rng = random.Random(8)
    texts = [sentence(rng.choice(list(VOCAB)), rng.choice([1, 2, 5, 40, 900, 5000]), rng) for _ in range(60)]
    texts += [sentence("aa", n, rng) + " " + sentence("cc", n, rng) for n in (1, 3, 50, 700)] + ["Für 3½ DIE", "½ ² Ⅷ 12", "日本語 の", "ß" * 9000, "the\u0301 y"]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        lang, score = brute(model, text)
        assert got[k].lang_pred == lang and abs(got[k].score - score) < 1e-12


def test_whole_texts_are_learnt_from(spark):
    # all begin alike; what tells them apart stands behind
    rng = random.Random(4)
    rows = [(sentence("bb", 500, rng) + " " + sentence(lang, 4000, rng), lang) for lang in ("aa", "cc") for _ in range(30)]
    model = L.train(spark.createDataFrame(rows, "text string, lang string"))
    classify = model.classifier()
    assert all(classify(sentence(lang, 30, rng))[0] == lang for lang in ("aa", "cc"))


def test_clashing_names(spark, model):
    got = L.identify(spark.createDataFrame([(1, VOCAB["aa"], 5, "x", 2.0)], "doc_id long, text string, lang_pred int, score string, rejected double"), model).first()
    assert got.lang_pred == "aa" and 0 <= got.score <= 1 and got.rejected is False

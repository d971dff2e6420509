import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm import packing
from tideline.llm.common import HashTable

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(texts):
    tok = Tokenizer.from_file(PATH)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


ODD = ["", "  ", "It's they'LL don'T 12a3-4 <|endoftext|> x", "Ünïcode ÇA ×÷", "İx Σας ﬁ y\u0085z 日本 é", "tab\tx\x1cy", "a\x00b", "''s !!x", "é", "#12!!ab_c" * 40, "x" * 5000]


def test_encoder_equals_tokenizer():
    texts = ODD + ["The End of, it. 3.14 ñandú ß"] * 3
    for got, want in zip(packing.Encoder(PATH).encode(texts), brute(texts), strict=True):
        assert got.tolist() == want


def test_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE", 5)
    enc = packing.Encoder(PATH)
    for _ in range(3):
        for t in ["alpha beta gamma delta epsilon zeta eta", "theta iota kappa lambda"]:
            assert enc.encode([t])[0].tolist() == brute([t])[0]


@pytest.mark.parametrize("open_windows,length", [(1, 16), (4, 64), (64, 4096)])
def test_pack_round_trip(spark, open_windows, length):
    texts = [*ODD, None, *(f"word{i} " * (i % 97) for i in range(300))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    got = packing.pack(docs, PATH, length=length, open_windows=open_windows, merge_partitions=2, keep_ids=True).collect()
    want = {i: ids for (i, _, _), ids in zip(rows, brute(texts), strict=True)}
    by_doc, by_seq = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, ids.tolist()))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: [x for _, p in sorted(v) for x in p] for d, v in by_doc.items()} == want
    for pieces in by_seq.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length and at & (at - 1) == 0


def test_empty_null_ids_and_repeats(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).collect() == []
    got = packing.pack(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], schema), PATH).collect()
    assert sum(r.length for r in got) == 9 and {r.doc_id for r in got} == {None, 1}
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], schema), PATH, length=100)


def test_hash_table_grows():
    table = HashTable(4)
    keys = np.random.default_rng(0).integers(1, 1 << 63, 5000, dtype=np.int64).astype(np.uint64)
    for k in range(0, 5000, 17):
        table.put(keys[k : k + 17], np.arange(k, min(k + 17, 5000)))
    assert (table.get(keys) == np.arange(5000)).all() and (table.get(keys + np.uint64(1)) == -1).all() and table.count == 5000


def test_very_long_texts(monkeypatch):
    many = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576 % 26)}q" for k in range(200_000))
    monkeypatch.setattr(packing, "_CACHE", 50_000)
    assert len(packing.Encoder(PATH).encode([many])[0]) > 200_000  # more distinct words than the table first holds
    monkeypatch.setattr(packing, "_AT_ONCE", 40)
    texts = [" ".join(ODD), "It's they'LL don'T " * 20, "a" * 100 + " b" * 100, "Σας e\u0301 x \u0301y 日本 z " * 9]
    for t in texts:
        assert packing.Encoder(PATH).encode([t])[0].tolist() == brute([t])[0]


def test_other_tokenizers_encode_as_they_do():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert packing.follows_rules(PATH) and not packing.follows_rules(path)
    for t in ODD:
        assert packing.Encoder(path).encode([t])[0].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]

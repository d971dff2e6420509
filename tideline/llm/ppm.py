"""Language-model scores by prediction by partial matching over bytes.

The trie holds the bytes that followed every context of up to five bytes. A byte is coded in the
longest context that was met; where it wasn't met there, an escape (estimated by the number of
distinct followers, method D) leads to the context one byte shorter, from which the followers already
ruled out are excluded. Below the empty context all bytes left are alike. Text is preceded by five and
followed by one byte 0xFF, which no UTF-8 text has, so a score covers the end of the text as well.

The trie is a set of tables (context and follower, count), one row a node, aggregated from all training
documents; nothing of it is broadcast, as it grows with the corpus. Documents are written once as
compressed shards of about sixteen megabytes, or of one longer text. A shard asks for the distinct six-byte strings and words
that it holds, as sorted arrays dealt by a hash of the key into parts; each part adds up the counts of
its keys, and, when the tables of the trie have given every distinct string its log probability,
answers each shard with an array. A shard's documents are scored from its answers. Shards and parts
grow in number with the corpus, not in size.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, crc_mod, give_back, slices, span_hashes, table
from tideline.plans.shared import Scratch

#: Text of a shard and of what goes to one part, in bytes.
ORDER, SHARD_BYTES, PART_BYTES, CHUNK = 5, 16 << 20, 32 << 20, 1 << 20
_END_WORD = 0x5EED  # the key of the token that ends a text
_WORD, _GRAM = 0, 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _groups(raws: list[bytes]):
    """(place of the first, texts) of about CHUNK bytes each, or of one longer text."""
    group, size, first = [], 0, 0
    for k, raw in enumerate(raws):
        group.append(raw)
        size += len(raw)
        if size >= CHUNK or k + 1 == len(raws):
            yield first, group
            group, size, first = [], 0, k + 1


def _grams(raws: list[bytes]):
    """(codes, owners) of six-byte strings in pieces of about CHUNK bytes; owners are places in raws."""
    for first, group in _groups(raws):
        yield from _pieces(group, first)


def _pieces(group: list[bytes], first: int):
    pad = b"\xff" * ORDER
    data = np.frombuffer(b"".join(pad + r + b"\xff" for r in group), np.uint8)
    sizes = np.array([len(r) + ORDER + 1 for r in group])
    begin = np.cumsum(sizes) - sizes
    real = np.ones(len(data), bool)
    for k in range(ORDER):
        real[begin + k] = False
    for a in range(ORDER, len(data), CHUNK):
        b = min(a + CHUNK, len(data))
        codes = np.zeros(b - a, np.int64)
        for k in range(ORDER + 1):
            codes <<= 8
            codes |= data[a - ORDER + k : b - ORDER + k]
        mine = np.flatnonzero(real[a:b])
        yield codes[mine], np.searchsorted(begin, mine + a, "right") - 1 + first


def _words(raws: list[bytes]):
    """(keys, owners) of the tokens, without ends, in pieces of about CHUNK bytes."""
    for first, group in _groups(raws):
        data = np.frombuffer(b" ".join(r.translate(LOWER) for r in group) + b" ", np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = ~_SPACE[data]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = np.cumsum([0] + [len(r) + 1 for r in group])[:-1]
        yield span_hashes(data, starts, ends).view(np.int64), np.searchsorted(begin, starts, "right") - 1 + first


def _tally(pieces) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts. Pieces are counted and merged as they come, so little more
    than the distinct keys is held."""
    held, size, most = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, CHUNK
    for keys in pieces:
        held.append(np.unique(keys, return_counts=True))
        size += len(held[-1][0])
        if size > most:
            held, size = [_merged(held)], 0
            most = max(CHUNK, len(held[0][0]))
    return _merged(held)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([h[0] for h in held])
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(np.concatenate([h[1] for h in held])[order], first)


_SHARD = "shard long, n int, ids binary, nulls binary, train binary, sizes binary, text binary"
_CELL = "shard long, part long, kind int, keys binary, counts binary"
_ANSWER = "shard long, kind int, keys binary, answers binary"


def _pack(x: np.ndarray) -> bytes:
    """Integers, compressed byte plane by byte plane, as the upper ones are all but empty."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpack(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _keys_out(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _pack(np.diff(keys, prepend=np.int64(0)))


def _keys_in(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.int64))


def _values_out(values: np.ndarray) -> bytes:
    """Doubles as the places of the distinct ones, of which there are few."""
    kinds, place = np.unique(values, return_inverse=True)
    return len(kinds).to_bytes(8, "little") + kinds.tobytes() + _pack(place.astype(np.uint32))


def _values_in(raw: bytes) -> np.ndarray:
    end = 8 + 8 * int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw[8:end], np.float64)[_unpack(raw[end:], np.uint32)]


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return np.mod(keys ^ (keys >> 17) ^ (keys >> 31), parts)


def _part_of(key: Column, parts: int) -> Column:
    """As _part."""
    return F.pmod(key.bitwiseXOR(F.shiftright(key, 17)).bitwiseXOR(F.shiftright(key, 31)), F.lit(parts))


def _shards(size: int):
    """Rows (doc_id, text, train) as compressed shards."""

    def run(batches):
        from pyspark import TaskContext

        base, k, held, total = TaskContext.get().partitionId() << 32, 0, [], 0

        def shard():
            ids, raws, train = ([x for h in held for x in h[c]] for c in range(3))
            row = (base + k, len(ids), np.array([0 if i is None else i for i in ids], np.int64).tobytes(), np.array([i is None for i in ids]).tobytes(), np.array(train, bool).tobytes(), np.array([len(r) for r in raws], np.int64).tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(raws)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], ["shard", "n", "ids", "nulls", "train", "sizes", "text"])

        for batch in slices(batches, (1,), 4 << 20):
            ids, train = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            raws = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            for j, r in enumerate(raws):
                total += len(r)
                if total >= size:
                    held.append((ids[at : j + 1], raws[at : j + 1], train[at : j + 1]))
                    yield shard()
                    k, held, total, at = k + 1, [], 0, j + 1
                    give_back()
            if at < len(raws):
                held.append((ids[at:], raws[at:], train[at:]))
            del ids, train, raws
        if held:
            yield shard()
        held.clear()
        give_back()

    return run


def _open(sizes: bytes, text: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(text)
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _ask(parts: int):
    """What a shard holds, with counts in its training documents, a cell for each part."""

    def cells_of(shard: int, train: bytes, sizes: bytes, text: bytes) -> pa.RecordBatch:
        raws, train = _open(sizes, text), np.frombuffer(train, bool)
        yes, no = ([r for r, t in zip(raws, train, strict=True) if t == kind] for kind in (True, False))
        ends = [np.full(len(yes), _END_WORD, np.int64)], [np.full(1, _END_WORD, np.int64)]
        cells: list[tuple] = []
        for kind, read, more in ((_WORD, _words, ends), (_GRAM, _grams, ([], []))):
            u, n = _tally(chain((k for k, _ in read(yes)), more[0]))
            others = np.setdiff1d(_tally(chain((k for k, _ in read(no)), more[1]))[0], u, assume_unique=True)
            u, n = np.concatenate([u, others]), np.concatenate([n, np.zeros(len(others), np.int64)])
            part = _part(u, parts)
            order = np.lexsort((u, part))
            u, n, part = u[order], n[order], part[order]
            for piece in np.split(np.arange(len(u)), np.flatnonzero(np.diff(part)) + 1):
                if len(piece):
                    cells.append((shard, int(part[piece[0]]), kind, _keys_out(u[piece]), _pack(n[piece].astype(np.int64))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "part", "kind", "keys", "counts"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                out = cells_of(*(batch.column(c)[k].as_py() for c in ("shard", "train", "sizes", "text")))
                give_back()
                yield out

    return run


def _add_up(group):
    """(kind, key, n) over all shards, of one part and kind."""
    keys = [_keys_in(k) for k in group.column("keys").to_pylist()]
    counts = [_unpack(c, np.int64) for c in group.column("counts").to_pylist()]
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
    kind = group.column("kind")[0].as_py()
    return pa.table({"kind": pa.array(np.full(len(u), kind, np.int32)), "key": pa.array(u), "n": pa.array(n)})


def _answer(cells, values):
    """Each cell's keys with their values, of one part and kind."""
    key, value = values.column("key").to_numpy(), values.column("value").to_numpy()
    order = np.argsort(key)
    key, value = key[order], value[order]
    out: list[list] = [[], [], [], []]
    for shard, kind, raw in zip(*(cells.column(c).to_pylist() for c in ("shard", "kind", "keys")), strict=True):
        for c, v in zip(out, (shard, kind, raw, _values_out(value[np.searchsorted(key, _keys_in(raw))])), strict=True):
            c.append(v)
    return pa.table({"shard": pa.array(out[0], pa.int64()), "kind": pa.array(out[1], pa.int32()), "keys": pa.array(out[2], pa.binary()), "answers": pa.array(out[3], pa.binary())})


def _look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of asked keys, all of which are there. keys are sorted."""
    kinds, back = np.unique(asked, return_inverse=True)
    return values[np.searchsorted(keys, kinds)][back]


_SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _score(total: int, kinds: int):
    """Scores of a shard's documents from its answers. total, kinds: tokens and distinct tokens of training."""

    def known(answers, kind):
        rows = [r for r in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "answers")), strict=True) if r[0] == kind]
        keys, values = np.concatenate([_keys_in(r[1]) for r in rows]), np.concatenate([_values_in(r[2]) for r in rows])
        order = np.argsort(keys)
        return keys[order], values[order]

    def run(shards, answers):
        out = scored(shards.to_pylist()[0], answers)
        give_back()
        return out

    def scored(row, answers):
        raws, n = _open(row["sizes"], row["text"]), row["n"]
        ids, nulls, train = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["train"], bool)
        words, grams = known(answers, _WORD), known(answers, _GRAM)
        end = _look(*words, np.array([_END_WORD], np.int64))[0]
        norm = math.log10(total + kinds + 1)
        n_words, base, seen = np.zeros(n), np.full(n, math.log10(end + 1) - norm), np.full(n, float(end > 0))
        for keys, own in _words(raws):
            c = _look(*words, keys)
            n_words += np.bincount(own, minlength=n)
            base += np.bincount(own, np.log10(c + 1) - norm, n)
            seen += np.bincount(own, c > 0, n)
        score = np.zeros(n)
        for codes, own in _grams(raws):
            score += np.bincount(own, _look(*grams, codes), n)
        return pa.table({"doc_id": pa.array(ids, mask=nulls), "train": pa.array(train), "n_tokens": pa.array((n_words + 1).astype(np.int64)), "n_known": pa.array(seen.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def _low(c: Column, size: int) -> Column:
    """The last ``size`` bytes of a code."""
    return c.bitwiseAND(F.lit((1 << (8 * size)) - 1))


def trie(counts: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """From (key, n) of six-byte strings: by order 0 to 5, followers (gram, n) with n > 0, and contexts
    (ctx, t, d, x): their total, distinct followers and, one byte shorter, the total of the same followers."""
    grams: list[DataFrame] = [None] * (ORDER + 1)  # type: ignore[list-item]
    grams[ORDER] = scratch.keep(counts.where("n > 0").select(F.col("key").alias("gram"), "n"), f"gram{ORDER}")
    for j in range(ORDER - 1, -1, -1):
        grams[j] = scratch.keep(grams[j + 1].groupBy(_low(F.col("gram"), j + 1).alias("gram")).agg(F.sum("n").alias("n")), f"gram{j}")
    nodes = []
    for j in range(ORDER + 1):
        own = grams[j].select(F.shiftright("gram", 8).alias("ctx"), "n", _low(F.col("gram"), j).alias("short"))
        if j:
            own = own.join(grams[j - 1].toDF("short", "m"), "short")
        else:
            own = own.withColumn("m", F.lit(0))
        nodes.append(scratch.keep(own.groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("m").alias("x")), f"node{j}"))
    return grams, nodes


def log_probabilities(asked: DataFrame, grams: list[DataFrame], nodes: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(key, value): log10 of the probability of the last byte of each asked string after the others.
    asked: (key, n) with the string's own count, so that only those not met look for shorter ones."""
    done = []
    left = asked.select("key", F.lit(0.0).alias("acc"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("d1"), F.when(F.col("n") > 0, F.col("n")).alias("n"))
    for j in range(ORDER, -1, -1):
        here = left.withColumn("gram", _low(F.col("key"), j + 1)).withColumn("ctx", F.shiftright(F.col("gram"), 8))
        here = (here if j == ORDER else here.join(grams[j], "gram", "left")).join(nodes[j], "ctx", "left")
        t, d = F.coalesce("t", F.lit(0)) - F.col("x1"), F.coalesce("d", F.lit(0)) - F.col("d1")
        here = scratch.keep(here.select("key", "acc", "n", F.greatest(t, F.lit(0)).alias("t"), F.greatest(d, F.lit(0)).alias("d"), F.coalesce("x", F.lit(0)).alias("x1"), F.coalesce(F.col("d"), F.lit(0)).alias("d1")), f"level{j}")
        done.append(here.where("n IS NOT NULL").select("key", (F.col("acc") + F.log10((2 * F.col("n") - 1) / (2 * F.col("t")))).alias("value")))
        escape = F.when(F.col("d") > 0, F.log10(F.col("d") / (2 * F.col("t")))).otherwise(0.0)
        left = here.where("n IS NULL").select("key", (F.col("acc") + escape).alias("acc"), "x1", "d1")
    done.append(left.select("key", (F.col("acc") - F.log10(256 - F.col("d1"))).alias("value")))
    return reduce(DataFrame.union, done)


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    ``train`` tells the rows to learn from; null is no. ``score`` is the log10 probability of the text
    with its end under the trie, ``base_score`` that of its tokens (words between ASCII white space after
    lower-casing A-Z, compared by 64-bit hashes, and an end) under add-one unigram counts.

    A null text is scored and learnt from as an empty one; ids are integers and may be null or repeat, and
    each row counts; texts of any length are read whole; without training rows all bytes are alike and
    base scores are 0; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "ppm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    shards = scratch.keep(rows.mapInArrow(_shards(shard_bytes), _SHARD), "shards")
    n_shards = shards.count()
    if not n_shards:
        return docs.sparkSession.createDataFrame([], _SCORED).select("doc_id", "train", "n_tokens", "n_known", F.lit(0).cast("long").alias("train_tokens"), "base_score", "score")
    parts = max(1, -(-n_shards * shard_bytes // part_bytes))
    # as many tasks as there are groups, so that a task's share doesn't grow with the corpus
    dealt = lambda df: df.repartition(2 * parts, "part", "kind")
    cells = scratch.keep(shards.select("shard", "train", "sizes", "text").mapInArrow(_ask(parts), _CELL), "cells")
    sums = scratch.keep(dealt(cells.select("part", "kind", "keys", "counts")).groupBy("part", "kind").applyInArrow(_add_up, "kind int, key long, n long"), "sums")
    words, counts = (sums.where(F.col("kind") == k).select("key", "n") for k in (_WORD, _GRAM))
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    grams, nodes = trie(counts, scratch)
    values = words.select(F.lit(_WORD).alias("kind"), "key", F.col("n").cast("double").alias("value")).union(log_probabilities(counts, grams, nodes, scratch).select(F.lit(_GRAM), "key", "value"))
    values = values.select(_part_of(F.col("key"), parts).alias("part"), "kind", "key", "value")
    answers = dealt(cells.select("shard", "part", "kind", "keys")).groupBy("part", "kind").cogroup(dealt(values).groupBy("part", "kind")).applyInArrow(_answer, _ANSWER)
    answers = scratch.keep(answers, "answers")
    scratch.drop("cells", "sums", *(f"{t}{j}" for t in ("gram", "node", "level") for j in range(ORDER + 1)))  # nothing reads them any more
    out = shards.repartition(n_shards, "shard").groupBy("shard").cogroup(answers.repartition(n_shards, "shard").groupBy("shard")).applyInArrow(_score(total, kinds), _SCORED)
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


class AdaptiveTrie:
    """The same model, learning each byte after it has coded it; for single texts in plain Python."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.followers: dict[bytes, dict[int, int]] = {}

    def log10(self, context: bytes, byte: int) -> float:
        out, excluded = 0.0, set()
        for j in range(min(self.order, len(context)), -1, -1):
            seen = {b: n for b, n in self.followers.get(context[len(context) - j :], {}).items() if b not in excluded}
            if not seen:
                continue
            t, d = sum(seen.values()), len(seen)
            if byte in seen:
                return out + math.log10((2 * seen[byte] - 1) / (2 * t))
            out += math.log10(d / (2 * t))
            excluded |= seen.keys()
        return out - math.log10(256 - len(excluded))

    def learn(self, context: bytes, byte: int) -> None:
        for j in range(min(self.order, len(context)) + 1):
            node = self.followers.setdefault(context[len(context) - j :], {})
            node[byte] = node.get(byte, 0) + 1

    def code(self, text: str, learn: bool = True) -> float:
        """log10 probability of the text and its end."""
        data, out = b"\xff" * self.order + text.encode() + b"\xff", 0.0
        for k in range(self.order, len(data)):
            context = data[k - self.order : k]
            out += self.log10(context, data[k])
            if learn:
                self.learn(context, data[k])
        return out


def adaptive_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) under a trie of each document's own, which learns as it reads. Byte by byte in
    Python: for small sets of documents."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([AdaptiveTrie().code(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, score double")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    out = score(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

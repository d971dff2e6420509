"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded,
verified by weighted Jaccard similarity.

Weights. A shingle of five words weighs (1 + ln tf) * idf. The idf falls with the logarithm of the share
of documents that hold the shingle, from 1 at ``RARE`` (and below) to ``IDF_LEAST`` at all of them; the
lower bound keeps the members of a very large group of near copies from being torn apart by the
shingles that they share. Only shingles above ``RARE`` need a count. There are at most (shingles a
document) / ``RARE`` of them, however many documents there are, which bounds what travels with the
function. A first pass finds candidates: a shard reports the shingles in more than ``RARE / 2`` of its
documents, and those that may be above ``RARE`` of all, with what other shards may have left out, are
counted exactly in a second pass. So the weights don't depend on how rows are dealt out.

Candidates. A sample of each of 30 hashes; three make a band, ten bands. Everything after works on
one row per different text, whose vector is written once.

Links. In a bucket each text is compared with a lead (a large bucket has several, which are compared
with the bucket's first one), and these links give components. Buckets whose texts are then still in
several components are compared pair by pair across components. Exact bounds leave pairs out: similar
texts have total weights within the threshold, so they are in the same class of weight or in
neighbouring ones; texts of the bucket's largest component needn't meet each other; and the shared
weight is at most that shared by sums over parts of the hash range. What is left is compared in blocks
of ``BLOCK_BYTES`` of vectors, so no pair is a row and no similar pair of a bucket goes unseen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, mix64, run_hashes, slices, span_hashes, table, word_hashes, word_spans
from tideline.llm.components import components
from tideline.plans.shared import Scratch

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 10, 3
RARE, IDF_LEAST = 0.001, 0.6
#: Bytes of text that are worked on at once (shards of counting have as many of them as SHARD_PIECES),
#: elements that are sampled at once, bytes of vectors on one side of a block.
PIECE_BYTES, SHARD_PIECES, SAMPLE_AT_ONCE, BLOCK_BYTES = 1 << 20, 8, 1 << 18, 1 << 20
#: Texts of a bucket that one lead is compared with at least, and parts of the hash range in the bound.
LEAD_TEXTS, BOUND_PARTS = 256, 512

_rng = np.random.default_rng(20240229)
#: Draws of r, ln c (both of Gamma(2, 1)) and beta by 16 bits of a hash.
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LNC = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_BETA = _rng.random(1 << 16, dtype=np.float32)
_ODD = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _sortable(x: np.ndarray) -> np.ndarray:
    """float32 as int64 in the same order, in the high 32 bits."""
    bits = x.astype(np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) << 32


_UNIT = _sortable(_LNC - _R * (1 - _BETA))  # of weight 1, for which t is 0


def shingles_of(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Shingle hashes of each text: of n words, or of all words where there are fewer."""
    if len(texts) == 1:
        words = word_hashes(texts[0].translate(LOWER))
        return [run_hashes(words, n) if len(words) >= n else run_hashes(words, len(words)) if len(words) else words]
    raw = np.frombuffer(b"\n".join(t.translate(LOWER) for t in texts), np.uint8)
    starts, ends = word_spans(raw)
    words = span_hashes(raw, starts, ends)
    first = np.searchsorted(starts, np.append(np.cumsum([0] + [len(t) + 1 for t in texts])[:-1], len(raw) + 1))
    runs, out = run_hashes(words, n), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        out.append(runs[a : b - n + 1] if b - a >= n else run_hashes(words[a:b], int(b - a)) if b > a else runs[:0])
    return out


class Weights:
    """Weight of a shingle from the counts of the common ones."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, documents: int):
        order = np.argsort(hashes)
        share = np.maximum(counts[order] - 1, 1e-9) / max(documents, 1)
        self.hashes = hashes[order]
        self.idf = IDF_LEAST + (1 - IDF_LEAST) * np.clip(np.log(share) / math.log(RARE), 0.0, 1.0)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.ones(len(shingles))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
            hit = self.hashes[at] == shingles
            out[hit] = self.idf[at[hit]]
        return out


def vector(u: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements and their weights, such that weights of shared elements add up to the sum of the lesser
    weights: a shingle of tf m has m elements, the k-th of weight idf * ln(k / (k - 1)), the first idf.
    32 bits of a hash do within a pair; the few elements of a document that share them become one."""
    if len(u) < (n := int(tf.sum())):
        level = np.arange(n) - np.repeat(np.cumsum(tf) - tf, tf) + 1
        hashes = np.repeat(u, tf)
        more = level > 1
        hashes[more] = mix64(hashes[more] + level[more].astype(np.uint64))
        step = np.ones(len(level))
        # up to the k-th these add up to 1 + ln k
        step[more] = np.log(level[more] / (level[more] - 1))
        order = np.argsort(hashes)
        u, idf = hashes[order], (np.repeat(idf, tf) * step)[order]
    short = (u >> np.uint64(32)).astype(np.uint32)
    first = np.ones(len(short), bool)
    np.not_equal(short[1:], short[:-1], out=first[1:])
    return short[first], idf[first].astype(np.float32)


def sample(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Improved consistent weighted samples, a row for each document of distinct shingles and weights."""
    cuts = [(d, a) for d, (u, _) in enumerate(docs) for a in range(0, len(u), SAMPLE_AT_ONCE)]
    out = np.empty((len(docs), len(_ODD)), np.uint64)
    best = np.full((len(docs), len(_ODD)), np.iinfo(np.int64).max)
    k = 0
    while k < len(cuts):
        first, n = k, 0
        while k < len(cuts) and (n == 0 or n + len(docs[cuts[k][0]][0]) <= SAMPLE_AT_ONCE):
            n += min(SAMPLE_AT_ONCE, len(docs[cuts[k][0]][0]) - cuts[k][1])
            k += 1
        keys, got = _sample([tuple(x[a : a + SAMPLE_AT_ONCE] for x in docs[d]) for d, a in cuts[first:k]])
        for row, (d, _) in enumerate(cuts[first:k]):
            less = keys[row] < best[d]
            best[d][less], out[d][less] = keys[row][less], got[row][less]
    return out


def _sample(docs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, the least of which decides, and samples of documents or pieces of them."""
    u = np.concatenate([d[0] for d in docs])
    w = np.concatenate([d[1] for d in docs])
    starts = np.cumsum([0] + [len(d[0]) for d in docs])[:-1]
    place, odd = np.arange(len(u)), np.flatnonzero(w != 1)
    lnw = np.log(w[odd]).astype(np.float32)
    out = np.empty((len(docs), len(_ODD)), np.uint64)
    keys = np.empty((len(docs), len(_ODD)), np.int64)
    for k, a in enumerate(_ODD):
        at = (u * a >> np.uint64(48)).astype(np.int64)
        key = _UNIT[at]
        t = np.zeros(0, np.float32)
        if len(odd):
            r, b = _R[at[odd]], _BETA[at[odd]]
            t = np.floor(lnw / r + b)
            key[odd] = _sortable(_LNC[at[odd]] - r * (t - b + 1))
        least = np.minimum.reduceat(key | place, starts)
        best = least & 0xFFFFFFFF
        keys[:, k] = least >> 32
        got = u[best]
        if len(odd):
            level = np.zeros(len(u), np.float32)
            level[odd] = t
            got = got + level[best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = mix64(got)
    return keys, out


def band_keys(samples: np.ndarray) -> np.ndarray:
    out = np.zeros((len(samples), BANDS), np.uint64)
    for b in range(BANDS):
        for k in range(ROWS):
            out[:, b] = mix64(out[:, b] * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * ROWS + k] + np.uint64(b))
    return out


def similarity(ua: np.ndarray, wa: np.ndarray, ub: np.ndarray, wb: np.ndarray) -> float:
    if len(ua) > len(ub):
        ua, wa, ub, wb = ub, wb, ua, wa
    at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
    hit = ub[at] == ua
    shared = float(np.minimum(wa[hit], wb[at[hit]]).sum(dtype=np.float64))
    return shared / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - shared)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t.encode() for t in batch.column(column).to_pylist()]


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = pieces = 0

    def report() -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n > RARE / 2 * size
        return pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(n[keep].astype(np.int64)), pa.array(np.full(int(keep.sum()), size, np.int64))], ["h", "n", "docs"])

    for piece in slices(batches, (0,), PIECE_BYTES):
        held += [np.unique(s) for s in shingles_of(_texts(piece, 0))]
        size, pieces = size + piece.num_rows, pieces + 1
        if pieces == SHARD_PIECES:
            yield report()
            held, size, pieces = [], 0, 0
    if held:
        yield report()


def _counts(hashes: np.ndarray):
    """Documents of each of these shingles (sorted), a row a task and shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(hashes), np.int64)
        for piece in slices(batches, (0,), PIECE_BYTES):
            for s in shingles_of(_texts(piece, 0)):
                at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                n[np.unique(at[hashes[at] == s])] += 1
        there = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(hashes[there].view(np.int64)), pa.array(n[there])], ["h", "n"])

    return run


def corpus_weights(docs: DataFrame, text_col: str = "text") -> Weights:
    texts = docs.where(F.col(text_col).isNotNull()).select(text_col)
    total = texts.count()
    found = texts.mapInArrow(_common, "h long, n long, docs long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    may = found.where(F.col("n") + RARE / 2 * (total - F.col("docs")) > RARE * total).select("h").toArrow().column(0).to_numpy()
    if not len(may):
        return Weights(np.zeros(0, np.uint64), np.zeros(0), total)
    hashes = np.sort(may.view(np.uint64))
    common = texts.mapInArrow(_counts(hashes), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > RARE * total).toArrow()
    return Weights(common.column(0).to_numpy().view(np.uint64), common.column(1).to_numpy().astype(float), total)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("cid", pa.string()), ("bands", pa.list_(pa.int64())), ("total", pa.float64()), ("u", pa.binary()), ("w", pa.binary()), ("wordless", pa.bool_())])
_SIGNED_SPARK = "doc_id long, cid string, bands array<long>, total double, u binary, w binary, wordless boolean"


def _signatures(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for piece in slices(batches, (2,), PIECE_BYTES):
            cids = piece.column(1).to_pylist()
            fresh = []
            for k, c in enumerate(cids):  # copies met lately are listed without a signature
                if c not in seen:
                    seen.add(c)
                    fresh.append(k)
            if len(seen) > 100_000:
                seen = set()
            cols: list[list] = [[None] * len(cids) for _ in range(4)]
            wordless = [False] * len(cids)
            places, docs = [], []
            for k, s in zip(fresh, shingles_of([piece.column(2)[k].as_py().encode() for k in fresh]), strict=True) if fresh else ():
                if not len(s):
                    wordless[k] = True
                    continue
                u, tf = np.unique(s, return_counts=True)
                idf = weights.of(u)
                short, w = vector(u, tf, idf)
                cols[1][k], cols[2][k] = float(w.sum(dtype=np.float64)), short.tobytes()
                cols[3][k] = None if (w == 1).all() else w.tobytes()
                places.append(k)
                docs.append((u, idf * (1 + np.log(tf))))
            if docs:
                for k, b in zip(places, band_keys(sample(docs)).view(np.int64), strict=True):
                    cols[0][k] = b
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(c, _SIGNED.field(j + 2).type) for j, c in enumerate(cols)), pa.array(wordless, pa.bool_())], schema=_SIGNED)

    return run


def _read(u: bytes, w: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    u = np.frombuffer(u, np.uint32)
    return u, np.ones(len(u), np.float32) if w is None else np.frombuffer(w, np.float32)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, (2, 4), 4 * PIECE_BYTES):
            vecs = (piece.column(k).to_pylist() for k in range(2, 6))
            good = pa.array([similarity(*_read(ua, wa), *_read(ub, wb)) >= threshold - 1e-6 for ua, wa, ub, wb in zip(*vecs, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([piece.column(0).filter(good), piece.column(1).filter(good)], ["a", "b"])

    return run


def block_links(vecs: list[tuple[np.ndarray, np.ndarray]], comps: list[str], left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between rows of left and right (masks; equal masks for a block with itself), of different
    components: at least enough to join what the links between these rows join."""
    parent = {c: c for c in comps}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links, rows, cols = [], np.flatnonzero(left), np.flatnonzero(right)
    total = np.array([w.sum(dtype=np.float64) for _, w in vecs])
    # what two texts share is at most what they share by sums over parts of the hash range
    parts = np.stack([np.bincount(u // np.uint32((1 << 32) // BOUND_PARTS), w, BOUND_PARTS) for u, w in vecs]).astype(np.float32)
    label = np.unique(comps, return_inverse=True)[1]
    for i in rows:
        js = cols[(label[cols] != label[i]) & ((cols > i) | ~left[cols])]
        js = js[np.minimum(total[js], total[i]) >= (threshold - 1e-6) * np.maximum(total[js], total[i])]
        if not len(js):
            continue
        most = np.minimum(parts[js], parts[i]).sum(axis=1, dtype=np.float64)
        js = js[most * (1 + 1e-4) >= (threshold - 1e-6) * (total[js] + total[i] - most)]
        for j in js.tolist():
            a, b = root(comps[i]), root(comps[j])
            if a != b and similarity(*vecs[i], *vecs[j]) >= threshold - 1e-6:
                parent[max(a, b)] = min(a, b)
                links.append((int(i), j))
    return links


def _blocks(threshold: float):
    def run(group):
        cids, comps, mine = (group.column(c).to_pylist() for c in ("cid", "comp", "mine"))
        vecs = [_read(u, w) for u, w in zip(group.column("u").to_pylist(), group.column("w").to_pylist(), strict=True)]
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        mine = np.array(mine)
        links = block_links(vecs, comps, mine == lo, mine == hi, threshold)
        return pa.table({"a": pa.array([cids[i] for i, _ in links], pa.string()), "b": pa.array([cids[j] for _, j in links], pa.string())})

    return run


def _block_rows(placed: DataFrame, threshold: float) -> DataFrame:
    """The texts of open buckets by block: a row for each block that a text is compared in.

    A bucket's texts are parted by class of weight and by whether they are of the bucket's largest
    component, and these again by a hash into parts of about ``BLOCK_BYTES``. Two parts make a block if
    their classes are the same or neighbours and one at least isn't of the largest component.
    """
    bucket = ["band", "key"]
    sizes = placed.groupBy(*bucket, "comp").agg(F.count("*").alias("m"))
    largest = sizes.groupBy(*bucket).agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"))
    step = -math.log(threshold - 2e-6)
    rows = placed.join(largest, bucket).withColumn("kind", 2 * F.floor(F.log("total") / step).cast("int") + F.when(F.col("comp") == F.col("largest"), 1).otherwise(0)).drop("largest")
    kinds = rows.groupBy(*bucket, "kind").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("parts"))
    # a bucket has two kinds for each class of weight, so some tens
    rows = rows.join(kinds.groupBy(*bucket).agg(F.collect_list(F.struct("kind", "parts")).alias("kinds")), bucket)
    code = lambda kind, part: kind.cast("long") * F.lit(1 << 32) + part
    own = F.filter("kinds", lambda s: s["kind"] == F.col("kind"))[0]["parts"]
    rows = rows.withColumn("mine", code(F.col("kind"), F.pmod(F.xxhash64("cid"), own)))
    near = F.filter("kinds", lambda s: (F.abs(F.shiftright(s["kind"], 1) - F.shiftright(F.col("kind"), 1)) <= 1) & ((s["kind"].bitwiseAND(F.lit(1)) == 0) | (F.col("kind").bitwiseAND(F.lit(1)) == 0)))
    others = F.flatten(F.transform(near, lambda s: F.transform(F.sequence(F.lit(0), s["parts"] - 1), lambda j: code(s["kind"], j))))
    out = rows.select(*bucket, "cid", "comp", "mine", F.explode(others).alias("other"))
    return out.select(*bucket, "cid", "comp", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id and class_id, the least id among the documents of its class.

    Classes are the connected components of links between texts whose weighted Jaccard similarity over
    shingles of five words (of all words, for shorter texts) is ``threshold`` or more; equal texts are of
    one class. Words are as in decontamination. A link is found if the texts share a band, which at a
    similarity of 0.8 fails once in a thousand times, and less above.

    A null text, or one without words, is in a class of its own id. Ids are integers; a null id stays
    null and only names a class that has no other. Rows that repeat give a row each, very long texts are
    read whole, an empty table gives no rows, and other columns are not read.
    """
    return _judged(docs, id_col, text_col, threshold).select("doc_id", "class_id")


def _judged(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """doc_id, cid (the MD5 of the text), class_id and stays, a row for each row of ``docs``. The text that
    stays for a class is the least cid of those with the class's id."""
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.col(text_col)).alias("cid"), F.col(text_col).alias("text"))
    weights = corpus_weights(rows)
    signed = scratch.keep(rows.where("text IS NOT NULL").mapInArrow(_signatures(weights), _SIGNED_SPARK), "signed")
    with_vector = signed.where("u IS NOT NULL")
    texts = with_vector.groupBy("cid").agg(F.first("bands").alias("bands"), F.first("total").alias("total"), F.first(F.length("u")).alias("size"))
    texts = scratch.keep(texts, "texts")
    banded = texts.select("cid", "total", "size", F.posexplode("bands").alias("band", "key"))
    lead = banded.groupBy("band", "key").agg(F.min("cid").alias("lead"), F.count("*").alias("n")).where("n > 1")
    # n texts have about sqrt(n / LEAD_TEXTS) leads, so that no lead has a large share of them
    leads = F.ceil(F.sqrt(F.col("n") / LEAD_TEXTS)).cast("int")
    buckets = banded.join(lead, ["band", "key"]).withColumn("leads", leads).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("leads")).cast("int"))
    buckets = scratch.keep(buckets.drop("n"), "buckets")
    wanted = scratch.keep(buckets.select("cid").distinct(), "wanted")
    # one plan at every size: the ids of texts in buckets grow with the documents
    vectors = with_vector.select("cid", "u", "w").join(wanted.hint("merge"), "cid").groupBy("cid").agg(F.first("u").alias("u"), F.first("w").alias("w"))
    vectors = scratch.keep(vectors, "vectors")
    large = buckets.where("leads > 1")
    second = scratch.keep(large.groupBy("band", "key", "part").agg(F.min("lead").alias("lead"), F.min("cid").alias("second")), "second")
    stars = buckets.where("leads = 1").select(F.col("lead").alias("a"), F.col("cid").alias("b"))
    stars = stars.union(large.join(second.drop("lead"), ["band", "key", "part"]).select("second", "cid")).union(second.select("lead", "second"))
    stars = stars.where("a <> b").distinct()
    pairs = stars.join(vectors.toDF("a", "ua", "wa"), "a").join(vectors.toDF("b", "ub", "wb"), "b").select("a", "b", "ua", "wa", "ub", "wb")
    links = scratch.keep(pairs.mapInArrow(_verify(threshold), "a string, b string"), "links")
    comps = components(links, scratch, "star")
    # buckets that are still of several components
    placed = buckets.join(comps.toDF("cid", "label"), "cid", "left").select("band", "key", "cid", "total", "size", F.coalesce("label", "cid").alias("comp"))
    placed = scratch.keep(placed, "placed")
    open_ = placed.groupBy("band", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band", "key")
    waiting = scratch.keep(_block_rows(placed.join(scratch.keep(open_, "open"), ["band", "key"]), threshold), "waiting")
    more = waiting.join(vectors, "cid").groupBy("band", "key", "lo", "hi").applyInArrow(_blocks(threshold), "a string, b string")
    links = scratch.keep(links.union(more), "all")
    comps = components(links, scratch, "final")
    least = scratch.keep(signed.groupBy("cid").agg(F.min("doc_id").alias("least"), F.max("wordless").alias("wordless")), "least")
    of = least.where("NOT wordless").join(comps.toDF("cid", "label"), "cid", "left").select("cid", "least", F.coalesce("label", "cid").alias("label"))
    of = scratch.keep(of, "of")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "cid")).alias("first")
    named = scratch.keep(of.groupBy("label").agg(first).select("label", F.col("first.least").alias("class_id"), F.col("first.cid").alias("kept")), "named")
    classes = scratch.keep(of.join(named, "label").select("cid", "class_id", "kept"), "classes")
    # the rest is still read by what is returned
    scratch.drop_but("signed", "classes")
    stays = F.col("class_id").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("cid") == F.col("kept")))
    with_words = signed.select("doc_id", "cid").join(classes, "cid", "left").select("doc_id", "cid", F.coalesce("class_id", "doc_id").alias("class_id"), stays.alias("stays"))
    return with_words.union(rows.where("text IS NULL").select("doc_id", "cid", F.col("doc_id").alias("class_id"), F.lit(True).alias("stays")))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One text of each class of ``docs``, with its own columns: of the rows with the class's least id the
    one with the least text hash.

    Rows are told apart by id and text together, so neither a null id nor one on several texts takes other
    rows with it. Rows that repeat with one id and text stay as often as they are there; rows without words
    and rows with a null id in a class without other ids stay.
    """
    judged = _judged(docs, id_col, text_col, threshold)
    gone = judged.where("NOT stays").select(F.col("doc_id").alias("__gone"), F.col("cid").alias("__cid")).distinct()
    gone = gone.hint("merge")  # grows with the documents
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(gone["__gone"]) & (F.md5(F.col(text_col)) == gone["__cid"]), "left_anti")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Benchmark decontamination with suffix arrays of the training shards.

Every task turns a few megabytes of documents into one shard: the word sequence of its documents,
without the words that no benchmark item has (no match can hold one, so they act as separators, like
the ends of documents). Prefix doubling sorts the shard's suffixes, and all suffixes of all benchmark
items are found in it by a binary search, which gives the occurrences of every window, the longest
verbatim match of each document and where it stands. Nothing is shuffled: the items travel to the
documents in blocks of ``block_bytes`` at most, and a benchmark of more than one block takes one more
pass over the documents for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import ASCII_LOWER, ASCII_UPPER, LOWER, span_hashes, table, word_spans

WINDOW, SHARD_BYTES, BLOCK_BYTES = 10, 8 << 20, 16 << 20

_STATE = [
    T.StructField("n_words", T.LongType()),
    T.StructField("_hits", T.BinaryType()),
    T.StructField("_items", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()),
    T.StructField("longest_item", T.StringType()),
    T.StructField("longest_start", T.LongType()),
]


class Items:
    """The words of one block of benchmark items, as ids in the order of the block's vocabulary."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        hashes = []
        for _, text in rows:
            raw = np.frombuffer(text.translate(LOWER), np.uint8)
            hashes.append(span_hashes(raw, *word_spans(raw)))
        rows = [r for r, h in zip(rows, hashes, strict=True) if len(h)]
        hashes = [h for h in hashes if len(h)]
        self.names = [r[0] for r in rows]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        sizes = np.array([len(h) for h in hashes], np.int64)
        words = np.searchsorted(self.vocabulary, np.concatenate(hashes)) if hashes else np.zeros(0, np.int64)
        #: Ids from 1; 0 ends each item.
        self.text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(self.text), bool)
        inside[ends] = False
        self.text[inside] = words + 1
        item = np.repeat(np.arange(len(sizes)), sizes + 1)
        span = np.minimum(window, sizes)
        at = np.flatnonzero(inside)
        #: Test suffixes that hold a whole window: where they start, their item, their window's words.
        self.at = at[at + span[item[at]] <= ends[item[at]]]
        self.item = item[self.at]
        self.span = span[self.item]
        self.least = int(span.min()) if len(span) else 0
        self.longest = int(sizes.max()) if len(sizes) else 0


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ids (0 separates) sorted by their first ``depth`` words, by prefix doubling."""
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while k < depth and len(text):
        ahead = np.zeros_like(rank)
        ahead[:-k or None] = rank[k:] + 1
        found, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
        k *= 2
        if len(found) == len(text):
            break
    return np.argsort(rank, kind="stable")


def _below(text: np.ndarray, at: np.ndarray, test: np.ndarray, of: np.ndarray, span: np.ndarray, right: bool) -> np.ndarray:
    """Whether the first span words of text[at:] sort below those of test[of:], or equal if right."""
    out, rows, k = np.full(len(at), right), np.arange(len(at)), 0
    while len(rows):
        a = text[np.minimum(at[rows] + k, len(text) - 1)]
        b = test[of[rows] + k]
        differ = a != b
        out[rows[differ]] = a[differ] < b[differ]
        k += 1
        rows = rows[~differ & (span[rows] > k)]
    return out


def search(text: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix the range of the suffix array whose suffixes start with its window."""
    ends = []
    for right in (False, True):
        lo, hi = np.zeros(len(items.at), np.int64), np.full(len(items.at), len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = _below(text, order[mid], items.text, items.at[open_], items.span[open_], right)
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        ends.append(lo)
    return ends[0], ends[1]


def match_shard(texts: list[bytes], items: Items) -> tuple[np.ndarray, list[np.ndarray], list[set[int]], np.ndarray]:
    """Of every document: words, a mask of hit words, items, and (length, item, start) of its longest match."""
    n = len(texts)
    raw = np.frombuffer(b"\n".join(t.translate(LOWER) for t in texts), np.uint8)
    starts, ends = word_spans(raw)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    first = np.searchsorted(starts, np.append(offsets, len(raw) + 1))
    n_words = np.diff(first)
    mask = np.zeros(len(starts), bool)
    found: list[set[int]] = [set() for _ in range(n)]
    longest = np.zeros((n, 3), np.int64)
    longest[:, 1] = -1
    if items.names and len(starts):
        hashes = span_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
        known = items.vocabulary[at] == hashes
        # maximal runs of known words within a document, of a shortest window at least
        edge = np.zeros(len(starts) + 1, bool)
        edge[first[:-1]] = True
        begin = np.flatnonzero(known & (edge[:-1] | ~np.append(False, known[:-1])))
        stop = np.flatnonzero(known & (edge[1:] | ~np.append(known[1:], False))) + 1
        keep = stop - begin >= items.least
        begin, stop = begin[keep], stop[keep]
        size = stop - begin
        if len(size):
            shift = np.cumsum(size + 1) - (size + 1)
            where = np.repeat(begin - shift, size + 1) + np.arange(int((size + 1).sum()))
            text = at[np.minimum(where, len(starts) - 1)] + 1
            text[shift + size] = 0
            order = suffix_array(text, items.longest)
            lo, hi = search(text, order, items)
            count = hi - lo
            test = np.repeat(np.arange(len(count)), count)
            place = order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            word, span = where[place], items.span[test]
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, word, 1)
            np.add.at(cover, word + span, -1)
            mask = np.cumsum(cover)[:-1] > 0
            doc = np.searchsorted(first, word, "right") - 1
            for d, i in np.unique(np.stack([doc, items.item[test]]), axis=1).T.tolist():
                found[d].add(i)
            length, rows = span.copy(), np.arange(len(span))
            while len(rows):  # past the window
                a = text[np.minimum(place[rows] + length[rows], len(text) - 1)]
                rows = rows[(a > 0) & (a == items.text[items.at[test[rows]] + length[rows]])]
                length[rows] += 1
            best = np.lexsort((word, -length, doc))
            best = best[np.append(True, doc[best][1:] != doc[best][:-1])] if len(best) else best
            longest[doc[best]] = np.stack([length[best], items.item[test[best]], word[best] - first[doc[best]]], 1)
    return n_words, np.split(mask, first[1:-1]), found, longest


def _pass(block: list[tuple[str, bytes]], window: int, shard_bytes: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block, window)
        held: list[pa.RecordBatch] = []
        size = 0

        def shard() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, texts = rows.column(id_col), rows.column(text_col)
            old = {c: rows.column(c).to_pylist() for c in rows.column_names if c not in (id_col, text_col)}
            raw = [(x or "").encode() for x in texts.to_pylist()]
            n_words, masks, found, longest = match_shard(raw, items)
            hits, names, best = [], [], []
            for k in range(len(raw)):
                mask, own = masks[k], [items.names[i] for i in found[k]]
                now = (int(longest[k, 0]), items.names[longest[k, 1]] if longest[k, 1] >= 0 else None, int(longest[k, 2]))
                if old:
                    mask = mask | np.unpackbits(np.frombuffer(old["_hits"][k], np.uint8), count=len(mask)).astype(bool)
                    own += old["_items"][k]
                    now = max((old["longest_match"][k], old["longest_item"][k], old["longest_start"][k] or 0), now, key=lambda x: x[0])
                hits.append(np.packbits(mask).tobytes())
                names.append(own)
                best.append(now)
            return pa.RecordBatch.from_arrays(
                [ids.combine_chunks(), texts.combine_chunks(), pa.array(n_words.tolist(), pa.int64()), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string())), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string()), pa.array([b[2] if b[0] else None for b in best], pa.int64())],
                [id_col, text_col, *(f.name for f in _STATE)],
            )

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= shard_bytes:
                yield shard()
                held, size = [], 0
        if held:
            yield shard()

    return run


def _summary(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in batch.column("_hits").to_pylist()]
            items = [sorted(x) for x in batch.column("_items").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hits], pa.bool_()), *(batch.column(c) for c in ("longest_match", "longest_item", "longest_start"))],
                [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_item", "longest_start"],
            )

    return run


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of block_bytes at most (an item larger than that is a block of its own)."""
    block: list[tuple[str, bytes]] = []
    size = 0
    for name, text in benchmark.select(F.col(item_col).cast("string"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        raw = text.encode()
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append(("" if name is None else name, raw))
        size += len(raw)
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: its words, the words inside benchmark windows and the items found.

    ``longest_match`` is the number of words of the longest verbatim match that holds a window,
    ``longest_item`` its item and ``longest_start`` the document's word at which it starts.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, compared by 64-bit hashes.
    A null or wordless text has no words and no hit; null and wordless items have no window; an item
    with a null id counts under the empty name; repeated rows of documents are judged one by one and
    repeated items count each; an empty benchmark leaves every document clean, empty documents give
    no rows; texts of any length are read whole; further columns of either table are not read.
    """
    out = docs.select(id_col, text_col)
    types = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([types[id_col], types[text_col], *_STATE])
    for block in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        out = out.mapInArrow(_pass(block, window, shard_bytes, id_col, text_col), schema)
    fields = [types[id_col], *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("longest_match", T.LongType()), ("longest_item", T.StringType()), ("longest_start", T.LongType())))]
    return out.mapInArrow(_summary(id_col), T.StructType(fields))


def _clean(block: list[tuple[str, bytes]], window: int, shard_bytes: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block, window)
        held: list[pa.RecordBatch] = []
        size = 0

        def shard() -> list[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            masks = match_shard([(x or "").encode() for x in rows.column(text_col).to_pylist()], items)[1]
            return rows.filter(pa.array([not m.any() for m in masks], pa.bool_())).to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= shard_bytes:
                yield from shard()
                held, size = [], 0
        if held:
            yield from shard()

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark window, with all their columns. Every row
    is judged by itself, so ids may repeat or be null; the other cases are as in :func:`decontaminate`."""
    for block in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(_clean(block, window, shard_bytes, text_col), docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = f"regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
spans AS (SELECT item_id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, list_slice(w, p, p + k - 1) AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM spans)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT r, k, p, list_slice(w, p, p + k - 1) AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, sizes)),
hits AS (SELECT r, p, k, item_id FROM places JOIN windows USING (k, win)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

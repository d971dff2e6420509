"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

1. Every non-blank line becomes an ID. Only lines that occur at least twice can be part of a repeated
   run, so all others are discarded at once and cut the sequences into segments.
2. Prefix doubling: the rank of the 2^(k+1) lines at a position is the rank of its pair (rank of 2^k
   lines here, rank of 2^k lines 2^k further on) among all pairs in sorted order. A global sort deals
   them out by range and numbers them in that order. The last doubling is the sort of the suffixes
   themselves, by pair and place, so a passage of any number of copies is split over tasks.
3. Each block of consecutive suffixes forms the longest common prefixes of neighbours, and from them the
   intervals of every depth. Of an interval's copies the first in place stays. An interval that touches
   an edge of its block may go on in the next, so there the block's first copy is left open: it goes if
   another block has an earlier one, by one row a block and depth.
4. A run counts from ``min_words`` words. A suffix whose longest earlier copy counts loses its first line
   if what follows that line counts as well (it is then decided there), else all lines of the copy.
   Together these are the later copies of exactly the maximal repeated runs that count.

So a suffix need be told apart from others only up to the line where what follows its first has
``min_words`` words: at most ``min_words`` + 1 lines, which the sort goes beyond. The number of rounds
doesn't depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import table
from tideline.plans.shared import Scratch

MIN_WORDS = 20
#: A single line of so many words that occurs so often goes without being part of a long run.
OFTEN_WORDS, OFTEN = 5, 100
#: A line counts as a word at least for every so many characters, and for every two of scripts without spaces.
WORD_CHARS = 12
_SPACELESS = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]"
_LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    """Non-blank lines with their place, ID and words."""
    one = lambda line, at: F.struct(at.cast("int").alias("line"), F.xxhash64(line).alias("id"), _words(line).alias("w"))
    return F.filter(F.transform(F.split(text, "\n"), one), lambda s: s["w"] > 0)


def _words(line: Column) -> Column:
    """Words between spaces or tabs, or what the characters make up for where these are few; 0 for blank lines."""
    bare = F.trim(line)
    size = F.length(bare)
    spaced = size - F.length(F.translate(bare, " \t\u3000", "")) + 1
    # two such characters are four bytes more than characters
    spaceless = F.when(F.octet_length(bare) - size >= 4, F.regexp_count(bare, F.lit(_SPACELESS)) / 2).otherwise(0)
    return F.when(bare == "", 0).otherwise(F.greatest(spaced, size / WORD_CHARS, spaceless)).cast("int")


def _segments(min_words: int):
    """Of each document's repeated lines the stretches of consecutive ones with words enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for d, h, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.sort(key=lambda r: r["i"])
                first = 0
                for k in range(1, len(rows) + 1):
                    if k == len(rows) or rows[k]["i"] != rows[k - 1]["i"] + 1:
                        part = rows[first:k]
                        if sum(r["w"] for r in part) >= min_words:
                            for r in part:
                                for c, v in zip(out, (d, h, part[0]["i"], r["i"], r["line"], r["id"], r["w"]), strict=True):
                                    c.append(v)
                        first = k
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["d", "h", "seg", "i", "line", "id", "w"])

    return run


_SEGMENTS = "d long, h long, seg int, i int, line int, id long, w int"


def shortest(words: list[int], least: int) -> list[int]:
    """For each start how many items have ``least`` words together; 0 where all that follow have fewer."""
    out, total, stop = [], 0, 0
    for start in range(len(words)):
        while stop < len(words) and total < least:
            total += words[stop]
            stop += 1
        out.append(stop - start if total >= least else 0)
        total -= words[start]
    return out


def _suffixes(min_words: int, levels: int):
    """The suffixes of each segment that may have a copy that counts: the pair they are sorted by, the lines
    that tell them apart, from which length a copy counts, and from which it also does without the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _SUFFIX_TYPES]
            for d, h, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.sort(key=lambda r: r["i"])
                least = shortest([r["w"] for r in rows], min_words) + [0]
                for start, row in enumerate(rows):
                    # no other suffix has as many lines in common as the first length that is nowhere repeated
                    if not least[start] or (row["m"] < levels - 1 and least[start] >= 2 << row["m"]):
                        continue
                    left, after = len(rows) - start, start + (1 << (levels - 1))
                    more = least[start + 1] + 1 if least[start + 1] else left + 1
                    told = rows[start : start + min(more, left)]
                    values = (row["last"], rows[after]["last"] if after < len(rows) else -1, d, h, row["i"], least[start], more, [r["r0"] for r in told], [r["line"] for r in told])
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SUFFIX_TYPES.values(), strict=True)], list(_SUFFIX_TYPES))

    return run


_SUFFIX_TYPES = {"a": pa.int64(), "b": pa.int64(), "d": pa.int64(), "h": pa.int64(), "i": pa.int32(), "least": pa.int32(), "more": pa.int32(), "ids": pa.list_(pa.int64()), "lines": pa.list_(pa.int32())}
_SUFFIXES = "a long, b long, d long, h long, i int, least int, more int, ids array<long>, lines array<int>"
_FOUND = "d long, h long, i int, lines array<int>, name array<long>"


def _prefixes(values: np.ndarray, rows: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Of each of the rows of a matrix its first values."""
    inside = np.arange(values.shape[1]) < sizes[:, None]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values[rows][inside], kind))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """A row for each list, -1 beyond its end."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.full((len(sizes), width), -1, np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What goes of each block of sorted suffixes (``name`` null), and what goes if the interval of that name
    has an earlier copy elsewhere."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = {c: batch.column(k) for k, c in enumerate(_SUFFIX_TYPES)}
        d, h, i, least, more = (column[c].to_numpy() for c in ("d", "h", "i", "least", "more"))
        sizes = np.diff(column["ids"].offsets.to_numpy())
        ids = _matrix(column["ids"], int(sizes.max()))
        lines = _matrix(column["lines"], ids.shape[1])
        place = np.empty(len(d), np.int64)
        place[np.lexsort((i, h, d))] = np.arange(len(d))
        same = (ids[1:] == ids[:-1]) & (ids[1:] >= 0)
        common = np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(axis=1)])
        longest = np.zeros(len(d), np.int64)
        edges = []
        for depth in range(1, ids.shape[1] + 1):
            starts = np.flatnonzero(common < depth)
            firsts = np.minimum.reduceat(place, starts)
            longest[place > np.repeat(firsts, np.diff(np.append(starts, len(d))))] = depth
            for first in {0: firsts[0], int(starts[-1]): firsts[-1]}.values():
                edges.append((int(first), depth))
        suffix = np.argsort(place)
        open_ = np.array([(suffix[first], depth) for first, depth in edges], np.int64).reshape(-1, 2)
        at, depth = open_.T
        keep = (depth >= least[at]) & (depth <= sizes[at]) & (depth > longest[at])
        at, depth = at[keep], depth[keep]
        later = np.flatnonzero(longest >= least)
        rows, size = np.concatenate([later, at]), np.concatenate([longest[later], depth])
        names = pa.concat_arrays([pa.nulls(len(later), pa.list_(pa.int64())), _prefixes(ids, at, depth, pa.int64())])
        gone = _prefixes(lines, rows, np.where(size >= more[rows], 1, size), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(d[rows]), pa.array(h[rows]), pa.array(i[rows], pa.int32()), gone, names], ["d", "h", "i", "lines", "name"])


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(d, h, gone): the numbers, from 0, of the lines to delete in the document with id d and text hash h."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(text_col).alias("h"), F.posexplode(_lines(F.col(text_col))).alias("i", "s"))
    lines = scratch.keep(keyed.select("d", "h", "i", "s.line", "s.id", "s.w"), "lines")
    again = scratch.keep(lines.groupBy("id").count().where("count > 1").orderBy("id").select("id", F.monotonically_increasing_id().alias("r0"), "count"), "level0")
    often = lines.where(F.col("w") >= OFTEN_WORDS).join(again.where(F.col("count") >= OFTEN).select("id"), "id")
    often = scratch.keep(often.select("d", "h", "line", "id"), "often")
    lead = often.groupBy("id").agg(F.min(F.struct("d", "h", "line")).alias("first"))
    alone = scratch.keep(often.join(lead, "id").where(F.struct("d", "h", "line") > F.col("first")).select("d", "h", "line"), "alone")
    common = lines.join(again, "id").groupBy("d", "h").agg(F.collect_set(F.struct("i", "line", F.col("r0").alias("id"), "w")).alias("rows"))
    at = scratch.keep(common.select("d", "h", "rows").mapInArrow(_segments(min_words), _SEGMENTS).withColumnRenamed("id", "r0"), "segments")
    scratch.drop("lines", "level0")
    levels = max(min_words, 1).bit_length()
    order = Window.partitionBy("d", "h", "seg").orderBy("i")
    at = at.withColumn("m", F.lit(0)).withColumn("last", F.col("r0"))
    for k in range(levels - 1):
        pairs = scratch.keep(at.withColumn("_next", F.coalesce(F.lead("last", 1 << k).over(order), F.lit(-1).cast("long"))), f"pairs{k}")
        classes = pairs.groupBy("last", "_next").agg((F.count("*") > 1).alias("_again"))
        ranks = scratch.keep(classes.orderBy("last", "_next").select("last", "_next", "_again", F.monotonically_increasing_id().alias("_rank")), f"level{k + 1}")
        joined = pairs.join(ranks, ["last", "_next"]).withColumn("m", F.when(F.col("_again"), k + 1).otherwise(F.col("m")))
        at = scratch.keep(joined.drop("last", "_next", "_again").withColumnRenamed("_rank", "last"), f"ranks{k + 1}")
        scratch.drop(f"pairs{k}", f"level{k + 1}", f"ranks{k}" if k else "segments")
    rows = at.groupBy("d", "h", "seg").agg(F.collect_list(F.struct("i", "line", "w", "m", "r0", "last")).alias("rows"))
    suffixes = scratch.keep(rows.select("d", "h", "rows").mapInArrow(_suffixes(min_words, levels), _SUFFIXES), "suffixes")
    found = scratch.keep(suffixes.orderBy("a", "b", "d", "h", "i").mapInArrow(_intervals, _FOUND), "found")
    edges = found.where("name IS NOT NULL")
    first = edges.groupBy("name").agg(F.min(F.struct("d", "h", "i")).alias("first"))
    late = edges.join(first, "name").where(F.struct("d", "h", "i") > F.col("first"))
    later = found.where("name IS NULL").select("d", "h", "lines").union(late.select("d", "h", "lines"))
    gone = later.select("d", "h", F.explode("lines").alias("line")).union(alone).groupBy("d", "h").agg(F.collect_set("line").alias("gone"))
    gone = scratch.keep(gone, "gone")
    scratch.drop_but("gone")
    return gone


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text, and ``n_lines`` and
    ``n_deleted`` added (or replaced).

    A run is any stretch of consecutive non-blank lines, in one document, of ``min_words`` words (split
    at spaces and tabs; a word at least for 12 characters, or 2 of a script without spaces) or more that
    also occurs elsewhere, or a single line of ``OFTEN_WORDS`` words that occurs ``OFTEN`` times; blank lines within it are passed over and stay, and lines are
    compared by 64-bit hashes of their exact text. Copies are ordered by id (null last), then by hash of
    the text, then by place, and the first stays: also within one document.

    A null text stays null with no lines; an empty one has one (blank) line. Rows that agree in id and
    text are one document: they keep or lose the same lines. Ids are integers. An empty table gives no
    rows; other columns pass through.
    """
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    own = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    keyed = docs.select(*(F.col(f"`{c}`") for c in own), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("__d"), F.xxhash64(F.col(f"`{text_col}`")).alias("__h"))
    # one plan at every size: a broadcast that a larger table would turn into a shuffle helps nobody
    joined = keyed.join(gone.toDF("__gd", "__gh", "__gone").hint("merge"), (F.col("__d") == F.col("__gd")) & (F.col("__h") == F.col("__gh")), "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    kept = F.array_join(F.filter(lines, lambda line, at: ~F.array_contains(F.col("__gone"), at)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(f"`{text_col}`")).otherwise(kept)
    return joined.select(
        *(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in own),
        F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.length(F.col(f"`{text_col}`")) - F.length(F.replace(F.col(f"`{text_col}`"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_deleted"),
    )


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars"), "text")

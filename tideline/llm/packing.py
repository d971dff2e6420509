"""Bounded-space best-fit packing of tokenised documents into sequences.

Each partition keeps ``open_windows`` windows open. A document goes to the window with the least room
that takes it whole; where none does, the fullest window is filled with the document's head and
emitted, and the rest is placed again. So a document is cut only when no open window has room for it,
and an emitted window has no padding. Windows still open at the end of a partition are merged in
groups of partitions of a bounded number and cut anew; what is left of a group is cut at powers of two.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import HashTable, slices, span_hashes, table
from tideline.plans.shared import Scratch

LENGTH, OPEN_WINDOWS, MERGE_PARTITIONS, END_ID = 4096, 64, 8, 2

#: Texts of these characters only are split here as the tokenizer's own rules would: no composition,
#: one-to-one lower case, no other white space, letters or digits, and no quote that could begin a
#: contraction. All others go through the tokenizer as they are.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-&(-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*\Z")
#: Of the bytes of such texts: 0 white space, 1 letters, 2 digits, 3 others, 4 the mark of a text's end.
_KIND = np.array([4 if b == 0 else 0 if b in b"\t\n\x0b\x0c\r " else 2 if 48 <= b <= 57 else 1 if 97 <= b <= 122 or b >= 128 else 3 for b in range(256)], np.int8)
_CACHE = 1_500_000
#: Bytes of text that are encoded at once, and characters of a piece of a longer text.
_AT_ONCE = 1 << 20
#: The rules of the tokenizers that the two shortcuts here, splitting plain texts and cutting
#: long ones before a space, are known to agree with.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}
_CUT = re.compile(r" (?=[0-9A-Za-z])")


def follows_rules(path: str) -> bool:
    """Whether the tokenizer's own description is one that the shortcuts agree with; others encode every
    text as a whole."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model = found["model"]
    return all(found.get(k) == v for k, v in _RULES.items()) and model["type"] == "BPE" and not model.get("dropout") and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in found["added_tokens"])


def _cut_before_spaces(text: str) -> Iterator[str]:
    """A text in pieces of about ``_AT_ONCE`` characters, or more where it has no space to cut before."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + _AT_ONCE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _byte_names() -> dict[int, str]:
    """The printable characters that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Encoder:
    """Ids of whole texts, equal to the tokenizer's, with the ids of each word worked out once."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.shortcuts = follows_rules(path)
        self.names = str.maketrans({chr(b): c for b, c in _byte_names().items()})
        self.end_id = end_id
        self._reset()

    def _reset(self) -> None:
        self.codes = HashTable(22)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.start = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)
        self.used = self.n = 0
        self._add([self.end_id])  # code 0: the mark of a text's end

    def _add(self, ids: list[int]) -> None:
        n, k = self.n, len(ids)
        if n == len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        if self.used + k > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + k, np.uint32)])
        self.flat[self.used : self.used + k] = ids
        self.start[n], self.size[n] = self.used, k
        self.used, self.n = self.used + k, n + 1

    def _code(self, raw: bytes) -> np.ndarray:
        """The code of each word, new ones learnt."""
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        edge = np.empty(len(kind) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[:-1] |= (kind == 2) | (kind == 4)
        at = np.flatnonzero(edge)
        words = kind[at[:-1]] > 0
        starts, ends = at[:-1][words], at[1:][words]
        hashes = span_hashes(data, starts, ends)
        codes = self.codes.get(hashes)
        mark = data[starts] == 0
        codes[mark] = 0
        if (new := np.flatnonzero(codes < 0)).size:
            found, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            model, names, n = self.tokenizer.model, self.names, self.n
            for k in new[first].tolist():
                self._add([t.id for t in model.tokenize(raw[starts[k] : ends[k]].decode("latin-1").translate(names))])
            self.codes.put(found, np.arange(n, self.n))
            codes[new] = n + back
        return codes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with the closing id. A very long text is encoded piece by piece."""
        if self.shortcuts and len(texts) == 1 and len(texts[0]) > _AT_ONCE:
            parts = [self._encode([part])[0][:-1] for part in _cut_before_spaces(texts[0])]
            return [np.concatenate([*parts, np.array([self.end_id], np.uint32)])]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.shortcuts and _PLAIN.match(t) and "<|" not in t]
        for k in set(range(len(texts))).difference(plain):
            out[k] = np.array([*self.tokenizer.encode(texts[k], add_special_tokens=False).ids, self.end_id], np.uint32)
        if plain:
            if self.codes.count > _CACHE:
                self._reset()
            codes = self._code("".join(f"{texts[k].lower()}\x00" for k in plain).encode())
            size = self.size[codes]
            ends = np.cumsum(size)
            ids = self.flat[np.repeat(self.start[codes] - (ends - size).astype(np.int32), size) + np.arange(int(ends[-1]), dtype=np.int32)]
            for k, part in zip(plain, np.split(ids, ends[codes == 0][:-1]), strict=True):
                out[k] = part
        return out


class Packer:
    """Open windows of one partition. A piece is (document, start, ids)."""

    def __init__(self, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.room: list[tuple[int, int]] = []  # (room, window), sorted
        self.windows: dict[int, list] = {}
        self.next = 0

    def add(self, doc, start: int, ids: np.ndarray) -> Iterator[list]:
        """Places the ids; gives the windows that this fills or closes."""
        while len(ids):
            k = bisect.bisect_left(self.room, (len(ids), -1))
            if k == len(self.room) and len(self.room) < self.most:
                window, room = self.next, self.length
                self.next += 1
                self.windows[window] = []
            else:
                room, window = self.room.pop(k if k < len(self.room) else 0)
            n = min(room, len(ids))
            self.windows[window].append((doc, start, ids[:n]))
            start, ids = start + n, ids[n:]
            if room == n:
                yield self.windows.pop(window)
            else:
                bisect.insort(self.room, (room - n, window))

    def rest(self) -> list[list]:
        return [self.windows[w] for _, w in self.room]


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())])
_SPARK = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


def _rows(windows: Iterator[tuple[int, list]], part: int | None, keep_ids: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in _PIECE]
    for sequence, pieces in windows:
        offset = 0
        for (doc, total), start, ids in pieces:
            raw = np.ascontiguousarray(ids, "<u4").tobytes()
            for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, part, raw if keep_ids else None), strict=True):
                c.append(v)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE, strict=True)], schema=_PIECE)


def _pack(path: str, length: int, open_windows: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, packer, n = Encoder(path, end_id), Packer(length, open_windows), 0
        for piece in slices(batches, (1,), _AT_ONCE):
            closed = []
            for doc, ids in zip(piece.column(0).to_pylist(), encoder.encode([x or "" for x in piece.column(1).to_pylist()]), strict=True):
                for window in packer.add((doc, len(ids)), 0, ids):
                    closed.append(((part << 32) + n, window))
                    n += 1
            if closed:
                yield _rows(iter(closed), None, keep_ids)
        if rest := packer.rest():
            yield _rows(((-1, w) for w in rest), part, True)

    return run


def _cut(total: int, length: int) -> list[int]:
    """Whole sequences, then the powers of two that make up what is left."""
    return [length] * (total // length) + [1 << b for b in reversed(range(length.bit_length())) if (total % length) >> b & 1]


def _merge(length: int, keep_ids: bool):
    def run(key, group):
        rows = group.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        base = -(key[0].as_py() + 1 << 32)
        pieces = [((d, t), s, np.frombuffer(i, "<u4")) for d, t, s, i in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids")), strict=True)]
        windows, k = [], 0
        sizes = _cut(sum(len(p[2]) for p in pieces), length)
        for n, room in enumerate(sizes):
            window = []
            while room:
                doc, start, ids = pieces[k]
                take = min(room, len(ids))
                window.append((doc, start, ids[:take]))
                room -= take
                if take == len(ids):
                    k += 1
                else:
                    pieces[k] = (doc, start + take, ids[take:])
            windows.append((base + n, window))
        return pa.Table.from_batches([_rows(iter(windows), None, keep_ids)])

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, open_windows: int = OPEN_WINDOWS, merge_partitions: int = MERGE_PARTITIONS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids; with ``keep_ids`` also each piece's ids.

    The pieces of a sequence stand gapless from offset 0. Every sequence holds ``length`` ids, but for
    those of what is left over, whose sizes are powers of two; so there is no padding to add. ``length``
    is a power of two.

    A null or empty text is its closing id alone; a null id stays null; rows that repeat are packed
    once each; texts of any length are cut as needed; an empty table gives no pieces; further columns
    are not read. Documents are only told apart by their row, so equal ids are no problem.

    Any tokenizer file may be given. One whose rules are those of ``_RULES`` is encoded word by word, and
    very long texts in pieces; others encode each text as a whole.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    scratch = Scratch(docs.sparkSession, "pack")
    first = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pack(tokenizer_path, length, open_windows, end_id, keep_ids), _SPARK)
    pieces = scratch.keep(first, "pieces")
    closed = pieces.where("sequence_id >= 0")
    # at most merge_partitions * open_windows windows meet in one group, however many partitions there are
    rest = pieces.where("sequence_id < 0").groupBy(F.floor(F.col("part") / merge_partitions).alias("g")).applyInArrow(_merge(length, keep_ids), _SPARK)
    out = closed.unionByName(rest).drop("part")
    return out if keep_ids else out.drop("ids")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

"""Language identification by compression against one raw-content dictionary per language.

A text is compressed with each language's zstandard dictionary, and the language whose dictionary makes
it smallest is chosen. It is compressed in pieces of ``PIECE_BYTES``, each from the dictionary anew, so
that the margin means the same for short and long texts: in one go, a long text would soon be told by
itself and all dictionaries would seem alike. The margin is the share saved against the runner-up; a text
with a narrow margin is rejected. Dictionaries come from a bounded sample of labelled rows, picked by a
hash of the text, so the same rows give the same model however they are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import crc_mod, slices, table

#: At most about so many labelled rows a language, so many characters of each from a place given by the
#: text's hash, and so many bytes of dictionary.
SAMPLE_ROWS, SAMPLE_CHARS, DICT_BYTES = 600, 2000, 48 << 10
LEVEL, PIECE_BYTES = 8, 4096
#: Rejected below this share of saving against the runner-up.
MARGIN = 0.01

_NO_LETTER = regex.compile(r"\P{L}+")


def normal(text: str) -> bytes:
    """Lower case, with every run of other characters than letters as one space."""
    return _NO_LETTER.sub(" ", text.lower()).strip().encode()


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary content by language; small enough to travel with the function that uses it."""

    content: tuple[tuple[str, bytes], ...]

    @property
    def languages(self) -> list[str]:
        return [lang for lang, _ in self.content]

    def classifier(self):
        """A function from text to (language, margin)."""
        import zstandard as zstd

        compressors, names = [], self.languages
        for _, raw in self.content:
            held = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            compressors.append(zstd.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

        def sizes(raw: bytes) -> list[tuple[int, int]]:
            pieces = [raw[a : a + PIECE_BYTES] for a in range(0, len(raw), PIECE_BYTES)]
            return sorted((sum(len(c.compress(p)) for p in pieces), k) for k, c in enumerate(compressors))

        def classify(text: str | None) -> tuple[str, float]:
            raw = normal(text) if text else b""
            if not raw or not names:
                return "und", 0.0
            raw = b" " + raw + b" "
            if len(names) == 1:
                return names[0], 1.0
            found = sizes(raw)
            if found[0][0] == found[1][0]:  # sizes are whole bytes; the text said three times over tells finer
                tied = {k for n, k in found if n == found[0][0]}
                found = [f for f in sizes(raw * 3) if f[1] in tied]
            return names[found[0][1]], 1 - found[0][0] / found[1][0]

        return classify


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES) -> LanguageModel:
    """A model from a bounded sample: about ``sample_rows`` rows a language, of each ``sample_chars``
    characters from a place in the whole text that its hash gives, ``dict_bytes`` of dictionary. Rows whose
    text or language is null are not used."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("l")).count().collect()}
    if not counts:
        return LanguageModel(())
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_rows / n))))
    place = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 30))
    start = F.pmod(F.xxhash64(F.lit("place"), F.col(text_col)), F.greatest(F.length(text_col) - sample_chars, F.lit(0)) + 1)
    piece = F.col(text_col).substr((start + 1).cast("int"), F.lit(sample_chars))
    picked = rows.where(place < share[F.col(lang_col)] * (1 << 30)).select(F.col(lang_col).alias("l"), place.alias("p"), piece.alias("t")).distinct()
    held: dict[str, list[tuple[int, str]]] = {}
    for lang, at, text in picked.collect():
        held.setdefault(lang, []).append((at, text))
    content = []
    for lang in sorted(held):
        parts, size = [], 0
        for _, text in sorted(held[lang]):
            raw = normal(text)
            if raw:
                parts.append(raw)
                size += len(raw) + 1
        # an even share of every sampled row where they are more than the dictionary holds
        if size > dict_bytes:
            parts = [p[: max(64, len(p) * dict_bytes // size)] for p in parts]  # still from the hashed place
        content.append((lang, (b" " + b" ".join(parts) + b" ")[:dict_bytes]))
    return LanguageModel(tuple(content))


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected`` added (or replaced).

    The whole text is compressed, whatever its length. A null text, or one without a letter, is
    ``und`` with score 0 and rejected, as is every text under an empty model. A text whose best two
    languages are less than ``margin`` apart is rejected but keeps its best language. The score is the
    margin. Equal sizes go to the first language in alphabetical order. Repeated rows are judged one
    by one; an empty table gives none; other columns pass through.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    docs_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = model.classifier()
        for batch in slices(batches, (docs_at,), 1 << 20):
            found = [classify(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            rejected = [f[0] == "und" or f[1] < margin for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(rejected, pa.bool_())], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 3) == 1, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")

"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its own text. A text belongs to the language whose dictionary
compresses it best; `rejected` marks answers whose margin over the second is narrow. Letter case is folded on both sides.
A text is compressed in pieces, each afresh, and its size is their sum: in one stream its own history would soon replace the
dictionary, and only its first part would tell the languages apart.

The dictionaries come from a bounded sample of the learning rows: for each language at most ``rows`` rows, first those of at
most ``usual`` characters, each by the hash of its id, and at most ``size`` bytes of their texts. Rows whose text or language is null teach nothing.
Null texts, and texts without a letter, are `und` with score 1. With no language learned, every text is `und` with score 0.
Equal sizes go to the language that comes first. Rows that repeat each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skywake.llm.common import batch_of, crc_mod, slices, table

ROWS, USUAL, SIZE, LEVEL = 200, 1_500, 65_536, 6
#: Bytes of a text that are compressed at a time.
PIECE = 4_096
#: An answer is rejected where the second language needs less than this share more.
MARGIN = 0.02
UNKNOWN = "und"

OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def learn(docs: DataFrame, rows: int = ROWS, usual: int = USUAL, size: int = SIZE) -> dict[str, bytes]:
    """A dictionary for each language of `docs` (doc_id, text, lang): at most `rows` times `size` bytes reach the driver a language."""
    order = Window.partitionBy("lang").orderBy(F.length("text") > usual, F.xxhash64("doc_id"), F.xxhash64("text"))
    sample = (
        docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .select("lang", "doc_id", F.substring("text", 1, size).alias("text"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= rows)
        .select("lang", "place", "text")
    )
    texts: dict[str, list] = {}
    for lang, place, text in sample.collect():
        texts.setdefault(lang, []).append((place, text))
    held = {}
    for lang in sorted(texts):
        parts, room = [], size
        for _, text in sorted(texts[lang]):
            part = text.lower().encode()[:room]
            parts.append(part)
            room -= len(part)
        held[lang] = b"\n".join(reversed(parts))
    return held


def predict(docs: DataFrame, dictionaries: dict[str, bytes], held_out, level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and rejected for every row of `docs`."""
    chosen = docs.select("doc_id", "text", held_out.alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = {
            lang: zstandard.ZstdCompressor(
                level=level,
                dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            for lang, content in dictionaries.items()
        }
        for tool in tools.values():
            tool.compress(b"")

        def answer(text: str | None) -> tuple[str, float, bool]:
            if text is None or not any(map(str.isalpha, text)):
                return UNKNOWN, 1.0, False
            if not tools:
                return UNKNOWN, 0.0, True
            data = text.lower().encode()
            parts = [data[start : start + PIECE] for start in range(0, len(data), PIECE)]
            sizes = sorted((sum(len(tool.compress(part)) for part in parts), place, lang) for place, (lang, tool) in enumerate(tools.items()))
            best = sizes[0][0]
            score = 1 / sum((best / size) ** 16 for size, _, _ in sizes)
            return sizes[0][2], score, len(sizes) > 1 and sizes[1][0] < best * (1 + margin)

        for part in slices(batches):
            found = list(map(answer, part["text"]))
            yield batch_of(OUT, doc_id=part["doc_id"], held_out=part["held_out"], lang_pred=[f[0] for f in found],
                           score=[f[1] for f in found], rejected=[f[2] for f in found])

    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    return predict(docs, learn(docs.where(~held_out)), held_out)

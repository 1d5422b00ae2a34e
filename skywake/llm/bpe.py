"""Byte-level BPE by overlapping chunks, and decoding.

A text of up to ``chunk`` characters is encoded where it is read. A longer one is cut into overlapping chunks that are
pre-tokenised as rows of their own. Pre-tokens depend only on what follows them, so from the first boundary that both
neighbours report, the later chunk is right; there the chunks are stitched, and the pieces between stitches are encoded as
rows of their own. Where neighbours share no boundary (a run longer than the overlap) the two are read as one chunk.

Null texts count as empty and give no ids. Rows that repeat, and ids that are null or repeat, each give their own row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.llm.common import batch_of, slices, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHUNK, OVERLAP = 32_768, 1_024

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
CHUNKS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("chunk_no", pa.int32()), ("start", pa.int64()),
                    ("last", pa.bool_()), ("part", pa.string())])
MARKED = CHUNKS.append(pa.field("ends", pa.list_(pa.int64())))
PIECES = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("piece_no", pa.int64()), ("copies", pa.int64()), ("part", pa.string())])


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def ids_of(text: str, path: str) -> bytes:
    return np.array(encoding(path).encode_ordinary(text), "<u4").tobytes()


def boundaries(text: str, last: bool) -> list[int]:
    """Ends of the pre-tokens that what follows `text` can't change, behind a character that isn't white space.

    The pattern looks at most two characters beyond a pre-token. Cut behind other characters, a piece's own end would
    show the pattern a different white space run.
    """
    sure = len(text) if last else len(text) - 2
    return [m.end() for m in pattern().finditer(text) if m.end() <= sure and not text[m.end() - 1].isspace()]


def _schema(arrow: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<long>')}" for f in arrow)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and `ids`, the ids as little-endian unsigned 32-bit integers, of each row's whole text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield batch_of(ENCODED, doc_id=part["doc_id"], ids=[ids_of(t, vocabulary) for t in part["text"]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            text = part["text"][0]
            digest = hashlib.sha256(text.encode()).digest()
            for no, start in enumerate(range(0, len(text), chunk)):
                if no and start + overlap >= len(text):
                    break  # the chunk before reaches the end
                last = start + chunk + overlap >= len(text)
                yield batch_of(CHUNKS, doc_id=part["doc_id"], digest=[digest], chunk_no=[no], start=[start], last=[last],
                               part=[text[start:] if last else text[start : start + chunk + overlap]])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            start, last, text = part["start"][0], part["last"][0], part["part"][0]
            ends = [e for e in boundaries(text, last) if e <= overlap or e >= chunk]
            yield batch_of(MARKED, **part, ends=[[start + e for e in ends]])

    def stitch(group: pa.Table) -> pa.Table:
        held, copies = {}, 0
        for row in group.to_pylist():
            held[row["chunk_no"]] = row
            copies += row["chunk_no"] == 0
        pieces, now, at = [], held[0], 0
        for no in range(1, len(held)):
            nxt = held[no]
            shared = set(nxt["ends"])
            meet = next((e for e in now["ends"] if e > max(at, nxt["start"]) and e in shared), None)
            if meet is None:  # no boundary in common: read both as one
                text = now["part"][at - now["start"] :] + nxt["part"][now["start"] + len(now["part"]) - nxt["start"] :]
                ends = [at + e for e in boundaries(text, nxt["last"])]
                now = {"start": at, "part": text, "ends": ends}
                continue
            pieces.append(now["part"][at - now["start"] : meet - now["start"]])
            now, at = nxt, meet
        pieces.append(now["part"][at - now["start"] :])
        n = len(pieces)
        return pa.table({"doc_id": [held[0]["doc_id"]] * n, "digest": [held[0]["digest"]] * n, "piece_no": range(n),
                         "copies": [copies] * n, "part": pieces}, schema=PIECES)

    def piecewise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16):
            part["part"] = [ids_of(t, vocabulary) for t in part["part"]]
            yield batch_of(pa.schema([*list(PIECES)[:4], pa.field("part", pa.binary())]), **part)

    def join(group: pa.Table) -> pa.Table:
        parts = sorted(zip(group["piece_no"].to_pylist(), group["part"].to_pylist(), strict=True))
        ids, n = b"".join(p for _, p in parts), group["copies"][0].as_py()
        return pa.table({"doc_id": [group["doc_id"][0].as_py()] * n, "ids": [ids] * n}, schema=ENCODED)

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, _schema(ENCODED))
    long = (
        rows.where(F.length("text") > chunk)
        .mapInArrow(cut, _schema(CHUNKS))
        .repartition("digest", "doc_id", "chunk_no")
        .mapInArrow(mark, _schema(MARKED))
        .groupBy("doc_id", "digest")
        .applyInArrow(stitch, _schema(PIECES))
        .repartition("digest", "doc_id", "piece_no")
        .mapInArrow(piecewise, "doc_id long, digest binary, piece_no long, copies long, part binary")
        .groupBy("doc_id", "digest")
        .applyInArrow(join, _schema(ENCODED))
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`encoded` with `decoded`, the bytes of its ids one behind the other; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                held = [None if ids is None else tokens.decode_bytes(np.frombuffer(ids, "<u4").tolist()) for ids in part["ids"].to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(held, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

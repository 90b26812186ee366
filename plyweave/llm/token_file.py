"""Token ids on disk: frequency-ranked, in byte-aligned variable-length code with separate control bytes.

A folder holds ``ranks`` (the vocabulary by falling corpus frequency) and ``blocks``.  A block is one byte
string: a header, the documents' ids and token counts, the control bytes (four 2-bit lengths each) and the
data bytes (1 to 4 for each rank).  Blocks lie in Parquet, so Spark commits, places and reads them on any
file system.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import encoder
from ._shared import cut, forget, scratch, small_table, steady_batches

MAGIC, HEADER = b"PWT1", struct.Struct("<4sIQQ")
BLOCK_TOKENS = 1 << 18
#: Lengths that each control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    size = extra.astype(np.int64) + 1
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    data[at] = ranks & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(extra >= k)
        data[at[more] + k] = ranks[more] >> (8 * k) & 0xFF
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers behind control and data bytes, by table lookup."""
    size = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    return HEADER.pack(MAGIC, len(ids), len(ranks), len(data)) + known.tobytes() + ids.tobytes() + counts.astype("<u8").tobytes() + control + data


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and ranks of a block."""
    magic, docs, n, size = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEADER.size
    known = np.frombuffer(block, np.uint8, docs, at)
    ids = np.frombuffer(block, "<i8", docs, at := at + docs)
    counts = np.frombuffer(block, "<u8", docs, at := at + 8 * docs).astype(np.int64)
    control = np.frombuffer(block, np.uint8, -(-n // 4), at := at + 8 * docs)
    data = np.frombuffer(block, np.uint8, size, at + len(control))
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], counts, unpack_ranks(control, data, n)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with ``end_id`` after each document's own."""
    if end_id is None:
        return ids, counts
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def _tokenized(docs: DataFrame, tokenizer_path: str, end_id: int | None, text_col: str, id_col: str) -> DataFrame:
    """(part, before, doc_id, ids) with parts in ascending id order and ``before`` counting a part's ids ahead of the document."""
    steady_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer_path).encode
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = with_end(*encode(batch.column(1).to_pylist()), end_id)
            ends = np.cumsum(counts)
            raw = ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4")
            stored = pa.array([raw[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part, np.int32)), pa.array(before + ends - counts), batch.column(0), pa.array(counts), stored], ["part", "before", "doc_id", "n", "ids"]
            )
            before += int(ends[-1])

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part int, before long, doc_id long, n long, ids binary")


def _numbers(raw: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Stored ids of a batch in a row; documents are stored with 2 or 4 bytes an id."""
    parts = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for x, n in zip(raw.to_pylist(), counts.tolist(), strict=True)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int | None = 2, text_col: str = "text", id_col: str = "doc_id", block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Encode every whole text and write the ids to ``path`` in ascending order of document ids.

    A null text counts as empty, and has the end id alone; a null id comes first; documents with equal ids
    follow each other by text.  Ranks are by counts over all documents, ties to the smaller id.  An empty
    table writes no block.
    """
    spark = docs.sparkSession
    tokens = cut(_tokenized(docs, tokenizer_path, end_id, text_col, id_col), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            here = np.bincount(_numbers(batch.column(1), batch.column(0).to_numpy()), minlength=len(total))
            here[: len(total)] += total
            total = here
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    seen = tokens.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    ranked = [r.id for r in sorted(seen, key=lambda r: (-r.n, r.id))]
    spark.createDataFrame([(k, i) for k, i in enumerate(ranked)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, before, counts = (batch.column(k).to_numpy() for k in (0, 1, 3))
            ids = batch.column(2).to_pylist()
            ranks = shared.value[_numbers(batch.column(4), counts)]
            ends = np.cumsum(counts)
            group = (ends - counts) // block_tokens
            edge = np.flatnonzero(np.diff(group, prepend=-1) | np.diff(part, prepend=-1))  # a block holds one part's documents
            rows = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(counts)], strict=True):
                rows.append((int(part[a]), int(before[a]), int(counts[a:b].sum()), write_block(ids[a:b], counts[a:b], ranks[ends[a] - counts[a] : ends[b - 1]])))
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "before", "n", "block"), x, strict=True)) for x in rows], pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("block", pa.binary())]))

    tokens.mapInArrow(encode, "part int, before long, n long, block binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    forget(tokens)


def read_tokens(spark: SparkSession, path: str, *, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a folder of :func:`write_tokens`.

    ``start`` counts the ids of all documents before it.  ``digest``: the crc32 of the ids as little-endian
    unsigned 32-bit numbers, as ``ids_crc32``, in place of the ids.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    ids = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)  # at most the vocabulary
    parts = sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.part)  # one row for each writing task
    bases = small_table(spark, list(zip([r.part for r in parts], [0, *accumulate(r.n for r in parts)], strict=False)), "part int, base long")
    shared = spark.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, counts, ranks = read_block(block)
                own = shared.value[ranks].astype("<u4")
                ends = np.cumsum(counts)
                spans = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
                last = pa.array([zlib.crc32(own[a:b].tobytes()) for a, b in spans], pa.int64()) if digest else pa.array([own[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array(counts), last], ["doc_id", "start", "n_tokens", kind[0]])

    kind = ("ids_crc32", "long") if digest else ("ids", "array<long>")
    placed = blocks.join(bases, "part").select((F.col("before") + F.col("base")).alias("start"), "block")
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind[0]} {kind[1]}")


def token_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The contract's columns, from the files that :func:`write_tokens` wrote."""
    spark = docs.sparkSession
    path = scratch(spark, "token-file")
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(spark, path, digest=True)

"""Packing: concatenate all documents' ids and cut fixed windows.

Two passes: documents are dealt by ranges of doc_id and encoded once into a written table with totals per partition;
prefix sums over those totals (one number a partition) give every document its global offset, and the second pass cuts
each document where windows end. A piece is the boundary record: where it lies in its document and in its sequence.

Rows: null text is empty (one end id). A null doc_id comes first. Rows that repeat a doc_id are packed one after another.
An empty table gives no pieces; other columns are ignored. Only the last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, known_id, known_text, prepare, shown_id, written
from .textvec import slices
from .tokens import default_path, encoder

ENCODED = "part int, start_in_part long, doc_id long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def encode_rows(path: str, end_id: int):
    """For mapInArrow: (doc_id, text) to ENCODED; ids are little-endian unsigned, as narrow as the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = enc.encode(batch.column("text"))
                sizes = np.diff(offsets) + 1
                ends = np.cumsum(sizes)
                flat = np.insert(ids, offsets[1:], end_id).astype(enc.dtype)
                width = enc.dtype.itemsize
                buffers = [None, pa.py_buffer((np.concatenate([[0], ends]) * width).astype(np.int32)), pa.py_buffer(flat)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + ends - sizes), batch.column("doc_id"),
                        pa.array(sizes), pa.Array.from_buffers(pa.binary(), len(sizes), buffers),
                    ],
                    names=["part", "start_in_part", "doc_id", "n_tokens", "ids"],
                )
                at += int(ends[-1])
        give_back()

    return run


def part_offsets(encoded: DataFrame) -> DataFrame:
    """part, base: ids in all partitions before. One row a partition passes through the driver."""
    rows = sorted(encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, out = 0, []
    for part, n in rows:
        out.append((part, base))
        base += n
    return encoded.sparkSession.createDataFrame(out, "part int, base long")


def cut(length: int, dtype: str):
    """For mapInArrow: (doc_id, start, n_tokens, ids) with global starts to PIECES; ids become unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                starts, sizes = batch.column("start").to_numpy(), batch.column("n_tokens").to_numpy()
                first, last = starts // length, (starts + sizes - 1) // length
                count = last - first + 1
                row = np.repeat(np.arange(len(starts)), count)
                seq = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(row))
                begin = np.maximum(seq * length, starts[row])
                stop = np.minimum((seq + 1) * length, (starts + sizes)[row])
                blob = batch.column("ids")
                flat = np.concatenate([np.frombuffer(x.as_buffer(), dtype) for x in blob]).astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(stop - begin)]) * 4
                buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row)), pa.array(begin - starts[row]), pa.array(stop - begin),
                        pa.Array.from_buffers(pa.binary(), len(row), buffers), pa.array(sizes[row]),
                        pa.array(seq), pa.array(begin - seq * length),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def pack(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """PIECES of documents in ascending doc_id order; ids is the piece as little-endian unsigned 32-bit integers."""
    prepare(docs.sparkSession)
    path = tokenizer or default_path()
    rows = docs.select(known_id().alias("doc_id"), known_text().alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    encoded = written(dealt.mapInArrow(encode_rows(path, end_id), ENCODED), "encoded")
    placed = encoded.join(F.broadcast(part_offsets(encoded)), "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )
    pieces = placed.mapInArrow(cut(length, encoder(path).dtype.str), PIECES)
    return pieces.withColumn("doc_id", shown_id("doc_id"))

"""Content-addressed token store.

Format, all Parquet under one folder:
  chunks/   key (128-bit digest of the chunk's bytes), payload (little-endian ids, as narrow as the vocabulary allows), n
  recipes/  part, row, doc_id, start, n_tokens, keys (one 16-byte digest after another), root; ascending doc_id
  manifest/ part, n_docs, n_tokens, base, root: one row a recipe partition, root over its documents' roots
A rolling hash over the last WINDOW ids cuts a document where its low bits are zero, so equal passages get equal chunks;
each distinct chunk is stored once. Roots are binary Merkle trees over digests.

Rows: null text is empty (the end id alone). A null doc_id comes first; repeated doc_ids are kept, one after another.
An empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, known_id, known_text, prepare, shared_dir, shown_id
from .textvec import BASE, U, mix, powers, slices
from .tokens import default_path, encoder

WINDOW, LEAST, MASK_BITS, MOST = 8, 64, 9, 4096
STAGED = "kind string, key binary, payload binary, doc_id long, n long"
RECIPES = "part int, row long, doc_id long, start_in_part long, n_tokens long, keys binary, root binary"


def digest(blob: bytes) -> bytes:
    return hashlib.blake2b(blob, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary tree; an odd node moves up as it is, no leaf gives the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        pairs = [digest(a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + ([leaves[-1]] if len(leaves) % 2 else [])
    return leaves[0]


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash allows a cut. Only the WINDOW ids up to a position count."""
    up, down = powers(len(ids))
    p = np.zeros(len(ids) + 1, U)
    x = _mixed(int(np.iinfo(ids.dtype).max) + 1 if ids.itemsize == 2 else 0)
    x = x[ids] if len(x) else mix(ids.astype(U) + U(1))
    x *= up[: len(ids)]
    np.cumsum(x, out=p[1:])
    rolled = (p[WINDOW:] - p[:-WINDOW]) * down[: max(0, len(p) - WINDOW)]
    # The hash is a product, so its high bits depend on all of the window.
    return np.flatnonzero((rolled * U(BASE)) >> U(64 - MASK_BITS) == 0) + WINDOW


@lru_cache(maxsize=1)
def _mixed(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=U))


def chunk_ends(start: int, end: int, cuts: np.ndarray) -> list[int]:
    """Ends of the chunks of ids[start:end], each of LEAST to MOST ids but for the last."""
    out, at = [], start
    while at < end:
        k = int(np.searchsorted(cuts, at + LEAST))
        to = min(int(cuts[k]) if k < len(cuts) else end, at + MOST, end)
        out.append(to)
        at = to
    return out


def chunk_rows(path: str, end_id: int):
    """For mapInArrow: (doc_id, text) to STAGED rows, chunks and recipes; a task sends each of its recent chunks once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        enc, part, row, sent = encoder(path), TaskContext.get().partitionId(), 0, set()
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = enc.encode(batch.column("text"))
                flat = np.insert(ids, offsets[1:], end_id).astype(enc.dtype)
                bounds = (offsets + np.arange(len(offsets))).tolist()
                cuts, blob, width = boundaries(flat), flat.tobytes(), enc.dtype.itemsize
                cols: tuple[list, ...] = ([], [], [], [], [])
                if len(sent) > 200_000:
                    sent = set()
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                    keys, at = [], a
                    for to in chunk_ends(a, b, cuts):
                        keys.append(key := digest(piece := blob[at * width : to * width]))
                        if key not in sent:
                            sent.add(key)
                            for c, v in zip(cols, ("chunk", key, piece, None, to - at), strict=True):
                                c.append(v)
                        at = to
                    for c, v in zip(cols, ("recipe", part.to_bytes(4, "big") + row.to_bytes(8, "big"), b"".join(keys), doc, b - a), strict=True):
                        c.append(v)
                    row += 1
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "key", "payload", "doc_id", "n"])

    return run


def place_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at, row = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = np.cumsum(n)
        roots = [merkle_root([k[i : i + 16] for i in range(0, len(k), 16)]) for k in batch.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(n), part, np.int32)), pa.array(row + np.arange(len(n))), batch.column("doc_id"),
                pa.array(at + ends - n), batch.column("n"), batch.column("payload"), pa.array(roots, pa.binary()),
            ],
            names=["part", "row", "doc_id", "start_in_part", "n_tokens", "keys", "root"],
        )
        at, row = at + int(ends[-1]) if len(n) else at, row + len(n)


def part_roots(pdf):
    import pandas as pd

    pdf = pdf.sort_values("row")
    return pd.DataFrame({"part": [pdf.part.iloc[0]], "n_docs": [len(pdf)], "n_tokens": [pdf.n_tokens.sum()], "root": [merkle_root(list(pdf.root))]})


def write_store(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 0) -> str:
    """Encode, chunk and write; returns the folder. One shuffle carries each distinct chunk of a task once."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(known_id().alias("doc_id"), known_text().alias("text"))
    staged = rows.mapInArrow(chunk_rows(tokenizer or default_path(), end_id), STAGED).dropDuplicates(["kind", "key"])
    staged.write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/chunks")
    found = spark.read.schema(STAGED).parquet(f"{folder}/chunks").filter("kind = 'recipe'").select("key", "payload", "doc_id", "n")
    ordered = found.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").mapInArrow(place_recipes, RECIPES)
    ordered.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    staged_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/chunks/kind=recipe")
    staged_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged_path, True)  # the ordered ones take their place
    recipes = spark.read.schema(RECIPES).parquet(f"{folder}/recipes")
    # A part's documents are one range partition, so a group here is no larger than a task that has already run.
    roots = recipes.select("part", "row", "n_tokens", "root").groupBy("part").applyInPandas(part_roots, "part int, n_docs long, n_tokens long, root binary")
    base, out = 0, []
    for r in sorted(roots.collect()):
        out.append((*r[:3], base, r[3]))
        base += r[2]
    spark.createDataFrame(out, "part int, n_docs long, n_tokens long, base long, root binary").coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


class Store:
    """A written store. Every read checks each chunk against its digest, each document against its Merkle root, and each
    recipe partition (documents, ids, root and place) against the manifest; what is damaged or missing is an error."""

    def __init__(self, spark: SparkSession, folder: str, dtype: str | None = None):
        prepare(spark)
        self.dtype = dtype or encoder(default_path()).dtype.str
        self.chunks = spark.read.schema(STAGED).parquet(f"{folder}/chunks").filter("kind = 'chunk'").select("key", "payload", "n")
        self.recipes = spark.read.schema(RECIPES).parquet(f"{folder}/recipes")
        self.manifest = spark.read.schema("part int, n_docs long, n_tokens long, base long, root binary").parquet(f"{folder}/manifest")

    def parts(self) -> DataFrame:
        """part, base of the manifest, once the recipes have been held against it; one row a partition."""
        found = self.recipes.select("part", "row", "n_tokens", "root").groupBy("part").applyInPandas(part_roots, "part int, n_docs long, n_tokens long, root binary")
        have = found.select("part", *(F.col(c).alias(f"_{c}") for c in ("n_docs", "n_tokens", "root")))
        before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        both = self.manifest.withColumn("_base", before).join(have, "part", "full")  # the manifest's window is over partitions, not rows
        same = F.coalesce((F.col("base") == F.col("_base")) & (F.col("n_docs") == F.col("_n_docs")) & (F.col("n_tokens") == F.col("_n_tokens")) & (F.col("root") == F.col("_root")), F.lit(False))
        return both.select("part", F.when(same, F.col("base")).otherwise(F.raise_error(F.concat(F.lit("the manifest does not match recipe partition "), F.col("part").cast("string")))).cast("long").alias("base"))

    def placed(self) -> DataFrame:
        """Recipes with the global start. All of parts() is read for the broadcast, so what it finds missing is an error here."""
        return self.recipes.join(F.broadcast(self.parts()), "part", "left").withColumn("start", F.col("base") + F.col("start_in_part"))

    def steps(self) -> DataFrame:
        """One row per document and chunk: part, row, pos, key."""
        count = (F.length("keys") / 16).cast("int")
        pos = F.explode(F.sequence(F.lit(0), count - 1))
        return self.recipes.filter(F.length("keys") > 0).select("part", "row", "keys", pos.alias("pos")).select("part", "row", "pos", F.expr("substring(keys, pos * 16 + 1, 16)").alias("key"))

    def digests(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the chunks as read.

        Chunks are read and verified where they lie; their checksums, not their ids, travel to the documents.
        """
        info = self.chunks.mapInArrow(checksums(self.dtype), "key binary, crc long, n long")
        found = self.steps().join(info, "key").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "crc", "n", "key"))).alias("steps"))
        whole = self.placed().join(found, ["part", "row"], "left").select("doc_id", "start", "n_tokens", "root", F.col("steps.crc").alias("crcs"), F.col("steps.n").alias("sizes"), F.expr("aggregate(steps.key, X'', (a, b) -> a || b)").alias("keys"))
        out = whole.mapInArrow(joined_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
        return out.withColumn("doc_id", shown_id("doc_id"))

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids (the document's bytes), rebuilt by joining chunks to recipes."""
        parts = self.steps().join(self.chunks, "key").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "payload", "key"))).alias("steps"))
        found = self.placed().join(parts, ["part", "row"], "left").select("doc_id", "start", "n_tokens", "root", F.col("steps.payload").alias("payloads"), F.col("steps.key").alias("keys"))
        return found.mapInArrow(rebuilt(self.dtype), "doc_id long, start long, n_tokens long, ids binary").withColumn("doc_id", shown_id("doc_id"))


def checksums(dtype: str):
    """(key, payload, n) to (key, crc, n): the checksum of each chunk's ids as unsigned 32-bit, once its digest agrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, crcs, at = batch.column("payload").cast(pa.large_binary()), [], 0
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
            narrow = memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]]
            ids = np.frombuffer(narrow, dtype)
            wide, per = memoryview(ids.astype("<u4").tobytes()), 4 // np.dtype(dtype).itemsize
            for key, begin, end, n in zip(batch.column("key").to_pylist(), offsets, offsets[1:], batch.column("n").to_pylist(), strict=False):
                size = end - begin
                if digest(narrow[at : at + size]) != key or size * per != 4 * n:
                    raise ValueError(f"chunk {key.hex()} does not match its digest")
                crcs.append(zlib.crc32(wide[at * per : (at + size) * per]))
                at += size
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crcs, pa.int64()), batch.column("n")], names=["key", "crc", "n"])

    return run


def rebuilt(dtype: str):
    """(doc_id, start, n_tokens, root, payloads, keys) to the documents' bytes, once chunks, root and length agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, root, payloads, keys in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "root", "payloads", "keys")), strict=True):
                payloads, keys = payloads or [], keys or []
                ids = b"".join(payloads)
                if any(digest(p) != k for p, k in zip(payloads, keys, strict=True)):
                    raise ValueError("a chunk does not match its digest")
                if merkle_root(keys) != root or len(ids) != n * np.dtype(dtype).itemsize:
                    raise ValueError("a document does not match its recipe")
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


@lru_cache(maxsize=1)
def _shifts() -> list[np.ndarray]:
    """Operators on CRC-32 registers: the k-th appends 2**k zero ids of four bytes. Four tables, one a byte of the register."""
    one = np.array([0xEDB88320, *(1 << np.arange(31))], dtype=np.uint64)  # a zero bit: column i is the image of bit i
    ops, op = [], one
    for k in range(5 + 32):
        if k >= 5:
            byte = np.arange(256, dtype=np.uint64)
            ops.append(np.stack([_linear(op, byte << np.uint64(8 * i)) for i in range(4)]))
        op = _linear(op, op)
    return ops


def _linear(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where((x >> np.uint64(i)) & np.uint64(1), op[i], np.uint64(0))
    return out


def append_checksum(crc: np.ndarray, more: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of a || b from those of a and b, where b has n ids of four bytes."""
    out = crc.astype(np.uint64)
    for k, op in enumerate(_shifts()):
        if not (n >> k).any():
            break
        hit = np.flatnonzero((n >> k) & 1)
        x = out[hit]
        out[hit] = op[0, x & np.uint64(255)] ^ op[1, (x >> np.uint64(8)) & np.uint64(255)] ^ op[2, (x >> np.uint64(16)) & np.uint64(255)] ^ op[3, x >> np.uint64(24)]
    return out ^ more.astype(np.uint64)


def joined_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs, sizes = batch.column("crcs"), batch.column("sizes")
        count = np.array([len(x) if x.is_valid else 0 for x in crcs])
        begin = np.concatenate([[0], np.cumsum(count)])
        flat_crc = np.array([c for x in crcs.to_pylist() for c in x or ()], np.int64)
        flat_n = np.array([c for x in sizes.to_pylist() for c in x or ()], np.int64)
        out, total = np.zeros(len(count), np.uint64), np.zeros(len(count), np.int64)
        some = np.flatnonzero(count)
        out[some], total[some] = flat_crc[begin[some]], flat_n[begin[some]]
        for k in range(1, int(count.max(initial=0))):
            live = np.flatnonzero(count > k)
            at = begin[live] + k
            out[live] = append_checksum(out[live], flat_crc[at], flat_n[at])
            total[live] += flat_n[at]
        for keys, root, n, have in zip(batch.column("keys").to_pylist(), batch.column("root").to_pylist(), batch.column("n_tokens").to_pylist(), total.tolist(), strict=True):
            if have != n or merkle_root([(keys or b"")[i : i + 16] for i in range(0, len(keys or b""), 16)]) != root:
                raise ValueError("a document does not match its recipe")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

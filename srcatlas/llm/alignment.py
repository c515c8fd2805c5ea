"""Alignment of two tokenizers' ids over a corpus: groups, links, and how often each pair of ids is linked.

A: byte-level BPE of space + text. B: SentencePiece of the text, which adds that space itself. Both cut the same bytes, so a
token is a range of bytes. Ranges that overlap are linked; a cut that both share ends a group. Between two neighbouring cuts
of either side lies exactly one link, so links are the merged cuts.

Counts: ids of B are dealt to STRIPES stripes (b mod STRIPES), and a stripe's counts are one dense matrix, ids of B by all ids
of A. Links leave the encoder as one row per batch of documents and stripe: cells of the stripe's matrix, and for each cell
the documents and how often. They are written once. A pass without a shuffle sums each task's cells, and those sums alone
meet in the stripe's task, which adds them up in the matrix (np.add.at) and takes row maxima. Scoring brings each stripe's
links and its counts together; large stripes are divided by batches, so the ids of a very frequent token are no hot task.

Memory: one batch of documents (about 2 MB of text, or one longer text) and a matrix of (ids of B / STRIPES) x (ids of A)
counts, 100 MB with the default tokenizers; both vocabularies bound it, not the corpus.

Rows: a null, empty or not reproducible text (the joined bytes of a side differ from space + text) has no tokens: all zero,
no groups. Strings of special tokens are plain text. Null, repeated and equal doc_ids are rows of their own. Other columns
of the table are not read, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import give_back, known_text, prepare, written
from .textvec import slices, utf8
from .tokens import Encoder, default_path

#: Stripes of the count matrix.
STRIPES = 128
#: Bits of a cell's place in its stripe and of a document's place in its batch.
CELL_BITS, DOC_BITS = 32, 24
#: Bytes of text in a batch of documents; one text is never cut.
MOST_TEXT = 2 << 20
#: Cells that a task sums up before it passes them on.
MOST_CELLS = 1 << 21
#: A stripe's links are divided into parts of about this many bytes, and all links into this many parts at least.
PART_BYTES, LEAST_PARTS = 32 << 20, 2 * STRIPES

ENCODED = "batch long, idx int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, stripe int, links binary"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PlainEncoder(Encoder):
    """Ids of the byte-level tokenizer, in which strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True

    def token_bytes(self) -> list[bytes]:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        return [bytes(byte_of[c] for c in n) if all(c in byte_of for c in n) else n.encode() for n in names]


class PieceEncoder(Encoder):
    """Ids of a SentencePiece model: words are encoded once each where no piece crosses a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.dtype = np.dtype("<u2" if len(self.names) <= 1 << 16 else "<u4")
        self.by_words = not any("▁" in n[1:] and n.strip("▁") for n in self.names)
        self._clear()

    def _ids(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array(self.model.encode(text), self.dtype)

    def _learn(self, words: list[str], first: np.ndarray, stems: np.ndarray) -> np.ndarray:
        codes = np.full(len(words), -2, np.int32)
        some = [i for i, w in enumerate(words) if w and "▁" not in w] if self.by_words else []
        if some:
            ids = self.model.encode([words[i] for i in some], num_threads=1)
            sizes = np.array([len(x) for x in ids])
            codes[some] = self._append(np.fromiter(itertools.chain.from_iterable(ids), self.dtype, int(sizes.sum())), sizes)
        return codes

    def token_bytes(self) -> list[bytes]:
        of = lambda i, n: bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
        return [of(i, n) for i, n in enumerate(self.names)]


class Side:
    """An encoder with the bytes of its tokens as one array."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        names = encoder.token_bytes()
        self.size = np.array([len(n) for n in names], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(names), np.uint8)
        self.count = len(names)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """One pair of encoders per Python worker."""
    return Side(PlainEncoder(path_a)), Side(PieceEncoder(path_b))


def pick(ids: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the marked documents, others without ids."""
    sizes = np.diff(offsets) * docs
    return ids[np.repeat(docs, np.diff(offsets))], np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=1)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below n as digits with a free place after them, and how many digits each has."""
    ids, width = np.arange(n), len(str(n - 1))
    size = np.array([len(str(i)) for i in range(n)])
    text = np.zeros((n, width + 1), np.uint8)
    for k in range(width):
        some = np.flatnonzero(size > k)
        text[some, k] = ord("0") + ids[some] // 10 ** (size[some] - 1 - k) % 10
    return text, size


class Aligned:
    """Tokens, cuts and links of a batch of texts."""

    def __init__(self, texts: pa.Array, a: Side, b: Side):
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, offsets = utf8(spaced)
        size = np.diff(offsets)
        docs = size > 1
        pair = [(s, *s.encoder.encode(t)) for s, t in ((a, spaced), (b, texts))]
        for side, ids, ptr in pair:
            total = np.concatenate([[0], np.cumsum(side.size[ids])])
            docs &= np.diff(total[ptr]) == size
        for side, ids, ptr in pair:
            own, _ = pick(ids, ptr, docs)
            same = side.joined(own) == data[np.repeat(docs, size)]
            if not same.all():
                of = np.repeat(np.flatnonzero(docs), size[docs])
                docs[np.unique(of[~same])] = False
        (self.a, self.ptr_a), (self.b, self.ptr_b) = (pick(ids, ptr, docs) for _, ids, ptr in pair)
        self.rows = len(texts)
        ends = np.cumsum(size * docs)  # bytes up to each document's end
        cut_a, cut_b = np.zeros((2, 1 + (ends[-1] if len(ends) else 0)), bool)
        cut_a[np.cumsum(a.size[self.a])] = cut_b[np.cumsum(b.size[self.b])] = True
        cuts = np.flatnonzero(cut_a | cut_b)
        own_a, own_b = cut_a[cuts], cut_b[cuts]
        both = own_a & own_b
        upto = np.searchsorted(cuts, ends, "right")
        #: Token of either side, and document, of each link; a link ends at each cut.
        self.link_a, self.link_b = np.cumsum(own_a) - own_a, np.cumsum(own_b) - own_b
        self.n_links = np.diff(upto, prepend=0)
        self.link_doc = np.repeat(np.arange(self.rows), self.n_links)
        group = np.cumsum(both) - both
        self.group_a, self.group_b = group[own_a], group[own_b]
        self.closes_a, self.closes_b = both[own_a], both[own_b]
        self.n_groups = np.bincount(self.link_doc[both], minlength=self.rows)

    def groups(self) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each document."""
        n = np.bincount(self.group_b, minlength=self.n_groups.sum()) if len(self.b) else np.zeros(0, np.int64)
        m = np.bincount(self.group_a, minlength=len(n))
        before_b, upto_a = np.cumsum(n) - n, np.cumsum(m)
        at_a = np.arange(len(self.a)) + before_b[self.group_a]
        at_b = np.arange(len(self.b)) + upto_a[self.group_b]
        ids, after = np.zeros(len(at_a) + len(at_b), np.int64), np.zeros(len(at_a) + len(at_b), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        after[at_a] = np.where(self.closes_a, ord("|"), ord(","))
        after[at_b] = np.where(self.closes_b, ord(";"), ord(","))
        shown, size = decimals(1 << max(10, int(ids.max(initial=0)).bit_length()))
        text, digits = shown[ids], size[ids]
        text[np.arange(len(ids)), digits] = after
        width = text.shape[1] - 1
        flat = text[np.arange(width + 1) <= digits[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(digits + 1)])[np.concatenate([[0], np.cumsum(np.diff(self.ptr_a) + np.diff(self.ptr_b))])]
        return [flat[i : j - 1].decode() if j > i else "" for i, j in itertools.pairwise(ends.tolist())]

    def cells(self, width: int) -> Iterator[tuple[int, bytes]]:
        """Stripe and packed links: cells of the stripe's matrix, each with its documents and how often it is in them."""
        b = self.b[self.link_b].astype(np.uint64)
        cell = b // np.uint64(STRIPES) * np.uint64(width) + self.a[self.link_a].astype(np.uint64)
        keys = (b % np.uint64(STRIPES)) << np.uint64(CELL_BITS + DOC_BITS) | cell << np.uint64(DOC_BITS) | self.link_doc.astype(np.uint64)
        keys, often = np.unique(keys, return_counts=True)
        bounds = np.searchsorted(keys >> np.uint64(CELL_BITS + DOC_BITS), np.arange(STRIPES + 1, dtype=np.uint64))
        for stripe, (i, j) in enumerate(itertools.pairwise(bounds.tolist())):
            if i < j:
                own = keys[i:j]
                doc = (own & np.uint64((1 << DOC_BITS) - 1)).astype(np.int32)
                place = (own >> np.uint64(DOC_BITS)) & np.uint64((1 << CELL_BITS) - 1)
                first = np.flatnonzero(np.diff(place, prepend=place[:1] + np.uint64(1)))
                yield stripe, packed(place[first].astype(np.uint32), np.diff(first, append=len(own)).astype(np.uint32), doc, often[i:j].astype(np.uint32))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one block of compressed bytes; the first and third are stored by their differences."""
    head = np.array([len(x) for x in arrays] + [ord(x.dtype.char) for x in arrays], "<u4").tobytes()
    steps = (np.diff(x, prepend=x.dtype.type(0)) if k in (0, 2) else x for k, x in enumerate(arrays))
    body = b"".join(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in steps)
    return len(body).to_bytes(8, "little") + head + pa.compress(body, "zstd", asbytes=True)


def unpacked(block: bytes, count: int) -> list[np.ndarray]:
    head = np.frombuffer(block, "<u4", 2 * count, 8).tolist()
    body = np.frombuffer(pa.decompress(block[8 + 8 * count :], int.from_bytes(block[:8], "little"), "zstd"), np.uint8)
    out, at = [], 0
    for k, (n, kind) in enumerate(zip(head[:count], head[count:], strict=True)):
        kind = np.dtype(chr(kind))
        x = np.ascontiguousarray(body[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel()
        at += n * kind.itemsize
        out.append(np.cumsum(x, dtype=kind) if k in (0, 2) else x)
    return out


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the schema with these columns, nulls in all others."""
    n = max(len(x) for x in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def encode_rows(path_a: str, path_b: str):
    schema = arrow_schema(ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in (y for whole in batches for y in slices(whole, "text", MOST_TEXT)):
            x = Aligned(batch.column("text"), a, b)
            n = np.arange(x.rows)
            yield rows_of(schema, batch=np.full(x.rows, number), idx=n, doc_id=batch.column("doc_id"), n_a=np.diff(x.ptr_a), n_b=np.diff(x.ptr_b), n_groups=x.n_groups, n_links=x.n_links, groups=x.groups())
            found = list(x.cells(a.count))
            if found:
                yield rows_of(schema, batch=np.full(len(found), number), stripe=[s for s, _ in found], links=[y for _, y in found])
            number += 1
        give_back()

    return run


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents (groups: their aligned ids as text) and rows of links (stripe is not null), by batch."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), known_text().alias("text")).mapInArrow(encode_rows(path_a, path_b), ENCODED)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells and counts of all links that a task reads, by stripe."""
    parts, held = defaultdict(list), 0

    def merged(some: list) -> tuple[np.ndarray, np.ndarray]:
        cells, at = np.unique(np.concatenate([c for c, _ in some]), return_inverse=True)
        return cells, np.bincount(at, np.concatenate([n for _, n in some]), len(cells)).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for stripe, some in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([packed(*merged(some))], pa.binary())], names=["stripe", "cells"])

    for batch in batches:
        for stripe, block in zip(batch.column("stripe").to_pylist(), batch.column("links").to_pylist(), strict=True):
            cells, runs, _, often = unpacked(block, 4)
            parts[stripe].append((cells, np.add.reduceat(often, np.cumsum(runs, dtype=np.int64) - runs, dtype=np.int64)))
            held += len(cells)
            if held > MOST_CELLS:
                parts = defaultdict(list, {s: [merged(x)] for s, x in parts.items()})
                held = sum(len(x[0][0]) for x in parts.values())
                if held > MOST_CELLS // 2:
                    yield from out()
                    parts, held = defaultdict(list), 0
    yield from out()


def count_rows(n_a: int, n_b: int):
    """Rows by stripe, one stripe after another: its cells with their counts and whether a count is its row's highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = None, None

        def out() -> pa.RecordBatch:
            best = matrix.reshape(-1, n_a).max(axis=1)
            cells = np.flatnonzero(matrix)
            counts = matrix[cells]
            block = packed(cells.astype(np.uint32), counts, (counts == best[cells // n_a]).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([block], pa.binary())], names=["stripe", "cells"])

        for batch in batches:
            for stripe, block in zip(batch.column("stripe").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if stripe != now:
                    if now is not None:
                        yield out()
                    now, matrix = stripe, np.zeros(-(-n_b // STRIPES) * n_a, np.int64)
                cells, counts = unpacked(block, 2)
                np.add.at(matrix, cells, counts)
        if now is not None:
            yield out()
        matrix = None
        give_back()

    return run


def score_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by stripe and part, the counts before the links: for each batch its documents' sums."""
    cells = counts = best = None
    for batch in batches:
        keys, out = [], []
        for number, block in zip(batch.column("batch").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if number is None:
                cells, counts, best = unpacked(block, 3)
                continue
            own, runs, doc, often = unpacked(block, 4)
            at = np.repeat(np.searchsorted(cells, own), runs)
            n_best, total = np.bincount(doc, often * best[at]), np.zeros(doc.max() + 1, np.int64)
            np.add.at(total, doc, often * counts[at])
            some = np.unique(doc)
            keys.append(number)
            out.append(packed(some.astype(np.int32), n_best[some].astype(np.uint32), np.zeros(0, np.int32), total[some]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["batch", "sums"])


def doc_rows(schema: pa.Schema):
    """Rows by batch, documents in order of idx before sums: the documents with their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n_best, total = None, [], None, None

        def out() -> Iterator[pa.RecordBatch]:
            docs = pa.Table.from_batches(held).combine_chunks()
            none = np.zeros(docs.num_rows, np.int64)
            columns = {f.name: docs.column(f.name) for f in schema if f.name in docs.column_names}
            columns |= {"n_best": none if n_best is None else n_best, "count_sum": none if n_best is None else total}
            yield from pa.table([columns[f.name] for f in schema], schema=schema).to_batches(max_chunksize=10_000)

        for batch in batches:
            number, is_sum = batch.column("batch").to_numpy(), batch.column("sums").is_valid()
            for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]):
                if i == j:
                    continue
                if number[i] != now:
                    if held:
                        yield from out()
                    now, held, n_best = number[i], [], None
                part, sums = batch.slice(i, j - i), is_sum.slice(i, j - i)
                if (docs := part.filter(pc.invert(sums))).num_rows:
                    held.append(docs)
                if (some := part.filter(sums).column("sums")) and n_best is None:
                    n_best, total = (np.zeros(sum(x.num_rows for x in held), np.int64) for _ in range(2))
                for block in some.to_pylist():
                    doc, k, _, sum_ = unpacked(block, 4)
                    n_best[doc] += k
                    total[doc] += sum_
        if held:
            yield from out()

    return run


def stripe_parts(links: DataFrame) -> list[int]:
    """How many parts each stripe's links are divided into; STRIPES rows come to the driver."""
    rows = links.groupBy("stripe").agg(F.sum(F.length("links")).alias("n")).collect()
    most = min(PART_BYTES, max(1, sum(r.n for r in rows) // LEAST_PARTS))
    parts = [1] * STRIPES
    for r in rows:
        parts[r.stripe] = -(-r.n // most)
    return parts


def counts(links: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """stripe, cells: the counts of all pairs of ids of each stripe, packed."""
    n_a, n_b = (s.count for s in sides(path_a, path_b))
    sums = links.select("stripe", "links").mapInArrow(summed, "stripe int, cells binary")
    return sums.repartition(STRIPES, "stripe").sortWithinPartitions("stripe").mapInArrow(count_rows(n_a, n_b), "stripe int, cells binary")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digests: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum.

    groups: aligned ids, a1,a2|b1;a3|b2,b3. With digests, groups_sha256 stands in its place ('' without tokens), and the
    groups themselves are never written. n_best: links whose count is the highest of their id of B, ties included;
    count_sum: the counts of all links, added up.
    """
    path_a, path_b = path_a or default_path(), path_b or default_pieces()
    found = encoded(docs, path_a, path_b)
    if digests:
        found = found.withColumn("groups", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(F.lit("")))
    found = written(found, "aligned")
    links, rows = found.filter("stripe is not null").select("batch", "stripe", "links"), found.filter("stripe is null").drop("stripe", "links")
    parts = stripe_parts(links)
    n_parts = F.array(*map(F.lit, parts))[F.col("stripe")]
    cells = counts(links, path_a, path_b)
    each = cells.select("stripe", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), F.lit(None).cast("long").alias("batch"), F.col("cells").alias("block"))
    both = each.union(links.select("stripe", F.pmod(F.xxhash64("batch"), n_parts).cast("int").alias("part"), "batch", F.col("links").alias("block")))
    sums = both.repartition("stripe", "part").sortWithinPartitions("stripe", "part", F.col("batch").asc_nulls_first()).select("batch", "block").mapInArrow(score_links, "batch long, sums binary")
    joined = rows.withColumn("sums", F.lit(None).cast("binary")).unionByName(sums, allowMissingColumns=True)
    by_batch = joined.repartition("batch").sortWithinPartitions("batch", F.col("idx").asc_nulls_last())
    out = by_batch.mapInArrow(doc_rows(arrow_schema(SCORED)), SCORED)
    return out.withColumnRenamed("groups", "groups_sha256") if digests else out

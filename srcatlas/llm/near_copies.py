"""Near-duplicates by SimHash and the exact Jaccard similarity of word shingle sets.

A text is the set of its shingles of `words` words (A-Z lower-cased, words are runs of anything but ASCII white space; fewer
words: the whole sequence) by their 64-bit hashes; equal sets travel once. Two texts are linked if their sets have a
similarity of `LEAST` or more, and a group is what links join.

Search: SimHash fingerprints of the texts within DISTANCE bits, found by simhash.py's covering anchors, are compared on their
whole sets, and those that are alike are linked. DISTANCE is all that these anchors cover. At a similarity of 0.8 fingerprints
differ in ten bits on average, so some links are beyond it, and a crowded anchor names only some pairs. For these links there
are 128 MinHashes in BANDS bands of ROWS. Sets of similarity 0.8 agree in a band but for one pair in twenty million
(0.5904 ** 32), so a set without a near fingerprint that agrees with no other one in any band has no link and goes no further.
Only the other sets' texts are fetched, and candidates are compared on their whole sets. Up to ROUNDS times each set is
compared with one other of those that fingerprints have not joined with it: every band's sets have a pivot, another one each
time, and of the pivots in other groups than its own a set takes the one that it shares most bands with. That joins groups of
near copies in linear work. Then those that are still in different groups are compared with each other, each pair once, unless
sketches of SKETCH bits tell them apart: a bit of two sets agrees with probability (1 + similarity) / 2, and pairs that differ
in more than FARTHEST bits, 5.5 standard deviations beyond similarity 0.8, have no link but for one in fifty million. Such
pairs are never emitted.

Rows: null text is empty; empty texts are one group. A null doc_id sorts first. Rows that repeat a doc_id are rows of
their own. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, known_id, known_text, maybe_in, prepare, written
from .graph import components
from .simhash import FARTHEST as COVERED
from .simhash import SEED, first_rows, near_fingerprints, text_fingerprints
from .textvec import BASE, SPACED, U, mix, permuted, shingle_sets, slices

#: The least similarity of a link, as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
#: Bits between fingerprints whose sets are compared.
DISTANCE = COVERED
BANDS, ROWS = 32, 4
ROUNDS = 5
SKETCH = 2048
FARTHEST = int(SKETCH * 0.1 + 5.5 * (SKETCH * 0.1 * 0.9) ** 0.5)
LONGS = [f"s{k}" for k in range(SKETCH // 64)]


def distinct_sets(column: pa.Array, words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text; all hashes of the batch and the pointers of texts into them."""
    _, h, _, ptr = shingle_sets(column, words, SPACED)
    return [np.unique(h[a:b]) for a, b in zip(ptr, ptr[1:], strict=False)], h, ptr


def band_keys(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each text with shingles."""
    some = ptr[:-1][np.diff(ptr) > 0]
    out = np.zeros((len(some), BANDS), U)
    for k in range(BANDS * ROWS if len(some) else 0):
        low = np.minimum.reduceat(permuted(h, k), some).astype(U)
        out[:, k // ROWS] = mix(out[:, k // ROWS] * U(BASE) + low + U(k))
    return out


def signature_rows(words: int):
    """(doc_id, copy, text) to (doc_id, copy, sid, fp, bands): the set's own hash, the text's fingerprint and the set's band keys; no bands without words."""
    from xxhash import xxh3_64_intdigest as xx

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, h, ptr = distinct_sets(batch.column("text"), words)
                sid = np.array([xx(s.tobytes(), SEED) for s in sets], U).view(np.int64)
                full = np.diff(ptr) > 0
                ends = np.concatenate([[0], np.cumsum(full) * BANDS]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(h, ptr).ravel().view(np.int64)))
                fp = pa.array(text_fingerprints(batch.column("text"), words))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(sid), fp, bands], names=["doc_id", "copy", "sid", "fp", "bands"])

    return run


def set_rows(words: int):
    """(sid, text) to (sid, n, shingles): the sorted distinct hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, _, _ = distinct_sets(batch.column("text"), words)
                yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "n", "shingles"])

    return run


def flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, shingles) to (sid, LONGS): the lowest bits of SKETCH MinHashes; none for empty sets."""
    for whole in batches:
        for batch in slices(whole, "shingles"):
            size = pc.binary_length(batch.column("shingles")).to_numpy() // 8
            batch, size = batch.filter(pa.array(size > 0)), size[size > 0]
            h, begin = flat(batch.column("shingles")), np.cumsum(size) - size
            bits = np.zeros((batch.num_rows, SKETCH), np.uint8)
            for k in range(SKETCH if batch.num_rows else 0):
                bits[:, k] = np.minimum.reduceat(permuted(h, BANDS * ROWS + k), begin) & 1
            packed = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("sid"), *(pa.array(np.ascontiguousarray(packed[:, k])) for k in range(len(LONGS)))], names=["sid", *LONGS])


def alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two shingle sets have a similarity of LEAST or more."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(LEAST[1] * both >= LEAST[0] * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


def fits(a: str, b: str):
    """Sizes that similar sets can have."""
    return (F.col(a) * LEAST[1] >= F.col(b) * LEAST[0]) & (F.col(b) * LEAST[1] >= F.col(a) * LEAST[0])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst; written) whose sets are alike; a set of src travels once a pair, so a hot dst is only a skewed join."""
    some = sets.select("sid", "shingles")
    both = pairs.join(some.toDF("src", "_a"), "src").join(some.toDF("dst", "_b"), "dst")
    out = written(both.filter(F.arrow_udf(alike, "boolean")("_a", "_b")).select("src", "dst"), "links")
    forget(pairs)
    return out


def fingerprint_pairs(signatures: DataFrame) -> DataFrame:
    """(src, dst) of different sets whose fingerprints are equal or near: each with its fingerprint's first set, and first sets."""
    held = written(signatures.select("fp", "sid").distinct(), "fingerprints")
    heads = written(held.groupBy("fp").agg(F.min("sid").alias("head")), "heads")
    near = written(near_fingerprints(heads, DISTANCE).distinct(), "near")
    equal = held.join(heads, "fp").select(F.col("sid").alias("src"), F.col("head").alias("dst"))
    across = near.join(heads.toDF("src", "a"), "src").join(heads.toDF("dst", "b"), "dst").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))
    out = written(equal.union(across).filter("src <> dst").distinct(), "candidates")
    for table in (held, heads, near):
        forget(table)
    return out


def candidate_sets(rows: DataFrame, signatures: DataFrame, near: DataFrame, words: int) -> DataFrame:
    """sid, n, shingles of every distinct set of the pairs near or that agrees with another one in a band; one text a set is read again."""
    banded = signatures.select("sid", F.explode("bands").alias("key"))  # a band's number is part of its key
    several = banded.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).filter("a < b").select("key")
    # Written, so that the joins shuffle both sides anew and the side of a hot band or set can be split.
    named = banded.join(written(several, "bands"), "key", "left_semi").select("sid").union(near.select("src")).union(near.select("dst")).distinct()
    heads = signatures.groupBy("sid").agg(F.min(F.struct("doc_id", "copy")).alias("head")).join(named, "sid", "left_semi")
    heads = written(heads.select("sid", F.col("head.doc_id").alias("doc_id"), F.col("head.copy").alias("copy")), "heads")
    near = rows.filter(maybe_in(F.xxhash64("doc_id", "copy"), heads, F.xxhash64("doc_id", "copy")))
    texts = near.join(heads.hint("merge"), ["doc_id", "copy"]).groupBy("sid").agg(F.first("text").alias("text"))
    out = written(texts.mapInArrow(set_rows(words), "sid long, n int, shingles binary"), "sets")
    forget(heads)
    return out


def pivot_links(cands: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """One comparison a set: with the pivot of other groups that it shares most bands with; the pairs that are alike."""
    entries = cands.select("sid", "n", "root", F.explode("bands").alias("key"))
    order = F.struct(F.xxhash64("sid", F.lit(turn)), "sid", "n", "root")
    pivots = entries.groupBy("key").agg(F.min(order).alias("p"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b")
    pivots = written(pivots.select("key", F.col("p.sid").alias("dst"), F.col("p.n").alias("_n"), F.col("p.root").alias("_root")), "pivots")
    met = entries.join(pivots, "key").filter("root <> _root").filter(fits("n", "_n")).groupBy("sid", "dst").agg(F.count(F.lit(1)).alias("k"))
    best = met.groupBy("sid").agg(F.max(F.struct("k", "dst")).alias("b"))
    out = verified(written(best.select(F.col("sid").alias("src"), F.col("b.dst").alias("dst")), "candidates"), sets)
    forget(pivots)
    return out


def other_links(cands: DataFrame, sets: DataFrame) -> DataFrame:
    """The alike pairs of sets of different groups, each at the first band that it shares."""
    entries = cands.select("sid", "n", "root", "bands", F.posexplode("bands").alias("band", "key"))
    open_keys = entries.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    opened = written(entries.join(open_keys, "key", "left_semi"), "opened")
    drawn = sets.select("sid", "shingles").join(opened.select("sid").distinct(), "sid", "left_semi").mapInArrow(sketches, "sid long, " + ", ".join(f"{c} long" for c in LONGS))
    left = written(opened.join(drawn, "sid"), "open")
    right = left.select("key", *(F.col(c).alias(f"_{c}") for c in ("sid", "n", "root", "bands", *LONGS)))
    apart = reduce(Column.__add__, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in LONGS))
    first = F.array_position(F.zip_with("bands", "_bands", lambda x, y: x == y), True) == F.col("band") + 1
    pairs = left.join(right, (left.key == right.key) & (F.col("root") < F.col("_root")) & fits("n", "_n") & (apart <= FARTHEST) & first)
    out = verified(written(pairs.select(F.col("sid").alias("src"), F.col("_sid").alias("dst")), "candidates"), sets)
    forget(opened)
    forget(left)
    return out


def members(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id (NULL_ID for null), copy (hash of the text), component: the same for all rows of a group."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(known_id().alias("doc_id"), F.xxhash64(known_text()).alias("copy"), known_text().alias("text"))
    signatures = written(rows.mapInArrow(signature_rows(words), "doc_id long, copy long, sid long, fp long, bands array<long>"), "signatures")
    near = fingerprint_pairs(signatures)
    sets = candidate_sets(rows, signatures, near, words)
    cands = written(signatures.join(sets.select("sid", "n"), "sid").groupBy("sid", "n").agg(F.first("bands").alias("bands")), "candidates")
    links = verified(near, sets)
    labels = None if links.isEmpty() else written(components(links), "labels")

    def grouped() -> DataFrame:
        return cands.withColumn("root", F.col("sid")) if labels is None else cands.join(labels, cands.sid == labels.node, "left").select("sid", "n", "bands", F.coalesce("root", "sid").alias("root"))

    for turn in range(ROUNDS):
        found = pivot_links(grouped(), sets, turn)
        if found.isEmpty():
            break
        links = links.union(found)
        labels = written(components(links), "labels")
    last = other_links(grouped(), sets)
    if not last.isEmpty():
        labels = written(components(links.union(last)), "labels")
    labels = spark.createDataFrame([], "node long, root long") if labels is None else labels
    out = written(signatures.join(labels, signatures.sid == labels.node, "left").select("doc_id", "copy", F.coalesce("root", "sid").alias("component")), "members")
    for table in (signatures, sets, cands):
        forget(table)
    return out


def one_per_group(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of docs, all columns, one of each group: the one with the smallest doc_id (of repeated ids, one row)."""
    return first_rows(docs, members(docs, words))

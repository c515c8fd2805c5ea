"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Sets are the distinct shingles of `words` words (ASCII letters lower-cased, punctuation dropped). Items fall into
partitions by their number of shingles, with powers of two as upper bounds. For a partition of upper bound q each text is
cut into blocks of q shingles, and every window of two neighbouring blocks is one MinHash domain: a copy of an item lies
whole in one of them or in two neighbours, so a window's size bounds the Jaccard similarity of a contained item from
below and short items are found in texts of any length. A window whose MinHash agrees with an item's in one of PERMUTATIONS
places is a candidate. At containment 0.8 the similarity is over 0.19 for the shortest items of a partition and over 0.36 for
the longest, so at most one item in 20,000 is missed (0.81 ** 48), at full containment one in a million. Candidates are then
compared by the share of the item's own shingles, as words, that the text has.

Items go to the tasks in groups of at most `most_items`; more items take more passes over the texts, which never move.

Rows: null texts and texts without words have no shingles and match nothing; a text or item of fewer than `words` words
is one shingle of all its words. Null doc_ids are kept as null, repeated rows give repeated results, items with equal ids
are told apart by their text. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .textvec import U, Words, permuted, shingle_sets, slices

PERMUTATIONS = 48


def partition_bits(size: np.ndarray) -> np.ndarray:
    """k of the partition with upper bound 2**k."""
    return np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)


def texts_of(w: Words, d: int, words: int) -> set[bytes]:
    """The shingles of one text as words."""
    some = [w.low[a:b].tobytes() for a, b in zip(w.start[w.ptr[d] : w.ptr[d + 1]], w.end[w.ptr[d] : w.ptr[d + 1]], strict=True)]
    return {b" ".join(some[i : i + words]) for i in range(max(1, len(some) - words + 1))} if some else set()


def window_places(h: np.ndarray, ptr: np.ndarray, bits: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each partition and permutation: (bits, k, document, value) of every window."""
    size, lowest = np.diff(ptr), min(bits, default=0)
    for k in range(PERMUTATIONS if bits else 0):
        low, begin, docs = permuted(h, k), ptr[:-1][size > 0], np.flatnonzero(size)
        step, count = lowest, -(-size[size > 0] >> lowest)
        at = np.repeat(begin, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) << lowest)
        block = np.minimum.reduceat(low, at) if len(at) else low[:0]
        while True:
            own = np.cumsum(count) - count
            doc = np.repeat(docs, count)
            if step in bits:
                window = block.copy()
                same = np.flatnonzero(doc[:-1] == doc[1:])
                window[same] = np.minimum(block[same], block[same + 1])
                yield step, k, doc, window
            if step >= max(bits):
                break
            half = -(-count // 2)
            pair = np.repeat(own, half) + 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half))
            block = np.minimum.reduceat(block, pair) if len(pair) else block
            count, step = half, step + 1


def place_key(bits: int, k: int, value: np.ndarray) -> np.ndarray:
    return (U(bits << 48 | k << 40) | value.astype(U)).view(np.int64) if len(value) else np.zeros(0, np.int64)


class Items:
    """Test items with their MinHash places; small enough for every task."""

    def __init__(self, ids: list, texts: list[str], words: int):
        column = pa.array(texts, pa.string())
        w, h, _, ptr = shingle_sets(column, words)
        self.ids, self.words = ids, words
        self.sets = [texts_of(w, d, words) for d in range(len(ids))]
        sizes = np.array([len(np.unique(h[a:b])) for a, b in zip(ptr, ptr[1:], strict=False)], np.int64)
        self.bits = np.where(sizes > 0, partition_bits(sizes), -1)
        some = np.flatnonzero(sizes)
        keys, owner = [], []
        for k in range(PERMUTATIONS if len(some) else 0):
            low = np.minimum.reduceat(permuted(h, k), ptr[:-1][some])
            for b in np.unique(self.bits[some]):
                mine = self.bits[some] == b
                keys.append(place_key(int(b), k, low[mine]))
                owner.append(some[mine])
        keys, owner = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *owner])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        # A bit per low part of a place turns almost all windows away before the search.
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys & 0xFFFFF] = True

    def candidates(self, h: np.ndarray, ptr: np.ndarray) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        for bits, k, doc, value in window_places(h, ptr, sorted({int(b) for b in self.bits if b >= 0})):
            maybe = np.flatnonzero(self.seen[value & 0xFFFFF])
            key = place_key(bits, k, value[maybe])
            lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
            for i in np.flatnonzero(hi > lo):
                found.update((int(doc[maybe[i]]), int(o)) for o in self.owner[lo[i] : hi[i]])
        return found


HITS = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


def hits_in(items: Items, column: pa.Array, least: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, shingles of the item, those found), in order of rows."""
    w, h, _, ptr = shingle_sets(column, items.words)
    have: tuple[int, set] = (-1, set())
    for d, i in sorted(items.candidates(h, ptr)):
        if have[0] != d:
            have = (d, texts_of(w, d, items.words))
        n, hit = len(items.sets[i]), len(items.sets[i] & have[1])
        if hit >= least * n:
            yield d, i, n, hit


def search(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = batch.column("doc_id")
                rows = [(ids[d].as_py(), items.ids[i], n, hit, hit / n) for d, i, n, hit in hits_in(items, batch.column("text"), least)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(),) * 4 + (pa.float64(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "n_shingles", "n_found", "containment"])

    return run


def item_groups(items: DataFrame, words: int, most_items: int) -> list:
    """Broadcast indexes of at most about `most_items` items each; the number of items is counted first."""
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    parts, out = -(-tests.count() // most_items), []
    for p in range(parts):
        some = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        out.append(items.sparkSession.sparkContext.broadcast(Items([r.item_id for r in some], [r.text for r in some], words)))
    return out


def clean(docs: DataFrame, items: DataFrame, words: int = 5, least: float = 0.8, most_items: int = 200_000) -> DataFrame:
    """The rows of docs, all columns, whose text contains no item; no shuffle."""
    prepare(docs.sparkSession)
    groups = item_groups(items, words, most_items)

    @F.arrow_udf("boolean")
    def dirty(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), bool)
        at = 0
        for batch in slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            for shared in groups:
                out[[at + d for d, *_ in hits_in(shared.value, batch.column(0), least)]] = True
            at += batch.num_rows
        return pa.array(out)

    return docs.filter(~dirty(F.col("text").cast("string"))) if groups else docs


def contained(docs: DataFrame, items: DataFrame, words: int = 5, least: float = 0.8, most_items: int = 200_000) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment of every item contained in a text to `least` or more.

    Items are sent to the tasks in groups of at most `most_items` rows (counted first), each group by one pass over docs.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in item_groups(items, words, most_items):
        found = rows.mapInArrow(search(shared, least), HITS)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], HITS) if out is None else out

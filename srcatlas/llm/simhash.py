"""SimHash near-duplicates by anchor-point covering.

Fingerprints: A-Z lower-cased, words are runs of anything but ASCII white space, shingles of `words` words (fewer: the whole
sequence), XXH64 with seed 42, a bit is set if it is set in over half of the shingles' hashes. No words: zero.

Search: fingerprints within `distance` bits agree but for floor(distance / 3) bits in one of three blocks. In a block the
anchors are a covering code: the [15, 11] Hamming code times all values of the other bits, of covering radius 1. Every
distinct fingerprint goes to all anchors within radius + half that many bits, rounded up, so a near pair meets at the anchor
of a value half way between the two; radius 2 covers FARTHEST bits. Pairs are compared there on all 64 bits. Copies of one fingerprint travel once. In an anchor with many fingerprints only
those are compared that agree in one of distance + 1 parts of their bits, and many that do give a spanning forest of their
links, never all pairs.

Rows: null text is empty; empty texts share fingerprint zero and link as any other. A null doc_id sorts first. Rows that
repeat a doc_id are rows of their own with one component if their texts are alike. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, known_id, known_text, maybe_in, prepare, shown_id, written
from .graph import components
from .textvec import U, slices

SEED = 42
#: First bit and width of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: The widest distance that anchors within radius 2 cover: two bits in one of three blocks.
FARTHEST = 8
#: From this many fingerprints on, an anchor is divided by parts, and a part gives a spanning forest of its links.
CROWDED = 48


def shingle_hashes(text: bytes, words: int) -> list[int]:
    from xxhash import xxh64_intdigest as xx

    some = text.lower().split()
    if not some:
        return []
    if len(some) <= words:
        return [xx(b" ".join(some), SEED)]
    joined = b" ".join(some)
    ends = list(accumulate(map((1).__add__, map(len, some))))
    starts = [0, *ends[:-words]]
    return [xx(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]


def majority(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per hashes[ptr[i]:ptr[i+1]]; none: zero."""
    out = np.zeros(len(ptr) - 1, U)
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        begin, size = ptr[:-1][full], np.diff(ptr)[full]
        # Bits go to byte lanes that hold sums of 255 rows; runs of 255 are summed first, then the runs of a document.
        runs = -(-size // 255)
        own = np.cumsum(runs) - runs
        at = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(own, runs))
        ones = np.empty((len(at), 8, 8), np.uint8)
        for k in range(8):
            lanes = np.add.reduceat((hashes[: ptr[-1]] >> U(k)) & U(0x0101010101010101), at)
            ones[:, :, k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(ones.reshape(-1, 64).astype(np.int32), own, axis=0)
        out[full] = np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def text_fingerprints(column: pa.Array, words: int) -> np.ndarray:
    """The fingerprint of each text as a signed long."""
    hashes = [shingle_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in column]
    ptr = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    return majority(np.fromiter((x for h in hashes for x in h), U, int(ptr[-1])), ptr).view(np.int64)


def fingerprint_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(text_fingerprints(batch.column("text"), words))], names=["doc_id", "copy", "fp"])

    return run


@lru_cache(maxsize=1)
def code_table() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit value the code words within 2 bits (padded with -1) and their distances, the nearest first."""
    x = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for i in range(15):
        syndrome ^= np.where(x >> i & 1, i + 1, 0)
    words, dist = np.full((1 << 15, 8), -1, np.int64), np.zeros((1 << 15, 8), np.int64)
    words[:, 0] = np.where(syndrome > 0, x ^ (1 << np.maximum(syndrome - 1, 0)), x)
    dist[:, 0] = syndrome > 0
    used = np.ones(1 << 15, np.int64)
    for i in range(15):
        for j in range(i):
            hit = np.flatnonzero(syndrome == ((i + 1) ^ (j + 1)))  # flipping both bits gives a code word
            words[hit, used[hit]] = x[hit] ^ (1 << i) ^ (1 << j)
            dist[hit, used[hit]] = 2
            used[hit] += 1
    return words, dist


def anchors_of(fps: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Row index and anchor of each replica: all anchors of each block within radius 1 + slack (0 or 1) bits."""
    words, dist = code_table()
    rows, keys = [], []
    for b, (low, width) in enumerate(BLOCKS):
        block = (fps >> U(low)) & U((1 << width) - 1)
        x, y = (block & U(0x7FFF)).astype(np.int64), (block >> U(15)).astype(np.int64)
        rest = width - 15
        flips = [[0], [1 << i for i in range(rest)], [1 << i | 1 << j for i in range(rest) for j in range(i)]]
        for k in range(8):
            c, d = words[x, k], dist[x, k]
            for more, some in enumerate(flips):
                ok = np.flatnonzero((c >= 0) & (d + more <= 1 + slack))
                for f in some:
                    rows.append(ok)
                    keys.append((b << 32) | (c[ok] << 8) | (y[ok] ^ f))
    return np.concatenate(rows), np.concatenate(keys)


def replicas(slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.slice(at, 20_000).column("fp").to_numpy().view(U)
                row, key = anchors_of(fps, slack)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64))], names=["anchor", "fp"])

    return run


def near_in_parts(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all links among distinct ones do, for an anchor with many.

    Fingerprints within `distance` bits agree in one of distance + 1 parts of the 64 bits, so each is compared with those
    that share a part with it: runs of sorted parts, of which long ones give a spanning forest.
    """
    src, dst = [np.zeros(0, U)], [np.zeros(0, U)]
    for k in range(distance + 1):
        low, high = 64 * k // (distance + 1), 64 * (k + 1) // (distance + 1)
        part = (fps >> U(low)) & U((1 << (high - low)) - 1)
        order = np.argsort(part, kind="stable")
        for a, b in pairs_in_runs(part[order], fps[order], distance):
            src.append(a)
            dst.append(b)
    return spanning(np.concatenate(src), np.concatenate(dst))


def spanning(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those links, in their order, that join what those before have not joined."""
    _, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    root = list(range(int(at.max(initial=-1)) + 1))
    keep = []
    for k, (a, b) in enumerate(zip(at[: len(src)].tolist(), at[len(src) :].tolist(), strict=True)):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[a] = b
            keep.append(k)
    return src[keep], dst[keep]


def pairs_in_runs(keys: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside runs of equal keys: all of short runs, a spanning forest of long ones."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
    size = end - begin
    for g in np.flatnonzero(size > CROWDED):
        yield forest(np.unique(fps[begin[g] : end[g]]), distance)
    small = np.flatnonzero((size > 1) & (size <= CROWDED))
    for at in range(0, len(small), 4000):
        g = small[at : at + 4000]
        left = np.repeat(begin[g], size[g]) + np.arange(size[g].sum()) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
        count = np.repeat(end[g], size[g]) - left - 1
        i = np.repeat(left, count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        near = np.flatnonzero((np.bitwise_count(fps[i] ^ fps[j]) <= distance) & (fps[i] != fps[j]))
        yield fps[i[near]], fps[j[near]]


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints: every step takes all unseen neighbours of one."""
    left, src, dst = fps, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                new, left = left[near], left[~near]
                src.append(np.full(len(new), x, U))
                dst.append(new)
                queue += list(new)
    none = np.zeros(0, U)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def links(distance: int):
    """For mapInArrow over rows in order of anchor: edges among the fingerprints of each anchor."""

    def compare(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.diff(keys)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        big = np.flatnonzero(end - begin > CROWDED)
        found = [near_in_parts(np.unique(fps[begin[g] : end[g]]), distance) for g in big]
        rest = np.ones(len(keys), bool)
        for g in big:
            rest[begin[g] : end[g]] = False
        found += pairs_in_runs(keys[rest], fps[rest], distance) if rest.any() else []
        none = np.zeros(0, U)
        return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, U)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("anchor").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(U)])
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last anchor may go on
            if done:
                yield edges(*compare(keys[:done], fps[:done]))
                keys, fps = keys[done:], fps[done:]
        if len(keys):
            yield edges(*compare(keys, fps))

    def edges(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        a, b = src.view(np.int64), dst.view(np.int64)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["src", "dst"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id (NULL_ID for null), copy (hash of the text) and fp, the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    some = docs.select(known_id().alias("doc_id"), F.xxhash64(known_text()).alias("copy"), known_text().alias("text"))
    return some.mapInArrow(fingerprint_rows(words), "doc_id long, copy long, fp long")


def near_fingerprints(fps: DataFrame, distance: int) -> DataFrame:
    """(src, dst) of the distinct fp of fps: an anchor's links of at most `distance` bits, of a crowded one a spanning forest."""
    if not 0 <= distance <= FARTHEST:
        raise ValueError(f"the anchors cover distances up to {FARTHEST}")
    anchored = fps.select("fp").mapInArrow(replicas((distance // 3 + 1) // 2), "anchor long, fp long")
    return anchored.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(links(distance), "src long, dst long")


def labels(found: DataFrame, distance: int) -> DataFrame:
    """fp, component (the same for all fingerprints that links of at most `distance` bits join), component_id (its smallest doc_id)."""
    heads = found.groupBy("fp").agg(F.min("doc_id").alias("head"))
    comp = components(near_fingerprints(heads, distance))
    labelled = comp.join(heads, comp.node == heads.fp)
    smallest = labelled.groupBy("root").agg(F.min("head").alias("least"))
    label = labelled.join(smallest, "root").select("fp", "root", "least")
    # Written, so that the join back shuffles both sides anew and a hot fingerprint's side can be split.
    return written(heads.join(label, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), F.coalesce("least", "head").alias("component_id")), "labels")


def near_groups(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links of at most `distance` bits."""
    found = written(fingerprints(docs, words), "fingerprints")
    return found.join(labels(found, distance), "fp").select(
        shown_id("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), shown_id("component_id").alias("component_id")
    )


def one_per_group(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The rows of docs, all columns, one of each group: the one with the smallest doc_id (of repeated ids, one row)."""
    found = written(fingerprints(docs, words), "fingerprints")
    return first_rows(docs, written(found.join(labels(found, distance), "fp"), "members"))


def first_rows(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The first row of docs of each component, by doc_id and hash of the text; members (written): doc_id, copy, component.

    A row is known by its id and its text, since many rows can have the same id or none; equal texts share a component.
    Only rows that go, or that repeat an id and a text, are shuffled; the others stay where they are read.
    """
    first = written(members.groupBy("component").agg(F.min(F.struct("doc_id", "copy")).alias("m")), "first")
    counted = members.groupBy("doc_id", "copy", "component").agg(F.count(F.lit(1)).alias("n")).join(first, "component")
    stays = (F.col("doc_id") == F.col("m.doc_id")) & (F.col("copy") == F.col("m.copy"))
    i, c, stay, maybe = free_names(docs, "id", "copy", "stays", "maybe")
    special = written(counted.select(F.col("doc_id").alias(i), F.col("copy").alias(c), stays.alias(stay), "n").filter(~F.col(stay) | (F.col("n") > 1)).drop("n"), "special")
    keyed = docs.withColumns({i: known_id(), c: F.xxhash64(known_text())})
    marked = keyed.withColumn(maybe, maybe_in(F.xxhash64(i, c), special, F.xxhash64(i, c)))
    # Rows that repeat an id and a text come down to one where they are read, so a hot id is no hot task.
    again = marked.filter(maybe).join(special.hint("merge"), [i, c], "left").filter(F.coalesce(F.col(stay), F.lit(True))).dropDuplicates([i, c])
    return marked.filter(~F.col(maybe)).select(*docs.columns).union(again.select(*docs.columns))

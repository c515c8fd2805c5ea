"""Line dedup by pairwise alignment: later documents lose the blocks of lines that they share with an earlier one.

Lines of at least RARE_WORDS words are units with 128-bit hashes, and shorter lines belong to the unit before them. A
document is paired with the first holder (smallest doc_id) of each of its runs: the shortest ones of consecutive units,
from each unit on and up to each unit, that have `least_words` words. Any block that an earlier document holds has such
runs, so it is met as a whole, and a run with many holders makes one pair a holder, never all pairs; no frequency has to
be cut off. In a pair, lines that occur once on either side are aligned by patience diff (the longest increasing
sequence), which goes on between them, and blocks of at least `least_words` words go from the later document, with the
short lines inside them. What a later document loses stays in the smallest document that has it.

Rows: null text stays null, the empty text empty. A null doc_id is the earliest. Rows with the same doc_id are neither
earlier nor later than each other, so they lose lines only to smaller ids, and repeated rows lose the same lines. A text
that is a copy of an earlier one becomes empty. Empty tables give empty results; other columns are kept as they are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, known_id, maybe_in, prepare, written
from .textvec import slices

RARE_WORDS = 5
UNITS = "id long, copy long, h binary, at array<int>, words int, run binary"


def units(text: str) -> list[tuple[list[int], bytes, int, bytes]]:
    """Lines of each unit (its own first, then the short ones after it), hash, words, hash of the short lines."""
    from xxhash import xxh3_128_digest as xx

    out: list = []
    for i, line in enumerate(text.split("\n")):
        n = len(line.split())
        if n >= RARE_WORDS:
            out.append(([i], xx(line.strip().encode()), n, []))
        elif out:
            out[-1][0].append(i)
            out[-1][3].append(line.strip())
    return [(lines, h, n, xx("\n".join(run).encode())) for lines, h, n, run in out]


def run_keys(hashes: list[bytes], words: list[int], least_words: int) -> set[bytes]:
    """Hashes of the shortest runs of least_words words or more that start or end at each unit."""
    from xxhash import xxh3_128_digest as xx

    sums = [0, *accumulate(words)]
    out = set()
    for k in range(len(words)):
        end = bisect_left(sums, sums[k] + least_words)
        if end < len(sums):
            out.add((k, end))
        if sums[k + 1] >= least_words:
            out.add((bisect_right(sums, sums[k + 1] - least_words) - 1, k + 1))
    return {xx(b"".join(hashes[i:j])) for i, j in out}


def unit_rows(least_words: int):
    """(id, copy, text) to UNITS: a row per distinct unit hash of a document, with its places, and one per run, with none."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.binary())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, copy, text in zip(*(batch.column(c).to_pylist() for c in ("id", "copy", "text")), strict=True):
                    seen: dict[bytes, list] = {}
                    some = units(text)
                    for k, (_, h, n, run) in enumerate(some):
                        if h in seen:
                            seen[h][0].append(k)
                        else:
                            seen[h] = [[k], n, run]
                    found = [(h, at, n, run) for h, (at, n, run) in seen.items()]
                    found += [(h, None, None, None) for h in run_keys([u[1] for u in some], [u[2] for u in some], least_words)]
                    for h, at, n, run in found:
                        for c, v in zip(cols, (doc, copy, h, at, n, run), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "copy", "h", "at", "words", "run"])

    return rows


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    top: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        tails[k : k + 1], top[k : k + 1] = [v], [i]
        back[i] = top[k - 1] if k else -1
    out, i = [], top[-1] if top else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def anchors(later: dict[int, int], first: dict[int, int], some: list[int], others: list[int]) -> list[tuple[int, int]]:
    """Rising pairs of places with one line: of lines that occur once on either side, else of all, the k-th with the k-th."""
    places: dict[int, tuple[list[int], list[int]]] = {}
    for side, (line, at) in enumerate(((later, some), (first, others))):
        for k in at:
            places.setdefault(line[k], ([], []))[side].append(k)
    pairs = sorted((x[0], y[0]) for x, y in places.values() if len(x) == len(y) == 1)
    if not pairs:
        pairs = sorted(p for x, y in places.values() for p in zip(x, y, strict=False))
    return [pairs[i] for i in rising([b for _, b in pairs])]


def aligned(matches: list[dict]) -> dict[int, int]:
    """Units of the later document to their partners, by patience diff that goes on between its anchors.

    Then units that repeat an aligned one get its partner, or the one after their neighbour's: a passage that the later
    document holds twice is shared twice.
    """
    later = {a: m for m, x in enumerate(matches) for a in x["at"]}
    first = {b: m for m, x in enumerate(matches) for b in x["first_at"]}
    pairs: dict[int, int] = {}
    ranges = [(sorted(later), sorted(first), -1, -1, None, None)]
    while ranges:
        some, others, a, b, c, d = ranges.pop()
        # Runs grow from the anchors at both ends of a range (at the first and last range, from the texts' begin).
        i = j = 0
        while i < len(some) and j < len(others) and some[i] == a + 1 and others[j] == b + 1 and later[some[i]] == first[others[j]]:
            a, b = some[i], others[j]
            pairs[a] = b
            i, j = i + 1, j + 1
        m, n = len(some), len(others)
        while c is not None and m > i and n > j and some[m - 1] == c - 1 and others[n - 1] == d - 1 and later[some[m - 1]] == first[others[n - 1]]:
            c, d = some[m - 1], others[n - 1]
            pairs[c] = d
            m, n = m - 1, n - 1
        some, others = some[i:m], others[j:n]
        found = anchors(later, first, some, others) if some and others else []
        if not found:
            continue
        pairs.update(found)
        ends = [(a, b), *found, (c, d)]
        for (a0, b0), (a1, b1) in zip(ends, ends[1:], strict=False):
            x = some[bisect_left(some, a0 + 1) : len(some) if a1 is None else bisect_left(some, a1)]
            y = others[bisect_left(others, b0 + 1) : len(others) if b1 is None else bisect_left(others, b1)]
            if x and y:
                ranges.append((x, y, a0, b0, a1, b1))
    partner: dict[int, int] = {}
    for a in sorted(pairs):
        partner.setdefault(later[a], pairs[a])
    for a in sorted(later):
        if a not in pairs and later[a] in partner:
            b = pairs.get(a - 1, -2) + 1
            pairs[a] = b if first.get(b) == later[a] else partner[later[a]]
    return pairs


def removed_units(least_words: int):
    """(id, copy, matches) of a pair to (id, copy, lost): unit numbers to delete; a negative one, -k - 1, keeps k's short lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for matches in batch.column("matches").to_pylist():
                pairs, lost = aligned(matches), []
                info = {a: m for m in matches for a in m["at"]}
                block: list[int] = []
                for a in [*sorted(pairs), None]:
                    if block and (a is None or a != block[-1] + 1 or pairs[a] != pairs[block[-1]] + 1):
                        if sum(info[k]["words"] for k in block) >= least_words:
                            lost += [k if info[k]["same_run"] else -k - 1 for k in block]
                        block = []
                    if a is not None:
                        block.append(a)
                out.append(lost)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), pa.array(out, pa.list_(pa.int32()))], names=["id", "copy", "lost"])

    return run


def without(text: str, lost: list[int]) -> tuple[str, int]:
    drop: set[int] = set()
    some = units(text)
    for k in lost:
        drop.update(some[k][0] if k >= 0 else some[-k - 1][0][:1])
    lines = text.split("\n")
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(drop)


def cleaned(texts: pa.Array, lost: pa.Array) -> pa.Array:
    out = [(t, 0) if not x else without(t, x) for t, x in zip(texts.to_pylist(), lost.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], names=["text", "n"])


def lost_units(docs: DataFrame, least_words: int = 10) -> DataFrame:
    """id, copy (hash of the text), lost: the units that each document loses; documents that lose none are absent."""
    prepare(docs.sparkSession)
    rows = docs.select(known_id().alias("id"), F.xxhash64("text").alias("copy"), F.col("text").cast("string").alias("text")).filter("text is not null")
    found = written(rows.mapInArrow(unit_rows(least_words), UNITS), "units")
    runs, lines = found.filter("at is null").select("id", "copy", "h"), found.filter("at is not null")
    # Written, so that the joins shuffle both sides anew and the side of a hot run or document can be split.
    first = written(runs.groupBy("h").agg(F.min(F.struct("id", "copy")).alias("first"), F.max("id").alias("last")).filter("last > first.id").select("h", "first"), "holders")
    paired = runs.join(first, "h").filter("id > first.id").select("id", "copy", F.col("first.id").alias("holder"), F.col("first.copy").alias("holder_copy")).distinct()
    paired = written(paired, "pairs")
    held = lines.join(paired.select(F.col("holder").alias("id"), F.col("holder_copy").alias("copy")).distinct(), ["id", "copy"], "left_semi")
    held = held.select(F.col("id").alias("holder"), F.col("copy").alias("holder_copy"), "h", F.col("at").alias("first_at"), F.col("run").alias("first_run")).distinct()
    mine = lines.distinct().join(paired, ["id", "copy"])
    matched = mine.join(held, ["holder", "holder_copy", "h"])
    pairs = matched.groupBy("id", "copy", "holder", "holder_copy").agg(
        F.collect_set(F.struct("at", "first_at", "words", (F.col("run") == F.col("first_run")).alias("same_run"))).alias("matches")
    )
    lost = pairs.select("id", "copy", "matches").mapInArrow(removed_units(least_words), "id long, copy long, lost array<int>").filter("size(lost) > 0")
    return lost.groupBy("id", "copy").agg(F.array_distinct(F.flatten(F.collect_list("lost"))).alias("lost"))


def dedup_lines(docs: DataFrame, least_words: int = 10, removed: str | None = None) -> DataFrame:
    """docs with the shared blocks taken out of text (and n_chars, where there is one, counted anew).

    removed: the name of a column to add with the number of lines that went.
    """
    i, c, gone, new, maybe = free_names(docs, "id", "copy", "lost", "new", "maybe")
    lost = written(lost_units(docs, least_words).toDF(i, c, gone), "lost")
    keyed = docs.withColumns({i: known_id(), c: F.xxhash64("text")})
    marked = keyed.withColumn(maybe, maybe_in(F.xxhash64(i, c), lost, F.xxhash64(i, c)))
    # Only documents that lose lines are shuffled; the others are answered where they are read.
    again = marked.filter(maybe).join(lost.hint("merge"), [i, c], "left")  # alike at every size
    again = again.withColumn(new, F.arrow_udf(cleaned, "struct<text: string, n: int>")(F.col("text").cast("string"), gone))
    cols = {x: F.col(f"`{new}`.text") if x == "text" else F.when(F.col(gone).isNull(), F.col(x)).otherwise(F.length(F.col(f"`{new}`.text"))) if x == "n_chars" else F.col(x) for x in docs.columns}
    extra = [] if removed is None else [removed]
    same = marked.filter(~F.col(maybe)).select(*(F.col(x).cast("string") if x == "text" else F.col(x) for x in docs.columns), *(F.lit(0).alias(x) for x in extra))
    return same.union(again.select(*(v.cast(docs.schema[x].dataType if x != "text" else "string").alias(x) for x, v in cols.items()), *(F.col(f"`{new}`.n").alias(x) for x in extra)))

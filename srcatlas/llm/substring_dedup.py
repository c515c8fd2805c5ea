"""Exact removal of repeated byte strings by a hash-compared suffix sort around shared anchors.

Every byte covered by a string of MATCH bytes that also starts earlier (smaller doc_id, or earlier in the document) goes.

Anchors: the K-byte grams of a string of MATCH bytes are hashed, and the positions of the smallest hash are its anchors.
Equal strings have equal anchors at equal places, so repeats meet at anchors of one gram; about one position in 39 is one.
Pass one sends per task the first anchor of each (gram, context), the context being the up to 2 * REST + K bytes that any
string with that gram in it can cover. A later anchor with an equal context (128 bits with the gram's hash) is covered
whole. Only grams with several contexts need bytes: pass two fetches the contexts of their first anchors, sorts the two
sides of each gram as suffixes by mergesort, where prefix polynomial hashes and binary search give the common extension
of two suffixes in logarithmic steps, checks neighbours' common bytes against collisions, and reads from the sorted runs
which strings occur earlier. Bytes that go are judged on the input.

Texts move only for documents that a bit filter of fixed size does not rule out; the others are answered where they lie.

Rows: null text is empty. A null doc_id is the earliest. Repeated rows are one document and get equal results; rows with
one doc_id and different texts count as documents in the order of their texts' hashes. Empty tables give no rows; other
columns are ignored.

Frequent grams: equal contexts leave a task once. A gram with more than HOT contexts streams through its task and is then
divided: its strings fall into RANGES by their place around the gram, and each range is keyed by the bytes that all its
strings share, so contexts that differ there part, and those that agree on a whole range again leave a task once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import known_id, known_text, prepare, shown_id, written
from .textvec import U, mix, prefix_hash, slices, span_hash, utf8

MATCH, K = 100, 24
REST = MATCH - K
#: Anchors that a task holds before it sends them.
HELD = 300_000
#: Rows of a batch that goes back to Spark.
ROWS = 20_000
FILTER_BITS = 1 << 22
#: Contexts of one gram that are compared as they are.
HOT = 20_000
#: Places (bytes of a string before the gram) that are compared together for a gram with more.
RANGES = [(lo, min(lo + 9, REST)) for lo in range(0, REST + 1, 10)]
FOUND = "kind int, doc long, a int, b int, gram long"
ANCHOR, RESOLVED, SPAN, DIVIDED = 0, 1, 2, 3


def sliding(x: np.ndarray, width: int, op: Callable) -> np.ndarray:
    """op over x[i : i + width], for every i that has it."""
    have, out = 1, x
    while 2 * have <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    more = width - have
    return op(out[: len(out) - more], out[more:]) if more else out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in it, gram hash and context hash of every anchor of a batch."""
    size = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if len(data) < MATCH or size.max(initial=0) < MATCH:
        return none, none, none.view(U), none.view(U)
    p = prefix_hash(data)
    n = len(data)
    at = np.arange(n - K + 1)
    gram = span_hash(p, at, at + K)
    order = (gram >> U(32)).astype(np.uint32)
    left_in_doc = np.repeat(offsets[1:], size) - np.arange(n)
    order[left_in_doc[: len(order)] < K] = 0xFFFFFFFF
    low = sliding(order, REST + 1, np.minimum)
    low[left_in_doc[: len(low)] < MATCH] = 0
    padded = np.zeros(len(low) + 2 * REST, np.uint32)
    padded[REST : REST + len(low)] = low
    top = sliding(padded, REST + 1, np.maximum)[: len(order)]
    found = np.flatnonzero((top == order) & (left_in_doc[: len(order)] >= K))
    doc = np.searchsorted(offsets, found, "right") - 1
    begin, end = np.maximum(offsets[doc], found - REST), np.minimum(offsets[doc + 1], found + K + REST)
    context = mix(span_hash(p, begin, end) + (found - begin).astype(U))
    return doc, found - offsets[doc], gram[found], context


def spans_of(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge spans that touch; spans of equal documents stand together in order of a, and b rises with a."""
    if not len(doc):
        return doc, a, b
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > b[:-1])
    at = np.flatnonzero(new)
    return doc[at], a[at], np.maximum.reduceat(b, at)


def rows_of(kind: int, doc: np.ndarray, a: np.ndarray, b: np.ndarray, gram: np.ndarray | None = None) -> pa.RecordBatch:
    gram = mix(doc.astype(U)) if gram is None else gram
    cols = [np.full(len(doc), kind, np.int32), doc.astype(np.int64), a.astype(np.int32), b.astype(np.int32), gram.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "doc", "a", "b", "gram"])


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to the task's first anchors by gram and context, and spans of what repeats inside the task."""
    held: list[tuple] = []
    count = 0

    def sent() -> Iterator[pa.RecordBatch]:
        doc, at, gram, context = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, doc, context, gram))
        doc, at, gram, context = doc[order], at[order], gram[order], context[order]
        first = np.ones(len(doc), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
        cols = [np.full(first.sum(), ANCHOR, np.int32), doc[first], at[first].astype(np.int32), np.zeros(first.sum(), np.int32), gram[first].view(np.int64), context[first].view(np.int64)]
        out = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "doc", "a", "b", "gram", "context"])
        yield from (out.slice(i, ROWS) for i in range(0, out.num_rows, ROWS))
        doc, at = doc[~first], at[~first]
        order = np.lexsort((at, doc))
        doc, a, b = spans_of(doc[order], np.maximum(0, at[order] - REST), at[order] + MATCH)
        some = rows_of(SPAN, doc, a, b)
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.zeros(len(doc), np.int64))], names=[*some.schema.names, "context"])

    for whole in batches:
        for batch in slices(whole, "text", 1 << 19):
            data, offsets = utf8(batch.column("text"))
            doc, at, gram, context = anchors(data, offsets)
            held.append((batch.column("doc").to_numpy()[doc], at, gram, context))
            count += len(doc)
            if count > HELD:
                yield from sent()
                held, count = [], 0
    if count:
        yield from sent()


def by_group(names: list[str], key: str, work: Callable) -> Callable:
    """For mapInArrow over rows in order of key: work on whole groups, some thousand rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch.select(names)])
            now = now if kept is None else pa.concat_tables([kept, now])
            keys = now.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield from work(now.slice(0, cut))
            kept = now.slice(cut)
        if kept is not None and kept.num_rows:
            yield from work(kept)

    return run


def meet(hot: int) -> Callable:
    """For mapInArrow over rows in order of gram, context, doc and a: later anchors of a context are resolved, first ones
    of several contexts stay open. Grams of more than 2 * hot rows are not held: they stream, and all their first ones stay
    open to be divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]
        big, last = None, None  # the gram that streams, its context so far
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            cols = [batch.column(c).to_numpy() for c in ("doc", "a", "gram", "context")]
            span = kind == SPAN
            yield rows_of(SPAN, cols[0][span], cols[1][span], batch.column("b").to_numpy()[span])
            now = [np.concatenate([k, c[~span]]) for k, c in zip(kept, cols, strict=True)]
            if big is not None:
                n = int(np.searchsorted(now[2] != big, True)) if (now[2] != big).any() else len(now[2])
                yield from streamed([c[:n] for c in now], last)
                last = now[3][n - 1] if n else last
                now = [c[n:] for c in now]
                big = None if len(now[2]) else big
            cut = int(np.searchsorted(now[2], now[2][-1])) if len(now[2]) else 0
            yield from met([c[:cut] for c in now])
            kept = [c[cut:] for c in now]
            if len(kept[2]) > 2 * hot:
                yield from streamed(kept, None)
                big, last = kept[2][-1], kept[3][-1]
                kept = [c[:0] for c in kept]
        yield from met(kept)

    def streamed(cols: list[np.ndarray], last) -> Iterator[pa.RecordBatch]:
        doc, a, gram, context = cols
        later = np.zeros(len(doc), bool)
        later[1:] = context[1:] == context[:-1]
        later[:1] = last is not None and context[:1] == last
        yield rows_of(RESOLVED, doc[later], np.maximum(0, a[later] - REST), a[later] + MATCH)
        yield rows_of(DIVIDED, doc[~later], a[~later], np.zeros((~later).sum(), np.int32), gram[~later])

    def met(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, a, gram, context = cols
        later = np.zeros(len(doc), bool)
        later[1:] = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])
        yield rows_of(RESOLVED, doc[later], np.maximum(0, a[later] - REST), a[later] + MATCH)
        # Among the first ones of a context, those whose gram has another context.
        doc, a, gram = doc[~later], a[~later], gram[~later]
        same = np.zeros(len(doc) + 1, bool)
        same[1:-1] = gram[1:] == gram[:-1]
        open_ = same[:-1] | same[1:]
        if open_.any():
            # A gram with more contexts than are compared at once is divided as a whole.
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            many = np.repeat(np.diff(np.append(first, len(gram))) > hot, np.diff(np.append(first, len(gram))))
            for kind, some in ((ANCHOR, open_ & ~many), (DIVIDED, open_ & many)):
                yield rows_of(kind, doc[some], a[some], np.zeros(some.sum(), np.int32), gram[some])

    return run


def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, at: list of (a, gram, kind)) to (kind, gram, doc, a, b, bytes, lo, hi).

    An open anchor becomes its context, b being the bytes before the gram and lo to hi the places to compare. A divided one
    becomes one context a range, cut down to what the range's strings cover; of equal ones the task sends the earliest, and
    the spans (kind SPAN, a to b) of the others.
    """
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    names = ["kind", "gram", "doc", "a", "b", "bytes", "lo", "hi"]
    seen: dict[tuple, tuple[int, int]] = {}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def span(lo: int, hi: int, before: int, after: int, doc: int, a: int) -> tuple:
        """What the strings of a range cover around the anchor at a."""
        return (SPAN, doc, doc, a - min(hi, before), a - max(lo, REST - after) + MATCH, None, 0, 0)

    for batch in batches:
        rows: list[tuple] = []
        for doc, text, some in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "at")), strict=True):
            data = text.encode()
            for x in some:
                a = x["a"]
                before, after = min(REST, a), min(REST, len(data) - a - K)
                if x["kind"] == ANCHOR:
                    rows.append((ANCHOR, x["gram"], doc, a, before, data[a - before : a + K + after], 0, REST))
                    continue
                for lo, hi in RANGES:
                    if before >= lo and after >= REST - hi and before + after >= REST:
                        left, right = min(hi, before), min(REST - lo, after)
                        if min(hi, before) < max(lo, REST - after):
                            continue
                        key = (lo, left, data[a - left : a + K + right])
                        old = seen.get(key)
                        if old is None or (doc, a) < old:
                            seen[key] = (doc, a)
                        late = (doc, a) if old is not None and seen[key] == old else old
                        if late is not None and late != seen[key]:
                            rows.append(span(lo, hi, left, right, *late))
        yield batch_of(rows)
    rows = []
    for (lo, left, blob), (doc, a) in seen.items():
        hi = dict(RANGES)[lo]
        shared = blob[left - lo : left + K + REST - hi]
        key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=lo.to_bytes(8, "big")).digest(), "big", signed=True)
        rows.append((DIVIDED, key, doc, a, left, blob, lo, hi))
        if len(rows) >= ROWS:
            yield batch_of(rows)
            rows = []
    yield batch_of(rows)


class Sides:
    """Suffixes of at most REST bytes, one a row: bytes, lengths and hashes of all prefixes."""

    def __init__(self, rows: np.ndarray, length: np.ndarray):
        self.rows, self.length = rows, length
        self.prefix = np.zeros((len(rows), REST + 1), U)
        power = np.cumprod(np.concatenate([[U(1)], np.full(REST - 1, U(0x9E3779B97F4A7C15))]), dtype=U)
        np.cumsum((rows.astype(U) + U(1)) * power, axis=1, out=self.prefix[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of suffixes i and j by binary search on prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.prefix[i, mid] == self.prefix[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        ended = (n == self.length[i]) | (n == self.length[j])
        k = np.minimum(n, REST - 1)
        return np.where(ended, self.length[i] < self.length[j], self.rows[i, k] < self.rows[j, k])

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in order of suffix inside their group (groups stand together), and each one's common bytes with the one before.

        A bottom-up mergesort, all groups and runs of a level at once: a row's place is its own plus its rank in the sister run.
        """
        n = len(group)
        begin = np.searchsorted(group, group)
        end = np.searchsorted(group, group, "right")
        order, width, most = np.arange(n), 1, int((end - begin).max(initial=0))
        while width < most:
            place = np.arange(n)
            run = (place - begin) // width
            own = begin + run * width
            sister = np.where(run % 2 == 0, own + width, own - width)
            low = np.minimum(sister, end)
            stop = np.minimum(low + width, end)
            first, right = low.copy(), run % 2 == 1
            while (live := np.flatnonzero(low < stop)).size:
                mid = (low[live] + stop[live]) // 2
                me, other = order[live], order[mid]
                # A row of the left run goes before equal ones of the right run.
                up = np.where(right[live], ~self.less(me, other), self.less(other, me))
                low[live], stop[live] = np.where(up, mid + 1, low[live]), np.where(up, stop[live], mid)
            moved = np.empty_like(order)
            moved[np.minimum(own, np.where(right, sister, own)) + (place - own) + (low - first)] = order
            order, width = moved, width * 2
        lcp = np.zeros(n, np.int64)
        lcp[1:] = self.common(order[1:], order[:-1])
        return order, lcp

    def checked(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sorted(), with neighbours compared byte by byte; should hashes have collided, bytes alone decide."""
        order, lcp = self.sorted(group)
        if (exact := self.bytes_in_common(order)).tolist() != lcp.tolist():
            order = np.lexsort((self.length, *self.rows.T[::-1], group))
            exact = self.bytes_in_common(order)
        return order, exact

    def bytes_in_common(self, order: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), np.int64)
        if len(order) > 1:
            same = self.rows[order[1:]] == self.rows[order[:-1]]
            run = np.where(same.all(axis=1), REST, same.argmin(axis=1))
            out[1:] = np.minimum(run, np.minimum(self.length[order[1:]], self.length[order[:-1]]))
        return out


def runs(order: np.ndarray, lcp: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """A number per row that is equal for rows of a group with `least` common bytes."""
    g = group[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (lcp[1:] < least)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Contexts of whole grams to the spans of strings that start earlier; spans pass."""
    done = rows.filter(pc.equal(rows.column("kind"), SPAN))
    yield rows_of(SPAN, *(done.column(c).to_numpy() for c in ("doc", "a", "b")))
    rows = rows.filter(pc.not_equal(rows.column("kind"), SPAN))
    gram, doc, a, before, least, most = (rows.column(c).to_numpy() for c in ("gram", "doc", "a", "b", "lo", "hi"))
    blobs = rows.column("bytes").to_pylist()
    left, right = np.zeros((len(doc), REST), np.uint8), np.zeros((len(doc), REST), np.uint8)
    middle = np.zeros((len(doc), K), np.uint8)
    after = np.zeros(len(doc), np.int64)
    for i, blob in enumerate(blobs):
        x = np.frombuffer(blob, np.uint8)
        n = before[i]
        left[i, :n], middle[i], tail = x[:n][::-1], x[n : n + K], x[n + K :]
        right[i, : len(tail)], after[i] = tail, len(tail)
    # Groups by the gram's hash and, against collisions, its bytes.
    cell = np.ascontiguousarray(middle).view(np.dtype((np.void, K))).ravel()
    _, word = np.unique(cell, return_inverse=True)
    order = np.lexsort((a, doc, word, gram))
    doc, a, before, left, right, after = doc[order], a[order], before[order].astype(np.int64), left[order], right[order], after[order]
    least, most = least[order], most[order]
    new = np.ones(len(doc), bool)
    new[1:] = (gram[order][1:] != gram[order][:-1]) | (word[order][1:] != word[order][:-1])
    group = np.cumsum(new) - 1
    l_order, l_lcp = Sides(left, before).checked(group)
    r_order, r_lcp = Sides(right, after).checked(group)
    n = len(doc)
    low, high = np.full(n, MATCH), np.full(n, -1)
    for o in range(REST + 1):
        fit = np.flatnonzero((before >= o) & (after >= REST - o) & (least <= o) & (o <= most))
        if len(fit) < 2:
            continue
        key = runs(l_order, l_lcp, group, o)[fit] * n + runs(r_order, r_lcp, group, REST - o)[fit]
        # Rows stand in order of document and place inside a group, so the first of a key is the earliest.
        again = np.argsort(key, kind="stable")
        same = key[again[1:]] == key[again[:-1]]
        hit = fit[again[1:][same]]
        low[hit], high[hit] = np.minimum(low[hit], o), np.maximum(high[hit], o)
    some = high >= 0
    yield rows_of(SPAN, doc[some], a[some] - high[some], a[some] - low[some] + MATCH)


def bit_filter(found: DataFrame, docs: DataFrame) -> Column:
    """A column of docs that is false only for documents that found does not name. FILTER_BITS bits pass through the driver."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
    marks = found.select(slot.alias("s")).groupBy(F.shiftright("s", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(32767)).alias("bits"))
    table = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for k, bits in marks.collect():
        table[k] = np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table.ravel())

    def seen(column: pa.Array) -> pa.Array:
        s = column.to_numpy()
        return pa.array(shared.value[s >> 3] >> (s & 7).astype(np.uint8) & 1 == 1)

    return F.arrow_udf(seen, "boolean")(slot)


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, spans) to the result; spans may overlap and reach over the end."""
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans")), strict=True):
            data, kept, at, gone, count = text.encode(), hashlib.sha256(), 0, 0, 0
            last = -1
            for a, b in sorted((s["a"], min(s["b"], len(data))) for s in spans or ()):
                if b <= a:
                    continue
                if a > last:
                    kept.update(data[at:a])
                    count += 1
                    gone += b - a
                elif b > last:
                    gone += b - last
                last = max(last, b)
                at = last
            kept.update(data[at:])
            out.append((doc, len(data), gone, count, kept.hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (*(pa.int64(),) * 4, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """docs (doc long, text string), doc unique: doc, a, b of byte strings that start earlier; spans may overlap.

    Also returns a written table that names (doc) every document with such a span, and some without.
    """
    wide = docs.filter(F.octet_length("text") >= MATCH)
    sent = wide.mapInArrow(anchor_rows, FOUND + ", context long")
    ordered = sent.repartition("gram").sortWithinPartitions("gram", "context", "doc", "a")
    met = written(ordered.mapInArrow(meet(hot), FOUND), "anchors")
    open_ = met.filter(F.col("kind").isin(ANCHOR, DIVIDED))
    waiting = open_.groupBy("doc").agg(F.collect_list(F.struct("a", "gram", "kind")).alias("at"))
    near = wide.filter(bit_filter(open_, wide)).join(waiting, "doc")
    contexts = near.select("doc", "text", "at").mapInArrow(context_rows, "kind int, gram long, doc long, a int, b int, bytes binary, lo int, hi int")
    names = ["kind", "gram", "doc", "a", "b", "bytes", "lo", "hi"]
    compared = contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(by_group(names, "gram", compare), FOUND)
    return met.filter(F.col("kind").isin(RESOLVED, SPAN)).select("doc", "a", "b").union(compared.select("doc", "a", "b")), met


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as (doc, text) with unique doc, and the table (doc_id, copy, doc) to go back; ids that repeat are counted anew."""
    keys = docs.select("doc_id", "copy").distinct()
    dealt = written(keys.repartitionByRange("doc_id", "copy").withColumn("part", F.spark_partition_id()), "keys")
    base, at = [], 0
    for part, n in sorted(dealt.groupBy("part").count().collect()):
        base.append((part, at))
        at += n
    from pyspark.sql import Window

    base_df = docs.sparkSession.createDataFrame(base, "part int, base long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "copy"))
    ids = dealt.withColumn("rank", rank).join(F.broadcast(base_df), "part").select("doc_id", "copy", (F.col("base") + F.col("rank")).alias("doc"))
    ids = written(ids, "numbers")
    return docs.join(ids, ["doc_id", "copy"]).groupBy("doc").agg(F.first("text").alias("text")), ids


def dedup_substrings(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. hot: contexts of one gram compared as they are."""
    prepare(docs.sparkSession)
    rows = docs.select(known_id().alias("doc_id"), known_text().alias("text"))
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return results(rows.withColumnRenamed("doc_id", "doc"), hot).withColumn("doc", shown_id("doc")).withColumnRenamed("doc", "doc_id")
    keyed = rows.withColumn("copy", F.xxhash64("text"))
    one, ids = numbered(keyed)
    back = keyed.select("doc_id", "copy").join(ids, ["doc_id", "copy"]).join(results(written(one, "documents"), hot), "doc").drop("doc", "copy")
    return back.withColumn("doc_id", shown_id("doc_id"))


def results(rows: DataFrame, hot: int) -> DataFrame:
    found, named = repeated_spans(rows, hot)
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    marked = rows.withColumn("_maybe", bit_filter(named, rows))
    whole = marked.filter(~F.col("_maybe")).select(
        "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
    )
    cut = marked.filter("_maybe").select("doc", "text").join(spans, "doc", "left").select("doc", "text", "spans")
    return whole.union(cut.mapInArrow(cut_rows, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))

"""Cross-entropy difference of two matched bigram models with exact counts.

The target model counts documents labelled with quality 1, the background model all documents. Both share one vocabulary, all
V words of the corpus, one order and one smoothing, and background counts are scaled by the ratio r of the models' tokens, so
both are of one size:
    p(w | h) = (c(h, w) + MU / V) / (c(h) + MU).
A document is scored by what all other documents count: its own tokens are taken out of every count. Its score is the mean
over its tokens of -log p_target + log p_background: the lower, the more it is like the target.

Nothing is hashed into shared slots or cut off; what is counted grows with the corpus and stays distributed. Tokens (history,
word, document) are dealt into buckets by history, so a bucket has all that p needs, and sums by document go back to the
block of documents that they came from. Words that have over a quarter of a bucket's tokens are hot, as are such pairs; there
are at most 4 times as many of either as there are buckets, and never more than MOST_HOT, so their counts are broadcast. A
hot pair is scored where it is read, and pairs of a hot history are dealt by both words. The number of buckets follows the
number of tokens, so a bucket fits a task. A block is known by a hash of its rows and counts the tokens that come back.

Rows: null text is empty; a text without words has 0 tokens and score 0.0. A null doc_id is scored and is never a target.
Several labels of one doc_id count as 1 if one is. Repeated rows count and score each; each is another document to the others.
Without target texts the target model is the smoothing alone. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, maybe_in, prepare, written
from .textvec import BASE, U, Words, mix, slices

MU = 50.0
#: Tokens of a bucket and of a block of documents; hot words and pairs that are broadcast.
BUCKET, BLOCK_BYTES, MOST_HOT = 1 << 19, 4 << 20, 1 << 20
#: The word before a text's first one.
START = U(0x5DEECE66D)
#: The key of all tokens among the counts of hot keys.
ALL = U(0x2545F4914F6CDD1D)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word and history of every token, as hashes."""
    w = Words(column)
    before = np.empty_like(w.hash)
    before[1:] = w.hash[:-1]
    before[w.ptr[:-1][np.diff(w.ptr) > 0]] = START
    return w.doc, w.hash, before


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * U(BASE) + w)


def counted(keys_of):
    """For mapInArrow: (text, target) to (key, target, background): counts of keys by task, merged now and then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple:
            key, at = np.unique(np.concatenate([np.zeros(0, U), *(k for k, *_ in held)]), return_inverse=True)
            return key, *(np.bincount(at, np.concatenate([np.zeros(0, np.int64), *(x[i] for x in held)]), len(key)).astype(np.int64) for i in (1, 2))

        for whole in batches:
            for batch in slices(whole, "text"):
                key, doc = keys_of(batch.column("text"))
                key, at = np.unique(key, return_inverse=True)
                aim = batch.column("target").to_numpy(zero_copy_only=False)[doc]
                held.append((key, np.bincount(at[aim], minlength=len(key)), np.bincount(at, minlength=len(key))))
                size += len(key)
                if size > 2_000_000:  # a long task stays at its distinct keys
                    held = [merged()]
                    size = 0
        key, *n = merged()
        out = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, n)], names=["key", "target", "background"])
        yield from (out.slice(i, 50_000) for i in range(0, out.num_rows, 50_000))
        give_back()

    return run


COUNTS = "key long, target long, background long"


@dataclass
class Hot:
    """Counts of hot keys, sorted by key: rows of target and background."""

    keys: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(rows: DataFrame) -> Hot:
        """rows: COUNTS of keys that have over one part in MOST_HOT of all tokens, so there are fewer than that."""
        some = rows.toPandas()
        keys = some.key.to_numpy(np.int64).view(U)
        order = np.argsort(keys)
        return Hot(keys[order], some[["target", "background"]].to_numpy(np.int64).reshape(-1, 2)[order])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where they are not hot."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Plan:
    """What both sides of the exchange know: hot words and pairs, smoothing, ratio of sizes, number of buckets."""

    words: Hot
    pairs: Hot
    size: int
    ratio: float
    buckets: int

    def numerator(self, counts: np.ndarray) -> np.ndarray:
        """log(target) - log(background) of pair counts without the document's own, a row a token."""
        return np.log(counts[:, 0] + MU / self.size) - np.log(counts[:, 1] * self.ratio + MU / self.size)

    def denominator(self, counts: np.ndarray) -> np.ndarray:
        return np.log(counts[:, 0] + MU) - np.log(counts[:, 1] * self.ratio + MU)


def own_counts(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each row's (doc, key) occurs."""
    order = np.lexsort((key, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group)[group] if len(order) else 0
    return out


BLOCKS = "bucket int, block long, at binary, hist binary, runs binary, words binary"
#: The bucket of rows that stay with their block: ids, null flags, tokens and sums of its documents, and its other tokens in number.
HOME = -1


def dealt(plan):
    """For mapInArrow: (doc_id, text, target) to BLOCKS: a block's tokens of a bucket, in order of history.

    at is twice each token's place in the block, and one more in a target; hist and runs are distinct histories and their
    tokens, words the hashes. The HOME row has what is known at once.
    """
    from xxhash import xxh3_64_intdigest as xx

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                aims = batch.column("target").to_numpy(zero_copy_only=False)
                ids = batch.column("doc_id")
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                found, base, block = [], 0, xx(ids.tobytes() + nulls.tobytes() + aims.tobytes())
                for part in slices(batch, "text"):  # words are found in smaller pieces, which need less memory
                    doc, word, before = grams(part.column("text"))
                    found.append((doc + base, word, before))
                    base += part.num_rows
                    block = xx(word.tobytes(), block)
                doc, word, before = (np.concatenate(x) for x in zip(*found, strict=True))
                block = int(np.array([block], U).view(np.int64)[0])
                tokens, aim, sums = np.bincount(doc, minlength=len(ids)), aims[doc].astype(np.int64), np.zeros(len(ids))
                hot, pair = p.words.find(before), pair_hash(before, word)
                known = p.pairs.find(pair)
                for places, key, counts, value, sign in ((hot, before, p.words.counts, p.denominator, -1), (known, pair, p.pairs.counts, p.numerator, 1)):
                    some = np.flatnonzero(places >= 0)
                    if len(some):
                        n = own_counts(doc[some], key[some])
                        left = counts[places[some]] - np.stack([n * aim[some], n], axis=1)
                        sums += sign * np.bincount(doc[some], value(left), len(ids))
                rest = np.flatnonzero(known < 0)
                yield rows_of([(HOME, block, ids, nulls, tokens.astype(np.int64), np.append(sums, len(rest)))])
                bucket = (np.where(hot[rest] >= 0, pair[rest], mix(before[rest])) % U(p.buckets)).astype(np.int64)
                order = np.lexsort((before[rest], bucket))
                rest, bucket = rest[order], bucket[order]
                narrow = np.uint16 if len(ids) <= 1 << 15 else np.uint32
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                rows = []
                for t, b in zip(np.split(rest, cuts), bucket[np.concatenate([[0], cuts]).astype(int)] if len(rest) else (), strict=False):
                    hist, runs = np.unique(before[t], return_counts=True)
                    rows.append((int(b), block, (2 * doc[t] + aim[t]).astype(narrow), hist, runs.astype(np.uint32), word[t]))
                for k in range(0, len(rows), 64):
                    yield rows_of(rows[k : k + 64])
        give_back()

    return run


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())] + [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(2, 6)]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in BLOCKS.split(", ")])


def summed(plan):
    """For mapInArrow over all rows of buckets: BLOCKS to BLOCKS, now with words as the sum (32-bit) of each document in at and
    runs as the number of tokens in them. Whole buckets are held, which the plan bounds; HOME rows pass."""

    def of_bucket(held: list[dict]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        words = [np.frombuffer(r["words"], U) for r in held]
        ats = [np.frombuffer(r["at"], f"<u{len(r['at']) // len(w)}").astype(np.int64) for r, w in zip(held, words, strict=True)]
        base = np.cumsum([0, *(int(a.max()) // 2 + 1 for a in ats)])
        doc = np.concatenate([a // 2 + b for a, b in zip(ats, base[:-1], strict=True)])
        aim = np.concatenate(ats) % 2
        hist = np.concatenate([np.repeat(np.frombuffer(r["hist"], U), np.frombuffer(r["runs"], np.uint32)) for r in held])
        pair = pair_hash(hist, np.concatenate(words))

        def left(key: np.ndarray, doc: np.ndarray, aim: np.ndarray) -> np.ndarray:
            """Counts of each token's key without those of its own document."""
            _, at = np.unique(key, return_inverse=True)
            n = own_counts(doc, at)
            return np.stack([np.bincount(at, aim)[at] - n * aim, np.bincount(at)[at] - n], axis=1)

        value = p.numerator(left(pair, doc, aim))
        cold = np.flatnonzero(p.words.find(hist) < 0)
        if len(cold):
            value[cold] -= p.denominator(left(hist[cold], doc[cold], aim[cold]))
        total, out = np.bincount(doc, value, base[-1]), []
        for r, a, b in zip(held, ats, base[:-1], strict=True):
            have = np.unique(a // 2)
            out.append((r["bucket"], r["block"], have.astype(f"<u{len(r['at']) // len(a)}"), np.zeros(0), np.array([len(a)]), total[b + have].astype(np.float32)))
        yield rows_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            home = pa.compute.equal(batch.column("bucket"), HOME)
            if home.true_count:
                yield batch.filter(home)
            for r in batch.filter(pa.compute.invert(home)).to_pylist():
                if held and r["bucket"] != held[0]["bucket"]:
                    yield from of_bucket(held)
                    held = []
                held.append(r)
        if held:
            yield from of_bucket(held)
        give_back()

    return run


SCORES = "doc_id long, n_tokens long, score double"


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BLOCKS in order of block and bucket, the HOME rows of a block first, to SCORES. Equal blocks share what comes back."""

    def of_block(home: list[dict], total: np.ndarray, returned: int) -> pa.RecordBatch:
        ids = np.frombuffer(home[0]["at"], np.int64)
        sums, sent = np.frombuffer(home[0]["words"], np.float64)[:-1], int(np.frombuffer(home[0]["words"], np.float64)[-1])
        if returned != sent * len(home):
            raise ValueError("tokens of a block are missing or came twice")
        n = np.frombuffer(home[0]["runs"], np.int64)
        score = np.where(n > 0, -(sums + total / len(home)) / np.maximum(n, 1), 0.0) + 0.0
        nulls = np.frombuffer(home[0]["hist"], bool)
        cols = [pa.array(np.tile(ids, len(home)), mask=np.tile(nulls, len(home))), pa.array(np.tile(n, len(home))), pa.array(np.tile(score, len(home)))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "score"])

    home: list[dict] = []
    total, returned, opened = np.zeros(0), 0, False
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] == HOME and (opened or home and home[0]["block"] != r["block"]):
                yield of_block(home, total, returned)
                home, opened = [], False
            if r["bucket"] == HOME:
                home.append(r)
                total, returned = np.zeros(len(r["at"]) // 8), 0
                continue
            if not home or r["block"] != home[0]["block"]:
                raise ValueError("tokens of a block are missing or came twice")
            opened = True
            values = np.frombuffer(r["words"], np.float32)
            total[np.frombuffer(r["at"], f"<u{len(r['at']) // len(values)}")] += values
            returned += int(np.frombuffer(r["runs"], np.int64)[0])
    if home:
        yield of_block(home, total, returned)


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, target: only texts that may be targets are shuffled. Rows stand in the same order whenever a task runs."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.max("quality").alias("_q")).filter("_q = 1 and _label_id is not null").select("_label_id")
    good = written(good, "targets")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tagged = rows.withColumn("maybe", F.col("doc_id").isNotNull() & maybe_in(F.coalesce("doc_id", F.lit(0)), good, F.col("_label_id")))
    maybe = tagged.filter("maybe").join(good.hint("merge"), F.col("doc_id") == F.col("_label_id"), "left").select("doc_id", "text", F.col("_label_id").isNotNull().alias("target"))
    return tagged.filter("not maybe").select("doc_id", "text", F.lit(False).alias("target")).union(maybe.sortWithinPartitions("doc_id", F.xxhash64("text")))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score of every row."""
    spark = docs.sparkSession
    prepare(spark)
    plain = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(False).alias("target"))
    total = [F.sum(c).alias(c) for c in ("target", "background")]
    words = written(plain.mapInArrow(counted(words_and_starts), COUNTS).groupBy("key").agg(*total), "words")
    n, distinct = words.agg(F.coalesce(F.sum("background"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))
    above = n / min(4 * buckets, MOST_HOT)
    known = spark.sparkContext.broadcast(Hot.of(words.filter(F.col("background") > above)))
    texts = marked(docs, labels)

    def hot_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hot words as histories, pairs of hot words, and all tokens."""
        doc, word, before = grams(column)
        some = np.flatnonzero(known.value.find(before) >= 0)
        both = some[known.value.find(word[some]) >= 0]
        return np.concatenate([before[some], pair_hash(before[both], word[both]), np.full(len(doc), ALL)]), np.concatenate([doc[some], doc[both], doc])

    hot = written(texts.select("text", "target").mapInArrow(counted(hot_keys), COUNTS).groupBy("key").agg(*total), "hot")
    sizes = hot.filter(F.col("key") == int(np.array([ALL]).view(np.int64)[0])).select("target", "background").first() or (0, 0)
    of_words = hot.join(words.filter(F.col("background") > above).select("key"), "key", "left_semi")
    of_pairs = hot.join(words.select("key"), "key", "left_anti").filter(F.col("background") > above)
    plan = spark.sparkContext.broadcast(Plan(Hot.of(of_words), Hot.of(of_pairs), max(1, distinct), sizes[0] / sizes[1] if sizes[1] else 1.0, buckets))
    # A partition may have several buckets, one after another; each is worked on alone.
    sent = texts.mapInArrow(dealt(plan), BLOCKS).repartition(buckets, F.when(F.col("bucket") == HOME, F.xxhash64("block")).otherwise(F.col("bucket").cast("long")))
    back = sent.sortWithinPartitions("bucket", "block").mapInArrow(summed(plan), BLOCKS)
    return back.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(gathered, SCORES)


def words_and_starts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every token's word and each text's start, which is a history too, with their documents."""
    doc, word, before = grams(column)
    first = np.flatnonzero(before == START)
    return np.concatenate([word, before[first]]), np.concatenate([doc, doc[first]])

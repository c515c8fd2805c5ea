"""Toxicity by non-negative positive-unlabelled learning.

Features: hashes of a document's distinct words and of their first 3 to 8 bytes, in 2**BITS slots. Slots that are
clearly commoner in confirmed toxic texts than in unlabelled ones are kept, and a linear model over their presence is
trained in numpy by the non-negative PU risk with logistic loss:
    prior * mean_P[loss(f, +)] + max(0, mean_U[loss(f, -)] - prior * mean_P[loss(f, -)]).
P are the confirmed toxic texts. U are documents without any label, and the labelled ones, toxic ones among them, with their
labels hidden: two samples of all texts, whose means are mixed with weights SHARE and 1 - SHARE. The prior is the share of
toxic rows among the labelled ones. Logistic loss makes the score an estimate of the
probability.

Bounds: at most `most_labels` labelled and `most_unlabelled` unlabelled documents are fitted, chosen by a hash of doc_id, one
row for each id; the kept slots of these are all that reaches the driver. Every document's whole text is scored where it is read.

Rows: null text scores as the empty text; a null doc_id is scored, never learnt from, and not held out. Several labels
of one doc_id count as toxic if one is; of several texts of one doc_id the first in order is learnt from. Without toxic labels
every score is the prior. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, prepare, written
from .textvec import U, Words, mix, slices, span_hash

BITS = 20
#: Toxic texts that a mark has at least, and how near its lift comes to the greatest possible one, that of toxic texts' own words.
LEAST_TEXTS, LIFT = 3, 0.7
#: Weight of documents without a label among the unlabelled texts.
SHARE = 0.35
PREFIXES = (3, 4, 5, 6, 7, 8)


def slots(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document and slot of every feature of a batch, repeats included."""
    docs, keys = [w.doc], [w.hash]
    size = w.end - w.start
    for p in PREFIXES:
        some = np.flatnonzero(size >= p)
        start = w.start[some]
        docs.append(w.doc[some])
        keys.append(mix(span_hash(w.prefix, start, start + p) + U(p)))
    return np.concatenate(docs), (np.concatenate(keys) >> U(64 - BITS)).astype(np.int64)


def distinct(docs: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((docs << BITS) | slot)
    return both >> BITS, both & ((1 << BITS) - 1)


def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (slot, pos, hid, unl): documents of a task with each slot: toxic, labelled, without label."""
    counts = np.zeros((3, 1 << BITS), np.int64)
    for whole in batches:
        for batch in slices(whole, "text"):
            doc, slot = distinct(*slots(Words(batch.column("text"))))
            known = batch.column("toxic").is_valid().to_numpy(zero_copy_only=False)
            toxic = batch.column("toxic").fill_null(0).to_numpy() == 1
            for k, some in enumerate((toxic, known, ~known)):
                counts[k] += np.bincount(slot[some[doc]], minlength=1 << BITS)
    at = np.flatnonzero(counts[1] + counts[2])
    out = pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c[at]) for c in counts)], names=["slot", "pos", "hid", "unl"])
    del counts
    yield from (out.slice(i, 50_000) for i in range(0, out.num_rows, 50_000))
    give_back()


def kept_slots(rank: np.ndarray):
    """(text, toxic) to (toxic, found): the ranks of the kept slots that a text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                doc, slot = slots(Words(batch.column("text")))
                hit = rank[slot] >= 0
                doc, slot = distinct(doc[hit], slot[hit])
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(rank[slot].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), found], names=["toxic", "found"])

    return run


def fit_nnpu(found: list[np.ndarray], toxic: np.ndarray, size: int, prior: float, share: np.ndarray | None = None, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model; full-batch Adam on the non-negative PU risk. share: weights of the texts in U, of sum 1."""
    count = np.array([len(x) for x in found])
    row, col = np.repeat(np.arange(len(found)), count), np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    pos, n, n_pos = toxic == 1, len(found), max(1, int(toxic.sum()))
    share = np.full(n, 1 / n) if share is None else share
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        f = np.bincount(row, w[col], n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
        soft = np.logaddexp(0, f)
        negative = (share * soft).sum() - prior * soft[pos].sum() / n_pos
        g_neg = share * s - np.where(pos, prior * s / n_pos, 0)
        g = np.where(pos, prior * (s - 1) / n_pos, 0) + g_neg if negative >= 0 else -g_neg
        grad = np.append(np.bincount(col, g[row], size), g.sum())
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    weights: np.ndarray  # float32, one per slot
    bias: float
    prior: float

    def score_array(self, column: pa.Array) -> np.ndarray:
        out = []
        for batch in slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            doc, slot = slots(Words(batch.column("text")))
            hit = np.flatnonzero(self.weights[slot])
            doc, slot = distinct(doc[hit], slot[hit])
            f = np.bincount(doc, self.weights[slot], batch.num_rows) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(f, -50, 50))))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, docs: DataFrame, text: str = "text") -> Column:
        """The score of each text as a column; the model is 2**BITS numbers and is broadcast."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def scored(column: pa.Array) -> pa.Array:
            return pa.array(shared.value.score_array(column))

        return scored(F.col(text).cast("string"))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text modulo 3 is not 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def chosen(docs: DataFrame, labels: DataFrame, most_labels: int, most_unlabelled: int) -> DataFrame:
    """text, toxic (1, 0, null without label) of the documents to fit, one row for each id."""
    ids = labels.filter("doc_id is not null")
    known = ids.filter(F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_fit")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = written(known.orderBy(F.xxhash64("_fit"), "_fit").limit(most_labels), "labelled")
    # The first ids by hash among those of documents: labelled ones go by an anti-join of ids alone.
    rest = docs.select(F.col("doc_id").cast("long").alias("_fit")).filter("_fit is not null").join(ids.select(F.col("doc_id").cast("long").alias("_fit")), "_fit", "left_anti").distinct()
    more = written(rest.orderBy(F.xxhash64("_fit"), "_fit").limit(most_unlabelled).withColumn("toxic", F.lit(None).cast("int")), "unlabelled")
    fit = F.broadcast(sample.union(more))  # the limits bound what is broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("_fit"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(fit, "_fit")
    if not rows.groupBy("_fit").count().filter("count > 1").isEmpty():  # ids that repeat; else no text has to move
        rows = rows.groupBy("_fit").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return rows.select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 60_000, most_unlabelled: int = 20_000, default_prior: float = 0.1) -> Model:
    prepare(docs.sparkSession)
    rows = chosen(docs, labels, most_labels, most_unlabelled)
    totals = rows.agg(F.sum("toxic"), F.count("toxic"), F.count(F.lit(1))).first()
    n_pos, n_known, n = int(totals[0] or 0), int(totals[1]), int(totals[2])
    prior = n_pos / n_known if 0 < n_pos < n_known else default_prior
    none = Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))), prior)
    if not 0 < n_pos < n_known:
        return none
    counts = rows.mapInArrow(count_slots, "slot int, pos long, hid long, unl long").groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("pos", "hid", "unl")))
    share = SHARE if n > n_known else 0.0
    # Of unlabelled texts a share `prior` is toxic, so a mark of toxic texts alone is 1 / prior times commoner among them.
    usual = (1 - share) * F.col("hid") / n_known + (share * F.col("unl") / (n - n_known) if share else F.lit(0.0))
    lift = ((F.col("pos") + 0.5) / (n_pos + 1)) / ((usual * n_known + 0.5) / (n_known + 1))
    # All marks are kept, 2**BITS at most.
    sure = counts.filter((F.col("pos") >= LEAST_TEXTS) & (lift > LIFT / prior)).orderBy("slot").toPandas()
    rank = np.full(1 << BITS, -1, np.int64)
    rank[sure.slot.to_numpy()] = np.arange(len(sure))
    # In a fixed order, so that sums of floats, and with them all scores, are the same in every run.
    fitted = rows.mapInArrow(kept_slots(rank), "toxic int, found array<int>").toPandas()
    fitted = fitted.iloc[sorted(range(len(fitted)), key=lambda i: (str(fitted.toxic[i]), tuple(fitted.found[i])))]
    weight = np.where(fitted.toxic.notna(), (1 - share) / n_known, share / max(1, n - n_known))
    w, bias = fit_nnpu([np.asarray(x) for x in fitted.found], (fitted.toxic == 1).to_numpy().astype(int), len(sure), prior, weight)
    none.weights[sure.slot.to_numpy()] = w
    none.bias = bias
    return none


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on) added; no shuffle."""
    return docs.withColumn("score", model.score(docs)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

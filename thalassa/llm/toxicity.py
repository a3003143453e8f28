"""Toxicity by a factorization machine over hashed terms.

Score = sigmoid(w0 + sum_i w_i x_i + n^-SHARE sum_{i<j} <v_i, v_j> x_i x_j) with x_i = 1 if the text holds a word of bucket
i, n the number of its known buckets, so pairs such as an insult with a group mention have weights of their own, which the
many pairs of a long text don't outweigh. Words (A-Z as a-z) are hashed to 2^BITS buckets.
Every bucket of two or more training rows takes part, whatever its labels; what one row alone holds says nothing of others.

Training is AdaGrad on the logistic loss over batches of rows, of single weights and factors together from the first
step, with L1 terms that keep those at zero that do not help. Factors start at small random numbers. Of all epochs the one
counts that loses least on training rows left out for that. Sums over the terms of a row are segment sums.

The classifier is fitted on at most TRAIN_ROWS labelled rows (a documented bound; chosen by the least hash of doc_id) of
at most TRAIN_TERMS distinct terms in all, and scores every row over its whole text. The model is of bounded size and
travels with the tasks; scoring shuffles nothing.

Cases: a null or empty text scores the bias alone. Without labels of both classes every score is 0.0. Several labels of
one doc_id count as their highest. A null doc_id is not held out and never trains. Repeated rows are scored each. Other
columns are kept by score(), which replaces a column of the name of its result; stage() adds none. An empty table gives
an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textnum

TRAIN_ROWS = 20_000
#: Distinct terms of all training rows together that the driver holds; rows beyond it are left out of the training.
TRAIN_TERMS = 20_000_000
BITS = 20
RANK = 4
EPOCHS = 40
BATCH = 64
RATE = 1.0
#: The L1 terms of weights and factors are these over the root of the number of rows, as the noise of a weight.
L1, V_L1 = 0.016, 0.008
#: Where the sums of squared gradients start: what few rows say moves little.
W_START, V_START = 1.0, 10.0
#: The spread of the factors at the start, and the power of the number of terms that divides pairs.
V_SPREAD, SHARE = 0.1, 0.75
FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _buckets(column: pa.Array):
    """(sorted distinct buckets of each text, all after one another, and where each text begins) per run of rows."""
    for _, data, offsets in textnum.slices(column):
        h, row, _ = textnum.words(data, offsets)
        x = np.unique(row.astype(np.int64) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
        yield (x & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(x >> BITS, np.arange(len(offsets)))


def _sums(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the segments of x that begin at cut[:-1]; empty ones give 0."""
    out = np.zeros((len(cut) - 1, *x.shape[1:]))
    full = np.flatnonzero(cut[1:] > cut[:-1])
    if len(full):
        out[full] = np.add.reduceat(x, cut[full], axis=0)
    return out


def _factor_sums(v: np.ndarray, f: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the factors v[f] of each segment, sums of all their squares). Factor by factor: numpy is slow on short rows."""
    s, squares = np.zeros((v.shape[1], len(cut) - 1)), np.zeros(len(f))
    for k in range(v.shape[1]):
        one = np.take(v[:, k], f)
        s[k] = _sums(one, cut)
        squares += one * one
    return s.T, _sums(squares, cut)


def _share(cut: np.ndarray) -> np.ndarray:
    """What a pair counts in a text of n terms: 1 / n^SHARE."""
    return np.maximum(np.diff(cut), 1.0) ** -SHARE


class FactorizationMachine:
    """Binary features; trained by AdaGrad on logistic loss with L1 on weights and factors."""

    def __init__(self, features: np.ndarray, rank: int = RANK):
        rng = np.random.default_rng(7)
        self.features = features
        self._index()
        self.w0, self.w = 0.0, np.zeros(len(features))
        self.steps = 0
        # each factor's numbers lie together
        self.v = np.zeros((len(features), rank), order="F")

    def _index(self) -> None:
        self.index = np.full(1 << BITS, -1, np.int32)
        self.index[self.features] = np.arange(len(self.features))

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "index"}

    def __setstate__(self, state):
        vars(self).update(state)
        self._index()

    def active(self, buckets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of texts, given by their buckets, and where each text begins."""
        i = self.index[buckets]
        known = np.append(0, np.cumsum(i >= 0))
        return i[i >= 0], known[cut]

    def margins(self, i: np.ndarray, cut: np.ndarray) -> np.ndarray:
        s, squares = _factor_sums(self.v, i, cut)
        return self.w0 + _sums(np.take(self.w, i), cut) + 0.5 * _share(cut) * ((s * s).sum(1) - squares)

    def loss(self, i: np.ndarray, cut: np.ndarray, y: np.ndarray, rows: int = 512) -> float:
        total = 0.0
        for lo in range(0, len(y), rows):
            m = self.margins(i[cut[lo] : cut[min(lo + rows, len(y))]], cut[lo : lo + rows + 1] - cut[lo])
            total += float((np.logaddexp(0, m) - y[lo : lo + rows] * m).sum())
        return total / len(y)

    def fit(self, i: np.ndarray, cut: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> None:
        """Of all epochs the one is found that loses least on one row in five, left out for that, as factors may learn single
        rows by heart; then all rows train up to that epoch."""
        deal = np.random.default_rng(11).permutation(len(y))
        test = np.sort(deal[: len(y) // 5])
        far = np.append(0, np.cumsum(cut[test + 1] - cut[test]))
        left = np.concatenate([np.zeros(0, i.dtype), *(i[cut[r] : cut[r + 1]] for r in test)]), far, y[test]
        best = 0, np.inf
        for epoch in self._epochs(i, cut, y, deal[len(y) // 5 :], range(epochs)):
            self.steps += len(y)
            if len(test) and (now := self.loss(*left)) < best[1]:
                best = epoch, now
        upto = range(best[0] + 1)
        for _ in self._epochs(i, cut, y, deal, upto):
            pass

    def _epochs(self, i: np.ndarray, cut: np.ndarray, y: np.ndarray, rows: np.ndarray, epochs):
        """Trains from the start, giving out each epoch after it."""
        rng = np.random.default_rng(13)
        grown = np.full_like(self.w, W_START), np.full_like(self.v, V_START, order="F"), [1e-8]
        self.w0, self.w[:], self.v[:] = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0, rng.normal(0, V_SPREAD, self.v.shape)
        for epoch in epochs:
            dealt = rng.permutation(rows)
            for lo in range(0, len(dealt), BATCH):
                self._step(i, cut, y, dealt[lo : lo + BATCH], grown)
            yield epoch

    def _step(self, i: np.ndarray, cut: np.ndarray, y: np.ndarray, rows: np.ndarray, grown: tuple) -> None:
        """One step down the gradient of a batch of rows; grown: the sums of squared gradients so far."""
        gw, gv, g0 = grown
        n = cut[rows + 1] - cut[rows]
        ends = np.append(0, np.cumsum(n))
        f = i[np.arange(ends[-1]) - np.repeat(ends[:-1] - cut[rows], n)]
        share = _share(ends)
        s, squares = _factor_sums(self.v, f, ends)
        m = self.w0 + _sums(np.take(self.w, f), ends) + 0.5 * share * ((s * s).sum(1) - squares)
        e = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[rows]
        g0[0] += e.sum() ** 2
        self.w0 -= 0.1 * RATE * e.sum() / g0[0] ** 0.5
        if not len(f):
            return
        by = np.argsort(f, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(f[by]) != 0))
        u, row = f[by][first], np.repeat(np.arange(len(rows)), n)[by]
        d = np.add.reduceat(np.take(e, row), first)
        gw[u] += d * d
        self.w[u] -= RATE * d / np.sqrt(gw[u])
        live = np.flatnonzero(self.w)
        most = RATE * L1 * len(y) ** -0.5 * len(rows) / np.sqrt(gw[live])
        self.w[live] -= np.clip(self.w[live], -most, most)
        # sum_r c_r (s_r - v) of the rows of a feature, by sums over them
        c = e * share
        total, least = np.add.reduceat(np.take(c, row), first), V_L1 * len(y) ** -0.5 * len(rows)
        for k in range(self.v.shape[1]):
            v, grown_k = self.v[:, k], gv[:, k]
            old = np.take(v, u)
            d = np.add.reduceat(np.take(c * s[:, k], row), first) - total * old
            g = np.take(grown_k, u) + d * d
            grown_k[u] = g
            pace = RATE / np.sqrt(g)
            moved = old - pace * d
            v[u] = moved - np.clip(moved, -pace * least, pace * least)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorizationMachine | None:
    """The model of docs (doc_id, text) and labels (doc_id, toxic), held-out rows left aside; None without both classes."""
    scratch.ship(docs.sparkSession)
    marked = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_id")

    def terms(batches):
        for b in batches:
            held = [x[lo:hi].tobytes() for x, cut in _buckets(b.column(0)) for lo, hi in zip(cut[:-1], cut[1:])]
            yield pa.record_batch([b.column(1), pa.array(held, pa.binary()), b.column(2)], names=["toxic", "terms", "key"])

    # at most `rows` ids are broadcast
    mine = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("_id")).select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", "text").alias("key"))
    got = mine.mapInArrow(terms, "toxic int, terms binary, key long").orderBy("key", "toxic").limit(rows)
    # sizes first, so that the driver holds a bounded number of terms
    got = scratch.materialize(got)
    size = np.cumsum([r[0] for r in got.orderBy("key", "toxic").select(F.octet_length("terms") / 4).collect()])
    got = got.orderBy("key", "toxic").limit(max(1, int(np.searchsorted(size, TRAIN_TERMS, "right")))).toArrow()
    y = got.column("toxic").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    x = [np.frombuffer(t.as_buffer(), np.int32) for t in got.column("terms")]
    cut = np.append(0, np.cumsum([len(t) for t in x]))
    x = np.concatenate(x)
    del got
    model = FactorizationMachine(np.flatnonzero(np.bincount(x, minlength=1 << BITS) > 1))
    x, cut = model.active(x, cut)
    model.fit(x, cut, y)
    del x, cut, y
    scratch.relieve(docs.sparkSession)
    return model


def score(docs: DataFrame, model: FactorizationMachine | None, out: str = "toxic_score") -> DataFrame:
    """docs with `out` (double)."""
    docs = docs.drop(out)
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    scratch.ship(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches):
        for b in batches:
            p = [np.zeros(0), *(1 / (1 + np.exp(-np.clip(model.margins(*model.active(x, cut)), -30, 30))) for x, cut in _buckets(b.column(at)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(p), pa.float64())], names=[*names, out])

    return docs.mapInArrow(run, schema)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model predicts as toxic."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (mark,) = scratch.fresh(docs.columns, "toxic_score")
    return score(docs, model, mark).where(F.col(mark) < 0.5).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))

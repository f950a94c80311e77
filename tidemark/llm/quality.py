"""Operator 6: quality classifier by positive-unlabelled learning.

Trusted positives (documents labelled good) and unlabelled web text train a small network
that minimises the non-negative unbiased risk (Kiryo et al., 2017): the risk on the
unlabelled text less the positives' share of it stands in for the risk on negatives, and
is not allowed to fall below zero. The class prior is estimated from the same two
samples by the best bin (Garg et al., 2021), crosswise on two halves: the smallest ratio of
the unlabelled to the positive share above a score. Labels other than the trusted positives are not used.

Features describe the whole text (character classes and their pairs, words, repetition);
language, source and ids are no inputs. One scan computes them for all documents; the
fit sees at most ``SAMPLE`` rows of either kind, drawn by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, SPACE, lower_ascii, slices, string_hash, utf8_text, word_bounds

#: Expected number, at most, of the trusted positives and of the unlabelled documents that the fit sees.
SAMPLE = 12_000
#: Gradient steps of the fit (a third of them for the prior's networks).
STEPS = 700
FOLDS = 5
THRESHOLD = 0.3

# Byte classes: other punctuation, space, line end, digit, upper, lower, beyond ASCII, comma and stop, control.
CLASSES = 9
KIND = np.zeros(256, np.uint8)
KIND[:32] = 8
KIND[127] = 8
KIND[[32, 9, 11, 12]] = 1
KIND[[10, 13]] = 2
KIND[48:58] = 3
KIND[65:91] = 4
KIND[97:123] = 5
KIND[128:] = 6
KIND[[44, 46]] = 7
FEATURES = CLASSES * CLASSES + CLASSES + 9


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One line per text; all shares and means, so texts of any length compare."""
    n, size = len(offs) - 1, (offs[1:] - offs[:-1]).astype(np.float64)
    out = np.zeros((n, FEATURES), np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(n), offs[1:] - offs[:-1])
    kind = KIND[data].astype(np.int64)
    one = np.bincount(row * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    same = row[1:] == row[:-1]
    two = np.bincount((row[1:] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[same], minlength=n * CLASSES**2).reshape(n, -1)
    out[:, :CLASSES] = one / np.maximum(size, 1)[:, None]
    out[:, CLASSES : CLASSES + CLASSES**2] = two / np.maximum(size - 1, 1)[:, None]
    low = lower_ascii(data)
    s, e, of = word_bounds(~SPACE[low], offs)
    words = np.bincount(of, minlength=n).astype(np.float64)
    h = string_hash(low, s, e)
    w = np.maximum(words, 1)
    length = (e - s).astype(np.float64)
    mean = np.bincount(of, length, n) / w
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, of[order][first], runs)
    repeat = (of[1:] == of[:-1]) & (h[1:] == h[:-1])
    tail = kind[e - 1] if len(e) else np.zeros(0, np.int64)
    more = [
        np.bincount(of[order][first], minlength=n) / w,  # distinct words
        top / w,
        np.bincount(of[1:][repeat], minlength=n) / w if len(of) else np.zeros(n),
        mean / 10,
        np.sqrt(np.maximum(np.bincount(of, length**2, n) / w - mean**2, 0)) / 10,
        np.bincount(of[tail == 0], minlength=n) / w,  # words that end in odd punctuation
        np.bincount(of[tail == 4], minlength=n) / w,
        np.bincount(of[(e - s == 1) & (tail == 0)], minlength=n) / w,
        np.minimum(words, 20) / 20,
    ]
    out[:, CLASSES + CLASSES**2 :] = np.stack(more, axis=1)
    return out


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offs in slices(batch):
            x = features(data, offs)
            yield pa.record_batch([rows.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))], names=["doc_id", "features"])


class Network:
    """One hidden layer; ``fit`` takes positives, unlabelled rows and the prior (None: the
    unlabelled count as negatives)."""

    def __init__(self, hidden: int = 24, seed: int = 7):
        self.hidden, self.seed = hidden, seed

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return a, a @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[1], -30, 30)))

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = STEPS, batch: int = 512, rate: float = 3e-3) -> Network:
        """``steps`` steps, whatever the number of rows, on batches of about ``batch`` of either kind."""
        rng = np.random.default_rng(self.seed)
        both = np.concatenate([pos, unl])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-2
        d = both.shape[1]
        self.w1, self.b1 = rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(0, self.hidden**-0.5, self.hidden), 0.0
        theta = [self.w1, self.b1, self.w2, np.zeros(1)]
        m, v, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
        rounds = max(1, min(len(pos), len(unl)) // batch)
        for _ in range(ceil(steps / rounds)):
            ps, us = np.array_split(rng.permutation(len(pos)), rounds), np.array_split(rng.permutation(len(unl)), rounds)
            for p, u in zip(ps, us, strict=True):
                x = np.concatenate([pos[p], unl[u]])
                z = (x - self.mean) / self.scale
                a = np.tanh(z @ self.w1 + self.b1)
                g = a @ self.w2 + theta[3][0]
                s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
                n = len(p)
                down, up = s - 1, s  # derivatives of log(1+exp(-g)) and log(1+exp(g))
                grad = np.zeros(len(x))
                if prior is None:
                    grad[:n], grad[n:] = down[:n] / n / 2, up[n:] / len(u) / 2
                else:
                    loss = np.logaddexp(0, g)
                    negative = loss[n:].mean() - prior * loss[:n].mean()
                    if negative >= 0:
                        grad[:n], grad[n:] = prior * (down[:n] - up[:n]) / n, up[n:] / len(u)
                    else:  # step back from fitting the unlabelled rows below zero risk
                        grad[:n], grad[n:] = prior * up[:n] / n, -up[n:] / len(u)
                da = grad[:, None] * self.w2[None, :] * (1 - a * a)
                grads = [z.T @ da + 1e-4 * self.w1, da.sum(0), a.T @ grad + 1e-4 * self.w2, np.array([grad.sum()])]
                step += 1
                for k, gk in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk * gk
                    theta[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.b2 = float(theta[3][0])
        return self


def best_bin(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of unlabelled over that of positives above the score where the ratio's
    upper confidence bound is least; both sorted."""
    at = np.unique(pos[: max(1, int(len(pos) * 0.98))])
    qp, qu = 1 - np.searchsorted(pos, at) / len(pos), 1 - np.searchsorted(unl, at) / len(unl)
    slack = np.sqrt(np.log(40) / 2 / len(unl)) + np.sqrt(np.log(40) / 2 / len(pos))
    best = np.argmin((qu + slack) / qp)
    return float(qu[best] / qp[best])


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled: the best bin of either half's scores by a
    network that was fitted to the other half, averaged. Both need two rows at least."""
    found = []
    for a, b in ((0, 1), (1, 0)):
        half = Network(seed=3).fit(pos[a::2], unl[a::2], None, steps=STEPS // 3)
        found.append(best_bin(np.sort(half.scores(pos[b::2])), np.sort(half.scores(unl[b::2]))))
    return float(np.clip(np.mean(found), 0.02, 0.98))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def drawn(n: int) -> Column:
    """Whether a doc_id is in a sample of about ``SAMPLE`` of ``n``, by its hash. A
    threshold, not an ordering: no task sends more than its share to the driver."""
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 40))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``.

    Trusted positives: documents all of whose ``labels`` rows have quality 1, outside the
    held-out fold; unlabelled: documents outside it, whatever their labels. Null and empty
    texts are scored like any other (their features are zero). With fewer than
    two trusted positives or two unlabelled documents nothing can be estimated and every
    score is 0.5. Repeated rows get equal scores; a null doc_id is not
    held out and not trained on. Other columns of either table are not read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8_text())
    table = scratch.table(text.mapInArrow(describe, "doc_id long, features array<float>"), "features", compression="zstd")
    train = ~held_out(F.col("doc_id"))
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1")
    good = scratch.table(good.select("doc_id"), "good")
    chosen = F.broadcast(good.where(drawn(good.count())))  # about SAMPLE ids, however many there are
    some = lambda df: df.groupBy("doc_id").agg(F.min("features").alias("features")).toPandas().sort_values("doc_id")
    pos = some(table.join(chosen, "doc_id"))
    unl = some(table.where(train & F.col("doc_id").isNotNull() & drawn(table.count())))
    net = None
    if min(len(pos), len(unl)) > 1:
        p, u = np.stack(pos["features"].to_numpy()).astype(np.float64), np.stack(unl["features"].to_numpy()).astype(np.float64)
        net = Network().fit(p, u, class_prior(p, u))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, FEATURES)
                s = np.round(net.scores(x.astype(np.float64)), 7) if net else np.full(batch.num_rows, 0.5)
                yield pa.record_batch([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = table.mapInArrow(score, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    return scratch.last(scored, "scores")

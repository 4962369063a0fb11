"""Quality classifier by positive-unlabelled learning with the non-negative risk.

The trusted positives are documents with label 1; the unlabelled sample is web text without a label;
labels of 0 are not used. A linear model g is fitted by minimising

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),   l(z) = log(1 + exp(-z)),

where a step goes against the second term alone once that estimate of the negatives' risk is below
zero. The prior, the share of positives in unlabelled text, is estimated first: a classifier of
positive against unlabelled rows is fitted on one half of the rows, and on the other half the
least ratio of the two tails above its score bounds the prior from above.

Features are made in the tasks from whole texts: bigrams and trigrams of the texts' character shapes
(upper, lower, digit, space, line feed, each ASCII sign) as scaled square roots of counts, and a few
figures on words, repeats and lines. About POSITIVES and UNLABELLED rows (never more than twice as many),
chosen by a hash of doc_id and text from those whose crc32(doc_id) mod 5 is not 0, reach the driver; rows of one
id are drawn one by one, equal ones count once. The fit is numpy. The unlabelled rows are of any source.

A text of any length is one row of features; its characters are counted in pieces and take some ten
bytes a byte of text. Null or empty text has the features of no characters, and a score like any other. Without labelled
positives every score is the prior 0.5. Rows that repeat a doc_id each give a row; labels that
repeat count once; a doc_id with both labels counts as a positive. An empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrack.llm.common import few, held_out, share_of, shingles, slices, unseen, utf8, words

POSITIVES, UNLABELLED = 1500, 3000
BINS, FIGURES = 2048, 13
#: Bytes whose shapes are counted at once.
PIECE = 1 << 19

_SHAPE = np.zeros(256, np.int64)
_SHAPE[97:123] = _SHAPE[128:] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[10] = 4
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_SHAPE[_SIGNS] = np.arange(5, 5 + len(_SIGNS))
KINDS = 5 + len(_SIGNS)


def _distinct(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and the count of its most frequent one."""
    n = len(offs) - 1
    if not len(h):
        return np.zeros(n), np.zeros(n)
    doc = np.repeat(np.arange(n), np.diff(offs))
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    runs, most = np.diff(np.append(at, len(h))), np.zeros(n)
    np.maximum.at(most, d[at], runs)
    return np.bincount(d[at], minlength=n).astype(float), most


def _shape_counts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text's character shapes, and of its hashed bigrams and trigrams of them. Bytes are
    counted a piece at a time, each with the two bytes before it, so that no text is too long."""
    n = len(offs) - 1
    shapes, two, three = np.zeros((n, KINDS), np.int64), np.zeros((n, BINS // 4), np.int64), np.zeros((n, BINS - BINS // 4), np.int64)
    for end in range(0, len(buf), PIECE):
        at = max(0, end - 2)
        shape = _SHAPE[buf[at : end + PIECE]]
        doc = np.searchsorted(offs, np.arange(at, at + len(shape)), "right") - 1
        first, last = doc[0], doc[-1] + 1
        grams = shape[:-1] * 41 + shape[1:]
        for x, k, into in ((shape, 0, shapes), (grams, 1, two), ((grams[:-1] * 41 + shape[2:]) * 2654435761 >> 7, 2, three)):
            begin = max(0, end - at - k)  # grams that end before this piece were counted with the last one
            x, d = x[begin:], doc[begin + k :]
            ok = d == doc[begin : begin + len(d)]
            cell = (d[ok] - first) * into.shape[1] + x[ok] % into.shape[1]
            into[first:last] += np.bincount(cell, minlength=(last - first) * into.shape[1]).reshape(last - first, -1)
    return shapes, two, three


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of BINS scaled counts and FIGURES figures for each text."""
    n, size = len(offs) - 1, np.diff(offs)
    h, _, woffs = words(buf, offs)
    nw = np.diff(woffs).astype(float)
    _, soffs = shingles(h, woffs, 3)
    kinds, top = _distinct(h, woffs)
    shapes, two, three = _shape_counts(buf, offs)
    out = np.zeros((n, BINS + FIGURES), np.float32)
    for counts, low in ((two, 0), (three, BINS // 4)):
        c = np.sqrt(counts)
        out[:, low : low + c.shape[1]] = c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1)
    some = np.maximum(size, 1)
    per = lambda low, high: shapes[:, low:high].sum(axis=1) / some
    word_doc = np.repeat(np.arange(n), np.diff(woffs))
    twice = np.bincount(word_doc[1:][(h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])], minlength=n) if len(h) else np.zeros(n)
    figures = [
        np.log1p(nw), np.log1p(size), size / np.maximum(nw, 1) / 10, kinds / np.maximum(nw, 1), top / np.maximum(nw, 1),
        np.diff(soffs) / np.maximum(nw - 2, 1), per(2, 3), per(3, 4), per(5, KINDS), per(4, 5) * 10, per(0, 1), (size == 0).astype(float), twice / np.maximum(nw, 1),
    ]
    out[:, BINS:] = np.clip(np.stack(figures, axis=1), 0, 20)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    middle: np.ndarray
    spread: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.middle) / self.spread) @ self.weights + self.bias, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam over full gradients."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, ridge: float = 1e-3) -> float:
    """Share of positives among u: the least U tail / P tail over thresholds with enough rows."""
    rates = []
    for k in (0, 1):
        fp, fu, hp, hu = p[k::2], u[k::2], p[1 - k :: 2], u[1 - k :: 2]
        if not len(fp) or not len(fu) or not len(hp) or not len(hu):
            continue

        def gradient(w):
            gp, gu = -_sigmoid(-(fp @ w)) / len(fp), _sigmoid(fu @ w) / len(fu)
            return fp.T @ gp + fu.T @ gu + ridge * w

        w = _descend(gradient, p.shape[1], 150)
        sp, su = hp @ w, hu @ w
        cuts = np.quantile(sp, np.linspace(0, 0.7, 36))
        # each tail with a margin of one standard error, so that chance doesn't pull the least down
        tail_p = np.array([(sp >= c).mean() for c in cuts])
        tail_u = np.array([(su >= c).mean() for c in cuts])
        error = np.sqrt(tail_u * (1 - tail_u) / len(su)) + np.sqrt(tail_p * (1 - tail_p) / len(sp))
        rates.append(np.min((tail_u + error) / np.maximum(tail_p - error, 1e-6)))
    return float(np.clip(np.mean(rates), 0.05, 0.95)) if rates else 0.5


def risk_step(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, bool]:
    """Gradient of the risk, or, where the estimate of the negatives' risk is below zero, of that term
    alone with its sign turned; and which of them it is."""
    zp, zu = p @ w, u @ w
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    of_negative = u.T @ (_sigmoid(zu) / len(zu)) - prior * (p.T @ (_sigmoid(zp) / len(zp)))
    if negative < 0:
        return -of_negative, True
    return of_negative - prior * (p.T @ (_sigmoid(-zp) / len(zp))), False


def fit(p: np.ndarray, u: np.ndarray, prior: float | None = None, ridge: float = 1e-3, steps: int = 400) -> Model:
    middle, spread = np.zeros(p.shape[1]), np.full(p.shape[1], 0.05)
    middle[:BINS] = u[:, :BINS].mean(axis=0)
    middle[BINS:], spread[BINS:] = u[:, BINS:].mean(axis=0), (u[:, BINS:].std(axis=0) + 0.02) / 6
    one = lambda x: np.concatenate([(x - middle) / spread, np.ones((len(x), 1))], axis=1)
    p, u = one(p), one(u)
    prior = estimate_prior(p, u) if prior is None else prior

    def gradient(w):
        step, turned = risk_step(w, p, u, prior)
        return step if turned else step + ridge * np.append(w[:-1], 0)

    w = _descend(gradient, p.shape[1], steps, 0.02)
    return Model(w[:-1], float(w[-1]), middle, spread, prior)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        batch = batch.take(pa.array(unseen(batch.column(2), seen)))
        buf, offs = utf8(batch.column(0))
        for a, b in slices(offs, 1 << 18):
            x = features(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            yield pa.record_batch({"positive": batch.column(1).slice(a, b - a), "key": batch.column(2).slice(a, b - a), "x": pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    good = labels.where("quality = 1").select("doc_id").distinct()
    n_good, n_all = good.count(), texts.count()
    if not n_good or not n_all:
        return None
    # the ids of the positives are bounded by the parameter, so they are broadcast; an id may have any number of
    # rows, so the rows of these ids are counted, and drawn again by id and text
    good = F.broadcast(good.where(share_of(F.col("doc_id"), positives / n_good, 11)))
    n_rows = texts.join(good, "doc_id", "left_semi").count()
    key = F.xxhash64("doc_id", "text")
    best = texts.join(good, "doc_id", "left_semi").where(share_of(key, positives / max(1, n_rows), 14))
    some = texts.where(share_of(key, min(1.0, 1.6 * unlabelled / n_all), 12)).join(labels.select("doc_id"), "doc_id", "left_anti")
    drawn = lambda rows, known, most: few(rows.select("text", F.lit(known).alias("positive"), key.alias("key")).mapInArrow(_rows, "positive boolean, key long, x binary"), most)
    rows = drawn(best, True, 2 * positives).unionByName(drawn(some, False, 2 * unlabelled)).toArrow().sort_by("key")
    x = np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in rows.column("x")]).astype(np.float32) if rows.num_rows else np.zeros((0, BINS + FIGURES), np.float32)
    positive = rows.column("positive").to_numpy().astype(bool)
    p, u = x[positive], x[~positive]
    if not len(p):
        return None
    # where every row is labelled, the positives are all that is known: nothing to tell apart
    return fit(p, u) if len(u) else None


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            buf, offs = utf8(batch.column(1))
            for a, b in slices(offs, 1 << 19):
                for c in range(a, b, 512):
                    d = min(b, c + 512)
                    x = features(buf[offs[c] : offs[d]], offs[c : d + 1] - offs[c])
                    score = model.score(x) if model else np.full(d - c, 0.5)
                    yield pa.record_batch({"doc_id": batch.column(0).slice(c, d - c), "held_out": batch.column(2).slice(c, d - c), "score": pa.array(score.astype(np.float64))})

    return run


def scores(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    out = rows.mapInArrow(_scores(shared), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the quality of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

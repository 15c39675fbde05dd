"""Toxicity by a classifier chain.

Categories are predicted one after the other, each by a linear (logistic) model over the words a text holds and the
probabilities of the categories before it. Where a later model is fitted, the earlier probabilities are
out-of-fold predictions: those of models that have not seen the row, as they will be in use.

The models are fitted on the driver, on at most ``SAMPLE_ROWS`` labelled rows (those with the smallest hash of id and
label). Features are the words of the sample whose share in positive rows is at least ``LEAST_Z`` standard
deviations from that of all rows; their number is bounded by the sample alone. The penalty is the one of ``PENALTIES`` with the
least out-of-fold loss. Words are counted on the executors. Every text is then scored whole.

Defined results. Null and empty texts hold no word and get the models' base probability. Labels that are null or
whose document is missing are not fitted on. Without a row of both classes a category's probability is its
smoothed share. Repeated rows are scored each. Extra columns are kept unless named like one of those added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import buffers, map_rows, saved, small_batches, word_table

#: Bound of the labelled rows that the chain is fitted on, and the tasks they are dealt to.
SAMPLE_ROWS, SAMPLE_TASKS, FOLDS = 10_000, 32, 5
#: A word is a feature of a category if its rows of the sample have the category so many standard deviations more or less often than all: fewer than one of a million words does so by chance.
LEAST_Z = 5.0
#: Penalties tried; the one with the least out-of-fold loss is taken.
PENALTIES = (0.3, 1.0, 3.0)
_BLANKS = bytes(c if inside else 0x20 for c, inside in enumerate(word_table()))


class Chain(NamedTuple):
    """words: the vocabulary; models: for each category its name, word weights, weights of earlier categories, bias and threshold."""

    words: dict[bytes, int]
    models: list[tuple[str, np.ndarray, np.ndarray, float, float]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows(NamedTuple):
    """Which words each row holds: word numbers, the row of each, and the number of rows and words."""

    word: np.ndarray
    row: np.ndarray
    n: int
    m: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.word], self.n)

    def part(self, keep: np.ndarray) -> Rows:
        at = np.cumsum(keep) - 1
        of = keep[self.row]
        return Rows(self.word[of], at[self.row[of]], int(keep.sum()), self.m)


def logistic(x: Rows, dense: np.ndarray, y: np.ndarray, penalty: float = 1.0, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, weights of dense columns and bias with the least loss: Newton steps solved by conjugate gradients.

    The loss is the negative log-likelihood and half the penalty times the squares of the weights, the bias free.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    theta = np.zeros(x.m + dense.shape[1] + 1)
    theta[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return theta[: x.m], theta[x.m : -1], float(theta[-1])
    ridge = np.full(len(theta), penalty)
    ridge[-1] = 0.0
    forth = lambda v: x.times(v[: x.m]) + dense @ v[x.m : -1] + v[-1]
    back = lambda e: np.concatenate([np.bincount(x.word, e[x.row], x.m), dense.T @ e, [e.sum()]])
    loss = lambda v, z: float(np.logaddexp(0, z).sum() - y @ z + ridge @ (v * v) / 2)
    z = forth(theta)
    now = loss(theta, z)
    for _ in range(50):
        p = _sigmoid(z)
        gradient = back(p - y) + ridge * theta
        size = float(np.linalg.norm(gradient))
        if size <= tolerance * len(y):
            break
        curve = np.maximum(p * (1 - p), 1e-12)
        scale = np.concatenate([np.bincount(x.word, curve[x.row], x.m), (dense * dense).T @ curve, [curve.sum()]]) + ridge
        step, r = np.zeros_like(theta), -gradient
        q = r / scale
        d, rq = q.copy(), float(r @ q)
        for _ in range(200):
            if np.linalg.norm(r) <= min(0.1, size**0.5) * size:
                break
            hd = back(curve * forth(d)) + ridge * d
            alpha = rq / float(d @ hd)
            step += alpha * d
            r -= alpha * hd
            q = r / scale
            rq, before = float(r @ q), rq
            d = q + (rq / before) * d
        move, fall = forth(step), float(gradient @ step)
        t = 1.0
        while t > 1e-6 and loss(theta + t * step, z + t * move) > now + 1e-4 * t * fall:
            t /= 2
        if t <= 1e-6:
            break
        theta, z = theta + t * step, z + t * move
        now = loss(theta, z)
    return theta[: x.m], theta[x.m : -1], float(theta[-1])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the largest F1 on out-of-fold probabilities; halfway between the two rows it parts."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    i = int(f1.argmax())
    return float((p[order][i] + (p[order][i + 1] if i + 1 < len(p) else 0)) / 2)


def _tokens(raw: bytes) -> set[bytes]:
    """The distinct words of a text."""
    return set(raw.lower().translate(_BLANKS).split())


def fit_models(x: Rows, ys: np.ndarray, fold: np.ndarray, categories: tuple[str, ...]) -> list[tuple[str, np.ndarray, np.ndarray, float, float]]:
    """The chain's models: each has the out-of-fold probabilities of the categories before it as columns of its own."""
    before = np.zeros((x.n, 0))
    models = []
    for i, name in enumerate(categories):
        y, best = ys[:, i], None
        for penalty in PENALTIES:
            out = np.zeros(x.n)
            for k in range(FOLDS):
                fit_on = fold != k
                w, v, bias = logistic(x.part(fit_on), before[fit_on], y[fit_on], penalty)
                out[~fit_on] = _sigmoid(x.part(~fit_on).times(w) + before[~fit_on] @ v + bias)
            sure = np.clip(out, 1e-12, 1 - 1e-12)
            loss = -float(y @ np.log(sure) + (1 - y) @ np.log(1 - sure))
            if best is None or loss < best[0]:
                best = (loss, penalty, out)
        _, penalty, out = best
        w, v, bias = logistic(x, before, y, penalty)
        models.append((name, w, v, bias, best_threshold(out, y)))
        before = np.column_stack([before, out])
    return models


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], doc_id: str = "doc_id", text: str = "text") -> Chain:
    """labels: doc_id and a 0/1 column for each category, in the order of the chain."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select(F.col(doc_id).alias("label_id"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    ys = [f"y{i}" for i in range(len(categories))]
    picked = saved(usable.orderBy(F.xxhash64("label_id", *ys), "label_id").limit(SAMPLE_ROWS))
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).join(F.broadcast(picked), F.col("id") == F.col("label_id"))
    sample = saved(sample.orderBy(F.xxhash64("id", "t"), "id", "t", *ys).limit(SAMPLE_ROWS).select("t", *ys).repartition(SAMPLE_TASKS))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.array([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(ys))]).T
            data, at, _ = buffers(b.column(0))
            raw, total = data.tobytes(), {}
            for i in range(len(b)):
                for w in _tokens(raw[at[i] : at[i + 1]]):
                    row = total.setdefault(w, [0] * (len(ys) + 1))
                    row[0] += 1
                    for c in range(len(ys)):
                        row[c + 1] += int(y[i, c] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), *[pa.array([r[c] for r in total.values()], pa.int64()) for c in range(len(ys) + 1)]], names=["w", "n", *ys])

    seen = sample.mapInArrow(counts, "w binary, n long, " + ", ".join(f"{y} long" for y in ys)).groupBy("w").agg(F.sum("n").alias("n"), *[F.sum(y).alias(y) for y in ys]).where("n >= 3")
    seen = saved(seen)
    total = sample.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys]).first()
    chosen: set[bytes] = set()
    for y in ys:
        share = (total[y] + 0.5) / (total.n + 1)
        z = F.abs(F.col(y) - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
        chosen |= {bytes(r.w) for r in seen.where(z >= LEAST_Z).select("w").collect()}  # of the bounded sample's words
    words = {w: i for i, w in enumerate(sorted(chosen))}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at, _ = buffers(b.column(0))
            raw = data.tobytes()
            found = [sorted(words[w] for w in _tokens(raw[at[i] : at[i + 1]]) if w in words) for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *b.columns[1:]], names=["f", *ys])

    rows = sample.mapInArrow(held, "f array<int>, " + ", ".join(f"{y} int" for y in ys)).collect()  # at most SAMPLE_ROWS
    rows.sort(key=lambda r: (r.f, [r[y] for y in ys]))  # so that reruns sum in one order
    x = Rows(np.array([f for r in rows for f in r.f], np.int64), np.repeat(np.arange(len(rows)), [len(r.f) for r in rows]).astype(np.int64), len(rows), len(words))
    # rows with equal features get one fold, so that copies do not tell on each other
    fold = np.array([zlib.crc32(np.array(r.f, np.int32).tobytes()) % FOLDS for r in rows], np.int64)
    held_y = np.array([[r[y] > 0 for y in ys] for r in rows], float).reshape(len(rows), len(ys))
    return Chain(words, fit_models(x, held_y, fold, categories))


def score_chain(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Adds p_<category> and is_<category> for each category of the chain."""
    small_batches(docs.sparkSession)
    names = [f"p_{m[0]}" for m in chain.models] + [f"is_{m[0]}" for m in chain.models]
    kept = [c for c in docs.columns if c not in names]
    where = kept.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most WORDS words a category

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, models = sent.value
        for b in batches:
            data, at, _ = buffers(b.column(where))
            raw = data.tobytes()
            word, row = [], []
            for i in range(len(b)):
                found = [words[w] for w in _tokens(raw[at[i] : at[i + 1]]) if w in words]
                word += found
                row += [i] * len(found)
            x = Rows(np.array(word, np.int64), np.array(row, np.int64), len(b), len(words))
            before = np.zeros((len(b), 0))
            for _, w, v, bias, _t in models:
                before = np.column_stack([before, _sigmoid(x.times(w) + before @ v + bias)])
            p = [pa.array(before[:, i]) for i in range(len(models))]
            is_ = [pa.array(before[:, i] >= m[4]) for i, m in enumerate(models)]
            yield pa.RecordBatch.from_arrays([*b.columns, *p, *is_], names=[*b.schema.names, *names])

    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    return map_rows(frame, score, ", ".join(f"`{n}` {'double' if i < len(chain.models) else 'boolean'}" for i, n in enumerate(names)))

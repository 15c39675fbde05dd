"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Fitting, on a bounded sample: a random rotation, k-means centroids, and the number of lists to probe that
reaches the wanted recall on sample queries. Every valid row is then put in the list of its nearest
centroid. A query first scans its nearest lists, as many as hold k others; its tenth best there goes with it to all further
probed lists. Within each list the rotated vectors are read in column blocks; after each block, from the first one on, a
hypothesis test on the partial distance abandons a candidate if its whole distance is, at the given
confidence, above the query's tenth best so far. Survivors get their exact distance, in double precision, from the
original vectors.

A list is searched in blocks of bounded size (vectors by hash of their id, queries likewise), so a list that
a third of all vectors fall into spreads over tasks, and no task holds more than one block of each.
Broadcast are the centroids, at most ``MAX_LISTS`` of them, and one size for each.

Defined results. Vectors null, zero, or holding null or non-finite components take no part, as query or candidate;
null ids neither. Vectors of another length than most are compared with those of their own length, all of them. Equal
distances go to the smaller id. A query whose lists hold fewer than k candidates gets more lists, so it gets k results or
all there are. Rows repeated with one id count as candidates each, but never for a query of that id. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved

#: Bounds of what the driver fits on and of what is sent to each task.
SAMPLE_ROWS, SAMPLE_QUERIES, MAX_LISTS = 20_000, 200, 4096
#: Rows of one block of a list: vectors and queries.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
#: Dimensions read between two tests, and the test's strictness in standard deviations (larger abandons less).
COLUMN_BLOCK, EPSILON = 16, 2.5
#: Candidates of a block that are read together; the tenth best is renewed after each.
STEP = 256


class Index(NamedTuple):
    rotation: np.ndarray
    centroids: np.ndarray  # of rotated vectors
    probes: int


def valid_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id (long) and v (array<double>) of the rows that take part."""
    v = F.col("v")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def fit(rows: DataFrame, n_rows: int, k: int = 10, recall: float = 0.97, seed: int = 5) -> Index:
    """Fits on about ``SAMPLE_ROWS`` distinct vectors of one length, taken by their hash, so copies count once and reruns agree."""
    part = max(1, -(-n_rows // SAMPLE_ROWS))
    sample = rows.where(F.pmod(F.xxhash64("v"), F.lit(part)) == 0).select("v").distinct()
    x = np.unique(np.array([r.v for r in sample.toLocalIterator()], np.float64), axis=0)
    rng = np.random.default_rng(seed)
    if not len(x):
        return Index(np.zeros((0, 0)), np.zeros((0, 0)), 0)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    x = x @ rotation
    n = int(min(MAX_LISTS, max(1, 2 * n_rows**0.5), max(1, len(x) // 8)))
    c = x[rng.choice(len(x), n, replace=False)]
    for _ in range(8):
        own = nearest(x, c, 1)[:, 0]
        size = np.bincount(own, minlength=n)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    own = nearest(x, c, 1)[:, 0]
    pick = rng.choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False)
    d = ((x[pick] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[pick] @ x.T)
    d[np.arange(len(pick)), pick] = np.inf
    near = np.argpartition(d, min(k, len(x) - 1), 1)[:, :k]
    ranks = np.empty((len(pick), n), np.int64)
    np.put_along_axis(ranks, nearest(x[pick], c, n), np.broadcast_to(np.arange(n), (len(pick), n)), 1)
    at = np.sort(np.take_along_axis(ranks, own[near], 1).ravel())
    return Index(rotation, c, int(min(n, at[min(len(at) - 1, int(np.ceil(recall * len(at))))] + 1)))


def nearest(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centroids of each row, nearest first."""
    out = np.empty((len(x), m), np.int64)
    for i in range(0, len(x), 4096):
        d = (c**2).sum(1)[None] - 2 * x[i : i + 4096] @ c.T
        out[i : i + 4096] = d.argmin(1)[:, None] if m == 1 else np.argsort(d, 1, kind="stable")[:, :m]
    return out


def scan(q: np.ndarray, x: np.ndarray, k: int, ids: np.ndarray, original_q: np.ndarray, original_x: np.ndarray, tau: float = np.inf) -> tuple[list[tuple[float, int]], int]:
    """The k best (distance, id) of one list block for one query, and how many candidates were abandoned by their partial distances.

    tau: the square of a distance that k others are known to be within. What is left has room for rounding, so equal distances stay.
    """
    dims, best, lost = x.shape[1], [], 0
    room = 1e-12 * float(original_q @ original_q)
    for i in range(0, len(x), STEP):
        alive, partial = np.arange(i, min(i + STEP, len(x))), None
        for j in range(0, dims, COLUMN_BLOCK):
            step = ((x[alive, j : j + COLUMN_BLOCK] - q[j : j + COLUMN_BLOCK]) ** 2).sum(1)
            partial = step if partial is None else partial + step
            seen = min(dims, j + COLUMN_BLOCK)
            if tau < np.inf:
                # after a random rotation the part of a squared distance in some dimensions follows a beta distribution
                spread = seen / dims + EPSILON * (2 * seen * (dims - seen) / (dims + 2)) ** 0.5 / dims
                keep = partial <= (tau * (1 + 1e-9) + room) * spread
                lost += len(alive) - int(keep.sum()) if seen < dims else 0
                alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
        if not len(alive):
            continue
        exact = np.sqrt(((original_x[alive] - original_q) ** 2).sum(1))
        best = sorted([*best, *zip(exact.tolist(), ids[alive].tolist(), strict=True)])[:k]
        if len(best) == k:
            tau = min(tau, best[-1][0] ** 2)
    return best, lost


def search(df: DataFrame, queries: Column, k: int = 10, recall: float = 0.97, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 5, abandoned: Accumulator | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the k nearest found of each row that ``queries`` (over vec_id) picks.

    abandoned: counts the candidates that were given up before their last dimension.
    """
    spark = df.sparkSession
    rows = valid_vectors(df, vec_id, embedding)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = usual.d
    index = fit(rows.where(F.size("v") == dims), usual["count"], k, recall, seed)
    sent = spark.sparkContext.broadcast(index)

    def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have the usual length, and those rows rotated."""
        length = np.diff(column.offsets.to_numpy())
        usual = length == dims
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return length, flat[np.repeat(usual, length)].reshape(-1, dims) @ sent.value.rotation

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, x = matrix(b.column(1))
            own = -length.astype(np.int64)  # a list for each other length
            if len(x):
                own[length == dims] = nearest(x, sent.value.centroids, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=["vec_id", "v", "list"])

    placed = saved(rows.mapInArrow(assign, "vec_id long, v array<double>, list int"))
    sizes = placed.where("list >= 0").groupBy("list").agg(F.count("*").alias("n")).collect()  # at most MAX_LISTS rows
    size = np.zeros(len(index.centroids), np.int64)
    for r in sizes:
        size[r.list] = r.n

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of each query; first: those that are scanned first, as they hold k others."""
        n = len(size)
        for b in batches:
            ids, lists, first = [], [], []
            length, x = matrix(b.column(1))
            order = iter(nearest(x, sent.value.centroids, n) if len(x) else [])
            for i, d in enumerate(length.tolist()):
                if d != dims:
                    ids, lists, first = [*ids, i], [*lists, -d], [*first, True]
                    continue
                near = next(order)
                enough = int(np.searchsorted(np.cumsum(size[near]), k + 1)) + 1
                near = near[: max(sent.value.probes, enough)]
                soon = np.arange(len(near)) < enough
                near, soon = near[size[near] > 0], soon[size[near] > 0]
                ids += [i] * len(near)
                lists += near.tolist()
                first += soon.tolist()
            of = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(lists, pa.int32()), pa.array(first, pa.bool_())], names=["query_id", "q", "list", "first"])

    asked = saved(placed.where(queries).select("vec_id", "v").mapInArrow(probe, "query_id long, q array<double>, list int, first boolean"))
    vectors = placed.groupBy("list").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("nv"))
    blocks = saved(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq")).join(vectors, "list"))
    side = F.broadcast(blocks) if blocks.count() <= 2 * MAX_LISTS else blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    vectors = placed.join(side, "list").select("list", mine("vec_id", "nv").alias("b"), every("nq").alias("c"), "vec_id", "v")

    def searched(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(qs) and len(vs):
            ids, x, q = vs["vec_id"].to_numpy(), np.stack(vs["v"].to_numpy()), np.stack(qs["q"].to_numpy())
            rx, rq = (x @ sent.value.rotation, q @ sent.value.rotation) if x.shape[1] == dims else (x, q)
            for i, (query, tau) in enumerate(zip(qs["query_id"].tolist(), qs["tau"].tolist(), strict=True)):
                found, lost = scan(rq[i], rx, k + int((ids == query).sum()), ids, q[i], x, tau)
                out += [(query, v, s) for s, v in found if v != query][:k]
                if abandoned is not None:
                    abandoned.add(lost)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def scanned(probing: DataFrame) -> DataFrame:
        key = ["list", "b", "c"]
        probing = probing.join(side, "list").select("list", every("nv").alias("b"), mine("query_id", "nq").alias("c"), "query_id", "q", "tau")
        return probing.groupBy(key).cogroup(vectors.groupBy(key)).applyInPandas(searched, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    soon = saved(best(scanned(asked.where("first").withColumn("tau", F.lit(float("inf"))))))
    known = soon.where(F.col("rank") == k).select(F.col("query_id").alias("known_id"), (F.col("score") * F.col("score")).alias("tau"))
    rest = asked.where("not first").join(known, F.col("query_id") == F.col("known_id"), "left").withColumn("tau", F.coalesce("tau", F.lit(float("inf"))))
    found = soon.drop("rank").unionByName(scanned(rest))
    return best(found).select("query_id", "rank", "vec_id", "score")

"""Statistics of encodings: popcounts, their mean and spread, histograms, and an online accumulator."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import DescribeError
from tessera.functions import bits
from tessera.functions.bits import deserialize_bitarray


class OnlineMeanVariance:
    """Mean and sample variance of batches, merged pairwise."""

    def __init__(self) -> None:
        self.n, self._mean, self._squares = 0, 0.0, 0.0

    def update(self, batch: Sequence[float]) -> None:
        if not all(math.isfinite(x) for x in batch):
            raise ValueError("values must be finite numbers")
        if not batch:
            raise ZeroDivisionError("an empty batch has no mean")
        n = len(batch)
        mean = math.fsum(batch) / n
        squares = math.fsum((x - mean) ** 2 for x in batch)
        gap, total = mean - self._mean, self.n + n
        self._squares += squares + gap * gap * self.n * n / total
        self._mean += gap * n / total
        self.n = total

    def mean(self) -> float:
        return self._mean

    def variance(self) -> float:
        return self._squares / (self.n - 1) if self.n > 1 else 0.0

    def std(self) -> float:
        return math.sqrt(self.variance())


def get_encoding_popcounts(clks: Iterable[str]) -> list[int]:
    """Popcounts of base64 encodings, on the driver."""
    clks = list(clks)
    if not clks:
        raise DescribeError("No clks found")
    try:
        return [deserialize_bitarray(c).count() for c in clks]
    except Exception as e:
        raise DescribeError("Failed to deserialize encodings") from e


def encoding_popcounts(df: DataFrame, clk: str = "clk") -> DataFrame:
    """Adds ``popcount`` of a column of base64 encodings; text that is not base64 fails the job."""
    return df.withColumn("popcount", bits.popcount(bits.from_base64(F.col(clk))))


def mean_column(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def variance_column(c: Column) -> Column:
    return F.coalesce(F.var_samp(c), F.lit(0.0))


def popcount_stats(df: DataFrame, column: str = "popcount") -> DataFrame:
    """One row: n, mean, variance and std; 0 where there are too few rows."""
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), mean_column(c).alias("mean"), variance_column(c).alias("variance"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"))


def popcount_histogram(df: DataFrame, column: str = "popcount") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))

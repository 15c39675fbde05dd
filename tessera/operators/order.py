"""Order of results: merging numbered chunks, as a driver-side iterator and as a sort at the sink."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from queue import Queue
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def iterable_to_queue(rows: Iterable, queue: Queue, number_of_sentinels: int = 1, sentinel: Any = None) -> None:
    """Feeds a bounded queue, then its end marks."""
    for row in rows:
        queue.put(row)
    for _ in range(number_of_sentinels):
        queue.put(sentinel)


def queue_to_sorted_iterable(queue: Queue, sentinel_count: int) -> Iterator[Any]:
    """Results (..., index) from a queue by rising index, each as soon as all before it are there; gaps close at the end."""
    waiting: list[tuple[int, int, Any]] = []
    expected, arrived = 0, 0
    while sentinel_count:
        item = queue.get()
        if item is None:
            sentinel_count -= 1
            continue
        heapq.heappush(waiting, (item[-1], arrived, item))
        arrived += 1
        while waiting and waiting[0][0] <= expected:
            index, _, ready = heapq.heappop(waiting)
            expected = max(expected, index + 1)
            yield ready
    while waiting:
        yield heapq.heappop(waiting)[2]


def in_row_order(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """A range sort, for the sink only."""
    return df.orderBy(row_id)


def numbered_chunks(df: DataFrame, size: int = 10_000, row_id: str = "row_id") -> DataFrame:
    """Adds chunk, the number of the row's chunk."""
    if size < 1:
        raise ValueError(f"a chunk must have at least one row, but size was {size}")
    return df.withColumn("chunk", F.floor(F.col(row_id) / size).cast("long"))

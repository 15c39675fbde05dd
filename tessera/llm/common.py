"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import string
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.saved import SHUFFLES_GO, dropped, saved, with_checkpoints  # noqa: F401

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Words separated by ASCII blanks, and words of ASCII letters, digits and any non-ASCII character.
BLANK_WORDS = r"[^\x20\x09-\x0D]+"
PLAIN_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between PLAIN_WORDS words, and between BLANK_WORDS words: Spark splits a text many times faster than it extracts all matches.
PLAIN_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANK_GAPS = r"[\x20\x09-\x0D]+"
#: Arrow batches stay this small, so that one of very long documents fits in a worker's memory.
BATCH_ROWS = 1000


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII strings take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_words(c: Column, gaps: str) -> Column:
    """The words of a text between ``gaps``; null texts have none."""
    return F.coalesce(F.array_remove(F.split(c, gaps), ""), F.array().cast("array<string>"))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch size to ``rows`` if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def release(spark: SparkSession) -> None:
    """Between rounds: lets Spark drop shuffle files and broadcasts of finished rounds, which it does when their handles are collected."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.15)  # Python's handles are given up by a thread of their own
        spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, made from ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_rows(frame: DataFrame, function, added: str) -> DataFrame:  # noqa: ANN001
    """mapInArrow over columns with any names; ``function`` finds them by place and adds those of the schema ``added``."""
    plain = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
    more = StructType.fromDDL(added).fields
    return plain.mapInArrow(function, StructType([*plain.schema.fields, *more])).toDF(*frame.columns, *[f.name for f in more])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, n + 1 offsets into it, and which rows are null."""
    nulls = np.asarray(column.is_null())
    raw = column.fill_null("").cast(pa.large_binary())
    parts = raw.buffers()
    at = np.frombuffer(parts[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None and parts[2].size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0], nulls


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty stretches give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def word_table(separators: str | None = None) -> np.ndarray:
    """For each byte of lower-cased UTF-8 text, whether it belongs to a PLAIN_WORDS word (or, with "blank", a BLANK_WORDS word)."""
    table = np.ones(256, bool)
    if separators == "blank":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
    return table


def word_starts(inside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks the first byte of each word; a row's first byte never continues the row before."""
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    starts[first] = inside[first]
    return starts


def held_bucket(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id's decimal text modulo ``n``; null ids count as bucket of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n

"""Encoding: rows of strings to composite Bloom filters.

``encode`` is one narrow projection, without a shuffle. The Arrow engine checks, normalises, tokenises and hashes in one
pass over Arrow batches; each distinct value of a field is hashed once for each worker, as far as its memory
goes. The native engine writes the double hash out in Catalyst expressions. Both give the same bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EntryError, FormatError, InvalidEntryError
from tessera.functions import bits, hashing
from tessera.functions.bits import Bits
from tessera.functions.keys import generate_key_lists
from tessera.plans.fields import FieldSpec, Ignore
from tessera.plans.schema import Schema

#: Values of one field that a worker remembers before it starts anew.
REMEMBERED_VALUES = 1 << 17
ROW_ID = "row_id"


def derive_keys(schema: Schema, secret: bytes | str) -> tuple[tuple[bytes, ...], ...]:
    """One pair of keys for each column, ignored ones too."""
    return generate_key_lists(secret, len(schema.fields), 2, schema.kdf_key_size, schema.kdf_salt, schema.kdf_info, schema.kdf_type, schema.kdf_hash)


class FieldKernel:
    """A field's values to bit masks, on one worker."""

    def __init__(self, field: FieldSpec, keys: tuple[bytes, ...], l: int, validate: bool) -> None:
        self.field, self.keys, self.l, self.validate = field, keys, l, validate
        of = field.hashing_properties
        self.make = hashing.kernel(of.hash_type, of.prevent_singularity, l)
        self.known: dict[str, int | InvalidEntryError] = {}

    def mask(self, value: str) -> int:
        found = self.known.get(value)
        if found is None:
            try:
                found = self._mask(value)
            except InvalidEntryError as e:
                found = e
            if len(self.known) >= REMEMBERED_VALUES:
                self.known.clear()
            self.known[value] = found
        if isinstance(found, InvalidEntryError):
            raise found
        return found

    def _mask(self, value: str) -> int:
        if self.validate:
            self.field.validate(value)
        of = self.field.hashing_properties
        tokens = list(of.comparator.tokenize(self.field.format_value(value)))
        if not tokens:
            return 0
        return hashing.encode_tokens(tokens, of.strategy.bits_per_token(len(tokens)), self.keys, self.l, of.encoding, self.make)


def kernels(schema: Schema, keys: Sequence[tuple[bytes, ...]], validate: bool) -> list[tuple[int, FieldKernel]]:
    """Place and kernel of each field that is hashed."""
    return [(i, FieldKernel(f, keys[i], schema.hash_l, validate)) for i, f in enumerate(schema.fields) if f.hashing_properties is not None]


def encode_row(row: Sequence[str], made: list[tuple[int, FieldKernel]], schema: Schema) -> int:
    """The folded mask of one row."""
    whole = 0
    for place, kernel in made:
        whole |= kernel.mask(row[place])
    return bits.fold_mask(whole, schema.hash_l, schema.xor_folds)


def with_row_ids(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Numbers rows from 0 in the order of partitions; one count for each partition goes to the driver."""
    local, part = F.monotonically_increasing_id(), F.spark_partition_id()
    counted = {r[0]: r[1] for r in df.select(part.alias("p")).groupBy("p").count().collect()}
    starts, total = [], 0
    for p in range(max(counted, default=-1) + 1):
        starts.append(total)
        total += counted.get(p, 0)
    return df.withColumn(name, F.get(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), part) + local.bitwiseAND(F.lit((1 << 33) - 1)))


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores by their values, before they are encoded: a small file may be one task's, however long its rows take."""
    n = max(df.rdd.getNumPartitions(), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *[F.col(f"`{c}`") for c in df.columns])


def columns_of(df: DataFrame, schema: Schema) -> list[str]:
    """The data columns, by position; row_id is not one of them."""
    found = [c for c in df.columns if c != ROW_ID]
    if len(found) != len(schema.fields):
        raise FormatError(f"the table has {len(found)} columns, but the schema has {len(schema.fields)} fields")
    return found


def encode(df: DataFrame, schema: Schema, secret: bytes | str, validate: bool = True, engine: str = "arrow", errors: str = "raise", keep: Sequence[str] = ()) -> DataFrame:
    """row_id, clk (binary), popcount and the columns to keep, of every row.

    Columns are matched to fields by position and taken as strings; null counts as the empty string. Without a
    row_id column rows are numbered. With ``errors="raise"`` a bad entry fails the job that reads the result;
    with ``"column"`` the result also has ``error`` (null where the row is good), and clk is null where it is not.
    """
    names = columns_of(df, schema)
    if ROW_ID not in df.columns:
        df = with_row_ids(df)
    keys = derive_keys(schema, secret)
    used = [i for i, f in enumerate(schema.fields) if f.hashing_properties is not None]
    for i in used:
        of = schema.fields[i].hashing_properties
        hashing.kernel(of.hash_type, of.prevent_singularity, schema.hash_l)  # bad lengths fail here, not in a task
    text = lambda i: F.coalesce(F.col(f"`{names[i]}`").cast("string"), F.lit(""))
    if engine == "native":
        return _native(df, schema, keys, used, text, validate, errors, keep)
    if engine != "arrow":
        raise ValueError(f"unknown engine {engine!r}")
    kept = [ROW_ID, *keep]
    frame = df.select(*[F.col(f"`{c}`") for c in kept], *[text(i).alias(f"_field{i}") for i in used])
    n, raising = len(kept), errors == "raise"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [k for _, k in kernels(schema, keys, validate)]
        size = -(-schema.l // 8)
        shift = 8 * size - schema.l
        for b in batches:
            clks, counts, wrong = [], [], []
            values = [b.column(n + j).to_pylist() for j in range(len(made))]
            for at in range(len(b)):
                whole, error = 0, None
                for j, kernel in enumerate(made):
                    try:
                        whole |= kernel.mask(values[j][at])
                    except InvalidEntryError as e:
                        error = f"Invalid entry in row {b.column(0)[at].as_py()}, column '{kernel.field.identifier}'. {e}"
                        if raising:
                            raise EntryError(error, b.column(0)[at].as_py()) from e
                        break
                mask = bits.fold_mask(whole, schema.hash_l, schema.xor_folds)
                clks.append(None if error else (mask << shift).to_bytes(size, "big"))
                counts.append(None if error else mask.bit_count())
                wrong.append(error)
            last = [] if raising else [pa.array(wrong, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(clks, pa.binary()), pa.array(counts, pa.int32()), *last], names=[*kept, "clk", "popcount", *(["error"] if last else [])])

    made = [T.StructField("clk", T.BinaryType()), T.StructField("popcount", T.IntegerType()), *([] if raising else [T.StructField("error", T.StringType())])]
    return frame.mapInArrow(run, T.StructType([*[frame.schema[c] for c in kept], *made]))


def token_column(field: FieldSpec, c: Column) -> Column:
    return field.hashing_properties.comparator.column(field.format_column(c))


def position_column(tokens: Column, field: FieldSpec, keys: tuple[bytes, ...], l: int) -> Column:
    """array<long> of all positions of a value's tokens, repeats included."""
    of = field.hashing_properties
    if of.hash_type != "doubleHash" or of.encoding not in ("ascii", "utf-8"):
        raise NotImplementedError("the native engine has the double hash over UTF-8 only")
    n = F.size(tokens)
    return F.flatten(F.transform(tokens, lambda t, i: hashing.double_hash_column(t, of.strategy.column(i, n), keys, l, bool(of.prevent_singularity))))


def _native(df: DataFrame, schema: Schema, keys: Sequence[tuple[bytes, ...]], used: list[int], text, validate: bool, errors: str, keep: Sequence[str]) -> DataFrame:  # noqa: ANN001
    kept = [ROW_ID, *keep]
    out = df.select(*[F.col(f"`{c}`") for c in kept], *[text(i).alias(f"_f{i}") for i in used])
    wrong: Column = F.lit(None).cast("string")
    if validate:
        said = [F.when(schema.fields[i].invalid_column(F.col(f"_f{i}")), F.concat(F.lit("Invalid entry in row "), F.col(ROW_ID).cast("string"), F.lit(f", column '{schema.fields[i].identifier}'."))) for i in used]
        wrong = F.coalesce(*said, F.lit(None).cast("string"))
    out = out.select("*", wrong.alias("error"))
    out = out.select(*[F.col(f"`{c}`") for c in kept], "error", *[token_column(schema.fields[i], F.col(f"_f{i}")).alias(f"_t{i}") for i in used])
    parts = [F.coalesce(position_column(F.col(f"_t{i}"), schema.fields[i], keys[i], schema.hash_l), F.array().cast("array<long>")) for i in used]
    every = F.array_distinct(reduce(lambda a, b: F.concat(a, b), parts)) if parts else F.array().cast("array<long>")
    out = out.select(*[F.col(f"`{c}`") for c in kept], "error", every.alias("_p"))
    bad = F.col("error").isNotNull()
    out = out.withColumn("_w", bits.words_of(F.col("_p"), schema.hash_l, schema.xor_folds))
    packed = bits.pack_words(F.col("_w"), schema.l)
    clk = F.when(bad, F.raise_error(F.col("error")).cast("binary") if errors == "raise" else F.lit(None)).otherwise(packed)
    popcount = F.when(~bad, bits.count_words(F.col("_w")))
    out = out.select(*[F.col(f"`{c}`") for c in kept], "error", clk.alias("clk"), popcount.alias("popcount"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "clk", "popcount", *([] if errors == "raise" else ["error"]))


# ---- lists of rows -------------------------------------------------------------------------------------


def stream_bloom_filters(rows: Iterable[Sequence[str]], keys: Sequence[tuple[bytes, ...]], schema: Schema) -> Iterator[tuple[Bits, str, int]]:
    """(filter, first column, popcount) of each row of an iterable, on the driver; for checks and small inputs."""
    made = kernels(schema, keys, False)
    for row in rows:
        found = Bits.of(encode_row(row, made, schema), schema.l)
        yield found, row[0], found.count()


def crypto_bloom_filter(row: Sequence[str], schema: Schema, keys: Sequence[tuple[bytes, ...]]) -> tuple[Bits, str, int]:
    return next(stream_bloom_filters([row], keys, schema))


def chunks(rows: Iterable, size: int) -> Iterator[tuple[int, tuple]]:
    """(number, rows) of consecutive chunks; the last may be short."""
    if size < 1:
        raise ValueError(f"a chunk must have at least one row, but size was {size}")
    rest = iter(rows)
    number = 0
    while some := tuple(islice(rest, size)):
        yield number, some
        number += 1


def generate_clks(pii_data: DataFrame | Sequence[Sequence[str]], schema: Schema, secret: bytes | str, validate: bool = True, callback=None, spark: SparkSession | None = None, engine: str = "arrow") -> list[Bits]:  # noqa: ANN001
    """The encodings of a table in row order, on the driver. callback(n, popcounts) is told of each partition's rows.

    For tables that do not fit the driver use ``encode`` and write its result.
    """
    from tessera.operators.validate import check_row_lengths, raise_first_invalid

    if not isinstance(pii_data, DataFrame):
        spark = spark or SparkSession.builder.getOrCreate()
        rows = [tuple(r) for r in pii_data]
        check_row_lengths(schema.fields, rows)
        if not rows:
            return []
        kind = ", ".join([f"{ROW_ID} long", *[f"c{i} string" for i in range(len(schema.fields))]])
        pii_data = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], kind)
    encoded = encode(pii_data, schema, secret, validate, engine, errors="column")
    raise_first_invalid(encoded, schema)
    out = []
    for r in encoded.orderBy(ROW_ID).toLocalIterator(prefetchPartitions=True):
        out.append(Bits(bytes(r.clk), schema.l))
    if callback is not None:
        for _, some in chunks(out, 10_000):
            callback(len(some), [b.count() for b in some])
    return out


def ignored_places(schema: Schema) -> list[int]:
    return [i for i, f in enumerate(schema.fields) if isinstance(f, Ignore)]

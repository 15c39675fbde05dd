"""CSV source and sink. Rows keep their file order in ``row_id``; rows of a wrong length are found, not padded.

With ``multi_line`` (quoted line breaks allowed) a file is one split. Without, files are split and read in parallel;
row ids come from each split's place, by one short row for each split.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import FormatError
from tessera.functions.bits import Bits, from_base64, to_base64
from tessera.operators.encode import encode, generate_clks
from tessera.operators.validate import validate_header
from tessera.plans.schema import Schema

CORRUPT = "_corrupt_row"
#: A string that stands for null in no file, so that empty values stay apart from it.
NO_NULL = "\x00null\x00"


def first_record(spark: SparkSession, path: str) -> list[str]:
    """The first CSV record, read on the driver; a few lines are enough unless quotes run over them."""
    for lines in (1, 100):
        text = "\n".join(r.value for r in spark.read.text(path).limit(lines).collect())
        try:
            row = next(csv.reader(io.StringIO(text), strict=True), None)
        except csv.Error:
            continue
        return row or []
    return []


def read_csv(spark: SparkSession, path: str, schema: Schema, header: bool | str = True, multi_line: bool = True) -> DataFrame:
    """row_id, one string column for each field (c0, c1, ...), and the corrupt row where the length was wrong.

    header: True checks it against the fields, 'ignore' skips it, False takes the first row as data.
    """
    if header not in (True, False, "ignore"):
        raise ValueError("header must be True, False or 'ignore'")
    if header is True:
        validate_header(schema.fields, first_record(spark, path))
    names = [f"c{i}" for i in range(len(schema.fields))]
    kind = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    reader = spark.read.schema(kind).option("header", bool(header)).option("enforceSchema", True).option("multiLine", multi_line).option("escape", '"')
    reader = reader.option("nullValue", NO_NULL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.csv(path).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("_path", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("_path").alias("p"), F.col("_start").alias("s"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = rows.join(splits, (F.col("_path") == F.col("p")) & (F.col("_start") == F.col("s")))
    return joined.select((F.col("_at") - F.col("first") + F.col("before")).alias("row_id"), *[F.when(F.col(CORRUPT).isNull(), F.coalesce(n, F.lit(""))).otherwise(F.col(n)).alias(n) for n in names], CORRUPT)


def checked_rows(rows: DataFrame, schema: Schema) -> DataFrame:
    """The rows without the corrupt column; FormatError for the first row of a wrong length."""
    bad = rows.where(F.col(CORRUPT).isNotNull()).agg(F.min(F.struct("row_id", CORRUPT, "c0")).alias("e")).first().e  # c0: Spark refuses to read the corrupt column alone
    if bad is not None:
        found = len(next(csv.reader(io.StringIO(bad[CORRUPT])), []))
        raise FormatError(f"row {bad.row_id} has {found} columns, but the schema has {len(schema.fields)} fields", bad.row_id)
    return rows.drop(CORRUPT)


def encode_csv(spark: SparkSession, path: str, secret: bytes | str, schema: Schema, validate: bool = True, header: bool | str = True, multi_line: bool = True, engine: str = "arrow", errors: str = "raise") -> DataFrame:
    """A CSV file to row_id, clk and popcount, as a table."""
    return encode(checked_rows(read_csv(spark, path, schema, header, multi_line), schema), schema, secret, validate, engine, errors)


def generate_clk_from_csv(path: str, secret: bytes | str, schema: Schema, validate: bool = True, header: bool | str = True, callback=None, spark: SparkSession | None = None) -> list[Bits]:  # noqa: ANN001
    """A CSV file to encodings in row order, on the driver."""
    spark = spark or SparkSession.builder.getOrCreate()
    return generate_clks(checked_rows(read_csv(spark, path, schema, header), schema), schema, secret, validate, callback)


def line_count(spark: SparkSession, path: str) -> int:
    """Lines of text files, the header's too."""
    return spark.read.text(path).count()


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("escape", '"').csv(path)


def write_encodings(encoded: DataFrame, path: str) -> None:
    """row_id and base64 text, as Parquet."""
    encoded.select("row_id", to_base64(F.col("clk")).alias("clk")).write.mode("overwrite").parquet(path)


def read_encodings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("row_id", from_base64(F.col("clk")).alias("clk"))

"""Encoding end to end: golden vectors, both engines, errors, CSV, streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

import tessera
from tessera.errors import EntryError, FormatError
from tessera.functions.bits import Bits, serialize_bitarray
from tessera.functions.strategies import BitsPerFeatureStrategy, BitsPerTokenStrategy
from tessera.functions.tokens import AbstractComparison, ExactComparison, NgramComparison, NumericComparison
from tessera.operators.encode import chunks, crypto_bloom_filter, derive_keys, encode, generate_clks, stream_bloom_filters, with_row_ids
from tessera.operators.validate import invalid_entries, validate_entries, validate_header
from tessera.plans.fields import DateSpec, EnumSpec, FieldHashingProperties, FieldSpec, Ignore, IntegerSpec, MissingValueSpec, StringSpec
from tessera.plans.schema import Schema, from_json_dict
from tessera.sources import csv as source
from tessera.streaming.encode_stream import encode_stream, running_stats, write_encoded
from tests.schemas import GOLDEN, GOLDEN_ROWS, GOLDEN_SCHEMA, PEOPLE_HEADER, PEOPLE_ROWS, people


def double(comparator, strategy, **more):
    return FieldHashingProperties(comparator, strategy, hash_type="doubleHash", **more)


@pytest.mark.parametrize("engine", ["arrow", "native"])
def test_golden(spark, engine):
    out = generate_clks(GOLDEN_ROWS, from_json_dict(GOLDEN_SCHEMA), "chicken", engine=engine)
    assert tuple(serialize_bitarray(b) for b in out[:2]) == GOLDEN
    assert [b.count() for b in out[:2]] == [532, 777]


@pytest.mark.parametrize("l,folds", [(1024, 0), (256, 2), (96, 1), (1000, 0)])
def test_engines_agree(spark, l, folds):
    rng = random.Random(4)
    schema = Schema(
        [
            Ignore("id"),
            StringSpec("name", double(NgramComparison(2), BitsPerFeatureStrategy(50))),
            IntegerSpec("n", double(NumericComparison(10, 3), BitsPerTokenStrategy(5))),
            DateSpec("d", double(NgramComparison(1, True), BitsPerTokenStrategy(3), prevent_singularity=True, missing_value=MissingValueSpec("", "")), "%Y-%m-%d"),
            EnumSpec("e", double(ExactComparison(), BitsPerTokenStrategy(9), missing_value=MissingValueSpec("NA", "x")), ["x", "y"]),
        ],
        l, folds,
    )
    rows = [(i, str(i), "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9))), str(rng.randint(-99, 99)), rng.choice(["", "2001-02-03", "1999-12-31"]), rng.choice(["x", "y", "NA"])) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, id string, name string, n string, d string, e string")
    a, b = ({r.row_id: (bytes(r.clk), r.popcount) for r in encode(df, schema, "s", engine=e).collect()} for e in ("arrow", "native"))
    assert a == b
    keys = derive_keys(schema, "s")
    for (_, *row), (found, first, n) in zip(rows, stream_bloom_filters([r[1:] for r in rows], keys, schema), strict=True):
        assert a[int(first)] == (found.data, n) and row[0] == first
    assert crypto_bloom_filter(rows[0][1:], schema, keys)[0].data == a[0][0]


def test_versions_give_the_same_bits(spark):
    old = people("doubleHash")
    v1 = {"version": 1, "clkConfig": {"l": 1024, "k": 30, "hash": {"type": "doubleHash"}, "kdf": old["clkConfig"]["kdf"]}, "features": []}
    for f, weight in zip(old["features"], (0, 0.5, 1, 2), strict=True):
        if "hashing" in f:
            c = f["hashing"]["comparison"]
            v1["features"].append({"identifier": f["identifier"], "format": f["format"], "hashing": {"ngram": c["n"], "positional": c["positional"], "weight": weight}})
        else:
            v1["features"].append(f)
    a, b, c = (generate_clks(PEOPLE_ROWS, from_json_dict(s), "x") for s in (v1, old, people()))
    assert a == b and b != c


def test_other_encodings_and_own_types(spark):
    class Halves(AbstractComparison):
        def tokenize(self, word):
            return [word[: len(word) // 2], word[len(word) // 2 :]]

    class Even(FieldSpec):
        def check(self, value):
            if len(value) % 2:
                self._bad("odd")

    for encoding in ("utf-16", "utf-32"):
        schema = Schema([Even("x", FieldHashingProperties(Halves(), BitsPerTokenStrategy(5), encoding=encoding))], 1024)
        assert generate_clks([("abcd",)], schema, "s")[0].count() > 0
        with pytest.raises(EntryError):
            generate_clks([("abc",)], schema, "s")


def test_missing_values(spark):
    schema = from_json_dict({
        "version": 2, "clkConfig": {"l": 1024, "kdf": {"type": "HKDF"}},
        "features": [
            {"identifier": "name", "format": {"type": "string", "encoding": "utf-8"}, "hashing": {"ngram": 2, "strategy": {"k": 20}, "hash": {"type": "doubleHash"}, "missingValue": {"sentinel": "null", "replaceWith": "Bob"}}},
            {"identifier": "age", "format": {"type": "integer"}, "hashing": {"ngram": 1, "strategy": {"k": 20}, "hash": {"type": "doubleHash"}, "missingValue": {"sentinel": "NA", "replaceWith": "42"}}},
        ],
    })
    a, b = generate_clks([("Bob", "42"), ("null", "NA")], schema, "sec")
    assert a == b


def test_counts_and_hashes(spark):
    def count(k, kind="doubleHash"):
        return generate_clks([("Deckard",)], Schema([StringSpec("n", FieldHashingProperties(NgramComparison(2), BitsPerTokenStrategy(k), hash_type=kind))], 1024), "s")[0].count()

    assert count(0) == 0 and count(20) < count(30) < count(40) and count(20, "blakeHash") > 0
    a, b = FieldHashingProperties(NgramComparison(2), BitsPerTokenStrategy(10)), double(NgramComparison(2), BitsPerTokenStrategy(10))
    one, two = (generate_clks([("Deckard", "Cane")], Schema([StringSpec("a", x), StringSpec("b", y)], 1024), "s")[0] for x, y in ((a, b), (b, a)))
    assert one != two


def test_entry_errors(spark):
    schema = from_json_dict(people())
    bad = [*PEOPLE_ROWS, ("3", "No One", "1999/02/30", "M"), ("4", "X", "1999/02/03", "M")]
    with pytest.raises(EntryError) as e:
        generate_clks(bad, schema, "s")
    assert e.value.row_index == 3 and e.value.field_spec.identifier == "born" and "row 3" in str(e.value)
    with pytest.raises(EntryError) as e:
        validate_entries(schema.fields, bad, 10)
    assert e.value.row_index == 13
    with pytest.raises(EntryError):  # without validation a bad date still cannot be normalised
        generate_clks(bad, schema, "s", validate=False)
    assert len(generate_clks([*PEOPLE_ROWS, ("4", "X", "1999/02/03", "M")], schema, "s", validate=False)) == 4
    with pytest.raises(FormatError) as e:
        generate_clks([*PEOPLE_ROWS, ("3", "x")], schema, "s")
    assert e.value.row_index == 3
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(bad)], "row_id long, a string, b string, c string, d string")
    assert {r.row_id: r.column for r in invalid_entries(df, schema).collect()} == {3: "born", 4: "full name"}
    marked = {r.row_id: r for r in encode(df, schema, "s", errors="column").collect()}
    assert marked[3].clk is None and "row 3" in marked[3].error and marked[0].error is None
    with pytest.raises(FormatError):
        encode(df.drop("d"), schema, "s")
    with pytest.raises(ValueError):
        encode(df, Schema(schema.fields, 1000), "s")
    with pytest.raises(ValueError):
        encode(df, schema, "s", engine="other")


def test_empty_callback_and_chunks(spark):
    schema = from_json_dict(people())
    assert generate_clks([], schema, "s") == []
    told = []
    out = generate_clks(PEOPLE_ROWS, schema, "s", callback=lambda n, counts: told.append((n, counts)))
    assert told == [(3, [b.count() for b in out])]
    assert list(chunks(range(5), 2)) == [(0, (0, 1)), (1, (2, 3)), (2, (4,))]
    with pytest.raises(ValueError):
        list(chunks([], 0))


def test_row_ids(spark):
    df = with_row_ids(spark.range(0, 100, 1, 7))
    assert [(r.id, r.row_id) for r in df.orderBy("id").collect()] == [(i, i) for i in range(100)]


def test_header():
    schema = from_json_dict(people())
    validate_header(schema.fields, PEOPLE_HEADER.split(","))
    for bad in (["a"], ["row", "full name", "sex", "born"]):
        with pytest.raises(FormatError):
            validate_header(schema.fields, bad)


def lines(rows):
    return [",".join(r) for r in rows]


@pytest.mark.parametrize(
    "name,content,outcomes",
    [
        ("good", [PEOPLE_HEADER, *lines(PEOPLE_ROWS)], (3, 3, EntryError)),
        ("name", [PEOPLE_HEADER.replace("full", "whole"), *lines(PEOPLE_ROWS)], (FormatError, 3, EntryError)),
        ("count", ["row,full name,born", *lines(PEOPLE_ROWS)], (FormatError, 3, FormatError)),
        ("none", lines(PEOPLE_ROWS), (FormatError, 2, 3)),
    ],
)
def test_csv_headers(spark, tmp_path, name, content, outcomes):
    path = tmp_path / f"{name}.csv"
    path.write_text("\n".join(content) + "\n")
    schema = from_json_dict(people())
    for header, want in zip((True, "ignore", False), outcomes, strict=True):
        if isinstance(want, int):
            assert len(source.generate_clk_from_csv(str(path), "open sesame", schema, header=header, spark=spark)) == want
        else:
            with pytest.raises(want):
                source.generate_clk_from_csv(str(path), "open sesame", schema, header=header, spark=spark)
    with pytest.raises(ValueError):
        source.read_csv(spark, str(path), schema, header="other")
    assert source.line_count(spark, str(path)) == len(content)


def test_csv_content(spark, tmp_path):
    schema = Schema([Ignore("i"), StringSpec("s", FieldHashingProperties(ExactComparison(), BitsPerTokenStrategy(5)))], 1024)
    path = tmp_path / "q.csv"
    path.write_text('i,s\n0,"a, ""b"""\n1,""\n2,\n3, x \n4,"two\nlines"\n')
    rows = source.read_csv(spark, str(path), schema).orderBy("row_id").collect()
    assert [(r.row_id, r.c1) for r in rows] == [(0, 'a, "b"'), (1, ""), (2, ""), (3, " x "), (4, "two\nlines")]
    made = source.generate_clk_from_csv(str(path), "s", schema, spark=spark)
    assert made == generate_clks([(str(i), v) for i, v in enumerate(('a, "b"', "", "", " x ", "two\nlines"))], schema, "s")
    path.write_text("i,s\n0,a\n1\n2,b\n")
    with pytest.raises(FormatError) as e:
        source.generate_clk_from_csv(str(path), "s", schema, spark=spark)
    assert e.value.row_index == 1


def test_csv_in_parallel(spark, tmp_path):
    schema = Schema([StringSpec("s", FieldHashingProperties(ExactComparison(), BitsPerTokenStrategy(5)))], 1024)
    spark.createDataFrame([(f"value {i}",) for i in range(500)], "s string").coalesce(1).write.csv(str(tmp_path / "p"), header=True)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = source.read_csv(spark, str(tmp_path / "p"), schema, multi_line=False)
        assert rows.rdd.getNumPartitions() > 1
        assert [(r.row_id, r.c0) for r in rows.orderBy("row_id").collect()] == [(i, f"value {i}") for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_encodings_round_trip(spark, tmp_path):
    schema = from_json_dict(people())
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(PEOPLE_ROWS)], "row_id long, a string, b string, c string, d string")
    made = encode(df, schema, "s")
    source.write_encodings(made, str(tmp_path / "e"))
    back = source.read_encodings(spark, str(tmp_path / "e"))
    assert {r.row_id: bytes(r.clk) for r in back.collect()} == {r.row_id: bytes(r.clk) for r in made.collect()}
    text = spark.read.parquet(str(tmp_path / "e")).first().clk
    assert "\n" not in text and Bits(tessera.deserialize_bitarray(text).data, 1024).length == 1024


def test_stream(spark, tmp_path):
    schema = from_json_dict(people())
    rows = [*PEOPLE_ROWS, ("3", "Bad Date", "no", "M")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a string, b string, c string, d string")
    df.write.parquet(str(tmp_path / "in"))
    made = encode_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), schema, "s", "id")
    query = write_encoded(made, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    out = {r.row_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = generate_clks(PEOPLE_ROWS, schema, "s")
    assert [bytes(out[i].clk) for i in range(3)] == [b.data for b in want] and out[3].clk is None and out[3].error
    memory = running_stats(made.where("error is null")).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    memory.awaitTermination()
    assert spark.table("stats").first().n == 3
    assert os.path.isdir(tmp_path / "cp")


def test_narrow_plan(spark):
    """One scan, one projection, one pass through Arrow; nothing is shuffled, and ignored columns are not read."""
    schema = from_json_dict(people())
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(PEOPLE_ROWS)], "row_id long, a string, b string, c string, d string")
    for engine, kind in (("arrow", "blakeHash"), ("native", "doubleHash")):
        plan = encode(df, schema if engine == "arrow" else from_json_dict(people(kind)), "s", engine=engine)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    assert F is not None


def test_native_folds_words_and_leaves_counts_of_bad_rows_out(spark):
    """Folded filters of the native engine are those of the Arrow engine, and where there is none there is no count."""
    schema = Schema([IntegerSpec("n", double(NgramComparison(2), BitsPerTokenStrategy(9)))], 128, 3)
    df = spark.createDataFrame([(0, "12345"), (1, "bad"), (2, "777")], "row_id long, n string")
    a, b = ({r.row_id: (r.clk, r.popcount) for r in encode(df, schema, "s", engine=e, errors="column").collect()} for e in ("arrow", "native"))
    assert a == b and a[1] == (None, None)

"""Fields: values that fit and values that do not, on strings and in Columns."""

import pytest
from pyspark.sql import functions as F

from tessera.errors import InvalidEntryError, InvalidSchemaError
from tessera.functions.strategies import BitsPerTokenStrategy
from tessera.functions.tokens import NgramComparison
from tessera.plans.fields import DateSpec, EnumSpec, FieldHashingProperties, Ignore, IntegerSpec, MissingValueSpec, StringSpec, spec_from_json_dict


def properties(**more):
    return FieldHashingProperties(NgramComparison(2), BitsPerTokenStrategy(10), **more)


CASES = [
    (StringSpec("s", properties(), regex=r"dog(.dog)*"), ["dog", "dog.dog", "dogfdogzdog"], ["", "dogy", "adog", "dog."]),
    (StringSpec("s", properties(encoding="ascii")), ["abc", ""], ["é"]),
    (StringSpec("s", properties(), case="lower"), ["abc", "a1"], ["Abc"]),
    (StringSpec("s", properties(), case="upper"), ["ABC", ""], ["ABc"]),
    (StringSpec("s", properties(), min_length=5, max_length=8), ["12345", "12345678", "ééééé"], ["1234", "123456789"]),
    (IntegerSpec("i", properties(), minimum=8, maximum=12), ["8", "10", " +12 ", "0009"], ["7", "13", "-10", "a", "", "1.5", "1e1"]),
    (IntegerSpec("i", properties(), minimum=8), ["8", str(10**321)], ["-" + "9" * 60]),
    (IntegerSpec("i", properties()), ["0", "-1", "  10", "+10"], ["bob", "- 1", "--1"]),
    (DateSpec("d", properties(), "%Y-%m-%d"), ["2016-02-29", "1970-01-01", "2006-3-20", "0123-01-12"], ["2017-02-29", "0000-01-01", "2017-13-01", "2017-00-00", " 2017-01-01", "2017/01/01", "17-01-01"]),
    (DateSpec("d", properties(), "%d/%m/%Y"), ["29/02/2016"], ["02/29/2016", "1-1-2016"]),
    (EnumSpec("e", properties(), ["dogs", "cats", "fërrets"]), ["dogs", "fërrets"], ["", "Dogs", "ferrets"]),
    (EnumSpec("e", properties(missing_value=MissingValueSpec("NULL", "dogs")), ["dogs"]), ["dogs", "NULL"], ["null"]),
]


@pytest.mark.parametrize("field,good,bad", CASES)
def test_validate(spark, field, good, bad):
    for value in good:
        field.validate(value)
    for value in bad:
        with pytest.raises(InvalidEntryError) as e:
            field.validate(value)
        assert e.value.field_spec is field
    rows = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, ok boolean")
    for r in rows.select("v", "ok", field.invalid_column(F.col("v")).alias("bad")).collect():
        assert r.bad != r.ok, r.v


def test_normal_forms(spark):
    number, day = IntegerSpec("i", properties()), DateSpec("d", properties(), "%Y-%m-%d")
    pairs = [(number, " +0010", "10"), (number, "-0", "0"), (number, "-007", "-7"), (number, "0", "0"), (number, "1_000", "1000"), (day, "1999-01-05", "19990105"), (day, "2006-3-20", "20060320")]
    for field, value, want in pairs:
        assert field.format_value(value) == want
        assert spark.range(1).select(field.format_column(F.lit(value)).alias("x")).first().x == want
    for field in (number, day):
        with pytest.raises(InvalidEntryError):
            field.format_value("no")


def test_missing_values(spark):
    field = DateSpec("d", properties(missing_value=MissingValueSpec("NA", "20000101")), "%Y-%m-%d")
    assert field.format_value("NA") == "20000101"  # as it stands
    assert MissingValueSpec("x").replace_with == "x"
    assert MissingValueSpec.from_json_dict({"sentinel": "a", "replaceWith": ""}).replace_with == ""
    assert spark.range(1).select(field.format_column(F.lit("NA")).alias("x")).first().x == "20000101"


def test_constructor_checks():
    for bad in (
        lambda: StringSpec("s", properties(), regex="a", case="upper"), lambda: StringSpec("s", properties(), regex="a", min_length=1), lambda: StringSpec("s", properties(), case="other"),
        lambda: StringSpec("s", properties(), min_length=-1), lambda: StringSpec("s", properties(), max_length=0), lambda: StringSpec("s", properties(), regex="("),
        lambda: FieldHashingProperties(None, BitsPerTokenStrategy(1)), lambda: FieldHashingProperties(NgramComparison(1), None), lambda: properties(encoding="none"), lambda: properties(prevent_singularity=True),
    ):
        with pytest.raises(ValueError):
            bad()


def test_json_fields():
    hashing = {"comparison": {"type": "exact"}, "strategy": {"bitsPerToken": 3}}
    field = spec_from_json_dict({"identifier": "a", "format": {"type": "string", "encoding": "ascii", "description": "d"}, "hashing": hashing})
    assert field.hashing_properties.encoding == "ascii" and field.description == "d" and field.min_length is None and field.hashing_properties.hash_type == "blakeHash"
    assert isinstance(spec_from_json_dict({"identifier": "a", "ignored": True, "format": {"type": "nothing"}}), Ignore)
    for bad in ({"identifier": "a"}, {"identifier": "a", "format": {"type": "x"}, "hashing": hashing}, {"identifier": "a", "format": {"type": "string", "pattern": "("}, "hashing": hashing}):
        with pytest.raises(InvalidSchemaError):
            spec_from_json_dict(bad)
    singular = hashing | {"hash": {"type": "blakeHash", "prevent_singularity": True}}
    with pytest.raises(ValueError):
        spec_from_json_dict({"identifier": "a", "format": {"type": "string"}, "hashing": singular})


def test_ignore():
    Ignore("x").validate("anything")
    assert Ignore().hashing_properties is None

"""Linkage schemas: rules, conversion, errors."""

import copy
import io
import json

import pytest

from tessera.errors import InvalidSchemaError, SchemaError
from tessera.plans.fields import Ignore, StringSpec
from tessera.plans.schema import Schema, convert_to_latest_version, from_json_dict, from_json_file, validate_schema_dict
from tests.schemas import GOLDEN_SCHEMA, KDF, people


def v2(strategy=None, **hashing):
    return {"version": 2, "clkConfig": {"l": 64, "kdf": {"type": "HKDF"}}, "features": [{"identifier": "a", "format": {"type": "string"}, "hashing": {"ngram": 2, "strategy": strategy or {"k": 5}} | hashing}]}


def test_good_schemas():
    s = from_json_dict(people())
    assert repr(s) == "<Schema (v3): 4 fields>" and s.l == 1024 and s.kdf_key_size == 64 and isinstance(s.fields[0], Ignore) and isinstance(s.fields[1], StringSpec)
    assert len(from_json_dict(GOLDEN_SCHEMA).fields) == 5
    assert from_json_dict(v2({"numBits": 7})).fields[0].hashing_properties.strategy.total == 7
    assert from_json_file(io.StringIO(json.dumps(people()))).l == 1024
    assert Schema([], 128, 2).hash_l == 512


def test_conversion():
    before = copy.deepcopy(GOLDEN_SCHEMA)
    new = convert_to_latest_version(GOLDEN_SCHEMA, validate_result=True)
    assert before == GOLDEN_SCHEMA and new["version"] == 3
    assert [f["hashing"]["strategy"]["bitsPerToken"] for f in new["features"]] == [60, 30, 15, 30, 30]
    assert new["features"][0]["hashing"]["comparison"] == {"type": "ngram", "n": 2, "positional": False} and new["features"][0]["hashing"]["hash"] == {"type": "doubleHash"}
    assert convert_to_latest_version(people()) == people()
    light = copy.deepcopy(GOLDEN_SCHEMA)
    light["features"][0]["hashing"]["weight"] = 0
    assert convert_to_latest_version(light)["features"][0] == {"identifier": "name", "ignored": True}


@pytest.mark.parametrize("bad", ["{", "[]", '"foo"', "{}", '{"version": 99}'])
def test_bad_documents(bad):
    with pytest.raises(SchemaError):
        from_json_file(io.StringIO(bad))


def changed(schema, *path, value=None, drop=False):
    schema = copy.deepcopy(schema)
    at = schema
    for p in path[:-1]:
        at = at[p]
    if drop:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return schema


HASHING = ("features", 1, "hashing")


@pytest.mark.parametrize(
    "bad",
    [
        changed(people(), "clkConfig", "l", drop=True),
        changed(people(), "clkConfig", "l", value=0),
        changed(people(), "clkConfig", "kdf", value={"type": "legacy"}),
        changed(people(), "clkConfig", "kdf", value={"type": "HKDF", "hash": "MD5"}),
        changed(people(), "features", 0, "ignored", value=False),
        changed(people(), *HASHING, "strategy", value={"bitsPerToken": 0}),
        changed(people(), *HASHING, "strategy", value={"bitsPerToken": 4.5}),
        changed(people(), *HASHING, "strategy", value={"bitsPerFeature": "4"}),
        changed(people(), *HASHING, "strategy", value={"bitsPerToken": 1, "bitsPerFeature": 1}),
        changed(people(), *HASHING, "strategy", value={}),
        changed(people(), *HASHING, "ngram", value=2),
        changed(people(), *HASHING, "comparison", value={"type": "ngram", "n": 0}),
        changed(people(), *HASHING, "comparison", value={"type": "numeric", "thresholdDistance": 0, "resolution": 1}),
        changed(people(), "features", 1, "format", value={"type": "string", "pattern": "a", "case": "upper"}),
        changed(people(), "features", 1, "format", value={"type": "enum"}),
        changed(people(), "features", 1, "format", value={"type": "date"}),
        changed(people(), "features", value={}),
        changed(GOLDEN_SCHEMA, "clkConfig", "k", drop=True),
        changed(GOLDEN_SCHEMA, "clkConfig", "k", value=30.0),
        changed(GOLDEN_SCHEMA, "features", 0, "hashing", "weight", value=0.01),  # rounds to a count of 0
        changed(GOLDEN_SCHEMA, "features", 0, "hashing", "ngram", value=0),  # allowed in version 1, not after conversion
        v2({"k": 0}),
        v2({"k": 1, "numBits": 1}),
        v2(more=1),
    ],
)
def test_bad_schemas(bad):
    with pytest.raises(SchemaError):
        from_json_dict(bad)


def test_integral_floats_count():
    assert from_json_dict(changed(people(), *HASHING, "strategy", value={"bitsPerToken": 4.0})).fields[1].hashing_properties.strategy.k == 4


def test_ignored_with_format():
    full = changed(people(), "features", 1, "ignored", value=True)
    assert isinstance(from_json_dict(full).fields[1], Ignore)
    old = v2()
    old["features"][0]["ignored"] = True
    with pytest.raises(SchemaError):
        validate_schema_dict(old)


def test_feature_errors_are_collected():
    bad = changed(changed(people(), "features", 1, "format", value={"type": "string", "pattern": "("}), "features", 2, "format", value={"type": "string", "pattern": "["})
    with pytest.raises(SchemaError) as e:
        from_json_dict(bad)
    assert [x.field_spec_index for x in e.value.errors] == [1, 2] and all(isinstance(x, InvalidSchemaError) for x in e.value.errors)


def test_folds():
    with pytest.warns(UserWarning):
        assert from_json_dict(changed(people(), "clkConfig", "xorFolds", value=1)).xor_folds == 0
    assert from_json_dict(changed(people(), "clkConfig", "xorFolds", value=1), strict_xor_folds=True).xor_folds == 1
    assert from_json_dict(changed(people(), "clkConfig", "xor_folds", value=2)).hash_l == 4096


def test_legacy_without_validation():
    s = from_json_dict(changed(people(), "clkConfig", "kdf", value={"type": "legacy"}), validate=False)
    assert s.kdf_type == "legacy" and KDF["type"] == "HKDF"

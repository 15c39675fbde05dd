"""Linkage schemas: the object, its JSON forms of versions 1 to 3, and their conversion to the latest."""

from __future__ import annotations

import base64
import json
import warnings
from collections.abc import Sequence
from copy import deepcopy
from typing import Any, TextIO

from tessera.errors import InvalidSchemaError, MasterSchemaError, SchemaError
from tessera.plans.fields import FieldSpec, spec_from_json_dict
from tessera.plans.rules import RULES

LATEST = 3


class Schema:
    """Fields in column order, the encoding's length after folding, and how keys are derived."""

    def __init__(
        self, fields: Sequence[FieldSpec], l: int, xor_folds: int = 0, kdf_type: str = "HKDF", kdf_hash: str = "SHA256",
        kdf_info: bytes | None = None, kdf_salt: bytes | None = None, kdf_key_size: int = 64,
    ) -> None:
        self.fields, self.l, self.xor_folds = tuple(fields), l, xor_folds
        self.kdf_type, self.kdf_hash, self.kdf_info, self.kdf_salt, self.kdf_key_size = kdf_type, kdf_hash, kdf_info, kdf_salt, kdf_key_size

    def __repr__(self) -> str:
        return f"<Schema (v{LATEST}): {len(self.fields)} fields>"

    @property
    def hash_l(self) -> int:
        """The filter's length before folding."""
        return self.l << self.xor_folds


def validate_schema_dict(schema: dict[str, Any]) -> None:
    """Raises SchemaError unless the dict fits the rules of its version."""
    if not isinstance(schema, dict):
        raise SchemaError("a schema must be a JSON object")
    if "version" not in schema:
        raise SchemaError("a schema must have a version")
    if schema["version"] not in (1, 2, 3):
        raise SchemaError(f"schema version {schema['version']!r} is not supported")
    rule = RULES.get(schema["version"])
    if rule is None:
        raise MasterSchemaError(f"there are no rules for version {schema['version']!r}")
    wrong = list(rule(schema, "schema"))
    if wrong:
        raise SchemaError("the schema is not valid: " + "; ".join(wrong))


def _to_v2(old: dict[str, Any]) -> dict[str, Any]:
    """The job-wide count becomes one for each feature, by its weight; a weight of 0 ignores the feature."""
    config = old["clkConfig"]
    features = []
    for feature in old["features"]:
        if not feature.get("ignored", False):
            hashing = dict(feature["hashing"])
            weight = hashing.pop("weight", 1.0)
            if weight == 0:
                feature = {"identifier": feature["identifier"], "ignored": True}
            else:
                feature = feature | {"hashing": hashing | {"strategy": {"k": int(round(weight * config["k"]))}, "hash": config["hash"]}}
        features.append(feature)
    return {"version": 2, "clkConfig": {"l": config["l"], "xor_folds": config.get("xor_folds", 0), "kdf": config["kdf"]} | {k: config[k] for k in ("xorFolds",) if k in config}, "features": features}


#: Names of insertion counts in version 2 and 3.
_COUNTS = {"k": "bitsPerToken", "numBits": "bitsPerFeature"}


def _to_v3(old: dict[str, Any]) -> dict[str, Any]:
    """Strategies get their new names, and the n-gram settings become a comparison."""
    def converted(feature: dict[str, Any]) -> dict[str, Any]:
        if feature.get("ignored", False):
            return feature
        hashing = dict(feature["hashing"])
        comparison = {"type": "ngram", "n": hashing.pop("ngram"), "positional": hashing.pop("positional", False)}
        strategy = {_COUNTS.get(k, k): v for k, v in hashing["strategy"].items()}
        return feature | {"hashing": hashing | {"comparison": comparison, "strategy": strategy}}

    return old | {"version": 3, "features": [converted(f) for f in old["features"]]}


def convert_to_latest_version(schema: dict[str, Any], validate_result: bool = False) -> dict[str, Any]:
    """A schema of any version as one of the latest; the given dict is left as it is."""
    version = schema.get("version", "not given")
    if version not in RULES:
        raise SchemaError(f"schema version {version!r} is not supported")
    schema = deepcopy(schema)
    for step in (_to_v2, _to_v3)[int(version) - 1 :]:
        schema = step(schema)
    if validate_result:
        validate_schema_dict(schema)
    return schema


def from_json_dict(described: dict[str, Any], validate: bool = True, strict_xor_folds: bool = False) -> Schema:
    """A Schema from its JSON form.

    The number of folds is read from ``xor_folds``, so that encodings stay equal to earlier ones. The documented
    name ``xorFolds`` has no effect but a warning, unless ``strict_xor_folds`` is set.
    """
    if validate:
        validate_schema_dict(described)
    described = convert_to_latest_version(described, validate_result=validate)
    config = described["clkConfig"]
    folds = config.get("xor_folds", 0)
    if config.get("xorFolds"):
        if strict_xor_folds:
            folds = config["xorFolds"]
        else:
            warnings.warn("xorFolds is read as xor_folds only; set strict_xor_folds to honour it", stacklevel=2)
    kdf = config["kdf"]
    fields, errors = [], []
    for i, feature in enumerate(described["features"]):
        try:
            fields.append(spec_from_json_dict(feature))
        except InvalidSchemaError as e:
            e.field_spec_index, e.json_field_spec = i, feature
            errors.append(e)
    if errors:
        raise SchemaError("the schema has invalid features", errors)
    decoded = lambda name: base64.b64decode(kdf[name]) if kdf.get(name) is not None else None
    return Schema(fields, int(config["l"]), int(folds), kdf["type"], kdf.get("hash", "SHA256"), decoded("info"), decoded("salt"), int(kdf.get("keySize", 64)))


def from_json_file(file: TextIO, validate: bool = True, strict_xor_folds: bool = False) -> Schema:
    try:
        described = json.load(file)
    except ValueError as e:
        raise SchemaError(f"the schema is not valid JSON: {e}") from e
    return from_json_dict(described, validate, strict_xor_folds)

"""Privacy-preserving record-linkage encoding on Spark.

A linkage schema says how each column of personal data is checked, split into tokens and hashed; the engine turns a
table into fixed-length keyed Bloom filters that can be compared without the data.
"""

from tessera.errors import DescribeError, EntryError, FormatError, InvalidEntryError, InvalidSchemaError, MasterSchemaError, SchemaError
from tessera.functions.bits import Bits, deserialize_bitarray, fold_xor, serialize_bitarray
from tessera.functions.keys import generate_key_lists, hkdf
from tessera.functions.strategies import BitsPerFeatureStrategy, BitsPerTokenStrategy, StrategySpec
from tessera.functions.tokens import AbstractComparison, ExactComparison, NgramComparison, NonComparison, NumericComparison, get_comparator
from tessera.operators.encode import encode, generate_clks
from tessera.operators.stats import OnlineMeanVariance, get_encoding_popcounts
from tessera.operators.synth import Distribution, NameList, generate_people, overlapping_subsets
from tessera.operators.validate import validate_entries, validate_header
from tessera.plans.fields import DateSpec, EnumSpec, FieldHashingProperties, FieldSpec, Ignore, IntegerSpec, MissingValueSpec, StringSpec, spec_from_json_dict
from tessera.plans.schema import Schema, convert_to_latest_version, from_json_dict, from_json_file, validate_schema_dict
from tessera.sources.csv import encode_csv, generate_clk_from_csv, read_csv

__all__ = [
    "AbstractComparison", "Bits", "BitsPerFeatureStrategy", "BitsPerTokenStrategy", "DateSpec", "DescribeError", "Distribution", "EntryError", "EnumSpec",
    "ExactComparison", "FieldHashingProperties", "FieldSpec", "FormatError", "Ignore", "IntegerSpec", "InvalidEntryError", "InvalidSchemaError", "MasterSchemaError",
    "MissingValueSpec", "NameList", "NgramComparison", "NonComparison", "NumericComparison", "OnlineMeanVariance", "Schema", "SchemaError", "StrategySpec", "StringSpec",
    "convert_to_latest_version", "deserialize_bitarray", "encode", "encode_csv", "fold_xor", "from_json_dict", "from_json_file", "generate_clk_from_csv", "generate_clks",
    "generate_key_lists", "generate_people", "get_comparator", "get_encoding_popcounts", "hkdf", "overlapping_subsets", "read_csv", "serialize_bitarray",
    "spec_from_json_dict", "validate_entries", "validate_header", "validate_schema_dict",
]

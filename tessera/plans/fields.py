"""Fields of a linkage schema: how a column's values are checked, normalised and hashed.

A field works on single strings (``validate``, ``format_value``), as the Arrow engine uses it, and offers Column forms
(``invalid_column``, ``format_column``) for the native engine and for validation that stays in the JVM.
"""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidEntryError, InvalidSchemaError
from tessera.functions.strategies import StrategySpec
from tessera.functions.tokens import AbstractComparison, get_comparator

#: The encodings and letter cases a schema may name.
ENCODINGS = ("ascii", "utf-8", "utf-16", "utf-32")
CASES = ("lower", "mixed", "upper")


class MissingValueSpec:
    """The string that stands for a missing value, and what is hashed in its place (itself by default)."""

    def __init__(self, sentinel: str, replace_with: str | None = None) -> None:
        self.sentinel = sentinel
        self.replace_with = sentinel if replace_with is None else replace_with

    @classmethod
    def from_json_dict(cls, described: dict[str, Any]) -> MissingValueSpec:
        return cls(described["sentinel"], described.get("replaceWith"))


class FieldHashingProperties:
    """Tokeniser, insertion strategy, hash and missing value of a field."""

    def __init__(
        self, comparator: AbstractComparison, strategy: StrategySpec, encoding: str = "utf-8", hash_type: str = "blakeHash",
        prevent_singularity: bool | None = None, missing_value: MissingValueSpec | None = None,
    ) -> None:
        if comparator is None:
            raise ValueError("a comparator is needed")
        try:
            "".encode(encoding)
        except LookupError:
            raise ValueError(f"unknown encoding {encoding!r}") from None
        if prevent_singularity is not None and hash_type != "doubleHash":
            raise ValueError("prevent_singularity is for doubleHash only")
        if strategy is None:
            raise ValueError("an insertion strategy is needed")
        self.comparator, self.strategy, self.encoding = comparator, strategy, encoding
        self.hash_type, self.prevent_singularity, self.missing_value = hash_type, prevent_singularity, missing_value

    @classmethod
    def from_json_dict(cls, described: dict[str, Any]) -> FieldHashingProperties:
        hashing = described.get("hash", {"type": "blakeHash"})
        missing = described.get("missingValue")
        return cls(
            get_comparator(described["comparison"]), StrategySpec.from_json_dict(described["strategy"]), hash_type=hashing["type"],
            prevent_singularity=hashing.get("prevent_singularity"), missing_value=MissingValueSpec.from_json_dict(missing) if missing else None,
        )

    def replace_missing_value(self, value: str) -> str:
        missing = self.missing_value
        return missing.replace_with if missing and value == missing.sentinel else value


class FieldSpec:
    """A field; subclass it with ``check`` and ``normal`` for one of your own."""

    def __init__(self, identifier: str | None, hashing_properties: FieldHashingProperties | None, description: str | None = None) -> None:
        self.identifier, self.hashing_properties, self.description = identifier, hashing_properties, description

    @classmethod
    def from_json_dict(cls, described: dict[str, Any]) -> FieldSpec:
        """From a feature of a version 3 schema; what its rules have checked is not checked again."""
        field = cls.__new__(cls)
        hashing = FieldHashingProperties.from_json_dict(described["hashing"]) if "hashing" in described else None
        FieldSpec.__init__(field, described["identifier"], hashing, described["format"].get("description"))
        field._read(described["format"])
        return field

    def _read(self, form: dict[str, Any]) -> None:
        """Takes the field's own settings from its ``format``."""

    # -- on strings

    def is_missing_value(self, value: str) -> bool:
        missing = self.hashing_properties.missing_value if self.hashing_properties else None
        return missing is not None and value == missing.sentinel

    def validate(self, value: str) -> None:
        """Raises InvalidEntryError if the value does not fit."""
        if self.is_missing_value(value):
            return
        try:
            value.encode(self.hashing_properties.encoding)
        except UnicodeEncodeError:
            self._bad(f"cannot be encoded as {self.hashing_properties.encoding}: {value!r}")
        self.check(value)

    def check(self, value: str) -> None:
        """The field's own rule."""

    def format_value(self, value: str) -> str:
        """What is tokenised: a missing value's replacement as it stands, or the value in its normal form."""
        if self.is_missing_value(value):
            return self.hashing_properties.replace_missing_value(value)
        return self.normal(value)

    def normal(self, value: str) -> str:
        return value

    def _bad(self, what: str) -> None:
        error = InvalidEntryError(what)
        error.field_spec = self
        raise error

    # -- on Columns

    def _present(self, c: Column) -> Column:
        missing = self.hashing_properties.missing_value
        return F.lit(True) if missing is None else c != missing.sentinel

    def invalid_column(self, c: Column) -> Column:
        """A boolean Column: the value does not fit."""
        wrong = ~self.fits_column(c)
        if self.hashing_properties.encoding == "ascii":
            wrong = wrong | (F.octet_length(c) != F.char_length(c))
        return self._present(c) & F.coalesce(wrong, F.lit(True))

    def fits_column(self, c: Column) -> Column:
        return F.lit(True)

    def format_column(self, c: Column) -> Column:
        normal = self.normal_column(c)
        missing = self.hashing_properties.missing_value
        return normal if missing is None else F.when(c == missing.sentinel, F.lit(missing.replace_with)).otherwise(normal)

    def normal_column(self, c: Column) -> Column:
        return c


def java_regex(pattern: str) -> str:
    """Python's names for groups in Java's spelling, matched against the whole value."""
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    return rf"\A(?:{re.sub(r'[(][?]P=(\w+)[)]', r'\\k<\1>', pattern)})\z"


class StringSpec(FieldSpec):
    """Text: either a whole-match regex, or letter case and length bounds."""

    def __init__(
        self, identifier: str, hashing_properties: FieldHashingProperties, description: str | None = None, regex: str | None = None,
        case: str = "mixed", min_length: int | None = 0, max_length: int | None = None,
    ) -> None:
        super().__init__(identifier, hashing_properties, description)
        if regex is not None:
            if case != "mixed" or min_length or max_length is not None:
                raise ValueError("a regex excludes case and length bounds")
            try:
                self.regex: re.Pattern[str] | None = re.compile(regex)
            except re.error as e:
                raise InvalidEntryError(f"invalid regular expression: {e}") from e
        else:
            self.regex = None
            if case not in CASES:
                raise ValueError(f"the case must be one of {', '.join(CASES)}, but was {case!r}")
            if min_length is not None and min_length < 0:
                raise ValueError(f"min_length must not be negative, but was {min_length}")
            if max_length is not None and max_length <= 0:
                raise ValueError(f"max_length must be positive, but was {max_length}")
        self.case, self.min_length, self.max_length = case, min_length, max_length

    def _read(self, form: dict[str, Any]) -> None:
        if "encoding" in form:
            self.hashing_properties.encoding = form["encoding"]
        self.regex = None
        if "pattern" in form:
            try:
                self.regex = re.compile(form["pattern"])
            except re.error as e:
                raise InvalidSchemaError(f"invalid regular expression: {e}") from e
        self.case, self.min_length, self.max_length = form.get("case", "mixed"), form.get("minLength"), form.get("maxLength")

    def check(self, value: str) -> None:
        if self.regex is not None:
            if not self.regex.fullmatch(value):
                self._bad(f"expected a value matching {self.regex.pattern!r}, but read {value!r}")
            return
        if self.min_length is not None and len(value) < self.min_length:
            self._bad(f"expected at least {self.min_length} characters, but read {value!r}")
        if self.max_length is not None and len(value) > self.max_length:
            self._bad(f"expected at most {self.max_length} characters, but read {value!r}")
        if self.case not in CASES:
            raise ValueError(f"unknown case {self.case!r}")
        if (self.case == "upper" and value.upper() != value) or (self.case == "lower" and value.lower() != value):
            self._bad(f"expected {self.case} case, but read {value!r}")

    def fits_column(self, c: Column) -> Column:
        if self.regex is not None:
            return c.rlike(java_regex(self.regex.pattern))
        fits = F.lit(True)
        if self.min_length:
            fits = fits & (F.char_length(c) >= self.min_length)
        if self.max_length is not None:
            fits = fits & (F.char_length(c) <= self.max_length)
        if self.case != "mixed":
            fits = fits & ((F.upper(c) if self.case == "upper" else F.lower(c)) == c)
        return fits


class IntegerSpec(FieldSpec):
    """A whole number in base 10, of any size, within inclusive bounds; its normal form is plain digits with a sign if negative."""

    def __init__(self, identifier: str, hashing_properties: FieldHashingProperties, description: str | None = None, minimum: int | None = None, maximum: int | None = None) -> None:
        super().__init__(identifier, hashing_properties, description)
        self.minimum, self.maximum = minimum, maximum

    def _read(self, form: dict[str, Any]) -> None:
        self.minimum, self.maximum = form.get("minimum"), form.get("maximum")

    def _number(self, value: str) -> int:
        try:
            return int(value, 10)
        except ValueError:
            self._bad(f"expected an integer, but read {value!r}")
            raise

    def check(self, value: str) -> None:
        number = self._number(value)
        if self.minimum is not None and number < self.minimum:
            self._bad(f"expected at least {self.minimum}, but read {value!r}")
        if self.maximum is not None and number > self.maximum:
            self._bad(f"expected at most {self.maximum}, but read {value!r}")

    def normal(self, value: str) -> str:
        return str(self._number(value))

    def fits_column(self, c: Column) -> Column:
        """For ASCII digits; numbers of over 38 digits are compared by sign and length."""
        shape = c.rlike(r"\A\s*[+-]?[0-9]+(?:_[0-9]+)*\s*\z")
        number = self.normal_column(c)
        value = number.try_cast("decimal(38,0)")
        wide = F.when(number.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
        low = F.lit(True) if self.minimum is None else F.when(value.isNull(), wide > 0).otherwise(value >= F.lit(str(self.minimum)).cast("decimal(38,0)"))
        high = F.lit(True) if self.maximum is None else F.when(value.isNull(), wide < 0).otherwise(value <= F.lit(str(self.maximum)).cast("decimal(38,0)"))
        return shape & low & high

    def normal_column(self, c: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(c, r"[\s_+]", ""), r"\A(-?)0+(?=[0-9])", "$1")
        return F.when(plain == "-0", F.lit("0")).otherwise(plain)


class DateSpec(FieldSpec):
    """A date in a strptime format; its normal form is year, month and day without separators."""

    OUTPUT = "%Y%m%d"

    def __init__(self, identifier: str, hashing_properties: FieldHashingProperties, format: str, description: str | None = None) -> None:  # noqa: A002
        super().__init__(identifier, hashing_properties, description)
        self.format = format

    def _read(self, form: dict[str, Any]) -> None:
        self.format = form["format"]

    def _date(self, value: str) -> datetime:
        try:
            return datetime.strptime(value, self.format)
        except ValueError as e:
            self._bad(f"expected a date as {self.format!r}, but read {value!r}: {e}")
            raise

    def check(self, value: str) -> None:
        self._date(value)

    def normal(self, value: str) -> str:
        return self._date(value).strftime(self.OUTPUT)

    def _parts(self) -> tuple[str, list[str]]:
        """A regex with one group for each of year, month and day, and their order; only for formats of these."""
        pieces, order, at = [], [], 0
        while at < len(self.format):
            code = self.format[at : at + 2]
            if code in ("%Y", "%m", "%d"):
                order.append(code[1])
                pieces.append({"%Y": "([0-9]{4})", "%m": "(1[0-2]|0[1-9]|[1-9])", "%d": "(3[01]|[12][0-9]|0[1-9]|[1-9])"}[code])
                at += 2
            elif code[0] == "%":
                raise NotImplementedError(f"{self.format!r} has no Column form")
            else:
                pieces.append(re.escape(self.format[at]))
                at += 1
        if sorted(order) != ["Y", "d", "m"]:
            raise NotImplementedError(f"{self.format!r} has no Column form")
        return rf"\A{''.join(pieces)}\z", order

    def _column_date(self, c: Column) -> Column:
        shape, order = self._parts()
        part = {p: F.regexp_extract(c, shape, order.index(p) + 1) for p in "Ymd"}
        text = F.concat_ws("-", part["Y"], F.lpad(part["m"], 2, "0"), F.lpad(part["d"], 2, "0"))
        return F.when(c.rlike(shape) & (part["Y"] != "0000"), F.try_to_date(text, "yyyy-MM-dd"))

    def fits_column(self, c: Column) -> Column:
        return self._column_date(c).isNotNull()

    def normal_column(self, c: Column) -> Column:
        day = self._column_date(c)
        return F.concat(F.year(day).cast("string"), F.date_format(day, "MMdd"))


class EnumSpec(FieldSpec):
    """One of a set of values."""

    def __init__(self, identifier: str, hashing_properties: FieldHashingProperties, values: Any, description: str | None = None) -> None:
        super().__init__(identifier, hashing_properties, description)
        self.values = frozenset(values)

    def _read(self, form: dict[str, Any]) -> None:
        self.values = frozenset(form["values"])

    def check(self, value: str) -> None:
        if value not in self.values:
            self._bad(f"expected one of {sorted(self.values)}, but read {value!r}")

    def fits_column(self, c: Column) -> Column:
        return c.isin(sorted(self.values))


class Ignore(FieldSpec):
    """A column that is neither checked nor hashed, but has its place and its keys."""

    def __init__(self, identifier: str | None = None) -> None:
        super().__init__("" if identifier is None else identifier, None)

    def validate(self, value: str) -> None:
        pass

    def invalid_column(self, c: Column) -> Column:
        return F.lit(False)


TYPES: dict[str, type[FieldSpec]] = {"string": StringSpec, "integer": IntegerSpec, "date": DateSpec, "enum": EnumSpec}


def spec_from_json_dict(described: dict[str, Any]) -> FieldSpec:
    """The field that a feature describes; ``ignored`` wins over everything else."""
    if described.get("ignored", False):
        return Ignore(described["identifier"])
    try:
        return TYPES[described["format"]["type"]].from_json_dict(described)
    except KeyError as e:
        raise InvalidSchemaError(f"the feature {described.get('identifier')!r} has no or an unknown {e}") from e

"""Insertion counts: how often each of a value's tokens goes into the filter."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidSchemaError


class StrategySpec(ABC):
    """Subclass it for counts of your own; without ``column`` it runs in the Arrow engine only."""

    @abstractmethod
    def bits_per_token(self, num_tokens: int) -> list[int]: ...

    def column(self, i: Column, num_tokens: Column) -> Column:
        """The count of the token at place i (from 0)."""
        raise NotImplementedError(f"{type(self).__name__} has no Column form")

    @staticmethod
    def from_json_dict(described: dict[str, Any]) -> StrategySpec:
        for key, make in (("bitsPerToken", BitsPerTokenStrategy), ("bitsPerFeature", BitsPerFeatureStrategy)):
            if key in described:
                return make(int(described[key]))
        raise InvalidSchemaError(f"unknown insertion strategy: {described}")


class BitsPerTokenStrategy(StrategySpec):
    """The same count for every token."""

    def __init__(self, bits_per_token: int) -> None:
        self.k = bits_per_token

    def bits_per_token(self, num_tokens: int) -> list[int]:
        return [self.k] * num_tokens

    def column(self, i: Column, num_tokens: Column) -> Column:
        return F.lit(self.k)


class BitsPerFeatureStrategy(StrategySpec):
    """Counts that add up to a whole for the feature; the first tokens take what does not divide."""

    def __init__(self, bits_per_feature: int) -> None:
        self.total = bits_per_feature

    def bits_per_token(self, num_tokens: int) -> list[int]:
        each, over = divmod(self.total, num_tokens)
        return [each + (i < over) for i in range(num_tokens)]

    def column(self, i: Column, num_tokens: Column) -> Column:
        n = F.nullif(num_tokens, F.lit(0))
        return (F.floor(F.lit(self.total) / n) + (i < F.lit(self.total) % n).cast("int")).cast("int")

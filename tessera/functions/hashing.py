"""Keyed hashing of tokens to bit positions.

Python kernels work on whole-number bit masks: position 0 is the highest bit, and a field's filter is the OR of
its tokens' masks, which are remembered for each worker. The Column form of the double hash writes HMAC out with
Spark's md5 and sha1 over pads that are literals of the plan; so it shows key material in explained plans,
and belongs to checks and small jobs. BLAKE2b has no Column form.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = Callable[[bytes, int, tuple[bytes, ...], int], int]
#: Tokens that a worker remembers.
REMEMBERED = 1 << 16


def _mask(positions: Iterable[int], l: int) -> int:
    out = 0
    for p in positions:
        out |= 1 << (l - 1 - p)
    return out


def _hashed(key: bytes, message: bytes, name: str, l: int) -> int:
    return int.from_bytes(hmac.digest(key, message, name), "big") % l


@lru_cache(REMEMBERED)
def double_hash(token: bytes, k: int, keys: tuple[bytes, ...], l: int) -> int:
    """Positions a + i * b: a by HMAC-SHA1 with the first key, b by HMAC-MD5 with the second."""
    a, b = _hashed(keys[0], token, "sha1", l), _hashed(keys[1], token, "md5", l)
    return _mask(((a + i * b) % l for i in range(k)), l)


@lru_cache(REMEMBERED)
def double_hash_non_singular(token: bytes, k: int, keys: tuple[bytes, ...], l: int) -> int:
    """The same with b hashed again, over the token and a counter's character, until it is not 0."""
    a, b, tries = _hashed(keys[0], token, "sha1", l), _hashed(keys[1], token, "md5", l), 0
    while not b:
        b = _hashed(keys[1], token + chr(tries).encode(), "md5", l)
        tries += 1
    return _mask(((a + i * b) % l for i in range(k)), l)


@lru_cache(REMEMBERED)
def blake_hash(token: bytes, k: int, keys: tuple[bytes, ...], l: int) -> int:
    """Positions from the 16-bit numbers of keyed BLAKE2b digests, salted by the digest's number."""
    shorts: list[int] = []
    for i in range(-(-k // 32)):
        shorts += struct.unpack("<32H", hashlib.blake2b(token, key=keys[0], salt=str(i).encode()).digest())
    return _mask((s % l for s in shorts[:k]), l)


def kernel(hash_type: str, prevent_singularity: bool | None, l: int) -> Kernel:
    """The kernel for a field; l is the filter's length before folding."""
    if hash_type == "doubleHash":
        return double_hash_non_singular if prevent_singularity else double_hash
    if hash_type == "blakeHash":
        if l & (l - 1):
            raise ValueError(f"the length must be a power of two for blakeHash, but was {l}")
        return blake_hash
    raise ValueError(f"unsupported hash type: {hash_type!r}")


def encode_tokens(tokens: Sequence[str], ks: Sequence[int], keys: tuple[bytes, ...], l: int, encoding: str, make: Kernel) -> int:
    """The mask of a value."""
    out = 0
    for token, k in zip(tokens, ks, strict=True):
        out |= make(token.encode(encoding), k, keys, l)
    return out


# ---- Column forms --------------------------------------------------------------------------------------


def hmac_pads(key: bytes, name: str) -> tuple[bytes, bytes]:
    """HMAC's inner and outer pad; both hashes have blocks of 64 bytes."""
    key = (hashlib.new(name, key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_column(message: Column, key: bytes, name: str) -> Column:
    """HMAC of a binary column as lower-case hexadecimal digits."""
    make = {"sha1": F.sha1, "md5": F.md5}[name]
    inner, outer = hmac_pads(key, name)
    return make(F.concat(F.lit(outer), F.unhex(make(F.concat(F.lit(inner), message)))))


def hex_mod(digits: Column, n_digits: int, l: int) -> Column:
    """A hexadecimal number modulo l: from its last digits where l is a power of two up to 2**60, else by Horner's rule."""
    if l & (l - 1) == 0 and l <= 1 << 60:
        return F.conv(F.right(digits, F.lit(15)), 16, 10).cast("long") % l
    acc = F.lit(0).cast("long")
    for at in range(0, n_digits, 4):
        acc = (acc * 65536 + F.conv(F.substring(digits, at + 1, 4), 16, 10).cast("long")) % l
    return acc


#: Further md5 tries that the Column form has for b = 0; with l of 1024 the last is needed once in 2**60 tokens. Where all give 0, an error is raised.
RETRIES = 5


def double_hash_column(token: Column, k: Column, keys: tuple[bytes, ...], l: int, non_singular: bool = False) -> Column:
    """array<long> of the k positions of a token (a string column, UTF-8)."""
    message = F.encode(token, "UTF-8")
    a = hex_mod(hmac_column(message, keys[0], "sha1"), 40, l)
    b = hex_mod(hmac_column(message, keys[1], "md5"), 32, l)
    if non_singular:
        again = [F.nullif(hex_mod(hmac_column(F.concat(message, F.lit(bytes([i]))), keys[1], "md5"), 32, l), F.lit(0)) for i in range(RETRIES)]
        b = F.coalesce(F.nullif(b, F.lit(0)), *again, F.raise_error(F.lit("a token's second hash is 0 after all retries; use the arrow engine")).cast("long"))
    # the pair is computed once and then used by every position
    pair = F.array(F.struct(a.alias("a"), b.alias("b")))
    positions = F.transform(pair, lambda h: F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: (h["a"] + i * h["b"]) % l))
    return F.when(k > 0, F.element_at(positions, 1)).otherwise(F.array().cast("array<long>"))

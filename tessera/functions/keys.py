"""Key derivation on the driver: RFC 5869 (HKDF) cut into one key list a field, or the legacy form."""

from __future__ import annotations

import hashlib
import hmac

#: The hashes HKDF may use.
HASHES = {"SHA256": hashlib.sha256, "SHA512": hashlib.sha512}


def hkdf(secret: bytes, num_keys: int, hash_algo: str = "SHA256", salt: bytes | None = None, info: bytes | None = None, key_size: int = 64) -> tuple[bytes, ...]:
    """``num_keys`` keys of ``key_size`` bytes each, from one HKDF output."""
    if hash_algo not in HASHES:
        raise ValueError(f"unsupported hash algorithm: {hash_algo!r}; known are {', '.join(HASHES)}")
    make = HASHES[hash_algo]
    size, length = make().digest_size, num_keys * key_size
    if length > 255 * size:
        raise ValueError(f"cannot derive {num_keys} keys of {key_size} bytes: {hash_algo} gives at most {255 * size} bytes")
    extracted = hmac.new(salt or bytes(size), secret, make).digest()
    block, out, i = b"", b"", 0
    while len(out) < length:
        i += 1
        block = hmac.new(extracted, block + (info or b"") + bytes([i]), make).digest()
        out += block
    return tuple(out[at : at + key_size] for at in range(0, length, key_size))


def generate_key_lists(
    secret: bytes | str, num_identifier: int, num_hashing_methods: int = 2, key_size: int = 64,
    salt: bytes | None = None, info: bytes | None = None, kdf: str = "HKDF", hash_algo: str = "SHA256",
) -> tuple[tuple[bytes, ...], ...]:
    """For each field, ignored ones too, a tuple of ``num_hashing_methods`` keys."""
    if num_hashing_methods < 1:
        raise ValueError("at least one hashing method is needed")
    if isinstance(secret, str):
        secret = secret.encode("utf-8")
    if not isinstance(secret, bytes):
        raise TypeError("the secret must be bytes or str")
    if kdf == "HKDF":
        keys = hkdf(secret, num_identifier * num_hashing_methods, hash_algo, salt, info, key_size)
        return tuple(keys[i : i + num_hashing_methods] for i in range(0, len(keys), num_hashing_methods))
    if kdf == "legacy":
        return ((secret,) * num_hashing_methods,) * num_identifier
    raise ValueError(f"unsupported key derivation function: {kdf!r}")

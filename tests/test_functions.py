"""Tokens, strategies, keys, hashing and bits; Python kernels against Column forms."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.errors import InvalidSchemaError
from tessera.functions import bits, hashing
from tessera.functions.bits import Bits
from tessera.functions.keys import generate_key_lists, hkdf
from tessera.functions.strategies import BitsPerFeatureStrategy, BitsPerTokenStrategy, StrategySpec
from tessera.functions.tokens import ExactComparison, NgramComparison, NonComparison, NumericComparison, get_comparator

WORDS = ["", "a", "ab", "José", "a b", "12", "longer value", " x "]


def test_ngrams():
    assert NgramComparison(2).tokenize("ab") == [" a", "ab", "b "]
    assert NgramComparison(1, True).tokenize("ab") == ["1 a", "2 b"]
    assert NgramComparison(2).tokenize("") == []
    assert NgramComparison(0).tokenize("ab") == ["", "", ""]
    assert NgramComparison(0, True).tokenize("a") == ["1 ", "2 "]
    with pytest.raises(ValueError):
        NgramComparison(-1)


@given(st.text(min_size=1, max_size=30), st.integers(1, 4))
def test_ngram_count(word, n):
    tokens = NgramComparison(n).tokenize(word)
    assert len(tokens) == len(word) + n - 1
    assert NgramComparison(n, True).tokenize(word) == [f"{i} {t}" for i, t in enumerate(tokens, 1)]


@pytest.mark.parametrize("made", [NgramComparison(1), NgramComparison(2), NgramComparison(3, True), NgramComparison(0), ExactComparison(), NonComparison()])
def test_token_columns(spark, made):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string")
    for r in rows.select("w", made.column(F.col("w")).alias("t")).collect():
        assert list(r.t) == list(made.tokenize(r.w)), r.w


def test_numeric():
    assert NumericComparison(8, 2).tokenize("25") == ["88", "96", "104", "112", "120"]
    assert NumericComparison(1, 20, 3).tokenize("42") == NumericComparison(1, 20, 3).tokenize("42.000")
    assert NumericComparison(8, 2).tokenize("") == []
    assert NumericComparison(1, 1).tokenize("-1.9") == NumericComparison(1, 1).tokenize("-1")
    assert NumericComparison(7, 1).tokenize(str(10**60))
    for bad, text in (((0, 1), "threhold_distance"), ((1, 0), "resolution"), ((1, 1, -1), "fractional_precision"), ((0.001, 1, 1), "not enough fractional precision")):
        with pytest.raises(ValueError, match=text):
            NumericComparison(*bad)


@settings(max_examples=60)
@given(st.integers(-(10**6), 10**6), st.integers(0, 400), st.integers(1, 500), st.integers(1, 30))
def test_numeric_neighbourhoods(x, gap, threshold, resolution):
    made = NumericComparison(threshold, resolution)
    a, b = set(made.tokenize(str(x))), set(made.tokenize(str(x + gap)))
    assert len(a) == 2 * resolution + 1
    if gap < threshold - threshold / resolution:
        assert a & b
    if gap > threshold + threshold / resolution:
        assert not a & b


@pytest.mark.parametrize("made", [NumericComparison(8, 2), NumericComparison(5.5, 3, 2), NumericComparison(1, 1)])
def test_numeric_columns(spark, made):
    rng = random.Random(3)
    words = ["", "0", "-0", "7", "-7", "25", "-25.5", "1.255", "-1.245"] + [str(rng.randint(-(10**6), 10**6)) for _ in range(50)] + [f"{rng.uniform(-1000, 1000):.2f}" for _ in range(50)]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", made.column(F.col("w")).alias("t")).collect():
        want = made.tokenize(r.w)
        if r.w in ("1.255", "-1.245"):
            continue  # halves in binary are not halves in decimal
        assert list(r.t) == want, r.w


def test_comparators_by_name():
    assert isinstance(get_comparator({"type": "exact"}), ExactComparison)
    assert get_comparator({"type": "ngram", "n": 2, "positional": True}).positional
    for bad in ({}, {"type": "ngram"}, {"type": "other"}, {"type": "numeric"}):
        with pytest.raises(ValueError):
            get_comparator(bad)


def test_strategies():
    assert BitsPerTokenStrategy(3).bits_per_token(2) == [3, 3]
    assert BitsPerFeatureStrategy(10).bits_per_token(4) == [3, 3, 2, 2]
    assert BitsPerFeatureStrategy(2).bits_per_token(4) == [1, 1, 0, 0]
    assert StrategySpec.from_json_dict({"bitsPerFeature": 7.0}).total == 7
    with pytest.raises(InvalidSchemaError):
        StrategySpec.from_json_dict({"k": 1})


def test_keys():
    # fixed values: test case 1 of RFC 5869
    okm = hkdf(bytes([0x0B] * 22), 1, salt=bytes(range(13)), info=bytes(range(0xF0, 0xFA)), key_size=42)[0]
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    keys = generate_key_lists("secret", 5)
    assert len(keys) == 5 and all(len(k) == 2 and len(k[0]) == 64 for k in keys) and len({x for k in keys for x in k}) == 10
    assert generate_key_lists(b"secret", 5) == keys
    assert generate_key_lists("secret", 2, kdf="legacy") == ((b"secret",) * 2,) * 2
    assert len(hkdf(b"x", 2, "SHA512", key_size=20)[1]) == 20
    for bad in (lambda: hkdf(b"x", 1, "MD5"), lambda: hkdf(b"x", 128), lambda: generate_key_lists("x", 1, 0), lambda: generate_key_lists("x", 1, kdf="other")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        generate_key_lists(5, 1)


SINGULAR_KEYS = (b"secret1", b"secret2")


def test_singularity():
    for token in (b"635", b"1402"):
        assert hashing.double_hash(token, 20, SINGULAR_KEYS, 1024).bit_count() == 1
        assert hashing.double_hash_non_singular(token, 20, SINGULAR_KEYS, 1024).bit_count() > 1
    for token in (b"666", b"1401"):
        assert hashing.double_hash(token, 20, SINGULAR_KEYS, 1024).bit_count() > 1
        assert hashing.double_hash(token, 20, SINGULAR_KEYS, 1024) == hashing.double_hash_non_singular(token, 20, SINGULAR_KEYS, 1024)


def test_blake():
    mask = hashing.blake_hash(b"tok", 40, (b"k" * 32,), 1024)
    shorts = b"".join(hashlib.blake2b(b"tok", key=b"k" * 32, salt=str(i).encode()).digest() for i in range(2))
    assert mask == hashing._mask({int.from_bytes(shorts[2 * i : 2 * i + 2], "little") % 1024 for i in range(40)}, 1024)
    for l in (1023, 1025):
        with pytest.raises(ValueError):
            hashing.kernel("blakeHash", None, l)
    with pytest.raises(ValueError):
        hashing.kernel("other", None, 1024)


@pytest.mark.parametrize("l,non_singular", [(1024, False), (1000, False), (16, True), (7, True)])
def test_double_hash_columns(spark, l, non_singular):
    rows = spark.createDataFrame([(f"t{i}é",) for i in range(60)], "t string")
    made = hashing.double_hash_column(F.col("t"), F.lit(6), SINGULAR_KEYS, l, non_singular)
    kernel = hashing.kernel("doubleHash", non_singular, l)
    for r in rows.select("t", made.alias("p")).collect():
        assert hashing._mask(r.p, l) == kernel(r.t.encode(), 6, SINGULAR_KEYS, l)
    assert rows.select(hashing.double_hash_column(F.col("t"), F.lit(0), SINGULAR_KEYS, l).alias("p")).first().p == []


def test_order_does_not_matter():
    keys = (b"a" * 32, b"b" * 32)
    one = hashing.encode_tokens(list("abcde"), [10] * 5, keys, 1024, "ascii", hashing.double_hash)
    assert one == hashing.encode_tokens(list("edcba"), [10] * 5, keys, 1024, "ascii", hashing.double_hash)
    assert 10 <= one.bit_count() <= 50


def test_fold():
    rng = random.Random(1)
    for length, folds in ((1024, 1), (1024, 3), (98, 1), (64, 6)):
        b = Bits.of(rng.getrandbits(length), length)
        out = bits.fold_xor(b, folds)
        assert out.length == length >> folds
        for j in range(out.length):
            assert out[j] == sum(b[p] for p in range(j, length, out.length)) % 2
    with pytest.raises(ValueError):
        bits.fold_xor(Bits.of(1, 49), 1)


def test_serialization():
    b = Bits.of(0b1011, 12)
    assert b.to01() == "000000001011" and b.count() == 3
    text = bits.serialize_bitarray(b)
    assert bits.deserialize_bitarray(text).length == 16 and bits.deserialize_bitarray(text).to01()[:12] == b.to01()


@pytest.mark.parametrize("length,folds", [(128, 0), (128, 1), (96, 1), (40, 0)])
def test_bit_columns(spark, length, folds):
    rng = random.Random(2)
    rows = [(i, sorted(rng.sample(range(length), rng.randint(0, 30)))) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, p array<long>")
    small = length >> folds
    folded = bits.fold_positions(F.col("p"), length, folds)
    out = df.select("p", bits.pack_positions(folded, small).alias("b"), bits.pack_positions(F.transform("p", lambda p: p % small), small, xor=True).alias("x")).select("*", bits.popcount(F.col("b")).alias("n"), bits.to_base64(F.col("b")).alias("t"))
    for r in out.collect():
        want = Bits.of(bits.fold_mask(hashing._mask(r.p, length), length, folds), small)
        assert bytes(r.b) == want.data == bytes(r.x) and r.n == want.count() and r.t == bits.serialize_bitarray(want)


def test_native_hash_is_never_singular(spark):
    """With one place every hash is 0, so all retries fail."""
    from pyspark.sql import functions as F

    from tessera.functions import hashing

    with pytest.raises(Exception, match="after all retries"):
        spark.createDataFrame([("t",)], "t string").select(hashing.double_hash_column(F.col("t"), F.lit(2), (b"a", b"b"), 1, True)).collect()

"""The rules of the three schema versions, as a small hand-written validator.

Rules are functions of a value and its path that yield what is wrong. Whole floats count as integers from version
2 on, as in the JSON-Schema draft of those versions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

Rule = Callable[[Any, str], Iterator[str]]

# The words that schemas may use.
ENCODINGS = ["ascii", "utf-8", "utf-16", "utf-32"]
CASES = ["upper", "lower", "mixed"]
KDF_HASHES = ["SHA256", "SHA512"]


def text(v: Any, at: str) -> Iterator[str]:
    if not isinstance(v, str):
        yield f"{at}: {v!r} is not a string"


def flag(v: Any, at: str) -> Iterator[str]:
    if not isinstance(v, bool):
        yield f"{at}: {v!r} is not true or false"


def number(minimum: float | None = None, above: float | None = None) -> Rule:
    def rule(v: Any, at: str) -> Iterator[str]:
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            yield f"{at}: {v!r} is not a number"
        elif minimum is not None and v < minimum:
            yield f"{at}: {v!r} is less than {minimum}"
        elif above is not None and v <= above:
            yield f"{at}: {v!r} is not more than {above}"

    return rule


def whole(minimum: int | None = None, floats: bool = True) -> Rule:
    def rule(v: Any, at: str) -> Iterator[str]:
        if isinstance(v, bool) or not (isinstance(v, int) or (floats and isinstance(v, float) and v.is_integer())):
            yield f"{at}: {v!r} is not an integer"
        elif minimum is not None and v < minimum:
            yield f"{at}: {v!r} is less than {minimum}"

    return rule


def choice(*allowed: Any) -> Rule:
    def rule(v: Any, at: str) -> Iterator[str]:
        if not any(v == a and type(v) is type(a) for a in allowed):
            yield f"{at}: {v!r} is not one of {list(allowed)}"

    return rule


def listed(each: Rule) -> Rule:
    def rule(v: Any, at: str) -> Iterator[str]:
        if not isinstance(v, list):
            yield f"{at}: {v!r} is not a list"
            return
        for i, x in enumerate(v):
            yield from each(x, f"{at}[{i}]")

    return rule


def fields(known: dict[str, Rule], required: tuple[str, ...] = (), closed: bool = False) -> Rule:
    def rule(v: Any, at: str) -> Iterator[str]:
        if not isinstance(v, dict):
            yield f"{at}: {v!r} is not an object"
            return
        for key in required:
            if key not in v:
                yield f"{at}: {key!r} is missing"
        for key, x in v.items():
            if key in known:
                yield from known[key](x, f"{at}.{key}")
            elif closed:
                yield f"{at}: {key!r} is not known"

    return rule


def exactly_one(*rules: Rule) -> Rule:
    def rule(v: Any, at: str) -> Iterator[str]:
        wrong = [list(r(v, at)) for r in rules]
        fitting = sum(not w for w in wrong)
        if fitting > 1:
            yield f"{at}: it fits {fitting} forms where one is allowed"
        elif not fitting:
            yield min(wrong, key=len)[0]

    return rule


def _formats(floats: bool) -> Rule:
    n = lambda least=None: whole(least, floats)
    typed = lambda name, known, required=(): fields({"type": choice(name), "description": text, **known}, ("type", *required), closed=True)
    return exactly_one(
        typed("string", {"encoding": choice(*ENCODINGS), "case": choice(*CASES), "minLength": n(0), "maxLength": n(1)}),
        typed("string", {"encoding": choice(*ENCODINGS), "pattern": text}, ("pattern",)),
        typed("integer", {"minimum": n(), "maximum": n()}),
        typed("date", {"format": text}, ("format",)),
        typed("enum", {"values": listed(text)}, ("values",)),
    )


def _hashes() -> Rule:
    return exactly_one(
        fields({"type": choice("doubleHash"), "prevent_singularity": flag}, ("type",)),
        fields({"type": choice("blakeHash")}, ("type",)),
    )


MISSING = fields({"sentinel": text, "replaceWith": text}, ("sentinel",))


def _kdf(floats: bool) -> Rule:
    return fields({"type": choice("HKDF"), "hash": choice(*KDF_HASHES), "salt": text, "info": text, "keySize": whole(1, floats)}, ("type",))


def _schema(config: Rule, hashing: Rule, floats: bool, closed_ignore: bool, feature_known: dict[str, Rule]) -> Rule:
    ignored = fields({"identifier": text, "ignored": choice(True), "description": text}, ("identifier", "ignored"), closed=closed_ignore)
    feature = fields({"identifier": text, "description": text, "format": _formats(floats), "hashing": hashing, **feature_known}, ("identifier", "format", "hashing"))
    return fields({"version": number(), "clkConfig": config, "features": listed(exactly_one(feature, ignored))}, ("version", "clkConfig", "features"))


def _v1() -> Rule:
    n = lambda least: whole(least, floats=False)
    config = fields({"l": n(1), "k": n(1), "xorFolds": n(0), "kdf": _kdf(False), "hash": _hashes()}, ("l", "k", "kdf", "hash"))
    hashing = fields({"ngram": n(0), "positional": flag, "weight": number(0), "missingValue": MISSING}, ("ngram",))
    return _schema(config, hashing, False, False, {})


def _v2() -> Rule:
    config = fields({"l": whole(1), "kdf": _kdf(True), "xorFolds": whole(0)}, ("l", "kdf"))
    # the size of a strategy's count is not checked in this version, but it is after conversion
    strategy = exactly_one(fields({}, ("numBits",)), fields({}, ("k",)))
    hashing = fields({"hash": _hashes(), "strategy": strategy, "ngram": whole(1), "positional": flag, "missingValue": MISSING}, ("ngram", "strategy"), closed=True)
    return _schema(config, hashing, True, False, {})


def _v3() -> Rule:
    config = fields({"l": whole(1), "kdf": _kdf(True), "xorFolds": whole(0)}, ("l", "kdf"))
    strategy = exactly_one(*[fields({name: whole(1)}, (name,), closed=True) for name in ("bitsPerToken", "bitsPerFeature")])
    comparison = exactly_one(
        fields({"type": choice("ngram"), "n": whole(1), "positional": flag}, ("type", "n")),
        fields({"type": choice("exact")}, ("type",)),
        fields({"type": choice("numeric"), "thresholdDistance": number(above=0), "resolution": whole(1), "fractional_precision": whole(0)}, ("type", "thresholdDistance", "resolution")),
    )
    hashing = fields({"hash": _hashes(), "strategy": strategy, "comparison": comparison, "missingValue": MISSING}, ("comparison", "strategy"), closed=True)
    return _schema(config, hashing, True, True, {"ignored": flag})


#: The rule sets by version.
RULES: dict[int, Rule] = {1: _v1(), 2: _v2(), 3: _v3()}

"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rolled) by its place. A text bundles (adds) the vectors of its n-grams,
a language the n-grams of its learning texts, and a text gets the language whose prototype has the
largest cosine with it. All but letters count as one blank; A-Z and other letters are lower-cased.

Learning sends one vector for each language and input partition, whatever the number of documents.

Defined results. Null texts and texts without a letter are ``und`` with score 0. Ties go to the smaller
language. Without any learning text every document with a letter is ``und``. Repeated rows each get their
result. Texts are counted together up to ``PIECE`` characters, and longer ones in pieces of that size that overlap by
two letters, so memory grows with neither the texts nor their number beyond their own bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, small_batches

DIMENSIONS = 1024
#: Documents, and characters of them, whose n-gram counts stand in memory together.
ROWS, PIECE = 200, 1 << 20


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            table[c] = ord(low) if len(low := s.lower()) == 1 else c
    return table


@lru_cache(65536)
def _letter(code: int, dims: int) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=code))
    return (rng.integers(0, 2, dims, dtype=np.int8) * 2 - 1).astype(np.float32)


def gram_vectors(grams: np.ndarray, dims: int) -> np.ndarray:
    """One row for each row of three folded letters."""
    letters, inverse = np.unique(grams, return_inverse=True)
    inverse = inverse.reshape(grams.shape)
    base = np.stack([_letter(int(c), dims) for c in letters])
    return np.roll(base, 2, 1)[inverse[:, 0]] * np.roll(base, 1, 1)[inverse[:, 1]] * base[inverse[:, 2]]


def chains(text: str | None) -> Iterator[np.ndarray]:
    """The folded letters of a text between blanks, runs of blanks as one, in pieces; each goes on from the last two of the one before."""
    text, last = text or "", np.zeros(1, np.int32)
    for i in range(0, len(text), PIECE):
        p = _folded()[np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        p = np.concatenate([last, p, [0]] if i + PIECE >= len(text) else [last, p])
        p = p[np.concatenate([[True], (p[1:] != 0) | (p[:-1] != 0)])]
        if p.any():
            yield p
        last = p[-2:]


def groups(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains of several texts, one after the other, and the text of each symbol: at most ``ROWS`` chains, one of a text, and about ``PIECE`` symbols at a time."""
    parts: list[np.ndarray] = []
    owners: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for p in chains(t):
            if parts and (len(parts) == ROWS or size + len(p) > PIECE or owners[-1] == i):
                yield np.concatenate(parts), np.repeat(owners, [len(x) for x in parts])
                parts, owners, size = [], [], 0
            parts.append(p)
            owners.append(i)
            size += len(p)
    if parts:
        yield np.concatenate(parts), np.repeat(owners, [len(x) for x in parts])


def counts(chain: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram counts of the texts in a group: (texts x trigrams) float32, the trigrams as rows of letters, and which texts they are."""
    rows, owner = np.unique(owner, return_inverse=True)
    if len(chain) < 3:
        return np.zeros((len(rows), 0), np.float32), np.zeros((0, 3), np.int64), rows
    letters = np.flatnonzero(np.bincount(chain, minlength=1))
    small = np.searchsorted(letters, chain).astype(np.int64)
    k = len(letters)
    code = (small[:-2] * k + small[1:-1]) * k + small[2:]
    same = owner[:-2] == owner[2:]
    code, owner = code[same], owner[:-2][same]
    if k**3 <= 1 << 22:
        seen = np.zeros(k**3, bool)
        seen[code] = True
        grams = np.flatnonzero(seen)
        place = np.zeros(k**3, np.int64)
        place[grams] = np.arange(len(grams))
        column = place[code]
    else:
        grams, column = np.unique(code, return_inverse=True)
    m = len(grams)
    table = np.bincount(owner.astype(np.int64) * m + column, minlength=len(rows) * m).reshape(len(rows), m).astype(np.float32)
    return table, letters[np.stack([grams // (k * k), grams // k % k, grams % k], 1)], rows


def _bundles(texts: list[str | None], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """A bundle for each text, and which texts have a letter."""
    out, has = np.zeros((len(texts), dims), np.float32), np.zeros(len(texts), bool)
    for group in groups(texts):
        table, grams, rows = counts(*group)
        has[rows] = True
        for i in range(0, len(grams), 8192):  # memory stays bounded for many kinds of letters
            out[rows] += table[:, i : i + 8192] @ gram_vectors(grams[i : i + 8192], dims)
    return out, has


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMENSIONS) -> dict[str, list[float]]:
    """A prototype for each language: the sum of its texts' bundles, in whole numbers, so that reruns agree."""
    small_batches(docs.sparkSession)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, of in batch.groupby("lang", sort=False):
                for group in groups(of["text"].tolist()):
                    table, grams, _ = counts(*group)
                    sums = total.setdefault(name, np.zeros(dims))
                    for j in range(0, len(grams), 8192):
                        sums += table[:, j : j + 8192].sum(0, dtype=np.float64) @ gram_vectors(grams[j : j + 8192], dims).astype(np.float64)
        if total:
            yield pd.DataFrame({"lang": list(total), "vector": [v.tolist() for v in total.values()]})

    parts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    parts = parts.mapInPandas(partial, "lang string, vector array<double>")
    at = parts.select("lang", F.posexplode("vector").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out: dict[str, list[float]] = {}
    for r in at.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).collect():  # dims numbers a language
        if any(x.v for x in r.v):
            out[r.lang] = [x.v for x in r.v]
    return dict(sorted(out.items()))


def identify(docs: DataFrame, prototypes: dict[str, list[float]], text: str = "text", dims: int = DIMENSIONS, prefix: str = "") -> DataFrame:
    """Adds lang_pred and score (cosine, negatives as 0) to every row; other columns are kept unless so named."""
    small_batches(docs.sparkSession)
    names, labels = [f"{prefix}lang_pred", f"{prefix}score"], list(prototypes)
    matrix = np.array([prototypes[k] for k in labels], np.float64).reshape(len(labels), dims)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    kept = [c for c in docs.columns if c not in names]
    where = kept.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, scores = batch.column(where).to_pylist(), [], []
            for i in range(0, len(texts), ROWS):
                bundles, has = _bundles(texts[i : i + ROWS], dims)
                if not labels:
                    found += ["und"] * len(has)
                    scores += [0.0] * len(has)
                    continue
                norm = np.linalg.norm(bundles.astype(np.float64), axis=1)
                cos = bundles.astype(np.float64) @ matrix.T / np.maximum(norm, 1e-300)[:, None]
                best = cos.argmax(1)
                found += [labels[b] if h else "und" for b, h in zip(best, has, strict=True)]
                scores += [min(1.0, max(0.0, float(c[b]))) if h else 0.0 for c, b, h in zip(cos, best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names])

    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    return map_rows(frame, predict, f"{names[0]} string, {names[1]} double")


def language_id(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", dims: int = DIMENSIONS) -> DataFrame:
    """Learns from rows that are not held out and have a language, and predicts every row."""
    return identify(docs, learn(docs.where(~held_out), text, lang, dims), text, dims)

"""Language-model scores by context-tree weighting over bytes.

A text is lower-cased (A-Z), its words are joined by one blank, and one end symbol follows. Each byte is
eight binary decisions; each decision has its own context tree over the up to ``DEPTH`` bytes before it. A
node's estimate is Krichevsky-Trofimov's; its weighted probability is half its own estimate and half the
product of its children's, so all depths are mixed by how well they explain the learning texts. Scoring
walks from the root: at each node the share won by its own estimate is used, and the rest goes deeper. A
decision never seen in a deeper context takes the deepest estimate there is.

Nothing of the model is broadcast but its first two levels (at most 65,536 nodes). Documents are dealt to blocks of
about ``BLOCK_BYTES``. Each block states its distinct grams (context and byte) and words with their learning
counts, dealt to shards; a shard of the counts is a subtree of every context tree, so it is weighted by
itself. Each block's grams and words are then answered by the shards and joined to its texts. What moves is
one entry for each distinct gram or word of a block, packed; how much there is grows with the corpus.

Defined results. Null texts count as empty: one token, the end. Repeated rows are learned from and scored
each. Without learning texts every decision has probability 1/2. An empty table gives an empty result. Texts
come in small batches, and grams are counted in slices of them, also within a very long text; of a block a task
holds its distinct grams and words, and when it scores its texts once more. Words stay in Arrow's memory.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby, tee
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, fresh, saved, small_batches

DEPTH = 5
END = 0x0A
BLOCK_BYTES = 24 << 20
#: Bytes of text whose grams are counted at a time; they take some thirty times their size.
SLICE_BYTES = 2 << 20
#: Symbols whose contexts are put together at a time.
STRETCH = 1 << 16
MAX_SHARDS = 512
#: Blocks whose counts are merged in one task before shards are put together.
MERGED = 64
#: So many entries at least wait until they are merged into a block's counts.
WAITING = 1 << 19

Counts = tuple[np.ndarray, np.ndarray]


# ---- grams ---------------------------------------------------------------------------------------------


_PLAIN = bytes.maketrans(b"\t\n\v\f\r" + UPPER.encode(), b"     " + LOWER.encode())


def body(text: bytes | None) -> bytes:
    plain = (text or b"").translate(_PLAIN)
    while b"  " in plain:
        plain = plain.replace(b"  ", b" ")
    return plain.strip(b" ")


def _keys(padded: bytes, at: np.ndarray | None = None) -> np.ndarray:
    """Symbols that have a whole context before them, each with it; of all, or those marked by ``at``. Worked out in short stretches."""
    raw = np.frombuffer(padded, np.uint8)
    n = len(raw) - DEPTH
    out, done = np.empty(n if at is None else np.count_nonzero(at), np.uint64), 0
    for start in range(0, n, STRETCH):
        stop = min(start + STRETCH, n)
        key = raw[start + DEPTH : stop + DEPTH].astype(np.uint64)
        for back in range(1, DEPTH + 1):
            key |= raw[start + DEPTH - back : stop + DEPTH - back].astype(np.uint64) << np.uint64(8 * (DEPTH - back + 1))
        key = key if at is None else key[at[start:stop]]
        out[done : done + len(key)] = key
        done += len(key)
    return out


def grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with its context, nearest byte first, as whole numbers; and how many each text has (its bytes and the end)."""
    pad = bytes([END]) * DEPTH
    sizes = np.array([len(b) + 1 for b in bodies], np.int64)
    padded = pad + (bytes([END]) + pad).join(bodies) + bytes([END])
    if len(bodies) == 1:
        return _keys(padded), sizes
    first = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    at = np.ones(len(padded) - DEPTH, bool)
    for start in first[1:]:
        at[start - DEPTH : start] = False
    return _keys(padded, at), sizes


def gram_slices(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """``grams`` of the texts; one longer than a slice comes in parts, and from its second on they say that they go on with it."""
    for long, some in groupby(bodies, lambda b: len(b) > SLICE_BYTES):
        if not long:
            yield (*grams(list(some)), False)
            continue
        for b in some:
            padded = bytes([END]) * DEPTH + b + bytes([END])
            for start in range(0, len(b) + 1, SLICE_BYTES):
                key = _keys(padded[start : start + SLICE_BYTES + DEPTH])
                yield key, np.array([len(key)], np.int64), start > 0


def runs(key: np.ndarray, weight: np.ndarray | None = None) -> Counts:
    """Distinct keys in order and the sums of their weights (1 by default); without weights the keys given are sorted where they lie."""
    if not len(key):
        return key.astype(np.uint64), np.zeros(0, np.int64)
    if weight is None:
        key.sort()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[start], np.diff(np.append(start, len(key)))
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start], np.add.reduceat(weight[order], start)


def merged(parts: Iterable[Counts]) -> Counts:
    parts = list(parts)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return runs(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


class Tally:
    """Sums of entries that come in parts; they are merged when half as many wait as there are, and ``WAITING`` at least."""

    def __init__(self, merge: Any, none: Any) -> None:
        self.merge, self.parts, self.waiting = merge, [(none, np.zeros(0, np.int64))], 0

    def add(self, keys: Any, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(counts)
        if self.waiting > max(WAITING, len(self.parts[0][1]) // 2):
            self.total()

    def total(self) -> tuple[Any, np.ndarray]:
        self.parts, self.waiting = [self.merge(self.parts)], 0
        return self.parts[0]


def slices(texts: Iterable[tuple[bytes, bool]]) -> Iterator[list[tuple[bytes, bool]]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t[0])
        if size >= SLICE_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


# ---- words ---------------------------------------------------------------------------------------------

WORD = pa.large_binary()


def words_of(bodies: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts in their order, and how many each text has."""
    raw = np.frombuffer(b" ".join(filter(None, bodies)), np.uint8)
    blank = raw == 0x20
    sizes = np.array([b.count(b" ") + 1 if b else 0 for b in bodies], np.int64)
    if not len(raw):
        return pa.array([], WORD), sizes
    ends = np.append(np.flatnonzero(blank), len(raw))
    at = np.concatenate([[0], ends - np.arange(len(ends))])
    return pa.Array.from_buffers(WORD, len(ends), [None, pa.py_buffer(at), pa.py_buffer(raw[~blank])]), sizes


def word_runs(words: pa.Array, weight: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and the sums of their weights (1 by default)."""
    coded = words.dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), weight, len(coded.dictionary)).astype(np.int64)


def merged_words(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    return word_runs(pa.concat_arrays([w for w, _ in parts]), np.concatenate([n for _, n in parts]))


def word_shard(words: pa.Array, n: int) -> np.ndarray:
    out = np.empty(len(words), np.int64)
    for at in range(0, len(words), 1 << 15):
        out[at : at + (1 << 15)] = [zlib.crc32(w) % n for w in words[at : at + (1 << 15)].to_pylist()]
    return out


def gram_shard(key: np.ndarray, n: int) -> np.ndarray:
    """By the two nearest bytes: all deeper nodes of a context tree lie in one shard."""
    return ((key >> np.uint64(8 * (DEPTH - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(n)


# ---- packing -------------------------------------------------------------------------------------------


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers or floats as bytes by place, compressed; rising ones by their steps."""
    if rising and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, kind: Any, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if rising else values


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpack_words(raw: bytes) -> list[bytes]:
    text = zstandard.ZstdDecompressor().decompress(raw)
    return text.split(b"\n") if text else []


# ---- the tree ------------------------------------------------------------------------------------------

_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(4096) + 0.5))]) + math.log(math.pi) / 2


def _lgamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series, for z of some hundreds and more."""
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    return np.where(n < 4096, _SMALL[np.minimum(n, 4096)], _lgamma(np.maximum(n, 1000) + 0.5))


_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097)))])


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov's probability of n0 zeros and n1 ones, as natural logarithm."""
    n = n0 + n1
    whole = np.where(n < 4096, _WHOLE[np.minimum(n, 4096)], _lgamma(np.maximum(n, 1000) + 1.0))
    return _lgamma_half(n0) + _lgamma_half(n1) - math.log(math.pi) - whole


class Level:
    """The nodes of one depth: key = context bytes, then the binary node (1 to 255) of the byte."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None) -> None:
        self.key, self.n0, self.n1 = key, n0, n1
        own = log_kt(n0, n1)
        if below is None:
            self.weighted, self.stop = own, np.ones(len(key))
        else:
            children = np.bincount(np.searchsorted(key, below[0]), weights=below[1], minlength=len(key)) if len(key) else np.zeros(0)
            self.weighted = np.logaddexp(own, children) - math.log(2)
            self.stop = np.exp(own - math.log(2) - self.weighted)

    def up(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node its parent's key and its weighted probability."""
        return (self.key >> np.uint64(16) << np.uint64(8)) | (self.key & np.uint64(255)), self.weighted

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which nodes there are, the estimate of a one, and the share that stops here."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.full(len(key), 0.5), np.ones(len(key))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key, (self.n1[at] + 0.5) / (self.n0[at] + self.n1[at] + 1.0), self.stop[at]


def node_counts(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, zeros, ones = [], [], []
    for j in range(8):
        bit = (symbol >> np.uint64(7 - j)) & np.uint64(1)
        keys.append((context << np.uint64(8)) | np.uint64(1 << j) | (symbol >> np.uint64(8 - j)))
        ones.append(np.where(bit == 1, count, 0))
        zeros.append(np.where(bit == 0, count, 0))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    n0 = np.bincount(place, np.concatenate(zeros), len(key)).astype(np.int64)
    return key, n0, np.bincount(place, np.concatenate(ones), len(key)).astype(np.int64)


def deep_levels(key: np.ndarray, count: np.ndarray) -> dict[int, Level]:
    """Depths ``DEPTH`` down to 2 of one shard."""
    levels, below = {}, None
    for d in range(DEPTH, 1, -1):
        context = key >> np.uint64(8 * (DEPTH - d + 1))
        short, n = (key, count) if d == DEPTH else runs((context << np.uint64(8)) | (key & np.uint64(255)), count)
        levels[d] = Level(*node_counts(short >> np.uint64(8), short & np.uint64(255), n), below)
        below = levels[d].up()
    return levels


def code(key: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of each gram's symbol in its context."""
    out = np.zeros(len(key))
    symbol = key & np.uint64(255)
    for j in range(8):
        node = np.uint64(1 << j) | (symbol >> np.uint64(8 - j))
        one = ((symbol >> np.uint64(7 - j)) & np.uint64(1)) == 1
        mixed, left, last, alive = np.zeros(len(key)), np.ones(len(key)), np.full(len(key), 0.5), np.ones(len(key), bool)
        for d in range(DEPTH + 1):
            context = key >> np.uint64(8 * (DEPTH - d + 1))
            there, p, stop = levels[d].look((context << np.uint64(8)) | node)
            alive &= there
            p = np.where(one, p, 1 - p)
            mixed += np.where(alive, left * stop * p, 0)
            left = np.where(alive, left * (1 - stop), left)
            last = np.where(alive, p, last)
        out += np.log10(mixed + left * last)
    return out


# ---- the jobs ------------------------------------------------------------------------------------------

PACKED = "kind int, shard int, block int, keys binary, counts binary"
PACKED_TYPES = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _state(block: int, texts: Iterable[bytes | None], learn: Iterable[bool], shards: int) -> pa.Table:
    """A block's distinct grams (kind 0) and words (kind 1) by shard, with their counts in learning texts."""
    every, spoken = Tally(merged, np.zeros(0, np.uint64)), Tally(merged_words, pa.array([], WORD))
    for some in slices((body(t), l) for t, l in zip(texts, learn, strict=True)):
        for used in (True, False):
            own = [b for b, l in some if l == used]
            for key, _, _ in gram_slices(own):
                key, n = runs(key)
                every.add(key, n if used else np.zeros(len(n), np.int64))
            words, n = word_runs(words_of(own)[0])
            spoken.add(words, n if used else np.zeros(len(n), np.int64))
    rows = []
    key, n = every.total()
    shard = gram_shard(key, shards)
    for s in np.unique(shard):
        of = shard == s
        rows.append((0, int(s), block, pack(key[of], True), pack(n[of])))
    words, n = spoken.total()
    order = pc.array_sort_indices(words)
    words, n = words.take(order), n[order.to_numpy()]
    shard = word_shard(words, shards)
    for s in np.unique(shard):
        of = np.flatnonzero(shard == s)
        rows.append((1, int(s), block, pack_words(words.take(pa.array(of)).to_pylist()), pack(n[of])))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKED_TYPES.types, strict=True)], schema=PACKED_TYPES)


def _scores(texts: Iterable[bytes | None], answers: pa.Table) -> pd.DataFrame:
    """For each text its words, those known, the sum of their logarithms, the model's score and its symbols (bytes and end)."""
    keys, values = [np.zeros(0, np.uint64)], [np.zeros(0)]
    words, logs = [pa.array([], WORD)], [np.zeros(0)]
    for kind, k, c in zip(*(answers[x] for x in ("kind", "keys", "counts")), strict=True):
        k, c = k.as_py(), c.as_py()
        if kind.as_py() == 0:
            keys.append(unpack(k, np.uint64, True))
            values.append(unpack(c, np.float64))
        else:
            words.append(pa.array(unpack_words(k), WORD))
            logs.append(np.log10(unpack(c, np.int64) + 0.5))
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key)
    key, value = key[order], value[order]
    spoken, log = pa.concat_arrays(words), np.concatenate(logs)
    del keys, values, words, logs, order
    unseen = np.log10(np.zeros(1) + 0.5)[0]
    out: list[tuple[int, int, float, float, int]] = []
    for some in slices((body(t), True) for t in texts):
        bodies = [b for b, _ in some]
        own, counts = words_of(bodies)
        found = log[pc.index_in(own, value_set=spoken).to_numpy()]
        scores: list[float] = []
        for ranked, sizes, goes_on in gram_slices(bodies):
            order = np.argsort(ranked)
            ranked = ranked[order]
            start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            ranked = ranked[start]
            each = np.empty(len(order))
            each[order] = np.repeat(value[np.searchsorted(key, ranked)], np.diff(np.append(start, len(order))))
            sums = np.add.reduceat(each, np.cumsum(sizes) - sizes).tolist()
            if goes_on:
                scores[-1] += sums[0]
            else:
                scores += sums
        at = 0
        for b, n, score in zip(bodies, counts.tolist(), scores, strict=True):
            of = found[at : at + n]
            out.append((n, n - int(np.count_nonzero(of == unseen)), math.fsum(of.tolist()), score, len(b) + 1))
            at += n
    return pd.DataFrame(out, columns=["words", "known", "base", "score", "symbols"])


def _merge(kind: int, keys: Iterable[bytes], counts: Iterable[bytes]) -> tuple[bytes, bytes, int, int]:
    """Entries that occur in learning texts, packed; how many there are and their sum."""
    if kind == 0:
        key, n = merged((unpack(k, np.uint64, True), unpack(c, np.int64)) for k, c in zip(keys, counts, strict=True))
        key, n = key[n > 0], n[n > 0]
        return pack(key, True), pack(n), len(n), int(n.sum())
    total: dict[bytes, int] = {}
    for k, c in zip(keys, counts, strict=True):
        for w, n in zip(unpack_words(k), unpack(c, np.int64).tolist(), strict=True):
            if n:
                total[w] = total.get(w, 0) + n
    words = sorted(total)
    return pack_words(words), pack(np.array([total[w] for w in words], np.int64)), len(words), sum(total.values())


def ctw_scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row.

    Learns from rows that are not held out. score is log10 of the model's probability; bits_per_byte its code length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    blocks = max(1, -(-int(size[0] or 0) // BLOCK_BYTES), -(-size[1] // 50_000))
    shards = min(MAX_SHARDS, 2 * blocks)
    named = {c: fresh(docs, c) for c in ("_block", "_held", "_body")}
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), F.lit(blocks)).cast("int").alias(named["_block"]),
        F.col(doc_id), held_out.alias(named["_held"]), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(named["_body"]),
    ).toDF("block", "id", "held", "body")

    def state(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = tee((t.as_py(), h.as_py()) for batch in batches for t, h in zip(batch["body"], batch["held"], strict=True))
        yield from _state(key[0].as_py(), (t for t, _ in texts), (not h for _, h in held), shards).to_batches()

    stated = saved(dealt.select("block", "held", "body").groupBy("block").applyInArrow(state, PACKED))

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k, c, types, total = _merge(int(key[0]), rows["keys"], rows["counts"])
        return pd.DataFrame({"kind": [key[0]], "shard": [key[1]], "block": [-1], "keys": [k], "counts": [c], "types": [types], "total": [total]})

    model, left = stated, blocks
    while left > MERGED:
        left = -(-left // MERGED)
        model = model.groupBy("kind", "shard", F.pmod("block", F.lit(left)).alias("part")).applyInPandas(lambda key, rows: merge(key, rows).assign(block=key[2]), PACKED + ", types long, total long").select("kind", "shard", "block", "keys", "counts")
    model = saved(model.groupBy("kind", "shard").applyInPandas(merge, PACKED + ", types long, total long"))
    words = model.where("kind = 1").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    learned = dealt.where(~F.col("held")).count()
    n_all, n_types = int(words[1]) + learned, int(words[0]) + (learned > 0)

    def shallow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, c in zip(batch["keys"], batch["counts"], strict=True):
                key, n = unpack(k, np.uint64, True), unpack(c, np.int64)
                two = deep_levels(key, n)[2]
                parent, weighted = two.up()
                at, place = np.unique(parent, return_inverse=True)
                sums = [np.bincount(place, v, len(at)) for v in (two.n0, two.n1, weighted)]
                yield pd.DataFrame({"node": at.astype(np.int64), "n0": sums[0].astype(np.int64), "n1": sums[1].astype(np.int64), "w": sums[2]})

    # At most 256 contexts of one byte with 255 nodes each.
    top = model.where("kind = 0").select("keys", "counts").mapInPandas(shallow, "node long, n0 long, n1 long, w double").groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("w")).orderBy("node").collect()
    key = np.array([r[0] for r in top], np.uint64)
    n0, n1 = (np.array([r[i] for r in top], np.int64) for i in (1, 2))
    one = Level(key, n0, n1, (key, np.array([r[3] for r in top], np.float64)))
    nodes, place = np.unique(key & np.uint64(255), return_inverse=True)
    root = Level(nodes, np.bincount(place, n0, len(nodes)).astype(np.int64), np.bincount(place, n1, len(nodes)).astype(np.int64), one.up()) if len(key) else Level(key, n0, n1, None)
    sent = spark.sparkContext.broadcast({0: root, 1: one})

    salts = -(-blocks // MERGED)
    asked = stated.select("kind", "shard", F.pmod("block", F.lit(salts)).alias("salt"), "block", "keys")
    known = model.select("kind", "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "keys", "counts")

    def answer(key: tuple, ask: pd.DataFrame, know: pd.DataFrame) -> pd.DataFrame:
        out = []
        if key[0] == 0:
            have = merged((unpack(k, np.uint64, True), unpack(c, np.int64)) for k, c in zip(know["keys"], know["counts"], strict=True))
            asked = [unpack(k, np.uint64, True) for k in ask["keys"]]
            every = runs(np.concatenate(asked))[0] if asked else np.zeros(0, np.uint64)
            values = code(every, {**deep_levels(*have), **sent.value})
            out = [pack(values[np.searchsorted(every, k)]) for k in asked]
        else:
            count: dict[bytes, int] = {}
            for k, c in zip(know["keys"], know["counts"], strict=True):
                count.update(zip(unpack_words(k), unpack(c, np.int64).tolist(), strict=True))
            out = [pack(np.array([count.get(w, 0) for w in unpack_words(k)], np.int64)) for k in ask["keys"]]
        return pd.DataFrame({"kind": key[0], "block": ask["block"], "keys": ask["keys"], "counts": out})

    by = ["kind", "shard", "salt"]
    answered = asked.groupBy(by).cogroup(known.groupBy(by)).applyInPandas(answer, "kind int, block int, keys binary, counts binary")
    less = math.log10(n_all + 0.5 * (n_types + 1))

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        end = math.log10(learned + 0.5)
        of = _scores((t.as_py() for t in rows["body"]), answers)
        tokens = of["words"].to_numpy() + 1
        n_bytes, total = of["symbols"].to_numpy(), of["score"].to_numpy()
        columns = {
            "id": rows["id"], "held_out": rows["held"], "n_tokens": tokens, "n_known": of["known"].to_numpy() + (learned > 0), "train_tokens": np.full(len(of), n_all),
            "base_score": of["base"].to_numpy() + end - tokens * less, "score": total, "n_bytes": n_bytes, "bits_per_byte": -total / math.log10(2) / n_bytes,
        }
        return pa.table(columns)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, schema).withColumnRenamed("id", doc_id)

"""N-gram Jaccard join by parity sketches.

A text's set holds the hashes of its distinct shingles. A parity sketch flips one bit for each element, so the
Hamming distance of two sketches is at most the size of the sets' symmetric difference, and sets
with Jaccard similarity of at least t differ in at most T = (1 - t) / (1 + t) * (size + size) elements.

Candidates. Sizes fall in bands that grow by 1 / t; linked texts lie in one band or in two neighbours, and each
text takes part in the join of its own band and of the next one. There its (very wide) sketch is cut in B > T
blocks. At least B - T blocks of linked texts are equal, so by the prefix principle they share one of
their first T + 1 blocks in any fixed order; empty blocks come last in it. A block is keyed by the
XOR of its elements' hashes, which is the hash of its parity bits. Nothing is lost.

Groups. Texts with equal sets are one set id from the start, and a stretch of input gives each set's keys once. Small groups
of one key give all their pairs. A key that is common in one stretch is told apart there, and its members go by tasks of
their own, so no task gets all sets of a common key. In large groups each member is paired with a hub only, the
member nearest to the majority of their sketches, and that in its largest group. Candidate pairs are dropped by the
Hamming distance of their narrow sketches, and the rest is verified on whole texts: they are fetched once, for the sets
that have a candidate, and sent once to each call, which verifies the pairs of a neighbourhood and leaves out those that
its own links have joined by then. Where a large group still has several components after that, its members'
sketches are compared in blocks, each pair under one common key or few: each component gives its nearest pairs to others,
within the distance, and more of them in each round until all are linked or refuted. So copies in any number cost
a few pairs each, and no link is lost.

Set ids are 64-bit hashes; two different sets share one with probability n**2 / 2**65.

Defined results. Texts without words (null, empty, blank) have the empty set and link with nothing. Null ids are
a component of their own unless linked. Repeated rows get equal results. An empty table gives an empty
result. Long texts are hashed as whole arrays of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import buffers, dropped, release, saved, small_batches, word_starts, word_table

WORDS, THRESHOLD = 5, Fraction(4, 5)
#: Blocks for each difference that is allowed; more than one leaves room to put empty blocks last.
ROOM = 1.25
#: Groups of one key up to this size give all their pairs.
SMALL_GROUP = 16
#: Members of a large group that are compared with as many others in one task; shingles of the pairs verified in one call.
GROUP_BLOCK, CALL_SHINGLES = 1024, 1 << 20
#: Smaller keys of a member that tell whether a pair is compared under one of them.
EARLIER = 3
#: Pairs that a component gives in the first round over large groups; eight times as many in each further one.
NEAREST = 16
#: Text bytes for each shard of candidate keys, and of a stretch of input in which each set's keys are made once.
SHARD_BYTES, STRETCH_BYTES = 24 << 20, 4 << 20
#: Sets and texts are found by a broadcast of their ids only where these are counted to be at most so many.
BROADCAST_ROWS = 500_000
U = np.uint64


# ---- sets ----------------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd factors, so it loses nothing."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


_rng = np.random.Generator(np.random.Philox(key=11))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_BASE), -1, 1 << 64))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every blank-separated word, A-Z lower-cased, and n + 1 offsets of the texts' words."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = word_table("blank")[low]
    starts = word_starts(inside, at)
    begin = np.flatnonzero(starts)
    words_at = np.searchsorted(begin, at)
    if not len(begin):
        return np.zeros(0, np.uint64), words_at
    ends = np.empty(len(low) + 1, bool)
    ends[:-1] = ~inside | starts
    ends[-1] = True
    stops = np.flatnonzero(ends)
    stop = stops[np.searchsorted(stops, begin, "right")]
    out = np.empty(len(begin), np.uint64)
    step = 1 << 20  # powers are made for a stretch of bytes at a time, from each stretch's first word
    first = 0
    while first < len(begin):
        last = max(first + 1, int(np.searchsorted(begin, begin[first] + step)))
        a, b = begin[first], stop[last - 1]
        power = np.full(b - a, _BASE)
        back = np.full(b - a, _BACK)
        power[0] = back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(back, out=back)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[low[a:b]] * power, out=total[1:])
        x, y = begin[first:last] - a, stop[first:last] - a
        out[first:last] = mix((total[y] - total[x]) * back[x] + (y - x).astype(np.uint64) * U(0xA0761D6478BD642F))
        first = last
    return out, words_at


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and n + 1 offsets."""
    h, w = word_hashes(data, at)
    n = np.diff(w)
    k = max(0, len(h) - words + 1)
    rolled = np.zeros(k, np.uint64)
    for i in range(words):
        rolled = rolled * U(0xE7037ED1A0B428DB) + h[i : i + k]
    rolled = mix(rolled + U(words))
    sets: list[np.ndarray] = []
    for i in range(len(n)):
        if n[i] >= words:
            sets.append(np.unique(rolled[w[i] : w[i + 1] - words + 1]))
        elif n[i]:
            one = U(0)
            with np.errstate(over="ignore"):
                for x in h[w[i] : w[i + 1]]:
                    one = one * U(0xE7037ED1A0B428DB) + x
            sets.append(mix(np.array([one], np.uint64) + U(int(n[i]))))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def reduced(op: np.ufunc, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """op over each stretch; 0 for empty ones."""
    out = np.zeros(len(at) - 1, values.dtype)
    full = at[:-1] < at[1:]
    if full.any():
        out[full] = op.reduceat(values, at[:-1][full])
    return out


def set_ids(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, as signed whole numbers; it also depends on the size."""
    with np.errstate(over="ignore"):
        one = reduced(np.add, mix(hashes ^ U(0x8EBC6AF09C88C6E3)), at)
        two = reduced(np.bitwise_xor, mix(hashes ^ U(0x589965CC75374CC3)), at)
        return mix(mix(one) + two * U(0x1D8E4E27C47D124F) + np.diff(at).astype(np.uint64)).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """Parity bits: a power of two of them, at least twice the size."""
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes: position h modulo a smaller power of two is what folding gives."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, size), 0)


def differ(sizes: int, t: Fraction = THRESHOLD) -> int:
    """The most elements in which two sets of so many elements together may differ."""
    return int((1 - t) * sizes / (1 + t))


def near(a: bytes, b: bytes, sizes: int, t: Fraction) -> bool:
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()) <= differ(sizes, t)


def bands(t: Fraction) -> np.ndarray:
    """Largest size of each band, up to 2**40."""
    tops, top = [1], 1
    while top < 1 << 40:
        top = max(top + 1, int(top / t))
        tops.append(top)
    return np.array(tops, np.int64)


def block_keys(hashes: np.ndarray, at: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which each set is joined, and the set (by place) of each."""
    tops, sizes = bands(t), np.diff(at)
    keys, owners = [], []
    band = np.searchsorted(tops, sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    for up in (0, 1):
        top = tops[np.minimum(band + up, len(tops) - 1)]
        allowed = ((t.denominator - t.numerator) * 2 * top) // (t.denominator + t.numerator)
        blocks = (allowed * ROOM).astype(np.int64) + 1
        blocks = np.maximum(blocks, allowed + 1)
        first = np.concatenate([[0], np.cumsum(np.where(sizes > 0, blocks, 0))])
        place = first[of] + ((hashes >> U(20)) % blocks.astype(np.uint64)[of]).astype(np.int64)
        order = np.argsort(place)
        placed, value = place[order], hashes[order]
        start = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]])) if len(placed) else np.zeros(0, np.int64)
        parity = np.zeros(first[-1], np.uint64)
        if len(start):
            parity[placed[start]] = np.bitwise_xor.reduceat(value, start)
        owner = np.repeat(np.arange(len(sizes)), np.where(sizes > 0, blocks, 0))
        index = (np.arange(len(parity)) - first[owner]).astype(np.uint64)
        name = mix(parity ^ mix((index << U(8)) ^ U(0x2D358DCCAA6C78A5) * ((band + up).astype(np.uint64)[owner] + U(1))))
        # first T + 1 blocks: those that are not empty by their key, then the empty ones
        rank = np.argsort((parity == 0).astype(np.int64) * (1 << 62) + (name >> U(2)).astype(np.int64))
        rank = rank[np.argsort(owner[rank], kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])[:-1]
        nth = np.arange(len(rank)) - begin[owner[rank]]
        take = rank[nth <= allowed[owner[rank]]]
        keys.append(name[take])
        owners.append(owner[take])
    return np.concatenate(keys), np.concatenate(owners)


# ---- jobs ----------------------------------------------------------------------------------------------


def described(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc_id, text_hash, n, sid and sketch of every row."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at, _ = buffers(b.column(1))
            h, s = shingle_sets(data, at, words)
            made = [sketch(h[s[i] : s[i + 1]]) for i in range(len(s) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(s)), pa.array(set_ids(h, s)), pa.array(made, pa.binary())], names=["doc_id", "text_hash", "n", "sid", "sketch"])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"), F.xxhash64(text).alias("text_hash")).mapInArrow(describe, f"doc_id {kind}, text_hash long, n long, sid long, sketch binary")


def short(key: np.ndarray) -> np.ndarray:
    """The upper 40 bits of keys, which tell the keys of one shard apart; two that agree only give more candidates."""
    return key >> U(24)


def pack_short(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(short(key).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack_short(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def stretches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of about ``STRETCH_BYTES`` of text at a time, each once: hashes and offsets."""
    kept: dict[int, np.ndarray] = {}
    size = 0
    for batch in batches:
        data, at, _ = buffers(batch.column(0))
        cut = [0, *np.flatnonzero(np.diff(at // STRETCH_BYTES)) + 1, len(at) - 1]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            h, s = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], words)
            ids = set_ids(h, s)
            kept.update((int(ids[k]), h[s[k] : s[k + 1]]) for k in range(j - i))
            size += int(at[j] - at[i])
            if size >= STRETCH_BYTES:
                yield np.concatenate(list(kept.values())), np.concatenate([[0], np.cumsum([len(x) for x in kept.values()])]).astype(np.int64)
                kept, size = {}, 0
    if kept:
        yield np.concatenate(list(kept.values())), np.concatenate([[0], np.cumsum([len(x) for x in kept.values()])]).astype(np.int64)


def candidates(docs: DataFrame, text: str, words: int, t: Fraction, shards: int) -> DataFrame:
    """Rows (key, a, b): pairs of set ids of small groups (key null), and members a of large groups (b null; they can be repeated)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, s in stretches(batches, words):
            ids, sizes = set_ids(h, s), np.diff(s).astype(np.uint32)
            key, owner = block_keys(h, s, t)
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(key)))
            common = np.repeat(size > SMALL_GROUP, size)
            first = np.zeros(len(key), bool)
            first[start] = True
            rows: list[tuple[int, bytes, bytes, bytes, bytes, bytes]] = []
            if common.any():  # these need no meeting, but a mark for what meets under the same key elsewhere
                of = order[common]
                named = (key[of] % U(shards) << U(40)) | short(key[of])
                rows.append((-1 - int(named[0] % U(shards)), named.tobytes(), b"", ids[owner[of]].tobytes(), b"", b""))
            marks = key[order[common & first]]
            order = np.sort(order[~common | first])  # by owner again, which packs better
            shard = (key[order] % U(shards)).astype(np.int64)
            order = order[np.argsort(shard, kind="stable")]
            cut = np.searchsorted(np.sort(shard), np.arange(shards + 1))
            marked = (marks % U(shards)).astype(np.int64)
            for i in range(shards):
                of = order[cut[i] : cut[i + 1]]
                if len(of):
                    used, place = np.unique(owner[of], return_inverse=True)
                    rows.append((i, pack_short(key[of]), place.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes(), ids[used].tobytes(), sizes[used].tobytes(), pack_short(marks[marked == i])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["shard", "keys", "places", "sids", "sizes", "marks"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        if shard < 0:
            members = pd.DataFrame({"key": np.frombuffer(b"".join(rows["keys"]), np.int64), "a": np.frombuffer(b"".join(rows["sids"]), np.int64)}).drop_duplicates()
            return members.assign(b=None)[["key", "a", "b"]].astype({"key": "Int64", "b": "Int64"})
        sids, ns = [], []
        for p, s, n in zip(rows["places"], rows["sids"], rows["sizes"], strict=True):
            s = np.frombuffer(s, np.int64)
            p = np.frombuffer(p, np.uint32 if len(s) > 65535 else np.uint16)
            sids.append(s[p])
            ns.append(np.frombuffer(n, np.uint32)[p])
        key, sid, n, marks = unpack_short(b"".join(rows["keys"])), np.concatenate(sids), np.concatenate(ns), unpack_short(b"".join(rows["marks"]))
        order = np.argsort(key)
        key = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        shared = same[1:] | same[:-1] | np.isin(key, marks)  # most keys belong to one set only
        key, sid, n = key[shared], sid[order[shared]], n[order[shared]].astype(np.int64)
        order = np.lexsort((sid, key))
        key, sid, n = key[order], sid[order], n[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])]) if len(key) else np.zeros(0, bool)
        key, sid, n = key[once], sid[once], n[once]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        nth = np.arange(len(key)) - np.repeat(start, size)
        size_of = np.repeat(np.where(np.isin(key[start], marks), SMALL_GROUP + 1, size), size)
        a, b = [], []
        for back in range(1, SMALL_GROUP):
            i = np.flatnonzero((nth >= back) & (size_of <= SMALL_GROUP))
            i = i[np.minimum(n[i], n[i - back]) * t.denominator >= np.maximum(n[i], n[i - back]) * t.numerator]
            a.append(sid[i])
            b.append(sid[i - back])
        pairs = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()
        large = np.flatnonzero(size_of > SMALL_GROUP)
        members = pd.DataFrame({"key": ((U(shard) << U(40)) | key[large]).view(np.int64), "a": sid[large]})
        return pd.concat([pairs.assign(key=None), members.assign(b=None)])[["key", "a", "b"]].astype({"key": "Int64", "b": "Int64"})

    small_batches(docs.sparkSession)
    packed = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(emit, "shard int, keys binary, places binary, sids binary, sizes binary, marks binary")
    return packed.groupBy("shard").applyInPandas(meet, "key long, a long, b long")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's edges (a, b) as arcs from each node to the smallest that it reaches by them."""
    root: dict[int, int] = {}
    for batch in batches:
        for x, y in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            join(root, x, y)
    rows = [(x, find(root, x)) for x in root]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"], dtype="int64")


def find(root: dict[int, int], x: int) -> int:
    root.setdefault(x, x)
    while root[x] != x:
        root[x] = x = root[root[x]]
    return x


def join(root: dict[int, int], x: int, y: int) -> None:
    x, y = find(root, x), find(root, y)
    root[max(x, y)] = min(x, y)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for edges (a, b): trees of each partition, then alternating stars until each tree is one; nothing is collected."""
    arcs = edges.select("a", "b").mapInPandas(_forest, "u long, v long").distinct()
    last = None
    while True:
        both = arcs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        arcs = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each node keeps its smallest neighbour; what hung on it follows
        least = arcs.groupBy("u").agg(F.min("v").alias("m"))
        arcs = arcs.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, arcs = last, saved(arcs)
        last = arcs
        if before is not None:
            dropped(before)
        ends = arcs.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        open_ = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").head(1)
        release(edges.sparkSession)
        if not open_:
            return arcs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def neighbourhoods(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, n) with g: the smallest node at most two steps away, which pairs of one small group share."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l"))
    of = lambda c: label.select(F.col("u").alias(c), F.col("l").alias(f"l{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n", F.least("la", "lb").alias("g"))


def verified(pairs: DataFrame, texts: DataFrame, words: int, t: Fraction) -> DataFrame:
    """Of the pairs (a, b, n, g) of set ids links that join all that are linked, by their whole texts (sid, text).

    g: pairs that had better be verified together; n: their sizes. A call gets about ``CALL_SHINGLES`` of them, so large g
    are split and small ones share a call.
    """
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    calls = -(-int(total) // CALL_SHINGLES) or 1
    many = pairs.groupBy("g").agg(F.ceil(F.sum("n") / CALL_SHINGLES).alias("parts"))
    dealt = pairs.join(many, "g").select("a", "b", F.pmod(F.xxhash64("g", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("a"), F.col("parts"))).otherwise(F.lit(0))), F.lit(calls)).alias("call"))
    wanted = saved(dealt.select("call", F.explode(F.array("a", "b")).alias("sid")).distinct())
    sent = texts.join(_side(wanted), "sid").select("call", "sid", "text")

    def check(some: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        text, made, root, found = dict(zip(have["sid"].tolist(), have["text"], strict=True)), {}, {}, []
        for a, b in sorted(zip(some["a"].tolist(), some["b"].tolist(), strict=True)):
            if find(root, a) != find(root, b) and a in text and b in text:
                x, y = (made[c] if c in made else made.setdefault(c, _set(text[c].encode(), words)) for c in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * t.denominator >= t.numerator * (len(x) + len(y) - both):
                    join(root, a, b)
                    found.append((a, b))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    sent = sent.withColumnRenamed("call", "to")
    return dealt.groupBy("call").cogroup(sent.groupBy("to")).applyInPandas(check, "a long, b long")


def _set(raw: bytes, words: int) -> np.ndarray:
    return shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), words)[0]


def jaccard_components(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, doc_id: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_copies (rows with the same set) of every row.

    keyed: also text_hash (xxhash64 of the text), which tells rows of one id apart, and stays: true for one id and text of each
    component (its smallest id, null last) and for rows without words.
    """
    t = threshold
    rows = saved(described(docs, doc_id, text, words))
    sets = saved(rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("at"), F.count("*").alias("copies")))
    volume = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    met = saved(candidates(docs, text, words, t, max(8, -(-int(volume) // SHARD_BYTES))))
    release(docs.sparkSession)
    # with each member of a key the next smaller ones of its keys
    own = Window.partitionBy("a").orderBy("key")
    members = saved(met.where("key is not null").select("key", "a").distinct().select("key", "a", *[F.lag("key", i).over(own).alias(f"e{i}") for i in range(1, EARLIER + 1)]))
    close = saved(met.where("b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    dropped(met)
    wanted = saved(close.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(members.select(F.col("a").alias("sid"))).distinct())
    met_sets = saved(rows.join(_side(wanted), "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    pairs = saved(_within(close, met_sets, t).unionByName(_within(_hubs(members, met_sets), met_sets, t)).distinct())
    dropped(close)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(members.select(F.col("a").alias("sid"))).distinct()
    state = Links(_texts(docs, doc_id, text, sets, saved(wanted)), words, t)
    state.settle(saved(neighbourhoods(pairs)))
    dropped(pairs)
    open_, most = members, NEAREST
    while (more := _large_groups(open_, met_sets, state.comp, t, most)) is not None:
        release(docs.sparkSession)
        state.settle(more.groupBy("a", "b").agg(F.max("n").alias("n"), F.min("g").alias("g")))
        cut = more.where("cut").select("key").distinct()
        if not cut.head(1):
            break
        open_, most = saved(open_.join(_side(cut), "key", "left_semi")), most * 8
        dropped(more)
    comp = state.comp
    named = sets.join(comp, F.col("sid") == F.col("node"), "left").select("sid", "doc_id", "at", "copies", F.coalesce("root", "sid").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component"), F.min("at").alias("first"))
    named = named.join(smallest, "root").select("sid", "component", "copies", "first")
    out = rows.select("doc_id", "text_hash", "n", "sid").join(named, "sid", "left")
    whole = F.col("n") > 0
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(whole, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(whole, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"), *(["text_hash", (~whole | F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").eqNullSafe(F.col("first"))).alias("stays")] if keyed else []))


def _side(ids: DataFrame) -> DataFrame:
    """One or two numbers a row: broadcast where counted to be few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _texts(docs: DataFrame, doc_id: str, text: str, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text), one row for each wanted set; found by the id and the hash of one of the set's texts."""
    reps = saved(sets.join(_side(wanted), "sid", "left_semi").select("sid", F.col("at.doc_id").alias("at_id"), F.col("at.text_hash").alias("at_hash")))
    rows = docs.select(F.col(doc_id).alias("rep"), F.xxhash64(text).alias("rep_hash"), F.col(text).cast("string").alias("text"))
    found = rows.join(_side(reps), (F.col("rep_hash") == F.col("at_hash")) & F.col("rep").eqNullSafe(F.col("at_id")))
    return saved(found.groupBy("sid").agg(F.first("text").alias("text")))  # rows can be repeated


class Links:
    """The pairs verified so far, the links found, and the components they make."""

    def __init__(self, texts: DataFrame, words: int, t: Fraction) -> None:
        self.texts, self.words, self.t = texts, words, t
        spark = texts.sparkSession
        self.tried, self.edges = (saved(spark.createDataFrame([], "a long, b long")) for _ in range(2))
        self.comp = saved(spark.createDataFrame([], "node long, root long"))

    def _next(self, name: str, df: DataFrame) -> None:
        """Replaces a table by what was made from it."""
        before, now = getattr(self, name), saved(df)
        setattr(self, name, now)
        dropped(before)

    def settle(self, pairs: DataFrame) -> None:
        """Verifies the pairs (a, b, n, g) that are between components and were not before."""
        of = lambda c: self.comp.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        left = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        now = saved(left.join(self.tried, ["a", "b"], "left_anti").select("a", "b", "n", "g"))
        if now.head(1):
            self._next("tried", self.tried.unionByName(now.select("a", "b")))
            self._next("edges", self.edges.unionByName(verified(now, self.texts, self.words, self.t)))
            self._next("comp", components(self.edges))
            release(self.texts.sparkSession)
        dropped(now)


def _hubs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Each member of large groups, in its largest one, with the hub of its block; and the blocks' hubs with the first of them."""
    size = members.groupBy("key").agg(F.count("*").alias("g"))
    own = members.join(size, "key").groupBy("a").agg(F.max(F.struct("g", "key")).alias("m")).select("a", "m.key", F.pmod(F.xxhash64("a"), F.ceil(F.col("m.g") / GROUP_BLOCK)).alias("part"))

    def hub(p: pd.DataFrame) -> pd.DataFrame:
        size = int(min(p["sketch"].map(len)))
        s = np.stack([folded(x, size) for x in p["sketch"]])
        major = np.packbits((np.unpackbits(s, axis=1).mean(0) > 0.5).astype(np.uint8))
        best = int(np.bitwise_count(s ^ major).sum(1, dtype=np.int64).argmin())
        a = p["a"].to_numpy()
        return pd.DataFrame({"key": p["key"].to_numpy(), "a": a, "b": a[best]})

    paired = saved(own.join(sets.select(F.col("sid").alias("a"), "sketch"), "a").groupBy("key", "part").applyInPandas(hub, "key long, a long, b long"))
    firsts = paired.groupBy("key").agg(F.min("b").alias("first"))
    hubs = paired.select("key", "b").distinct().join(firsts, "key").select(F.col("b").alias("x"), F.col("first").alias("y"))
    both = paired.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(hubs)
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct()


def _within(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    of = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where((F.least("na", "nb") * t.denominator >= F.greatest("na", "nb") * t.numerator))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = [near(x, y, int(n), t) for x, y, n in zip(p["sa"], p["sb"], p["n"], strict=True)]
            yield p.loc[np.array(ok, bool), ["a", "b", "n"]]

    return both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "sa", "sb").mapInPandas(keep, "a long, b long, n long")


def _large_groups(members: DataFrame, sets: DataFrame, comp: DataFrame, t: Fraction, most: int) -> DataFrame | None:
    """(key, g, a, b, n, cut): for each component in a block pair g of a group (key, a), its ``most`` nearest pairs to others; cut: it has more.

    A group without such pairs needs no later round: components only grow. A pair with a common smaller key is left to that one, where
    the members' next smaller keys show it.
    """
    earlier = [f"e{i}" for i in range(1, EARLIER + 1)]
    named = members.join(comp, F.col("a") == F.col("node"), "left").select("key", "a", *earlier, F.coalesce("root", "a").alias("root"))
    several = named.groupBy("key").agg(F.count("*").alias("g"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    left = saved(named.join(several.select("key", "g"), "key"))
    n = left.count()
    if not n:
        return None
    full = left.join(sets.select(F.col("sid").alias("a"), "n", "sketch"), "a").withColumn("nb", F.ceil(F.col("g") / GROUP_BLOCK).cast("int"))
    full = full.withColumn("own", F.pmod(F.xxhash64("a"), F.col("nb")).cast("int"))
    # a block meets itself and every later one: side 0 has the earlier block, side 1 the later
    places = F.concat(F.transform(F.expr("sequence(own, nb - 1)"), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side"))), F.filter(F.transform(F.expr("sequence(0, own)"), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))), lambda p: p["i"] < p["j"]))
    dealt = full.select("key", F.explode(places).alias("p"), "a", "root", "n", "sketch", *earlier).select("key", "p.i", "p.j", "p.side", "a", "root", "n", "sketch", *[F.coalesce(e, "a").alias(e) for e in earlier])
    # many small groups share a task's call
    dealt = dealt.withColumn("call", F.pmod(F.xxhash64("key", "i", "j"), F.lit(1 + n // 4096)))

    def nearest(key: int, x: np.ndarray, y: np.ndarray, a: np.ndarray, root: np.ndarray, n: np.ndarray, before: np.ndarray, sketches: list[bytes]) -> list[tuple[int, int, int, int, bool]]:
        size = min(map(len, (sketches[k] for k in (*x, *y))))
        sx, sy = (np.stack([folded(sketches[k], size) for k in q]) for q in (x, y))
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for i, k in enumerate(x):
            apart = np.bitwise_count(sx[i] ^ sy).sum(1, dtype=np.int64)
            fits = (root[y] != root[k]) & (np.minimum(n[k], n[y]) * t.denominator >= np.maximum(n[k], n[y]) * t.numerator)
            at = np.flatnonzero(fits & (apart * (t.denominator + t.numerator) <= (t.denominator - t.numerator) * (n[k] + n[y])))
            at = at[~(before[y[at]][:, :, None] == before[k]).any((1, 2))]
            if len(at) > most + 1:  # one more than wanted shows that there are more
                at = at[np.argpartition(apart[at], most)[: most + 1]]
            if len(at):
                found.setdefault(int(root[k]), []).extend((int(apart[j]), int(a[k]), int(a[y[j]]), int(n[k] + n[y[j]])) for j in at)
        return [(key, p, q, both, len(of) > most) for of in found.values() for _, p, q, both in sorted(of)[:most]]

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        key, i, j, side, a, root, n = (p[c].to_numpy() for c in ("key", "i", "j", "side", "a", "root", "n"))
        sketches, before = p["sketch"].tolist(), p[earlier].to_numpy()
        order = np.lexsort((side, j, i, key))
        new = np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in (key, i, j)], axis=0)])
        out: list[tuple[int, int, int, int, int, bool]] = []
        for at in np.split(order, np.flatnonzero(new)[1:]):
            x = at[side[at] == 0]
            y = x if i[at[0]] == j[at[0]] else at[side[at] == 1]
            if len(x) and len(y):
                g = hash((int(key[at[0]]), int(i[at[0]]), int(j[at[0]])))
                out += [(g, *row) for row in nearest(int(key[at[0]]), x, y, a, root, n, before, sketches)]
        return pd.DataFrame(out, columns=["g", "key", "a", "b", "n", "cut"]).astype({"g": np.int64, "key": np.int64, "a": np.int64, "b": np.int64, "n": np.int64, "cut": bool})

    found = dealt.groupBy("call").applyInPandas(compare, "g long, key long, a long, b long, n long, cut boolean")
    return saved(found.select("g", "key", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "n", "cut"))

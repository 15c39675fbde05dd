"""The training-data operators: brute-force versions, round trips, held-out accuracy, and odd inputs."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, ctw, decontam, jaccard, langid, license, mixing, pii, toxicity, urlfilter

KIND = "doc_id long, text string"


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (4, "one"), (None, "one two three four five six"), (5, "Long " * 30000), (6, "é ü"), (7, "..!!")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and a clashing extra column."""
    return spark.createDataFrame([(*r, 1) for r in ODD], KIND + ", score int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


# ---- 1 -------------------------------------------------------------------------------------------------


def test_ann(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 32)) * 3
    x = np.concatenate([centres[i % 6] + rng.normal(size=32) for i in range(900)]).reshape(-1, 32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[5].tolist()) for i in range(200)]
    bad = [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [None] * 32), (5005, [float("inf")] * 32), (5100, None), (None, [1.0] * 32)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    found = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vectors = dict(rows)
    assert set(found) == {i for i in vectors if i % 100 == 0}
    hits = total = 0
    for q, near in found.items():
        near.sort()
        assert [n for n, _, _ in near] == list(range(1, 11)) and q not in {v for _, v, _ in near}
        for _, v, s in near:
            assert math.isclose(s, math.dist(vectors[q], vectors[v]), abs_tol=1e-9)
        want = sorted((math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q)[:10]
        hits += len({i for _, i in want} & {v for _, v, _ in near})
        total += 10
        assert [(s, v) for _, v, s in near] == sorted((s, v) for _, v, s in near)
    assert hits / total >= 0.9


def test_ann_few(spark):
    df = spark.createDataFrame([(i * 100, [float(i + 1), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    out = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    assert len(out) == 12
    assert ann.search(df.where("false"), F.lit(True)).collect() == []


def test_scan_finds_all_without_tests():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(700, 24)), rng.normal(size=24)
    rotation = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    want = sorted((math.dist(q, v), i) for i, v in enumerate(x))[:10]
    found, lost = ann.scan(q @ rotation, x @ rotation, 10, np.arange(700), q, x)
    assert len({i for _, i in want} & {i for _, i in found}) >= 9 and lost > 0
    # a known bound acts on the first candidates too, and copies at the same distance stay, the smaller ids first
    found, early = ann.scan(q @ rotation, x @ rotation, 10, np.arange(700), q, x, want[-1][0] ** 2)
    assert early > lost and len({i for _, i in want} & {i for _, i in found}) >= 9
    copies = np.tile(x[:1], (600, 1))
    assert [i for _, i in ann.scan(q @ rotation, copies @ rotation, 10, np.arange(600), q, copies)[0]] == list(range(10))


def test_ann_on_the_registered_table(spark):
    """Recall against brute force over all rows, and candidates abandoned, with the query's parameters."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    lost = spark.sparkContext.accumulator(0)
    out = ann.search(df, F.col("vec_id") % 100 == 0, abandoned=lost).collect()
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found, hits = {}, 0
    for r in out:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, near in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(near & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert set(found) == set(ids[ids % 100 == 0].tolist()) and hits >= 0.9 * 10 * len(found)
    assert lost.value > 0.1 * len(found) * len(rows) / 2


def test_ann_lengths(spark):
    """Vectors of an uncommon length are searched among their own length."""
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(30)] + [(100 + i, [float(i % 7), 1.0]) for i in range(12)] + [(200, [5.0])], "vec_id long, embedding array<double>")
    out = ann.search(df, F.col("vec_id").isin(0, 100, 200)).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100, 200)}
    assert [v for v, _ in got[0]] == list(range(1, 11)) and got[200] == []
    assert got[100] == sorted(((100 + i, float(i % 7)) for i in range(1, 12)), key=lambda r: (r[1], r[0]))[:10]


# ---- 2 -------------------------------------------------------------------------------------------------


def brute_components(rows, words=5):
    sets = {}
    for i, t in rows:
        w = blank_words(t)
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else (frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holds = {}
    for i, s in sets.items():
        for g in s:
            holds.setdefault(g, []).append(i)
    for i in sorted(sets):
        for j, n in Counter(j for g in sets[i] for j in holds[g] if j < i).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    base, passage = ([rng.choice(vocabulary) for _ in range(n)] for n in (60, 12))
    rows = []
    for i in range(500):
        kind = i % 5
        words = list(base)
        if kind == 0:
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(60)] = rng.choice(vocabulary)
        elif kind == 1:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + passage
        elif kind == 2:
            words = [rng.choice(vocabulary[:3]) for _ in range(rng.randint(0, 8))]
        elif kind == 3:
            words = base[rng.randint(0, 12) :]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "\t ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n ")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, KIND).repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(rows)


def test_jaccard_large_groups(spark):
    """Thousands of near copies around a centre, most of which are not linked to each other; and a text that every second row has."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(10, " ".join(base))]
    for i in range(5000):
        words = list(base)
        words[rng.randrange(8, 52)] = f"x{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(20000 + i, "one text that very many rows share with each other") for i in range(5000)] + [(7, "one text that very many rows share with each other")]
    rng.shuffle(rows)
    out = jaccard.jaccard_components(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    assert len(out) == len(rows) and {r.component_id for r in out if r.doc_id < 20000 and r.doc_id != 7} == {10}
    assert {r.component_id for r in out if r.doc_id >= 20000 or r.doc_id == 7} == {7} and {r.n_copies for r in out if r.doc_id >= 20000} == {5001}


def test_stretches_give_each_set_once(monkeypatch):
    texts = [f"word{i % 7} and some more words to fill a text" for i in range(50)] + ["", "long " * 500, "long " * 500]
    whole = {int(i) for t in texts for i in jaccard.set_ids(*jaccard.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))}
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(jaccard, "STRETCH_BYTES", size)
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 20])], names=["t"]) for i in range(0, len(texts), 20)]
        found = [jaccard.set_ids(h, s).tolist() for h, s in jaccard.stretches(iter(batches), 5)]
        assert {i for f in found for i in f} == whole and all(len(set(f)) == len(f) for f in found)
    assert len(found) == 1


def test_jaccard_odd(odd, none):
    out = sorted(jaccard.jaccard_components(odd).collect(), key=lambda r: (r.doc_id or 0, r.n_shingles))
    assert len(out) == len(ODD) and [r.component_id for r in out if r.doc_id == 4] == [4, 4] and [r.n_copies for r in out if r.doc_id == 4] == [2, 2]
    assert jaccard.jaccard_components(none).collect() == []


def test_jaccard_ids_null_or_repeated(spark):
    rng = random.Random(5)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, " ".join(a)), (None, " ".join(a)), (3, near(a)), (1, " ".join(b)), (1, " ".join(c)), (1, " ".join(c)), (5, near(b)), (7, near(c)), (9, " ".join(d)), (None, " ".join(e)), (None, near(e))]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, KIND).repartition(3), keyed=True)
    of = {r.text_hash: (r.component_id, r.n_copies) for r in out.collect()}
    key = {t: k for t, k in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    assert [of[key[t]] for _, t in rows] == [(3, 2), (3, 2), (3, 1), (1, 1), (1, 2), (1, 2), (1, 1), (1, 1), (9, 1), (None, 1), (None, 1)]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 40)).astype(np.uint64)]))
        x, y = jaccard.sketch(a), jaccard.sketch(b)
        size = min(len(x), len(y))
        assert np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum() <= len(np.setxor1d(a, b))


def test_blocks_meet():
    """Any two sets within the threshold share a key."""
    rng, t = random.Random(4), jaccard.THRESHOLD
    for _ in range(300):
        n = rng.randint(1, 120)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randint(0, max(1, n // 8))):
            b.discard(rng.choice(sorted(b))) if b and rng.random() < 0.5 else b.add(rng.getrandbits(64))
        if not b or 5 * len(a & b) < 4 * len(a | b):
            continue
        one, two = (np.array(sorted(s), np.uint64) for s in (a, b))
        keys, owner = jaccard.block_keys(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]), t)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


# ---- 3 -------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = ["https://a.b.org/x", "http://example.org/es/1", "http://EXAMPLE.org/en/12?q", "http://notexample.org/es/1", "http://org", "https://org/", None, "no scheme", "http://c.com/de/1#x", "http://c.com/DE/1", "http://bad.net/page.html", "http://www.bad.net/page/", "http://bad.net/other", "x://"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("https://bad.net/page",), (None,)], "url string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_filter(pages, rules, listed).collect()}
    assert out[0] == ("a.b.org", "/x", "org/", "allow") and out[1][2:] == ("example.org/es/", "block") and out[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert out[3][2:] == ("org/", "allow") and out[4] == ("org", "", None, "allow") and out[5][2:] == ("org/", "allow")
    assert out[6] == out[7] == ("", "", None, "allow") and out[8][2:] == ("com/de/", "block") and out[9][2:] == (None, "allow")
    assert out[10][3] == out[11][3] == "block" and out[12][3] == "allow" and out[13] == ("", "", None, "allow")
    assert urlfilter.url_filter(pages, rules.where("false"), listed.where("false")).where("verdict <> 'allow'").count() == 0
    assert urlfilter.url_filter(pages.where("false"), rules, listed).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    words = urlfilter.bloom(keys, 64)
    full = F.array(*[F.lit(w) for w in words])
    hit = F.lit(True)
    for w in range(4):
        m = urlfilter._mask(F.col("key"), w)
        hit = hit & (F.get(full, urlfilter._block(F.col("key"), 64) * 4 + w).bitwiseAND(m) == m)
    assert keys.where(hit).count() == 500
    others = spark.range(2000).select(F.concat(F.lit("z"), F.col("id").cast("string")).alias("key"))
    assert others.where(hit).count() < 60


# ---- 4 -------------------------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_pseudonyms(spark):
    texts = [
        "mail foo.bar19@mail5.example.com, call +1 (323) 555-1055 or 323-555-1055.", "card 4785380592391139 and 4785-3805-9239-1139, bad 4785380592391138",
        "on 1984-02-29, 31/12/1999 and 31.12.1999, not 2023-02-30", "from 13.149.130.89 not 999.1.1.1", 'token = "0641917ea4e9feb9cda11111" password=531ccd051a92ebc', "DE89 3704 0044 0532 0130 00, 123-45-6789, +33 1 23 45 67 89", "clean 12 text 2.0", None, "",
    ]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], KIND + ", n_pii int")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    for i, words in enumerate((["bar19@", "555-1055"], ["4785"], ["1984-02-29", "31/12/1999", "31.12.1999"], ["13.149.130.89"], ["0641917ea4e9", "531ccd051"], ["3704", "123-45", "1 23 45"])):
        assert not any(w in out[i].text for w in words if w != "4785") and len(out[i].text) <= len(texts[i]) + 4
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", out[1].text)
    assert luhn(cards[0]) and cards[1].replace("-", "") == cards[0] != "4785380592391139" and cards[2] == "4785380592391138"
    assert "2023-02-30" in out[2].text and "999.1.1.1" in out[3].text and re.search(r"@mail5\.example\.com, call \+1 \(\d{3}\) \d{3}-\d{4}", out[0].text)
    assert [out[i].n_pii for i in range(9)] == [3, 2, 3, 1, 2, 3, 0, 0, 0] and out[6].text == texts[6] and out[7].text is None and out[8].text == ""
    assert out[0].kinds == "email,phone"
    again = pii.pseudonymise(df, "other").where("doc_id = 1").first().text
    assert again != out[1].text


def test_pseudonyms_beside_other_values(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    rows = [
        (f"card {card} 12/27", [card], "card"), (f"{card} 123", [card], "card"), ("order 12 4111111111111111", ["4111111111111111"], "card"), (f"order 123 {card} 456 12/27", [card], "card"),
        (f"2024 {card}", [card], "card"), (f"1 22 333 4444 55555 {card} 1 22 333", [card], "card"), ("7 4111-1111-1111-1111 323-555-1055", ["4111-1111-1111-1111", "323-555-1055"], "card,phone"),
        (f"{card} 2024-01-02 9", [card, "2024-01-02"], "card,date"), (f"+44 20 7946 0958 {card}", ["7946 0958", card], "card,world"), (f"AB12 {card}", [card], "card"), (f"000-12-3456 {card}", [card], "card"),
        (f"{iban} BIC: COBADEFF", [iban], "iban"), (f"NR12 {iban} BIC 7", [iban], "iban"), (f"{iban} {card} 12", [iban, card], "card,iban"), ("DE89370400440532013000 COBADEFF X", ["DE89370400440532013000"], "iban"),
        ("at 2024-01-02T10:00:00Z", ["2024-01-02"], "date"), ("at 2024-01-02Tea 2023-02-29 2023-04-31", [], ""), ("card 4111 1111 1111 1112 123", [], ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], KIND)
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    for i, (t, values, kinds) in enumerate(rows):
        assert not any(v in out[i].text for v in values) and (out[i].kinds, len(out[i].text)) == (kinds, len(t)) and (values or out[i].text == t), (t, out[i])
    # what stands beside a value stays, and the value has the pseudonym that it has alone
    alone = pii.pseudonymise(spark.createDataFrame([(0, card), (1, iban)], KIND), "k").orderBy("doc_id").collect()
    assert out[0].text == f"card {alone[0].text} 12/27" and out[1].text == f"{alone[0].text} 123" and out[11].text == f"{alone[1].text} BIC: COBADEFF" and luhn(re.sub(r"\D", "", alone[0].text))


def test_permutations_are_undone(spark):
    digits = spark.createDataFrame([(f"{i:03d}",) for i in range(1000)], "v string").select("v", pii.permute_digits("k", "t", F.col("v")).alias("p")).select("v", "p", pii.permute_digits("k", "t", F.col("p"), back=True).alias("b"))
    rows = digits.collect()
    assert len({r.p for r in rows}) == 1000 and all(r.b == r.v for r in rows)
    chars = spark.createDataFrame([("ab.XY09-z",), ("a",), ("q7",)], "v string").select("v", pii.permute_chars("k", "t", F.col("v")).alias("p")).select("v", "p", pii.permute_chars("k", "t", F.col("p"), back=True).alias("b"))
    assert all(r.b == r.v and len(r.p) == len(r.v) for r in chars.collect())


def test_pseudonyms_odd(odd, none):
    assert pii.pseudonymise(odd, "k").where("n_pii > 0").count() == 0 and pii.pseudonymise(odd, "k").count() == len(ODD)
    assert pii.pseudonymise(none, "k").count() == 0


def test_pseudonyms_long_runs(spark):
    """Long repetitions of what each kind is made of neither overflow nor hang, and the value after them is found."""
    units = ["b.", "a@", "a@b.", "b-", "1.", "12 ", "1-", "4111 ", "AB12 ", "A1", "password=", "+49 ", "(323) ", "2024-01-02 ", "000-", "%", "DE89"]
    rows = [(i, "a@" + u * (100_000 // len(u)) + "com") for i, u in enumerate(units)] + [(100 + i, u * (100_000 // len(u)) + " mail x.y@z.org") for i, u in enumerate(units)]
    out = {r.doc_id: (r.text, r.n_pii) for r in pii.pseudonymise(spark.createDataFrame(rows, KIND).repartition(8), "k").collect()}
    assert len(out) == len(rows) and all("x.y@z.org" not in out[100 + i][0] and out[100 + i][1] > 0 for i in range(len(units)))


def test_native_plans(spark, odd):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    for df in (pii.pseudonymise(odd, "k"), decontam.decontaminate(odd, items)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# ---- 5 -------------------------------------------------------------------------------------------------


def brute_hits(docs, items, k=13):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for p, ids in windows.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark, odd, none):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(30)] + ["É", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 13, 14, 30])))) for i in range(12)] + [(50, None), (51, "..."), (None, "v1"), (10, "v1 v2 v1 v2 v1")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 2:
            at = rng.randint(0, len(w))
            w[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((i, ", ".join(w).upper() if i % 3 == 0 else " ".join(w)))
    docs += [(99, None), (5, docs[5][1]), (None, docs[7][1]), (5, docs[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.decontaminate(spark.createDataFrame(docs, KIND), bench)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in out.collect()), key=str) == brute_hits(docs, items)
    assert decontam.decontaminate(odd, bench).count() == len(ODD) and decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(odd, bench.where("false")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b y c"), (2, "c b a"), (3, "a " + "z " * 20 + "b c")], KIND)
    out = decontam.proximity(docs, spark.createDataFrame([("a b c",)], "phrase string"), 6).collect()
    key = {(r.k1, r.k2) for r in out}
    want = {(r.k1, r.k2) for r in decontam._named(docs.where("doc_id < 3"), "text").collect()}
    assert key == want and {r.span for r in out} == {6, 3}


def test_proximity_of_items(spark):
    """n_near against a count by hand: an item is near where its three rarest terms lie within the distance of the rarest."""
    rng = random.Random(16)
    vocabulary = [f"v{i}" for i in range(25)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(70, None), (71, "")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 8])))) for i in range(10)] + [(20, "v1 nowhere"), (21, None)]
    counts = Counter(w for _, t in docs for w in plain_words(t))
    want = {}
    for d, t in docs:
        w, near = plain_words(t), 0
        for _, item in items:
            own = plain_words(item)
            terms = sorted(set(own), key=lambda x: (counts[x], x))[:3]
            near += bool(own) and all(x in counts for x in own) and any(all(any(w[j] == x for j in range(max(0, i - 4), i + 5) if j < len(w)) for x in terms) for i in range(len(w)) if w[i] == terms[0])
        want[d] = near
    out = decontam.decontaminate(spark.createDataFrame(docs, KIND), spark.createDataFrame(items, "item_id long, text string"), distance=4)
    assert {r.doc_id: r.n_near for r in out.collect()} == want


# ---- 6 -------------------------------------------------------------------------------------------------


def brute_ctw(texts, learn):
    """The same model with recursive dictionaries."""
    counts = {}
    bodies = [ctw.body((t or "").encode()) + b"\n" for t in texts]
    for b, use in zip(bodies, learn, strict=True):
        s = b"\n" * ctw.DEPTH + b
        for i in range(ctw.DEPTH, len(s)):
            if use:
                for d in range(ctw.DEPTH + 1):
                    for j in range(8):
                        node = (s[i - d : i], j, s[i] >> (8 - j))
                        counts.setdefault(node, [0, 0])[s[i] >> (7 - j) & 1] += 1
    children = {}
    for c, j, p in counts:
        if c:
            children.setdefault((c[1:], j, p), []).append((c, j, p))
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)
    memo = {}

    def weighted(node):
        if node not in memo:
            own = kt(counts[node])
            if len(node[0]) == ctw.DEPTH:
                memo[node] = (own, 1.0)
            else:
                below = sum(weighted(c)[0] for c in children[node])
                total = np.logaddexp(own, below) - math.log(2)
                memo[node] = (total, math.exp(own - math.log(2) - total))
        return memo[node]

    scores = []
    for b in bodies:
        s, total = b"\n" * ctw.DEPTH + b, 0.0
        for i in range(ctw.DEPTH, len(s)):
            for j in range(8):
                bit, left, p, last = s[i] >> (7 - j) & 1, 1.0, 0.0, 0.5
                for d in range(ctw.DEPTH + 1):
                    node = (s[i - d : i], j, s[i] >> (8 - j))
                    if node not in counts:
                        break
                    n = counts[node]
                    last = (n[bit] + 0.5) / (sum(n) + 1)
                    stop = weighted(node)[1]
                    p += left * stop * last
                    left *= 1 - stop
                total += math.log10(p + left * last)
        scores.append(total)
    return scores


def test_ctw(spark):
    texts = ["The cat sat on the mat", "the cat ate", None, "A dog sat", "the cat sat on a dog", "zzz", "Été été"]
    learn = [True, True, True, True, False, False, True]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], KIND)
    out = sorted(ctw.ctw_scores(df, F.col("doc_id").isin(4, 5)).collect(), key=lambda r: r.doc_id)
    for r, want in zip(out, brute_ctw(texts, learn), strict=True):
        assert math.isclose(r.score, want, rel_tol=1e-6), r
    tokens = Counter(w for t, use in zip(texts, learn, strict=True) if use for w in [*blank_words(t), None])
    n, v = sum(tokens.values()), len(tokens)
    for r, t in zip(out, texts, strict=True):
        words = [*blank_words(t), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(tokens[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
    assert [r.held_out for r in out] == [False] * 4 + [True] * 2 + [False]


def test_ctw_odd(odd, none):
    assert ctw.ctw_scores(odd, F.lit(False)).count() == len(ODD)
    alone = ctw.ctw_scores(odd, F.lit(True)).where("doc_id = 2").first()
    assert math.isclose(alone.score, 8 * math.log10(0.5)) and alone.train_tokens == 0
    assert ctw.ctw_scores(none, F.lit(True)).count() == 0


POOLS = []


def peak_mb(function):
    """What a call takes at most beside what there was, of Python's, numpy's and Arrow's memory."""
    before, own = pa.default_memory_pool(), pa.proxy_memory_pool(pa.system_memory_pool())
    POOLS.append(own)  # what the call returns lies in it
    pa.set_memory_pool(own)
    tracemalloc.start()
    try:
        result = function()
        return result, (tracemalloc.get_traced_memory()[1] + own.max_memory()) / 1e6
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)


def numbered_words(n, distinct):
    return b" ".join(b"w%d" % i for i in np.random.default_rng(6).integers(0, distinct, n).tolist())


def answers_of(stated):
    """Answers to a block's state with any value for each gram."""
    rng = np.random.default_rng(7)
    rows = [(r["kind"], r["keys"], ctw.pack(-rng.random(len(ctw.unpack(r["counts"], np.int64)))) if r["kind"] == 0 else r["counts"]) for r in stated.to_pylist()]
    return pa.table({"kind": [r[0] for r in rows], "keys": [r[1] for r in rows], "counts": [r[2] for r in rows]})


def test_ctw_memory_of_a_block():
    """10 MB of many texts, and of a single one: neither all gram places nor all words as objects are held at once."""
    words = numbered_words(1_500_000, 50_000).split(b" ")
    texts = [b" ".join(words[i : i + 400]) for i in range(0, len(words), 400)]
    _, mb = peak_mb(lambda: ctw._state(0, texts, [True] * len(texts), 8))
    assert mb < 60, mb
    long = [b" ".join(texts)]
    stated, mb = peak_mb(lambda: ctw._state(0, long, [True], 8))
    assert mb < 150, mb
    answers = answers_of(stated)
    scored, mb = peak_mb(lambda: ctw._scores(long, answers))
    assert mb < 180 and scored["words"].tolist() == [len(words)], mb


def test_ctw_slices(monkeypatch):
    """States and scores do not depend on where texts are cut."""
    texts = [b"The cat sat", None, b"", b"a", b"on  the\tmat and on the other mat, too " * 9, b"x" * 70, b"the end"]
    learn = [True, False, True, True, True, False, False]
    outs = []
    for size in (1 << 20, 7, 64):
        monkeypatch.setattr(ctw, "SLICE_BYTES", size)
        monkeypatch.setattr(ctw, "WAITING", size)
        stated = ctw._state(3, texts, learn, 4)
        outs.append((stated, ctw._scores(texts, answers_of(stated))))
    for stated, scored in outs[1:]:
        assert stated.equals(outs[0][0]) and scored.drop(columns="score").equals(outs[0][1].drop(columns="score"))
        assert np.allclose(scored["score"], outs[0][1]["score"], rtol=1e-12, atol=0)
    answers = answers_of(outs[0][0]).to_pylist()
    value = {k: v for r in answers if r["kind"] == 0 for k, v in zip(ctw.unpack(r["keys"], np.uint64, True).tolist(), ctw.unpack(r["counts"], np.float64).tolist(), strict=True)}
    for t, score in zip(texts, outs[0][1]["score"], strict=True):
        assert math.isclose(score, sum(value[k] for k in ctw.grams([ctw.body(t)])[0].tolist()), rel_tol=1e-12)
    seen = Counter(w for t, use in zip(texts, learn, strict=True) if use for w in blank_words((t or b"").decode()))
    stated = {w.decode(): n for r in outs[0][0].to_pylist() if r["kind"] == 1 for w, n in zip(ctw.unpack_words(r["keys"]), ctw.unpack(r["counts"], np.int64).tolist(), strict=True)}
    assert stated == {w: seen[w] for t in texts for w in blank_words((t or b"").decode())}


def test_ctw_ids_stay_whole(spark):
    """An id that a double can't hold, in one block with a null id."""
    big = 2**60 + 1
    out = ctw.ctw_scores(spark.createDataFrame([(big, "a"), (None, "b"), (big + 1, "c")], KIND), F.lit(False)).collect()
    assert {r.doc_id for r in out} == {big, None, big + 1}


def test_ctw_probabilities_add_up():
    key, n = ctw.runs(ctw.grams([b"abracadabra", b"abc"])[0])
    two = ctw.deep_levels(key, n)
    parent, w = two[2].up()
    at, place = np.unique(parent, return_inverse=True)
    one = ctw.Level(at, *(np.bincount(place, v, len(at)).astype(np.int64) for v in (two[2].n0, two[2].n1)), (parent, w))
    nodes, place = np.unique(at & np.uint64(255), return_inverse=True)
    root = ctw.Level(nodes, *(np.bincount(place, v, len(nodes)).astype(np.int64) for v in (one.n0, one.n1)), one.up())
    for context in (int(key[3]) >> 8, 0x7A7A7A7A7A):
        every = np.array([(context << 8) | x for x in range(256)], np.uint64)
        assert math.isclose((10 ** ctw.code(every, {**two, 0: root, 1: one})).sum(), 1, rel_tol=1e-9)


# ---- 7 -------------------------------------------------------------------------------------------------


def test_license_base(spark, odd, none):
    texts = ["Released under the MIT License. MIT license!", "GNU General Public License, version 3, apache-license", "cc BY-NC 4.0", "commit license", None, "mit licenses", "É mit license", "Apache License, Version 2.0"]
    out = {r.doc_id: r for r in license.license_scan(spark.createDataFrame(list(enumerate(texts)), KIND)).collect()}
    labels = dict(license.BASE)
    for i, t in enumerate(texts):
        w = plain_words(t)
        places = sorted((k, labels[p]) for p in labels for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = out[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)) and r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "gpl-3" in out[1].labels and "cc-by-nc-4.0" in out[2].labels and "apache-2" in out[7].labels and out[3].labels == ""
    assert license.license_scan(odd).count() == len(ODD) and license.license_scan(none).count() == 0


def brute_detect(words):
    """Every rule over the whole text, without gates, and each detection against all kept before it."""
    found = []
    for i, r in enumerate(license.rules()):
        for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", words):
            start = len(words[: m.start()].split())
            found.append(license.Detection(r.label, r.priority, start, start + len(m[0].split()), i))
    kept = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.order)):
        if not any(k.start <= d.start and d.end <= k.end for k in kept):
            kept.append(d)
    return kept


def test_license_detections_by_brute_force():
    kept = license.detect("under the gnu lesser general public license version 2 1 or later")
    assert [(d.label, d.start, d.end) for d in kept] == [("lgpl-2.1-or-later", 2, 12)]
    rng = random.Random(23)
    pieces = [s for r in license.rules()[::3] for s in samples(re._parser.parse(r.pattern))[:3]]
    for _ in range(60):
        text = " ".join(rng.choice([rng.choice(pieces), "some", "other words", "of the", "or later"]) for _ in range(rng.randint(1, 40)))
        words = " ".join(plain_words(text))
        assert license.detect(words) == brute_detect(words)


def test_license_suppression_of_many():
    rng = random.Random(24)
    for _ in range(200):
        found = [license.Detection(str(i), rng.choice([10, 50, 60]), at := rng.randrange(30), at + rng.randint(1, 12), i) for i in range(rng.randint(0, 40))]
        want = []
        for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.order)):
            if not any(k.start <= d.start and d.end <= k.end for k in want):
                want.append(d)
        assert license.unsuppressed(found) == want


def samples(parsed):
    """Strings of a parsed pattern: every alternative, with and without what is optional."""
    out = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            some = [chr(value)]
        elif name == "IN":
            o, v = value[0]
            some = ["x"] if str(o) == "NEGATE" else [chr(v if str(o) == "LITERAL" else v[0])]
        elif name == "NOT_LITERAL":
            some = ["x"]
        elif name == "BRANCH":
            some = [x for branch in value[1] for x in samples(branch)]
        elif name == "SUBPATTERN":
            some = samples(value[3])
        else:
            assert name == "MAX_REPEAT", name
            least, _, body = value
            some = [x * max(least, 1) for x in samples(body)] + ([""] if least == 0 else [])
        out = [a + b for a in out for b in some]
    return out


def test_license_samples_pass_both_gates():
    gate, compiled = license._engine()
    for i, r in enumerate(license.rules()):
        for s in samples(re._parser.parse(r.pattern)):
            words = " ".join(plain_words(s))
            if not compiled[i].fullmatch(words):
                continue  # commas and brackets are no words
            assert license._prefilter().search(words.encode()) and any(i in of for _, of in gate.iter(words)), (r, words)


def test_license_names_of_every_gate(spark):
    texts = ["GNU Library General Public License, version 2", "0BSD", "FreeBSD"]
    out = {r.doc_id: r.labels.split(",") for r in license.license_scan(spark.createDataFrame(list(enumerate(texts)), KIND)).collect()}
    assert "lgpl-2" in out[0] and out[1] == ["0bsd"] and out[2] == ["bsd-2-clause"]


# ---- 8 -------------------------------------------------------------------------------------------------


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = langid.language_id(docs, held).where(held & (F.length("text") > 30))
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.right > 0.97 and 0 <= r.low and r.high <= 1
    prototypes = langid.learn(docs)
    got = langid.identify(odd, prototypes).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 7} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.identify(none, prototypes).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.learn(docs.where("false"))).collect()} == {"und"}


@pytest.mark.parametrize("piece", [1 << 20, 2, 3, 7])
def test_bundles_by_definition(piece, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", piece)
    texts = ["Ab c!", "été", None, "a", "12", "one  two 3 three", "     x     y", "!!!!! z"]
    got, has = langid._bundles(texts, 64)
    for t, g, h in zip(texts, got, has, strict=True):
        s = "".join(c.lower() if c.isalpha() else "\0" for c in t or "")
        s = re.sub("\0+", "\0", f"\0{s}\0")
        want = np.zeros(64)
        letter = lambda c: langid._letter(ord(c), 64)
        if h:
            for i in range(len(s) - 2):
                want += np.roll(letter(s[i]), 2) * np.roll(letter(s[i + 1]), 1) * letter(s[i + 2])
        assert np.allclose(g, want) and h == any(c.isalpha() for c in t or "")


# ---- 9 -------------------------------------------------------------------------------------------------


def test_toxicity(spark, odd, none):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(800):
        text = [rng.choice(words) for _ in range(40)]
        rude, junk = i % 8 == 0, i % 5 == 0
        if rude:
            text[3:3] = [rng.choice(["nasty", "vilely", "vilest"])]
        if junk:
            text[9:9] = ["click", "here"]
        rows.append((i, " ".join(text), int(junk), int(rude)))
    df = spark.createDataFrame(rows, KIND + ", junk int, rude int")
    chain = toxicity.fit_chain(df.select("doc_id", "text"), df.where("doc_id < 600").select("doc_id", "junk", "rude"), ("junk", "rude"))
    assert [m[0] for m in chain.models] == ["junk", "rude"] and len(chain.models[1][2]) == 1
    out = toxicity.score_chain(df.where("doc_id >= 600"), chain)
    assert out.where("(is_rude <> (rude = 1)) or (is_junk <> (junk = 1))").count() <= 2
    assert toxicity.score_chain(odd, chain).count() == len(ODD) and toxicity.score_chain(none, chain).count() == 0
    flat = toxicity.fit_chain(df.select("doc_id", "text"), df.where("false").select("doc_id", "junk", "rude"), ("junk", "rude"))
    assert toxicity.score_chain(odd, flat).first().p_rude == pytest.approx(0.5)


def brute_chain(texts, labels, fit_on):
    """The chain with dense matrices and plain Newton steps, everything recomputed from the texts."""
    def newton(x, y, penalty):
        x = np.column_stack([x, np.ones(len(x))])
        ridge = np.full(x.shape[1], penalty)
        ridge[-1] = 0
        theta = np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-x @ theta))
            theta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * theta) * 0.7
        return theta

    say = lambda x, theta: 1 / (1 + np.exp(-np.column_stack([x, np.ones(len(x))]) @ theta))
    words = [set(plain_words(t)) for t in texts]
    y = np.array(labels, float)[fit_on]
    chosen = set()
    for w in set().union(*words):
        has = np.array([w in words[i] for i in fit_on])
        for c in range(y.shape[1]):
            share = (y[:, c].sum() + 0.5) / (len(y) + 1)
            if has.sum() >= 3 and abs(y[has, c].sum() - has.sum() * share) >= toxicity.LEAST_Z * math.sqrt(has.sum() * share * (1 - share)):
                chosen.add(w)
    names = sorted(chosen, key=str.encode)
    x = np.array([[float(w in some) for w in names] for some in words])
    fold = np.array([zlib.crc32(np.flatnonzero(x[i]).astype(np.int32).tobytes()) % toxicity.FOLDS for i in fit_on])
    train, every, probabilities = x[fit_on], x, []
    for c in range(y.shape[1]):
        tried = []
        for penalty in toxicity.PENALTIES:
            out = np.zeros(len(y))
            for k in range(toxicity.FOLDS):
                out[fold == k] = say(train[fold == k], newton(train[fold != k], y[fold != k, c], penalty))
            tried.append((-np.log(np.where(y[:, c] > 0, out, 1 - out)).sum(), penalty, out))
        _, penalty, out = min(tried, key=lambda r: r[0])
        p = say(every, newton(train, y[:, c], penalty))
        probabilities.append(p)
        train, every = np.column_stack([train, out]), np.column_stack([every, p])
    return np.array(probabilities).T


def test_toxicity_by_brute_force(spark):
    rng = random.Random(19)
    texts, labels = [], []
    for _ in range(400):
        rude, junk = rng.random() < 0.3, rng.random() < 0.4
        some = [rng.choice("abcdefghijklmnopqrst") for _ in range(12)]
        some += [rng.choice(["vile", "É"])] * (rude and rng.random() < 0.9) + ["click"] * (junk and rng.random() < 0.8) + ["vile"] * (rng.random() < 0.03)
        rng.shuffle(some)
        texts.append(", ".join(some).upper() if rng.random() < 0.2 else " ".join(some))
        labels.append((int(junk), int(rude or (junk and rng.random() < 0.2))))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], KIND).repartition(3)
    marks = spark.createDataFrame([(i, *l) for i, l in enumerate(labels) if i % 4], "doc_id long, junk int, rude int")
    out = sorted(toxicity.score_chain(docs, toxicity.fit_chain(docs, marks, ("junk", "rude"))).collect(), key=lambda r: r.doc_id)
    want = brute_chain(texts, labels, [i for i in range(400) if i % 4])
    assert np.allclose([(r.p_junk, r.p_rude) for r in out], want, atol=1e-4)
    assert want.std(0).min() > 0.1


# ---- 10 ------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        each = left / sum(w[s] for s in open_)
        over = {s for s in open_ if each * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: each * w[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, odd, none):
    rng = random.Random(10)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(["a", "a", "a", "B", "c", None, "é"])) for i in range(1500)] + [(2000, None, "a"), (2001, "  ", "zero")]
    df = spark.createDataFrame(rows, KIND + ", source string").withColumn("target", F.lit("clash"))
    out = mixing.pareto_mix(df)
    got = out.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.pareto_mix(df.repartition(5)).collect()))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 300
    assert mixing.pareto_mix(odd.withColumn("source", F.lit("x"))).count() == len(ODD) and mixing.pareto_mix(none.withColumn("source", F.lit("x"))).count() == 0


@pytest.mark.parametrize("ordered", [1, 4096])
def test_mixing_with_odds(spark, ordered, monkeypatch):
    """Unequal odds: every target is met to within a document, in one round of bins and in several, and rows without id are told apart."""
    monkeypatch.setattr(mixing, "ORDERED", ordered)
    rng = random.Random(20)
    rows = [(None if i % 5 == 0 else i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 5, 60, 300, 1200]))), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(900)]
    out = mixing.pareto_mix(spark.createDataFrame(rows, KIND + ", source string"), odds=mixing.length_odds(F.col("text"))).collect()
    taken, target = Counter(), {}
    for r in out:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 600 for s in target) and len(target) == 4
    none = [r.copies for r in out if r.doc_id is None and r.source == "a" and r.size > 100]
    assert len(set(none)) > 1
    rate = lambda low, high: (lambda c: sum(c) / len(c))([r.copies for r in out if r.source == "a" and low <= r.size < high])
    if target["a"] < 2 * sum(r.size for r in out if r.source == "a"):
        assert rate(0, 50) < rate(50, 1000) < rate(1000, 9999)


def test_mixing_prefers_heavy_documents(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), (1 + (F.col("id") % 2) * 3).alias("w"))
    out = mixing.pareto_mix(df, weights=(1, 1), share=0.5, odds=F.col("w"))
    share = {r.w: r.c for r in out.where("source = 'b'").groupBy("w").agg(F.avg("copies").alias("c")).collect()}
    assert share[4] > 2.5 * share[1]


# ---- the whole -----------------------------------------------------------------------------------------


def test_duplicates_stage_keeps_one(spark, sf_dir):
    """Of each group one row stays, whatever its ids: null, repeated on near copies, or whole rows repeated."""
    import corpus_pipeline

    rng = random.Random(21)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, d = (text() for _ in range(4))
    rows = [(None, " ".join(a)), (None, near(a)), (1, " ".join(b)), (1, near(b)), (1, near(b)), (5, " ".join(c)), (4, near(c)), (None, near(c)), (6, " ".join(d)), (6, " ".join(d)), (7, None), (8, ""), (9, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], KIND + ", `odd.name` int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert out.columns == docs.columns and [i for i, _ in got] == [0, 1, 4, 6, 7, 8, 9] and got[2][1] == near(c) and got[3][1] == " ".join(d)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), sf_dir).count() == 0


def test_stages_odd_rows(spark, odd, sf_dir):
    """Stages keep odd rows and odd column names; the mix takes no empty text."""
    import corpus_pipeline

    docs = odd.withColumnRenamed("score", "n.chars").withColumn("source", F.lit("x")).withColumn("lang", F.lit("en")).withColumn("target", F.lit(1))
    for f in (corpus_pipeline.decontaminate, corpus_pipeline.pseudonymise):
        assert f(spark, docs, sf_dir).columns == docs.columns and f(spark, docs, sf_dir).count() == len(ODD) and f(spark, docs.where("false"), sf_dir).count() == 0
    assert sorted(corpus_pipeline.identify_language(spark, docs, sf_dir).columns) == sorted(docs.columns)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert all(r.text and r.text.strip() for r in mixed.collect()) and corpus_pipeline.mix_sources(spark, docs.where("false"), sf_dir).count() == 0


def test_language_stage_without_languages(spark, odd, sf_dir):
    import corpus_pipeline

    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["4", "4", "5", "6", "None"]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    component = brute_components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if component[i][1] == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {d for d, _, n_hit, *_ in brute_hits(list(kept.items()), bench) if n_hit}
    clean = set(kept) - dirty
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} <= clean and len(out) == len({r.doc_id for r in out})
    stage, d = None, docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        d = f(spark, d, sf_dir)
        assert d.columns == docs.columns, name
        stage = d
    assert {r.doc_id for r in stage.select("doc_id").collect()} == clean
    # no window of a benchmark item is left in any text that comes out
    assert not any(n_hit for _, _, n_hit, *_ in brute_hits([(r.doc_id, r.text) for r in out], bench))

"""Statistics, matching, order and synthetic data."""

import io
import math
import queue
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.errors import DescribeError
from tessera.functions.bits import Bits, serialize_bitarray
from tessera.operators import match, order, stats, synth
from tessera.operators.encode import encode, generate_clks
from tessera.plans.schema import from_json_dict
from tests.schemas import people


def test_online_statistics():
    o = stats.OnlineMeanVariance()
    assert (o.mean(), o.variance(), o.std()) == (0, 0, 0)
    o.update([7.5])
    assert (o.mean(), o.variance()) == (7.5, 0)
    o = stats.OnlineMeanVariance()
    values = list(range(1000))
    for i in range(0, 1000, 50):
        o.update(values[i : i + 50])
    assert math.isclose(o.mean(), 499.5) and math.isclose(o.variance(), statistics.variance(values)) and math.isclose(o.std(), statistics.stdev(values))
    for bad in ([math.nan], [math.inf]):
        with pytest.raises(ValueError):
            o.update(bad)


def test_table_statistics(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 2, 7)], "popcount int")
    r = stats.popcount_stats(df).first()
    assert (r.n, r.mean) == (4, 3.0) and math.isclose(r.variance, statistics.variance([1, 2, 2, 7]))
    assert stats.popcount_stats(df.where("popcount = 1")).first()[1:] == (1.0, 0.0, 0.0)
    assert stats.popcount_stats(df.where("popcount > 9")).first() == (0, 0.0, 0.0, 0.0)
    assert {r.popcount: r.n for r in stats.popcount_histogram(df).collect()} == {1: 1, 2: 2, 7: 1}


def test_describe(spark):
    made = [Bits.of(random.Random(i).getrandbits(100), 100) for i in range(5)]
    text = [serialize_bitarray(b) for b in made]
    assert stats.get_encoding_popcounts(text) == [b.count() for b in made]
    assert [r.popcount for r in stats.encoding_popcounts(spark.createDataFrame([(t,) for t in text], "clk string")).collect()] == [b.count() for b in made]
    with pytest.raises(DescribeError, match="No clks found"):
        stats.get_encoding_popcounts([])
    with pytest.raises(DescribeError, match="Failed to deserialize encodings"):
        stats.get_encoding_popcounts(["a"])


def vectors(spark, seed, n, base):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        mask = base[i % len(base)]
        for _ in range(rng.randint(0, 6)):
            mask ^= 1 << rng.randrange(128)
        rows.append((i, Bits.of(mask, 128).data))
    return rows, spark.createDataFrame(rows, "row_id long, clk binary")


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_dice_join(spark, threshold):
    rng = random.Random(8)
    base = [rng.getrandbits(128) for _ in range(10)] + [0]
    a, left = vectors(spark, 1, 60, base)
    b, right = vectors(spark, 2, 70, base)
    want = {}
    for i, x in a:
        for j, y in b:
            p, q = int.from_bytes(x, "big"), int.from_bytes(y, "big")
            n = p.bit_count() + q.bit_count()
            if p and q and 2 * (p & q).bit_count() / n >= threshold:
                want[i, j] = 2 * (p & q).bit_count() / n
    found = match.dice_join(left, right, threshold, blocks=3)
    assert {(r.left_id, r.right_id): pytest.approx(r.dice) for r in found.collect()} == want
    one = match.greedy_matching(found.persist()).collect()
    assert len({r.left_id for r in one}) == len(one) == len({r.right_id for r in one})
    with pytest.raises(ValueError):
        match.dice_join(left, right, 0)


def test_dice_join_over_several_partitions(spark):
    rows, df = vectors(spark, 3, 90, [random.Random(9).getrandbits(128)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = match.dice_join(df, df, 0.5, blocks=4).where("left_id = right_id").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == sum(any(x) for _, x in rows)


def test_quality(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "left_id long, right_id long")
    r = match.precision_recall(pairs((1, 1), (2, 2), (3, 4)), pairs((1, 1), (2, 2), (3, 3), (4, 4))).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 2) and math.isclose(r.precision, 2 / 3) and r.recall == 0.5


def test_overlap_end_to_end(spark):
    """Two lists that share 80 of 100 people share at least 80 encodings."""
    names = synth.NameList(300, seed=5)
    one, two = names.generate_subsets(100, 0.8)
    schema = from_json_dict(people())
    a, b = (set(generate_clks(rows, schema, "s")) for rows in (one, two))
    assert len(set(one) & set(two)) == 80 and len(a & b) >= 79
    with pytest.raises(ValueError):
        names.generate_subsets(300, 0.5)


def test_generated_tables(spark):
    df = synth.generate_people(spark, 200, seed=3, year=2020)
    rows = df.orderBy("row_id").collect()
    assert rows == synth.generate_people(spark, 200, seed=3, year=2020, partitions=3).orderBy("row_id").collect()
    assert {r["GENDER M or F"] for r in rows} == {"M", "F"} and all(len(r["NAME freetext"]) >= 3 for r in rows)
    assert encode(df, synth.people_schema(), "s").where("popcount > 0").count() == 200
    parts = synth.overlapping_subsets(df, 50, 0.5, 3)
    ids = [{r.row_id for r in p.collect()} for p in parts]
    assert all(len(i) == 50 for i in ids) and all(len(ids[x] & ids[y]) == 25 for x in range(3) for y in range(x))
    with pytest.raises(ValueError):
        synth.overlapping_subsets(df, 200, 0.5)


def test_distributions(spark, tmp_path):
    d = synth.Distribution([("a", 2), ("b", 8)])
    counts = {v: 0 for v in "ab"}
    rng = random.Random(1)
    for _ in range(5000):
        counts[d.generate(rng)] += 1
    assert 0.17 < counts["a"] / 5000 < 0.23
    out = spark.range(10).select(d.column((F.col("id") + 0.5) / 10).alias("v")).collect()
    assert [r.v for r in out] == ["a"] * 2 + ["b"] * 8
    (tmp_path / "good.csv").write_text("Age,Count\n0,5\n1,7\n")
    assert synth.Distribution(str(tmp_path / "good.csv")).total == 12
    (tmp_path / "dirty.csv").write_text("a,b\nx,y\n")
    (tmp_path / "empty.csv").write_text("a,b\n")
    for name in ("dirty", "empty", "absent"):
        with pytest.raises(ValueError):
            synth.Distribution(str(tmp_path / f"{name}.csv"))
    assert synth.random_date(2000, synth.Distribution([("10", 1)])).year == 1990
    for bad in (None, synth.Distribution([("x", 1)])):
        with pytest.raises(ValueError):
            synth.random_date(2000, bad)
    f = io.StringIO()
    synth.save_csv([(1, "a,b")], ["x", "y z"], f)
    assert f.getvalue().splitlines() == ["x,y z", '1,"a,b"']


def test_queues():
    rng = random.Random(2)
    items = [(f"r{i}", i) for i in range(20)]
    rng.shuffle(items)
    q = queue.Queue()
    order.iterable_to_queue(items, q, number_of_sentinels=3)
    assert [i for _, i in order.queue_to_sorted_iterable(q, 3)] == list(range(20))
    q = queue.Queue()
    order.iterable_to_queue([("a", 5), ("b", 2), ("c", 9)], q)
    assert [i for _, i in order.queue_to_sorted_iterable(q, 1)] == [2, 5, 9]


def test_chunk_numbers(spark):
    df = spark.range(25).withColumnRenamed("id", "row_id")
    assert {r.row_id: r.chunk for r in order.numbered_chunks(df, 10).collect()} == {i: i // 10 for i in range(25)}
    assert [r.row_id for r in order.in_row_order(df.repartition(3)).collect()] == list(range(25))
    with pytest.raises(ValueError):
        order.numbered_chunks(df, 0)


def test_dice_join_stores_no_more_for_more_blocks(spark, monkeypatch):
    """Copies of an encoding are compared once, also where its ids are cut into pieces; null ids stay; nothing is shuffled for pairs of blocks."""
    monkeypatch.setattr(match, "IDS", 7)
    monkeypatch.setattr(match, "ENTRIES", 50)
    rng = random.Random(4)
    kinds = [rng.getrandbits(64) for _ in range(3)]
    rows = [(None if i == 5 else i, Bits.of(kinds[i * i % 3], 64).data) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, clk binary")
    found = match.dice_join(df, df, 1.0, blocks=5, digits=9)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    key = lambda pair: tuple(-1 if x is None else x for x in pair)
    assert sorted(key(r[:2]) for r in found.collect()) == sorted(key((i, j)) for i, a in rows for j, b in rows if a == b)


def test_dice_is_rounded_half_up(spark):
    """As Spark rounds, also where a five is the last digit."""
    n = 1024
    whole, part = Bits.of((1 << n) - 1, n).data, [Bits.of((1 << k) - 1, n).data for k in (867, 869, 871, 1023)]
    left, right = spark.createDataFrame([(0, whole)], "row_id long, clk binary"), spark.createDataFrame(list(enumerate(part)), "row_id long, clk binary")
    exact = match.dice_join(left, right, 0.1).select("right_id", F.round("dice", 9).alias("dice")).collect()
    assert sorted(exact) == sorted(match.dice_join(left, right, 0.1, digits=9).select("right_id", "dice").collect()) and len(exact) == 4


@pytest.mark.parametrize("repeated", [False, True])
def test_dice_quality_makes_no_pairs(spark, monkeypatch, repeated):
    """The same as precision and recall of the pairs; where no id is repeated or null, pairs are not made."""
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(5)] + [0]
    a, b = vectors(spark, 6, 50, base)[0], vectors(spark, 7, 60, base)[0]
    if repeated:
        a, b = [(i % 40 or None, x) for i, x in a], [(i % 45, x) for i, x in b]
    left, right = (spark.createDataFrame(x, "row_id long, clk binary") for x in (a, b))
    truth = spark.createDataFrame([(i, i) for i in range(70)] + [(3, 4), (3, 4)], "left_id long, right_id long")
    want = match.precision_recall(match.dice_join(left, right, 0.8), truth).first()
    if not repeated:
        monkeypatch.setattr(match, "dice_join", None)
    assert match.dice_quality(left, right, 0.8, truth).first() == want and want.tp and want.fp and want.fn


def test_equal_encodings_of_many_rows_are_dealt(spark, monkeypatch):
    """Pairs of one encoding are made by many tasks; null ids stay, null encodings meet nothing."""
    monkeypatch.setattr(match, "IDS", 2)
    rows = [(i if i else None, b"a" if i < 120 else b"b") for i in range(130)] + [(500, None)]
    df = spark.createDataFrame(rows, "row_id long, clk binary")
    found = match.exact_matches(df, df)
    key = lambda pair: tuple(-1 if x is None else x for x in pair)
    assert sorted(key(r) for r in found.collect()) == sorted(key((i, j)) for i, a in rows for j, b in rows if a == b and a)
    assert found.where("left_id < 120 and left_id > 0").groupBy(F.spark_partition_id()).count().count() > 4

"""Every registered query of the encoder against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in names)} FROM ({catalogue.ORACLE_SQL[name]})")
    assert rows == sorted(str(tuple(r)) for r in found.fetchall())


def bit_places(rows):
    """Customers' places of ones by SQL, apart from the encoder."""
    c = duckdb.connect()
    c.register("given", rows)
    c.sql("CREATE VIEW customer AS SELECT row_id::BIGINT AS c_custkey, c_name, c_nationkey::INT AS c_nationkey, c_mktsegment FROM given")
    return {i: set(p) for i, p in c.sql(f"{catalogue.CLK_CTES} SELECT id, list(p) FROM pos GROUP BY id").fetchall()}


def similar(left, right):
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    return {(i, j): dice(a, b) for i, a in left.items() for j, b in right.items() if dice(a, b) >= 0.8}


def test_dice_join_of_all_customers(spark, sf_dir):
    places = bit_places(catalogue.customers(spark, sf_dir).toPandas())
    want = similar(places, places)
    found = {(r.left_id, r.right_id): r.dice for r in catalogue.dice_join(spark, sf_dir).collect()}
    assert len(places) == 150 and found == {k: round(v, 9) for k, v in want.items()} and len(found) > 150


def test_match_quality_of_all_customers(spark, sf_dir):
    left, right = (bit_places(f(spark, sf_dir).toPandas()) for f in (catalogue.customers, catalogue.recorded_again))
    want = set(similar(left, right))
    tp = len({(i, i) for i in left} & want)
    r, = catalogue.match_quality(spark, sf_dir).collect()
    assert (r.tp, r.fp, r.fn) == (tp, len(want) - tp, 150 - tp) and r.recall == round(tp / 150, 9) and r.precision == round(tp / len(want), 9)
    assert 0 < r.fn < 150 and r.fp > 0


@pytest.mark.parametrize("engine", ["arrow", "native"])
def test_encoding_is_dealt_over_all_cores(spark, sf_dir, engine):
    """The customers lie in one file of one row group, which one task reads."""
    held = catalogue.encoded(spark, sf_dir, engine=engine).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 4 and max(r["count"] for r in held) < 150 // 4


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["row_id", "clk", "popcount"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

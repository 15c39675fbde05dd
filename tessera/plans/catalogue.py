"""The registered queries of the encoder over the driver's tables, each with DuckDB SQL where SQL can express it.

All queries read whole tables. Results are whole numbers and strings, or rounded doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bits, hashing
from tessera.functions.keys import hkdf
from tessera.functions.strategies import BitsPerFeatureStrategy, BitsPerTokenStrategy, StrategySpec
from tessera.functions.tokens import AbstractComparison, ExactComparison, NgramComparison, NumericComparison
from tessera.operators import match, order, stats, synth
from tessera.operators.encode import dealt, derive_keys, encode
from tessera.operators.validate import invalid_entries
from tessera.plans.fields import DateSpec, EnumSpec, FieldHashingProperties, FieldSpec, Ignore, IntegerSpec, MissingValueSpec, StringSpec
from tessera.plans.schema import Schema

SECRET = "a secret for the registered queries only"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(comparator: AbstractComparison, strategy: StrategySpec, missing: MissingValueSpec | None = None, encoding: str = "utf-8", kind: str = "doubleHash", non_singular: bool | None = None) -> FieldHashingProperties:
    return FieldHashingProperties(comparator, strategy, encoding, kind, non_singular, missing)


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, "|")


# ---- the customer schema -------------------------------------------------------------------------------


def customer_schema(l: int = 1024, folds: int = 0, per_feature: bool = False, kind: str = "doubleHash") -> Schema:
    """custkey ignored; name bigrams, nation exact, segment unigrams by place."""
    count = lambda token, feature: BitsPerFeatureStrategy(feature) if per_feature else BitsPerTokenStrategy(token)
    return Schema(
        [
            Ignore("c_custkey"),
            StringSpec("c_name", hashed(NgramComparison(2), count(10, 100), kind=kind), regex=r"Customer#[0-9]{9}"),
            IntegerSpec("c_nationkey", hashed(ExactComparison(), count(20, 40), kind=kind), minimum=0, maximum=24),
            EnumSpec("c_mktsegment", hashed(NgramComparison(1, True), count(8, 90), kind=kind), SEGMENTS),
        ],
        l, folds,
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id and the schema's columns as strings."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), *[F.col(c).cast("string") for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")])


def encoded(spark: SparkSession, sf_dir: str, schema: Schema | None = None, engine: str = "arrow") -> DataFrame:
    return encode(dealt(customers(spark, sf_dir)), schema or customer_schema(), SECRET, engine=engine)


# ---- SQL pieces ----------------------------------------------------------------------------------------


def blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def sql_hmac(message: str, key: bytes, name: str) -> str:
    inner, outer = hashing.hmac_pads(key, name)
    return f"{name}({blob(outer)} || unhex({name}({blob(inner)} || {message})))"


def sql_hash(message: str, key: bytes, name: str, l: int) -> str:
    """HMAC modulo a power of two up to 2**32."""
    return f"(('0x' || right({sql_hmac(message, key, name)}, 8))::UBIGINT % {l})::BIGINT"


def sql_ngrams(c: str, n: int, positional: bool = False) -> str:
    pad = " " * (n - 1)
    gram = f"substr('{pad}' || {c} || '{pad}', i, {n})"
    return f"list_transform(range(1, length({c}) + {n}), lambda i: {'i || chr(32) || ' if positional else ''}{gram})"


def sql_numeric(v: str, step: int, resolution: int) -> str:
    """Tokens around v, which is scaled already (without the factor 2 * resolution)."""
    v = f"({v} * {2 * resolution})"
    rest = f"(({v} % {step}) + {step}) % {step}"
    middle = f"({v} - {rest} + CASE WHEN {rest} <> 0 AND 2 * ({rest}) >= {step} THEN {step} ELSE 0 END)"
    return f"array_to_string(list_transform(range(-{resolution}, {resolution} + 1), lambda i: ({middle} + i * {step})::BIGINT::VARCHAR), '|')"


def sql_customer_positions(l: int, per_feature: bool = False) -> str:
    """CTE ``pos``: id and every position of every token of the customer schema."""
    keys = derive_keys(customer_schema(), SECRET)
    fields = ((1, sql_ngrams("c_name", 2), 10, 100), (2, "[c_nationkey::VARCHAR]", 20, 40), (3, sql_ngrams("c_mktsegment", 1, True), 8, 90))
    parts = []
    for place, tokens, each, total in fields:
        count = f"({total} // n + CASE WHEN j < {total} % n THEN 1 ELSE 0 END)" if per_feature else str(each)
        a, b = sql_hash("encode(t)", keys[place][0], "sha1", l), sql_hash("encode(t)", keys[place][1], "md5", l)
        parts.append(f"SELECT id, {count} AS k, {a} AS a, {b} AS b FROM (SELECT id, len(ts) AS n, unnest(ts) AS t, unnest(range(len(ts))) AS j FROM (SELECT c_custkey AS id, {tokens} AS ts FROM customer))")
    return f"h AS ({' UNION ALL '.join(parts)}), pos AS (SELECT DISTINCT id, (a + i * b) % {l} AS p FROM (SELECT id, a, b, unnest(range(k)) AS i FROM h))"


def sql_packed(source: str, l: int) -> str:
    """CTE ``clk``: id, base64 and popcount of the distinct positions (id, p) of ``source``."""
    return (
        f"word AS (SELECT id, g, coalesce(bit_or(CASE WHEN p IS NULL THEN 0::UBIGINT ELSE 1::UBIGINT << (63 - p % 64)::UBIGINT END), 0) AS v FROM (SELECT DISTINCT id FROM {source}) CROSS JOIN (SELECT unnest(range({l // 64})) AS g) LEFT JOIN {source} s USING (id) "
        "WHERE s.p IS NULL OR s.p // 64 = g GROUP BY id, g), "
        f"filled AS (SELECT id, g, coalesce(v, 0::UBIGINT) AS v FROM (SELECT DISTINCT id FROM {source}) CROSS JOIN (SELECT unnest(range({l // 64})) AS g) LEFT JOIN word USING (id, g)), "
        "clk AS (SELECT id, base64(unhex(string_agg(format('{:016x}', v), '' ORDER BY g))) AS clk, sum(bit_count(v))::BIGINT AS popcount FROM filled GROUP BY id)"
    )


CLK_CTES = f"WITH {sql_customer_positions(1024)}, {sql_packed('pos', 1024)}"
PER_FEATURE_CTES = f"WITH {sql_customer_positions(1024, True)}, {sql_packed('pos', 1024)}"
FOLDED_CTES = f"WITH {sql_customer_positions(2048)}, fold AS (SELECT id, p % 512 AS p FROM pos GROUP BY id, p % 512 HAVING count(*) % 2 = 1), {sql_packed('fold', 512)}"


# ---- tokens --------------------------------------------------------------------------------------------


def _part_names(n: int) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", joined(NgramComparison(n).column(F.col("p_name"))).alias("tokens"))


for _n, _name in ((1, "ngram_unigram"), (2, "ngram_bigram"), (3, "ngram_trigram")):
    QUERIES[_name] = _part_names(_n)
    ORACLE_SQL[_name] = f"SELECT p_partkey, array_to_string({sql_ngrams('p_name', _n)}, '|') AS tokens FROM part"


@query(f"SELECT o_orderkey, array_to_string({sql_ngrams('d', 1, True)}, '|') AS tokens FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)")
def ngram_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("d")).select("o_orderkey", joined(NgramComparison(1, True).column(F.col("d"))).alias("tokens"))


@query("SELECT c_custkey, c_mktsegment AS tokens, CASE WHEN c_mktsegment = '' THEN 0 ELSE 1 END AS n_tokens FROM customer")
def exact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = ExactComparison().column(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", joined(tokens).alias("tokens"), F.size(tokens).alias("n_tokens"))


@query(f"SELECT p_partkey, {sql_numeric('p_size', 8, 2)} AS tokens FROM part")
def numeric_tokens_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", joined(NumericComparison(8, 2).column(F.col("p_size").cast("string"))).alias("tokens"))


@query(f"SELECT c_custkey, {sql_numeric('v', 550, 3)} AS tokens FROM (SELECT c_custkey, round(c_acctbal * 100)::BIGINT AS v FROM customer)")
def numeric_tokens_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", joined(NumericComparison(5.5, 3, 2).column(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))).alias("tokens"))


def _counts(strategy: StrategySpec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = table(spark, sf_dir, "part").select("p_partkey", NgramComparison(2).column(F.col("p_name")).alias("t"))
        return tokens.select("p_partkey", joined(F.transform("t", lambda t, i: strategy.column(i, F.size("t")).cast("string"))).alias("counts"))

    return run


QUERIES["bits_per_token"] = _counts(BitsPerTokenStrategy(20))
ORACLE_SQL["bits_per_token"] = "SELECT p_partkey, array_to_string(list_transform(range(length(p_name) + 1), lambda i: '20'), '|') AS counts FROM part"
QUERIES["bits_per_feature"] = _counts(BitsPerFeatureStrategy(200))
ORACLE_SQL["bits_per_feature"] = "SELECT p_partkey, array_to_string(list_transform(range(n), lambda i: (200 // n + CASE WHEN i < 200 % n THEN 1 ELSE 0 END)::VARCHAR), '|') AS counts FROM (SELECT p_partkey, length(p_name) + 1 AS n FROM part)"


# ---- normal forms and missing values -------------------------------------------------------------------

_ANY = hashed(ExactComparison(), BitsPerTokenStrategy(10))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders")
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = DateSpec("day", _ANY, "%d/%m/%Y")
    return table(spark, sf_dir, "orders").select("o_orderkey", field.format_column(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN (-c_custkey)::VARCHAR ELSE c_custkey::VARCHAR END AS number FROM customer")
def normalize_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.lit("  "), F.when(F.col("c_custkey") % 2 == 1, "-00").otherwise("+00"), F.col("c_custkey").cast("string"), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", IntegerSpec("number", _ANY).format_column(written).alias("number"))


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS missing, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NONE' ELSE c_mktsegment END AS value FROM customer")
def missing_value_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = EnumSpec("segment", hashed(ExactComparison(), BitsPerTokenStrategy(10), MissingValueSpec("BUILDING", "NONE")), SEGMENTS)
    c = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", (c == "BUILDING").alias("missing"), field.format_column(c).alias("value"))


# ---- validation ----------------------------------------------------------------------------------------


def _valid(name: str, key: str, value: str, field: FieldSpec) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, name).select(key, (~field.invalid_column(F.expr(value))).alias("valid"))


def _check(name: str, key: str, value: str, field: FieldSpec, registered: str, sql: str) -> None:
    QUERIES[registered] = _valid(name, key, value, field)
    ORACLE_SQL[registered] = f"SELECT {key}, {sql} AS valid FROM {name}"


_check("customer", "c_custkey", "c_name", StringSpec("n", _ANY, regex=r"Customer#[0-9]{6}[0-4]{3}"), "validate_regex", "regexp_full_match(c_name, 'Customer#[0-9]{6}[0-4]{3}')")
_check("part", "p_partkey", "p_name", StringSpec("n", _ANY, min_length=9, max_length=10), "validate_length", "length(p_name) BETWEEN 9 AND 10")
_check("part", "p_partkey", "p_type", StringSpec("n", _ANY, case="upper"), "validate_case", "upper(p_type) = p_type")
_check("part", "p_partkey", "p_name", StringSpec("n", _ANY, case="upper"), "validate_case_upper", "upper(p_name) = p_name")
_check("part", "p_partkey", "string(p_size)", IntegerSpec("n", _ANY, minimum=10, maximum=30), "validate_integer", "p_size BETWEEN 10 AND 30")
_check("part", "p_partkey", "p_brand", IntegerSpec("n", _ANY), "validate_integer_text", "try_cast(p_brand AS BIGINT) IS NOT NULL")
_check("customer", "c_custkey", "c_mktsegment", EnumSpec("n", _ANY, SEGMENTS[:3]), "validate_enum", "c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')")
_check("documents", "doc_id", "coalesce(text, '')", StringSpec("n", hashed(ExactComparison(), BitsPerTokenStrategy(1), encoding="ascii")), "validate_encoding", "strlen(coalesce(text, '')) = length(coalesce(text, ''))")
_check("customer", "c_custkey", "concat('2017-02-', lpad(string(c_custkey % 40), 2, '0'))", DateSpec("n", _ANY, "%Y-%m-%d"), "validate_date", "try_strptime('2017-02-' || lpad((c_custkey % 40)::VARCHAR, 2, '0'), '%Y-%m-%d') IS NOT NULL")
_check("customer", "c_custkey", "c_mktsegment", EnumSpec("n", hashed(ExactComparison(), BitsPerTokenStrategy(1), MissingValueSpec("MACHINERY")), SEGMENTS[:2]), "validate_sentinel", "c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')")


def _strict_schema() -> Schema:
    return Schema(
        [Ignore("c_custkey"), StringSpec("c_name", _ANY, regex=r"Customer#[0-9]{8}[0-7]"), IntegerSpec("c_nationkey", _ANY, maximum=20), EnumSpec("c_mktsegment", _ANY, SEGMENTS[:4])], 1024
    )


_INVALID = "SELECT c_custkey AS row_id, CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]{8}[0-7]') THEN 'c_name' WHEN c_nationkey > 20 THEN 'c_nationkey' WHEN c_mktsegment = 'MACHINERY' THEN 'c_mktsegment' END AS \"column\" FROM customer"


@query(f"SELECT * FROM ({_INVALID}) WHERE \"column\" IS NOT NULL")
def all_invalid_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_entries(customers(spark, sf_dir), _strict_schema())


@query(f"SELECT * FROM ({_INVALID}) WHERE \"column\" IS NOT NULL ORDER BY row_id LIMIT 1")
def first_invalid_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = invalid_entries(customers(spark, sf_dir), _strict_schema())
    return found.agg(F.min_by(F.struct("row_id", "column"), "row_id").alias("e")).select("e.row_id", "e.column")


@query("SELECT c_custkey AS row_id, c_name FROM customer")
def column_prune_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a table whose other columns are ignored."""
    schema = Schema([Ignore("c_custkey"), StringSpec("c_name", _ANY), Ignore("c_nationkey"), Ignore("c_mktsegment")], 1024)
    return customers(spark, sf_dir).select("row_id", *[f.identifier for f in schema.fields if f.hashing_properties is not None])


# ---- hashing and filters -------------------------------------------------------------------------------

_KEYS = hkdf(SECRET.encode(), 2)


def _positions(non_singular: bool, l: int, k: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = table(spark, sf_dir, "part").select(F.explode(NgramComparison(2).column(F.col("p_name"))).alias("token")).distinct()
        return tokens.select("token", joined(hashing.double_hash_column(F.col("token"), F.lit(k), _KEYS, l, non_singular).cast("array<string>")).alias("positions"))

    return run


def _sql_positions(non_singular: bool, l: int, k: int) -> str:
    b = sql_hash("encode(t)", _KEYS[1], "md5", l)
    if non_singular:
        b = "coalesce(" + ", ".join([f"nullif({b}, 0)", *[f"nullif({sql_hash(f'encode(t || chr({i}))' if i else 'encode(t) || ' + blob(bytes(1)), _KEYS[1], 'md5', l)}, 0)" for i in range(hashing.RETRIES)], "0"]) + ")"
    return (
        f"SELECT t AS token, array_to_string(list_transform(range({k}), lambda i: ((a + i * b) % {l})::VARCHAR), '|') AS positions FROM (SELECT t, {sql_hash('encode(t)', _KEYS[0], 'sha1', l)} AS a, {b} AS b "
        f"FROM (SELECT DISTINCT unnest({sql_ngrams('p_name', 2)}) AS t FROM part))"
    )


QUERIES["double_hash_positions"] = _positions(False, 1024, 20)
ORACLE_SQL["double_hash_positions"] = _sql_positions(False, 1024, 20)
#: A short filter, so that rehashing happens.
QUERIES["double_hash_nonsingular"] = _positions(True, 16, 4)
ORACLE_SQL["double_hash_nonsingular"] = _sql_positions(True, 16, 4)


def _text(df: DataFrame) -> DataFrame:
    return df.select("row_id", bits.to_base64(F.col("clk")).alias("clk"), F.col("popcount").cast("long").alias("popcount"))


_CLK = "SELECT id AS row_id, clk, popcount FROM clk"


@query(f"{CLK_CTES} {_CLK}")
def clk_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every customer's encoding."""
    return _text(encoded(spark, sf_dir))


@query(f"{CLK_CTES} {_CLK}")
def clk_base64_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(encoded(spark, sf_dir, engine="native"))


@query(f"{PER_FEATURE_CTES} {_CLK}")
def clk_bits_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(encoded(spark, sf_dir, customer_schema(per_feature=True)))


@query(f"{FOLDED_CTES} {_CLK}")
def xor_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(encoded(spark, sf_dir, customer_schema(512, 2)))


@query(f"{FOLDED_CTES} {_CLK}")
def xor_fold_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(encoded(spark, sf_dir, customer_schema(512, 2), "native"))


@query()
def blake_clk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(encoded(spark, sf_dir, customer_schema(kind="blakeHash")))


@query()
def hkdf_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each derived key of the customer schema."""
    keys = derive_keys(customer_schema(), SECRET)
    return spark.createDataFrame([(i, j, k.hex()) for i, pair in enumerate(keys) for j, k in enumerate(pair)], "field int, method int, key string")


# ---- statistics, matching, order, sampling -------------------------------------------------------------


@query(f"{CLK_CTES} SELECT count(*) AS n, round(avg(popcount), 6) AS mean, round(var_samp(popcount), 6) AS variance, round(stddev_samp(popcount), 6) AS std FROM clk")
def popcount_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.popcount_stats(encoded(spark, sf_dir)).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "std")])


@query(f"{CLK_CTES} SELECT popcount, count(*) AS n FROM clk GROUP BY popcount")
def popcount_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.popcount_histogram(_text(encoded(spark, sf_dir)))


@query(f"{CLK_CTES} SELECT id AS row_id, popcount FROM clk")
def base64_roundtrip_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.encoding_popcounts(_text(encoded(spark, sf_dir)).select("row_id", "clk")).select("row_id", F.col("popcount").cast("long").alias("popcount"))


def _segment_schema() -> Schema:
    return Schema([Ignore("row"), IntegerSpec("nation", hashed(ExactComparison(), BitsPerTokenStrategy(20))), EnumSpec("segment", hashed(NgramComparison(2), BitsPerTokenStrategy(10)), SEGMENTS)], 1024)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers by nation and segment, odd and even keys apart; many share an encoding."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").cast("string").alias("row"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    even, odd = (encode(dealt(rows.where(f"row_id % 2 = {x}")), _segment_schema(), SECRET) for x in (0, 1))
    return even, odd


@query("SELECT a.c_custkey AS left_id, b.c_custkey AS right_id FROM customer a JOIN customer b USING (c_nationkey, c_mktsegment) WHERE a.c_custkey % 2 = 0 AND b.c_custkey % 2 = 1")
def exact_clk_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.exact_matches(*_halves(spark, sf_dir))


@query("SELECT count(*) AS n FROM (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 INTERSECT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1)")
def common_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.common_encodings(*_halves(spark, sf_dir)).agg(F.count("*").alias("n"))


@query()
def dice_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of customers, each with itself too, whose encodings have a Dice coefficient of at least 0.8."""
    made = encoded(spark, sf_dir)
    return match.dice_join(made, made, 0.8, digits=9)


def recorded_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as a second source has them, with faults by key: of 12, one has another segment and nation, three have two wrong digits in the name, two another nation."""
    case, key = F.col("row_id") % 12, F.col("row_id")
    digit = lambda at: F.pmod(F.substring("c_name", at, 1).cast("int") + 1 + key % 9, F.lit(10)).cast("string")
    name = F.concat(F.substring("c_name", 1, 13), digit(14), F.substring("c_name", 15, 2), digit(17), F.substring("c_name", 18, 1))
    nation = F.pmod(F.col("c_nationkey").cast("int") + 1 + key % 24, F.lit(25)).cast("string")
    names = F.array(*map(F.lit, SEGMENTS))
    segment = F.get(names, F.pmod(F.array_position(names, F.col("c_mktsegment")) + key % 4, F.lit(len(SEGMENTS))).cast("int"))
    return customers(spark, sf_dir).select("row_id", "c_custkey", F.when(case.isin(1, 5, 9), name).otherwise(F.col("c_name")).alias("c_name"), F.when(case.isin(0, 3, 7), nation).otherwise(F.col("c_nationkey")).alias("c_nationkey"), F.when(case == 0, segment).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


@query()
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a Dice coefficient of 0.8 finds each customer's own row in a second, faulty source."""
    again = encode(dealt(recorded_again(spark, sf_dir)), customer_schema(), SECRET)
    truth = customers(spark, sf_dir).select(F.col("row_id").alias("left_id"), F.col("row_id").alias("right_id"))
    found = match.dice_quality(encoded(spark, sf_dir), again, 0.8, truth)
    return found.select("tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("SELECT c_custkey AS row_id, c_custkey // 100 AS chunk FROM customer")
def row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.numbered_chunks(customers(spark, sf_dir), 100).select("row_id", "chunk")


@query(
    "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey) - 1 AS n FROM customer) "
    "SELECT 0 AS subset, c_custkey AS row_id FROM r WHERE n < 80 OR (n >= 80 AND n < 100) UNION ALL SELECT 1, c_custkey FROM r WHERE n < 80 OR (n >= 100 AND n < 120)"
)
def overlap_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two subsets of 100 rows with 80 in common: a sampling operator, whose size is its parameter."""
    parts = synth.overlapping_subsets(customers(spark, sf_dir), 100, 0.8, 2, F.md5(F.col("row_id").cast("string").cast("binary")))
    return parts[0].select(F.lit(0).alias("subset"), "row_id").unionByName(parts[1].select(F.lit(1).alias("subset"), "row_id"))


_WEIGHTS = (("a", 2), ("b", 8), ("c", 5))


@query("SELECT c_custkey, CASE WHEN u < 2 THEN 'a' WHEN u < 10 THEN 'b' ELSE 'c' END AS value FROM (SELECT c_custkey, (c_custkey * 7919) % 15 AS u FROM customer)")
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    uniform = ((F.col("c_custkey") * 7919) % 15 + 0.5) / 15
    return table(spark, sf_dir, "customer").select("c_custkey", synth.Distribution(_WEIGHTS).column(uniform).alias("value"))


@query()
def generated_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many people as there are customers, with their encodings."""
    people = synth.generate_people(spark, table(spark, sf_dir, "customer").count(), seed=1, year=2020)
    return _text(encode(people, synth.people_schema(), SECRET))

"""The registered queries: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, ctw, decontam, jaccard, langid, license, mixing, pii, toxicity, urlfilter
from tessera.llm.common import held_bucket

#: The rules of the URL query (host, path, verdict).
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Sites whose pages the block list names.
LISTED_SITES = ("spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Counts common shingles of one text of each set, and follows links by recursion.
SQL_OP2 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY r
), c AS (
  SELECT h, count(*) AS copies, min(r) AS r FROM n GROUP BY h
), x AS (
  SELECT r, g, n FROM s JOIN n USING (r) WHERE r IN (SELECT r FROM c)
), l AS (
  SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.g = b.g AND a.r <> b.r AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), t(a, b) AS (
  SELECT r, r FROM c UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a
), f AS (
  SELECT h, min(doc_id) AS doc_id FROM n JOIN d USING (r) GROUP BY h
), m AS (
  SELECT t.a AS r, min(f.doc_id) AS component FROM t JOIN c ON c.r = t.b JOIN f USING (h) GROUP BY t.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE m.component END AS component_id, coalesce(c.copies, 1)::BIGINT AS n_copies
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN c ON c.h = n.h LEFT JOIN m ON m.r = c.r
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = pages.where(F.col("url").rlike(rf"://(?:[a-z]+\.)?(?:{'|'.join(LISTED_SITES)})\.example\.")).select("url")
    return urlfilter.url_filter(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


SQL_OP3 = rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rh, rp, rv) AS (VALUES {", ".join(str(r) for r in URL_RULES)}), m AS (
  SELECT *, (SELECT max(struct_pack(n := length(rh || rp), rule := rh || rp, v := rv)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM p
)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.v, CASE WHEN regexp_matches(url, '://([a-z]+\.)?({"|".join(LISTED_SITES)})\.example\.') THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""


#: The key of the registered query only; a deployment passes its own secret.
PII_KEY = "demonstration key"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near"
    )


#: Joins texts and items by windows, and items' rarest terms by distance; words by the contract.
SQL_OP5 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), q AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), h AS (
  SELECT r, i, item_id, q.n FROM (
    SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)
  ) x JOIN q ON x.p = q.p AND x.n = q.n
), c AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r
), tok AS (
  SELECT r, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d
), ik AS (
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS nth, bool_or(n IS NULL) OVER (PARTITION BY item_id) AS missing
  FROM (SELECT DISTINCT item_id, unnest(w) AS term FROM b) LEFT JOIN (SELECT term, count(*) AS n FROM tok GROUP BY term) USING (term)
), pl AS (
  SELECT r, pos, item_id, nth, terms FROM tok JOIN (SELECT *, max(nth) OVER (PARTITION BY item_id) AS terms FROM ik WHERE NOT missing AND nth <= 3) USING (term)
), nr AS (
  SELECT r, count(DISTINCT item_id) AS n_near FROM (
    SELECT x.r, x.item_id FROM pl x JOIN pl y ON x.r = y.r AND x.item_id = y.item_id AND x.nth = 1 AND abs(x.pos - y.pos) <= 26
    GROUP BY x.r, x.item_id, x.pos, x.terms HAVING count(DISTINCT y.nth) = x.terms
  ) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r) LEFT JOIN nr USING (r)
"""


def op6_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ctw.ctw_scores(docs, held_bucket(F.col("doc_id")) == 1)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_bucket(F.col("doc_id")) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = langid.learn(docs.where(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit_chain(docs, labels, ("low_quality", "toxic"))
    return toxicity.score_chain(docs, chain).select("doc_id", "p_low_quality", "p_toxic", "is_low_quality", F.col("is_toxic").alias("toxic"), F.col("p_toxic").alias("score"))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.pareto_mix(docs, odds=mixing.length_odds(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: Targets by dealing again until none is above, level by the odds' sums, ranks and the cut by one sort of each source.
SQL_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), n AS (
  SELECT *, CASE WHEN size < 50 THEN 0.5::DOUBLE WHEN size < 1000 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
    md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS name FROM d
), z AS (
  SELECT source, source_size, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), r(turn, source, source_size, w, capped) AS (
  SELECT 0, source, source_size, w, false FROM z
  UNION ALL
  SELECT turn + 1, source, source_size, w, capped OR w * (1.5 * sum(source_size) OVER () - sum(CASE WHEN capped THEN 2.0 * source_size ELSE 0 END) OVER ())::DOUBLE
    > 2.0 * source_size * (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE FROM r WHERE turn < 50
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN source_size * 2.0::DOUBLE ELSE
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - (sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER ())::DOUBLE) / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE * w END AS target
  FROM r WHERE turn = 50
), s AS (
  SELECT source, w, sum(size)::DOUBLE AS words FROM n GROUP BY source, w
), l AS (
  SELECT s.source, w, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(words * w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source WINDOW p AS (PARTITION BY s.source ORDER BY w DESC)
), g AS (
  SELECT source, max_by(level, w) FILTER (level * w <= 2) AS level FROM l GROUP BY source
), a AS (
  SELECT doc_id, n.source, size, name, source_size, target, coalesce(least(2.0::DOUBLE, level * w), 2.0::DOUBLE) AS rate,
    (('0x' || name[1:13])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source JOIN g ON n.source IS NOT DISTINCT FROM g.source
), b AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS p, (u / (1 - u)) * ((1 - (rate - floor(rate))) / nullif(rate - floor(rate), 0)) AS o FROM a
), c AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN floor(o / (1 + o) * 1125899906842623::DOUBLE)::BIGINT END AS rank,
    target - sum(CASE WHEN size > 0 THEN whole * size ELSE 0 END) OVER (PARTITION BY source) AS need FROM b
), e AS (
  SELECT source, max({'rank': rank, 'name': name}) AS last FROM (
    SELECT source, rank, name, need, size, sum(size) OVER (PARTITION BY source ORDER BY rank, name) AS upto
    FROM (SELECT source, rank, name, any_value(need) AS need, sum(size) AS size FROM c WHERE rank IS NOT NULL GROUP BY source, rank, name)
  ) WHERE upto - need <= need - (upto - size) AND need > 0 GROUP BY source
), f AS (
  SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE whole + coalesce(rank IS NOT NULL AND {'rank': rank, 'name': name} <= last, false)::INT END::BIGINT AS copies
  FROM c LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM f
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ann, op2_jaccard_join, op3_url_filter, op4_pii, op5_decontamination, op6_ctw_scores, op7_license_scan, op8_language_id, op9_toxicity_chain, op10_pareto_mix)
}
ORACLE_SQL: dict[str, str] = {"op2_jaccard_join": SQL_OP2, "op3_url_filter": SQL_OP3, "op5_decontamination": SQL_OP5, "op10_pareto_mix": SQL_OP10}

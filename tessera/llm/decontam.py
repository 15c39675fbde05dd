"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

The benchmark's phrases (windows of ``k`` consecutive words; shorter items whole) are the test queries. The index
holds postings (text, position, term) of the training texts for the rarest test terms, by counts over the
whole corpus; it is written to the shared folder once and read by both searches.

Phrases: the offset-adjusted lists of a phrase's ``rarest`` rarest terms are intersected, so common words' postings
are never made. What is left is compared with the words of the text, by 128 bits of hash of the
whole phrase. Proximity: an item is near where its ``near_terms`` rarest terms all stand within ``distance``
words of its rarest one, in any order.

A text is named by 128 bits of its hash, so copies share their postings' groups, and lists are grouped by text,
place and phrase, never by term alone: a passage that a third of all documents hold spreads over all tasks.
Whole texts are moved only for those with places, and the result is joined by that name; where
it is counted small, it is broadcast and nothing of the documents moves.

Defined results. Null texts have no words and are not contaminated; null or empty items have no phrase. Repeated rows
each get their result. Items are named by item_id as text; null item ids are left out. Empty tables give
empty or clean results. Long texts are handled as one row of their own words; extra columns are kept unless named
like one of those added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import PLAIN_GAPS, ascii_lower, fresh, saved, split_words

ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated", "n_near")
#: A side is broadcast only if counted to have at most so many rows of one word (or of one text's result, items counted each).
BROADCAST_ROWS = 100_000
NAME = ["k1", "k2"]


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), PLAIN_GAPS)


def _hash(c: Column, n: int) -> Column:
    return F.xxhash64(c, F.lit(n))


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (id as text) and its words w; items without id or words are left out."""
    return items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.col("item").isNotNull() & (F.size("w") > 0))


def phrases(items: DataFrame, k: int = 13, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct phrases: phrase (words joined by blanks), len, items (sorted ids as strings)."""
    n = F.size("w")
    windows = F.when(n < k, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.slice("w", i, k)))
    each = item_words(items, item_id, text).select("item", F.explode(windows).alias("p"))
    return each.groupBy(F.array_join("p", " ").alias("phrase"), F.size("p").alias("len")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _named(docs: DataFrame, text: str) -> DataFrame:
    """k1, k2 name a text; rows with equal texts have equal results."""
    return docs.where(F.col(text).isNotNull()).select(_hash(F.col(text), 1).alias("k1"), _hash(F.col(text), 2).alias("k2"), F.col(text).alias("text"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int, text: str = "text") -> DataFrame:
    """The index for the given distinct terms: k1, k2, pos (from 0), term."""
    each = _named(docs, text).select(*NAME, F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return each.join(_side(terms.select("term"), n_terms), "term", "left_semi").select(*NAME, "pos", "term")


def term_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """term and n, its occurrences in all texts, for each term of the vocabulary (distinct) that occurs."""
    words = docs.select(F.explode(words_of(F.col(text))).alias("term"))
    return words.join(_side(vocabulary, vocabulary.count()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(each: DataFrame, counted: DataFrame, phrase: str, rarest: int) -> DataFrame:
    """Of rows (phrase, offset, term) the ``rarest`` rarest of each phrase whose terms all occur, with their number nth."""
    of = Window.partitionBy(phrase)
    ranked = each.join(_side(counted, counted.count()), "term", "left").withColumn("missing", F.max(F.col("n").isNull()).over(of)).withColumn("nth", F.row_number().over(of.orderBy("n", "term", "offset")))
    return ranked.where(~F.col("missing") & (F.col("nth") <= rarest)).select(phrase, "term", "offset", "nth")


def _near(index: DataFrame, close: DataFrame, distance: int, n: int) -> DataFrame:
    """k1, k2, phrase, pos of the rarest term, and span, where all terms of ``close`` (phrase, term, nth) are within ``distance`` of it."""
    block = lambda shift: (F.floor(F.col("pos") / (distance + 1)) + shift).alias("block")
    lists = index.join(_side(close, n), "term")
    first = lists.where("nth = 1").select(*NAME, "phrase", "pos", F.explode(F.array(*[block(i) for i in (-1, 0, 1)])).alias("block"))
    near = lists.select(*NAME, "phrase", "nth", F.col("pos").alias("at"), block(0))
    met = first.join(near, [*NAME, "phrase", "block"]).where(F.abs(F.col("pos") - F.col("at")) <= distance)
    closest = met.groupBy(*NAME, "phrase", "pos", "nth").agg(F.min_by("at", F.struct(F.abs(F.col("pos") - F.col("at")), F.col("at"))).alias("at"))
    whole = closest.groupBy(*NAME, "phrase", "pos").agg(F.count("*").alias("terms"), (F.max("at") - F.min("at") + 1).alias("span"))
    wanted = close.groupBy("phrase").agg(F.max("nth").cast("long").alias("terms"))
    return whole.join(_side(wanted, n), ["phrase", "terms"]).select(*NAME, "phrase", "pos", "span")


def proximity(docs: DataFrame, queries: DataFrame, distance: int, rarest: int | None = None, text: str = "text") -> DataFrame:
    """Places where all terms of a phrase (or its ``rarest`` rarest) stand within ``distance`` words of its rarest term, in any order.

    queries: phrases (column phrase, lower-cased words joined by blanks). Returns k1, k2 (the text's name),
    phrase, pos of the rarest term, and span (words from the first to the last nearest term).
    """
    each = saved(queries.select("phrase").distinct().select("phrase", F.posexplode(F.array_distinct(F.split("phrase", " "))).alias("offset", "term")))
    counted = saved(term_counts(docs, each.select("term").distinct(), text))
    close = saved(rarest_terms(each, counted, "phrase", rarest or 1 << 30))
    n = close.count()
    return _near(saved(postings(docs, close.select("term").distinct(), n, text)), close, distance, n)


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 13, one_in: int = 20, rarest: int = 2, near_terms: int = 3, distance: int = 26, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Adds n_words, n_hit (words inside a phrase's occurrence), n_items, items, contaminated and n_near (items near somewhere).

    contaminated: n_hit > 0 and one_in * n_hit >= n_words.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    docs = docs.select(*kept)
    found = saved(phrases(items, k, item_id).select("*", _hash(F.col("phrase"), 1).alias("h1"), _hash(F.col("phrase"), 2).alias("h2")))
    n_found = found.count()
    own = item_words(items, item_id).select(F.col("item").alias("phrase"), F.posexplode(F.array_distinct("w")).alias("offset", "term")).dropDuplicates(["phrase", "term"])
    counted = saved(term_counts(docs, saved(own.select("term").distinct()), text))
    anchors = rarest_terms(found.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term")), counted, "phrase", rarest)
    anchors = saved(anchors.join(_side(found.select("phrase", "h1", "h2", "len"), n_found), "phrase").drop("phrase"))
    close = saved(rarest_terms(own, counted, "phrase", near_terms))
    n_anchors, n_close = anchors.count(), close.count()
    index = saved(postings(docs, anchors.select("term").unionByName(close.select("term")).distinct(), n_anchors + n_close, text))

    adjusted = index.join(_side(anchors, n_anchors), "term").where("pos >= offset").select(*NAME, (F.col("pos") - F.col("offset")).alias("start"), "h1", "h2", "len", "nth")
    places = adjusted.groupBy(*NAME, "start", "h1", "h2", "len").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("nth") - 1)).alias("lists"))
    places = places.where(F.bit_count("lists") == F.least(F.lit(rarest), F.col("len")))
    # a text has at most as many places as words times phrases with the same rarest terms
    by_text = saved(places.groupBy(*NAME).agg(F.collect_list(F.struct("start", "len", "h1", "h2")).alias("places")))
    n_texts = by_text.count()
    texts = _named(docs, text).join(_side(by_text.select(*NAME), n_texts), NAME, "left_semi").dropDuplicates(NAME)
    texts = texts.join(by_text, NAME)
    phrase_at = lambda w, p: F.array_join(F.slice(w, p["start"] + 1, p["len"]), " ")
    same = lambda w, p: (_hash(phrase_at(w, p), 1) == p["h1"]) & (_hash(phrase_at(w, p), 2) == p["h2"])
    # bound as a variable, the words are split once for a text and not for each place
    right = F.element_at(F.transform(F.array(words_of(F.col("text"))), lambda w: F.filter("places", lambda p: same(w, p))), 1)
    hits = saved(texts.select(*NAME, F.array_sort(right).alias("hits"))).where(F.size("hits") > 0)
    # the hits are in order of their starts, so the words of each beyond the end of those before are counted once
    ends = lambda acc, p: F.struct(F.greatest(acc["end"], p["start"] + p["len"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), p["start"] + p["len"] - F.greatest(acc["end"], p["start"]))).alias("n"))
    covered = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), ends)["n"].cast("long")
    named = hits.select(*NAME, F.explode(F.array_distinct(F.transform("hits", lambda p: F.struct(p["h1"], p["h2"])))).alias("h")).select(*NAME, "h.h1", "h.h2")
    named = named.join(_side(found.select("h1", "h2", "items"), n_found), ["h1", "h2"]).select(*NAME, F.explode("items").alias("item"))
    named = named.groupBy(*NAME).agg(F.array_sort(F.collect_set("item")).alias("items"))
    near = _near(index, close, distance, n_close).groupBy(*NAME).agg(F.count_distinct("phrase").alias("n_near"))
    facts = hits.select(*NAME, covered.alias("n_hit")).join(named, NAME).join(near, NAME, "full_outer")
    facts = saved(facts.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    n_facts = facts.agg(F.coalesce(F.sum(1 + F.size("items")), F.lit(0))).first()[0]

    a, b, n_words = (fresh(docs, n) for n in ("_k1", "_k2", "_n_words"))
    keyed = docs.select("*", _hash(F.col(text), 1).alias(a), _hash(F.col(text), 2).alias(b), F.size(words_of(F.col(text))).cast("long").alias(n_words))
    facts = facts.toDF(*(fresh(docs, n) for n in ("_f1", "_f2", "_n_hit", "_items", "_n_near")))
    f1, f2, n_hit, held, n_near = (F.col(c) for c in facts.columns)
    both = keyed.join(_side(facts, n_facts), (F.col(a) == f1) & (F.col(b) == f2), "left")
    n_hit = F.coalesce(n_hit, F.lit(0)).cast("long")
    held = F.coalesce(held, F.array().cast("array<string>"))
    return both.select(
        *kept, F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"), held.alias("items"),
        ((n_hit > 0) & (n_hit * one_in >= F.col(n_words))).alias("contaminated"), F.coalesce(n_near, F.lit(0)).cast("long").alias("n_near"),
    )

"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document's expected copies are ``level * odds``, at most ``cap``; the source's level is
found so that they sum to its target. Whole copies are certain. The fraction left is an inclusion probability
p, and the document's rank is [u / (1 - u)] / [p / (1 - p)] with u a hash of its id and text: its random
odds divided by its inclusion odds. Each source takes its documents by rising rank up to the point where the
words taken come nearest to the target.

That point is found without sorting a source in one task. Ranks are whole numbers of 50 bits; in each round the words of the
1024 next finer bins are summed, map-side first, and the bin in which the target falls is kept, until few
documents are left in it to be put in order. Odds are rounded to sixteenths (1/16 to 16), so a
source's level is found from at most 256 sums.

Defined results. Null and empty texts have size 0 and are never taken. A null source is a source of its
own, last in order. Null ids hash as an empty id, so rows without id are told apart by their texts; rows equal in id and text
are taken together. Odds that are null, not positive or not finite count as 1. An empty table gives an
empty result. Extra columns are kept unless named like one of those added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BLANK_GAPS, fresh, saved, split_words

ADDED = ("size", "source_size", "target", "copies", "taken")
#: Bits of a rank, and of them those that one round decides.
RANK_BITS, ROUND_BITS = 50, 10
#: Documents of one source that are put in order in one task, unless rows equal in id and text are more.
ORDERED = 4096


def length_odds(text: Column) -> Column:
    """Odds by size: fragments under 50 words half as likely as others, texts of 1000 words and more twice."""
    n = words_in(text)
    return F.when(n < 50, 0.5).when(n < 1000, 1.0).otherwise(2.0)


def words_in(text: Column) -> Column:
    return F.size(split_words(text, BLANK_GAPS)).cast("long")


def mix_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row a source (columns source, source_size) to the same with ``target``.

    Sources by code point, null last, take the weights in turn. ``share`` of all words is dealt by weight;
    what is above ``cap`` times a source's size is dealt again. Dealing again until none is above ends at
    one level for all sources below their cap, so the level is found from one running sum.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    t = t.select(
        "*", F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("m0"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w0"),
        F.sum("w").over(everything).alias("wt"), (F.sum("source_size").over(everything) * share).alias("pool"),
    )
    t = t.withColumn("capped", F.col("most") * (F.col("wt") - F.col("w0")) <= F.col("w") * (F.col("pool") - F.col("m0")))
    capped = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0.0)).over(everything)
    level = (F.col("pool") - capped("most")) / F.nullif(F.col("wt") - capped("w"), F.lit(0.0))
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("w")).alias("target"))


def levels(sums: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """source, source_size, target and level, from the words of each source and odds (source, w, words).

    With the largest odds at ``cap``, the others share what is left; the level is that of the fewest at cap for which no other is above.
    """
    both = sums.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "w", "words", "source_size", "target")
    own = Window.partitionBy("source").orderBy(F.desc("w"))
    before = F.coalesce(F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("w")).over(own.rowsBetween(0, Window.unboundedFollowing))
    at = both.select("*", ((F.col("target") - cap * before) / F.nullif(rest, F.lit(0.0))).alias("level"))
    fits = F.col("level") * F.col("w") <= cap
    return at.groupBy("source", "source_size", "target").agg(F.max_by(F.when(fits, F.col("level")), F.when(fits, F.col("w"))).alias("level"))


def pareto_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, text: str = "text", source: str = "source", doc_id: str = "doc_id", odds: Column | None = None) -> DataFrame:
    """Adds size, source_size, target, copies and taken (copies * size) to each document.

    odds: relative odds of the documents of a source; equal by default.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    names = key, size, w, name = [fresh(docs, n) for n in ("_source", "_size", "_odds", "_name")]
    given = F.coalesce(odds if odds is not None else F.lit(1.0), F.lit(1.0)).cast("double")
    given = F.when((given > 0) & (given < float("inf")), given).otherwise(1.0)
    sized = docs.select(
        "*", F.col(source).cast("string").alias(key), words_in(F.col(text)).alias(size), (F.least(F.lit(256.0), F.greatest(F.lit(1.0), F.round(F.least(given, F.lit(16.0)) * 16))) / 16).alias(w),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary")).alias(name),
    )
    narrow = saved(sized.select(*[F.col(c).alias(n) for c, n in zip(names, ("source", "size", "w", "name"), strict=True)]))
    sums = saved(narrow.groupBy("source", "w").agg(F.sum("size").alias("words")))
    targets = mix_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    found = saved(levels(sums, targets, cap))
    small = found.count() <= 100_000  # one short row a source
    side = lambda df: F.broadcast(df) if small else df

    def ranked(df: DataFrame, size: str, w: str, name: str) -> DataFrame:
        rate = F.when(F.col("level").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("level") * F.col(w)))
        df = df.withColumn("whole", F.floor(rate).cast("long")).withColumn("p", rate - F.col("whole"))
        u = (F.conv(F.substring(name, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
        drawn = (u / (1 - u)) * ((1 - F.col("p")) / F.nullif(F.col("p"), F.lit(0.0)))
        # odds / (1 + odds) keeps the order and lies between 0 and 1; where nothing is drawn there is no rank
        return df.withColumn("rank", F.when((F.col("p") > 0) & (F.col(size) > 0), F.floor(drawn / (1 + drawn) * float((1 << RANK_BITS) - 1)).cast("long")))

    at = ranked(narrow.join(side(found.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))), "size", "w", "name")
    at = saved(at.select("source", "name", "size", "rank", F.when(F.col("size") > 0, F.col("whole") * F.col("size")).otherwise(0).alias("certain"), "target"))
    need = at.groupBy("source").agg((F.max("target") - F.sum("certain")).alias("need")).where("need > 0")
    edge = saved(need.select(F.col("source").alias("s"), "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")))
    drawn = at.where("rank is not null").select("source", "name", "size", "rank")
    own = Window.partitionBy("source").orderBy("bin")
    for bits in range(ROUND_BITS, RANK_BITS + 1, ROUND_BITS):
        inside = drawn.join(side(edge), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("rank", RANK_BITS - bits + ROUND_BITS) == F.col("prefix")))
        bins = inside.groupBy("source", F.shiftright("rank", RANK_BITS - bits).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("need").alias("need"), F.max("below").alias("below"))
        bins = bins.withColumn("upto", F.col("below") + F.sum("words").over(own))
        # where rounding lets the target fall beyond the last bin, that bin is the one
        last = F.lead("bin").over(own).isNull()
        at_edge = bins.withColumn("last", last).where((F.col("upto") - F.col("words") < F.col("need")) & ((F.col("upto") >= F.col("need")) | F.col("last")))
        edge = saved(at_edge.select(F.col("source").alias("s"), "need", F.col("bin").alias("prefix"), (F.col("upto") - F.col("words")).alias("below"), "n"))
        if (edge.agg(F.max("n")).first()[0] or 0) <= ORDERED:
            break
        edge = edge.drop("n")
    inside = drawn.join(side(edge), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("rank", RANK_BITS - bits) == F.col("prefix")))
    inside = inside.groupBy("source", "rank", "name").agg(F.sum("size").alias("size"), F.max("need").alias("need"), F.max("below").alias("below"))
    inside = inside.withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "name")))
    near = F.col("upto") - F.col("need") <= F.col("need") - (F.col("upto") - F.col("size"))
    last = inside.where(near).groupBy("source").agg(F.max(F.struct("rank", "name")).alias("last"))
    start = F.call_function("shiftleft", F.col("prefix"), F.lit(RANK_BITS - bits))
    cuts = edge.join(last, F.col("s").eqNullSafe(F.col("source")), "left").select("s", F.coalesce("last", F.struct(start.alias("rank"), F.lit("").alias("name"))).alias("last"))
    cuts = saved(found.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("cut_source"), "source_size", "target", "level", "last"))
    out = ranked(sized.join(side(cuts), F.col(key).eqNullSafe(F.col("cut_source")), "left"), size, w, name)
    extra = F.col("rank").isNotNull() & F.col("last").isNotNull() & (F.struct(F.col("rank"), F.col(name).alias("name")) <= F.col("last"))
    copies = F.when(F.col(size) == 0, F.lit(0)).otherwise(F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(size).alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col(size)).alias("taken"))

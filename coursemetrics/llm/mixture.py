"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. Every document of it gets the whole copies that are certain; what is left of
the target is a sample of fixed size in words. Documents are ranked by the odds of a random number, keyed by the
document id, over the odds of their inclusion; the sample is the head of that order, and the document at its end gives
only the words still missing, so a source meets its target to the word.

The order is never sorted as a whole. Words are added up by ranges of the ranking variable, twice (4,096 ranges, then
4,096 within the one where a source's sample ends); only the documents of that last range, one in 16 million of a
source's ranks, meet in a window.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemetrics.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 12     # bits of the ranking variable told apart at once; two rounds
DRAW_BITS = 52


def draw(key: Column, seed: int) -> Column:
    """A random number of (0, 1) that depends on the key and the seed only; exact in a double."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, DRAW_BITS // 4)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << DRAW_BITS))


def range_of(rank: Column) -> Column:
    """Ranges of equal width for ranks below 1 and of equal width of the inverse above; falls nowhere as the rank grows.

    The last document of a Pareto sample lies near rank 1, so ranges are narrow where it matters."""
    half = float(1 << (2 * RANGES - 1))
    return F.when(rank < 1, F.floor(rank * half)).otherwise((1 << (2 * RANGES)) - 1 - F.floor(half / rank)).cast("long")


def cut_at(words: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``(place, left, before, range, words)``, the range where each place's sample ends, with the words before it."""
    run = F.sum("words").over(Window.partitionBy(*keys).orderBy("range")) + F.col("before")
    return words.withColumn("after", run).where("after > left and after - words <= left").withColumn("before", F.col("after") - F.col("words"))


def sample_words(drawn: DataFrame) -> DataFrame:
    """Pareto order samples of fixed size in words.

    ``drawn`` has ``place`` (long, the group), ``left`` (the group's sample size), ``size``, ``rank`` (random odds over
    inclusion odds; null or left = 0: not sampled) and ``tie`` columns ``doc_id``; every row comes back with ``extra``,
    its sampled words: its whole size before the end of the sample, what is missing at the end, 0 after it.
    """
    ranked = drawn.withColumn("fine", range_of(F.col("rank")))
    coarse = F.shiftright("fine", RANGES)
    first = cut_at(ranked.where("rank is not null").groupBy("place", "left", coarse.alias("range")).agg(F.sum("size").alias("words"))
                   .withColumn("before", F.lit(0)), ["place"]).select("place", F.col("range").alias("at"), "before")
    inside = ranked.join(first, "place").where(coarse == F.col("at"))
    end = cut_at(inside.groupBy("place", "left", "before", F.col("fine").alias("range")).agg(F.sum("size").alias("words")), ["place"]).select(
        "place", F.col("range").alias("end"), "before")
    found = ranked.join(end, "place", "left")
    order = Window.partitionBy("place").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = found.where("fine = end").withColumn("extra", F.greatest(F.lit(0), F.least(
        F.col("size"), F.col("left") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    # A group without an end takes every document of its order: its sample is as large as the group.
    rest = found.where("rank is null or end is null or fine <> end").withColumn(
        "extra", F.when(F.col("rank").isNotNull() & (F.col("end").isNull() | (F.col("fine") < F.col("end"))), F.col("size")).otherwise(0))
    return rest.unionByName(last).drop("fine", "end", "before")


def numbered(sources: DataFrame, column: str) -> DataFrame:
    """Sources with their ``place`` from 0 by code point, null last: ranges are sorted apart, only their counts meet."""
    order = F.col(column).asc_nulls_last()
    parts = stored(sources.repartitionByRange(order).withColumn("shard", F.spark_partition_id()), "mixture-sources")
    counts = parts.groupBy("shard").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard").orderBy(order)) - 1
    return parts.withColumn("within", within).join(offsets, "shard").withColumn("place", F.col("offset") + F.col("within")).drop("shard", "within", "offset")


def targets(sources: DataFrame, share: tuple[int, int], most: int) -> DataFrame:
    """``sources`` of (weight, source_size) with ``target``: ``share`` of all words by weight, none above ``most`` times its size.

    A source whose part is above its limit stops there and the others share the excess, until none is above. A round is
    one aggregate over the sources; three sums reach the driver. Limits are compared in exact arithmetic.
    """
    all_words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    all_words, weights = all_words or 0, weights or 0
    top, bottom = share
    full_words = full_weight = 0
    while True:
        # A weight of 1 gets over / under words.
        over, under = top * all_words - most * bottom * full_words, bottom * (weights - full_weight)
        full = (F.col("weight").cast("decimal(18,0)") * F.lit(Decimal(over)).cast("decimal(20,0)")
                > F.col("source_size").cast("decimal(18,0)") * F.lit(Decimal(most * under)).cast("decimal(20,0)"))
        found = sources.where(full).agg(F.sum("source_size"), F.sum("weight")).first()
        found = (found[0] or 0, found[1] or 0)
        if found == (full_words, full_weight):
            part = (F.col("weight") * F.lit(over)).cast("double") / F.lit(float(under)) if under else F.lit(0.0)
            return sources.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(part))
        full_words, full_weight = found


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of every document a mix of all sources takes.

    A document's size is its number of words (runs without ASCII white space). Sources in order of their code points,
    null last, take the weights in turn and share ``share`` (a ratio) of all words; a source's target is at most ``most``
    times its own words, and the excess is shared by the others. Within a source every document gets the same number
    of whole copies, ``floor(target / source_size)``, and is in the Pareto sample for the rest with the probability left.

    Returns the id column, size, source_size, target (both of the document's source), taken (words, repeats counted)
    and copies (whole copies, a sampled document's included; the words beyond them are the document's first). A source's
    taken words are its target, rounded to a word; no document exceeds ``most`` times its size.

    The draw depends on id and seed only, so reruns agree. Null and empty texts have size 0 and take 0; a null source
    is a source of its own; rows that repeat an id share its draw and follow each other in the order; an empty table
    gives no rows; other columns, also ones named like the results, are not read.
    """
    kind = docs.schema[id_col].dataType
    sizes = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                               F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                               draw(F.col(id_col), seed).alias("u")), "mixture-sizes")
    known = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    known = stored(known.withColumn("weight", F.get(turn, (F.col("place") % len(weights)).cast("int")).cast("long")), "mixture-places")
    ratio = F.col("target") / F.col("source_size")
    known = targets(known, share, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0))
    known = stored(known.withColumns({
        "chance": F.when(F.col("source_size") > 0, ratio - F.col("whole")).otherwise(0.0),
        "left": F.least("source_size", F.greatest(F.lit(0), F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")))}), "mixture-targets")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    drawn = stored(sizes.alias("d").join(known.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source", "weight")
                   .withColumn("rank", F.when((F.col("chance") > 0) & (F.col("size") > 0), odds)), "mixture-draws")
    taken = F.col("whole") * F.col("size") + F.col("extra")
    return sample_words(drawn).select(F.col("doc_id").cast(kind).alias(id_col), "size", "source_size", "target", taken.alias("taken"),
                                      F.when(F.col("size") > 0, F.floor(taken / F.col("size"))).otherwise(0).alias("copies"))


def texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: a row per copy of a document (``copy`` from 0), whole texts first, then the first words of the one
    that is cut. Ids must be unique; documents of which nothing is taken give no row."""
    taken = mixed.select(F.col(id_col).alias("__id"), "size", "taken", "copies").where("taken > 0")
    cut = F.col("taken") - F.col("copies") * F.col("size")
    copy = F.explode(F.sequence(F.lit(0), (F.col("copies") + (cut > 0).cast("long") - 1).cast("int"))).alias("copy")
    words = F.slice(F.regexp_extract_all(text_col, F.lit(f"({WORD})")), 1, cut.cast("int"))
    own = [F.col(c) for c in docs.columns if c not in (text_col, "size", "taken", "copies", "copy")]
    rows = docs.select(*own, text_col).join(taken, F.col(id_col) == F.col("__id")).select(*own, text_col, "size", "taken", "copies", copy)
    return rows.withColumn(text_col, F.when(F.col("copy") < F.col("copies"), F.col(text_col)).otherwise(F.array_join(words, " "))).select(*own, text_col, "copy")


#: The same result in DuckDB, for weights 5, 2, 1, a share of 3/2, at most 2 times and the seed 42.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
      (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(place % 3 + 1)::INTEGER] AS weight FROM s),
o AS (SELECT *, 3 * sum(source_size) OVER ()::HUGEINT AS words,
      coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
      sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weights FROM w),
f AS (SELECT *, weight * (words - 4 * before) > 4 * source_size * weights AS full_up FROM o),
p AS (SELECT *, (max(words) OVER () - 4 * coalesce(sum(source_size) FILTER (full_up) OVER (), 0))::BIGINT AS over_words,
      (2 * coalesce(sum(weight) FILTER (NOT full_up) OVER (), 0))::BIGINT AS under FROM f),
t AS (SELECT source, source_size, CASE WHEN full_up THEN (2 * source_size)::DOUBLE WHEN under = 0 THEN 0
      ELSE (weight * over_words)::DOUBLE / under::DOUBLE END AS target FROM p),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
h AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0 END AS chance,
      least(source_size, greatest(0, floor(target + 0.5)::BIGINT - whole * source_size)) AS left_over FROM g),
r AS (SELECT d.doc_id, d.size, h.source_size, h.target, h.whole, h.left_over, h.source,
      CASE WHEN chance > 0 AND size > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
e AS (SELECT *, CASE WHEN odds IS NULL THEN 0 ELSE greatest(0, least(size, left_over - coalesce(sum(size) OVER (PARTITION BY source, odds IS NULL
      ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS extra FROM r)
SELECT doc_id, size, source_size, target, (whole * size + extra)::BIGINT AS taken,
       (CASE WHEN size > 0 THEN floor((whole * size + extra) / size) ELSE 0 END)::BIGINT AS copies FROM e
"""

"""Facet counts of filtered hits from stored bitmaps (G9): documents are read once, when the index is written.

Documents are dealt into buckets of 32,768; the index keeps, for every value of a facet and every bucket, one bitmap of the
documents that have it. A filter's documents in a bucket are the intersection of its values' bitmaps (an upper bound is the
union of the bitmaps of the smaller numbers), and a facet's count is the number of bits that its bitmap shares with them.

Scale notes
-----------
* Equal filters of many requests are answered once; the work is distinct filters times facet values times buckets, 4 KB each.
* Bitmaps meet in groups of one bucket, BLOCK filters and BLOCK values (2 MB), whatever the number of either.
* A filter on a frequent value is dealt over SHARES tasks; the index rows, far fewer, are repeated for them.
* A value that few documents have costs as many bytes in a task as a frequent one (not on disk, where the bitmap is compressed).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 256
SHARES = 16
BITMAP_BYTES = 4096     # of Spark's bitmap functions
EVERY = ""              # the field whose one bitmap a bucket holds all documents


def _one_argument(entry, field: str):
    return lambda value: entry(field, value)


@dataclass(frozen=True)
class FacetIndex:
    bits: DataFrame     # field, value (of facets), number (of bounds), bucket, bits
    facets: tuple[str, ...]


def build_facets(docs: DataFrame, path: str, fields=("department", "skill_level", "format"), array_fields=("skills_taught",),
                 bounds=("duration_hours",)) -> FacetIndex:
    """Write the bitmaps of ``docs`` under ``path``. A null value is a facet value of its own, a null array has none, a value that an
    array repeats counts once; a null number is within no bound."""
    spark = docs.sparkSession
    names = [*fields, *array_fields, *bounds]
    # Written first: a task that is run again numbers its documents alike.
    docs.select(*names).write.mode("overwrite").parquet(f"{path}/values")

    def entry(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(None).cast("double").alias("number"))

    def number(field: str) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(None).cast("string").alias("value"), F.col(field).cast("double").alias("number"))

    entries = F.array(entry(EVERY, F.lit("")), *[entry(f, F.col(f)) for f in fields], *map(number, bounds))
    for f in array_fields:
        of_array = F.transform(F.array_distinct(f), _one_argument(entry, f))
        entries = F.concat(entries, F.coalesce(of_array, F.array().cast(
            "array<struct<field:string,value:string,number:double>>")))
    numbered = spark.read.schema(docs.select(*names).schema).parquet(f"{path}/values").select(F.monotonically_increasing_id().alias("doc"), entries.alias("entries"))
    (numbered.select("doc", F.inline("entries")).where(~F.col("field").isin(*bounds) | F.col("number").isNotNull())
     .groupBy("field", "value", "number", F.bitmap_bucket_number("doc").alias("bucket"))
     .agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc")).alias("bits")).write.mode("overwrite").parquet(f"{path}/bits"))
    bits = spark.read.schema("field string, value string, number double, bucket long, bits binary").parquet(f"{path}/bits")
    return FacetIndex(bits, (*fields, *array_fields))


def _shared(rows: DataFrame) -> DataFrame:
    return rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))


def _below(index: FacetIndex, bounds: DataFrame) -> DataFrame:
    """(field, bound, bucket, bits): the documents of every bucket whose number is at most the bound."""
    buckets = _shared(index.bits.where(F.col("field") == EVERY).select("bucket"))
    places = (bounds.withColumn("share", F.pmod(F.xxhash64("bound"), F.lit(SHARES)).cast("int")).join(buckets, "share")
              .select("field", "bucket", F.col("bound").alias("number"), F.lit(1).alias("asked"), F.lit(None).cast("binary").alias("bits")))
    known = index.bits.where("number is not null").select("field", "bucket", "number", F.lit(0).alias("asked"), "bits")
    so_far = Window.partitionBy("field", "bucket").orderBy("number", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return (known.unionByName(places).withColumn("bits", F.bitmap_or_agg("bits").over(so_far)).where("asked = 1")
            .select("field", F.col("number").alias("bound"), "bucket", "bits"))


def _selected(index: FacetIndex, asked: DataFrame, own: list[str], filters) -> DataFrame:
    """The bitmap of each distinct filter in each bucket where it has documents."""
    string, double = "string", "double"
    eq = [F.when(F.col(c).isNotNull(), F.struct(F.lit(d).alias("field"), F.col(c).cast(string).alias("value"))) for c, (d, _, kind) in zip(own, filters) if kind == "eq"]
    le = [F.when(F.col(c).isNotNull(), F.struct(F.lit(d).alias("field"), F.col(c).cast(double).alias("bound"))) for c, (d, _, kind) in zip(own, filters) if kind == "le"]
    of_eq = F.filter(F.array(*eq), lambda x: x.isNotNull()) if eq else F.array().cast("array<struct<field:string,value:string>>")
    of_le = F.filter(F.array(*le), lambda x: x.isNotNull()) if le else F.array().cast("array<struct<field:string,bound:double>>")
    everything = F.array(F.struct(F.lit(EVERY).alias("field"), F.lit("").alias("value")))
    terms = (asked.withColumn("eq", of_eq).withColumn("le", of_le).withColumn("wanted", F.greatest(F.lit(1), F.size("eq") + F.size("le")))
             .withColumn("eq", F.when(F.size("eq") + F.size("le") == 0, everything).otherwise(F.col("eq")))
             .withColumn("share", F.pmod(F.xxhash64(*own), F.lit(SHARES)).cast("int")))
    kept = [*own, "wanted", "bucket", "bits"]
    found = [terms.select(*own, "wanted", "share", F.inline("eq")).join(_shared(index.bits.where("value is not null")), ["field", "value", "share"]).select(*kept)]
    if le:
        wanted = terms.select(*own, "wanted", "share", F.inline("le"))
        found.append(wanted.join(_shared(_below(index, wanted.select("field", "bound").distinct())), ["field", "bound", "share"]).select(*kept))
    return (reduce(DataFrame.unionByName, found).groupBy(*own, "wanted", "bucket").agg(F.count("*").alias("terms"), F.bitmap_and_agg("bits").alias("bits"))
            .where((F.col("terms") == F.col("wanted")) & (F.bitmap_count("bits") > 0)).select(*own, "bucket", "bits"))


def _blocks(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return rows.withColumn(name, F.floor((place - 1) / BLOCK).cast("int"))


def _repeated(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """``rows`` once for each block ``name`` of the other side in the same bucket."""
    last = others.groupBy("bucket").agg(F.max(name).alias("last"))
    return rows.join(last, "bucket").withColumn(name, F.explode(F.sequence(F.lit(0), "last"))).drop("last")


def _words(bits: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, BITMAP_BYTES // 8)


def _meet(own: list[str]):
    def run(group: pa.Table) -> pa.Table:
        is_filter = group.column("is_filter").to_numpy(zero_copy_only=False)
        ours, theirs = group.filter(pa.array(is_filter)), group.filter(pa.array(~is_filter))
        a, b = _words(ours.column("bits")), _words(theirs.column("bits"))
        counts = np.stack([np.bitwise_count(a & v).sum(1, dtype=np.int64) for v in b]) if len(a) and len(b) else np.zeros((len(b), len(a)), np.int64)
        value, asked = np.nonzero(counts)
        return pa.table([*[ours.column(c).take(pa.array(asked)) for c in own], *[theirs.column(c).take(pa.array(value)) for c in ("field", "value")],
                         pa.array(counts[value, asked], pa.int64())], names=[*own, "field", "value", "n"])
    return run


def facets_of_hits(index: FacetIndex, requests: DataFrame, filters) -> DataFrame:
    """Facet counts of the documents that pass each distinct filter of ``requests``.

    ``filters`` as in ``search``: (document column, request column, "eq" | "le"); a null request value does not filter. Rows: the
    request columns, facet, value, count of documents (never 0). A filter without documents has no rows; lazy.
    """
    own = [f"_f{i}" for i in range(len(filters))]
    asked = requests.select(*[F.col(r).alias(c) for c, (_, r, _) in zip(own, filters)]).distinct()
    chosen = _blocks(_selected(index, asked, own, filters), own, "fblock")
    values = _blocks(index.bits.where(F.col("field").isin(*index.facets)).select("field", "value", "bucket", "bits"), ["field", "value"], "vblock")
    types = {f.name: f.dataType for f in asked.schema}
    left = _repeated(chosen, values, "vblock").select("bucket", "fblock", "vblock", F.lit(True).alias("is_filter"), *own,
                                                      F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), "bits")
    right = _repeated(values, chosen, "fblock").select("bucket", "fblock", "vblock", F.lit(False).alias("is_filter"),
                                                       *[F.lit(None).cast(types[c]).alias(c) for c in own], "field", "value", "bits")
    schema = ", ".join(f"{c} {types[c].simpleString()}" for c in own) + ", field string, value string, n long"
    met = left.unionByName(right).groupBy("bucket", "fblock", "vblock").applyInArrow(_meet(own), schema)
    return (met.groupBy(*own, "field", "value").agg(F.sum("n").alias("n"))
            .select(*[F.col(c).alias(r) for c, (_, r, _) in zip(own, filters)], F.col("field").alias("facet"), "value", F.col("n").alias("count")))

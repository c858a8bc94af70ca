"""Approximate vector top-k (G4): random-projection hash tables stored as bucket tables.

* A table has ``bits`` random orthogonal directions; the signs of a unit vector's projections are its bucket. The index is
  one row per vector and table, written once; equal vectors are one row with their k smallest ids, so copies don't fill
  a bucket.
* A request probes the buckets that cost it least (the squared projections it would have to flip), over all tables
  together. How many is fitted on a bounded sample: the probes that find ``target`` of the sample's exact neighbours.
* Candidates meet by an equi-join on the bucket, as a cogroup that scores a bucket's vectors against its requests with one
  matrix product and passes on k rows for each request. A crowded bucket and a crowd of requests are split into parts,
  whose pairs are groups of their own; requests are a join key, never packed or broadcast, so their number has no cap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from coursemetrics.functions.topk import top_k_per_group
from coursemetrics.operators.search import vector_top_k

TABLES = 6
MAX_BITS = 12
ROWS_PER_BUCKET = 64
PART_ROWS = 20_000       # vectors, and requests, that one group holds at most (on average)
SAMPLE = 128             # requests that the number of probes is fitted on


@dataclass(frozen=True)
class HashIndex:
    buckets: DataFrame      # tbl, bucket, doc_id, same (ids of equal vectors), vec (unit length)
    crowds: DataFrame       # tbl, bucket, parts
    planes: np.ndarray      # tables x dim x bits
    probes: int
    k: int


def hash_planes(dim: int, bits: int, tables: int = TABLES, seed: int = 42) -> np.ndarray:
    """Directions of each table: orthonormal, so that a table's bits tell apart as much as they can."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, max(dim, bits))))[0][:, :bits] if bits <= dim
                     else rng.standard_normal((dim, bits)) / math.sqrt(dim) for _ in range(tables)])


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of ``dim`` numbers and a length above 0, those as unit vectors)."""
    values = [x if x is not None and len(x) == dim and None not in x else None for x in column.to_pylist()]
    rows = np.array([i for i, x in enumerate(values) if x is not None], np.int64)
    vectors = np.array([values[i] for i in rows], np.float64).reshape(len(rows), dim)
    length = np.linalg.norm(vectors, axis=1)
    good = np.isfinite(length) & (length > 0)
    return rows[good], vectors[good] / length[good, None]


def codes(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bucket numbers, vectors x tables."""
    signs = np.einsum("nd,tdb->ntb", unit, planes) > 0
    return (signs << np.arange(planes.shape[2])).sum(2)


def probe_order(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Costs of all buckets of all tables, requests x (tables * 2**bits): squared projections a bucket disagrees with."""
    bits = planes.shape[2]
    projected = np.einsum("nd,tdb->ntb", unit, planes)
    has = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    square = projected ** 2
    against_one, against_zero = np.where(projected > 0, 0, square), np.where(projected > 0, square, 0)
    cost = against_one @ has.T + against_zero @ (1 - has).T
    return cost.reshape(len(unit), -1)


def _bucket_rows(planes: np.ndarray, arrow: pa.Schema):
    def run(batches):
        tables, dim, _ = planes.shape
        for batch in batches:
            rows, unit = unit_rows(batch.column("vec"), dim)
            if not len(rows):
                continue
            places = codes(unit, planes)
            ids, same = (batch.column(c).take(pa.array(rows)) for c in ("doc_id", "same"))
            vectors = pa.array(list(unit), pa.list_(pa.float64()))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(places[:, t], pa.int64()), ids, same, vectors], schema=arrow)
    return run


def distinct_vectors(docs: DataFrame, k: int) -> DataFrame:
    """``(vec, doc_id, same)``: one row for equal vectors, with the smallest id and the k smallest ones."""
    keyed = docs.where("vec is not null").withColumn("__h", F.xxhash64("vec"))
    equal = Window.partitionBy("__h", "vec").orderBy("doc_id")
    return (keyed.withColumn("__n", F.row_number().over(equal)).where(F.col("__n") <= k)
            .groupBy("__h", "vec").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list("doc_id")).alias("same")).drop("__h"))


def build_index(docs: DataFrame, path: str, k: int, doc_id: str = "doc_id", vec: str = "vector", tables: int = TABLES, bits: int | None = None,
                target: float = 0.97, sample: int = SAMPLE, seed: int = 42) -> HashIndex:
    """Write the bucket tables of ``docs`` under ``path`` and fit the number of probes.

    Rows without a vector, or with one of another dimension than most, or of length 0, are not indexed (they have no
    cosine). ``bits`` follows the number of vectors (some ROWS_PER_BUCKET a bucket, MAX_BITS at most) unless given. The probes
    are fitted on ``sample`` vectors with the smallest id hashes, against an exact search of all vectors.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(vec).cast("array<double>").alias("vec"))
    distinct = distinct_vectors(given, k)
    told = given.where("size(vec) > 0").groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()  # rows: distinct dimensions
    dim, n = (told["dim"], told["count"]) if told else (1, 0)
    bits = bits or min(MAX_BITS, max(3, round(math.log2(max(2, n) / ROWS_PER_BUCKET))))
    planes = hash_planes(dim, bits, tables, seed)
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("tbl", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("doc_id", id_type),
                           T.StructField("same", T.ArrayType(id_type)), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    distinct.mapInArrow(_bucket_rows(planes, to_arrow_schema(schema)), schema).write.mode("overwrite").parquet(f"{path}/buckets")
    buckets = spark.read.schema(schema).parquet(f"{path}/buckets")
    (buckets.groupBy("tbl", "bucket").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
     .write.mode("overwrite").parquet(f"{path}/crowds"))
    crowds = spark.read.parquet(f"{path}/crowds")
    asked = buckets.where("tbl = 0").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select(F.col("doc_id").alias("query_id"), F.col("vec").alias("query_vector"))
    one_table = buckets.where("tbl = 0").select("doc_id", F.col("vec").alias("vector"))
    near = vector_top_k(one_table, asked, k + 1).where("query_id <> doc_id").join(asked, "query_id").join(
        one_table.select("doc_id", "vector"), "doc_id").select("query_vector", "vector").collect()  # sample * (k + 1) rows at most
    if near:
        q, d = (np.array(x, np.float64) for x in zip(*near))
        cost, place = probe_order(q, planes), codes(d, planes) + np.arange(tables) * (1 << bits)
        # A bucket is probed once as many are allowed as cost no more; a neighbour is found with the first of its buckets.
        found = np.sort((cost[:, :, None] <= np.take_along_axis(cost, place, 1)[:, None, :]).sum(1).min(1))
        probes = int(found[math.ceil(target * len(found)) - 1])
    else:
        probes = 1
    return HashIndex(buckets, crowds, planes, probes, k)


def _probes(index: HashIndex, arrow: pa.Schema):
    planes, wanted = index.planes, index.probes

    def run(batches):
        tables, dim, bits = planes.shape
        take = min(wanted, tables << bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows, unit = unit_rows(some.column("query_vector"), dim)
                if not len(rows):
                    continue
                cost = probe_order(unit, planes)
                best = np.argpartition(cost, take - 1, axis=1)[:, :take] if take < cost.shape[1] else np.tile(np.arange(cost.shape[1]), (len(rows), 1))
                of = np.repeat(np.arange(len(rows)), take)
                yield pa.RecordBatch.from_arrays(
                    [some.column("query_id").take(pa.array(rows[of])), pa.array((best.ravel() >> bits).astype(np.int32)),
                     pa.array(best.ravel() & ((1 << bits) - 1), pa.int64())], schema=arrow)
    return run


def approximate_top_k(index: HashIndex, requests: DataFrame, k: int | None = None, query_id: str = "query_id", query_vec: str = "query_vector") -> DataFrame:
    """(query_id, doc_id, similarity rounded to 6, rank): exact cosines of the candidates in the probed buckets.

    Query ids must be distinct. Requests without a vector of the index's dimension get no rows.
    """
    k = k or index.k
    if k > index.k:
        raise ValueError(f"the index keeps {index.k} ids of equal vectors")
    dim = index.planes.shape[1]
    id_type, doc_type = requests.schema[query_id].dataType, index.buckets.schema["doc_id"].dataType
    asked = requests.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("query_vector"))
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("tbl", T.IntegerType()), T.StructField("bucket", T.LongType())])
    probed = asked.mapInArrow(_probes(index, to_arrow_schema(schema)), schema).join(index.crowds, ["tbl", "bucket"])
    crowd = probed.groupBy("tbl", "bucket").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("request_parts"))
    # Every part of a bucket's vectors meets every part of its requests, each pair in a group of its own.
    key = ["tbl", "bucket", "part", "request_part"]
    # A row for each bucket, tables * 2**MAX_BITS at most unless ``bits`` was given: vectors are shuffled once, for the cogroup.
    few = (lambda df: F.broadcast(df)) if index.planes.shape[2] <= MAX_BITS else (lambda df: df)
    left = (index.buckets.join(few(crowd), ["tbl", "bucket"]).join(few(index.crowds), ["tbl", "bucket"])
            .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
            .withColumn("request_part", F.explode(F.sequence(F.lit(0), F.col("request_parts") - 1))).select(*key, "doc_id", "same", "vec"))
    right = (probed.join(few(crowd), ["tbl", "bucket"]).withColumn("request_part", F.pmod(F.xxhash64("query_id"), F.col("request_parts")).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(asked, "query_id").select(*key, "query_id", "query_vector"))
    out = T.StructType([T.StructField("query_id", id_type), T.StructField("doc_id", doc_type), T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def score(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        """A bucket's vectors against the requests that probe it: k best of each request."""
        if not vectors.num_rows or not asking.num_rows:
            return arrow.empty_table()
        vectors, asking = vectors.combine_chunks(), asking.combine_chunks()
        d = vectors.column("vec").combine_chunks().flatten().to_numpy().reshape(vectors.num_rows, dim)
        of, q = unit_rows(asking.column("query_vector").combine_chunks(), dim)
        doc, same = vectors.column("doc_id").to_pylist(), vectors.column("same").to_pylist()
        query = asking.column("query_id").to_pylist()
        found = []
        step = max(1, (1 << 21) // len(d))
        for at in range(0, len(q), step):
            near = np.round(q[at:at + step] @ d.T, 6)
            limit = np.partition(near, len(d) - k, axis=1)[:, len(d) - k] if len(d) > k else np.full(len(near), -2.0)
            for r, c in zip(*(x.tolist() for x in np.nonzero(near >= limit[:, None]))):
                found.append((query[of[at + r]], -near[r, c], doc[c], c))
        found.sort(key=lambda x: (x[1], x[2]))
        rows, left_of = [], {}
        for who, minus, _, c in found:
            if (n := left_of.get(who, k)) > 0:
                rows += [(who, x, -minus) for x in same[c][:n]]
                left_of[who] = n - len(same[c][:n])
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), arrow.types)], schema=arrow)

    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, out)
    return top_k_per_group(best.distinct(), "query_id", [F.desc("similarity"), "doc_id"], k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(requests, exact_hits, found, recall, exact_scores): how much of the exact lists was found, over all requests, and
    whether every found row has the exact similarity."""
    both = exact.select("query_id", "doc_id", "similarity").join(
        approximate.select("query_id", "doc_id", F.col("similarity").alias("told")), ["query_id", "doc_id"], "left")
    per = both.groupBy("query_id").agg(F.count("*").alias("n"), F.count("told").alias("found"), F.count_if(F.abs(F.col("told") - F.col("similarity")) > 1.5e-6).alias("off"))
    return per.agg(F.count("*").alias("requests"), F.sum("n").alias("exact_hits"), F.sum("found").alias("found"),
                   (F.sum("found") / F.sum("n")).alias("recall"), (F.sum("off") == 0).alias("exact_scores"))

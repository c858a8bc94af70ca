"""Helpers shared by the corpus operators: table reading, durable intermediates, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is named, a scratch folder in local mode only (tests); on a cluster that is
    an error, since the executors would not reach it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="corpus-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The table is on storage that every executor reaches, so a lost executor costs no
    recomputation of what came before, and the plan above starts from a plain scan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def translate_table(keeps: Callable[[int], bool]) -> bytes:
    """A ``bytes.translate`` table: kept bytes stay, A-Z lowered, every other byte becomes a space."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if keeps(b) else 32 for b in range(256))


def blocks_of(text: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """A translated text in order, cut at the first space after every ``limit`` bytes."""
    at = 0
    while len(text) - at > limit:
        end = text.find(b" ", at + limit)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """``(u, v)`` long edges -> ``(node, root)``: the smallest node reachable from every node with an edge.

    Alternating large-star and small-star steps; neighbour minima are plain aggregates with map-side
    combine, so a hub with a third of all edges is never gathered in one task, and the joins that carry
    a minimum back to the edges are inner joins that adaptive execution can split. Every round is a
    written table; rounds go on until nothing changes (their number grows with the logarithm of a component's size); edges shrink to one star per component. Nulls and self-loops are ignored.
    """
    now = stored(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), tag)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.inline(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct())
        now = stored(small, tag)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark

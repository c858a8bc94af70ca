"""Best-fit packing by a length histogram.

Documents become pieces of at most ``limit`` tokens. Only the histogram of piece lengths (``limit``
counts) reaches the driver; best fit in decreasing length runs over its counts and gives, for every
length, ranges of ranks with the sequences and offsets they take. Pieces then take their slot by a join
on their rank within the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemetrics.llm.common import stored
from coursemetrics.llm.tokens import Encoder

END_ID = 2


def pieces(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
           end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and the piece's place in its task.

    ``shard`` is the writing task and ``seq`` the piece's number among those of its length there; once the
    rows are written they number the pieces of a length without a sort or a shuffle of pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder(tokenizer, ids=True), TaskContext.get().partitionId()
        tail, seen = int(end_id).to_bytes(4, "little"), np.zeros(limit + 1, np.int64)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows, out = [], []
            for row, ids in enumerate(encoder.stream(texts)):
                ids += tail
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = limit if piece or n <= limit or n % limit == 0 else n % limit
                    length = min(length, n - start)
                    out.append((piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), seen[length]))
                    rows.append(row)
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            if not rows:
                continue
            made = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(made[:, 0], pa.int64()).cast(pa.int32()),
                 *(pa.array(made[:, i]) for i in (1, 2, 3, 4)), pa.array(np.full(len(rows), shard, np.int64))],
                names=[id_col, "piece", "start", "length", "ids_crc32", "seq", "shard"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
                           *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "seq", "shard"))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit in decreasing length over counts.

    Returns (length, first rank, end rank, first sequence, pieces a sequence, offset of its first piece);
    the rank r of a range takes sequence ``first + (r - from) // each`` at ``offset + (r - from) % each * length``.
    Sequences with the same free room are handled together, so the work depends on ``limit``, not on counts.
    """
    free: dict[int, list[list[int]]] = {}
    made, sequences = [], 0

    def put(length: int, rank: int, count: int, first: int, each: int, room: int) -> None:
        made.append((length, rank, rank + count, first, each, limit - room))
        if left := room - each * length:
            free.setdefault(left, []).append([first, -(-count // each)])

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while count:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                each, whole = limit // length, count // (limit // length)
                group = [sequences, whole or 1]
                sequences += group[1]
                room = limit
            else:
                group = free[room].pop()
                if not free[room]:
                    del free[room]
                each, whole = room // length, count // (room // length)
            take = min(whole, group[1])
            if take:
                put(length, rank, take * each, group[0], each, room)
                used = take
                rank, count = rank + take * each, count - take * each
            else:  # fewer pieces are left than one sequence has room for
                put(length, rank, count, group[0], count, room)
                used, rank, count = 1, rank + count, 0
            if room < limit and used < group[1]:
                free.setdefault(room, []).append([group[0] + used, group[1] - used])
    return made


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = END_ID) -> DataFrame:
    """Pack all documents into as few sequences of at most ``limit`` tokens as best fit finds.

    Null and empty texts are the end token alone; repeated rows and ties are pieces of their own; a null id
    stays null; an empty table gives no rows; other columns are not read. Only documents longer than ``limit``
    are cut, into full pieces after a shorter first one. Returns id, piece, start, length, ids_crc32,
    sequence_id and offset.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, limit, id_col, text_col, end_id), "pieces")
    counts = cut.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = counts.select("length", "shard", (F.sum("n").over(
        Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    # At most `limit` rows reach the driver, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Bounded by `limit` too: a length opens new sequences once and closes or splits groups of equal room.
    slots = spark.createDataFrame(plan(histogram, limit), "plan_length long, rank_from long, rank_to long, first long, each long, base long")
    placed = cut.join(before, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("seq"))
    within = F.col("rank") - F.col("rank_from")
    return (placed.join(F.broadcast(slots), (F.col("length") == F.col("plan_length"))
                        & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
            .select(id_col, "piece", "start", "length", "ids_crc32",
                    (F.col("first") + F.floor(within / F.col("each"))).alias("sequence_id"),
                    (F.col("base") + within % F.col("each") * F.col("length")).alias("offset")))

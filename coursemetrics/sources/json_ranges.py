"""Large JSON array files read by byte ranges: one array per file, many tasks per file.

The text source cuts files at byte ranges on any file system it knows; with ``}`` as its line end a row is a chunk of a
record, however the file is laid out. What a range can't know by itself is where in the array it begins, so its chunks are
read twice: first each range tells, for both cases of beginning inside or outside a string, how it changes the nesting and
how many records it ends; these are chained file by file (a row for each range); then each range cuts its chunks
into records from a known state. A record that lies in several ranges leaves a piece in each, and only pieces are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LEADING = r"^[\s,\[\uFEFF]+"
ESCAPED = re.compile(rb"\\.", re.S)
NEST = np.zeros(256, np.int8)       # change of nesting at each byte
NEST[[ord(c) for c in "{["]], NEST[[ord(c) for c in "}]"]] = 1, -1
QUOTE, CLOSE = ord('"'), ord("}")
RANGE = ("file", "start")


def brackets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of all brackets, their bytes, whether an odd number of quotes stands before each, quotes in all)."""
    plain = np.frombuffer(ESCAPED.sub(b"xx", data), np.uint8)
    places = np.flatnonzero(NEST[plain])
    quotes = np.flatnonzero(plain == QUOTE)
    return places, plain[places], (np.searchsorted(quotes, places) & 1).astype(bool), len(quotes)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "}").text(path)
            .select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def _runs(batches):
    """Batches cut where the range changes: (file, start, first row, text with the line ends put back)."""
    for batch in batches:
        starts = batch.column("start").to_numpy()
        files = batch.column("file").to_numpy()
        cuts = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                texts = batch.column("value").slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                yield int(files[lo]), int(starts[lo]), batch.slice(lo, 1), b"}".join(texts) + b"}"


def _told(batches):
    """Of each range, for both ways to begin: change of nesting, string state at the end, and how many ``}`` stand at each
    nesting, counted from the range's beginning."""
    held: dict = {}
    for file, start, _, data in _runs(batches):
        _, kind, odd, quotes = brackets(data)
        for begins in (False, True):
            state = held.setdefault((file, start, begins), [0, begins, Counter()])
            mine = kind[odd == state[1]]
            depth = state[0] + np.cumsum(NEST[mine], dtype=np.int64)
            at, n = np.unique(depth[mine == CLOSE], return_counts=True)
            state[2].update(dict(zip(at.tolist(), n.tolist())))
            state[0] = int(depth[-1]) if len(depth) else state[0]
            state[1] ^= bool(quotes & 1)
    rows = [(f, s, b, d, i, list(ends), list(ends.values())) for (f, s, b), (d, i, ends) in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, (
        pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
        names=["file", "start", "begins", "depth", "inside", "at", "ends"])


def _chained(table: pa.Table) -> pa.Table:
    """The ranges of one file in order: nesting, string state and number of the record at the beginning of each."""
    told = {(r["start"], r["begins"]): r for r in table.to_pylist()}
    file, depth, inside, record, rows = table.column("file")[0].as_py(), 0, False, 0, []
    for start in sorted({s for s, _ in told}):
        rows.append((file, start, depth, inside, record))
        r = told[start, inside]
        record += sum(n for at, n in zip(r["at"], r["ends"]) if depth + at == 1)
        depth, inside = depth + r["depth"], r["inside"]
    return pa.table([pa.array(x) for x in zip(*rows)], names=["file", "start", "depth0", "inside0", "record0"])


def _cut(batches):
    """Records of each range as (file, record, start, whole, text)."""
    held: dict = {}     # of the range that is read: nesting, string state, number of the open record, its text, whether it began here

    def as_batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
            names=["file", "record", "start", "whole", "text"])

    def left():
        return [(*key[:1], record, key[1], False, text) for key, (_, _, record, text, _) in held.items() if text.strip(b" \t\r\n]}")]

    for file, start, first, data in _runs(batches):
        key, rows = (file, start), []
        if key not in held:
            rows += left()
            r = first.to_pylist()[0]
            held = {key: (r["depth0"], r["inside0"], r["record0"], b"", r["depth0"] <= 1 and not r["inside0"])}
        depth, inside, record, text, whole = held[key]
        places, kind, odd, quotes = brackets(data)
        mine = odd == inside
        places, kind = places[mine], kind[mine]
        nesting = depth + np.cumsum(NEST[kind], dtype=np.int64)
        at = 0
        for end in (places[(kind == CLOSE) & (nesting == 1)] + 1).tolist():
            rows.append((file, record, start, whole, text + data[at:end]))
            at, record, text, whole = end, record + 1, b"", True
        depth = int(nesting[-1]) if len(nesting) else depth
        held[key] = (depth, inside ^ bool(quotes & 1), record, b"" if depth < 1 else text + data[at:], whole)
        if rows:
            yield as_batch(rows)
    if rows := left():
        yield as_batch(rows)


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record, text)``: the text of every object in the arrays at ``path``, with a hash of its file's path and its place there.

    Ranges are as large as the session's ``spark.sql.files.maxPartitionBytes``. What follows the last whole record of a file that
    breaks off comes as a record too, so that a parser can tell.
    """
    chunks = _chunks(spark, path)
    told = chunks.mapInArrow(_told, "file long, start long, begins boolean, depth long, inside boolean, at array<long>, ends array<long>")
    # A range may be read in two batches of a task, never in two tasks.
    begins = told.groupBy("file").applyInArrow(_chained, "file long, start long, depth0 long, inside0 boolean, record0 long")
    # A row for each range of bytes: a few numbers for every 128 MB read.
    known = chunks.join(F.broadcast(begins), list(RANGE))
    pieces = known.mapInArrow(_cut, "file long, record long, start long, whole boolean, text binary").withColumn("text", F.col("text").cast("string"))
    split = (pieces.where("not whole").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))  # ranges of a record
             .select("file", "record", F.array_join(F.col("p.text"), "").alias("text")))
    return (pieces.where("whole").select("file", "record", "text").unionByName(split)
            .withColumn("text", F.regexp_replace("text", LEADING, "")))


def read_array_files(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """Rows of the array files at ``path`` with a declared schema, as ``raw.read_raw`` gives them, from many tasks a file.
    ``corrupt`` names a column for the text of records that don't parse."""
    options = {}
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        options["columnNameOfCorruptRecord"] = corrupt
    return array_records(spark, path).select(F.inline(F.array(F.from_json("text", schema, options))))

"""Suffix-array deduplication: bytes of long strings that occur anywhere else, by a distributed merge sort.

A full suffix array of the corpus would move every suffix. Of the suffixes only those are sorted that can
show a repeat: every window of ``length`` bytes holds the place where a hash of KGRAM bytes is smallest (its
anchor), equal windows have their anchor at the same offset, and an anchor whose KGRAM bytes occur once in
the corpus shows nothing. What is left is sorted as suffixes:

* a task makes sorted runs of its anchors' suffixes, front-coded (shared prefix with the predecessor, rest);
* runs are exchanged by the hash of the first KGRAM bytes, so all suffixes that can share them meet;
* a loser tree merges the runs: contenders carry the prefix they share with the last output, compare those
  numbers first and, only where they are equal, the bytes behind it, and the merge yields the common prefix
  of neighbours without comparing known bytes again.

The bytes before the anchor travel along. A window that starts j bytes before its anchor is repeated exactly
where two suffixes share length - j bytes and the j bytes before them are equal, which is read off the sorted
order for every j. Equal texts are taken once; equal surroundings of anchors are merged in their task.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemetrics.llm.common import stored

KGRAM = 32
BLOCK = 1 << 19
RUN_ROWS = 40_000
PART_ROWS = 60_000
#: Anchors with more places than this are compared window by window, see ``_hot_intervals``.
HOT_PLACES = 200_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0x9E3779B97F4A7C15 | 5, pow(0x9E3779B97F4A7C15 | 5, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """A well-mixed hash of the KGRAM bytes from every place on."""
    up, down = _powers(BLOCK + 4096)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    h = (sums[KGRAM:] - sums[:-KGRAM]) * down[:len(data) - KGRAM + 1]
    for shift, odd in ((32, 0xD6E8FEB86659FD93), (29, 0xA5CB3B1F0A9D2C6B)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(odd)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest (or largest) of every ``width`` neighbours."""
    op, fill = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, np.uint64(0))
    n = len(x) - width + 1
    y = np.append(x, np.full(-len(x) % width, fill, np.uint64)).reshape(-1, width)
    front = op.accumulate(y, axis=1).ravel()
    back = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], front[width - 1:width - 1 + n])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows of a text, in blocks of window starts."""
    places, hashes, width = [], [], length - KGRAM + 1
    for at in range(0, len(text) - length + 1, BLOCK):
        h = kgram_hashes(np.frombuffer(text, np.uint8, min(BLOCK + length - 1, len(text) - at), at))
        low = _sliding(h, width, True)
        most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), width, False)
        own = np.flatnonzero(most == h)
        places.append(own + at)
        hashes.append(h[own])
    if len(places) < 2:
        return (places[0], hashes[0]) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    places, first = np.unique(np.concatenate(places), return_index=True)  # blocks overlap
    return places, np.concatenate(hashes)[first]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    n = min(len(a), len(b)) - known
    if n <= 0:
        return known
    x = int.from_bytes(a[known:known + n]) ^ int.from_bytes(b[known:known + n])
    return known + n - (x.bit_length() + 7) // 8


def front_code(rows: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, reversed bytes before it, smallest source, largest source) as one blob."""
    shared, last = [], b""
    for suffix, *_ in rows:
        shared.append(common(last, suffix))
        last = suffix
    n = len(rows)
    head = np.array([shared, [len(r[0]) for r in rows], [len(r[1]) for r in rows]], "<u2").tobytes()
    source = np.array([[r[2] for r in rows], [r[3] for r in rows]], "<i8").tobytes()
    body = b"".join([*(r[0][k:] for r, k in zip(rows, shared)), *(r[1] for r in rows)])
    return struct.pack("<I", n) + zstandard.compress(head + source + body, 5)


class Run:
    """Reads a front-coded run, one suffix at a time."""

    def __init__(self, blob: bytes):
        n, data = struct.unpack_from("<I", blob)[0], zstandard.decompress(blob[4:])
        self.shared, self.sizes, before = (np.frombuffer(data, "<u2", n, 2 * n * i).tolist() for i in range(3))
        self.low, self.high = (np.frombuffer(data, "<i8", n, 6 * n + 8 * n * i).tolist() for i in range(2))
        self.data, self.at = data, 22 * n
        left, ends = 22 * n + sum(self.sizes) - sum(self.shared), np.cumsum([0, *before]).tolist()
        self.before = [data[left + a:left + b] for a, b in zip(ends, ends[1:])]
        self.row, self.suffix = -1, b""

    def next(self) -> bool:
        """Step to the next suffix; ``suffix`` and ``shared[row]`` (with the one before it) are set."""
        self.row += 1
        if self.row >= len(self.sizes):
            return False
        k, size = self.shared[self.row], self.sizes[self.row]
        self.suffix = self.suffix[:k] + self.data[self.at:self.at + size - k]
        self.at += size - k
        return True


def merge(runs: list[Run]) -> Iterator[tuple[Run, int]]:
    """Loser tree over sorted runs: yields (run, prefix shared with the output before) in order.

    Every contender knows the prefix it shares with the last output. Of two, the one that shares more is smaller
    and the other's number stays right; only equal numbers need bytes, from there on.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    prefix = [0] * leaves
    alive = [i < len(runs) and runs[i].next() for i in range(leaves)]

    def beats(a: int, b: int) -> bool:
        """Whether a comes before b; the loser's prefix becomes the one it shares with the winner."""
        if not alive[b]:
            return True
        if not alive[a]:
            return False
        if prefix[a] != prefix[b]:
            return prefix[a] > prefix[b]
        x, y = runs[a].suffix, runs[b].suffix
        k = common(x, y, prefix[a])
        first = k == len(x) or k < len(y) and x[k] < y[k]
        prefix[b if first else a] = k
        return first

    losers, winners = [0] * leaves, [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if leaves > 1 else 0
    while alive[top]:
        yield runs[top], prefix[top]
        if runs[top].next():
            prefix[top] = runs[top].shared[runs[top].row]
        else:
            alive[top] = False
        node = (top + leaves) // 2
        while node:
            if not beats(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2


def _classes(order_lcp: np.ndarray, depth: int) -> np.ndarray:
    return np.cumsum(order_lcp < depth)


def repeated_windows(blobs: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """(id of the surroundings, covered ranges relative to the anchor) of all anchors in a repeated window."""
    suffixes, before, low, high, shared = [], [], [], [], []
    for run, k in merge([Run(b) for b in blobs]):
        i = run.row
        suffixes.append(run.suffix)
        before.append(run.before[i])
        low.append(run.low[i])
        high.append(run.high[i])
        shared.append(k)
    n = len(suffixes)
    if not n:
        return
    right = np.array(shared, np.int64)
    right[0] = -1
    near = np.maximum(right, np.append(right[1:], -1)) >= KGRAM  # others only share a hash value's remainder
    sizes = np.fromiter(map(len, suffixes), np.int64, n)
    by_left = sorted(range(n), key=before.__getitem__)
    left = np.array([-1, *(common(before[a], before[b]) for a, b in zip(by_left, by_left[1:]))], np.int64)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    left_sizes = np.fromiter(map(len, before), np.int64, n)
    # Equal surroundings: the same whole suffix and the same bytes before it.
    same_right = np.cumsum((right != sizes) | (sizes != np.concatenate([[-1], sizes[:-1]])))
    ordered = left_sizes[by_left]
    same_left = np.cumsum((left != ordered) | (ordered != np.concatenate([[-1], ordered[:-1]])))[rank]
    _, first, whole = np.unique(same_right * (n + 1) + same_left, return_index=True, return_inverse=True)
    smallest, largest = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(smallest, whole, np.array(low))
    np.maximum.at(largest, whole, np.array(high))
    often = smallest != largest  # in more than one place
    use = first[near[first] | often]
    hit = np.zeros((len(use), length - KGRAM + 1), bool)
    for j in range(length - KGRAM + 1):
        valid = (left_sizes[use] >= j) & (sizes[use] >= length - j)
        key = _classes(right, length - j)[use] * (n + 1) + _classes(left, j)[rank[use]]
        _, of, count = np.unique(key[valid], return_inverse=True, return_counts=True)
        hit[valid, j] = (count[of] > 1) | often[whole[use[valid]]]
    for row in np.flatnonzero(hit.any(1)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[row].view(np.int8), [0]])))
        i = use[row]
        yield surroundings_id(suffixes[i], before[i]), [(int(1 - b), int(length - a)) for a, b in zip(edges[::2], edges[1::2])]


def surroundings_id(suffix: bytes, before: bytes) -> bytes:
    return xxhash.xxh3_128_digest(struct.pack("<H", len(suffix)) + suffix + before)


def _anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """``hash, tid, place`` of every anchor; texts that a task sees again are skipped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tids, hashes, places = [], [], []
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if tid not in seen:
                    seen.add(tid)
                    own, h = anchors(text.as_buffer().to_pybytes(), length)
                    tids.append(np.full(len(own), tid, np.int64))
                    hashes.append(h.view(np.int64))
                    places.append(own.astype(np.int32))
            if tids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, tids, places)], names=["hash", "tid", "place"])

    return texts.where(F.octet_length("text") >= length).select("tid", "text").mapInArrow(run, "hash long, tid long, place int")


PLACES = T.ArrayType(T.StructType([T.StructField("text", T.BinaryType()), T.StructField("place", T.IntegerType())]))
ARROW_PLACES = pa.list_(pa.struct([("text", pa.binary()), ("place", pa.int32())]))


def _runs(candidates: DataFrame, length: int, parts: int) -> DataFrame:
    """Two kinds of rows: (part, blob) front-coded runs; (around, places) where anchors with equal surroundings stand in texts
    that only one row holds, a row for each surroundings and flush, so a hot passage is one row of a task."""
    back = length - KGRAM
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("blob", T.BinaryType()), T.StructField("around", T.BinaryType()),
                           T.StructField("places", PLACES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            by_part, around, places = defaultdict(list), [], []
            for (suffix, before), (low, high, own) in held.items():
                by_part[xxhash.xxh64_intdigest(suffix[:KGRAM]) % parts].append((suffix, before, low, high))
                if own:
                    around.append(surroundings_id(suffix, before))
                    places.append(own)
            held.clear()
            got = [(p, front_code(sorted(rows))) for p, rows in by_part.items()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary()),
                                              pa.nulls(len(got), pa.binary()), pa.nulls(len(got), ARROW_PLACES)], names=schema.names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(around), pa.int32()), pa.nulls(len(around), pa.binary()), pa.array(around, pa.binary()),
                                              pa.array(places, ARROW_PLACES)], names=schema.names)

        for batch in batches:
            for sha, copies, text, cold in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data, name = text.encode(), bytes.fromhex(sha[:32])
                for p in cold:
                    suffix, before = data[p:p + length], data[max(0, p - back):p][::-1]
                    if len(suffix) < KGRAM:
                        continue  # a place of another text with the same short id
                    source = xxhash.xxh64_intdigest(f"{sha}{p}") - (1 << 63)
                    old = held.setdefault((suffix, before), [source, source, []])
                    old[0], old[1] = min(old[0], source), max(old[1], source)
                    if copies == 1:
                        old[2].append({"text": name, "place": p})
                size += len(cold)
                if len(held) >= RUN_ROWS or size >= 8 * RUN_ROWS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return candidates.select("sha", "copies", "text", "cold").mapInArrow(run, schema)


def _hot_intervals(candidates: DataFrame, length: int) -> DataFrame:
    """``name, a, b`` of repeated windows around hot anchors, an exact way without a meeting of all their places.

    Every window becomes a digest of 128 bits, whose places are compared by an aggregate with map-side combine. A window
    that a text itself repeats is told at once, as ranges, and stands for all its places there in one row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, text, hot in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data, name, ends = text.encode(), bytes.fromhex(sha[:32]), np.array(hot, np.int64) + 1
                marks = np.zeros(len(data) + 2, np.int64)
                np.add.at(marks, np.maximum(0, ends - (length - KGRAM + 1)), 1)
                np.add.at(marks, np.minimum(ends, len(data) + 1), -1)
                starts = np.flatnonzero(np.cumsum(marks)[:max(0, len(data) - length + 1)])
                for k in range(0, len(starts), BLOCK):
                    own = starts[k:k + BLOCK]
                    digests = [xxhash.xxh3_128_digest(data[s:s + length]) for s in own.tolist()]
                    first: dict[bytes, int] = {}
                    again = {d for i, d in enumerate(digests) if first.setdefault(d, i) != i}
                    local = own[[d in again for d in digests]]
                    cuts = np.flatnonzero(np.diff(local) > length)
                    begin, end = local[np.append(0, cuts + 1)] if len(local) else local, local[np.append(cuts, -1)] + length if len(local) else local
                    windows = list(first)
                    at = own[[first[d] for d in windows]] if windows else own
                    n = len(windows) + len(begin)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([*windows, *[None] * len(begin)], pa.binary()), pa.array([name] * n, pa.binary()), pa.array(np.concatenate([at, begin])),
                         pa.array(np.concatenate([at + length, end])), pa.array([*(d in again for d in windows), *[True] * len(begin)], pa.bool_())],
                        names=["window", "name", "a", "b", "local"])

    found = stored(candidates.where(F.size("hot") > 0).select("sha", "text", "hot").mapInArrow(run, "window binary, name binary, a long, b long, local boolean"), "suffix-hot")
    place, windows = F.xxhash64("name", "a"), found.where("window is not null")
    often = (windows.groupBy("window").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("local").alias("twice"))
             .where("low <> high or twice").select("window"))
    return found.where("window is null").select("name", "a", "b").unionByName(windows.join(often, "window").select("name", "a", "b"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the bytes that no string of ``length`` bytes found elsewhere covers.

    Texts are UTF-8 bytes, strings never cross documents, overlaps within a document count, and all strings are
    judged on the input. Null texts are empty; texts shorter than ``length`` stay; a text that two rows hold
    goes whole, in both; a null id stays null; other columns are not read; an empty table gives no rows.
    Returns the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary) and ``kept_sha256``; ``kept`` is null where all
    bytes or none are left out, so whole texts are not moved again.
    """
    if length < 2 * KGRAM:
        raise ValueError(f"length must be {2 * KGRAM} or more")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    base = stored(texts.select("id", "tid", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "suffix-base")
    found = _anchor_table(texts, length)  # computed for the counts and again for the join: cheaper than a place on disk
    place = F.xxhash64("tid", "place")
    often = (found.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"))
             .where("low <> high").select("hash", (F.col("n") > HOT_PLACES).alias("is_hot")))
    kept = found.join(often, "hash").groupBy("tid", "place").agg(F.max("is_hot").alias("is_hot"))
    # The places of a text in one row: as bounded as the text.
    places = kept.groupBy("tid").agg(F.collect_list(F.when(~F.col("is_hot"), F.col("place"))).alias("cold"), F.collect_list(F.when(F.col("is_hot"), F.col("place"))).alias("hot"))
    copies = base.groupBy("sha", "tid", "n_bytes").agg(F.min("id").alias("low_id"), F.count("*").alias("copies"))
    # One row of every text is read again: the key holds its id, so copies of a text are spread.
    wanted = copies.join(places, "tid").select(F.xxhash64("sha", "low_id").alias("key"), F.col("sha").alias("own"), "copies", "cold", "hot")
    rows = texts.withColumn("sha", F.sha2("text", 256)).select(F.xxhash64("sha", "id").alias("key"), "sha", "text")
    candidates = stored(rows.join(wanted, "key").where("sha = own").select("sha", "copies", "text", "cold", "hot"), "suffix-candidates")
    total = candidates.agg(F.sum(F.size("cold"))).first()[0] or 0
    runs = stored(_runs(candidates, length, max(1, -(-total // PART_ROWS))), "suffix-runs")

    def merged(table: pa.Table) -> pa.Table:
        got = list(repeated_windows(table.column("blob").to_pylist(), length))
        return pa.table({"around": pa.array([x for x, _ in got], pa.binary()), "spans": pa.array([[{"a": a, "b": b} for a, b in s] for _, s in got], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})

    ranges = runs.where("part is not null").select("part", "blob").groupBy("part").applyInArrow(merged, "around binary, spans array<struct<a: int, b: int>>")
    # A text's name is half of its SHA-256.
    spans = (runs.where("around is not null").select("around", "places").join(ranges, "around")
             .select(F.explode("places").alias("p"), "spans").select("p", F.explode("spans").alias("s"))
             .select(F.col("p.text").alias("name"), (F.col("p.place").cast("long") + F.col("s.a")).alias("a"), (F.col("p.place").cast("long") + F.col("s.b")).alias("b")))
    by_text = (spans.unionByName(_hot_intervals(candidates, length)).groupBy("name")
               .agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, rest, at, spans_, removed = text.encode(), [], 0, 0, 0
                for r in ranges_:
                    if r["a"] > at or not spans_:
                        rest.append(data[at:r["a"]])
                        spans_, removed, at = spans_ + 1, removed + r["b"] - r["a"], r["b"]
                    elif r["b"] > at:
                        removed, at = removed + r["b"] - at, r["b"]
                rest = b"".join([*rest, data[at:]])
                out.append((removed, spans_, rest, hashlib.sha256(rest).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                                              pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.string())], names=["sha", "n_removed", "n_spans", "kept", "kept_sha256"])

    single = candidates.where("copies = 1").select("sha", "text", F.unhex(F.substring("sha", 1, 32)).alias("name"))
    parts = single.join(by_text, "name").select("sha", "text", "spans").mapInArrow(
        cut, "sha string, n_removed long, n_spans long, kept binary, kept_sha256 string")
    whole = copies.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select(
        "sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(None).cast("binary").alias("kept"), F.lit(EMPTY_SHA).alias("kept_sha256"))
    told = stored(parts.unionByName(whole), "suffix-result").withColumnRenamed("sha", "told_sha")
    zero = F.lit(0).cast("long")
    return base.join(told, F.col("sha") == F.col("told_sha"), "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        "kept", F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


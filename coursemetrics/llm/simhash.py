"""SimHash near-duplicates through a Gray-order hierarchical index.

Equal fingerprints are merged first, so copies cost one row. For a maximum distance d, the 64 bits are
cut into d + 1 blocks; fingerprints within d bits agree on a whole block. That agreed block is the
top masked pattern of the index and the key by which Spark deals the index out: every fingerprint goes
to d + 1 sub-indexes. In a task, the fingerprints of a sub-index are sorted by Gray rank, runs of them
share the bits on which all agree (a mask and a pattern) in an upper node, runs of nodes share theirs
in turn, and a search from the root adds up the differences of the shared bits and leaves a whole pair
of groups as soon as they exceed d. Linked fingerprints are merged in the task; only links to the
smallest fingerprint of each merged set leave it, which keeps every connection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemetrics.llm.common import connected_components, stored

FAN = 16
STEP = 1 << 20
ROWS = 1 << 18


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six white characters of ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:at + (1 << 15)], ends[at:at + (1 << 15)])], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > n).view(">u8")[0])


PRINT = "__simhash_print"


def with_fingerprint(docs: DataFrame, shingle: int, seed: int, text_col: str) -> DataFrame:
    """All columns of ``docs`` and the fingerprint of their text as a signed long."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x, shingle, seed) for x in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.view(np.int64))], names=[*batch.schema.names, PRINT])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(PRINT, T.LongType())]))


def gray_rank(fp: Column) -> Column:
    """Place of a 64-bit pattern in Gray order, as a signed long that sorts like the unsigned one."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def block_masks(blocks: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _levels(fp: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Index from the leaves up: (first child, end child, pattern of shared bits, mask of shared bits) of each node."""
    both = either = fp
    out = []
    while True:
        size = len(group)
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        if out and len(heads) == size:
            return out
        place = np.arange(size) - np.repeat(heads, np.diff(np.append(heads, size)))
        first = np.flatnonzero(place % FAN == 0)
        both, either = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(either, first)
        out.append((first, np.append(first[1:], size), both, ~(both ^ either)))
        group = group[first]


def _children(a: np.ndarray, b: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a child of a and a child of b (each once where a is b), and the pair they come from."""
    na, nb = end[a] - first[a], end[b] - first[b]
    of = np.repeat(np.arange(len(a)), na * nb)
    at = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
    left, right = first[a[of]] + at // nb[of], first[b[of]] + at % nb[of]
    keep = (a[of] != b[of]) | (left <= right)
    return left[keep], right[keep], of[keep]


def merge(fp: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """For every fingerprint (Gray-sorted within its group) the place of the representative it is linked to."""
    root, levels = np.arange(len(fp)), _levels(fp, group)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = root[a], root[b]
            low = np.minimum(x, y)
            if (x == y).all():
                return
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root[root] != root).any():
                root[:] = root[root]

    def search(level: int, a: np.ndarray, b: np.ndarray, gone: np.ndarray) -> None:
        """gone: the differences added up so far in each pair of nodes of this level."""
        first, end, pattern, mask = levels[level]
        size = (end[a] - first[a]) * (end[b] - first[b])
        part = np.cumsum(size) // STEP
        for k in np.unique(part):
            pa_, pb_, acc = a[part == k], b[part == k], gone[part == k]
            left, right, of = _children(pa_, pb_, first, end)
            known = mask[pa_[of]] & mask[pb_[of]]
            if level:
                _, _, below, below_mask = levels[level - 1]
                new = below_mask[left] & below_mask[right] & ~known
                total = acc[of] + np.bitwise_count((below[left] ^ below[right]) & new)
                keep = total <= limit
                if keep.any():
                    search(level - 1, left[keep], right[keep], total[keep])
            else:
                total = acc[of] + np.bitwise_count((fp[left] ^ fp[right]) & ~known)
                keep = (total <= limit) & (left != right)
                if keep.any():
                    link(left[keep], right[keep])

    tops = np.arange(len(levels[-1][0]))
    search(len(levels) - 1, tops, tops, np.zeros(len(tops), np.int64))
    return root


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links ``(u, v)`` that connect exactly the distinct ``fp`` joined by steps of at most ``max_bits`` bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_rows, full = 0, ROWS

        def flush(rows: np.ndarray) -> pa.RecordBatch | None:
            change = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            group = np.concatenate([[0], np.cumsum(change)])
            many = np.bincount(group)[group] > 1
            fp, group = rows[2][many], group[many]
            if not len(fp):
                return None
            root = merge(fp.view(np.uint64), group, max_bits)
            far = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[root[far]])], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(i).cast(pa.int64()).to_numpy() for i in range(3)]))
            held_rows += len(batch)
            if held_rows >= full:
                rows = np.concatenate(held, axis=1)
                cut = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
                if len(cut):  # whole groups go, the open one stays
                    if (out := flush(rows[:, :cut[-1] + 1])) is not None:
                        yield out
                    rows = rows[:, cut[-1] + 1:]
                held, held_rows = [rows], rows.shape[1]
                full = max(ROWS, 2 * held_rows)  # an open group is put together again only when it has doubled
        if held and (out := flush(np.concatenate(held, axis=1))) is not None:
            yield out

    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                               for i, m in enumerate(block_masks(max_bits + 1)))))
    dealt = (distinct.select("fp", keys.alias("k")).select("k.block", "k.key", "fp")
             .repartition("block", "key").sortWithinPartitions("block", "key", gray_rank(F.col("fp"))))
    return dealt.mapInArrow(run, "u long, v long")


def classes(prints: DataFrame, max_bits: int, id_col: str) -> DataFrame:
    """``fp, root, component_id`` of every distinct fingerprint in a stored table of ids and fingerprints."""
    distinct = stored(prints.groupBy(F.col(PRINT).alias("fp")).agg(F.min(id_col).alias("low")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), max_bits), "simhash-links")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return named.select("fp", "root", "low").join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root")


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = 42,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and near-duplicate class of every row.

    Returns the id, ``fp`` (the 64 bits as a signed long) and ``component_id``: the smallest id reachable over
    steps of at most ``max_bits`` differing bits, its own included. Null, empty and white texts have the
    fingerprint 0 and are linked like others. Rows with a null id get the class of their fingerprint; a class
    without any id has a null ``component_id``. Repeated rows are kept; other columns are not read; an empty
    table gives no rows.
    """
    prints = stored(with_fingerprint(docs.select(id_col, text_col), shingle, seed, text_col).drop(text_col), "simhash")
    return (prints.join(classes(prints, max_bits, id_col).select("fp", "component_id"), F.col(PRINT) == F.col("fp"))
            .select(id_col, "fp", "component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = 42,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of every class, with all its columns.

    Where several rows of a class carry that id, those of the smallest fingerprint are taken and of these
    the row with the smallest hash over all columns. A row with a null id stands only for a class without
    any id. Null and empty texts form one class (with others near the fingerprint 0).
    """
    wide = stored(with_fingerprint(docs, shingle, seed, text_col), "simhash-docs")
    # The class's smallest id belongs to the fingerprints whose own smallest id it is.
    best = (classes(wide.select(id_col, PRINT), max_bits, id_col).where(F.col("low").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min("fp").alias("__best"), F.min("component_id").alias("__low"))
            .select("__best", "__low", F.xxhash64("__best", "__low").alias("__key")))
    rows = wide.withColumn("__row_key", F.xxhash64(PRINT, id_col))
    found = rows.join(best, (F.col("__row_key") == F.col("__key")) & (F.col(PRINT) == F.col("__best"))
                      & F.col(id_col).eqNullSafe(F.col("__low")))
    first = F.row_number().over(Window.partitionBy("__row_key", PRINT, id_col).orderBy(F.xxhash64(*docs.columns)))
    return found.withColumn("__n", first).where("__n = 1").select(*docs.columns)

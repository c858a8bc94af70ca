"""Catalogue search as Spark jobs: documents, filters, exact vector top-k,
BM25 keyword scoring, rank fusion, facets.

Scale notes
-----------
* Requests (queries) are packed into rows of at most MAX_REQUEST_BYTES, broadcast once each, read by each task
  with the first row of its partition. Their bytes are counted first (``request_blocks`` skips that); what needs
  more than one row is searched block by block, each block's hits written before the next, so neither a driver nor
  a task ever holds more than one and any number of requests is answered. Apart from that the result is a lazy frame.
* Documents are scored where they are scanned, in blocks of documents by requests (numpy on
  Arrow batches), and each task emits its k best rows per request. No document and no
  (request, document) pair is shuffled; the final top k is a window with a partial group
  limit before its shuffle.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from coursemetrics.functions.topk import top_k_per_group
from coursemetrics.session import checkpoint_dir

# Fixed values (our ranking choices; the hosted ranker's formula is not public).
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
MAX_REQUEST_BYTES = 64 << 20
MANY_REQUEST_BYTES = 4 << 20    # beyond these, k rows a request and partition are more than the documents
CELLS = 1 << 19     # documents x requests scored at once
BATCH_DOCUMENTS = 2048
WAITING_WORDS = 1 << 18     # words of documents that are looked up among the request terms at once

# filter spec: (document column, request column, "eq" | "le")
COURSE_FILTERS = [("department", "department", "eq"), ("skill_level", "skill_level", "eq"),
                  ("format", "format", "eq"), ("duration_hours", "max_duration_hours", "le")]


# ── documents (G1, G2, G8, G9) ─────────────────────────────────────────────

def course_embed_text(dim_courses: DataFrame, *keep: str) -> DataFrame:
    """``embed_text`` of every course; ``keep`` names further catalogue columns to carry along."""
    skills = F.array_join(F.coalesce(F.col("skills_taught"), F.array().cast("array<string>")), ", ")
    text = F.concat(
        F.lit("Title: "), F.col("title"), F.lit("\nDepartment: "), F.col("department"),
        F.lit("\nLevel: "), F.col("skill_level"), F.lit("\nFormat: "), F.col("format"),
        F.lit("\nDuration: "), F.col("duration_hours").cast("string"), F.lit(" hours"),
        F.lit("\nSkills: "), skills, F.lit("\nDescription: "), F.col("description"))
    return dim_courses.select("course_id", text.alias("embed_text"), *keep)


def course_vectors_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Binding: the catalogue entry of part key p takes the vector with vec_id = p."""
    return embeddings.select(F.format_string("COURSE-%04d", F.col("vec_id") + 1).alias("course_id"),
                             F.col("embedding").alias("content_vector"))


def search_docs(dim_courses: DataFrame, gold_course_completion: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Index documents: typed and defaulted fields, completion stats (left join, NULL when missing), vector."""
    stats = gold_course_completion.select("course_id", F.col("completion_rate_pct").alias("completion_rate"),
                                          "avg_score")
    docs = (dim_courses.join(stats, "course_id", "left")
            .select("course_id", "title",
                    F.coalesce(F.col("description"), F.lit("")).alias("description"),
                    "department", "skill_level", "format",
                    F.coalesce(F.col("duration_hours").cast("double"), F.lit(0.0)).alias("duration_hours"),
                    F.coalesce(F.col("skills_taught"), F.array().cast("array<string>")).alias("skills_taught"),
                    F.coalesce(F.col("num_modules").cast("int"), F.lit(0)).alias("num_modules"),
                    F.col("completion_rate").cast("double").alias("completion_rate"),
                    F.col("avg_score").cast("double").alias("avg_score")))
    if vectors is not None:
        docs = docs.join(vectors, "course_id", "left")
    return docs


def course_document(docs: DataFrame, course_id: str) -> DataFrame:
    """One document by id, vector excluded; no row when missing."""
    return docs.filter(F.col("course_id") == course_id).drop("content_vector")


def facet_counts(docs: DataFrame, fields=("department", "skill_level", "format"), array_fields=("skills_taught",)
                 ) -> DataFrame:
    parts = [docs.groupBy(F.col(f).cast("string").alias("value")).agg(F.count("*").alias("count"))
             .select(F.lit(f).alias("facet"), "value", "count") for f in fields]
    parts += [docs.select(F.explode(f).alias("value")).groupBy("value").agg(F.count("*").alias("count"))
              .select(F.lit(f).alias("facet"), "value", "count") for f in array_fields]
    return reduce(DataFrame.unionByName, parts)


def search_filter(department=None, skill_level=None, format_filter=None, max_duration_hours=None) -> Column:
    """AND of the given predicates (Column values, not pasted filter text)."""
    preds = []
    if department:
        preds.append(F.col("department") == F.lit(department))
    if skill_level:
        preds.append(F.col("skill_level") == F.lit(skill_level))
    if format_filter:
        preds.append(F.col("format") == F.lit(format_filter))
    if max_duration_hours is not None:
        preds.append(F.col("duration_hours") <= F.lit(float(max_duration_hours)))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


# ── requests beside document batches ───────────────────────────────────────

REQUESTS, STATS = "__requests", "__stats"


def _packed(requests: DataFrame, fields: list[Column]) -> DataFrame:
    """The requests of a block in one row for one broadcast."""
    return requests.agg(F.collect_list(F.struct(*fields)).alias(REQUESTS), F.min(F.lit(0)).alias("__key"))


def _block_count(requests: DataFrame, size: Column) -> int:
    return _blocks_of(requests.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])


def _blocks_of(total: int) -> int:
    return -(-2 * total // MAX_REQUEST_BYTES) if total > MAX_REQUEST_BYTES else 1


def _blocks(requests: DataFrame, query_id: str, blocks: int | None, size: Column) -> list[DataFrame]:
    """Requests cut by the hash of their id. Counted by bytes, a block is half as large as allowed on average."""
    blocks = blocks or _block_count(requests, size)
    if blocks == 1:
        return [requests]
    bucket = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    return [requests.filter(bucket == i) for i in range(blocks)]


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"


def _written(df: DataFrame) -> DataFrame:
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_turn(parts: list[DataFrame]) -> DataFrame:
    """One block stays lazy; several are written one after the other, so that one is in memory at a time."""
    if len(parts) == 1:
        return parts[0]
    spark = parts[0].sparkSession
    root = _folder(spark)
    for i, part in enumerate(parts):
        part.write.parquet(f"{root}/block={i}")
    return spark.read.schema(parts[0].schema).parquet(root).select(*parts[0].columns)


def _dealt(docs: DataFrame, request_bytes: int) -> DataFrame:
    """Documents for many requests, in few partitions of like size: each one answers every request with its own k best."""
    return docs.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism) if request_bytes > MANY_REQUEST_BYTES else docs


def _beside(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """``docs`` with the packed requests in the first row of every partition: a task reads them once,
    documents are neither shuffled nor copied, and nothing runs before the plan does."""
    first = F.when(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, F.lit(0))
    return (docs.withColumn("__first", first)
            .join(F.broadcast(packed), F.col("__first") == F.col("__key"), "left").drop("__first", "__key"))


def _beside_first(batch: pa.RecordBatch, column: str) -> pa.StructArray:
    """What is packed beside the first row of a partition."""
    rows = batch.column(column)
    return rows[0].values if rows[0].is_valid else rows.values[:0]


def _sortable(ids: pa.Array) -> np.ndarray:
    values = ids.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (size of them) for each pair, one after the other."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


class _Filters:
    """The filter values of all requests: codes for equality, bounds for "le"; null means no condition."""

    def __init__(self, requests: pa.StructArray, filters):
        self.specs = list(filters or [])
        self.wanted = []
        for _, r, op in self.specs:
            values = requests.field(r).to_pylist()
            if op == "eq":
                codes = {v: i for i, v in enumerate(dict.fromkeys(v for v in values if v is not None))}
                self.wanted.append((codes, np.array([-1 if v is None else codes[v] for v in values], np.int64)))
            else:
                self.wanted.append((None, np.array([np.nan if v is None else float(v) for v in values])))
        self.bounds = [(i, w) for i, ((_, _, op), (_, w)) in enumerate(zip(self.specs, self.wanted)) if op == "le"]

    def document_values(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for (d, _, op), (codes, _) in zip(self.specs, self.wanted):
            values = batch.column(d).to_pylist()
            out.append(np.array([codes.get(v, -2) for v in values], np.int64) if op == "eq"
                       else np.array([np.inf if v is None else float(v) for v in values]))
        return out

    def groups(self, requests: int) -> list[tuple[tuple, np.ndarray]]:
        """Requests with the same equality values, which are scored together against the documents that have them."""
        wanted = [w for (_, _, op), (_, w) in zip(self.specs, self.wanted) if op == "eq"]
        if not requests or not wanted:
            return [((), np.arange(requests))] if requests else []
        same, of = np.unique(np.stack(wanted, axis=1), axis=0, return_inverse=True)
        order, of = np.argsort(of.ravel(), kind="stable"), np.sort(of.ravel())
        cuts = np.searchsorted(of, np.arange(len(same) + 1))
        return [(tuple(key.tolist()), order[a:b]) for key, a, b in zip(same, cuts, cuts[1:])]

    def equal(self, documents: list[np.ndarray], key: tuple, rows: np.ndarray) -> np.ndarray:
        """Which documents of ``rows`` have the equality values of a group."""
        mask = np.ones(len(rows), bool)
        for own, wanted in zip([o for (_, _, op), o in zip(self.specs, documents) if op == "eq"], key):
            mask &= (wanted < 0) | (own[rows] == wanted)
        return mask

    def refused(self, documents: list[np.ndarray], rows: np.ndarray, requests: np.ndarray) -> np.ndarray | None:
        """Which pairs (request, document of ``rows``) of a group the bounds exclude; both may be one longer axis each."""
        out = None
        for i, wanted in self.bounds:
            no = ~(np.isnan(wanted[requests]) | (documents[i][rows] <= wanted[requests]))
            out = no if out is None else out | no
        return out


class _TopK:
    """Best k documents of every request over the batches of a task: score (as an integer) descending, id ascending.

    Only what reaches a request's k-th score so far is looked at as a pair (request, document); the rest of a matrix of
    scores costs one comparison. Documents are kept as numbers into ``ids``.
    """

    PLACES = 1 << 20

    def __init__(self, k: int, requests: int, offset: int = 0, lowest: float = -np.inf):
        self.k, self.offset, self.lowest = k, offset, lowest
        self.scores, self.documents = np.full((requests, k), -1, np.int64), np.zeros((requests, k), np.int64)
        self.ids, self.most = None, 1 << 16

    def number(self, ids: np.ndarray) -> int:
        """Take the ids of a batch; its documents are numbered from the result on."""
        if self.ids is None:
            self.ids = ids[:0]
        if len(self.ids) > self.most:
            some = self.scores >= 0
            used, self.documents[some] = np.unique(self.documents[some], return_inverse=True)
            self.ids = self.ids[used]
            self.most = max(1 << 16, 2 * len(used))
        self.ids = np.concatenate([self.ids, ids])
        return len(self.ids) - len(ids)

    def least(self, requests: np.ndarray) -> np.ndarray:
        """Scores below these can't be among the best (one in the last place is allowed for)."""
        return np.maximum((np.maximum(self.scores[requests, -1], 0) - self.offset - 1) / 1e6, self.lowest)

    def offer(self, values: np.ndarray, requests: np.ndarray, documents: np.ndarray) -> None:
        """values: scores, requests by documents (numbers, in id order); -inf or not a number is no match."""
        width, least = len(documents), self.least(requests)
        unset = np.flatnonzero(self.scores[requests, -1] < 0)
        if len(unset) and width > 8 * self.k:  # the k-th best of the first documents
            first = np.nan_to_num(values[unset, :max(1024, 8 * self.k)], nan=-np.inf, neginf=-np.inf)
            least[unset] = np.maximum(least[unset], np.partition(first, -self.k, axis=1)[:, -self.k] - 2e-6)
        hit = values >= least[:, None]
        count = np.count_nonzero(hit, axis=1)
        crowded = count * 8 > width + 8 * self.k
        rows = np.flatnonzero(crowded)
        if len(rows):  # one partition finds the k best of each, the lowest ids among equal scores
            whole = np.where(hit[rows], np.rint(np.where(hit[rows], values[rows], 0) * 1e6).astype(np.int64) + self.offset, -1)
            hit[rows] = False
            keys = np.where(whole >= 0, whole * self.PLACES + (self.PLACES - 1 - np.arange(width)), -1)
            if width > self.k:
                keys = np.partition(keys, width - self.k, axis=1)[:, -self.k:]
            at, place = np.nonzero(keys >= 0)
            found = keys[at, place]
            self.take(requests[rows[at]], found // self.PLACES, documents[self.PLACES - 1 - found % self.PLACES])
        pairs = np.flatnonzero(hit)
        if len(pairs):
            self.take(requests[pairs // width], np.rint(values.ravel()[pairs] * 1e6).astype(np.int64) + self.offset, documents[pairs % width])

    def take(self, request: np.ndarray, score: np.ndarray, document: np.ndarray) -> None:
        """Merge pairs into the best."""
        keep = score >= np.maximum(self.scores[request, -1], 0)
        if not keep.any():
            return
        touched, row = np.unique(request[keep], return_inverse=True)
        old = self.scores[touched]
        had = old >= 0
        row = np.concatenate([np.nonzero(had)[0], row])
        score, document = np.concatenate([old[had], score[keep]]), np.concatenate([self.documents[touched][had], document[keep]])
        used, of = np.unique(document, return_inverse=True)
        by_id = np.empty(len(used), np.int64)
        by_id[np.argsort(self.ids[used], kind="stable")] = np.arange(len(used))
        order = np.lexsort((by_id[of], -score, row))
        row = row[order]
        at = np.arange(len(row)) - np.searchsorted(row, np.arange(len(touched)))[row]
        best = at < self.k
        scores, documents = np.full(old.shape, -1, np.int64), np.zeros(old.shape, np.int64)
        scores[row[best], at[best]], documents[row[best], at[best]] = score[order][best], document[order][best]
        self.scores[touched], self.documents[touched] = scores, documents

    def rows(self, query_ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch | None:
        if self.ids is None:
            return None
        request, at = np.nonzero(self.scores >= 0)
        ids = self.ids[self.documents[request, at]]
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(request)).cast(schema.field(0).type), pa.array(ids if ids.dtype.kind in "iU" else ids.tolist(), schema.field(1).type),
             pa.array((self.scores[request, at] - self.offset) / 1e6, pa.float64())], schema=schema)


def _result_schema(requests: DataFrame, query_id: str, docs: DataFrame, doc_id: str, value: str) -> T.StructType:
    return T.StructType([T.StructField("query_id", requests.schema[query_id].dataType), T.StructField("doc_id", docs.schema[doc_id].dataType),
                         T.StructField(value, T.DoubleType())])


# ── exact vector top-k (G4) ────────────────────────────────────────────────

ONE = 2_000_000  # a cosine of -1 is stored as 1,000,000: stored values are never negative


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors of one length, scaled to length 1; a zero vector has no direction and is not a number."""
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _local_vector_topk(k: int, filters, arrow: pa.Schema):
    def run(batches):
        top = None
        for batch in batches:
            if top is None:
                asked = _beside_first(batch, REQUESTS)
                lengths = np.array(pc.list_value_length(asked.field("qv")).fill_null(0))
                asked = asked.take(pa.array(np.flatnonzero(lengths)))
                dims = lengths.max(initial=0)
                if (lengths[lengths > 0] != dims).any():
                    raise ValueError("request vectors differ in length")
                q = _matrix(asked.field("qv"), dims) if dims else None
                told, top = _Filters(asked, filters), _TopK(k, len(asked), ONE)
                groups = told.groups(len(asked))
            vectors = batch.column("vec")
            valid = np.flatnonzero(np.array(pc.list_value_length(vectors).fill_null(-1)) == (dims or -2))
            if not len(valid):
                continue
            d, ids = _matrix(vectors.take(pa.array(valid)), dims), _sortable(batch.column("doc_id"))[valid]
            order = np.argsort(ids, kind="stable")
            valid, d, begin = valid[order], d[order], top.number(ids[order])
            own = told.document_values(batch)
            for key, members in groups:
                here = np.flatnonzero(told.equal(own, key, valid))
                if not len(here):
                    continue
                some, step = d[here].T, max(1, CELLS // len(here))
                for a in range(0, len(members), step):
                    sims = q[members[a:a + step]] @ some
                    no = told.refused(own, valid[here][None, :], members[a:a + step, None])
                    if no is not None:
                        sims[no] = -np.inf
                    top.offer(sims, members[a:a + step], begin + here)
        if top is not None and (out := top.rows(asked.field("query_id"), arrow)) is not None:
            yield out
    return run


def vector_top_k(docs: DataFrame, requests: DataFrame, k: int, doc_id: str = "doc_id", vec: str = "vector",
                 query_id: str = "query_id", query_vec: str = "query_vector", filters=None, request_blocks: int | None = None) -> DataFrame:
    """Exact cosine nearest neighbours: (query_id, doc_id, similarity rounded to 6, rank).

    Documents are scanned once for each block of requests, against all of its requests. For many requests the documents
    that have a vector are dealt over few partitions first; for several blocks of them they are written once.
    """
    schema = _result_schema(requests, query_id, docs, doc_id, "similarity")
    dsel = docs.select(F.col(doc_id).alias("doc_id"), F.col(vec).cast("array<double>").alias("vec"), *[d for d, _, _ in filters or []])
    fields = [F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("qv"), *[F.col(r) for _, r, _ in filters or []]]
    run = _local_vector_topk(k, filters, to_arrow_schema(schema))
    if request_blocks is None:
        total = requests.agg(F.coalesce(F.sum(_vector_bytes(query_vec)), F.lit(0))).first()[0]
        request_blocks = _blocks_of(total)
        dsel = _dealt(dsel.where("vec is not null"), total)
        if request_blocks > 1:
            dsel = _dealt(_written(dsel), total)
    parts = [_beside(dsel, _packed(block, fields)).mapInArrow(run, schema) for block in _blocks(requests, query_id, request_blocks, _vector_bytes(query_vec))]
    return top_k_per_group(_in_turn(parts), "query_id", [F.desc("similarity"), "doc_id"], k)


def _vector_bytes(vec: str) -> Column:
    return 8 * F.greatest(F.size(vec), F.lit(0)) + 32


def label_centroids(embeddings: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label (element-wise): per (label, position) averages, re-assembled in order."""
    cells = embeddings.select(label, F.posexplode(F.col(vec).cast("array<double>")))
    avg = cells.groupBy(label, "pos").agg(F.avg("col").alias("x"))
    return (avg.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("px"))  # dim entries
            .select(F.col(label).alias("query_id"), F.transform("px", lambda e: e["x"]).alias("query_vector")))


# ── BM25 keyword scoring (G5) ──────────────────────────────────────────────

def tokens(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_remove(F.split(F.lower(c), TOKEN_SPLIT), "")


def _hits(tokens_: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) of the request terms in a batch of token lists, ordered by document."""
    lengths = np.array(pc.list_value_length(tokens_).fill_null(0))
    found = pc.index_in(tokens_.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = found >= 0
    keys, tf = np.unique(doc[at] * max(1, len(terms)) + found[at], return_counts=True)
    return keys // max(1, len(terms)), keys % max(1, len(terms)), tf


def _slices(batches):
    """Batches of at most BATCH_DOCUMENTS rows: what is computed from a batch's tokens takes several times their memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCUMENTS):
            yield batch.slice(at, BATCH_DOCUMENTS)


def _local_statistics(batches):
    """Documents, texts, tokens, and the document frequency of every request term in a task.

    A lookup among the request terms costs all of them, so the words of many slices wait for one.
    """
    terms, df, told, waiting, counts = None, None, np.zeros(3, np.int64), [], []

    def look_up():
        nonlocal df
        at = pc.index_in(pa.concat_arrays(waiting), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        df += np.bincount(at[at >= 0], np.concatenate(counts)[at >= 0], len(df)).astype(np.int64)
        waiting.clear()
        counts.clear()

    for batch in _slices(batches):
        if terms is None:
            terms = _beside_first(batch, REQUESTS).field("term")
            df = np.zeros(len(terms), np.int64)
        toks = batch.column("toks")
        words, lengths = toks.flatten().dictionary_encode(), np.array(pc.list_value_length(toks).fill_null(0))
        width = max(1, len(words.dictionary))
        own = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + words.indices.to_numpy()) % width
        waiting.append(words.dictionary)
        counts.append(np.bincount(own, minlength=len(words.dictionary)))
        told += [batch.num_rows, batch.num_rows - toks.null_count, lengths.sum()]
        if sum(map(len, waiting)) > WAITING_WORDS:
            look_up()
    if terms is not None:
        look_up()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*NAMES, *["term"] * len(some)]), pa.concat_arrays([pa.nulls(3, pa.string()), terms.take(pa.array(some)).cast(pa.string())]),
                                          pa.array([*told.tolist(), *df[some].tolist()], pa.int64())], names=["kind", "term", "n"])


NAMES = ("documents", "texts", "tokens")


def _local_kept(arrow: pa.Schema):
    """Request terms that documents have, each with their number, and the totals of the documents."""
    def run(batches):
        terms = None
        for batch in batches:
            if terms is None:
                told = _beside_first(batch, STATS)
                total = dict(zip(told.field("kind").to_pylist(), told.field("n").to_pylist())) if len(told) else {}
                at = np.flatnonzero(np.array(pc.equal(told.field("kind"), "term"), bool))
                terms, n = told.field("term").take(pa.array(at)), told.field("n").take(pa.array(at))
            asked, had = batch.column("terms"), batch.column("kept")
            flat, lengths = asked.flatten(), np.array(pc.list_value_length(asked).fill_null(0))
            found = pc.index_in(flat, value_set=terms)
            at = np.flatnonzero(np.array(found.is_valid(), bool))
            row = np.concatenate([np.repeat(np.arange(len(had)), np.array(pc.list_value_length(had))), np.repeat(np.arange(len(lengths)), lengths)[at]])
            fresh = pa.StructArray.from_arrays([flat.take(pa.array(at)), n.take(found.take(pa.array(at)))], fields=list(had.type.value_type))
            cuts = np.searchsorted(np.sort(row), np.arange(len(lengths) + 1))
            kept = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.concat_arrays([had.flatten(), fresh]).take(pa.array(np.argsort(row, kind="stable"))))
            totals = pa.array([[total.get(x, 0) for x in NAMES]] * batch.num_rows, arrow.field("totals").type)
            columns = {x: batch.column(x) for x in arrow.names} | {"kept": kept, "totals": totals}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)
    return run


class _Group:
    """Requests with the same equality values, their terms (from the most to the least common in each request)."""

    def __init__(self, key: tuple, members: np.ndarray, row: np.ndarray, term: np.ndarray):
        self.key, self.members, self.row = key, members, row        # row: place in members
        self.terms, self.of = np.unique(term, return_inverse=True)
        self.begin = np.searchsorted(row, np.arange(len(members) + 1))

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sum over the terms of each request."""
        total = np.append(0.0, np.cumsum(values))
        return total[self.begin[1:]] - total[self.begin[:-1]]


class _Block:
    """The weights of a group's terms in its documents of a batch, by term."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, documents: int, terms: int):
        order = np.argsort(term, kind="stable")  # documents stay in order within a term
        self.doc, self.term, self.weight, self.documents, self.terms = doc[order], term[order], weight[order], documents, terms
        self.cuts = np.searchsorted(self.term, np.arange(terms + 1))
        self.df = np.diff(self.cuts)
        self.top = np.zeros(terms)
        some = np.flatnonzero(self.df)
        self.top[some] = np.maximum.reduceat(self.weight, self.cuts[some])
        self.common = np.flatnonzero(self.df * 8 > documents)
        self.matrix = None

    def dense(self, row: np.ndarray, term: np.ndarray, requests: int) -> np.ndarray:
        """Summed weights, requests by documents. Terms in many documents of the block are a matrix product, so a word that
        nearly every text has costs no (request, document) pairs; the others are added up pair by pair."""
        column = np.full(self.terms, -1)
        column[self.common] = np.arange(len(self.common))
        if self.matrix is None:
            self.matrix = np.zeros((len(self.common), self.documents))
            at = np.flatnonzero(column[self.term] >= 0)
            self.matrix[column[self.term[at]], self.doc[at]] = self.weight[at]
        rare = column[term] < 0
        size = self.df[term[rare]]
        at = _spread(self.cuts[term[rare]], size)
        out = np.bincount(np.repeat(row[rare], size) * self.documents + self.doc[at], self.weight[at], requests * self.documents).astype(np.float64, copy=False).reshape(requests, self.documents)
        if len(self.common):
            asked = np.zeros((requests, len(self.common)))
            asked[row[~rare], column[term[~rare]]] = 1
            out += asked @ self.matrix
        return out

    def lookup(self, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Weights of single terms in single documents, 0 where a document lacks the term."""
        keys = self.term * self.documents + self.doc
        wanted = term * self.documents + doc
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, self.weight[at], 0.0)


def _score_group(group: _Group, block: _Block, top: _TopK, refused, documents: np.ndarray) -> None:
    """Offer a block's documents to the requests of a group.

    A request whose terms' highest weights in the block together stay below its k-th score is left out. Of the others, a
    document must have one of the terms that come after the most common ones which stay below it together: where these
    terms are in few documents, those are scored alone, else all of the block.
    """
    least = top.least(group.members)
    highest = block.top[group.of]
    reach = group.summed(highest)
    live = (reach > 0) & (reach >= least)
    if not live.any():
        return
    total = np.cumsum(highest)
    before = np.append(0.0, total)[group.begin[:-1]]
    needed = (total - before[group.row] >= least[group.row] - 1e-9) & (highest > 0) & live[group.row]
    size = np.where(needed, block.df[group.of], 0)
    pairs = group.summed(size)
    few = live & (pairs * 16 < block.documents)
    for chosen, cost, score in ((few, pairs, _score_pairs), (live & ~few, np.full(len(live), block.documents), _score_all)):
        rows = np.flatnonzero(chosen)
        cuts = np.cumsum(cost[rows]) // max(CELLS, 1)
        for at in np.split(rows, np.flatnonzero(np.diff(cuts)) + 1):
            if len(at):
                score(group, block, top, refused, documents, at, needed, least, highest)


def _entries(group: _Group, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``at``, entry) of all terms of some requests."""
    size = group.begin[at + 1] - group.begin[at]
    return np.repeat(np.arange(len(at)), size), _spread(group.begin[at], size)


def _score_all(group, block, top, refused, documents, at, needed, least, highest) -> None:
    row, entry = _entries(group, at)
    seen = highest[entry] > 0
    values = block.dense(row[seen], group.of[entry[seen]], len(at))
    no = refused(np.arange(block.documents)[None, :], group.members[at][:, None])
    if no is not None:
        values[no] = -np.inf
    top.offer(values, group.members[at], documents)


def _score_pairs(group, block, top, refused, documents, at, needed, least, highest) -> None:
    row, entry = _entries(group, at)
    first, rest = needed[entry], ~needed[entry] & (highest[entry] > 0)
    rest_most = np.bincount(row[rest], highest[entry[rest]], len(at))
    size = block.df[group.of[entry[first]]]
    post = _spread(block.cuts[group.of[entry[first]]], size)
    keys, of = np.unique(np.repeat(row[first], size) * block.documents + block.doc[post], return_inverse=True)
    score = np.bincount(of, block.weight[post], len(keys))
    row_of, doc = keys // block.documents, keys % block.documents
    keep = score + rest_most[row_of] >= least[at][row_of] - 1e-9
    row_of, doc, score = row_of[keep], doc[keep], score[keep]
    row, entry = row[rest], entry[rest]
    begin = np.searchsorted(row, np.arange(len(at) + 1))
    size = np.diff(begin)[row_of]
    pair = np.repeat(np.arange(len(row_of)), size)
    term = group.of[entry[_spread(begin[row_of], size)]]
    if len(pair):
        score = score + np.bincount(pair, block.lookup(doc[pair], term), len(score))
    no = refused(doc, group.members[at][row_of])
    keep = score > 0 if no is None else (score > 0) & ~no
    top.take(group.members[at][row_of[keep]], np.rint(score[keep] * 1e6).astype(np.int64), documents[doc[keep]])


def _local_bm25(k: int, filters, k1: float, b: float, arrow: pa.Schema):
    def run(batches):
        top = None
        for batch in _slices(batches):
            if top is None:
                rows = _beside_first(batch, REQUESTS)
                lists = rows.field("terms")
                row, flat = np.repeat(np.arange(len(rows)), np.array(pc.list_value_length(lists), np.int64)), lists.flatten()
                coded = flat.field("term").dictionary_encode()
                terms, term = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                df = np.zeros(len(terms))
                df[term] = flat.field("n").to_numpy()
                n, texts, words = rows.field("totals")[0].as_py() if len(rows) else (0, 0, 0)
                average, idf = words / max(1, texts), np.log(1 + (n - df + 0.5) / (df + 0.5))
                told, top, groups = _Filters(rows, filters), _TopK(k, len(rows), 0, np.nextafter(0, 1)), []
                for key, members in told.groups(len(rows)):
                    place = np.full(len(rows), -1)
                    place[members] = np.arange(len(members))
                    mine = np.flatnonzero(place[row] >= 0)
                    mine = mine[np.lexsort((idf[term[mine]], place[row[mine]]))]
                    if len(mine):
                        groups.append(_Group(key, members, place[row[mine]], term[mine]))
            if not groups:
                continue
            ids, own = _sortable(batch.column("doc_id")), told.document_values(batch)
            doc, term, tf = _hits(batch.column("toks"), terms)
            if not len(doc):
                continue
            dl = np.array(pc.list_value_length(batch.column("toks")).fill_null(0))
            weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / max(average, 1e-12)))
            by_id = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            doc, begin = place[doc], top.number(ids[by_id])
            order = np.argsort(doc, kind="stable")
            doc, term, weight = doc[order], term[order], weight[order]
            for group in groups:
                mask = told.equal(own, group.key, by_id)
                at = np.minimum(np.searchsorted(group.terms, term), len(group.terms) - 1)
                kept = mask[doc] & (group.terms[at] == term)
                if kept.any():
                    here = np.flatnonzero(mask)
                    block = _Block((np.cumsum(mask) - 1)[doc[kept]], at[kept], weight[kept], len(here), len(group.terms))
                    _score_group(group, block, top, lambda docs, requests: told.refused(own, by_id[here][docs], requests), begin + here)
        if top is not None and (out := top.rows(rows, arrow)) is not None:
            yield out
    return run


def _statistics(docs: DataFrame, words: DataFrame) -> DataFrame:
    """One row: the totals of the documents and how many of them have each of the words that any has."""
    packed = words.agg(F.collect_list(F.struct("term")).alias(REQUESTS), F.min(F.lit(0)).alias("__key"))
    counted = _beside(docs.select("toks"), packed).mapInArrow(_local_statistics, "kind string, term string, n long")
    return (counted.groupBy("kind", "term").agg(F.sum("n").alias("n"))
            .agg(F.collect_list(F.struct("kind", "term", "n")).alias(STATS), F.min(F.lit(0)).alias("__key")))


def keyword_top_k(docs: DataFrame, requests: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text",
                  query_id: str = "query_id", query_text: str = "query_text", filters=None,
                  k1: float = BM25_K1, b: float = BM25_B, request_blocks: int | None = None) -> DataFrame:
    """BM25 over whole texts: (query_id, doc_id, score rounded to 6, rank).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); each distinct query term counts once. One pass over the
    documents counts (a row for each request term and task), a second one scores in their own partitions and
    leaves k rows for each request and task; texts are not shuffled, but for many requests they are dealt over few partitions.
    A request's terms that no document has add nothing to a score and are left out after the first pass. Requests with
    the same other terms and filter values are answered once, and the answer is joined to each of them.
    """
    dsel = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("toks"), *[d for d, _, _ in filters or []])
    own = [F.col(r) for r in dict.fromkeys(r for _, r, _ in filters or [])]
    whose = requests.select(F.col(query_id).alias("query_id"), F.array_sort(F.array_distinct(tokens(query_text))).alias("terms"),
                            F.array().cast("array<struct<term:string,n:bigint>>").alias("kept"), F.array().cast("array<bigint>").alias("totals"),
                            F.struct(F.lit(0).alias("__none"), *own).alias("own"))
    size = F.coalesce(F.octet_length(F.array_join("terms", " ")), F.lit(0)) + 32
    total = whose.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] if request_blocks is None else 0
    words = whose.select(F.explode("terms").alias("term")).distinct()
    keep = _local_kept(to_arrow_schema(whose.schema))
    for block in _blocks(words, "term", request_blocks or (1 if _blocks_of(total) == 1 else None), F.octet_length("term") + 32):
        whose = _beside(whose, _statistics(dsel, block)).mapInArrow(keep, whose.schema)
    # What a request asks for is its id here: requests that ask the same are answered once.
    whose = whose.select("query_id", F.struct(F.col("kept").alias("terms"), "totals", "own.*").alias("ask"))
    if total > min(MANY_REQUEST_BYTES, MAX_REQUEST_BYTES):
        # What is left of many requests is written: it decides on their blocks, and is read more than once.
        whose = _written(whose)
        total = whose.select("ask").distinct().agg(F.coalesce(F.sum(_ask_bytes()), F.lit(0))).first()[0]
    dsel = _dealt(dsel, total)
    asks = whose.select("ask").distinct()
    schema = _result_schema(asks, "ask", docs, doc_id, "score")
    run = _local_bm25(k, filters, k1, b, to_arrow_schema(schema))
    parts = [_beside(dsel, _packed(block, [F.col("ask.*")])).mapInArrow(run, schema)
             for block in _blocks(asks, "ask", request_blocks or _blocks_of(total), _ask_bytes())]
    best = top_k_per_group(_in_turn(parts).withColumnRenamed("query_id", "ask"), "ask", [F.desc("score"), "doc_id"], k).drop("rank")
    return top_k_per_group(whose.join(best, "ask").select("query_id", "doc_id", "score"), "query_id", [F.desc("score"), "doc_id"], k)


def _ask_bytes() -> Column:
    return F.coalesce(F.octet_length(F.array_join(F.col("ask.terms")["term"], " ")), F.lit(0)) + 8 * F.size("ask.terms") + 32


# ── hybrid search (G6) and skill search (G7) ───────────────────────────────

def reciprocal_rank_fusion(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """sum over lists of 1 / (k + rank) per (query_id, doc_id)."""
    parts = [r.select("query_id", "doc_id", (1.0 / (k + F.col("rank"))).alias("rrf")) for r in ranked]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.sum("rrf").alias("rrf"))


def hybrid_search(docs: DataFrame, requests: DataFrame, top: int = 5, doc_id: str = "doc_id",
                  text: str = "text", vec: str = "vector", filters=None, request_blocks: int | None = None) -> DataFrame:
    """Vector (2*top over-fetch) and keyword (2*top) lists fused by RRF; top per request."""
    vreq = requests.filter(F.col("query_vector").isNotNull())
    v = vector_top_k(docs, vreq, 2 * top, doc_id, vec, filters=filters, request_blocks=request_blocks)
    kw = keyword_top_k(docs, requests, 2 * top, doc_id, text, filters=filters, request_blocks=request_blocks)
    fused = reciprocal_rank_fusion(v, kw).withColumn("rrf", F.round("rrf", 8))
    return top_k_per_group(fused, "query_id", [F.desc("rrf"), "doc_id"], top)


def skill_query_text(skills: Column) -> Column:
    return F.concat(F.lit("Courses teaching: "), F.array_join(skills, ", "))


def gap_skill_requests(gold_department_skills: DataFrame, n_skills: int = 3) -> DataFrame:
    """One request per department: its n largest skill gaps, restricted to that department."""
    ranked = top_k_per_group(gold_department_skills, "department", [F.desc("skill_gap"), "skill_name"], n_skills)
    return (ranked.groupBy("department")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "skill_name"))).alias("rs"))    # n_skills entries
            .select(F.col("department").alias("query_id"), F.col("department"),
                    skill_query_text(F.transform("rs", lambda x: x["skill_name"])).alias("query_text")))


def search_by_skills(docs: DataFrame, requests: DataFrame, top: int = 5, request_blocks: int | None = None) -> DataFrame:
    """Hybrid search of the catalogue with each request's department filter.

    docs: course_id, embed_text, content_vector, department; requests: query_id, query_text, query_vector, department
    (a null department or vector: no filter, keyword search alone).
    """
    return hybrid_search(docs, requests, top, doc_id="course_id", text="embed_text", vec="content_vector",
                         filters=[("department", "department", "eq")], request_blocks=request_blocks)

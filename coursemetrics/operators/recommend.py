"""Course recommender: truncated SVD of the learner x course weight matrix.

* The weights of a learner are one sparse vector, as long as its courses, checkpointed and kept for the fit, so an
  iteration of the solver reads vectors, not events. ``RowMatrix.computeSVD`` multiplies them
  in the cluster.
* V (courses x components) is the only matrix on the driver. Its size is checked against
  MAX_FACTOR_BYTES; it is broadcast once for the learner factors U*S = A*V (one row per learner) and once
  for scoring.
* Scoring runs in Arrow batches: a block of learners times V, started courses masked by their index,
  the best n by one partial sort. A learner is one row, so nothing is shuffled or merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window, functions as F

from coursemetrics.operators.features import interaction_weights
from coursemetrics.session import checkpoint_dir

N_COMPONENTS = 50
MAX_FACTOR_BYTES = 256 << 20
CELLS = 1 << 21     # learners x courses scored at once
ROWS_PER_TASK = 5_000
MOST_ROWS_PER_TASK = 1_000_000


@dataclass
class Recommender:
    course_index: DataFrame      # course_id, idx (in the order of course_id)
    course_factors: DataFrame    # course_id, idx, v (array<double>, length k)
    learner_factors: DataFrame   # learner_email, u (array<double>) = row of U*S
    k: int
    n_courses: int
    singular_values: list
    v: np.ndarray                # courses x k
    courses: list


def course_index(weights: DataFrame) -> DataFrame:
    """Dense 0-based ids for the courses seen (catalogue-sized, so a global rank is bounded)."""
    courses = weights.select("course_id").distinct()
    return courses.withColumn("idx", (F.row_number().over(Window.orderBy("course_id")) - 1).cast("int"))


def learner_cells(weights: DataFrame, index: DataFrame) -> DataFrame:
    """(learner_email, cells): the learner's (idx, weight) pairs in index order; as many as its courses."""
    return (weights.join(index, "course_id").groupBy("learner_email")
            .agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("cells")))


def _sparse(n: int):
    """The cells as one sparse vector of length n."""
    return F.udf(lambda cells: Vectors.sparse(n, [c["idx"] for c in cells], [c["weight"] for c in cells]), VectorUDT())


def vector_tasks(rows: int, cores: int) -> int:
    """Tasks of the solver's jobs: one for every ROWS_PER_TASK vectors, no more than the cluster runs at once unless they would
    hold more than MOST_ROWS_PER_TASK."""
    return max(1, min(-(-rows // ROWS_PER_TASK), cores), -(-rows // MOST_ROWS_PER_TASK))


def fit_recommender(interactions: DataFrame, k: int = N_COMPONENTS) -> Recommender:
    spark = interactions.sparkSession
    w = interaction_weights(interactions).select("learner_email", "course_id", "weight")
    cidx = course_index(w).cache()
    courses = [r["course_id"] for r in cidx.orderBy("idx").collect()]     # the catalogue's ids
    n = len(courses)
    if n == 0:
        raise ValueError("no interactions to learn from")
    k_eff = max(1, min(k, n - 1))
    if n * k_eff * 8 > MAX_FACTOR_BYTES:
        raise ValueError(f"{n} courses x {k_eff} components exceed MAX_FACTOR_BYTES")
    checkpoint_dir(spark)
    # The solver runs a short job for each product, some hundred in all: few tasks, over a plan that is cut here.
    cells = learner_cells(w, cidx).checkpoint()
    tasks = vector_tasks(cells.count(), spark.sparkContext.defaultParallelism)
    rows = cells.coalesce(tasks).select(_sparse(n)("cells").alias("row")).checkpoint()
    rows = MLUtils.convertVectorColumnsFromML(rows, "row").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        svd = RowMatrix(rows).computeSVD(k_eff, computeU=False)
        v, values = svd.V.toArray(), [float(x) for x in svd.s.toArray()]
    finally:
        rows.unpersist()
    k_got = v.shape[1]
    factors = spark.createDataFrame([(c, i, v[i].tolist()) for i, c in enumerate(courses)], "course_id string, idx int, v array<double>")
    shared = spark.sparkContext.broadcast(v)

    def project(batches):
        for batch in batches:
            own = batch.column("cells")
            flat, of = own.flatten(), np.repeat(np.arange(len(own)), np.array(pc.list_value_length(own)))
            parts = shared.value[pc.struct_field(flat, "idx").to_numpy()] * pc.struct_field(flat, "weight").to_numpy()[:, None]
            heads = np.searchsorted(of, np.arange(len(own)))
            u = np.add.reduceat(parts, heads, axis=0) if len(own) else parts
            yield pa.RecordBatch.from_arrays([batch.column("learner_email"), pa.array(u.tolist(), pa.list_(pa.float64()))], names=["learner_email", "u"])

    return Recommender(cidx, factors, cells.mapInArrow(project, "learner_email string, u array<double>"), k_got, n, values, v, courses)


def recommender_info(rec: Recommender, interactions: DataFrame) -> DataFrame:
    """Learners, courses, k and the explained-variance ratio of the k components.

    Ratio = sum of column variances of U*S / total column variance of the
    weight matrix (population variances over all learners, zeros included).
    """
    w = interaction_weights(interactions)
    learners = w.select("learner_email").distinct().agg(F.count("*").alias("n")).select("n").scalar()
    n = F.col("n_learners")
    tot = (w.groupBy("course_id").agg(F.sum("weight").alias("s1"), F.sum(F.col("weight") ** 2).alias("s2"))
           .withColumn("n_learners", learners)
           .agg(F.sum(F.col("s2") / n - (F.col("s1") / n) ** 2).alias("total_var"), F.max("n_learners").alias("n_learners")))
    fac = (rec.learner_factors.select(F.posexplode("u"))
           .groupBy("pos").agg(F.sum("col").alias("s1"), F.sum(F.col("col") ** 2).alias("s2"))
           .withColumn("n_learners", learners)
           .agg(F.sum(F.col("s2") / n - (F.col("s1") / n) ** 2).alias("factor_var")))
    return tot.select(n.cast("bigint").alias("n_learners"),
                      F.lit(rec.n_courses).cast("bigint").alias("n_courses"),
                      F.lit(rec.k).cast("bigint").alias("n_components"),
                      F.round(fac.select("factor_var").scalar() / F.col("total_var"), 4)
                      .alias("explained_variance_ratio"))


def recommend_courses(rec: Recommender, interactions: DataFrame, top_n: int = 5,
                      learners: DataFrame | None = None) -> DataFrame:
    """Top-n unstarted courses per learner by U*S . V (rounded to 4), ties by course id. Unknown learners get no rows."""
    started = (interactions.join(rec.course_index, "course_id").groupBy("learner_email")
               .agg(F.collect_list("idx").alias("started")))      # a learner's courses
    lf = rec.learner_factors
    if learners is not None:
        lf = lf.join(learners.select("learner_email").distinct(), "learner_email", "left_semi")
    shared = interactions.sparkSession.sparkContext.broadcast((rec.v, np.array(rec.courses, dtype=object)))
    n, places, offset = rec.n_courses, 1 << 24, 1 << 37

    def score(batches):
        v, ids = shared.value
        for batch in batches:
            step = max(1, CELLS // n)
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                u = some.column("u").flatten().to_numpy().reshape(some.num_rows, -1)
                keys = (np.rint(np.round(u @ v.T, 4) * 1e4).astype(np.int64) + offset) * places + (places - 1 - np.arange(n))
                own = some.column("started")
                of = np.repeat(np.arange(len(own)), np.array(pc.list_value_length(own).fill_null(0)))
                keys[of, own.flatten().to_numpy()] = -1
                best = np.sort(np.partition(keys, n - top_n, axis=1)[:, -top_n:] if n > top_n else keys, axis=1)[:, ::-1]
                row, rank = np.nonzero(best >= 0)
                found = best[row, rank]
                yield pa.RecordBatch.from_arrays(
                    [some.column("learner_email").take(pa.array(row)), pa.array(rank + 1, pa.int32()),
                     pa.array(ids[places - 1 - found % places].tolist(), pa.string()), pa.array((found // places - offset) / 1e4)],
                    names=["learner_email", "rank", "course_id", "score"])

    return lf.join(started, "learner_email", "left").mapInArrow(score, "learner_email string, rank int, course_id string, score double")


def recommendations_with_title(recs: DataFrame, dim_courses: DataFrame) -> DataFrame:
    """Course title for each recommendation, falling back to the id."""
    t = dim_courses.select("course_id", "title")
    return (recs.join(t, "course_id", "left")
            .select("learner_email", "rank", "course_id", "score",
                    F.coalesce(F.col("title"), F.col("course_id")).alias("title")))

"""Implicit-feedback recommender (F3/F4) for catalogues of any size: alternating least squares.

Both factor matrices stay blocked on executors: the fit exchanges factor blocks, scoring multiplies block by block and keeps
the best courses of each learner, and nothing of the size of the catalogue reaches the driver. Started courses are dropped
after scoring, so a learner with s started courses asks for s + n: learners are scored in classes of s (powers of four), each
with the list length that its class needs, so that one busy learner does not lengthen the lists of all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, functions as F

from coursemetrics.functions.ids import dense_ids
from coursemetrics.functions.topk import top_k_per_group
from coursemetrics.operators.features import interaction_weights

RANK = 16
ITERATIONS = 8
REGULARISATION = 0.1
CONFIDENCE = 10.0
CLASS_BASE = 4


@dataclass
class FactorModel:
    model: ALSModel
    learners: DataFrame     # learner_email, learner
    courses: DataFrame      # course_id, course
    cells: DataFrame        # learner, course, weight


def fit_factors(interactions: DataFrame, path: str, rank: int = RANK, iterations: int = ITERATIONS, regularisation: float = REGULARISATION,
                confidence: float = CONFIDENCE, seed: int = 42) -> FactorModel:
    """Factors of the learner x course weights; a weight is the confidence that the learner wants the course.

    Ids and the weights by id are written under ``path`` (shared storage): the fit reads them in every iteration. ALS checkpoints
    into the session's checkpoint folder, which cuts its lineage.
    """
    spark = interactions.sparkSession
    weights = interaction_weights(interactions).select("learner_email", "course_id", "weight")
    if weights.isEmpty():
        raise ValueError("no interactions to learn from")
    learners = dense_ids(weights, "learner_email", f"{path}/learners", "learner")
    courses = dense_ids(weights, "course_id", f"{path}/courses", "course")
    weights.join(learners, "learner_email").join(courses, "course_id").select("learner", "course", F.col("weight").cast("float").alias("weight")) \
        .write.mode("overwrite").parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    als = ALS(userCol="learner", itemCol="course", ratingCol="weight", implicitPrefs=True, rank=rank, maxIter=iterations, regParam=regularisation,
              alpha=confidence, seed=seed, coldStartStrategy="drop", checkpointInterval=4, intermediateStorageLevel="MEMORY_AND_DISK", finalStorageLevel="MEMORY_AND_DISK")
    return FactorModel(als.fit(cells), learners, courses, cells)


def recommend_by_factors(fit: FactorModel, top_n: int = 5, learners: DataFrame | None = None) -> DataFrame:
    """(learner_email, rank, course_id, score rounded to 4): best courses a learner has not started, ties by course id.

    Learners without interactions get no rows; one who has started all but m courses gets m.
    """
    started = fit.cells.groupBy("learner").agg(F.count("*").alias("n"))
    if learners is not None:
        started = started.join(fit.learners.join(learners.select("learner_email").distinct(), "learner_email", "left_semi"), "learner", "left_semi")
    classed = started.withColumn("class", F.ceil(F.log(float(CLASS_BASE), F.col("n"))).cast("int"))
    found = None
    for row in classed.groupBy("class").count().orderBy("class").collect():   # one row per power of four
        wanted = top_n + CLASS_BASE ** row["class"]
        some = fit.model.recommendForUserSubset(classed.where(F.col("class") == row["class"]).select("learner"), wanted)
        some = some.select("learner", F.explode("recommendations").alias("r")).select("learner", "r.course", "r.rating")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return fit.learners.select("learner_email", F.lit(0).alias("rank"), F.lit("").alias("course_id"), F.lit(0.0).alias("score")).limit(0)
    fresh = found.join(fit.cells.select("learner", "course"), ["learner", "course"], "left_anti")
    named = fresh.join(fit.courses, "course").withColumn("score", F.round(F.col("rating").cast("double"), 4))
    best = top_k_per_group(named.select("learner", "course_id", "score"), "learner", [F.desc("score"), "course_id"], top_n)
    return best.join(fit.learners, "learner").select("learner_email", "rank", "course_id", "score")

"""Dropout-risk model: stratified split, gradient-boosted trees, metrics, scoring.

Everything runs on Spark ML. The split and CV folds come from a seeded hash of
(learner, course), cut by the counts of its buckets for each label: stratified
proportions without sorting a label's rows, by a rule that SQL can state too.
The fill-in median for ``avg_score`` is taken at training time and kept with
the model; ``median="batch"`` reproduces scoring with the batch's own median.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from coursemetrics.functions.labels import risk_label, risk_tier_cut, suggested_intervention
from coursemetrics.operators.features import FEATURE_COLS, dropout_features, median_avg_score
from coursemetrics.session import checkpoint_dir

LABEL = "completed"
ROWS_PER_TASK = 25_000
MOST_ROWS_PER_TASK = 1_000_000
# Model settings of the reference model.
GBT_DEFAULTS = dict(maxIter=200, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=20)
SEED = 42
TEST_FRACTION = 0.20
N_FOLDS = 5
HASH_BUCKETS = 4096


def hash_bucket(seed: int = SEED, keys=("learner_email", "course_id"), buckets: int = HASH_BUCKETS):
    """Bucket of a row by the md5 of seed and keys (any engine gives the same)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def _with_place(df: DataFrame, label: str, seed: int) -> DataFrame:
    """Adds ``_before`` (rows of the label in lower buckets) and ``_of`` (rows of the label).

    Only counts per label and bucket are ordered, HASH_BUCKETS rows for a label, never the rows themselves.
    """
    b = df.withColumn("_bucket", hash_bucket(seed))
    counts = b.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    label_rows = Window.partitionBy(label)
    places = counts.select(label, "_bucket", (F.sum("_n").over(label_rows.orderBy("_bucket")) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(label_rows).alias("_of"))
    # a row for each label and bucket: a proven size bound for the broadcast
    return b.join(F.broadcast(places), [label, "_bucket"])


def stratified_split(features: DataFrame, label: str = LABEL, test_fraction: float = TEST_FRACTION,
                     seed: int = SEED) -> DataFrame:
    """Adds ``is_train``; of each label value the lowest buckets that make up ``test_fraction`` are held out."""
    return (_with_place(features, label, seed).withColumn("is_train", F.col("_before") >= test_fraction * F.col("_of"))
            .drop("_bucket", "_before", "_of"))


def assign_folds(features: DataFrame, n_folds: int = N_FOLDS, label: str = LABEL, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` in 0..n_folds-1, stratified on the label."""
    fold = F.least(F.floor(F.col("_before") * n_folds / F.col("_of")), F.lit(n_folds - 1)).cast("int")
    return _with_place(features, label, seed).withColumn("fold", fold).drop("_bucket", "_before", "_of")


def model_frame(features: DataFrame, median) -> DataFrame:
    """Derived features with the given median; remaining NULLs become 0; label as double."""
    f = dropout_features(features, median=median).na.fill(0, subset=FEATURE_COLS)
    if LABEL in f.columns:
        f = f.withColumn("label", F.col(LABEL).cast("double"))
    return f


def build_pipeline(params: dict | None = None, seed: int = SEED, scale: bool = False) -> Pipeline:
    p = dict(GBT_DEFAULTS, **(params or {}))
    stages = [VectorAssembler(inputCols=FEATURE_COLS, outputCol="raw_features", handleInvalid="keep")]
    if scale:  # trees do not need it; kept as an option for parity with the endpoint model
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    else:
        stages[0].setOutputCol("features")
    stages.append(GBTClassifier(labelCol="label", featuresCol="features", seed=seed,
                                checkpointInterval=10, **p))
    return Pipeline(stages=stages)


@dataclass
class DropoutModel:
    model: PipelineModel
    median: float | None
    metrics: dict = field(default_factory=dict)
    importances: list = field(default_factory=list)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        meta = json.dumps({"median": self.median, "metrics": self.metrics, "importances": self.importances})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> "DropoutModel":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        return cls(PipelineModel.load(f"{path}/pipeline"), meta["median"], meta["metrics"],
                   [tuple(x) for x in meta["importances"]])


def classification_metrics(predictions: DataFrame) -> dict:
    """Accuracy, precision/recall/F1 of class 1 (zero division -> 0), ROC-AUC, counts. Predictions are computed once."""
    kept = predictions.select("label", "prediction", "probability").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cells = {(int(r["label"]), int(r["prediction"])): r["count"] for r in kept.groupBy("label", "prediction").count().collect()}
        both = len({label for label, _ in cells}) == 2
        auc = (BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability", metricName="areaUnderROC").evaluate(kept)
               if both else float("nan"))
    finally:
        kept.unpersist()
    tp, fp, fn, tn = (cells.get(x, 0) for x in ((1, 1), (0, 1), (1, 0), (0, 0)))
    n = tp + fp + fn + tn
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn) if tp + fn else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return {"n_test": n, "accuracy": (tp + tn) / n if n else 0.0, "precision": precision, "recall": recall,
            "f1": f1, "roc_auc": auc, "tp": tp, "fp": fp, "fn": fn, "tn": tn}


def fit_tasks(rows: int, cores: int) -> int:
    """Tasks of a fit's jobs: one for every ROWS_PER_TASK rows, no more than the cluster runs at once unless they would hold
    more than MOST_ROWS_PER_TASK rows."""
    return max(1, min(-(-rows // ROWS_PER_TASK), cores), -(-rows // MOST_ROWS_PER_TASK))


def for_fit(kept: DataFrame) -> DataFrame:
    """A kept table for a fit, without a shuffle: a fit runs a short job for each level of each tree, some thousand in all, whose
    cost is the number of its tasks and what each of them reports to the driver.

    The table is checkpointed: tasks over the plan that made it would send the counters of each of its steps every time.
    """
    tasks = fit_tasks(kept.count(), kept.sparkSession.sparkContext.defaultParallelism)
    return kept.coalesce(tasks).checkpoint()


def train_dropout(features: DataFrame, params: dict | None = None, seed: int = SEED,
                  test_fraction: float = TEST_FRACTION, scale: bool = False, cv_folds: int = 0) -> DropoutModel:
    """Fit on a stratified 80% split, evaluate on the rest; ``cv_folds`` adds the cross-validated AUC to the metrics.

    The feature table is computed once and kept for the fit: median, split, trees and evaluation read it.
    """
    spark = features.sparkSession
    checkpoint_dir(spark)  # GBT checkpoints its running predictions every 10 trees
    base = features.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        median = median_avg_score(base).first()["median_avg_score"]
        data = model_frame(stratified_split(base, test_fraction=test_fraction, seed=seed), median).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = build_pipeline(params, seed, scale).fit(for_fit(data).filter("is_train"))
            metrics = classification_metrics(model.transform(data.filter("NOT is_train")))
            metrics["n_samples"] = data.count()
        finally:
            data.unpersist()
        if cv_folds:
            folds = cross_validate_dropout(base, params, cv_folds, seed)
            metrics |= {"cv_mean_auc": folds["mean_auc"], "cv_std_auc": folds["std_auc"]}
    finally:
        base.unpersist()
    metrics["n_train"] = metrics["n_samples"] - metrics["n_test"]
    gbt = model.stages[-1]
    importances = list(zip(FEATURE_COLS, [float(v) for v in gbt.featureImportances.toArray()]))
    return DropoutModel(model, median, metrics, importances)


def cross_validate_dropout(features: DataFrame, params: dict | None = None, n_folds: int = N_FOLDS,
                           seed: int = SEED) -> dict:
    """Stratified k-fold ROC-AUC: mean and population std over folds.

    A fold's fit is a chain of small jobs, so the folds are fitted side by side over the same kept table.
    """
    checkpoint_dir(features.sparkSession)
    median = median_avg_score(features).first()["median_avg_score"]
    data = model_frame(assign_folds(features, n_folds, seed=seed), median).persist(StorageLevel.MEMORY_AND_DISK)
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability", metricName="areaUnderROC")

    def fold(k: int) -> float:
        m = build_pipeline(params, seed).fit(rows.filter(F.col("fold") != k))
        return ev.evaluate(m.transform(rows.filter(F.col("fold") == k)))

    try:
        rows = for_fit(data)
        with ThreadPoolExecutor(n_folds) as pool:
            aucs = list(pool.map(inheritable_thread_target(fold), range(n_folds)))
    finally:
        data.unpersist()
    mean = sum(aucs) / len(aucs)
    std = (sum((a - mean) ** 2 for a in aucs) / len(aucs)) ** 0.5
    return {"fold_auc": aucs, "mean_auc": mean, "std_auc": std}


def score_dropout(model: DropoutModel, features: DataFrame, median="model") -> DataFrame:
    """Adds ``dropout_risk`` = P(not completed). ``median="batch"`` fills with the batch median."""
    fill = None if median == "batch" else model.median
    framed = model_frame(features.withColumn("_avg_score_in", F.col("avg_score")), fill)
    scored = model.model.transform(framed)
    drop = ("raw_features", "features", "rawPrediction", "probability", "prediction", "label", "_avg_score_in")
    keep = [F.col("_avg_score_in").alias("avg_score") if c == "avg_score" else F.col(c)
            for c in scored.columns if c not in drop]
    return scored.select(*keep, vector_to_array("probability")[0].alias("dropout_risk"),
                         F.col("prediction").alias("predicted_label"))


def confusion_matrix(model: DropoutModel, features: DataFrame) -> DataFrame:
    """Held-out actual x predicted counts (pivot values given: always both columns)."""
    data = model_frame(stratified_split(features), model.median).filter("NOT is_train")
    pred = model.model.transform(data)
    return (pred.groupBy(F.col("label").cast("int").alias("actual"))
            .pivot("prediction", [0.0, 1.0]).count().na.fill(0)
            .withColumnRenamed("0.0", "predicted_0").withColumnRenamed("1.0", "predicted_1")
            .orderBy("actual"))


def feature_importances(model: DropoutModel, spark: SparkSession) -> DataFrame:
    rows = sorted(model.importances, key=lambda kv: (-kv[1], kv[0]))
    return spark.createDataFrame([(k, float(round(v, 4))) for k, v in rows], "feature string, importance double")


def model_info(model: DropoutModel, spark: SparkSession) -> DataFrame:
    m = model.metrics
    return spark.createDataFrame(
        [(True, float(round(m.get("roc_auc", 0.0), 4)), int(m.get("n_samples", 0)), int(m.get("n_train", 0)),
          int(m.get("n_test", 0)), float(m.get("accuracy", 0.0)), float(m.get("precision", 0.0)),
          float(m.get("recall", 0.0)), float(m.get("f1", 0.0)), float(model.median or 0.0),
          m.get("cv_mean_auc"), m.get("cv_std_auc"))],
        "trained boolean, roc_auc double, n_samples long, n_train long, n_test long, accuracy double, "
        "precision double, recall double, f1 double, fill_median double, cv_mean_auc double, cv_std_auc double")


def gold_dropout_risk(model: DropoutModel, features: DataFrame) -> DataFrame:
    """All (learner, course) pairs scored, training rows included (``is_train`` marks them)."""
    scored = score_dropout(model, stratified_split(features))
    return scored.select("learner_email", "course_id", F.col("dropout_risk").alias("dropout_risk_score"),
                         *FEATURE_COLS, "is_train")


def high_risk_pairs(gold_risk: DataFrame, threshold: float = 0.65) -> DataFrame:
    return (gold_risk.filter(F.col("dropout_risk_score") > threshold)
            .select("learner_email", "course_id", "dropout_risk_score", "modules_touched", "avg_score")
            .orderBy(F.desc("dropout_risk_score"), "learner_email", "course_id"))


def score_course(model: DropoutModel, course_features: DataFrame) -> DataFrame:
    """Course learners (non-completers) scored, with tier, label and intervention; risk desc."""
    s = score_dropout(model, course_features)
    return (s.select("course_id", "learner_email", "total_events", "modules_touched", "avg_score", "active_days",
                     "span_days", "dropout_risk",
                     risk_tier_cut("dropout_risk").alias("risk_tier"),
                     risk_label("dropout_risk").alias("risk_label"))
            .orderBy(F.desc("dropout_risk"), "course_id", "learner_email"))


def at_risk_with_risk(at_risk: DataFrame, scored_course: DataFrame) -> DataFrame:
    """At-risk rows <- dropout risk (left join); a missing risk shows as '—' and 'On track'."""
    r = scored_course.select("course_id", "learner_email", "dropout_risk")
    return (at_risk.join(r, ["course_id", "learner_email"], "left")
            .withColumn("risk_tier", risk_label("dropout_risk", missing="—"))
            .withColumn("intervention", suggested_intervention("dropout_risk", "days_inactive")))


def feature_summary(features: DataFrame) -> DataFrame:
    """describe() of the model features and the label: one row per column with count, mean, sample deviation, min,
    quartiles (interpolated) and max."""
    columns = [c for c in FEATURE_COLS if c in features.columns] + [LABEL]
    long = features.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                                               for c in columns])).alias("f")).select("f.feature", "f.x")
    return long.groupBy("feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev("x").alias("std"), F.min("x").alias("min"),
        *[F.percentile("x", q).alias(name) for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))], F.max("x").alias("max"))


def label_summary(features: DataFrame) -> DataFrame:
    """Pairs of each label, their share, and so the completion rate."""
    total = features.agg(F.count("*").alias("n")).select("n").scalar()
    return features.groupBy(LABEL).agg(F.count("*").alias("pairs")).withColumn("share", F.round(F.col("pairs") / total, 4))


def score_records(model: DropoutModel, spark: SparkSession, records: list[dict]) -> DataFrame:
    """Single-record scoring re-aimed as a tiny batch: dicts with the five base features.

    As in the reference, the fill-in median comes from the batch itself, so a lone record
    without a score gets 0 for it.
    """
    base = [("total_events", "long"), ("modules_touched", "long"), ("avg_score", "double"),
            ("active_days", "long"), ("span_days", "long")]
    rows = [tuple(r.get(k) for k, _ in base) for r in records]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in base))
    return score_dropout(model, df, median="batch").withColumn("dropout_risk", F.round("dropout_risk", 4))


CLASS_NAMES = {0: "Dropout", 1: "Completed"}


def classification_report(model: DropoutModel, features: DataFrame) -> DataFrame:
    """Held-out precision, recall, F1 and support of each class (zero division -> 0), then accuracy, macro and weighted averages."""
    data = model_frame(stratified_split(features), model.median).filter("NOT is_train")
    pred = model.model.transform(data).select(F.col("label").cast("int").alias("y"),
                                              F.col("prediction").cast("int").alias("p"))
    per = (pred.select("y", "p", F.explode(F.array(*[F.lit(c) for c in CLASS_NAMES])).alias("cls"))
           .groupBy("cls")
           .agg(F.sum(((F.col("y") == F.col("cls")) & (F.col("p") == F.col("cls"))).cast("int")).alias("tp"),
                F.sum((F.col("p") == F.col("cls")).cast("int")).alias("predicted"),
                F.sum((F.col("y") == F.col("cls")).cast("int")).alias("support")))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    names = F.create_map(*[x for c, n in CLASS_NAMES.items() for x in (F.lit(c), F.lit(n))])
    classes = (per.select(F.col("cls").alias("class"), names[F.col("cls")].alias("class_name"),
                          precision.alias("precision"), recall.alias("recall"), "support", "tp")
               .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                         F.col("precision") + F.col("recall")), F.lit(0.0))))
    scores, support = ("precision", "recall", "f1"), F.sum("support").alias("support")
    accuracy = F.try_divide(F.sum("tp"), F.sum("support"))
    rows = classes.agg(F.array(
        F.struct(F.lit("accuracy").alias("class_name"), *[accuracy.alias(c) for c in scores], support),
        F.struct(F.lit("macro avg").alias("class_name"), *[F.avg(c).alias(c) for c in scores], support),
        F.struct(F.lit("weighted avg").alias("class_name"), *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores],
                 support)).alias("rows")).select(F.inline("rows"))
    out = classes.drop("tp").unionByName(rows, allowMissingColumns=True)
    return out.orderBy(F.col("class").asc_nulls_last(), "class_name")

"""Bronze statements -> silver events (flatten, type, validate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LANG = "en-US"


def extension(key: str) -> Column:
    """Context extension whose (URL) key ends with ``/key``; the host part of the key is not fixed."""
    ext = F.col("context.extensions")
    hits = F.map_values(F.map_filter(ext, lambda k, v: k.endswith("/" + key) | (k == key)))
    return F.get(hits, 0)


CORRUPT = "_corrupt_record"


def valid_statement() -> Column:
    """Mailbox, verb and course id are there."""
    ok = F.col("actor.mbox").isNotNull() & F.col("verb.display").getItem(LANG).isNotNull() & extension("course_id").isNotNull()
    return F.coalesce(ok, F.lit(False))


def rejected_statements(bronze: DataFrame) -> DataFrame:
    """What ``silver_events`` leaves out, as text with the reason: unreadable records, statements without a required part."""
    told = F.to_json(F.struct(*[c for c in bronze.columns if c != CORRUPT]))
    corrupt = F.col(CORRUPT) if CORRUPT in bronze.columns else F.lit(None).cast("string")
    return bronze.filter(~valid_statement()).select(
        F.coalesce(corrupt, told).alias("statement"), F.when(corrupt.isNotNull(), "unreadable").otherwise("incomplete").alias("reason"))


def silver_events(bronze: DataFrame) -> DataFrame:
    """Flatten statements to 17 typed columns; keep rows with mailbox, verb and course id.

    ``learner_mbox`` is the raw mailbox, ``learner_email`` the address without ``mailto:`` (joins with
    the learner dimension). A timestamp that does not parse gives NULL instead of failing the job.
    """
    mbox = F.col("actor.mbox")
    verb = F.col("verb.display").getItem(LANG)
    course = extension("course_id")
    return (bronze
            .filter(valid_statement())
            .select(F.col("id").alias("event_id"),
                    mbox.alias("learner_mbox"),
                    F.regexp_replace(mbox, "^mailto:", "").alias("learner_email"),
                    F.col("actor.name").alias("learner_name"),
                    verb.alias("verb"),
                    F.col("object.id").alias("object_id"),
                    F.col("object.definition.name").getItem(LANG).alias("object_name"),
                    F.col("result.score.scaled").alias("score"),
                    F.col("result.score.raw").alias("score_raw"),
                    F.col("result.success").alias("quiz_passed"),
                    F.col("result.completion").alias("course_completed"),
                    F.col("result.duration").alias("duration_iso"),
                    F.try_to_timestamp(F.col("timestamp")).alias("ts"),
                    course.alias("course_id"),
                    extension("module_id").alias("module_id"),
                    extension("department").alias("department"),
                    extension("format").alias("course_format")))

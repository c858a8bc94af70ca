"""Declared schemas of the raw JSON files (no inference pass; all-NULL fields keep their type)."""

from pyspark.sql import types as T

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()
LANG_MAP = T.MapType(S, S)
AGENT = T.StructType([T.StructField("objectType", S), T.StructField("name", S), T.StructField("mbox", S)])

EVENT_SCHEMA = T.StructType([
    T.StructField("id", S),
    T.StructField("actor", AGENT),
    T.StructField("verb", T.StructType([T.StructField("id", S), T.StructField("display", LANG_MAP)])),
    T.StructField("object", T.StructType([
        T.StructField("objectType", S), T.StructField("id", S),
        T.StructField("definition", T.StructType([T.StructField("name", LANG_MAP), T.StructField("type", S)]))])),
    T.StructField("context", T.StructType([T.StructField("extensions", T.MapType(S, S))])),
    T.StructField("timestamp", S),
    T.StructField("stored", S),
    T.StructField("authority", AGENT),
    T.StructField("result", T.StructType([
        T.StructField("score", T.StructType([T.StructField("scaled", D), T.StructField("raw", D),
                                             T.StructField("min", L), T.StructField("max", L)])),
        T.StructField("success", B), T.StructField("completion", B), T.StructField("duration", S)])),
])

COURSE_SCHEMA = T.StructType([
    T.StructField("course_id", S), T.StructField("title", S), T.StructField("department", S),
    T.StructField("skill_level", S), T.StructField("format", S), T.StructField("duration_hours", L),
    T.StructField("skills_taught", T.ArrayType(S)), T.StructField("description", S),
    T.StructField("num_modules", L), T.StructField("module_titles", T.ArrayType(S)),
    T.StructField("prerequisites", T.ArrayType(S)),
])

LEARNER_SCHEMA = T.StructType([
    T.StructField("learner_id", S), T.StructField("name", S), T.StructField("email", S),
    T.StructField("department", S), T.StructField("job_title", S), T.StructField("manager_email", S),
    T.StructField("hire_date", S),
    T.StructField("skills", T.ArrayType(T.StructType([T.StructField("skill_name", S),
                                                      T.StructField("proficiency_level", D)]))),
    T.StructField("completed_courses", T.ArrayType(S)),
])

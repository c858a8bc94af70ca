"""Text and prompt tables: learner context, search-result blocks, prompt rows,
conversation history, tool-source extraction, skill profiles, and the JSON
inputs of the course and gap reviews.

Per-row text is assembled from built-in array and string functions. Numbers
are rounded with ``stable_round`` before ``format_string`` so the digits do
not depend on the formatter's tie rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from coursemetrics.functions.labels import SKILL_TARGET, skill_band
from coursemetrics.functions.rounding import stable_round
from coursemetrics.functions.topk import top_k_per_group

# Layout of the learner context and of the search-result block.
PROFILE_HEADER = "LEARNER PROFILE:"
SKILLS_HEADER = "CURRENT SKILL PROFICIENCY (out of 5.0, target is 3.5):"
GAPS_HEADER = "TOP DEPARTMENT SKILL GAPS:"
GAP_MARKER = " <-- GAP"
RESULTS_HEADER = "AVAILABLE COURSES FROM CATALOG:"
NO_RESULTS = "No courses found matching this query."
N_TOP_GAPS = 5
N_COMPLETED_SHOWN = 10
N_PROFILE_SKILLS = 6
DESCRIPTION_CHARS = 200
# Our own system text (the deployed prompt is configuration, passed as a parameter).
SYSTEM_PROMPT = ("You are a learning and development advisor. Recommend courses only from the catalogue "
                 "results provided, explain why each fits the learner, and say when nothing fits.")

NL = "\n"


def _unknown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))


def sorted_skills(skills: Column) -> Column:
    """Skills by proficiency ascending, ties kept in list order."""
    tagged = F.transform(skills, lambda s, i: F.struct(s["proficiency_level"].alias("p"), i.alias("i"),
                                                       s["skill_name"].alias("n")))
    return F.array_sort(tagged)


def department_gap_blocks(gold_department_skills: DataFrame, n: int = N_TOP_GAPS) -> DataFrame:
    """Per department: the text block of its n largest positive gaps (bounded by n per department)."""
    pos = gold_department_skills.filter(F.coalesce(F.col("skill_gap"), F.lit(0.0)) > 0)
    top = top_k_per_group(pos, "department", [F.desc("skill_gap"), "skill_name"], n)
    line = F.format_string("  %-30s avg=%.2f  gap=%.2f", F.col("skill_name"),
                           stable_round("avg_proficiency", 2), stable_round("skill_gap", 2))
    return (top.groupBy("department")
            .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("rl"))
            .select("department", F.concat(F.lit(NL + GAPS_HEADER + NL),
                                           F.array_join(F.transform("rl", lambda x: x["line"]), NL))
                    .alias("gaps_block")))


def completed_lists(completions: DataFrame) -> DataFrame:
    """(learner_email, completed_courses sorted) from (course_id, learner_email) pairs."""
    return (completions.groupBy("learner_email")
            .agg(F.array_sort(F.collect_set("course_id")).alias("completed_courses")))   # <= catalogue size


def learner_context(dim_learners: DataFrame, gold_department_skills: DataFrame, completions: DataFrame
                    ) -> DataFrame:
    """One context text per learner (profile, skills with gap marks, department gaps, completed courses)."""
    skills = sorted_skills(F.coalesce(F.col("skills"), F.array()))
    skill_lines = F.transform(skills, lambda s: F.format_string(
        "  %-30s %.1f%s", s["n"], stable_round(s["p"], 1),
        F.when(s["p"] < SKILL_TARGET, GAP_MARKER).otherwise("")))
    skills_block = F.when(F.size(skills) > 0, F.concat(F.lit(NL + SKILLS_HEADER + NL), F.array_join(skill_lines, NL)))
    done = F.coalesce(F.col("completed_courses"), F.array().cast("array<string>"))
    n_done = F.size(done)
    done_block = F.when(n_done > 0, F.concat(
        F.format_string(NL + "ALREADY COMPLETED (%d courses):" + NL, n_done),
        F.array_join(F.transform(F.slice(done, 1, N_COMPLETED_SHOWN), lambda c: F.concat(F.lit("  "), c)), NL),
        F.when(n_done > N_COMPLETED_SHOWN,
               F.format_string(NL + "  ... and %d more", n_done - N_COMPLETED_SHOWN)).otherwise("")))
    profile = F.concat_ws(NL, F.lit(PROFILE_HEADER),
                          F.concat(F.lit("  Name:       "), _unknown("name")),
                          F.concat(F.lit("  Department: "), _unknown("department")),
                          F.concat(F.lit("  Job title:  "), _unknown("job_title")),
                          F.concat(F.lit("  Hire date:  "), _unknown("hire_date")))
    joined = (dim_learners.join(department_gap_blocks(gold_department_skills), "department", "left")
              .join(completed_lists(completions).withColumnRenamed("learner_email", "email"), "email", "left"))
    text = F.concat(profile, F.coalesce(skills_block, F.lit("")), F.coalesce(F.col("gaps_block"), F.lit("")),
                    F.coalesce(done_block, F.lit("")))
    return joined.select("learner_id", "email", text.alias("context"))


def _fmt_or_na(c: str) -> Column:
    v = F.col(c)
    return F.when(v.isNull() | (v == 0), F.lit("N/A")).otherwise(v.cast("string"))


def search_results_block(hits: DataFrame, requests: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Numbered text block per request; requests without hits get the no-results line.

    ``hits``: query_id, rank and the document fields (title, course_id, department, skill_level,
    format, duration_hours, skills_taught, completion_rate, avg_score, description).
    """
    entry = F.concat_ws(
        NL,
        F.format_string(NL + "[%d] %s (ID: %s)", F.col("rank"), F.col("title"), F.col("course_id")),
        F.concat(F.lit("    Department: "), F.coalesce("department", F.lit("?")), F.lit("  |  Level: "),
                 F.coalesce("skill_level", F.lit("?"))),
        F.concat(F.lit("    Format: "), F.coalesce("format", F.lit("?")), F.lit("  |  Duration: "),
                 F.coalesce(F.col("duration_hours").cast("string"), F.lit("?")), F.lit("h")),
        F.concat(F.lit("    Skills taught: "),
                 F.array_join(F.coalesce("skills_taught", F.array().cast("array<string>")), ", ")),
        F.concat(F.lit("    Completion rate: "), _fmt_or_na("completion_rate"), F.lit("%  |  Avg score: "),
                 _fmt_or_na("avg_score")),
        F.concat(F.lit("    Description: "), F.substring(F.coalesce("description", F.lit("")), 1, DESCRIPTION_CHARS)))
    blocks = (hits.groupBy(query_id)
              .agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("re"))  # top-n per request
              .select(query_id, F.concat(F.lit(RESULTS_HEADER + NL),
                                         F.array_join(F.transform("re", lambda x: x["e"]), NL)).alias("block")))
    return (requests.select(query_id).distinct().join(blocks, query_id, "left")
            .select(query_id, F.coalesce("block", F.lit(NO_RESULTS)).alias("search_block")))


def conversation_history(conversations: DataFrame) -> DataFrame:
    """Ordered chat turns as rows (conv_id, position, role, content); system turns are not history."""
    return (conversations.filter(F.col("role").isin("user", "assistant"))
            .select("conv_id", F.col("turn").alias("position"), "role", F.col("text").alias("content")))


def last_user_messages(conversations: DataFrame) -> DataFrame:
    """The latest user turn of each conversation: (conv_id, turn, message)."""
    last = (conversations.filter(F.col("role") == "user").groupBy("conv_id")
            .agg(F.max("turn").alias("turn")))
    return conversations.join(last, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("message"))


def rag_prompts(requests: DataFrame, history: DataFrame, blocks: DataFrame, contexts: DataFrame | None = None,
                system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Prompt rows per request: position 0 system, then earlier history turns, then the user message.

    requests: conv_id, turn, message; blocks: conv_id, search_block; contexts: conv_id, context (optional).
    """
    req = requests.join(blocks, "conv_id", "left")
    if contexts is not None:
        req = req.join(contexts, "conv_id", "left")
    ctx = F.col("context") if contexts is not None else F.lit(None).cast("string")
    system = F.concat(F.lit(system_prompt),
                      F.coalesce(F.concat(F.lit(NL + NL), ctx), F.lit("")),
                      F.lit(NL + NL + "<search_results>" + NL),
                      F.coalesce("search_block", F.lit(NO_RESULTS)),
                      F.lit(NL + "</search_results>"))
    sys_rows = req.select("conv_id", F.lit(0).cast("bigint").alias("position"), F.lit("system").alias("role"),
                          system.alias("content"))
    hist = (history.join(requests.select("conv_id", F.col("turn").alias("last_turn")), "conv_id")
            .filter(F.col("position") < F.col("last_turn"))
            .select("conv_id", (F.col("position") + 1).alias("position"), "role", "content"))
    user = req.select("conv_id", (F.col("turn") + 1).alias("position"), F.lit("user").alias("role"),
                      F.col("message").alias("content"))
    return sys_rows.unionByName(hist).unionByName(user)


def skill_profile(dim_learners: DataFrame, n: int = N_PROFILE_SKILLS) -> DataFrame:
    """Lowest n skills per learner with a band (red < 2.5, yellow < 3.5, else green)."""
    low = F.slice(sorted_skills(F.coalesce(F.col("skills"), F.array())), 1, n)
    return (dim_learners.select("learner_id", F.posexplode(low).alias("pos", "s"))
            .select("learner_id", (F.col("pos") + 1).cast("bigint").alias("position"),
                    F.col("s.n").alias("skill_name"), F.col("s.p").alias("proficiency_level"),
                    skill_band(F.col("s.p")).alias("band"),
                    F.format_string("%s — %.1f/5", F.col("s.n"), stable_round(F.col("s.p"), 1)).alias("line")))


# ── tool-source extraction from logged responses (H5) ──────────────────────

# Tool-output item types.
TOOL_OUTPUT_TYPES = ("mcp_call", "tool_call", "tool_result", "function_call_output")
_BLOCK = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
_ITEM = T.StructType([T.StructField("type", T.StringType()), T.StructField("server_label", T.StringType()),
                      T.StructField("content", T.StringType())])
RESPONSE_SCHEMA = T.StructType([T.StructField("output", T.ArrayType(_ITEM))])


def extract_tool_sources(logs: DataFrame, catalogue_label: str | None, response_col: str = "response",
                         item_types=TOOL_OUTPUT_TYPES) -> DataFrame:
    """One row per text returned by a catalogue tool call in a logged JSON response.

    Items of the given types whose server label is empty or the catalogue's are kept; their
    ``content`` is either a string or a list of blocks with ``text`` (blocks without text are
    skipped). Malformed JSON gives no rows.
    """
    parsed = logs.withColumn("_r", F.from_json(F.col(response_col), RESPONSE_SCHEMA))
    items = parsed.select("*", F.explode_outer("_r.output").alias("item")).filter(F.col("item").isNotNull())
    label = F.col("item.server_label")
    ok_label = label.isNull() | (label == "")
    if catalogue_label is not None:
        ok_label = ok_label | (label == catalogue_label)
    items = items.filter(F.col("item.type").isin(*item_types) & ok_label)
    raw = F.col("item.content")          # a JSON array is kept as its text by the string field
    blocks = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, T.ArrayType(_BLOCK)))
    texts = F.when(blocks.isNotNull(), F.transform(blocks, lambda b: b["text"])).otherwise(F.array(raw))
    keep = [c for c in logs.columns if c != response_col]
    return (items.select(*keep, F.col("item.type").alias("item_type"), F.explode(texts).alias("text"))
            .filter(F.col("text").isNotNull() & (F.col("text") != "")))


# ── review inputs (plan items) ─────────────────────────────────────────────

def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def course_review_input(gold_course_completion: DataFrame, gold_module_dropoff: DataFrame) -> DataFrame:
    """Per course: the course row and its module funnel as one JSON text."""
    funnel = (gold_module_dropoff.groupBy("course_id")
              .agg(F.array_sort(F.collect_list(F.struct("module_id", "learners_reached", "learners_completed",
                                                        "module_completion_pct", "avg_quiz_score")))
                   .alias("modules")))                                   # modules of one course
    g = gold_course_completion.join(funnel, "course_id", "left")
    return g.select("course_id", _json(F.struct("course_id", "title", "department", "course_format", "enrolled",
                                                "completed", "completion_rate_pct", "avg_score", "modules"))
                    .alias("review_input"))


def gap_review_input(gold_department_skills: DataFrame, dim_courses: DataFrame, n_gaps: int = 10,
                     n_courses: int = 15) -> DataFrame:
    """Per department: its n largest gaps and first courses by title, as one JSON text."""
    gaps = (top_k_per_group(gold_department_skills, "department", [F.desc("skill_gap"), "skill_name"], n_gaps)
            .groupBy("department")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "skill_name", "avg_proficiency", "skill_gap")))
                 .alias("gaps")))
    courses = (top_k_per_group(dim_courses, "department", ["title", "course_id"], n_courses)
               .groupBy("department")
               .agg(F.array_sort(F.collect_list(F.struct("rank", "course_id", "title"))).alias("courses")))
    both = gaps.join(courses, "department", "full")
    return both.select("department", _json(F.struct(
        "department",
        F.transform("gaps", lambda x: x.dropFields("rank")).alias("gaps"),
        F.transform("courses", lambda x: x.dropFields("rank")).alias("courses"))).alias("review_input"))


# ── plan items over silver (P-2, P-6) ──────────────────────────────────────

def dept_skills_active_learners(learner_skills: DataFrame, silver: DataFrame, target: float = 3.5) -> DataFrame:
    """Skill averages by the department of the learners' *events* (learners with activity only)."""
    active = silver.select(F.col("learner_email").alias("email"), F.col("department").alias("event_department")) \
        .distinct()
    return (learner_skills.join(active, "email")
            .groupBy(F.col("event_department").alias("department"), "skill_name")
            .agg(F.avg("proficiency_level").alias("avg_p"), F.count("*").alias("learner_count"))
            .select("department", "skill_name", stable_round("avg_p", 2).alias("avg_proficiency"),
                    stable_round(F.lit(float(target)) - F.col("avg_p"), 2).alias("skill_gap"), "learner_count"))


def iso_duration_seconds(c) -> Column:
    d = F.col(c) if isinstance(c, str) else c

    def part(unit: str) -> Column:
        return F.coalesce(F.regexp_extract(d, r"(\d+)" + unit, 1).try_cast("bigint"), F.lit(0))
    return F.when(d.isNotNull(), part("H") * 3600 + part("M") * 60 + part("S"))


def avg_duration_hours(silver: DataFrame) -> DataFrame:
    """Average activity duration per course in hours (ISO-8601 text parsed to seconds)."""
    secs = iso_duration_seconds("duration_iso")
    return (silver.groupBy("course_id")
            .agg(stable_round(F.avg(secs) / 3600.0, 4).alias("avg_duration_hours"),
                 F.count(secs).alias("timed_events")))

"""Plans and their execution: channels to tools, checks of plans and interpretations, outcomes of the recovery loop.

Everything about many questions is a projection or an aggregate over a table of them; only `execute`
runs one plan's steps, one after another, on lazy tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.loading import untruncated

LOG, METRIC, LITERATURE = "query_training_log", "compute_metrics", "search_literature"
ORDER = (LOG, METRIC, LITERATURE)
#: The tool lists that each kind of task may have.
TASKS = {
    "literature_only": ((LITERATURE,),), "log_lookup": ((LOG,),), "log_metric": ((LOG, METRIC),),
    "hybrid": ((LOG, LITERATURE), (LOG, METRIC, LITERATURE)), "unsupported": ((),), "ambiguous": ((),),
}
#: Searches after the first one.
MOST_RETRIES = 2


def _words(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts)).cast("array<string>")


def channels_routed(rows: DataFrame) -> DataFrame:
    """All columns with task_type and tools from clarification, personal, analyses (how many) and literature; null flags are false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    metric = F.coalesce("analyses", F.lit(0)) > 0
    open_, own, read = flag("clarification"), flag("personal"), flag("literature")
    task = F.when(open_, "ambiguous").when(own & read, "hybrid").when(own & metric, "log_metric").when(own, "log_lookup").when(read, "literature_only").otherwise("unsupported")
    tools = _words(F.when(own, LOG), F.when(own & metric, METRIC), F.when(read, LITERATURE))
    return rows.withColumns({"task_type": task, "tools": F.when(open_, F.array().cast("array<string>")).otherwise(tools)})


def plan_error(task: Column, tools: Column, unsupported: Column, reason: Column) -> Column:
    """What is wrong with a plan, the first of: repeated or unknown tools, their order, a metric without records, tools that
    don't belong to the task, and a reason that is missing or out of place; null for a sound plan."""
    place = F.transform(tools, lambda t: F.array_position(F.array(*[F.lit(x) for x in ORDER]), t))
    fits = F.lit(False)
    for name, lists in TASKS.items():
        for some in lists:
            fits = fits | ((task == name) & (F.array_join(tools, ",") == ",".join(some)))
    refused = task == "unsupported"
    told = F.coalesce(F.trim(reason), F.lit("")) != ""
    return (
        F.when(F.size(F.array_distinct(tools)) < F.size(tools), "repeated_tool").when(F.array_contains(place, 0), "unknown_tool").when(F.array_sort(place) != place, "tool_order")
        .when(F.array_contains(tools, METRIC) & ~F.array_contains(tools, LOG), "metric_without_records").when(~F.coalesce(fits, F.lit(False)), "tools_of_another_task")
        .when(refused & ~(F.coalesce(unsupported, F.lit(False)) & told), "reason_missing").when(~refused & F.coalesce(unsupported, F.lit(False)), "unsupported_out_of_place")
        .when(~refused & reason.isNotNull(), "reason_out_of_place")
    )


def ungrounded(question: Column, mention: Column, days: Column, sessions: Column, spans: Column) -> Column:
    """Which parts of an interpretation the question doesn't have: the exercise as it is said, the days, the number of
    sessions, and the words that each analysis was read from. Parts that are null or empty claim nothing."""
    said = F.lower(F.coalesce(question, F.lit("")))
    absent = lambda x: ~F.contains(said, F.lower(x))
    number = F.concat(F.lit("(^|[^0-9])"), sessions.cast("string"), F.lit("([^0-9]|$)"))
    return _words(
        F.when(absent(mention), "exercise"), F.when(F.exists(F.coalesce(days, F.array().cast("array<string>")), absent), "time_condition"),
        F.when(~F.regexp_like(said, number), "n_sessions"), F.when(F.exists(F.coalesce(spans, F.array().cast("array<string>")), lambda x: (F.trim(x) == "") | absent(x)), "requested_analyses"),
    )


def personal_signals(operation: Column, analyses: Column, asked: Column, exercise: Column, session: Column, sources: Column) -> Column:
    """The reasons for which a question needs the asker's records, in a fixed order."""
    return _words(
        F.when(operation.isNotNull(), "record_operation"), F.when(F.coalesce(analyses, F.lit(0)) > 0, "requested_analyses"), F.when(asked, "explicit_personal_request"),
        F.when(exercise.isNotNull() & session.isNotNull(), "exercise_session_context"), F.when(F.array_contains(sources, "training_records"), "evidence_need"),
    )


def evidence_need(own: Column, read: Column, asked: Column, out_of_scope: Column, unresolved: Column) -> Column:
    """required, optional and status of what an answer needs: own records, and literature that it needs or that is asked for as
    `required` or `optional`. Nothing is needed out of scope; a question that needs nothing else has an open purpose."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    inside = ~flag(out_of_scope)
    must = flag(read) | (F.coalesce(asked, F.lit("none")) == "required")
    may = (F.coalesce(asked, F.lit("none")) == "optional") & ~must
    required = _words(F.when(inside & flag(own), "training_records"), F.when(inside & must, "literature"))
    optional = _words(F.when(inside & may, "literature"))
    open_ = flag(unresolved) | (inside & (F.size(required) + F.size(optional) == 0))
    return F.struct(required.alias("required"), optional.alias("optional"), F.when(open_, "clarification_required").otherwise("resolved").alias("status"))


def literature_clause(question: Column, anchors: list[str], explicit: list[str]) -> Column:
    """The clause of a question that its first scientific word stands in, or without one its first explicit word for literature:
    from the clause mark before it to the end of its sentence. Without either, the whole question."""
    said = F.trim(F.coalesce(question, F.lit("")))
    low = F.lower(said)

    def first(words: list[str]) -> Column:
        return F.array_min(F.filter(F.array(*[F.instr(low, F.lit(w.lower())) for w in words]), lambda at: at > 0)) if words else F.lit(None).cast("int")

    at = F.coalesce(first(anchors), first(explicit))
    # What stands before the word: its last part behind a clause mark is the clause's own beginning, or the word begins it.
    parts = F.split(F.substring(said, F.lit(1), at - 1), r"[,;，；]\s+|\n")
    begin = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")
    rest = F.substring(said, at, F.length(said))
    whole = F.concat(begin, F.regexp_extract(rest, r"^[^?？.!]*[?？.!]?", 0))
    cut = F.regexp_replace(whole, r"^[\s,;，；]+|[\s,;，；]+$", "")
    return F.when(at.isNull() | (cut == ""), said).otherwise(cut)


# Implements of a catalogue's exercise names, and what a metric's verdict is called.
IMPLEMENTS = ("barbell", "dumbbell", "cable", "machine", "smith machine", "bodyweight", "kettlebell", "ez bar")
VERDICTS = ("plateau candidate", "plateau_candidate", "plateau-candidate", "training gap", "training_gap", "training-gap", "정체 후보", "median e1rm")


def personal_leaks(query: Column) -> Column:
    """Signs that a literature query tells of the asker's own records: a date, a number of sessions, a catalogue's name, a verdict."""
    said = F.lower(F.coalesce(query, F.lit("")))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(said, w))
    date = F.regexp_like(said, F.lit(r"(^|[^0-9])[0-9]{4}([-/.][0-9]{1,2}|\s?년)")) | F.regexp_like(said, F.lit(r"[0-9]{1,2}\s?월\s?[0-9]{1,2}\s?일"))
    sessions = F.regexp_like(said, F.lit(r"[0-9]+\s?[-–]?\s?(sessions?([^a-z]|$)|세션)"))
    return _words(F.when(date, "personal_date"), F.when(sessions, "personal_session_condition"), F.when(has([f"({x})" for x in IMPLEMENTS]), "canonical_catalog_form"), F.when(has(VERDICTS), "record_judgement"))


def outcomes(attempts: DataFrame, by: str, retries: int = MOST_RETRIES) -> DataFrame:
    """by, status, retries: where each case's searches end, from attempt (from 1), sufficient and failed.

    The first attempt that is sufficient or failed ends a case; after the first search and `retries`
    more without either it abstains. Later attempts count for nothing, so each case is one
    aggregate and its attempts may come in any order.
    """
    within = attempts.where(F.col("attempt").between(1, retries + 1))
    first = lambda c: F.min(F.when(F.col(c), F.col("attempt")))
    found = within.groupBy(by).agg(first("sufficient").alias("_good"), first("failed").alias("_bad"), F.max("attempt").alias("_last"))
    bad = F.col("_bad").isNotNull() & (F.col("_good").isNull() | (F.col("_bad") <= F.col("_good")))
    status = F.when(bad, "execution_failure").when(F.col("_good").isNotNull(), "answer_ready").otherwise("abstain_ready")
    end = F.when(bad, F.col("_bad")).otherwise(F.coalesce("_good", "_last"))
    return found.select(by, status.alias("status"), (end - 1).alias("retries"))


# The sentences of an answer that abstains.
ABSTENTION = {
    "have": "현재 확인 가능한 내용: {} 결과는 확보되어 있습니다.", "found": "현재 확인 가능한 내용: 검색된 문헌 근거 {}개를 확인했습니다.", "lack": "부족한 문헌 근거: {}",
    "unknown": "부족한 근거: {}", "no_reason": "현재 데이터와 문헌 근거로 답할 수 있는 범위를 확인하지 못했습니다.", "again": "초기 검색 후 문헌 추가 검색을 {}회 수행했지만 필요한 근거가 충분하지 않았습니다.",
    "once": "현재 문헌 검색 결과만으로는 필요한 근거가 충분하지 않았습니다.", "open": "따라서 현재 근거만으로는 다음 주장에 답을 확정할 수 없습니다: {}",
}
RECORDS_HAD, METRICS_HAD = "개인 운동 기록", "계산된 지표"


def abstention(tools: Column, chunks: Column, requirements: Column, reason: Column, retries: Column, question: Column) -> Column:
    """The text of an answer that abstains: what was found, what is missing, how often it was searched for, and what stays open."""

    def say(key: str, value: Column) -> Column:
        before, _, after = ABSTENTION[key].partition("{}")
        return F.concat(F.lit(before), value.cast("string"), F.lit(after))

    had = F.array_join(_words(F.when(F.array_contains(tools, LOG), RECORDS_HAD), F.when(F.array_contains(tools, METRIC), METRICS_HAD)), ", ")
    lacking = F.array_distinct(F.filter(F.transform(requirements, lambda x: F.trim(x)), lambda x: x != ""))
    why = F.coalesce(F.nullif(F.trim(reason), F.lit("")), F.lit(ABSTENTION["no_reason"]))
    parts = _words(
        F.when(F.size(tools) > 0, say("have", had)), F.when(chunks > 0, say("found", chunks)), F.when(F.size(lacking) > 0, say("lack", F.array_join(lacking, "; "))).otherwise(say("unknown", why)),
        F.when(retries > 0, say("again", retries)).when(chunks > 0, F.lit(ABSTENTION["once"])), say("open", question),
    )
    return F.array_join(parts, "\n\n")


@dataclass
class Step:
    tool: str
    operation: str
    inputs: dict = field(default_factory=dict)


@dataclass
class Done:
    tool: str
    operation: str
    status: str
    rows: DataFrame | None = None
    error: str | None = None


def execute(steps: list[Step], tools: dict[str, Callable[..., DataFrame]], limit: int | None = None) -> list[Done]:
    """What each step of a plan gave. A metric is computed from the records of the step before, never from a list that was
    cut at `limit`; a step that fails doesn't keep later ones from running, but a metric without records isn't run."""
    out, records = [], None
    for step in steps:
        tool, inputs = tools.get(step.tool), dict(step.inputs)
        if tool is None:
            out.append(Done(step.tool, step.operation, "configuration_error", error="tool_not_configured"))
            continue
        try:
            if step.tool == METRIC:
                if records is None:
                    out.append(Done(step.tool, step.operation, "dependency_error", error="training_records_unavailable"))
                    continue
                inputs["records"] = untruncated(records, limit) if limit else records
            rows = tool(step.operation, **inputs)
            out.append(Done(step.tool, step.operation, "ok" if rows.take(1) else "empty", rows))
            records = rows if step.tool == LOG else records
        except Exception as e:  # a tool's fault is a result of the plan
            out.append(Done(step.tool, step.operation, "execution_error", error=f"{type(e).__name__}: {e}"))
    return out

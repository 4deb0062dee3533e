"""Operations by name on a log and a corpus, and a question run through route, tools, grade and answer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import metrics, records, retrieval, timeseries
from tallyhouse.plans.router import SIGNALS, Signals, routed

#: Codes of errors in what was asked; others are faults of the data.
INPUT_ERRORS = ("invalid_date_range", "invalid_limit", "invalid_session_count", "unknown_operation", "unknown_exercise")
MAX_RECOVERIES = 2


@dataclass
class Result:
    """status: ok, empty (valid but without rows) or failed; rows is lazy."""

    operation: str
    status: str
    rows: DataFrame | None = None
    error: str | None = None


@dataclass
class Engine:
    """sets are flagged sets of one log; chunks and vectors are optional."""

    spark: SparkSession
    sets: DataFrame
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    signals: Signals = field(default_factory=lambda: SIGNALS)

    def _scope(self, exercise: str | None, start: dt.date | None, end: dt.date | None) -> DataFrame:
        rows = self.sets.where(records.in_dates("started_at", start, end))
        return rows if exercise is None else rows.where(F.col("exercise_name") == exercise)

    def operations(self) -> dict[str, Callable[..., DataFrame]]:
        bests = lambda rows: metrics.session_bests(rows)
        return {
            "exercise_records": lambda rows, limit=5000, **_: records.limited(rows, ["started_at", "set_order", "set_id"], limit),
            "list_sessions": lambda rows, limit=5000, **_: records.limited(records.sessions(rows), ["started_at", "session_id"], limit),
            "exercise_first_last": lambda rows, **_: records.first_and_last(rows),
            "date_bounds": lambda rows, **_: records.date_bounds(rows),
            "estimated_1rm": lambda rows, **_: bests(rows),
            "first_last_n_session_median_e1rm": lambda rows, n=5, **_: metrics.first_last_medians(bests(rows), n),
            "weekly_volume": lambda rows, **_: metrics.weekly_volume(rows),
            "weekly_frequency": lambda rows, **_: metrics.weekly_frequency(rows),
            "training_gap": lambda rows, **_: metrics.gaps(rows.select("exercise_name", "started_at", "session_id").distinct(), "exercise_name", "session_id"),
            "plateau_candidate": lambda rows, **_: metrics.plateau_candidates(bests(rows), "exercise_name", "best"),
            "peak_and_latest": lambda rows, **_: timeseries.peak_and_latest(bests(rows), "exercise_name"),
        }

    def run(self, operation: str, exercise: str | None = None, start: dt.date | None = None, end: dt.date | None = None, **arguments) -> Result:
        try:
            f = self.operations().get(operation)
            if not f:
                raise ValueError("unknown_operation")
            if exercise is not None:
                found = records.resolve_name(self.sets, exercise).take(2)
                if len(found) != 1:
                    raise ValueError("unknown_exercise")
                exercise = found[0][0]
            rows = f(self._scope(exercise, start, end), **arguments)
            return Result(operation, "ok" if rows.take(1) else "empty", rows)
        except ValueError as e:
            if str(e) not in INPUT_ERRORS:
                raise
            return Result(operation, "failed", error=str(e))

    def search(self, queries: DataFrame, k: int = 10, depth: int = 50) -> DataFrame:
        """Hybrid search of a table of queries (query_id, text, vector); without vectors lexical alone."""
        lexical = retrieval.bm25(queries, self.chunks, depth if self.vectors is not None else k)
        if self.vectors is None:
            return lexical
        return retrieval.rrf(retrieval.exact_cosine(queries, self.vectors, depth), lexical, k)

    def recovered(self, first: DataFrame, again: list[DataFrame], k: int = 10) -> DataFrame:
        """A first ranking fused with up to two later ones, each fusion's ranks being the next one's first list."""
        for other in again[:MAX_RECOVERIES]:
            first = retrieval.recovery_fusion(first, other, k)
        return first

    def plan(self, questions: DataFrame) -> DataFrame:
        return routed(questions, self.signals)

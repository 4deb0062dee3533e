"""Clarifications as a stream: expiry, wrong and second choices, capacity, batches and restarts."""

import datetime as dt
import random

import pytest

from tallyhouse.queries.streams import finished
from tallyhouse.streaming import clarifications, events

KIND = "owner long, action_id long, at timestamp, kind string, options array<string>, choice string"
START = dt.datetime(2024, 1, 1)


def ask(owner, nth, second, options="12"):
    return owner, nth, START + dt.timedelta(seconds=second), "ask", list(options), None


def choose(owner, nth, second, choice):
    return owner, nth, START + dt.timedelta(seconds=second), "choose", None, choice


def brute(rows, seconds, most, remember):
    """One owner after another, one action after another."""
    out, state = {}, {}
    for owner, nth, at, kind, options, choice in sorted(rows, key=lambda r: (r[2], r[1])):
        now = (at - START).total_seconds()
        waiting, last = state.setdefault(owner, ({}, [None]))
        if kind == "ask":
            live = {k: v for k, v in waiting.items() if v[0] > now}
            if len(options) < 2:
                out[nth] = "too_few_options"
            elif len(live) >= most:
                out[nth] = "capacity_reached"
            else:
                waiting[nth], last[0] = (now + seconds, options), (nth, now + seconds)
                out[nth] = "waiting"
        elif last[0] is None or now >= last[0][1] + remember:
            out[nth] = "not_found"
        elif now >= last[0][1]:
            waiting.pop(last[0][0], None)
            out[nth] = "expired"
        elif last[0][0] not in waiting:
            out[nth] = "not_found"
        elif choice not in waiting[last[0][0]][1]:
            out[nth] = "invalid_selection"
        else:
            del waiting[last[0][0]]
            out[nth] = "taken"
    return out


class Fed:
    """A folder that gets files, and a stream over it that goes on from its checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.parts = spark, folder, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, **settings):
        stream = self.spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        found = finished(clarifications.clarified(stream, **settings), "outcomes", f"{self.folder}/out").collect()
        return {r.action_id: r.outcome for r in found}


def test_outcomes_one_by_one(spark, tmp_path):
    fed = Fed(spark, tmp_path)
    rows = [
        ask(1, 1, 0), choose(1, 2, 5, "9"), choose(1, 3, 6, "2"), choose(1, 4, 7, "2"),  # wrong, right, second
        ask(2, 5, 0), choose(2, 6, 100, "1"), choose(2, 7, 400, "1"),  # expired at its end, then forgotten
        choose(3, 8, 1, "1"), ask(3, 9, 2, "1"), choose(3, 10, 3, "1"),  # nothing asked, too few options
        ask(4, 11, 0), ask(4, 12, 1), ask(4, 13, 2), choose(4, 14, 3, "1"), ask(4, 15, 4), ask(4, 16, 150),  # two at a time
    ]
    fed.add(rows)
    got = fed.run(seconds=100, most=2, remember=300)
    assert got == brute(rows, 100, 2, 300)
    assert [got[k] for k in range(1, 17)] == ["waiting", "invalid_selection", "taken", "not_found", "waiting", "expired", "not_found", "not_found", "too_few_options", "not_found", "waiting", "waiting", "capacity_reached", "taken", "waiting", "waiting"]


def test_batches_and_a_restart_change_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(240):
        owner = rng.choice([1, 1, 1, 2, 3])
        rows.append(ask(owner, k, k * 20, "123"[: rng.randint(1, 3)]) if rng.random() < 0.5 else choose(owner, k, k * 20, rng.choice("1234")))
    settings = {"seconds": 150, "most": 2, "remember": 200, "late": "0 seconds"}
    fed, got = Fed(spark, tmp_path), {}
    for a in range(0, 240, 60):
        fed.add(rows[a : a + 60])
        got = fed.run(**settings)  # a new run from the checkpoint that the last one left
    assert got == brute(rows, 150, 2, 200) and set(got.values()) == {"waiting", "too_few_options", "capacity_reached", "taken", "invalid_selection", "expired", "not_found"}


@pytest.mark.parametrize("form", [events.windowed_counts, events.sessions])
def test_other_streams_give_what_the_batch_gives(spark, tmp_path, form):
    rng = random.Random(5)
    rows = [(k, START + dt.timedelta(minutes=k * 17), rng.randint(1, 4), rng.choice("xy"), rng.random()) for k in range(400)]
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double"
    late = [(900, START + dt.timedelta(days=60), 1, "x", 0.0)]  # moves the watermark past all others
    for part in (rows, late):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = form(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    shown = lambda found: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found)
    assert shown(finished(stream, "counts").collect()) == shown(form(spark.createDataFrame(rows, kind)).collect())

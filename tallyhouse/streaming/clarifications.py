"""Questions that wait for a choice, as a stateful stream of actions.

Every owner has a state of his own: the questions that wait, each with its options and the moment it
ends, and the last question. An action is a row; its outcome is a row too:

* ask: `waiting`, or `too_few_options`, or `capacity_reached` while as many wait as may.
* choose, which is about the owner's last question that came to wait: `taken`, once; `invalid_selection`
  leaves it waiting; `expired` after its end; `not_found` if there is none, if it was taken, or if its
  end is longer ago than it is remembered.

All that decides is in the actions' own times, so outcomes are the same however the stream falls into
batches as long as actions come in their order; timers only clear what no later action can ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "owner long, action_id long, at timestamp, kind string, outcome string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


class Clarifications(StatefulProcessor):
    def __init__(self, seconds: float = 1200, most: int = 1024, remember: float = 86_400):
        self.seconds, self.most, self.remember = int(seconds * MICROS), most, int(remember * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "token long", "until long, options array<string>")
        self.last = handle.getValueState("last", "token long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        waiting = {k[0]: (v[0], v[1]) for k, v in self.open.iterator()}
        before, last = dict(waiting), self.last.get()
        # A batch's actions of one owner in their order; the batches' size bounds how many they are.
        for action in sorted(rows, key=lambda r: (r.micros, r.action_id)):
            if action.kind == "ask":
                outcome, waiting, last = self._asked(action, waiting, last)
            else:
                outcome = self._chosen(action, waiting, last)
            yield Row(owner=key[0], action_id=action.action_id, at=action.at, kind=action.kind, outcome=outcome)
        for token in before.keys() - waiting.keys():
            self.open.removeKey((token,))
        for token, value in waiting.items():
            if token not in before:
                self.open.updateValue((token,), value)
        if last is not None:
            self.last.update(tuple(last))
        self._timer(waiting, last)

    def _asked(self, action: Row, waiting: dict, last: tuple | None) -> tuple:
        if len(action.options or ()) < 2:
            return "too_few_options", waiting, last
        live = {k: v for k, v in waiting.items() if v[0] > action.micros}
        if len(live) >= self.most:
            return "capacity_reached", live, last
        until = action.micros + self.seconds
        return "waiting", live | {action.action_id: (until, list(action.options))}, (action.action_id, until)

    def _chosen(self, action: Row, waiting: dict, last: tuple | None) -> str:
        if last is None or action.micros >= last[1] + self.remember:
            return "not_found"
        if action.micros >= last[1]:
            waiting.pop(last[0], None)
            return "expired"
        if last[0] not in waiting:
            return "not_found"
        if action.choice not in waiting[last[0]][1]:
            return "invalid_selection"
        del waiting[last[0]]
        return "taken"

    def _timer(self, waiting: dict, last: tuple | None) -> None:
        """One timer for all that an owner has: when the last of it can be forgotten."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        ends = [v[0] for v in waiting.values()] + ([last[1] + self.remember] if last is not None else [])
        if ends:
            self.handle.registerTimer(max(ends) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.open.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def clarified(actions: DataFrame, seconds: float = 1200, most: int = 1024, remember: float = 86_400, late: str = "1 hour") -> DataFrame:
    """Outcomes of a stream of owner, action_id, at (timestamp), kind (ask or choose), options, choice.

    Rows without an owner, id or time are left out; of equal times the smaller id acts first. The session
    must use STATE_STORE, which transformWithState needs.
    """
    rows = actions.where("owner IS NOT NULL AND action_id IS NOT NULL AND at IS NOT NULL").withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    return rows.groupBy("owner").transformWithState(Clarifications(seconds, most, remember), OUTCOME, "append", "eventtime")

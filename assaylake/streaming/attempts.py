"""Provider calls as a keyed stream: retries with growing pauses, and failover over models and credentials.

Each request's state is small: how often it was tried, which model and credential come next, and which
credentials are spent. Timers of event time say when a retry is due and when a silent call has expired, so the
ledger follows from the events alone, in whatever batches they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "request_id string, at timestamp, outcome string, payload_returned boolean"
LEDGER = "request_id string, entry long, kind string, attempt long, model string, credential string, at timestamp, outcome string, status string"
LEDGER_NAMES = [part.split()[0] for part in LEDGER.split(",")]

#: Failures after which the same call may be tried again, those that spend a credential, and those that pass to the next model.
RETRYABLE = ("provider_unavailable", "timeout")
SPENDS_CREDENTIAL = ("quota_exhausted", "authentication_failed")
PASSES_MODEL = ("provider_unavailable", "timeout", "model_unavailable")
#: Tries of one call, and seconds before the next one (a power of two).
MAX_ATTEMPTS = 3
SECOND_MS = 1000


class Plan:
    """What one request's state decides, apart from Spark: the ledger's entries and when the next timer is due."""

    def __init__(self, models: tuple[str, ...], credentials: tuple[str, ...], failover: bool, expiry_s: int, held: tuple | None = None):
        self.models, self.credentials, self.failover, self.expiry_s = models, credentials, failover, expiry_s
        self.entries, self.attempt, self.model, self.credential, self.spent, self.status = held or (0, 0, 0, 0, 0, "OPEN")
        self.rows: list[tuple] = []
        self.due: int | None = None
        self.awaiting_retry = False

    def held(self) -> tuple:
        return self.entries, self.attempt, self.model, self.credential, self.spent, self.status

    def _enter(self, kind: str, at: int, outcome: str | None, status: str) -> None:
        self.entries += 1
        self.status = status
        model = self.models[self.model] if self.model < len(self.models) else None
        credential = self.credentials[self.credential] if self.credential < len(self.credentials) else None
        self.rows.append((self.entries, kind, self.attempt, model, credential, at, outcome, status))

    def _next_credential(self) -> bool:
        free = [i for i in range(len(self.credentials)) if not self.spent >> i & 1]
        self.credential = free[0] if free else len(self.credentials)
        return bool(free)

    def event(self, at: int, outcome: str, payload_returned: bool) -> None:
        """The outcome of the call that is under way; outcomes after the end are kept as late ones."""
        if self.status not in ("OPEN", "RETRYING_TRANSIENT", "FAILING_OVER"):
            self._enter("late", at, outcome, self.status)
            return
        self.attempt += 1
        if outcome == "succeeded":
            self._enter("attempt", at, outcome, "LIVE_PAYLOAD_RETURNED")
        elif self.failover and outcome in SPENDS_CREDENTIAL:
            self._enter("attempt", at, outcome, "FAILING_OVER")
            self.spent |= 1 << self.credential
            if not self._next_credential():
                self._enter("end", at, outcome, "CREDENTIALS_UNAVAILABLE")
        elif self.failover and outcome in PASSES_MODEL:
            self._enter("attempt", at, outcome, "FAILING_OVER")
            self.model += 1
            if self.model == len(self.models):
                self._enter("end", at, outcome, "MODELS_UNAVAILABLE")
        elif not self.failover and outcome in RETRYABLE:
            last = self.attempt >= MAX_ATTEMPTS
            self._enter("attempt", at, outcome, "LIVE_PAYLOAD_REPAIR_UNAVAILABLE" if payload_returned else "LIVE_UNAVAILABLE_AFTER_RETRIES" if last else "RETRYING_TRANSIENT")
            if self.status == "LIVE_PAYLOAD_REPAIR_UNAVAILABLE" and not last:
                self.status = "RETRYING_TRANSIENT"
            if not last:
                self.due, self.awaiting_retry = at + SECOND_MS * 2**self.attempt, True
        else:
            self._enter("attempt", at, outcome, "NON_TRANSIENT_FAILURE")
        if self.due is None and self.status in ("OPEN", "FAILING_OVER"):
            self.due = at + SECOND_MS * self.expiry_s

    def timer(self, at: int, retry: bool) -> None:
        """A pause is over, or a call has been silent for too long."""
        if self.status not in ("OPEN", "RETRYING_TRANSIENT", "FAILING_OVER"):
            return
        if retry:
            self._enter("retry_due", at, None, self.status)
            self.due = at + SECOND_MS * self.expiry_s
        else:
            self._enter("end", at, None, "EXPIRED")


class _Calls(StatefulProcessor):
    def __init__(self, models, credentials, failover, expiry_s):
        self.settings = (models, credentials, failover, expiry_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "entries long, attempt long, model long, credential long, spent long, status string")
        self.waits = handle.getValueState("waits", "due long, retry boolean")

    def _plan(self) -> Plan:
        return Plan(*self.settings, tuple(self.state.get()) if self.state.exists() else None)

    def _keep(self, plan: Plan) -> None:
        self.state.update(plan.held())
        if self.waits.exists():
            self.handle.deleteTimer(self.waits.get()[0])
            self.waits.clear()
        if plan.due is not None:
            self.handle.registerTimer(plan.due)
            self.waits.update((plan.due, plan.awaiting_retry))

    @staticmethod
    def _frame(key, rows) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *r) for r in rows], columns=LEDGER_NAMES)
        out["at"] = pd.to_datetime(out["at"], unit="ms")
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["at", "outcome"])
        plan = self._plan()
        if self.waits.exists():
            plan.due, plan.awaiting_retry = self.waits.get()
        for r in events.itertuples(index=False):
            at = int(pd.Timestamp(r.at).value // 1_000_000)
            # A pause or an expiry that lies before this event has passed, even if its timer has not been called.
            while plan.due is not None and plan.due <= at:
                due, retry = plan.due, plan.awaiting_retry
                plan.due, plan.awaiting_retry = None, False
                plan.timer(due, retry)
            plan.due, plan.awaiting_retry = None, False
            plan.event(at, r.outcome, bool(r.payload_returned))
        self._keep(plan)
        yield self._frame(key, plan.rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        plan = self._plan()
        at, retry = expiredTimerInfo.getExpiryTimeInMs(), self.waits.exists() and bool(self.waits.get()[1])
        self.waits.clear()
        plan.timer(at, retry)
        self._keep(plan)
        yield self._frame(key, plan.rows)

    def close(self) -> None:
        pass


def attempt_ledger(events: DataFrame, models: tuple[str, ...], credentials: tuple[str, ...], failover: bool, expiry_s: int = 600, late: str = "1 minute") -> DataFrame:
    """The ledger of a stream of EVENT rows, append-only.

    Without ``failover`` a retryable failure is tried again, MAX_ATTEMPTS times in all, 2, 4, ... seconds after
    it. With it, a spent credential passes to the next one for good, an unavailable model to the next model,
    and other failures end the request. The stream needs the RocksDB state store.
    """
    return (
        events.withWatermark("at", late)
        .groupBy("request_id")
        .transformWithStateInPandas(_Calls(models, credentials, failover, expiry_s), LEDGER, "Append", "EventTime")
    )

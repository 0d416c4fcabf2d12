"""Retries and failover as a keyed stream, against the same decisions replayed in a plain loop, and SQL over the ledger."""

import datetime as dt
import json
import os
import random

import duckdb
import pytest

from assaylake.streaming import attempts

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def run(spark, folder, batches, name, **settings):
    (folder / "in").mkdir()
    for i, batch in enumerate(batches):
        text = "".join(json.dumps({"request_id": r, "at": (T0 + dt.timedelta(seconds=s)).isoformat(), "outcome": o, "payload_returned": p}) + "\n" for r, s, o, p in batch)
        (folder / "in" / f"{i}.json").write_text(text)
        os.utime(folder / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    events = spark.readStream.schema(attempts.EVENT).option("maxFilesPerTrigger", 1).json(f"file://{folder}/in")
    ledger = attempts.attempt_ledger(events, ("big", "small"), ("a", "b"), **settings)
    query = ledger.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return sorted((r.request_id, r.entry, r.kind, r.attempt, r.model, r.credential, int(r.at.replace(tzinfo=dt.timezone.utc).timestamp() - T0.timestamp()), r.outcome, r.status) for r in spark.table(name).collect())


def test_retries_pause_and_end(rocks, tmp_path):
    batches = [
        [("ok", 0, "succeeded", True), ("slow", 0, "timeout", False), ("bad", 0, "schema_invalid", False), ("mute", 1, "timeout", False)],
        [("slow", 5, "provider_unavailable", False), ("ok", 6, "timeout", False)],
        [("slow", 20, "timeout", True), ("half", 20, "timeout", True)],
        [("tick", 5000, "succeeded", True)],
        [("tick2", 5001, "succeeded", True)],
    ]
    got = run(rocks, tmp_path, batches, "retries", failover=False, expiry_s=100)
    mine = lambda r: [x[2:] for x in got if x[0] == r]
    assert mine("ok") == [("attempt", 1, "big", "a", 0, "succeeded", "LIVE_PAYLOAD_RETURNED"), ("late", 1, "big", "a", 6, "timeout", "LIVE_PAYLOAD_RETURNED")]
    assert mine("bad") == [("attempt", 1, "big", "a", 0, "schema_invalid", "NON_TRANSIENT_FAILURE")]
    assert [(x[0], x[4], x[6]) for x in mine("slow")] == [
        ("attempt", 0, "RETRYING_TRANSIENT"), ("retry_due", 2, "RETRYING_TRANSIENT"), ("attempt", 5, "RETRYING_TRANSIENT"),
        ("retry_due", 9, "RETRYING_TRANSIENT"), ("attempt", 20, "LIVE_PAYLOAD_REPAIR_UNAVAILABLE"),
    ]
    # A call that never answers again: the pause, then the expiry.
    assert [(x[0], x[4], x[6]) for x in mine("mute")] == [("attempt", 1, "RETRYING_TRANSIENT"), ("retry_due", 3, "RETRYING_TRANSIENT"), ("end", 103, "EXPIRED")]
    assert [(x[0], x[4]) for x in mine("half")] == [("attempt", 20), ("retry_due", 22), ("end", 122)]


def test_failover_over_credentials_then_models(rocks, tmp_path):
    batches = [
        [("q", 0, "quota_exhausted", False), ("m", 0, "provider_unavailable", False), ("f", 0, "schema_invalid", False)],
        [("q", 3, "timeout", False), ("m", 3, "quota_exhausted", False), ("f", 3, "succeeded", True)],
        [("q", 6, "authentication_failed", False), ("m", 6, "succeeded", True)],
        [("tick", 5000, "succeeded", True)],
        [("tick2", 5001, "succeeded", True)],
    ]
    got = run(rocks, tmp_path, batches, "failover", failover=True)
    mine = lambda r: [(x[2], x[4], x[5], x[8]) for x in got if x[0] == r]
    assert mine("q") == [("attempt", "big", "a", "FAILING_OVER"), ("attempt", "big", "b", "FAILING_OVER"), ("attempt", "small", "b", "FAILING_OVER"), ("end", "small", None, "CREDENTIALS_UNAVAILABLE")]
    assert mine("m") == [("attempt", "big", "a", "FAILING_OVER"), ("attempt", "small", "a", "FAILING_OVER"), ("attempt", "small", "b", "LIVE_PAYLOAD_RETURNED")]
    assert mine("f") == [("attempt", "big", "a", "NON_TRANSIENT_FAILURE"), ("late", "big", "a", "NON_TRANSIENT_FAILURE")]


def test_batches_do_not_matter_and_sql_over_the_ledger(rocks, tmp_path):
    rng = random.Random(3)
    outcomes = ["timeout", "provider_unavailable", "succeeded", "schema_invalid"]
    events = sorted(((f"r{rng.randrange(12)}", s, rng.choice(outcomes), False) for s in rng.sample(range(300), 40)), key=lambda e: e[1])
    want = []
    for request in sorted({e[0] for e in events}):
        plan = attempts.Plan(("big", "small"), ("a", "b"), False, 30)
        for _, s, outcome, payload in [e for e in events if e[0] == request] + [(request, 10**6, None, False)]:
            while plan.due is not None and plan.due <= s * 1000:
                due, retry = plan.due, plan.awaiting_retry
                plan.due, plan.awaiting_retry = None, False
                plan.timer(due, retry)
            plan.due, plan.awaiting_retry = None, False
            if outcome:
                plan.event(s * 1000, outcome, payload)
        want += [(request, *r[:5], r[5] // 1000, *r[6:]) for r in plan.rows]
    tick = [[("tick", 5000, "succeeded", True)], [("tick2", 5001, "succeeded", True)]]
    ledgers = []
    for i, size in enumerate((7, 40)):
        folder = tmp_path / str(i)
        folder.mkdir()
        batches = [events[k : k + size] for k in range(0, 40, size)] + tick
        ledgers.append([r for r in run(rocks, folder, batches, f"ledger{i}", failover=False, expiry_s=30) if "tick" not in r[0]])
    assert ledgers[0] == ledgers[1] == sorted(want)
    con = duckdb.connect()
    con.execute("CREATE TABLE ledger (request_id VARCHAR, entry INT, kind VARCHAR, attempt INT, model VARCHAR, credential VARCHAR, s INT, outcome VARCHAR, status VARCHAR)")
    con.executemany("INSERT INTO ledger VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", ledgers[0])
    assert con.execute("SELECT count(*) FROM ledger WHERE kind = 'attempt' AND attempt > 3").fetchone() == (0,)
    pauses = "SELECT count(*) FROM ledger a JOIN ledger b ON b.request_id = a.request_id AND b.entry = a.entry + 1 WHERE a.kind = 'attempt' AND b.kind = 'retry_due' AND b.s - a.s <> 2 ** a.attempt"
    assert con.execute(pauses).fetchone() == (0,)
    assert con.execute("SELECT count(*) FROM (SELECT request_id FROM ledger GROUP BY 1 HAVING max(entry) <> count(*))").fetchone() == (0,)

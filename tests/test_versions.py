"""Versions of tables, hash chains and merged answers on small cases."""

import pytest

from assaylake.operators import chains, dispositions
from assaylake.sources.versions import Conflict, VersionedTables, append_once
from assaylake.streaming import jobs

ROW = "event_id string, v int"


def table(tables, name, schema):
    return sorted(tuple(r) for r in tables.read(name, schema).collect())


def test_a_batch_lost_between_its_writes_leaves_the_old_version(spark, tmp_path):
    tables = VersionedTables(spark, f"file://{tmp_path}/t")
    assert tables.version() == 0 and table(tables, "rows", ROW) == []
    append_once(tables, spark.createDataFrame([("x", 1), ("y", 2)], ROW), "event_id", "w", 0)
    second = spark.createDataFrame([("y", 2), ("x", 9), ("z", 3)], ROW)
    publish = tables._publish
    tables._publish = lambda manifest: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError, match="killed"):
        append_once(tables, second, "event_id", "w", 1)
    tables._publish = publish
    assert tables.version() == 1 and table(tables, "rows", ROW) == [("x", 1), ("y", 2)] and table(tables, "conflicts", "event_id string") == []
    for _ in range(2):
        append_once(tables, second, "event_id", "w", 1)
    assert tables.version() == 2
    assert table(tables, "rows", ROW) == [("x", 1), ("y", 2), ("z", 3)] and table(tables, "conflicts", "event_id string") == [("x",)]
    assert sorted(r.event_id for r in tables.read("rows", ROW, 1).collect()) == ["x", "y"]


def test_two_writers_of_one_version(spark, tmp_path):
    tables = VersionedTables(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([("x", 1)], ROW)
    base = tables.manifest()
    assert tables.commit({"rows": rows}, base=base) == 1
    with pytest.raises(Conflict):
        tables.commit({"rows": rows}, base=base)
    assert table(tables, "rows", ROW) == [("x", 1)]
    assert tables.commit({"rows": rows}, replace=("rows",)) == 2 and table(tables, "rows", ROW) == [("x", 1)]


def test_stream_into_versions(spark, tmp_path):
    (tmp_path / "ev").mkdir()
    events = spark.readStream.schema(ROW).json(f"file://{tmp_path}/ev")
    (tmp_path / "ev" / "a.json").write_text('{"event_id": "x", "v": 1}\n{"event_id": "x", "v": 1}\n{"event_id": "y", "v": 2}\n')
    for _ in range(2):
        jobs.append_versions(events, f"file://{tmp_path}/log", f"file://{tmp_path}/cp").awaitTermination(120)
        (tmp_path / "ev" / "b.json").write_text('{"event_id": "y", "v": 2}\n{"event_id": "x", "v": 9}\n{"event_id": "z", "v": 3}\n')
    tables = VersionedTables(spark, f"file://{tmp_path}/log")
    assert table(tables, "rows", ROW) == [("x", 1), ("y", 2), ("z", 3)] and table(tables, "conflicts", "event_id string") == [("x",)]


def test_chains(spark):
    logs = spark.createDataFrame([("a", i, f"p{i}") for i in range(1, 8)] + [("b", 1, None), ("b", 2, "x")], "log_id string, ordinal long, payload string")
    whole = chains.chained(logs)
    assert chains.broken_links(whole).count() == 0
    changed = whole.selectExpr("log_id", "ordinal", "if(log_id = 'a' and ordinal = 5, 'other', payload) as payload", "prev_hash", "hash")
    assert [tuple(r) for r in chains.verified_prefix(changed).orderBy("log_id").collect()] == [("a", 7, 4, 5, "tampered"), ("b", 2, 2, None, None)]
    gap = whole.filter("not (log_id = 'a' and ordinal in (3, 4))")
    assert [(r.ordinal, r.reason) for r in chains.broken_links(gap).collect()] == [(5, "predecessor_missing")]
    assert sorted((r.ordinal, r.difference) for r in chains.log_differences(gap, whole, 3).collect()) == [(3, "missing"), (4, "missing")]
    assert chains.log_differences(whole, whole, 3).count() == 0
    assert [r.r for r in chains.ranked(whole.filter("log_id = 'a' and ordinal <> 2"), "log_id", "ordinal", "r", 3).orderBy("ordinal").collect()] == [1, 2, 3, 4, 5, 6]
    assert chains.verified_prefix(whole.limit(0)).count() == 0


def test_answers_are_merged_whole_or_not_at_all(spark):
    known = spark.createDataFrame([("d", "a", "Pt/C")], "doc_id string, local_id string, identity string")
    candidates = spark.createDataFrame([("d", f"c{i}", "the rate was 5") for i in range(1, 7)], "doc_id string, candidate_id string, snippet string")
    answers = spark.createDataFrame(
        [("d", 1, "c1", "added", None), ("d", 2, "c2", "added", None), ("d", 3, "c3", "added", None), ("d", 4, "c4", "rejected", "no"), ("d", 5, "c9", "added", None), ("d", 6, "c1", "added", None), ("d", 7, "c5", "added", None), ("d", 8, "c6", "added", None)],
        "doc_id string, seq int, candidate_id string, status string, reason string",
    )
    additions = spark.createDataFrame(
        [("d", 1, "b", "Ni", "rate was 5"), ("d", 1, "a", "Au", "rate was 5"), ("d", 2, "b", "Fe", "rate was 5"), ("d", 3, "b", "Co", "rate was 5"), ("d", 3, "x", "Q", "rate was 5"), ("d", 7, "x", "R", "rate was 6")],
        "doc_id string, seq int, local_id string, identity string, snippet string",
    )
    state, outcomes = dispositions.merge_dispositions(known, candidates, answers, additions)
    # 1 contradicts the document, so its b is gone and 2 may say what b is; 3 contradicts 2, so x stays unsaid.
    assert sorted(map(tuple, state.collect())) == [("d", "a", "Pt/C"), ("d", "b", "Fe")]
    assert {r.seq: r.accepted for r in outcomes.collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True}
    assert {r.seq: r.reason for r in outcomes.collect() if r.seq in (4, 5, 6)} == {4: "no", 5: "unknown_or_duplicate_candidate_id", 6: "unknown_or_duplicate_candidate_id"}

"""Sessions kept by a stream: late and repeated messages, restarts, bounded memory."""

from datetime import datetime, timedelta

from tendero.sources.snapshots import SnapshotTable
from tendero.streaming import state

SCHEMA = "session long, at timestamp, seq long, role string"
DAY = datetime(2024, 3, 1)


def message(session, hours, seq, role="user"):
    return (session, DAY + timedelta(hours=hours), seq, role)


def batch_result(rows):
    out = {}
    for session, at, seq, role in {(r[0], r[2]): r for r in rows}.values():
        n, newest = out.get(session, (0, (datetime.min, 0, "")))
        out[session] = (n + 1, max(newest, (at, seq, role)))
    return sorted(((k, n, newest[0], newest[2]) for k, (n, newest) in out.items()), key=str)


def test_three_runs_equal_one_batch(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    runs = [
        [message(1, 0, 1), message(1, 1, 2, "assistant"), message(2, 2, 3), message(2, 2, 3), message(None, 1, 4)],
        # repeats of the first run, and messages older than those known
        [message(1, 1, 2, "assistant"), message(1, 0.5, 5, "late"), message(3, 20, 6), message(2, 30, 7, "assistant"), message(2, 2, 3)],
        [message(3, 40, 8, "assistant"), message(2, 28, 9, "late"), message(2, 30, 7, "assistant"), message(4, 41, 10)],
    ]
    seen, remembered = [], []
    for n, rows in enumerate(runs):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/part{n}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)
        run = state.run_sessions(stream, work, delay="36 hours")
        seen += rows
        got = sorted(((r.session, r.messages, r.updated_at, r.last_role) for r in run.sessions.collect()), key=str)
        assert got == batch_result(seen) and run.refused == 0
        remembered.append(run.remembered)
    # far later: what was remembered goes, and a message from before the delay is refused, not counted twice
    spark.createDataFrame([message(9, 500, 20)], SCHEMA).coalesce(1).write.parquet(f"{source}/part8")
    run = state.run_sessions(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source), work, delay="36 hours")
    assert remembered == [4, 7, 10] and run.remembered == 1
    spark.createDataFrame([message(1, 0, 1), message(9, 501, 21)], SCHEMA).coalesce(1).write.parquet(f"{source}/part9")
    run = state.run_sessions(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source), work, delay="36 hours")
    assert run.refused == 1
    got = {r.session: r.messages for r in run.sessions.collect()}
    assert got == {r[0]: r[1] for r in batch_result([*seen, message(9, 500, 20), message(9, 501, 21)])}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    store = SnapshotTable.create(spark, str(tmp_path / "s"), state.SESSIONS, ["session"])
    rows = spark.createDataFrame([message(1, 0, 1), message(1, 2, 2, "assistant")], SCHEMA)
    state.merge_sessions(store, rows, tag="batch 0")
    state.merge_sessions(store, rows, tag="batch 0")
    assert [r.messages for r in store.read().collect()] == [2]


def test_many_batches_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FOLD_AFTER", 2)
    store = SnapshotTable.create(spark, str(tmp_path / "s"), state.SESSIONS, ["session"])
    for n in range(4):
        state.merge_sessions(store, spark.createDataFrame([message(n % 2, n, n)], SCHEMA), tag=f"batch {n}")
    assert store.manifest()["base"] is not None and len(store.manifest()["deltas"]) <= 2
    assert sorted((r.session, r.messages) for r in store.read().collect()) == [(0, 2), (1, 2)]

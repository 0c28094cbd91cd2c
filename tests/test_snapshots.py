"""The keyed table: merges, tombstones, old readers, crashes and writers side by side."""

import pytest

from tendero.sources import snapshots
from tendero.sources.snapshots import Conflict, SnapshotTable

SCHEMA = "k string, at int, v double"


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable.create(spark, str(tmp_path / "t"), SCHEMA, ["k"])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def put(table, *data, **more):
    return table.upsert(table.spark.createDataFrame(list(data), SCHEMA), **more)


def drop(table, *keys):
    return table.delete(table.spark.createDataFrame([(k,) for k in keys], "k string"))


def test_changes_merge_on_reading(table):
    assert rows(table.read()) == []
    one = put(table, ("a", 1, 1.0), ("b", 1, 2.0), (None, 1, 9.0))
    two = put(table, ("b", 2, 3.0), ("c", 2, 4.0), ("c", 1, 5.0), order=["at"])
    three = drop(table, "a", "unknown", None)
    want = [("b", 2, 3.0), ("c", 2, 4.0)]
    assert rows(table.read()) == want
    assert rows(table.read(one)) == [("a", 1, 1.0), ("b", 1, 2.0), (None, 1, 9.0)]
    assert rows(table.read(two)) == sorted([("a", 1, 1.0), ("b", 2, 3.0), ("c", 2, 4.0), (None, 1, 9.0)], key=str)
    folded = table.compact()
    assert table.manifest()["deltas"] == [] and rows(table.read()) == want and folded > three
    put(table, ("a", 7, 7.0), ("b", None, None))
    assert rows(table.read()) == sorted([("a", 7, 7.0), ("b", None, None), ("c", 2, 4.0)], key=str)
    drop(table, "c")
    assert rows(table.read()) == sorted([("a", 7, 7.0), ("b", None, None)], key=str)
    assert rows(table.read(folded)) == want  # an older reader still has its files


def test_base_is_not_shuffled(spark, table, tmp_path):
    put(table, *[(f"k{n}", n, float(n)) for n in range(100)])
    table.compact()
    put(table, ("k1", 0, -1.0))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    base = plan.split("BroadcastHashJoin")[1].split("BroadcastExchange")[0]
    assert "LeftAnti" in base and "FileScan" in base and "Exchange" not in base


def test_a_crash_before_the_manifest_changes_nothing(table, monkeypatch):
    put(table, ("a", 1, 1.0))
    before = table.versions()

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_commit", die)
        with pytest.raises(OSError):
            put(table, ("a", 2, 2.0))
        with pytest.raises(OSError):
            table.compact()
    again = SnapshotTable(table.spark, table.path)
    assert again.versions() == before and rows(again.read()) == [("a", 1, 1.0)]
    put(again, ("a", 3, 3.0))
    assert rows(again.read()) == [("a", 3, 3.0)]
    assert len(again.vacuum()) == 2  # the two folders that no manifest names; the rest is in use


def test_a_half_written_manifest_is_no_snapshot(table, tmp_path):
    put(table, ("a", 1, 1.0))
    last = table.versions()[-1]
    (tmp_path / "t" / "manifests" / f"{last + 1:010d}.json").write_text('{"key": ["k"], "base"')
    assert table.versions()[-1] == last and rows(table.read()) == [("a", 1, 1.0)]
    assert put(table, ("b", 1, 1.0)) == last + 2
    assert rows(table.read()) == [("a", 1, 1.0), ("b", 1, 1.0)]


def test_the_second_writer_builds_on_the_first(table, monkeypatch):
    put(table, ("a", 1, 1.0))
    other, real, calls = SnapshotTable(table.spark, table.path), SnapshotTable._next_number, []

    def late(self):
        number = real(self)
        if self is table and not calls:
            calls.append(1)
            put(other, ("b", 2, 2.0))  # comes between reading and committing
        return number

    monkeypatch.setattr(SnapshotTable, "_next_number", late)
    put(table, ("c", 3, 3.0))
    assert rows(table.read()) == [("a", 1, 1.0), ("b", 2, 2.0), ("c", 3, 3.0)]
    calls.clear()
    monkeypatch.setattr(SnapshotTable, "_next_number", lambda self: real(self))
    old = table.manifest()

    def during(self, version=None, read=SnapshotTable.read):
        found = read(self, version)
        if not calls:
            calls.append(1)
            put(other, ("d", 4, 4.0))
        return found

    monkeypatch.setattr(SnapshotTable, "read", during)
    table.compact()
    monkeypatch.undo()
    assert len(table.manifest()["deltas"]) == 1 and table.manifest()["base"] != old["base"]
    assert rows(table.read()) == [("a", 1, 1.0), ("b", 2, 2.0), ("c", 3, 3.0), ("d", 4, 4.0)]


def test_numbers_are_never_taken_twice(table):
    with pytest.raises(Conflict):
        table._commit(0, table.manifest())


def test_a_tag_is_applied_once(table):
    put(table, ("a", 1, 1.0), tag="batch 0")
    version = table.versions()[-1]
    assert put(table, ("a", 9, 9.0), tag="batch 0") == version
    assert rows(table.read()) == [("a", 1, 1.0)]


def test_vacuum_keeps_what_is_named(table):
    for n in range(4):
        put(table, ("a", n, float(n)))
    table.compact()
    put(table, ("b", 0, 0.0))
    gone = table.vacuum(keep=1)
    assert len(gone) == 4 and rows(table.read()) == [("a", 3, 3.0), ("b", 0, 0.0)]
    assert len(table.versions()) == 1


def test_keys_must_exist(spark, tmp_path):
    with pytest.raises(ValueError):
        SnapshotTable.create(spark, str(tmp_path / "x"), SCHEMA, ["no"])
    with pytest.raises(ValueError):
        SnapshotTable(spark, str(tmp_path / "nothing")).read()
    assert snapshots.END

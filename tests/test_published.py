"""Versions of a table side by side: what readers see whatever becomes of a writer."""

import pytest

from tallyreach.sources import published


def rows(spark, *values):
    return spark.createDataFrame([(value,) for value in values], "a int")


def seen(spark, path):
    return sorted(row.a for row in published.read(spark, path).collect())


def test_versions_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError, match="published"):
        published.read(spark, path)
    assert published.publish(rows(spark, 1, 2), path) == 1
    early = published.read(spark, path)
    assert published.publish(early.selectExpr("a * 10 AS a"), path) == 2
    assert seen(spark, path) == [10, 20]
    assert sorted(row.a for row in early.collect()) == [1, 2]
    assert published.publish(rows(spark), path) == 3
    assert seen(spark, path) == []
    # The first version is gone with its note, the second is still there.
    assert len(list((tmp_path / "t").glob("data-*"))) == 2
    assert len(list((tmp_path / "t" / published.NOTES).glob("*.json"))) == 2
    with pytest.raises(ValueError, match="newest"):
        published.publish(rows(spark), path, kept=0)


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "x"), (2, "y")], "a int, part string")
    published.publish(frame, path, ("part",))
    assert published.read(spark, path, frame.schema).filter("part = 'y'").first().a == 2


def test_a_writer_lost_before_its_note_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    published.publish(rows(spark, 1), path)

    def lost(*_):
        raise SystemExit

    with monkeypatch.context() as patch:
        patch.setattr(published, "_note", lost)
        with pytest.raises(SystemExit):
            published.publish(rows(spark, 2), path)
    assert seen(spark, path) == [1]
    # Killed outright: its directory stays, without a note.
    rows(spark, 3).write.parquet(f"{path}/data-lost")
    assert seen(spark, path) == [1]
    assert published.publish(rows(spark, 4), path) == 2
    assert seen(spark, path) == [4]


def test_a_note_half_written_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "t")
    published.publish(rows(spark, 1), path)
    (tmp_path / "t" / published.NOTES / f"{2:012d}.json").write_text('{"direc')
    assert seen(spark, path) == [1]
    assert published.publish(rows(spark, 5), path) == 3
    assert seen(spark, path) == [5]


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    published.publish(rows(spark, 1), path)
    monkeypatch.setattr(published, "_numbers", lambda *_: [])
    with pytest.raises(FileExistsError):
        published.publish(rows(spark, 2), path)
    monkeypatch.undo()
    assert seen(spark, path) == [1]
    assert len(list((tmp_path / "t").glob("data-*"))) == 1

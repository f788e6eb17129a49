"""Checkpoint tables can be removed at the end of a job."""

import os

from vardens import session


def test_remove_checkpoints_deletes_what_this_process_wrote(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    kept = spark.range(3)
    frame = session.checkpoint(kept)
    folder = session._written[0]
    assert frame.count() == 3 and os.path.isdir(folder.removeprefix("file:"))
    assert session.remove_checkpoints(spark) == 1 and session.remove_checkpoints(spark) == 0
    assert not os.path.exists(folder.removeprefix("file:")) and kept.count() == 3


def test_a_checkpoint_bounds_automatic_broadcasts(spark):
    name = next(iter(session.BROADCAST_SETTINGS))
    before = spark.conf.get(name)
    try:
        for now, then in (("10MB", str(session.BROADCAST_BYTES)), ("64k", "64k"), ("-1", "-1")):
            spark.conf.set(name, now)
            session.checkpoint(spark.range(1))
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)

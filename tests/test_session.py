"""Intermediates of a job: where they lie and when they go."""

from pathlib import Path

import pytest

from evigrid import session


def test_release_deletes_this_jobs_intermediates_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    spark.range(3).write.parquet(str(tmp_path / "evigrid-other" / "a"))
    first = session.materialise(spark.range(5))
    second = session.materialise(first.selectExpr("id * 2 as id"))
    assert sorted(r.id for r in second.collect()) == [0, 2, 4, 6, 8]
    folder = Path(session.job_folder(spark))
    assert sum(1 for x in folder.iterdir() if x.is_dir()) == 2
    session.release(spark)
    assert not any(x.is_dir() for x in folder.iterdir())
    with pytest.raises(Exception, match="FILE_NOT_EXIST"):
        second.collect()
    assert spark.read.parquet(str(tmp_path / "evigrid-other" / "a")).count() == 3
    # the job may go on with new ones, and a release without any is no error
    assert session.materialise(spark.range(2)).count() == 2
    session.release(spark)
    session.release(spark)

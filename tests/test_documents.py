"""A file for each row, written by all tasks."""

from __future__ import annotations

import glob

from tallyframe.plans import files as P


def test_pages_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """Pages that lie in one part of a table are dealt, each is a file, and all of them are read back."""
    spark.sql("SELECT id AS page_id, repeat('é', CAST(id AS INT)) AS html FROM range(40)").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(P, "_folder", lambda _: f"file://{tmp_path}/files")
    assert sorted(map(tuple, P.page_documents(spark, str(tmp_path)).collect())) == [(k, k) for k in range(40)]
    found = glob.glob(f"{tmp_path}/files/part-*.json")
    assert len(found) == 40 and len({f.split("part-")[1].split("-")[0] for f in found}) > 2

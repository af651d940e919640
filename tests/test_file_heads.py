"""The first bytes of files that are read in splits."""

from __future__ import annotations

from tallyframe.plans import registry
from tallyframe.sources import files as S

registry.load()
BODIES = {"a": b"PAR1" + b"x" * 5000 + b"\nPAR2\n" * 900, "b": b"P\n\nQrest", "c": b"\n\n\n\n\nz", "d": b"ab", "e": b"", "f": b"\xff\xfe\x00\r\nmore", "g": b"A\r\n"}


def test_heads_are_the_first_bytes(spark, tmp_path):
    for stem, body in BODIES.items():
        (tmp_path / f"{stem}.parquet").write_bytes(body)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.file_path.rsplit("/", 1)[1][0]: bytes(r["head"]) for r in S.file_heads(spark, str(tmp_path), "*.parquet").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {stem: body[:4] for stem, body in BODIES.items() if body}


def test_no_task_holds_a_whole_file(spark, tmp_path):
    """The content column, of which one task reads a file as a whole, is not asked for."""
    spark.range(9).write.parquet(f"{tmp_path}/documents.parquet")
    done = registry.QUERIES["file_scan"](spark, str(tmp_path))
    assert {r.magic for r in done.collect()} == {"PAR1"}
    assert "content" not in done._jdf.queryExecution().executedPlan().toString()


def test_two_queries_read_given_tables(spark):
    """The linter ran on rows made up in the program, the join on listings alone."""
    sf = "/root/testdata/sf0.001"
    for name, files in (("policy_linter", "part.parquet"), ("stem_join", "conversations.parquet")):
        assert any(f.endswith(files) for f in registry.QUERIES[name](spark, sf).inputFiles())
    assert {r.stem for r in registry.QUERIES["stem_join"](spark, sf).collect()} >= {"orders", "events", "documents"}

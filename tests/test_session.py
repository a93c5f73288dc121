"""The checkpoint folder, and what is read of stored tables."""

from types import SimpleNamespace

import pytest

import __spark_entry__ as entry
from airspan.session import checkpoint_root, remove
from airspan.sinks.writers import stored_or_none

SF_DIR = "/root/testdata/sf0.001"


def test_a_cluster_needs_a_shared_checkpoint_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(session)


def test_a_time_range_reads_only_its_days(spark):
    plan = entry.queries()["stored_days"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_only_a_missing_table_counts_as_empty(spark, tmp_path):
    assert stored_or_none(spark, str(tmp_path / "none")) is None
    (tmp_path / "empty").mkdir()
    assert stored_or_none(spark, str(tmp_path / "empty")) is None
    with pytest.raises(Exception):
        stored_or_none(spark, "nosuchscheme://x/y")
    spark.range(3).write.parquet(str(tmp_path / "t"))
    remove(spark, str(tmp_path / "t"))
    remove(spark, str(tmp_path / "t"))
    assert stored_or_none(spark, str(tmp_path / "t")) is None

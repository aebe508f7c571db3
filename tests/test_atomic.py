"""The atomic sink: a job that fails on purpose, tasks that write nothing, and readers of the earlier table."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from dimlark.sources import atomic


def files(path):
    return sorted(os.listdir(f"{path}/data"))


def test_a_failing_job_leaves_the_earlier_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not atomic.has_table(path)
    with pytest.raises(FileNotFoundError):
        atomic.read_table(spark, path)
    atomic.write_table(spark.range(100).repartition(4), path)
    before, held = atomic.read_table(spark, path), files(path)
    broken = spark.range(1000, 3000).repartition(4).withColumn("id", F.when(F.col("id") == 2999, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        atomic.write_table(broken, path)
    assert sorted(r["id"] for r in atomic.read_table(spark, path).collect()) == list(range(100))
    assert files(path) == held, "what the failed job wrote is gone"
    atomic.write_table(spark.range(5).withColumn("more", F.lit("x")), path)
    assert atomic.read_table(spark, path).columns == ["id", "more"] and atomic.read_table(spark, path).count() == 5
    assert before.count() == 100, "a reader that began before the swap finishes"


def test_old_files_go_and_empty_tables_stay_tables(spark, tmp_path):
    path = (tmp_path / "t").as_uri()
    for n in (10, 20, 0, 7):
        atomic.write_table(spark.range(n).withColumn("text", F.lit("a\n")).repartition(3), path)
        assert atomic.read_table(spark, path).count() == n
    assert len(os.listdir(tmp_path / "t" / "manifests")) == atomic.KEPT
    named = {f for m in atomic.manifests(*atomic.opened(path)) for f in atomic.manifest(atomic.opened(path)[0], m)["files"]}
    assert set(files(tmp_path / "t")) == named
    with pytest.raises(Exception, match="replaces tables"):
        spark.range(1).write.format(atomic.FORMAT).mode("append").save(path)


def test_a_task_tried_again_counts_once(tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructType

    path = str(tmp_path / "t")
    writer = atomic.AtomicWriter(path, StructType().add("id", LongType()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["id"])

    def lost():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(lost())
    writer.commit([writer.write(iter([batch])), None])
    told = atomic.manifest(atomic.opened(path)[0], atomic.manifests(*atomic.opened(path))[-1])
    assert told["rows"] == 2 and len(told["files"]) == 1

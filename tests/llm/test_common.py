"""Slices of batches, and the shared folder."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

from tarnlake.llm import common


@pytest.mark.parametrize("texts", [[], ["a"], ["ab"] * 1200, [None, "x" * 90, "y" * 200, "", None, "z" * 99, "é" * 60], ["x" * 500] * 3])
def test_slices_are_whole_and_bounded(monkeypatch, texts):
    monkeypatch.setattr(common, "TEXT_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["i", "t"])
    parts = list(common.sliced(iter([batch])))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts and [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    for p in parts:
        size = [len((t or "").encode()) for t in p.column(1).to_pylist()]
        assert 0 < p.num_rows <= common.TEXT_ROWS and (sum(size) <= 100 or p.num_rows == 1)


def session(master, folder=None):
    context = SimpleNamespace(master=master, setCheckpointDir=lambda at: None, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default), sparkContext=context)


def test_shared_folder():
    assert common.shared_dir(session("spark://host:7077", "hdfs://all/of/us/")) == "hdfs://all/of/us"
    assert common.shared_dir(session("local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))


def test_tasks_grow_with_bytes():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key: "200"))
    assert common.task_count(spark, 10) == 200 and common.task_count(spark, 10**14) > 10**6

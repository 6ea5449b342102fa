from types import SimpleNamespace

import pytest

from veraframe.llm.common import by_place, shared_folder, whole_ids


def session(master, conf=None, checkpoint=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: checkpoint)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    assert shared_folder(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y" == shared_folder(session("yarn", None, "hdfs://x/y"))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
    assert shared_folder(session("local[4]")).startswith("file://") and shared_folder(session("local[4]")) == shared_folder(session("local[4]"))


def test_columns_by_place(spark):
    d = spark.createDataFrame([(1, 2, "x", 3)], "`a.b` int, TEXT int, text string, doc_id long")
    named, (text, other, dotted) = by_place(d, "text", "TEXT", "a.b")
    assert named.select(text, other, dotted).first() == ("x", 2, 1)
    whole_ids(d, "doc_id")
    with pytest.raises(TypeError):
        whole_ids(d, "text")

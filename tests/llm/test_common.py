from __future__ import annotations

import pytest

from orrery.llm import common as C


def test_a_sample_takes_one_text_of_each_id(spark):
    """Repeated rows neither grow the sample nor send their texts to the driver."""
    docs = spark.createDataFrame([(1, f"text {k % 3}", "en") for k in range(40)] + [(2, "b", "de"), (None, "c", "de"), (3, None, "en")], "doc_id long, text string, lang string")
    got = C.labelled_sample(docs.select("doc_id", "lang"), docs.select("doc_id", "text"), 10)
    assert sorted(got) == [("de", "b"), ("en", "text 0")]
    assert len(C.labelled_sample(docs.select("doc_id", "lang"), docs, 1)) <= 1
    assert C.labelled_sample(docs.select("doc_id", "lang").limit(0), docs, 10) == [] == C.labelled_sample(docs.select("doc_id", "lang"), docs, 0)


def test_several_labels_of_a_document_are_examples_each(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("c", 1)], "doc_id string, quality int")
    assert sorted(C.labelled_sample(labels, docs, 10)) == [(0, "x"), (1, "x")]


def test_a_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * 100, "en") for k in range(50)] + [(100, "y" * 200, "en")], "doc_id long, text string, lang string")
    got = C.labelled_sample(docs.select("doc_id", "lang"), docs, 51, max_bytes=1600)
    assert 10 <= len(got) <= 16 and all(t == "x" * 100 for _, t in got)


def test_no_folder_of_its_own_on_a_cluster():
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        C.scratch(Cluster)

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from orrery.llm import decontaminate, language_id, line_dedup, mixing, queries, simhash

from orrery.llm.common import stored

from .helpers import SCHEMA, clashing, frame, hard_rows


def test_stages_follow_one_another(spark, sf_dir):
    """Every stage works on what the one before it kept, all but the last give the columns of documents, and its decisions hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "source_mixing"]
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "source_mixing":
            assert out.columns == columns
            from orrery.llm.common import stored

            out = stored(out)
        kept = {r["doc_id"] for r in out.collect()}
        assert kept <= ids
        results[name] = (docs, out)
        docs, ids = out, kept
    before, after = results["line_dedup"]
    lines = [x.strip(" ") for r in after.collect() for x in (r["text"] or "").split("\n") if x.strip(" ")]
    assert len(lines) == len(set(lines))
    before, after = results["simhash_near_dedup"]
    assert simhash.near_duplicates(after).count() <= 0.1 * simhash.near_duplicates(before).count()
    before, after = results["decontamination"]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.contamination(before, bench).count() > 0 and decontaminate.contamination(after, bench).count() == 0
    run = {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("slot", "doc_id", "source").collect()}
    assert run == {(r["slot"], r["doc_id"], r["source"]) for r in results["source_mixing"][1].collect()}


def test_hard_tables(spark, tmp_path):
    """The whole pipeline runs over nulls, empty texts, repeated rows and an empty table."""
    rows = [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat sat on the mat with the hat", "en", "s", 34), (3, "the cat sat on the mat with the hat", "en", "s", 34)]
    for k, some in enumerate((rows, [])):
        where = f"{tmp_path}/{k}"
        spark.createDataFrame(some, SCHEMA).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(1, "a b c d e f g h")] if some else [], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        out = corpus_pipeline.run(spark, where)
        assert {r["doc_id"] for r in out.collect()} == ({3} if some else set())


def test_clashing_names_long_texts_and_ties(spark, tmp_path):
    """Every stage passes other columns on under whatever names, and a very long text, ties and repeated rows through."""
    rows = hard_rows(20)
    docs = clashing(spark, rows)
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
    kept = docs.collect()
    assert 104 in {r["doc_id"] for r in kept} and len(kept) > 10
    assert all(tuple(r)[5:] == (1, 2, 3, "x", "g", "l", 4, 5) for r in kept)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in kept}


def test_no_near_copy_is_left(spark, sf_dir):
    """The third stage keeps one of every pair within the radius, also of pairs that nothing else connects."""
    rng, rows = random.Random(4), []
    for k in range(200):
        base, other = [f"p{k}x{i}" for i in range(200)], {*rng.sample(range(200), 15)}
        rows += [(2 * k, " ".join(base), "en", "s", 1), (2 * k + 1, " ".join(f"q{k}x{i}" if i in other else w for i, w in enumerate(base)), "en", "s", 1)]
    _, prints = simhash.fingerprints(pa.array([r[1] for r in rows]))
    apart = np.bitwise_count(prints[::2] ^ prints[1::2]).sum(axis=1)
    assert (apart > 22).sum() > 50 and (apart > simhash.RADIUS).any()
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), sf_dir).collect()}
    assert kept == {2 * k for k in range(200)} | {2 * k + 1 for k in range(200) if apart[k] > simhash.RADIUS}


def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert all(m.query in queries.QUERIES.values() for m in (decontaminate, language_id, line_dedup, mixing, simhash))

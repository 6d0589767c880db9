from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orrery.llm import outliers as O
from orrery.llm import quality as Q
from orrery.llm.common import blocks

from .helpers import clashing, empty, frame, hard_rows, words


def labelled():
    t = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas()
    return t.merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id")


def test_held_out_quality():
    m = labelled()
    train, test = m[:2000], m[2000:]
    model = Q.train(list(zip(train.quality, train.text, strict=True)))
    kept = Q.scores(model, pa.array(test.text)) >= Q.THRESHOLD
    good = test.quality.to_numpy() == 1
    assert kept[good].mean() > 0.995 and (~kept[~good]).mean() > 0.9


def test_scores_are_sparse_dot_products():
    model = Q.Model(np.random.default_rng(1).normal(size=1 << Q.BITS).astype(np.float32), 0.3)
    texts = pa.array(["a b c b", "", "Hello!! hello", None, "x"])
    want = []
    for text in texts.to_pylist():
        columns = [Q.features(b)[0] for b in blocks(pa.array([text], pa.string()))][0]
        index, count = np.unique(columns, return_counts=True)
        want.append(1 / (1 + np.exp(-((model.weights[index] * count).sum() * Q.SCALE / max(1, count.sum()) + 0.3))))
    assert np.allclose(Q.scores(model, texts), want, atol=1e-5)
    assert len(Q.features(next(blocks(pa.array(["a b c"]))))[0]) == 5, "three words and two pairs"


def test_quality_hard_rows(spark):
    docs = clashing(spark, hard_rows())
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1), (0, 0, 0), (3, 7, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.classified(docs, Q.learned(docs, labels)).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert Q.classified(empty(spark), Q.learned(empty(spark), labels)).count() == 0
    unlearned = Q.classified(docs, Q.learned(docs, labels.limit(0))).collect()
    assert all(r["kept"] and r["score"] is None for r in unlearned)


def concentrated(x: np.ndarray):
    """Where concentration steps end from each start: (logarithm of the determinant, distances), all vectors in one place."""
    spread = (np.quantile(x, 0.75, axis=0, method="inverted_cdf") - np.quantile(x, 0.25, axis=0, method="inverted_cdf")) / 1.349
    ends = []
    for d in O.started(x, np.quantile(x, 0.5, axis=0, method="inverted_cdf"), spread):
        best = None
        while True:
            cut = np.argmax(np.bincount(O.bins(d), minlength=O.BINS).cumsum() >= np.ceil(len(x) * O.COVERED))
            near = x[O.bins(d) <= cut]
            p, logdet = O.fitted(len(near), near.sum(axis=0), near.T @ near)
            if best is not None and logdet >= best[0] - O.TOLERANCE:
                break
            p = np.array(p)
            d = O.squared(x, p[: O.DIM], p[O.DIM :].reshape(O.DIM, O.DIM))
            best = (logdet, d)
        ends.append(best)
    return ends


def brute(x: np.ndarray):
    """The documented distances with all vectors of a group in one place."""
    d = min(concentrated(x), key=lambda e: e[0])[1]
    median = np.argmax(np.bincount(O.bins(d), minlength=O.BINS).cumsum() >= np.ceil(len(x) * 0.5))
    return d * min(1.0, O.chi_square(0.5) / 2 ** ((median + 0.5) / O.PER_OCTAVE - 8))


@pytest.mark.parametrize("seed", range(6))
def test_steps_end_at_the_least_determinant_of_all_subsets(seed):
    """Of sixteen vectors every subset of twelve is tried: the steps find the same outliers and, but for whole bins, its determinant."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(16, O.DIM)) * 0.3 + rng.normal(size=O.DIM)
    x[12:] += rng.choice([-1, 1], size=(4, O.DIM)) * rng.uniform(4, 9, size=(4, 1))

    def logdet(rows):
        near = x[list(rows)]
        return O.fitted(len(near), near.sum(axis=0), near.T @ near)[1]

    least, subset = min((logdet(rows), rows) for rows in itertools.combinations(range(16), 12))
    ended, d = min(concentrated(x), key=lambda e: e[0])
    assert set(np.argsort(d)[:12].tolist()) == set(subset) and abs(ended - least) < 1e-6


def test_outliers_against_brute_force(spark):
    rows = [(i, words(i, 40 + i % 90) + ".\n" + words(i + 1, 30), "en", f"s{i % 2}", None) for i in range(200)]
    rows += [(1000 + i, "### $$$ " * (60 + i) + "A1 B2", "en", "s0", None) for i in range(6)] + [(2000, "HELLO " * 300, "en", "s1", None)]
    got = {r["doc_id"]: r for r in O.judged(frame(spark, rows)).collect()}
    for source in ("s0", "s1"):
        own = [r for r in rows if r[3] == source]
        want = brute(O.statistics(pa.array([r[1] for r in own])))
        assert np.allclose([got[r[0]]["distance"] for r in own], want, rtol=1e-3, atol=1e-3)
    assert not any(got[1000 + i]["kept"] for i in range(6)) and not got[2000]["kept"]
    assert sum(not r["kept"] for r in got.values()) <= 9


def test_outliers_on_labels():
    m = labelled()
    x = O.statistics(pa.array(m.text))
    good, bad = [], []
    for _, index in m.groupby(["lang"]).indices.items():
        rejected = brute(x[index]) > O.chi_square(1 - O.TAIL) * O.SLACK
        quality = m.quality.to_numpy()[index]
        good += rejected[quality == 1].tolist()
        bad += rejected[quality == 0].tolist()
    assert np.mean(good) < 0.01 and np.mean(bad) > 0.8


def test_outlier_hard_rows(spark):
    rows = hard_rows() + [(200 + i, words(i, 50), None, None, 1) for i in range(70)]
    got = O.judged(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    small = [r for r in got if r["grouped_by"] == "*"]
    assert small and all(r["kept"] and r["distance"] is None for r in small)
    assert {r["grouped_by"] for r in got} == {"*", "(none)/(none)"}
    assert O.judged(empty(spark)).count() == 0
    assert abs(O.chi_square(0.95, 1) - 3.8415) < 1e-3 and abs(O.chi_square(0.5, 7) - 6.3458) < 1e-3

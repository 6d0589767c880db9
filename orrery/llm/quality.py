"""Quality classifier (operator 4): logistic regression on hashed word n-grams, trained with FTRL.

Features are the words of a text and its runs of symbols (letters made small), alone and in pairs of neighbours, hashed
into 2**``BITS`` columns; a feature's value is its share of the text's n-grams times ``SCALE``. Training is
follow-the-regularised-leader with per-coordinate rates over at most ``sample`` labelled documents (those with the
smallest hash of doc_id; the table of labels may be of any size), ``EPOCHS`` times in a drawn order. Scoring is one sparse
dot product for each text, over the whole text.

Cases: null and empty texts have no features: their score is that of the bias alone. Null ids are scored but have no
label; rows are scored one by one, so repeated ones get equal scores; of several different labels of a document each is
an example, and of several texts of one id the first in order is used. Labels other than 0 and 1 are ignored. Without examples of both classes nothing can be learned: the score is
null and every row stays. The result has the columns below only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Block, blocks, labelled_sample, mix, table, texts_of, tokens

BITS = 18
SAMPLE = 3000
EPOCHS = 3
SCALE = 8.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
#: A document is kept if its probability of being good is at least this.
THRESHOLD = 0.35


class Model(NamedTuple):
    weights: np.ndarray  #: float32, one for each column
    bias: float


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Columns of all n-grams of a block's texts in order, and the bounds of each text in them."""
    found = tokens(block, symbols=True)
    h, count = found.hash, np.diff(found.bounds)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(len(count) + 1, np.int64)
    with np.errstate(over="ignore"):
        pairs = mix(h * np.uint64(0x9FB21C651E98DF25) + np.r_[h[1:], h[:1]])
    pairs[h == np.r_[h[1:], h[:1]]] = np.uint64(1)  # a word after itself is one feature, whatever the word
    both = np.empty(2 * len(h), np.uint64)
    both[::2], both[1::2] = h, pairs
    use = np.ones(len(both), bool)
    use[2 * found.bounds[1:][count > 0] - 1] = False  # no pair begins at a text's last token
    return (mix(both[use]) >> np.uint64(64 - BITS)).astype(np.int64), np.r_[0, np.cumsum(np.maximum(2 * count - 1, 0))]


def train(rows: list[tuple[int, str | None]], seed: int = 1, epochs: int = EPOCHS) -> Model | None:
    """FTRL-proximal over examples (label, text); None without examples of both classes."""
    rows = sorted((int(y), text or "") for y, text in rows if y in (0, 1))
    if len({y for y, _ in rows}) < 2:
        return None
    examples = []
    for y, text in rows:
        columns = [features(b)[0] for b in blocks(pa.array([text], pa.string()))]
        index, counts = np.unique(np.concatenate(columns), return_counts=True)
        examples.append((y, index, counts * (SCALE / max(1, counts.sum()))))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias
    rng = np.random.default_rng(seed)

    def weight(index: np.ndarray) -> np.ndarray:
        zi = z[index]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[index])) / ALPHA + L2)
        return np.where(np.abs(zi) > L1, w, 0.0)

    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            y, index, value = examples[k]
            index, value = np.r_[index, 1 << BITS], np.r_[value, 1.0]
            w = weight(index)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA * w
            n[index] += g * g
    w = weight(np.arange((1 << BITS) + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The probability that each text is good."""
    out = []
    for block in blocks(texts):
        columns, bounds = features(block)
        count = np.diff(bounds)
        sums = np.r_[0.0, np.cumsum(model.weights[columns], dtype=np.float64)]
        dot = (sums[bounds[1:]] - sums[bounds[:-1]]) * (SCALE / np.maximum(count, 1))
        out.append(1 / (1 + np.exp(-np.clip(dot + model.bias, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The classifier trained on a bounded sample of the labelled documents."""
    return train(labelled_sample(labels.select("doc_id", "quality").where("quality IN (0, 1)"), docs, sample))


def classified(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (rounded to 6 places) and kept for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, 1 MB

    def worker(batches):
        for batch in batches:
            if shared.value is None:
                score, kept = pa.nulls(batch.num_rows, pa.float64()), np.ones(batch.num_rows, bool)
            else:
                score = np.round(scores(shared.value, texts_of(batch)), 6)
                kept, score = score >= threshold, pa.array(score, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score, pa.array(kept, pa.bool_())], ["doc_id", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(worker, f"doc_id {kind}, score double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document of the table ``documents``, learned from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return classified(docs, learned(docs, table(spark, sf_dir, "labels")))

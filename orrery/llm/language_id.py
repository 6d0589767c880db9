"""Language identification (operator 2): a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes (capitals made small) in both directions and gives every position a probability for each
language; a document's probabilities are the means over its word bytes. It is trained in numpy, by backpropagation
through time with Adam, on at most ``sample`` labelled documents (those with the smallest hash of doc_id): each position
of a training segment should get the language of its document. A further class, ``und``, is trained on drawn strings of
symbols, digits and random letters.

Whole texts are read, in segments of ``SEGMENT`` bytes; the state starts anew in each, in either direction. Segments of
all documents of a block run side by side, longest first, so that one step is a few operations on dense arrays.

A document is rejected if its best class is ``und`` or that class's mean probability is below ``min_confidence``.

Cases: null and empty texts and texts without a word byte have no language: predicted is ``und``, confidence is 0 and they
are rejected. Null declared languages aren't trained on. Null ids are judged like others but not trained on; rows are
judged one by one, so repeated ones get equal results. Without any labelled text nothing can be learned: predicted and
confidence are null and all rows stay. The result has the columns below only; :func:`identified_only` passes all
input columns through.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import CLASS, Block, blocks, fold, labelled_sample, table, texts_of

SAMPLE = 600
HIDDEN = 16
SEGMENT = 64
STEPS = 160
BATCH = 96
MIN_CONFIDENCE = 0.3
UND = "und"
#: Bytes of text whose segments run side by side.
LOT = 1 << 17


class Net(NamedTuple):
    """Weights; the first axis of w, u and c is the direction. Gates in order: reset, update, candidate."""

    labels: list[str]
    w: np.ndarray  #: (2, 256, 3 HIDDEN) of the input byte, biases included
    u: np.ndarray  #: (2, HIDDEN, 3 HIDDEN) of the state
    c: np.ndarray  #: (2, 1, HIDDEN) added to the state's part of the candidate
    v: np.ndarray  #: (2, HIDDEN, labels)
    b: np.ndarray  #: (labels,)


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def new_net(labels: list[str], rng: np.random.Generator, hidden: int = HIDDEN) -> Net:
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    return Net(labels, draw(2, 256, 3 * hidden, by=0.3), draw(2, hidden, 3 * hidden, by=hidden**-0.5), np.zeros((2, 1, hidden), np.float32), draw(2, hidden, len(labels), by=0.3), np.zeros(len(labels), np.float32))


def gradients(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[np.ndarray, ...]]:
    """Loss and gradients (w, u, c, v, b) for segments x (time, rows) of labels y (rows); weight: of each position."""
    steps, rows = x.shape
    hidden = net.u.shape[1]
    ways = np.stack([x, x[::-1]], axis=1)  # time, direction, rows
    at = np.arange(2)[:, None]
    h = np.zeros((steps + 1, 2, rows, hidden), np.float32)
    r, z, n, s = (np.empty((steps, 2, rows, hidden), np.float32) for _ in range(4))
    for t in range(steps):
        a, g = net.w[at, ways[t]], h[t] @ net.u
        gates = _logistic(a[..., : 2 * hidden] + g[..., : 2 * hidden])
        r[t], z[t] = gates[..., :hidden], gates[..., hidden:]
        s[t] = g[..., 2 * hidden :] + net.c
        n[t] = np.tanh(a[..., 2 * hidden :] + r[t] * s[t])
        h[t + 1] = n[t] + z[t] * (h[t] - n[t])
    out = np.stack([h[1:, 0], h[:0:-1, 1]])  # direction, time, rows, hidden: both aligned to the position
    p = _softmax(out[0] @ net.v[0] + out[1] @ net.v[1] + net.b)
    total = max(float(weight.sum()), 1.0)
    loss = -float((np.log(p[:, np.arange(rows), y] + 1e-9) * weight).sum()) / total
    d = p
    d[:, np.arange(rows), y] -= 1
    d *= (weight / total)[..., None]
    flat = d.reshape(-1, d.shape[-1])
    dv = np.stack([out[k].reshape(-1, hidden).T @ flat for k in range(2)])
    db = flat.sum(axis=0)
    dout = np.stack([d @ net.v[0].T, (d @ net.v[1].T)[::-1]], axis=1)  # time, direction, rows, hidden
    dw, du, dc = np.zeros_like(net.w), np.zeros_like(net.u), np.zeros_like(net.c)
    dh = np.zeros((2, rows, hidden), np.float32)
    back = net.u.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        dh += dout[t]
        dn = dh * (1 - z[t]) * (1 - n[t] ** 2)
        dz = dh * (h[t] - n[t]) * z[t] * (1 - z[t])
        ds = dn * r[t]
        dr = dn * s[t] * r[t] * (1 - r[t])
        for k in range(2):
            np.add.at(dw[k], ways[t, k], np.concatenate([dr[k], dz[k], dn[k]], axis=-1))
        dg = np.concatenate([dr, dz, ds], axis=-1)
        du += h[t].transpose(0, 2, 1) @ dg
        dc += ds.sum(axis=1, keepdims=True)
        dh = dh * z[t] + dg @ back
    return loss, (dw, du, dc, dv, db)


def _noise(rng: np.random.Generator, count: int) -> np.ndarray:
    """Segments of class ``und``: random symbols, digits and letters, cut by blanks."""
    sets = [b"#$%&*+-/<=>@\\^_|~!?.,;:", b"0123456789", b"0123456789abcdef", bytes(range(97, 123)), bytes(range(128, 192)), bytes(range(33, 127))]
    out = np.empty((count, SEGMENT), np.uint8)
    for row in out:
        row[:] = rng.choice(np.frombuffer(sets[rng.integers(len(sets))], np.uint8), SEGMENT)
        row[rng.random(SEGMENT) < rng.choice([0.0, 0.1, 0.2])] = 32
    return fold(out.ravel()).reshape(out.shape)


def train(rows: list[tuple[str, str]], seed: int = 1, steps: int = STEPS) -> Net | None:
    """A network for labelled texts (label, text); None if no text has a word byte."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[np.ndarray]] = {}
    for label, text in sorted(rows):
        data = fold(np.frombuffer(text.encode(), np.uint8))
        if (CLASS[data] == 1).any():
            by.setdefault(label, []).append(data)
    if not by:
        return None
    labels = [*sorted(by), UND] if UND not in by else sorted(by)
    net = new_net(labels, rng)
    weights = [x.copy() for x in net[1:]]
    first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    for step in range(1, steps + 1):
        y = rng.integers(len(labels), size=BATCH)
        x = _noise(rng, BATCH)
        for i, k in enumerate(y):
            if labels[k] in by:
                texts = by[labels[k]]
                data = texts[rng.integers(len(texts))]
                if len(data) < SEGMENT:
                    data = np.resize(np.r_[data, np.uint8(32)], SEGMENT)
                start = rng.integers(len(data) - SEGMENT + 1)
                x[i] = data[start : start + SEGMENT]
        x = x.T
        weight = (CLASS[x] == 1).astype(np.float32) + (np.array([labels[k] == UND for k in y], np.float32) * 0.2)
        _, grads = gradients(Net(labels, *weights), x, y, weight)
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for value, g, m, s in zip(weights, grads, first, second, strict=True):
            g *= np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.02) * (g * g - s)
            value -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(s / np.float32(1 - 0.98**step)) + np.float32(1e-6))
    return Net(labels, *weights)


class Runner:
    """One direction of a network at work on up to ``rows`` segments: every array is dense, and made once."""

    def __init__(self, net: Net, way: int, rows: int):
        hidden = net.u.shape[1]
        half = [np.float32(0.5), np.float32(0.5), np.float32(1)]  # logistic(x) = (1 + tanh(x / 2)) / 2
        cut = lambda x, k: np.ascontiguousarray(x[way][:, k * hidden : (k + 1) * hidden] * half[k])
        self.w, self.u, self.c = [cut(net.w, k) for k in range(3)], [cut(net.u, k) for k in range(3)], net.c[way]
        self.h = np.zeros((rows, hidden), np.float32)
        self.a, self.g = (np.empty((rows, hidden), np.float32) for _ in range(2))
        self.r, self.z = (np.empty((rows, hidden), np.float32) for _ in range(2))

    def step(self, x: np.ndarray) -> np.ndarray:
        """Read the next bytes of the first len(x) segments; their states."""
        m = len(x)
        h, a, g, r, z = self.h[:m], self.a[:m], self.g[:m], self.r[:m], self.z[:m]
        for k, gate in ((0, r), (1, z)):
            np.take(self.w[k], x, axis=0, out=gate, mode="clip")
            np.matmul(h, self.u[k], out=g)
            gate += g
            np.tanh(gate, out=gate)
            gate *= np.float32(0.5)
            gate += np.float32(0.5)
        np.take(self.w[2], x, axis=0, out=a, mode="clip")
        np.matmul(h, self.u[2], out=g)
        g += self.c
        g *= r
        a += g
        np.tanh(a, out=a)
        h -= a
        h *= z
        h += a
        return h


def positions(net: Net, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a block: its summed position probabilities and its positions' label counts, over word bytes."""
    data = fold(block.data)
    k, count = len(net.labels), len(block.offsets) - 1
    sums, labelled = np.zeros((count, k)), np.zeros((count, k), np.int64)
    size = np.diff(block.offsets)
    per = -(-size // SEGMENT)
    text = np.repeat(np.arange(count), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = block.offsets[:-1][text] + nth * SEGMENT
    length = np.minimum(SEGMENT, block.offsets[1:][text] - start)
    order = np.argsort(-length, kind="stable")
    rows = max(1, min(len(order), LOT // SEGMENT))
    ahead, behind = Runner(net, 0, rows), Runner(net, 1, rows)
    heads = [np.ascontiguousarray(v.T) for v in net.v]
    padded = np.r_[data, np.zeros(SEGMENT, np.uint8)]
    for lo in range(0, len(order), LOT // SEGMENT):
        own = order[lo : lo + LOT // SEGMENT]
        x = np.ascontiguousarray(padded[start[own][:, None] + np.arange(SEGMENT)].T)
        active = np.searchsorted(-length[own], -np.arange(SEGMENT), "left")  # rows longer than t
        last = int(length[own[0]])
        word = CLASS[x] == 1
        ahead.h[:], behind.h[:] = 0, 0
        back = np.empty((last, k, len(own)), np.float32)  # classes first: sums over them are then few long additions
        for t in range(last - 1, -1, -1):
            m = active[t]
            np.matmul(heads[1], behind.step(x[t, :m]).T, out=back[t, :, :m])
        total, best = np.zeros((k, len(own)), np.float32), np.zeros((k, len(own)), np.int32)
        for t in range(last):
            m = active[t]
            p = heads[0] @ ahead.step(x[t, :m]).T
            p += back[t, :, :m]
            p += net.b[:, None]
            top = p.max(axis=0)
            mask = word[t, :m]
            best[:, :m] += (p == top) & mask
            p -= top
            np.exp(p, out=p)
            p *= mask / p.sum(axis=0)
            total[:, :m] += p
        for j in range(k):
            sums[:, j] += np.bincount(text[own], total[j], count)
            labelled[:, j] += np.bincount(text[own], best[j], count).astype(np.int64)
    return sums, labelled


def judged(net: Net, texts: pa.Array, min_confidence: float) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """predicted, confidence, label_bytes and kept of each text."""
    predicted, confidence, counted, kept = [], [], [], []
    for block in blocks(texts):
        sums, labelled = positions(net, block)
        total = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        for i, j in enumerate(best.tolist()):
            label = net.labels[j] if total[i] > 0 else UND
            share = float(sums[i, j] / total[i]) if total[i] > 0 else 0.0
            predicted.append(label)
            confidence.append(round(share, 4))
            counted.append(",".join(f"{name}:{n}" for name, n in zip(net.labels, labelled[i].tolist(), strict=True) if n))
            kept.append(label != UND and share >= min_confidence)
    return predicted, np.array(confidence), counted, np.array(kept, bool)


def learned(docs: DataFrame, sample: int = SAMPLE) -> Net | None:
    """The network trained on a bounded sample of ``docs`` with declared languages."""
    if "lang" not in docs.columns:
        return None
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    return train(labelled_sample(labelled.select("doc_id", "lang"), labelled.select("doc_id", "text"), sample))


def identified(docs: DataFrame, net: Net | None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, lang, predicted, confidence, label_bytes (``label:positions`` of the word bytes) and kept for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def worker(batches):
        for batch in batches:
            if net is None:
                rest = [pa.nulls(batch.num_rows, pa.string()), pa.nulls(batch.num_rows, pa.float64()), pa.nulls(batch.num_rows, pa.string()), pa.array(np.ones(batch.num_rows, bool))]
            else:
                predicted, confidence, counted, kept = judged(net, texts_of(batch), min_confidence)
                rest = [pa.array(predicted, pa.string()), pa.array(confidence, pa.float64()), pa.array(counted, pa.string()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.string()), *rest], ["doc_id", "lang", "predicted", "confidence", "label_bytes", "kept"])

    slim = docs.selectExpr("doc_id", "text", "lang" if "lang" in docs.columns else "CAST(NULL AS STRING) AS lang")
    return slim.mapInArrow(worker, f"doc_id {kind}, lang string, predicted string, confidence double, label_bytes string, kept boolean")


def identified_only(docs: DataFrame, net: Net | None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``docs`` (all its columns) without the documents that are rejected."""
    if net is None:
        return docs

    def worker(batches):
        for batch in batches:
            yield batch.filter(pa.array(judged(net, texts_of(batch), min_confidence)[3], pa.bool_()))

    return docs.mapInArrow(worker, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document of the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return identified(docs, learned(docs))

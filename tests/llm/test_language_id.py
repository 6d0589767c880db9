from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from orrery.llm import language_id as L
from orrery.llm.common import CLASS, blocks, fold

from .helpers import clashing, empty, hard_rows


def test_gradients_by_differences():
    """Backpropagation through time agrees with numeric differences."""
    rng = np.random.default_rng(0)
    net = L.new_net(["a", "b", "c"], rng, hidden=3)
    net = net._replace(c=rng.normal(0, 0.3, net.c.shape), b=rng.normal(0, 0.3, net.b.shape))
    x, y = rng.integers(97, 100, (7, 4)).astype(np.uint8), rng.integers(3, size=4)
    weight = rng.random((7, 4)).astype(np.float32)
    _, grads = L.gradients(net, x, y, weight)
    for k in range(5):
        value, grad = net[k + 1], grads[k]
        flat = np.flatnonzero(np.abs(grad.ravel()) > 1e-4)
        for i in rng.choice(flat, min(6, len(flat)), replace=False):
            losses = []
            for step in (1e-2, -1e-2):
                changed = value.copy()
                changed.ravel()[i] += step
                losses.append(L.gradients(net._replace(**{net._fields[k + 1]: changed}), x, y, weight)[0])
            assert abs((losses[0] - losses[1]) / 2e-2 - grad.ravel()[i]) < 2e-3 + 0.05 * abs(grad.ravel()[i])


def brute(net, text):
    """Sums of position probabilities, a byte at a time."""
    data, hidden = fold(np.frombuffer(text.encode(), np.uint8)), net.u.shape[1]
    total = np.zeros(len(net.labels))
    logistic = lambda v: 1 / (1 + np.exp(-v))
    for lo in range(0, len(data), L.SEGMENT):
        part = data[lo : lo + L.SEGMENT]
        states = []
        for way, seq in ((0, part), (1, part[::-1])):
            h, found = np.zeros(hidden), []
            for byte in seq:
                a, g = net.w[way][byte].astype(float), h @ net.u[way].astype(float)
                r, z = logistic(a[:hidden] + g[:hidden]), logistic(a[hidden : 2 * hidden] + g[hidden : 2 * hidden])
                n = np.tanh(a[2 * hidden :] + r * (g[2 * hidden :] + net.c[way][0]))
                h = n + z * (h - n)
                found.append(h)
            states.append(found if way == 0 else found[::-1])
        for byte, f, b in zip(part, *states, strict=True):
            e = f @ net.v[0] + b @ net.v[1] + net.b
            p = np.exp(e - e.max())
            if CLASS[byte] == 1:
                total += p / p.sum()
    return total


def test_positions_against_brute_force():
    net = L.new_net(["a", "b"], np.random.default_rng(3))
    texts = ["Hello World " * 20, "x", "", "é ü 123", "a" * 64, "b" * 65]
    sums = np.concatenate([L.positions(net, b)[0] for b in blocks(pa.array(texts))])
    assert np.allclose(sums, [brute(net, t) for t in texts], atol=1e-3)


def test_held_out_accuracy():
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["lang", "text"])
    rows = list(zip(t["lang"].to_pylist(), t["text"].to_pylist(), strict=True))
    net = L.train(rows[:400])
    predicted, _, _, kept = L.judged(net, pa.array([x for _, x in rows[400:]]), L.MIN_CONFIDENCE)
    assert np.mean([a == b for a, (b, _) in zip(predicted, rows[400:], strict=True)]) > 0.97
    assert kept.mean() > 0.98
    junk = ["#$%^ &*!! 8832 0x77fe", "9981 2234 8876 1123 4432", "qzxv kjwq zzxq vbnk"]
    assert not L.judged(net, pa.array(junk[:2]), L.MIN_CONFIDENCE)[3].any()


def test_hard_rows(spark):
    rows = hard_rows()
    docs = clashing(spark, rows)
    net = L.train([("en", "the cat and the dog " * 9), ("de", "der hund und die katze " * 9)], steps=20)
    got = L.identified(docs, net).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for k in (100, 101, 102, 103):
        assert (by[k]["predicted"], by[k]["confidence"], by[k]["kept"]) == ("und", 0.0, False)
    assert L.identified_only(docs, net).columns == docs.columns
    assert L.identified(empty(spark), L.learned(empty(spark))).count() == 0
    assert L.learned(empty(spark)) is None
    assert all(r["kept"] and r["predicted"] is None for r in L.identified(docs, None).collect())
    assert L.identified_only(docs, None).count() == len(rows)

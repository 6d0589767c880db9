from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import hmm as H
from orrery.llm.common import blocks, tokens

from .helpers import clashing, empty, frame, hard_rows, words


def naive(ids, lengths, model, table):
    """Plain forward-backward over whole sequences in log-free double arithmetic with scaling at every word."""
    k = len(model.start)
    counts, moves, starts, logs, at = np.zeros((len(table), k)), np.zeros((k, k)), np.zeros(k), [], 0
    for n in lengths:
        seq, alpha, scales = ids[at : at + n], [model.start], []
        at += n
        for w in seq:
            a = alpha[-1] @ model.move * table[w]
            scales.append(a.sum())
            alpha.append(a / a.sum())
        logs.append(float(np.log(scales).sum()) if len(seq) else 0.0)
        beta = np.ones(k)
        for t in range(len(seq) - 1, -1, -1):
            gamma = alpha[t + 1] * beta
            counts[seq[t]] += gamma / gamma.sum()
            xi = alpha[t][:, None] * model.move * (table[seq[t]] * beta)[None, :]
            moves += xi / xi.sum()
            beta = model.move @ (table[seq[t]] * beta)
            beta /= beta.sum()
        if len(seq):
            post = model.start * beta
            starts += post / post.sum()
    return counts, moves, starts, logs


def random_model(rng, k, v):
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return H.Model(norm(rng.random(k)), norm(rng.random((k, k))), np.ones(k), np.ones(k), v), norm(rng.random((k, v))).T


def test_against_all_paths():
    """The forward recursion is the sum over all state paths."""
    rng = np.random.default_rng(2)
    model, table = random_model(rng, 3, 5)
    ids = rng.integers(5, size=6)
    total = 0.0
    for path in itertools.product(range(3), repeat=7):
        p = model.start[path[0]]
        for t in range(6):
            p *= model.move[path[t], path[t + 1]] * table[ids[t], path[t + 1]]
        total += p
    s = H.sequences(ids, np.array([6]))
    assert np.allclose(H.forward(s, model, *H._products(s, model, table))[0], np.log(total))


@pytest.mark.parametrize("lengths", [[5, 0, 200, 64, 65, 1, 700], [0, 0], []])
def test_segments_against_plain_recursion(lengths):
    rng = np.random.default_rng(1)
    model, table = random_model(rng, 4, 30)
    lengths = np.array(lengths, np.int64)
    ids = rng.integers(30, size=int(lengths.sum()))
    s = H.sequences(ids, lengths)
    logs, _ = H.forward(s, model, *H._products(s, model, table))
    counts, moves, starts, total = H.expected(s, model, table)
    want = naive(ids, lengths, model, table)
    assert np.allclose(logs, want[3]) and np.isclose(total, sum(want[3]))
    for got, expected in zip((counts, moves, starts), want[:3], strict=True):
        assert np.allclose(got, expected, atol=1e-6)


def brute(texts, states=H.STATES, iterations=H.ITERATIONS):
    """Training and scoring of a whole small corpus in one place."""
    hashes = [np.concatenate([tokens(b, symbols=True).hash for b in blocks(pa.array([t or ""]))] or [np.zeros(0, np.uint64)]) for t in texts]
    lengths = np.array([len(h) for h in hashes])
    vocabulary, ids, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    known = counts > 1
    sums = H.tilt(vocabulary.view(np.int64), states) * counts[:, None]
    start, move = H.initial(states)
    emit = np.where(known[:, None], sums, 0)
    model = H.Model(start, move, sums.sum(axis=0), sums[~known].sum(axis=0), int(known.sum()) + 1)
    for _ in range(iterations):
        c, m, s, _ = naive(ids, lengths, model, H.emissions(model, emit))
        model = H.Model((s + 1e-3) / (s.sum() + states * 1e-3), (m + 1e-3) / (m.sum(axis=1, keepdims=True) + states * 1e-3), c.sum(axis=0), c[~known].sum(axis=0), model.vocabulary)
        emit = np.where(known[:, None], c, 0)
    return naive(ids, lengths, model, H.emissions(model, emit))[3], lengths


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 2000)  # several chunks in a task
    rows = [(i, words(i, 10 + i, 80) + f" once{i}", "en", "s", 1) for i in range(60)]
    got = {r["doc_id"]: r for r in H.scored(frame(spark, rows)).collect()}
    want, lengths = brute([r[1] for r in rows])
    assert np.allclose([got[r[0]]["log_likelihood"] for r in rows], want, rtol=1e-4)
    assert [got[r[0]]["n_tokens"] for r in rows] == lengths.tolist() and all(got[i]["n_unknown"] >= 1 for i in range(60))


def test_training_raises_the_likelihood(spark):
    rows = [(i, " ".join(["a b c d"] * 10 + ["x y z"] * 10), "en", "s", 1) for i in range(20)]
    total = [sum(r["log_likelihood"] for r in H.scored(frame(spark, rows), iterations=k).collect()) for k in (0, 1, 3)]
    assert total[0] < total[1] < total[2]


def test_the_query_trains_until_it_has_settled(spark, tmp_path):
    rows = [(i, " ".join(["a b c d"] * 10 + ["x y z"] * 10), "en", "s", 1) for i in range(20)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    few, whole = ([r["log_likelihood"] / r["n_tokens"] for r in df.collect()] for df in (H.scored(frame(spark, rows)), H.query(spark, str(tmp_path))))
    assert np.mean(whole) > np.mean(few) + 0.1
    # Ten rounds more hardly help.
    model_rounds = [np.sum(brute([rows[0][1]] * 20, iterations=k)[0]) / (20 * 70) for k in (40, 50)]
    assert np.mean(whole) > model_rounds[0] - 0.05 and model_rounds[1] - model_rounds[0] < 0.05


def test_slow_start_is_not_settled():
    start = [-7.1143, -7.0996, -7.0991, -7.0983, -7.0968]  # gains that fall under the tolerance and grow again
    assert not any(H.settled(start[:k], 1e-3) for k in range(6))
    assert H.settled([-6.4124, -6.4118, -6.4113], 1e-3) and not H.settled([-6.5515, -6.4960, -6.4955], 1e-3)


def test_hard_rows(spark):
    rows = hard_rows()
    got = H.scored(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["log_likelihood"] == 0 and r["perplexity"] is None for r in got if r["doc_id"] in (100, 101, 102))
    assert len({r["log_likelihood"] for r in got if r["doc_id"] == 0}) == 1
    assert H.scored(empty(spark)).count() == 0


@pytest.mark.parametrize("segment", [1, 7, 64])
def test_texts_of_many_segments_against_plain_recursion(monkeypatch, segment):
    monkeypatch.setattr(H, "SEGMENT", segment)
    monkeypatch.setattr(H, "LOT", 150)
    rng = np.random.default_rng(3)
    model, table = random_model(rng, 4, 30)
    table[:, 1] *= 1e-6  # states far apart
    lengths = np.array([5, 0, 200, 64, 65, 1, 700, 8, 7])
    ids = rng.integers(30, size=int(lengths.sum()))
    s = H.sequences(ids, lengths)
    counts, moves, starts, logs = naive(ids, lengths, model, table)
    got = H.expected(s, model, table)
    assert np.allclose(H.likelihoods(s, model, table), logs) and np.isclose(got[3], sum(logs))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(got[:3], (counts, moves, starts), strict=True))


def test_products_only_where_texts_go_on(monkeypatch):
    """Texts of one segment need no product, first and last segments carry one vector, and scoring needs nothing of last ones."""
    monkeypatch.setattr(H, "SEGMENT", 10)
    work, step = [], np.matmul
    monkeypatch.setattr(H.np, "matmul", lambda a, b, **rest: (work.append(b.size // 4), step(a, b, **rest))[1])
    model, table = random_model(np.random.default_rng(4), 4, 30)
    lengths = np.array([10, 25, 7, 13, 0])
    s = H.sequences(np.random.default_rng(5).integers(30, size=int(lengths.sum())), lengths)
    H.likelihoods(s, model, table)
    assert sum(work) == 55 + 2 * 10 + 4 * 10  # every word once, two first segments, the inner one as a product
    work.clear()
    H.expected(s, model, table)
    assert sum(work) == 2 * 55 + 2 * 10 + 4 * 10 + 5 + 3  # there and back, and back once through the two last segments


@pytest.mark.parametrize("segment", [13, 4096])
def test_states_that_hardly_change_and_words_of_one_state(monkeypatch, segment):
    """Probabilities down to 1e-12, so that the recursions are far from even between two scalings; inputs stay as they were."""
    monkeypatch.setattr(H, "SEGMENT", segment)
    rng = np.random.default_rng(7)
    move = np.full((4, 4), 1e-11) + np.eye(4)
    model = H.Model(np.full(4, 0.25), move / move.sum(axis=1, keepdims=True), np.ones(4), np.ones(4), 30)
    table = np.where(rng.random((30, 4)) < 0.4, 1.0, 1e-12) * rng.random((30, 4))
    lengths = np.array([300, 1, 12, 13, 14, 90])
    ids = rng.integers(30, size=int(lengths.sum()))
    s, kept = H.sequences(ids, lengths), table.copy()
    counts, moves, starts, logs = naive(ids, lengths, model, table)
    for given in (table, np.asfortranarray(table)):
        got = H.expected(s, model, given)
        assert np.allclose(H.likelihoods(s, model, given), logs, rtol=1e-9) and np.isclose(got[3], sum(logs), rtol=1e-9)
        assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(got[:3], (counts, moves, starts), strict=True))
        assert (given == kept).all()


def test_bundles_give_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 300)
    rows = [(i, words(i, 10 + i, 80) + f" once{i}", "en", "s", 1) for i in range(60)]
    alone = sorted(map(tuple, H.scored(frame(spark, rows)).collect()))
    monkeypatch.setattr(H, "_bundled", lambda docs: 3)
    for a, b in zip(alone, sorted(map(tuple, H.scored(frame(spark, rows)).collect())), strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-4)


def test_nothing_is_left_behind(spark):
    H.scored(frame(spark, [(1, "a b a b", "en", "s", 1)])).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("orrery_chunks")]


@pytest.mark.parametrize("shards", [1, 51, 70_000])
def test_bundles_and_messages_keep_every_word_in_its_place(shards):
    rng = np.random.default_rng(6)
    words_ = rng.integers(-(2**63), 2**63 - 1, 3000)
    local = [rng.permutation(words_)[:n] for n in (2000, 0, 2500)]
    ids = rng.integers(1 << 26, size=500)
    assert (H._unpack(H._pack(ids), 500) == ids).all() and len(H._unpack(H._pack(ids[:0]), 0)) == 0
    asked = np.unique(local[0])
    messages = H._messages(3, asked, np.stack([asked % 1000] * 4, axis=1).astype(np.float32), shards)
    assert sorted(np.concatenate([np.frombuffer(m[2], np.int64) for m in messages])) == sorted(asked) and len({m[0] for m in messages}) == len(messages)
    left = pa.table({"words": pa.array([w.tobytes() for w in local], pa.binary()), "lengths": pa.array([b""] * 3, pa.binary()), "ids": pa.array([b""] * 3, pa.binary())})
    bundle = H._opened(left, pa.table({"words": pa.array([m[2] for m in messages], pa.binary()), "sums": pa.array([m[3] for m in messages], pa.binary())}), 4)
    assert all((bundle.words[place] == w).all() and len(place) == len(w) for place, w in zip(bundle.places, local, strict=True))
    assert (bundle.known[:, 0] == np.where(np.isin(bundle.words, asked), bundle.words % 1000, 0)).all()

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orrery.llm import simhash as S

from .helpers import clashing, empty, frame, hard_rows, words


def distance(a, b):
    return int(np.unpackbits((a ^ b).view(np.uint8)).sum())


def test_variants_meet():
    """Words within two bits share a variant; words at three don't."""
    rng = np.random.default_rng(0)
    for _ in range(50):
        w = rng.integers(0, 2**32, dtype=np.uint32)
        for bits in (0, 1, 2, 3):
            other = w
            for b in rng.choice(32, bits, replace=False):
                other ^= np.uint32(1) << np.uint32(b)
            meet = set(S.variants(np.array([w]))[0].tolist()) & set(S.variants(np.array([other]))[0].tolist())
            assert bool(meet) == (bits <= 2)


def test_recall_against_brute_force(spark):
    """At least 0.9 of all pairs within the radius end in one group."""
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    texts = t["text"].to_pylist()
    index, prints = S.fingerprints(t["text"].combine_chunks())
    ids = np.array(t["doc_id"].to_pylist())[index]
    near = []
    bits = np.unpackbits(prints.view(np.uint8), axis=1).astype(np.int16)
    for i in range(len(bits)):
        d = np.abs(bits[i + 1 :] - bits[i]).sum(axis=1)
        near += [(int(ids[i]), int(ids[i + 1 + j])) for j in np.flatnonzero(d <= S.RADIUS)]
    assert len(near) > 50 and len(texts) == 1000
    found = S.near_duplicates(frame(spark, list(zip(*(t[c].to_pylist() for c in ("doc_id", "text", "lang", "source", "n_chars")), strict=True)))).collect()
    group = {r["doc_id"]: r["kept_doc_id"] for r in found}
    of = lambda d: group.get(d, d)
    assert np.mean([of(a) == of(b) for a, b in near]) >= 0.9
    linked = {x for p in near for x in p}
    assert all(d in linked for d in group), "only near copies go"


def test_groups_of_copies(spark):
    rng = random.Random(5)
    base = words(1, 300, 5000).split()
    rows = [(7, " ".join(base), "en", "s", 1)]
    for k in range(30):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(300)] = f"z{rng.randrange(9999)}"
        rows.append((20 + k, " ".join(copy), "en", "s", 1))
    rows += [(100 + k, words(500 + k, 200, 5000), "en", "s", 1) for k in range(10)]
    got = S.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == set(range(20, 50)) and {r["kept_doc_id"] for r in got} == {7} and {r["group_size"] for r in got} == {31}
    assert {r["doc_id"] for r in S.deduplicated(frame(spark, rows)).collect()} == {7, *range(100, 110)}


def test_hard_rows(spark):
    rows = hard_rows()
    out = S.deduplicated(clashing(spark, rows))
    assert out.columns == clashing(spark, rows).columns
    assert out.count() == len(rows), "rows of one id stay together; null ids and texts without a word stay"
    assert S.near_duplicates(empty(spark)).count() == 0
    assert S.deduplicated(empty(spark)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 6), (9, 8), (8, 7), (7, 6)]
    got = {r["v"]: r["label"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}


def test_fingerprint_is_the_sign_of_sums():
    text = words(3, 700, 600)
    from orrery.llm.common import blocks, mix, tokens

    block = next(blocks(pa.array([text])))
    own = np.unique(tokens(block).hash >> np.uint64(24))
    total = np.zeros(192, int)
    for w in own:
        lanes = np.array([mix(np.array([w + np.uint64((k + 1) << 44)], np.uint64))[0] for k in range(3)])
        total += np.unpackbits(lanes.view(np.uint8)).astype(int) * 2 - 1
    assert (np.packbits(total > 0).view(np.uint32) == S.fingerprints(pa.array([text]))[1][0]).all()
    assert len(list(itertools.islice(own, 2))) == 2


def at_distances(rng, bits: list[int], of: int = 192) -> np.ndarray:
    """Pairs of fingerprints, one after the other, that differ in so many bits, spread evenly over all words."""
    out = []
    for n in bits:
        a = rng.integers(0, 2, of, dtype=np.uint8)
        b = a.copy()
        for word in range(6):
            b[word * 32 + rng.choice(32, n // 6 + (word < n % 6), replace=False)] ^= 1
        out += [a, b]
    return np.packbits(np.array(out), axis=1).view(np.int64)


def points_of(spark, prints):
    return spark.createDataFrame([(int(k), *map(int, p)) for k, p in enumerate(prints)], "fp long, f0 long, f1 long, f2 long")


@pytest.mark.parametrize("group", [S.GROUP, 100])
def test_every_pair_within_the_radius(spark, monkeypatch, group):
    """Isolated pairs that differ in 18 to 30 bits are one class, those at 31 aren't; in one group of points and in several."""
    monkeypatch.setattr(S, "GROUP", group)
    bits = [18, 20, 22, 24, 25, 26, 27, 28, 29, 30] * 20 + [31, 32] * 20
    prints = at_distances(np.random.default_rng(1), bits)
    got = {r["fp"]: r["label"] for r in S.classified(points_of(spark, prints)).collect()}
    assert len(got) == len(prints) and [got[2 * k] == got[2 * k + 1] for k in range(len(bits))] == [b <= S.RADIUS for b in bits]
    assert len(set(got.values())) == len(prints) - sum(b <= S.RADIUS for b in bits)


def test_groups_are_those_of_all_pairs(spark):
    """Documents are grouped just as the components of all pairs within the radius."""
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    index, prints = S.fingerprints(t["text"].combine_chunks())
    bits = np.unpackbits(prints.view(np.uint8), axis=1).astype(np.float32)
    label, ids = np.arange(len(bits)), np.array(t["doc_id"].to_pylist())[index]
    same = bits @ bits.T + (1 - bits) @ (1 - bits.T) >= 192 - S.RADIUS
    while ((least := np.where(same, label, len(bits)).min(axis=1)) != label).any():
        label = least
    first = {}
    for k in np.argsort(ids):
        first.setdefault(label[k], int(ids[k]))
    want = {int(d): first[x] for d, x in zip(ids, label, strict=True) if d != first[x]}
    assert {r["doc_id"]: r["kept_doc_id"] for r in S.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()} == want


def test_isolated_copies_near_the_radius(spark):
    """Copies with a tenth of their words changed, which no other document connects, are found without exception."""
    rng, rows = random.Random(8), []
    for k in range(400):
        base, other = [f"p{k}x{i}" for i in range(200)], {*rng.sample(range(200), 18)}
        copy = [f"q{k}x{i}" if i in other else w for i, w in enumerate(base)] if k % 2 else [*base[: -rng.randrange(8, 22)], f"q{k}"]
        rows += [(2 * k, " ".join(base), "en", "s", 1), (2 * k + 1, " ".join(copy), "en", "s", 1)]
    _, prints = S.fingerprints(pa.array([r[1] for r in rows]))
    near = [k for k in range(400) if distance(prints[2 * k], prints[2 * k + 1]) <= S.RADIUS]
    assert sum(distance(prints[2 * k], prints[2 * k + 1]) > 24 for k in near) > 50
    assert {(r["doc_id"], r["kept_doc_id"], r["group_size"]) for r in S.near_duplicates(frame(spark, rows)).collect()} == {(2 * k + 1, 2 * k, 2) for k in near}


def test_crowds_and_several_groups_are_searched_whole(monkeypatch):
    """The search finds what comparing all pairs finds: with large classes, equal keys, small tiles and two groups."""
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2, (30, 192), dtype=np.uint8)
    bits = np.repeat(centres, 40, axis=0) ^ (rng.random((1200, 192)) < rng.uniform(0.02, 0.12, (1200, 1)))
    prints = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
    apart = np.bitwise_count((prints[:, None] ^ prints[None]).view(np.uint64)).sum(axis=2)
    monkeypatch.setattr(S, "TILE", 50)
    monkeypatch.setattr(S, "CROWD", 5)
    for radius in (0, 7, 30):
        want = S.Classes(len(prints))
        want.join(*np.nonzero(apart <= radius))
        of = rng.permutation(len(prints))
        whole, halves = S.Classes(len(prints)), S.Classes(len(prints))
        keys = list(range(S.KEYS))
        S.linked(prints, None, of, None, keys, radius, whole)
        for a, b in ((slice(0, 500), None), (slice(500, None), None), (slice(0, 500), slice(500, None))):
            S.linked(prints[a], prints[b] if b else None, of[a], of[b] if b else None, keys, radius, halves)
        for got in (whole, halves):
            assert len(got.links) == len(want.links)
            assert len({(want.find(k), got.find(int(of[k]))) for k in range(len(prints))}) == len(prints) - len(want.links)


def test_reaches_leave_no_pair_out():
    for radius in (0, 5, 11, 12, 30, 40):
        assert sum(r + 1 for r in S.reaches(radius)) == radius + 1
    assert len(S.masks(2)) == 137 and len(S.masks(1)) == 17 and len(S.masks(2, 5)) == 16 and len(S.masks(1, 0)) == 1

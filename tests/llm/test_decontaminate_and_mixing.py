from __future__ import annotations

import math
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from orrery.llm import decontaminate as D
from orrery.llm import mixing as M
from orrery.llm.common import blocks

from .helpers import clashing, empty, frame, hard_rows, words

BENCH = [(1, "The quick brown Fox jumps over the lazy dog near the river bank"), (2, "short but four"), (3, "one two three four five"), (4, None), (None, "alpha beta gamma delta epsilon zeta eta theta")]


def normal(text):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]


def brute(text, bench, n=D.WINDOW):
    w, spots, items = normal(text), set(), set()
    for item, b in bench:
        b = normal(b)
        if len(b) >= D.MIN_WORDS:
            k = min(n, len(b))
            grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    spots.add((i, i + k))
                    items.add(item)
    covered = {p for a, b in spots for p in range(a, b)}
    return len(spots), len(covered), sorted(items, key=lambda x: (x is None, x))


DOCS = [
    (1, "intro words here. the QUICK brown fox jumps, over the lazy dog! and then more words " + words(1, 40), "en", "s", 1), (2, "the quick brown fox jumps over the big cat", "en", "s", 1),
    (3, "say one two three four five now " + words(2, 30), "en", "s", 1), (4, "short but four", "en", "s", 1), (5, BENCH[0][1], "en", "s", 1), (6, words(3, 50), "en", "s", 1), (7, BENCH[4][1], "en", "s", 1),
]


@pytest.mark.parametrize("limit", [D.MAX_BENCHMARK_BYTES, 20])
def test_contamination_against_brute_force(spark, monkeypatch, limit):
    """One hash set, and a benchmark in several parts."""
    monkeypatch.setattr(D, "MAX_BENCHMARK_BYTES", limit)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r["doc_id"]: (r["n_windows"], r["hit_words"], [None if x == D.NO_ITEM else int(x) for x in r["items"].split(",")]) for r in D.contamination(frame(spark, DOCS), bench).collect()}
    want = {d[0]: brute(d[1], BENCH) for d in DOCS}
    assert got == {k: v for k, v in want.items() if v[0]}
    assert set(got) == {1, 3, 5, 7}


def test_spans_go_and_the_rest_stays(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = {r["doc_id"]: r for r in D.decontaminated(frame(spark, DOCS), bench).collect()}
    assert set(out) == {1, 2, 3, 4, 6}
    assert out[1]["text"].startswith("intro words here. ") and "brown" not in out[1]["text"] and out[1]["text"].endswith(words(1, 40)) and out[1]["n_chars"] == len(out[1]["text"])
    assert all(out[k]["text"] == dict((d[0], d[1]) for d in DOCS)[k] for k in (2, 4, 6))


def test_removal_leaves_no_new_hit():
    sets = D.gram_set([(1, "a b c d"), (2, "x y z w v")])
    assert D.clean("p a x y z w v b c d q", sets).split() == ["p", "q"]


def test_item_ids_of_any_type(spark):
    bench = spark.createDataFrame([("set/b", BENCH[0][1]), ("set/a", BENCH[0][1]), (None, BENCH[2][1])], "item_id string, text string")
    assert {r["doc_id"]: r["items"] for r in D.contamination(frame(spark, DOCS), bench).collect()} == {1: "set/a,set/b", 3: "(none)", 5: "set/a,set/b"}


def test_long_items_in_pieces_find_the_same(spark, monkeypatch):
    """Pieces, parts and held texts give what one set gives."""
    long = words(70, 600, 5000)
    bench = spark.createDataFrame([(1, long), (2, words(71, 300, 5000)), (3, BENCH[2][1])], "item_id int, text string")
    w = long.split()
    rows = [(i, " ".join(["x y", *w[7 * i : 7 * i + 12], "z"]), "en", "s", 1) for i in range(80)] + [(100, BENCH[2][1], "en", "s", 1), (101, long, "en", "s", 1)]
    whole = sorted(map(tuple, D.contamination(frame(spark, rows), bench).collect()))
    kept = sorted(map(tuple, D.decontaminated(frame(spark, rows), bench).collect()))
    assert len(whole) == len(rows) and len(kept) < len(rows)
    for name, value in (("PIECE", 200), ("MAX_BENCHMARK_BYTES", 500), ("HELD", 3000)):
        monkeypatch.setattr(D, name, value)
    assert sorted(map(tuple, D.contamination(frame(spark, rows), bench).collect())) == whole
    assert sorted(map(tuple, D.decontaminated(frame(spark, rows), bench).collect())) == kept


def test_decontaminate_hard_rows(spark):
    docs, bench = clashing(spark, hard_rows()), spark.createDataFrame(BENCH, "item_id long, text string")
    assert D.decontaminated(docs, bench).columns == docs.columns and D.decontaminated(docs, bench).count() == len(hard_rows())
    assert D.contamination(docs, bench.limit(0)).count() == 0 and D.contamination(empty(spark), bench).count() == 0


def schedule(rows, weights=None, size=50):
    """The documented schedule, one document at a time."""
    import hashlib

    texts = {}
    for doc_id, text, _, source, _ in rows:
        texts.setdefault((source or M.NO_SOURCE, doc_id, text), []).append(len(re.findall(r"\S+", text or "")))
    placed = {}
    for source in sorted({k[0] for k in texts}):
        own = sorted((k for k in texts if k[0] == source), key=lambda k: hashlib.md5(("" if k[1] is None else str(k[1])).encode()).hexdigest())
        at = 0
        for k in own:
            placed[k] = (at // size, at % size)
            at += sum(texts[k])
        placed[source] = at
    totals = {s: placed[s] for s in placed if isinstance(s, str) and placed[s]}
    weights = {s: (math.isqrt(t) if weights is None else weights.get(s, 0)) for s, t in totals.items()}
    weights = {s: w for s, w in weights.items() if w}
    blocks_of = {s: 1 + max(b for k, (b, _) in ((k, v) for k, v in placed.items() if isinstance(k, tuple)) if k[0] == s) for s in weights}
    total = sum(weights.values())
    slots = min((math.floor(blocks_of[s] * total / w) for s, w in weights.items()), default=0)
    out, rank = set(), dict.fromkeys(weights, 0)
    for i in range(slots):
        u, lo = (i * 0.6180339887498949 - math.floor(i * 0.6180339887498949)) * total, 0
        for s in sorted(weights):
            if lo <= u < lo + weights[s]:
                b = rank[s]
                rank[s] += 1
                if b < blocks_of[s]:
                    out |= {(i, k[1], k[2], s, b) for k, v in placed.items() if isinstance(k, tuple) and k[0] == s and v[0] == b}
            lo += weights[s]
    return out


@pytest.mark.parametrize("weights", [None, {"s0": 3, "s1": 1}])
def test_schedule_against_brute_force(spark, weights):
    rows = [(i, words(i, 5 + i % 40), "en", f"s{i % 3}", 1) for i in range(300)]
    got = M.mixed(frame(spark, rows), weights, block_tokens=50).collect()
    assert {(r["slot"], r["doc_id"], r["text"], r["source"], r["block"]) for r in got} == schedule(rows, weights)
    if weights:
        share = sum(r["n_tokens"] for r in got if r["source"] == "s0") / sum(r["n_tokens"] for r in got)
        assert abs(share - 0.75) < 0.05 and not any(r["source"] == "s2" for r in got)


def test_pipeline_mixing_leaves_nothing_out(spark):
    """A source of one short document doesn't end the schedule: the other blocks all come, and its own come again."""
    rows = [(i, words(i, 400), "en", f"s{i % 3 % 2}", 1) for i in range(300)] + [(1000, words(1000, 40), "en", "tiny", 1)]
    got = corpus_pipeline.mix_sources(spark, frame(spark, rows), "").collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    tiny, others = [r for r in got if r["source"] == "tiny"], [r for r in got if r["source"] != "tiny"]
    assert sorted(r["epoch"] for r in tiny) == list(range(len(tiny)))
    assert len({(r["doc_id"], r["epoch"]) for r in others}) == len(others)
    first = {(r["source"], r["block"]): r["slot"] for r in got if r["epoch"] == 0}
    assert max(first.values()) == max(r["slot"] for r in got)


@pytest.mark.parametrize("weights", [None, {"s0": 3, "s1": 1}])
def test_whole_schedule_begins_as_the_short_one_does(spark, weights):
    rows = [(i, words(i, 5 + i % 40), "en", f"s{i % 3}", 1) for i in range(300)]
    short, whole = (M.mixed(frame(spark, rows), weights, block_tokens=50, max_epochs=k).collect() for k in (1, None))
    assert {tuple(r) for r in short} <= {tuple(r) for r in whole}
    assert {r["doc_id"] for r in whole} == {r[0] for r in rows if weights is None or r[3] in weights}


def test_mixing_hard_rows(spark):
    rows = hard_rows()
    out = M.mixed(clashing(spark, rows), block_tokens=100)
    assert {(r["doc_id"], r["source"]) for r in out.collect()} <= {(r[0], r[3] or M.NO_SOURCE) for r in rows}
    assert M.mixed(empty(spark)).count() == 0


def test_words_are_found_across_blocks():
    texts = pa.array([None, "a b", "", "C-d é1"])
    assert [len(b.offsets) - 1 for b in blocks(texts, 4)] == [2, 2] or sum(len(b.offsets) - 1 for b in blocks(texts, 4)) == 4


def test_a_document_under_two_sources_is_one_of_each(spark):
    rows = [(1, "a b c", "en", s, 1) for s in ("x", "y")] + [(2, "d", "en", "x", 1)] * 2
    got = M.mixed(frame(spark, rows), max_epochs=None).collect()
    first = sorted((r["doc_id"], r["source"]) for r in got if r["epoch"] == 0)
    assert first == [(1, "x"), (1, "y"), (2, "x"), (2, "x")]


def test_ranks_run_on_over_ranges_of_slots(spark, monkeypatch):
    rows = [(i, words(i, 5 + i % 40), "en", f"s{i % 3}", 1) for i in range(300)]
    whole = sorted(map(tuple, M.mixed(frame(spark, rows), block_tokens=50, max_epochs=None).collect()))
    monkeypatch.setattr(M, "SLOT_RANGE", 7)
    assert sorted(map(tuple, M.mixed(frame(spark, rows), block_tokens=50, max_epochs=None).collect())) == whole


def test_points_are_those_of_the_golden_ratio():
    assert abs(M.GOLDEN / 2**64 - 0.6180339887498949) < 1e-15
    assert all(abs(i * M.GOLDEN % 2**64 / 2**64 - i * 0.6180339887498949 % 1) < 1e-9 for i in range(100_000))

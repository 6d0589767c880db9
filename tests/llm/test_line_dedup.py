from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import line_dedup as D
from orrery.llm.common import blocks

from .helpers import clashing, empty, frame, hard_rows


def brute(rows):
    """The documented result, one line at a time."""
    seen, cut, order = {}, set(), []
    for doc_id, text in {(r[0], r[1] or "") for r in rows}:
        order += [((doc_id is not None, doc_id), text, pos, line.strip(" ")) for pos, line in enumerate(text.split("\n"))]
    for key, text, pos, line in sorted(order, key=lambda o: (o[0][0], o[0][1] or 0, o[1], o[2])):
        if line:
            if line in seen:
                cut.add((key[1], text, pos))
            seen[line] = True
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        gone = [p for p in range(len(lines)) if (r[0], r[1] or "", p) in cut]
        kept = [x for p, x in enumerate(lines) if p not in gone]
        if not gone:
            out.append((r[0], r[1]))
        elif any(x.strip(" ") for x in kept):
            out.append((r[0], "\n".join(kept)))
    return sorted(out, key=repr)


ROWS = [(1, "a\nb\nc", "en", "s", 5), (2, "b\n x \nd", "en", "s", 8), (3, "x\nb", "en", "s", 3), (4, "q\nq\nr\n", "en", "s", 6), (5, "", None, None, 0), (6, None, "en", "s", None), (7, " a ", "en", "s", 3)]


def test_lines_of_a_block():
    texts = pa.array(["a b\n  c  \n", "", "\n\nd", " \n ", None, "é\nz"])
    found = [(b.first + int(t), int(p), b.data[s:e].tobytes().decode()) for b in blocks(texts) for t, p, s, e in zip(*D.lines_of(b)[:4], strict=True)]
    assert found == [(0, 0, "a b"), (0, 1, "c"), (2, 2, "d"), (5, 0, "é"), (5, 1, "z")]


@pytest.mark.parametrize("limit", [D.MAX_BROADCAST, 0])
def test_brute_force(spark, limit):
    """Both ways to look filters up give the documented rows."""
    got = sorted(((r["doc_id"], r["text"]) for r in D.deduplicated(frame(spark, ROWS), limit).collect()), key=repr)
    assert got == brute(ROWS)


def test_hard_rows(spark):
    rows = hard_rows()
    out = D.deduplicated(clashing(spark, rows))
    assert out.columns == clashing(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == brute(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in D.deduplicated(clashing(spark, rows), 0).collect()), key=repr) == brute(rows)
    assert D.deduplicated(empty(spark)).count() == 0 == D.deduplicated(empty(spark), -1).count()


@pytest.mark.parametrize("limit", [D.MAX_BROADCAST, 0])
def test_internal_names_in_the_input(spark, limit):
    """Columns of any names pass through, the operator's own among them."""
    names = ["doc_id", "text", "row", "row2", "cut", "lines", "kept", "pos", "line", "c0", "c1", "__cut", "__row", "n_chars"]
    df = spark.createDataFrame([(1, "a\nb", *range(12)), (2, "b\nc", *range(12))], ["doc_id", "text", *names[2:]])
    got = D.deduplicated(df, limit)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb", *range(12)), (2, "c", *range(11), 1)]


def test_large_filters_and_many_shards(spark, monkeypatch):
    """Places sent in several messages, long texts and one line in a third of all rows: as by broadcast, and as line by line."""
    monkeypatch.setattr(D, "GATHERED", 50)
    rows = [(i, "\n".join(f"line {(i * 7 + k * k) % 97}" for k in range(5)) + ("\nhot" if i % 3 == 0 else ""), "en", "s", 1) for i in range(120)]
    rows += [(500, "\n".join(f"line {k % 301}" for k in range(20_000)), "en", "s", 1)]
    for limit in (0, D.MAX_BROADCAST):
        got = sorted(((r["doc_id"], r["text"]) for r in D.deduplicated(frame(spark, rows), limit).collect()), key=repr)
        assert got == brute(rows)


def test_every_repeat_is_in_the_filter():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 5000)
    size, bits = D.twice_seen([a, np.r_[b, a[:100]]], [b[:50]])
    packed = np.frombuffer(bits, np.uint8)
    assert D.in_filter(a[:100], size, packed).all() and D.in_filter(b[:50], size, packed).all()
    assert D.in_filter(a[100:], size, packed).mean() < 0.05

"""Language-model scoring with a hidden Markov model over words (operator 10).

Symbols are the words of a text and its runs of symbols (letters made small). Every word that occurs at least twice in
the corpus is a symbol of its own; all others are one symbol, the unknown word. The vocabulary and its counts grow with
the corpus and are never on one machine: they lie in shards of the hash space.

1. Texts are encoded once, in chunks of about ``CHUNK`` bytes: local word numbers, and the hashes of the local words. Up
   to ``BUNDLED`` chunks of a task form a bundle, as many as leave each partition of a shuffle four bundles; the table is
   bucketed by bundle, so it isn't shuffled again. Bundles, and shards of ``SHARD_WORDS`` words, keep the messages few.
2. A round trip: each bundle sends its words with their expected counts for every state to the shards; a shard adds them
   up and answers each bundle with the sums for its words. The first round sends plain counts, to which the shard
   gives each state's own random tilt (from the word's hash).
3. Baum-Welch: with the answers, a bundle knows the emission probabilities of its words. It runs the scaled
   forward-backward recursion and gives expected emission counts (to the shards) and a small row of expected
   transitions and starts. States start out likely to stay (``STAY``), as neighbouring words have much in common. The
   query trains until the log-likelihood a word has gained less than ``TOLERANCE`` in two rounds running, the later gain
   not being the greater: the start may gain little before the states part. A round's files go once the next is stored.
   :func:`scored` makes ``ITERATIONS`` rounds unless told otherwise.
4. Scoring: the scaled forward recursion gives each text's exact log-likelihood.

The recursions are exact for texts of any length. Texts run side by side, a step being a few operations on all; those of
more than ``SEGMENT`` words are cut into segments, which are chained along each text first: vectors are carried through the
first and the last one, K x K products through those between.

Emissions are (count + SMOOTHING) over their state's total; the state before the first word is drawn from the start
distribution. Logarithms are natural; perplexity is exp(-log_likelihood / n_tokens).

Cases: null and empty texts have no word: log_likelihood is 0 and perplexity null. Each row is a sequence of its own, so
repeated rows count as often as they occur and get equal scores; null ids are carried; an empty table gives an empty
result; the result has the columns doc_id, n_tokens, n_unknown, log_likelihood and perplexity only.
"""

from __future__ import annotations

import itertools
import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, forget, forget_shuffles, mix, scratch, stored, table, texts_of, tokens

STATES = 4
ITERATIONS = 2
#: Gain in log-likelihood a word, in nats, under which training has settled.
TOLERANCE = 5e-4
SMOOTHING = 1e-3
#: Probability of staying in a state before training: near-even starts gain nothing for many rounds, sticky ones end at lesser optima.
STAY = 0.8
CHUNK = 16 << 20
BUNDLED = 16
SEGMENT = 4096
#: Words of the segments that run side by side.
LOT = 1 << 19
#: Steps after which a recursion is scaled; emissions are scaled by word before.
SCALED = 8
#: Words, counted once in each bundle, that a shard should hold, give or take.
SHARD_WORDS = 2_000_000
_STATS = "shard int, bundle long, words binary, sums binary"


class Model(NamedTuple):
    """The small part of the model; emission counts lie with the bundles."""

    start: np.ndarray  #: (K,) state before the first word
    move: np.ndarray  #: (K, K) transition probabilities
    total: np.ndarray  #: (K,) sums of the emission counts
    unknown: np.ndarray  #: (K,) emission counts of the unknown word
    vocabulary: int  #: symbols, the unknown word included


class Sequences(NamedTuple):
    """Texts as chained segments of at most SEGMENT words; ``ids`` are rows of the emission table."""

    ids: np.ndarray
    lengths: np.ndarray  #: words of each text
    text: np.ndarray  #: text of each segment
    first: np.ndarray  #: position in ids of each segment's first word
    size: np.ndarray  #: words of each segment
    chain: list[np.ndarray]  #: chain[j]: for the texts with more than j segments, longest first, their j-th segment
    order: np.ndarray  #: texts, longest first


def initial(states: int = STATES) -> tuple[np.ndarray, np.ndarray]:
    """Start and transition probabilities before training: even starts, states that like to stay."""
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY)
    return np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True)


def tilt(words: np.ndarray, states: int = STATES) -> np.ndarray:
    """A factor between 0.5 and 1.5 for each word and state, from the word's hash."""
    lanes = np.stack([mix(words.view(np.uint64) + np.uint64((k + 1) * 0x51ED2701)) for k in range(states)], axis=1)
    return 0.5 + (lanes >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def emissions(model: Model, counts: np.ndarray) -> np.ndarray:
    """Emission probabilities of words with these expected counts; words without any are the unknown word."""
    known = counts.sum(axis=1) > 0
    return np.where(known[:, None], counts + SMOOTHING, model.unknown + SMOOTHING) / (model.total + SMOOTHING * model.vocabulary)


def sequences(ids: np.ndarray, lengths: np.ndarray, over: int = 0) -> Sequences:
    """The segments of all texts, or of those only that have more than ``over``."""
    per = -(-lengths // SEGMENT)
    per = np.where(per > over, per, 0)
    text = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = (np.cumsum(lengths) - lengths)[text] + nth * SEGMENT
    order = np.argsort(-per, kind="stable")
    begin, sorted_per = (np.cumsum(per) - per)[order], per[order]
    chain = [begin[: np.searchsorted(-sorted_per, -j, "left")] + j for j in range(int(per.max()) if len(per) else 0)]
    return Sequences(ids, lengths, text, first, np.minimum(SEGMENT, lengths[text] - nth * SEGMENT), chain, order)


def _lots(s: Sequences):
    """Segments in lots, longest first: their numbers, and how many have more than t words for each t."""
    order = np.argsort(-s.size, kind="stable")
    upto, lo = np.cumsum(s.size[order]), 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LOT, "right")))
        own = order[lo:hi]
        yield own, np.searchsorted(-s.size[own], -np.arange(int(s.size[own[0]])), "left").tolist()
        lo = hi


def _peaks(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The emission table, states first, scaled by its words' greatest emissions, and their logarithms."""
    scaled = np.array(table.T, order="C")  # a copy in any case
    peak = scaled.max(axis=0)
    scaled /= peak
    return scaled, np.log(peak)


_kept: list[np.ndarray] = []


def _room(size: int) -> list[np.ndarray]:
    """Three arrays of doubles that a worker process keeps: memory that is new each time costs more than the sums in it."""
    if not _kept or len(_kept[0]) < size:
        _kept[:] = [np.empty(size) for _ in range(3)]
    return [x[:size] for x in _kept]


def _flat(s: Sequences, own: np.ndarray, active: list[int], scaled: np.ndarray, out: np.ndarray | None = None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Where each step of a lot begins, and its words and their emissions, states first, one step after another."""
    base = np.r_[0, np.cumsum(active)]
    if len(own) < len(active):  # a segment at a time reads its words in order
        ids = np.empty(base[-1], s.ids.dtype)
        for i, (first, n) in enumerate(zip(s.first[own].tolist(), s.size[own].tolist(), strict=True)):
            ids[base[:n] + i] = s.ids[first : first + n]
    else:
        at = np.arange(base[-1])
        at -= np.repeat(base[:-1], active)
        at = np.take(s.first[own], at)
        at += np.repeat(np.arange(len(active)), active)
        ids = np.take(s.ids, at)
    return base.tolist(), ids, np.take(scaled, ids, axis=1, mode="clip", out=out)


def _carried(s: Sequences, model: Model, scaled: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``begin`` carried through each segment's transitions and emissions, scaled to sum 1 together, and the
    logarithm of the scale without the words' peaks."""
    out, log = np.empty((len(s.first), *begin.shape)), np.zeros(len(s.first))
    move = np.ascontiguousarray(model.move.T)
    for own, active in _lots(s):
        base, _, emit = _flat(s, own, active, scaled)
        m = np.repeat(begin[:, :, None], len(own), axis=2)
        spare, scale = np.empty_like(m), np.zeros(len(own))
        for t, n in enumerate(active):
            now = spare[:, :, :n]
            np.matmul(move, m[:, :, :n], out=now)
            now *= emit[:, base[t] : base[t + 1]]
            stay = active[t + 1] if t + 1 < len(active) else 0
            since = 0 if t % SCALED == SCALED - 1 else stay  # those that end here are scaled in any case
            if since < n:
                norm = now[:, :, since:].sum(axis=(0, 1))
                now[:, :, since:] /= norm
                scale[since:n] += np.log(norm)
            if stay < n:
                out[own[stay:n]] = now[:, :, stay:].transpose(2, 0, 1)
            m, spare = spare, m
        log[own] = scale
    return out, log


def _followed(s: Sequences, model: Model, scaled: np.ndarray) -> np.ndarray:
    """The likelihood of each segment from each state before it, scaled to sum 1."""
    out = np.empty((len(s.first), len(model.start)))
    for own, active in _lots(s):
        base, _, right = _flat(s, own, active, scaled)
        beta = np.ones((len(model.start), len(own)))
        for t in range(len(active) - 1, -1, -1):
            now, here = beta[:, : active[t]], right[:, base[t] : base[t + 1]]
            here *= now
            np.matmul(model.move, here, out=now)
            if t % SCALED == 0:
                now /= now.sum(axis=0)
        out[own] = beta.T
    return out


def _products(s: Sequences, model: Model, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's product of transitions and emissions, scaled to sum 1, and the logarithm of its scale."""
    scaled, log_peak = _peaks(table)
    out, log = _carried(s, model, scaled, np.eye(len(model.start)))
    sums = np.r_[0.0, np.cumsum(log_peak[s.ids])]
    return out, log + sums[s.first + s.size] - sums[s.first]


def forward(s: Sequences, model: Model, products: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text, and the scaled state distribution before each segment."""
    k, count = len(model.start), len(s.order)
    total, at = np.zeros(count), np.broadcast_to(model.start, (count, k)).copy()
    before = np.empty((len(s.first), k))
    for segment in s.chain:
        n = len(segment)
        before[segment] = at[:n]
        step = np.einsum("ni,nij->nj", at[:n], products[segment])
        norm = step.sum(axis=1, keepdims=True)
        at[:n] = step / norm
        total[:n] += np.log(norm[:, 0]) + log[segment]
    out = np.empty(count)
    out[s.order] = total
    return out, before


def _borders(s: Sequences, model: Model, scaled: np.ndarray, following: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The state distribution before each segment and, if ``following``, the likelihood of what follows it, both scaled.

    Only texts of several segments need work: a vector is carried on through their first segments and back through their
    last ones, and only those between need products.
    """
    k = len(model.start)
    before, after = np.broadcast_to(model.start, (len(s.first), k)).copy(), np.ones((len(s.first), k))
    long = sequences(s.ids, s.lengths, over=1)
    if len(long.first):
        own = np.flatnonzero(s.lengths[s.text] > SEGMENT)
        opening = np.r_[True, long.text[1:] != long.text[:-1]]
        closing = np.r_[opening[1:], True]
        inner = ~opening & ~closing
        some = lambda which: long._replace(first=long.first[which], size=long.size[which])
        passed, products = np.empty((len(own), k)), np.empty((len(own), k, k))
        passed[opening] = _carried(some(opening), model, scaled, model.start[None])[0][:, 0]
        products[inner] = _carried(some(inner), model, scaled, np.eye(k))[0]
        on = [*map(len, long.chain[1:]), 0]  # how many texts go on after their j-th segment
        at = passed[long.chain[0]]
        at /= at.sum(axis=1, keepdims=True)
        for j, segment in enumerate(long.chain[1:], 1):
            before[own[segment]] = at[: len(segment)]
            step = np.einsum("ni,nij->nj", at[: on[j]], products[segment[: on[j]]])
            at[: on[j]] = step / step.sum(axis=1, keepdims=True)
        if following:
            passed[closing] = _followed(some(closing), model, scaled)
            at = np.ones((len(long.order), k))
            for j in range(len(long.chain) - 1, -1, -1):
                segment = long.chain[j]
                after[own[segment]] = at[: len(segment)]
                if j:
                    step = np.einsum("nij,nj->ni", products[segment[: on[j]]], at[: on[j]])
                    at[: on[j]] = step / step.sum(axis=1, keepdims=True)
                    at[on[j] : len(segment)] = passed[segment[on[j] :]]
    return before, after


class Lot(NamedTuple):
    """A forward sweep over a lot of segments; the words of step t of all that have so many come together, states first."""

    own: np.ndarray  #: segments, longest first
    active: list[int]  #: how many have more than t words
    base: list[int]  #: where step t begins
    ids: np.ndarray
    emit: np.ndarray  #: scaled emissions
    at: np.ndarray  #: state distributions after each word, scaled to sum 1 at every SCALED-th step only
    norm: dict[int, np.ndarray]  #: what the distributions of such a step were divided by
    log: np.ndarray  #: log-likelihood of each segment of the lot, without the words' peaks
    spare: np.ndarray  #: room for as many doubles as there are in at


def _forward_sweeps(s: Sequences, model: Model, scaled: np.ndarray, before: np.ndarray):
    """The scaled forward recursion over all segments, a lot at a time; the next one takes the place of the last."""
    k = len(model.start)
    move = np.ascontiguousarray(model.move.T)
    for own, active in _lots(s):
        emit, at, spare = (x.reshape(k, -1) for x in _room(k * sum(active)))
        base, ids, emit = _flat(s, own, active, scaled, emit)
        norms, log = {}, np.zeros(len(own))
        now = before[own].T
        for t, n in enumerate(active):
            a, b = base[t], base[t + 1]
            then, now = now, at[:, a:b]
            np.matmul(move, then[:, :n], out=now)
            now *= emit[:, a:b]
            if t % SCALED == SCALED - 1:
                norms[t] = norm = now.sum(axis=0)
                now /= norm
                log[:n] += np.log(norm)
            stay = active[t + 1] if t + 1 < len(active) else 0
            if stay < n:
                log[stay:n] += np.log(now[:, stay:].sum(axis=0))
        yield Lot(own, active, base, ids, emit, at, norms, log, spare)


def likelihoods(s: Sequences, model: Model, table: np.ndarray) -> np.ndarray:
    """The exact log-likelihood of each text."""
    scaled, log_peak = _peaks(table)
    before, _ = _borders(s, model, scaled, following=False)
    out = np.zeros(len(s.lengths))
    for lot in _forward_sweeps(s, model, scaled, before):
        out += np.bincount(s.text[lot.own], lot.log, len(out))
    sums = np.r_[0.0, np.cumsum(log_peak[s.ids])]
    ends = np.cumsum(s.lengths)
    return out + sums[ends] - sums[ends - s.lengths]


def _joint(lot: Lot, begin: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums over a lot's words of the distribution before each word (``begin`` before the first) by its row of ``right``.

    While as many segments go on, the words of a step follow those of the step before, so such steps are one product.
    """
    base, active = lot.base, lot.active
    out = begin @ right[:, : base[1]].T
    for t, until in itertools.pairwise([*np.flatnonzero(np.diff(active, prepend=0)).tolist(), len(active)]):
        if t:
            out += lot.at[:, base[t - 1] : base[t - 1] + active[t]] @ right[:, base[t] : base[t + 1]].T
        if until - t > 1:
            out += lot.at[:, base[t] : base[until - 1]] @ right[:, base[t + 1] : base[until]].T
    return out


def expected(s: Sequences, model: Model, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts: emissions for each row of the table, transitions, starts, and the log-likelihood.

    The backward recursion is divided by what the forward one was, so their product keeps its sum from word to word;
    it is made 1 at a segment's last word.
    """
    k = len(model.start)
    scaled, log_peak = _peaks(table)
    before, after = _borders(s, model, scaled)
    opening = np.r_[True, s.text[1:] != s.text[:-1]] if len(s.text) else np.zeros(0, bool)
    moves, counts, starts, total = np.zeros((k, k)), np.zeros((k, len(table))), np.zeros(k), 0.0
    for lot in _forward_sweeps(s, model, scaled, before):
        total += float(lot.log.sum())
        begin, right, beta = before[lot.own].T, lot.emit, lot.spare  # each emission is used once more
        ends = np.array(lot.base)[s.size[lot.own] - 1] + np.arange(len(lot.own))
        last = after[lot.own].T
        beta[:, ends] = last / (last * lot.at[:, ends]).sum(axis=0)
        first = np.empty((k, len(lot.own)))
        for t in range(len(lot.active) - 1, -1, -1):
            a, b = lot.base[t], lot.base[t + 1]
            own = right[:, a:b]
            own *= beta[:, a:b]
            if t in lot.norm:
                own /= lot.norm[t]
            np.matmul(model.move, own, out=beta[:, lot.base[t - 1] : lot.base[t - 1] + b - a] if t else first)
        post = first[:, opening[lot.own]] * model.start[:, None]
        starts += (post / post.sum(axis=0)).sum(axis=1)
        moves += _joint(lot, begin, right)
        gamma = np.multiply(lot.at, beta, out=beta)
        for j in range(k):
            counts[j] += np.bincount(lot.ids, gamma[j], len(table))
    return np.ascontiguousarray(counts.T), moves * model.move, starts, total + float(counts.sum(axis=0) @ log_peak)


def _pack(ids: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * count, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    out = np.zeros((count, 4), np.uint8)
    for k in range(4):
        if planes[k].any():  # most chunks have words for three bytes at most
            out[:, k] = planes[k]
    return out.view("<u4").ravel().astype(np.int64)


def _by_shard(words: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that groups words by shard, and the bounds of the shards in it."""
    shard = ((mix(words.view(np.uint64)) >> np.uint64(20)) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)  # 16 bits are sorted by radix
    return np.argsort(shard, kind="stable"), np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]


def _bundled(docs: DataFrame) -> int:
    """Chunks to a bundle, by Spark's estimate of the input's size: one where it is small or unknown."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 if size >= 1 << 60 else max(1, min(BUNDLED, size // (4 * partitions * CHUNK)))


def encoded(docs: DataFrame, bundled: int = 1) -> DataFrame:
    """Chunks of whole texts: bundle, doc_ids, lengths, ids (packed), words and counts (most frequent first), n_words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def worker(batches):
        base, serial = TaskContext.get().partitionId() << 32, 0
        names, hashes, lengths, held = [], [], [], 0

        def row():
            everything = np.concatenate(hashes)
            local, words = pd.factorize(everything)
            counts = np.bincount(local, minlength=len(words))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ids = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([base + serial // bundled]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.concatenate(lengths).astype(np.int64).tobytes()], pa.binary()),
                    pa.array([_pack(rank[local])], pa.binary()), pa.array([words[order].tobytes()], pa.binary()), pa.array([counts[order].astype(np.int32).tobytes()], pa.binary()), pa.array([len(words)], pa.int64()),
                ], ["bundle", "doc_ids", "lengths", "ids", "words", "counts", "n_words"],
            )

        for batch in batches:
            for block in blocks(texts_of(batch)):
                found = tokens(block, symbols=True)
                names.append(batch.column(0).slice(block.first, len(block.offsets) - 1))
                hashes.append(found.hash)
                lengths.append(np.diff(found.bounds))
                held += len(block.data)
                if held >= CHUNK:
                    yield row()
                    serial += 1
                    names, hashes, lengths, held = [], [], [], 0
        if names:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(worker, f"bundle long, doc_ids array<{kind}>, lengths binary, ids binary, words binary, counts binary, n_words long")


def _bucketed(chunks: DataFrame) -> tuple[DataFrame, str]:
    """The chunks as a table in the shared folder, bucketed by bundle, and its name: later joins by bundle don't move them."""
    spark = chunks.sparkSession
    buckets = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"orrery_chunks_{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/{name}"
    chunks.repartition(buckets, "bundle").write.bucketBy(buckets, "bundle").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.__dict__["stored_at"] = path
    return out, name


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "bundle", "words", "sums"])


def _messages(bundle: int, words: np.ndarray, values: np.ndarray, shards: int) -> list[tuple]:
    """Words and what belongs to them, by shard."""
    order, bounds = _by_shard(words, shards)
    words, values = words[order], values[order]
    return [(int(k), bundle, words[bounds[k] : bounds[k + 1]].tobytes(), values[bounds[k] : bounds[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(bounds))]


def _counted(chunks: DataFrame, shards: int) -> DataFrame:
    """The first request of each bundle: its words and their plain counts, by shard."""

    def work(group: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("words").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in group.column("counts").to_pylist()])
        own, at = np.unique(words, return_inverse=True)
        return _rows(_messages(group.column("bundle")[0].as_py(), own, np.bincount(at, counts, len(own)).astype(np.int64), shards))

    return chunks.select("bundle", "words", "counts").groupBy("bundle").applyInArrow(work, _STATS)


def _answered(requests: DataFrame, states: int, plain: bool) -> DataFrame:
    """What each shard answers: for every bundle the summed counts of its words. The plain first round also gives a row
    with bundle -1: known words, unknown occurrences, and sums of the unknown and of all known words' counts."""

    def shard(group: pa.Table) -> pa.Table:
        number = group.column("shard")[0].as_py()
        bundle, raw, value = (group.column(c).to_pylist() for c in ("bundle", "words", "sums"))
        words = [np.frombuffer(x, np.int64) for x in raw]
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        ends = np.cumsum([0, *map(len, words)])
        out = []
        if plain:
            total = np.bincount(at, np.concatenate([np.frombuffer(x, np.int64) for x in value]))
            known = total > 1
            sums = tilt(distinct, states) * total[:, None]
            out.append((number, -1, b"", np.r_[known.sum(), total[~known].sum(), sums[~known].sum(axis=0), sums[known].sum(axis=0)].tobytes()))
            sums[~known] = 0
        else:
            values = np.concatenate([np.frombuffer(x, np.float32) for x in value]).reshape(-1, states)
            sums = np.stack([np.bincount(at, values[:, k]) for k in range(states)], axis=1)
        sums = sums.astype(np.float32)
        return _rows(out + [(number, bundle[k], raw[k], sums[at[ends[k] : ends[k + 1]]].tobytes()) for k in range(len(words))])

    return requests.groupBy("shard").applyInArrow(shard, _STATS)


class Bundle(NamedTuple):
    words: np.ndarray  #: of all chunks, ascending
    known: np.ndarray  #: (words, K) emission counts
    lengths: list[np.ndarray]  #: of each chunk's texts
    places: list[np.ndarray]  #: for each chunk the places of its words, most frequent first, in words
    packed: list[bytes]

    def sequences(self, k: int) -> Sequences:
        """A chunk's texts; words are numbered as in its places."""
        return sequences(_unpack(self.packed[k], int(self.lengths[k].sum())), self.lengths[k])


def _opened(left: pa.Table, right: pa.Table, states: int) -> Bundle:
    """A bundle with the shards' answers; words that weren't asked for have no counts."""
    local = [np.frombuffer(x, np.int64) for x in left.column("words").to_pylist()]
    words, at = np.unique(np.concatenate(local), return_inverse=True)  # one sort; np.unique alone hashes, and searching each word takes longer too
    known = np.zeros((len(words), states))
    for raw, value in zip(right.column("words").to_pylist(), right.column("sums").to_pylist(), strict=True):
        known[np.searchsorted(words, np.frombuffer(raw, np.int64))] = np.frombuffer(value, np.float32).reshape(-1, states)
    lengths = [np.frombuffer(x, np.int64) for x in left.column("lengths").to_pylist()]
    return Bundle(words, known, lengths, np.split(at, np.cumsum([len(w) for w in local])[:-1]), left.column("ids").to_pylist())


def _trained(chunks: DataFrame, answers: DataFrame, model: Model, shards: int) -> DataFrame:
    """The next requests of all bundles, and for each bundle a row of shard -1: transitions, starts, totals, unknown, log-likelihood."""
    states = len(model.start)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        bundle = _opened(left, right, states)
        emit, known = emissions(model, bundle.known), bundle.known.sum(axis=1) > 0
        counts, small = np.zeros_like(bundle.known), np.zeros(states * states + states + 1)
        for k, place in enumerate(bundle.places):
            own, moves, starts, log = expected(bundle.sequences(k), model, emit[place])
            if k:
                counts[place] += own
            else:
                counts[place] = own  # the words of a chunk are distinct
            small += np.r_[moves.ravel(), starts, log]
        number = left.column("bundle")[0].as_py()
        row = np.r_[small[:-1], counts.sum(axis=0), counts[~known].sum(axis=0), small[-1]]
        return _rows([(-1, number, b"", row.tobytes()), *_messages(number, bundle.words[known], np.maximum(counts[known], 1e-9).astype(np.float32), shards)])

    chunks = chunks.select("bundle", "lengths", "ids", "words")
    return chunks.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(work, _STATS)


def _scored(chunks: DataFrame, answers: DataFrame, model: Model, kind: str) -> DataFrame:
    states = len(model.start)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        bundle, parts = _opened(left, right, states), []
        emit, unknown = emissions(model, bundle.known), bundle.known.sum(axis=1) == 0
        for k, place in enumerate(bundle.places):
            s = bundle.sequences(k)
            logs = likelihoods(s, model, emit[place])
            lost, ends = np.r_[0, np.cumsum(unknown[place][s.ids])], np.cumsum(s.lengths)
            with np.errstate(over="ignore"):
                perplexity = np.exp(-logs / np.maximum(s.lengths, 1))
            names = left.column("doc_ids").combine_chunks().slice(k, 1).flatten()
            parts.append(pa.table([names, pa.array(s.lengths), pa.array(lost[ends] - lost[ends - s.lengths]), pa.array(np.round(logs, 6)), pa.array(np.round(perplexity, 4), mask=s.lengths == 0)], ["doc_id", "n_tokens", "n_unknown", "log_likelihood", "perplexity"]))
        return pa.concat_tables(parts)

    chunks = chunks.select("bundle", "doc_ids", "lengths", "ids", "words")
    return chunks.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(work, f"doc_id {kind}, n_tokens long, n_unknown long, log_likelihood double, perplexity double")


def _summed(df: DataFrame, where: str, size: int) -> np.ndarray:
    """The sum of small rows of doubles, one for each shard or bundle; each task adds its own up first."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.frombuffer(value, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = np.zeros(size)
    for row in df.where(where).select("sums").mapInArrow(add, "sums binary").toLocalIterator():
        total += np.frombuffer(bytes(row["sums"]), np.float64)
    return total


def settled(logs: list[float], tolerance: float) -> bool:
    """Whether the last two gains of a round's log-likelihood a word are under ``tolerance`` and don't grow."""
    gains = np.diff(logs[-3:])
    return len(gains) == 2 and gains[1] <= gains[0] < tolerance


def scored(docs: DataFrame, states: int = STATES, iterations: int | None = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """The likelihood of every row of ``docs`` under a model trained on all of them; iterations None: until it has settled.

    The scores are stored and all other files deleted.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks, name = _bucketed(encoded(docs, _bundled(docs)))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // SHARD_WORDS))
    last = stored(_answered(_counted(chunks, shards), states, plain=True))
    found = _summed(last, "bundle = -1", 2 + 2 * states)
    answers = last.where("bundle >= 0")
    start, move = initial(states)
    model = Model(start, move, found[2 : 2 + states] + found[2 + states :], found[2 : 2 + states], int(found[0]) + 1)
    logs: list[float] = []  # before each round, a word
    for _ in itertools.count() if iterations is None else range(iterations):
        counted = stored(_trained(chunks, answers, model, shards))
        found = _summed(counted, "shard = -1", states * states + 3 * states + 1)
        moves, (starts, total, unknown) = found[: states * states].reshape(states, states), found[states * states : -1].reshape(3, states)
        model = Model((starts + 1e-3) / (starts.sum() + states * 1e-3), (moves + 1e-3) / (moves.sum(axis=1, keepdims=True) + states * 1e-3), total, unknown, model.vocabulary)
        forget(last)  # the round after it is in the shared folder as well
        last, answers = counted, _answered(counted.where("shard >= 0"), states, plain=False)
        forget_shuffles(spark)
        logs.append(found[-1] / max(1.0, total.sum()))
        if iterations is None and settled(logs, tolerance):
            break
    out = stored(_scored(chunks, answers, model, kind))
    forget(last)
    spark.sql(f"DROP TABLE {name}")
    forget(chunks)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood of every document of the table ``documents``, under a model trained until it has settled."""
    return scored(table(spark, sf_dir, "documents"), iterations=None)

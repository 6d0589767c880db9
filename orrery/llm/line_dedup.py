"""Line deduplication (operator 1): of every line that occurs more than once, the first occurrence stays.

1. Each task hashes its lines (64 bits, vectorised over blocks of text), keeps every hash once and sends them, 8 bytes each and packed by shard
   of the hash space, to the shards. A shard inserts them into its *once-seen* Bloom filter; a hash that was in there
   already goes into its *twice-seen* filter. No line text moves. There is a shard for every ``SHARD_BYTES`` of input, so
   its hashes and filters (packed bits) fit one task at any size.
2. Every line whose hash is in the twice-seen filter is a suspect. The filters are broadcast if together they stay
   within ``max_broadcast`` bytes. Larger ones stay where they are: tasks send (row, position, hash) of their lines packed
   to the shards, which test one message after another, and only the suspects' places come back to their rows.
3. Only suspects' texts shuffle: they are grouped by their text, which confirms repeats exactly and finds each first
   occurrence, in order of (doc_id, row hash, position). The others are cut from their documents.

Lines are compared without surrounding blanks; blank lines are never repeats and always stay. A document all of whose
non-blank lines went is gone itself. Null texts are empty ones and stay as they are; null ids come before all others;
identical rows share their fate, as they share every position; rows are told apart by 128 bits of id and text; other
columns pass through under whatever names, n_chars is renewed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Block, blocks, mix, span_hashes, stored, table, texts_of

BITS_PER_HASH = 16
PROBES = 4
MAX_BROADCAST = 64 << 20
MIN_SHARDS = 32
#: Bytes of input, by Spark's estimate, to a shard.
SHARD_BYTES = 512 << 20
#: Lines whose places and hashes a task gathers before it sends them to the shards.
GATHERED = 1 << 21
_KEY = ["row", "row2"]


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Probe positions, one row for each of PROBES, in a filter of ``size`` (a power of two) bits."""
    value = mix(hashes.astype(np.uint64))
    step = (value >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(value + np.uint64(k) * step) & np.uint64(size - 1) for k in range(PROBES)]).astype(np.int64)


def _put(packed: np.ndarray, at: np.ndarray) -> None:
    """Set the bits ``at``, one bit of the bytes after another: a byte may then occur any number of times."""
    at = at.ravel()
    for bit in range(8):
        packed[at[(at & 7) == bit] >> 3] |= np.uint8(128 >> bit)


def _got(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def twice_seen(groups: list[np.ndarray], again: list[np.ndarray]) -> tuple[int, bytes]:
    """The twice-seen filter of groups of distinct hashes and of hashes known to repeat inside a group.

    Returns its size in bits and its packed bits. Every hash that is in two groups is in the filter.
    """
    count = sum(map(len, groups))
    size = 1 << max(10, int(np.ceil(np.log2(max(1, count * BITS_PER_HASH)))))
    once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
    for group in groups:
        at = _bits(group, size)
        _put(twice, at[:, _got(once, at)])
        _put(once, at)
    for group in again:
        _put(twice, _bits(group, size))
    # Few hashes repeat: the filter is halved (both halves or-ed) as long as it stays sparse.
    while size > 1024 and int(np.bitwise_count(twice).sum()) < 0.1 * size:
        size //= 2
        twice = twice[: size // 8] | twice[size // 8 :]
    return size, twice.tobytes()


def in_filter(hashes: np.ndarray, size: int, packed: np.ndarray) -> np.ndarray:
    return _got(packed, _bits(hashes, size))


def _by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that groups hashes by shard, and (shard, first, last) of those that have any."""
    shard = (mix(hashes.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0]) if len(order) else np.zeros(0, np.int64)
    return order, list(zip(shard[order][first].tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True)) if len(order) else []


class Lines(NamedTuple):
    """The non-blank lines of a block without surrounding blanks."""

    text: np.ndarray  #: index of the text in the block
    pos: np.ndarray  #: position among all lines of that text
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray  #: int64


def lines_of(block: Block) -> Lines:
    data, offsets = block.data, block.offsets
    breaks = np.flatnonzero(data == 10)
    count = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(offsets) - 1) + 1
    text = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start, end = np.sort(np.r_[offsets[:-1], breaks + 1]), np.sort(np.r_[breaks, offsets[1:]])
    visible = np.flatnonzero(data != 32)
    first, last = np.searchsorted(visible, start), np.searchsorted(visible, end) - 1
    some = last >= first
    text, pos, start, end = text[some], pos[some], visible[first[some]], visible[last[some]] + 1
    return Lines(text, pos, start, end, span_hashes(data, start, end).view(np.int64))


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns renamed by position, c0 on, and row and row2, which tell its rows apart."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).select("*", *(x.alias(name) for x, name in zip(_keys(docs), _KEY, strict=True)))


def _keys(docs: DataFrame) -> list:
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(doc_id, text), F.xxhash64(text, doc_id)]


def _slim(docs: DataFrame) -> DataFrame:
    at = {c: docs.columns.index(c) for c in ("doc_id", "text")}
    return _plain(docs).select(F.col(f"c{at['doc_id']}").alias("doc_id"), *_KEY, F.col(f"c{at['text']}").alias("text"))


def _shards(docs: DataFrame) -> int:
    """A number that grows with the input: Spark's estimate of its bytes, or the bytes of its texts where that is unknown."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(MIN_SHARDS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)


def _batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))


def filters(docs: DataFrame, shards: int) -> DataFrame:
    """The twice-seen filter of each shard of the hash space: shard, size, bits."""

    def pack(batches):
        seen = [lines_of(block).hash for batch in batches for block in blocks(texts_of(batch))]
        if not seen:
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        order, parts = _by_shard(values, shards)
        values, counts = values[order], counts[order]
        rows = [(k, values[a:b].tobytes(), values[a:b][counts[a:b] > 1].tobytes()) for k, a, b in parts]
        if rows:
            yield _batch(rows, {"shard": pa.int32(), "hashes": pa.binary(), "again": pa.binary()})

    def build(batches):
        number, groups, again = None, [], []
        result = lambda: _batch([(number, *twice_seen(groups, again))], {"shard": pa.int32(), "size": pa.int64(), "bits": pa.binary()})
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != number:
                    if groups:
                        yield result()
                    number, groups, again = row["shard"], [], []
                groups.append(np.frombuffer(row["hashes"], np.int64))
                again.append(np.frombuffer(row["again"], np.int64))
        if groups:
            yield result()

    packed = docs.select("text").mapInArrow(pack, "shard int, hashes binary, again binary")
    return packed.repartition(max(8, shards // 4), "shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, size long, bits binary")


def _as_lines(batch: pa.RecordBatch, block: Block, found: Lines) -> pa.RecordBatch:
    """Some lines of a block with what their rows are told apart by."""
    at, raw = pa.array(found.text + block.first), block.data.tobytes()
    texts = pa.array([raw[a:b] for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(found.pos.astype(np.int32)), texts], ["doc_id", *_KEY, "pos", "line"])


def _by_broadcast(docs: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """The suspects by filters that every task holds."""
    shared = docs.sparkSession.sparkContext.broadcast({r["shard"]: (r["size"], bytes(r["bits"])) for r in built.toLocalIterator()})

    def cut(batches):
        for batch in batches:
            for block in blocks(texts_of(batch)):
                found = lines_of(block)
                keep = np.zeros(len(found.hash), bool)
                order, parts = _by_shard(found.hash, shards)
                for k, a, b in parts:
                    size, bits = shared.value[k]
                    keep[order[a:b]] = in_filter(found.hash[order[a:b]], size, np.frombuffer(bits, np.uint8))
                yield _as_lines(batch, block, Lines(*(x[keep] for x in found)))

    return _slim(docs).mapInArrow(cut, _line_schema(docs))


def _by_shuffle(docs: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """The suspects by filters that stay where they are: packed places and hashes go there, places of suspects come back."""

    def places(batches):
        rows, pos, hashes, held = [], [], [], 0

        def send():
            r, p, h = np.concatenate(rows), np.concatenate(pos), np.concatenate(hashes)
            order, parts = _by_shard(h, shards)
            r, p, h = r[order], p[order], h[order]
            return _batch([(k, 1, 0, h[a:b].tobytes(), r[a:b].tobytes(), p[a:b].tobytes()) for k, a, b in parts], kinds)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (1, 2)], axis=1)
            for block in blocks(texts_of(batch)):
                found = lines_of(block)
                rows.append(keys[found.text + block.first])
                pos.append(found.pos.astype(np.int32))
                hashes.append(found.hash)
                held += len(found.pos)
                if held >= GATHERED:
                    yield send()
                    rows, pos, hashes, held = [], [], [], 0
        if held:
            yield send()

    def look_up(batches):
        number, size, bits = None, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["kind"]:
                    number, size, bits = row["shard"], row["size"], np.frombuffer(row["a"], np.uint8)
                    continue
                assert row["shard"] == number, "each shard's filter comes before its messages"
                keep = in_filter(np.frombuffer(row["a"], np.int64), size, bits)
                keys = np.frombuffer(row["b"], np.int64).reshape(-1, 2)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.frombuffer(row["c"], np.int32)[keep])], [*_KEY, "pos"])

    def cut(batches):
        for batch in batches:
            given = batch.column(4)
            length = given.value_lengths().to_numpy()
            wanted = (np.repeat(np.arange(len(length)), length) << 32) | given.flatten().to_numpy()
            for block in blocks(texts_of(batch)):
                found = lines_of(block)
                keep = np.isin(((found.text + block.first) << 32) | found.pos, wanted)
                yield _as_lines(batch, block, Lines(*(x[keep] for x in found)))

    kinds = {"shard": pa.int32(), "kind": pa.int32(), "size": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
    sent = _slim(docs).mapInArrow(places, "shard int, kind int, size long, a binary, b binary, c binary")
    both = sent.unionByName(built.selectExpr("shard", "0 AS kind", "size", "bits AS a", "CAST(NULL AS BINARY) AS b", "CAST(NULL AS BINARY) AS c"))
    found = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(look_up, "row long, row2 long, pos int")
    positions = found.groupBy(*_KEY).agg(F.collect_set("pos").alias("positions"))
    return _slim(docs).join(positions, _KEY).select("doc_id", *_KEY, "text", "positions").mapInArrow(cut, _line_schema(docs))


def _line_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, row2 long, pos int, line string"


def suspects(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, row, row2, pos and line of the lines that the twice-seen filters hold: all repeats and a few others."""
    shards = _shards(docs)
    built = stored(filters(docs, shards))
    small = (built.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= max_broadcast
    return (_by_broadcast if small else _by_shuffle)(docs, built, shards)


def repeats(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """row, row2 and pos of every line that has an earlier occurrence."""
    found = stored(suspects(docs, max_broadcast))
    firsts = found.groupBy("line").agg(F.min(F.struct("doc_id", *_KEY, "pos")).alias("f")).selectExpr("f.row AS row", "f.row2 AS row2", "f.pos AS pos")
    return found.select(*_KEY, "pos").join(firsts, [*_KEY, "pos"], "left_anti")


def deduplicated(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` (all its columns) without repeated lines and without documents that consist of such only."""
    cut = repeats(docs, max_broadcast).groupBy(*_KEY).agg(F.collect_set("pos").alias("cut"))
    given = F.col(f"c{docs.columns.index('text')}")
    joined = _plain(docs).join(cut, _KEY, "left").withColumn("lines", F.when(F.col("cut").isNotNull(), F.split(F.coalesce(given, F.lit("")), "\n")))
    kept = F.expr("transform(array_except(sequence(0, size(lines) - 1), cut), p -> lines[p])")
    joined = joined.withColumn("kept", F.when(F.col("cut").isNotNull(), kept)).where("cut IS NULL OR exists(kept, x -> trim(x) <> '')")
    text = F.when(F.col("cut").isNull(), given).otherwise(F.array_join("kept", "\n"))
    out = [F.col(f"c{k}") for k in range(len(docs.columns))]
    if "n_chars" in docs.columns:
        k = docs.columns.index("n_chars")
        out[k] = F.when(F.col("cut").isNull(), out[k]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    out[docs.columns.index("text")] = text
    return joined.select(*(c.alias(name) for c, name in zip(out, docs.columns, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``documents`` after line deduplication."""
    return deduplicated(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
ranked AS (
  SELECT doc_id, pos, line, trim(line) AS bare, row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, pos) AS k FROM lines),
marked AS (SELECT *, bare = '' OR k = 1 AS stays FROM ranked),
texts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (stays) AS t, bool_and(stays) AS whole, bool_or(stays AND bare <> '') AS remains
  FROM marked GROUP BY doc_id)
SELECT doc_id, CASE WHEN whole THEN text ELSE t END AS text, lang, source, CASE WHEN whole THEN n_chars ELSE length(t) END AS n_chars
FROM documents JOIN texts USING (doc_id) WHERE whole OR remains
"""

"""Shared pieces: intermediate tables, bounded samples and vectorised tokenisation of Arrow text.

Conventions of all operators here:

* a null text counts as an empty text; rows whose ``doc_id`` is null or repeated are described in
  each operator's docstring;
* input columns are picked by name, or renamed by position, before internal ones join them, so extra columns never clash.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name given to a null or missing source.
NO_SOURCE = "(none)"
#: Bytes of text that a labelled sample may have together.
SAMPLE_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; one of our own only where that is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage ends there and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/orrery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` table that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.__dict__["stored_at"])
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to; else they stay until the driver's memory fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def labelled_sample(ids: DataFrame, texts: DataFrame, bound: int, max_bytes: int = SAMPLE_BYTES) -> list[tuple]:
    """Labels and whole texts of at most ``bound`` distinct rows of ``ids`` (doc_id, label columns), on the driver.

    Taken are the rows with the smallest hash of doc_id that have a text, one text for each id (of several the first in
    order), until the texts have ``max_bytes`` together; texts of more than a sixteenth of that are passed over. So
    repeated rows and very long texts can't make the sample larger, and each task keeps one text for an id at most.
    """
    labels = [c for c in ids.columns if c != "doc_id"]
    known = ids.where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64(F.col("doc_id")), *ids.columns).limit(bound).select("doc_id", *labels).collect()
    if not known:
        return []
    kind = texts.schema["doc_id"].dataType.simpleString()

    def one_each(batches):
        best: dict = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in best or text < best[key]:
                    best[key] = text
        yield pa.RecordBatch.from_arrays([pa.array(list(best), batch_type), pa.array(list(best.values()), pa.string())], ["doc_id", "text"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(texts.schema["doc_id"].dataType)
    own = texts.select("doc_id", "text").where(F.col("doc_id").isin([r[0] for r in known]) & (F.octet_length("text") <= max_bytes // 16))
    picked = stored(own.mapInArrow(one_each, f"doc_id {kind}, text string").groupBy("doc_id").agg(F.min("text").alias("text")))
    size = dict(picked.select("doc_id", F.octet_length("text")).toLocalIterator())
    rows, total = [], 0
    for row in known:
        total += size.get(row[0], 0)
        if total > max_bytes:
            break
        if row[0] in size:
            rows.append(row)
    text_of = dict(picked.where(F.col("doc_id").isin([r[0] for r in rows])).toLocalIterator()) if rows else {}
    forget(picked)
    return [(*r[1:], text_of[r[0]]) for r in rows]


# -- bytes and words of Arrow text

#: Byte classes: 0 separator, 1 word byte (letters, digits and every byte of a non-ASCII character), 2 other visible.
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 2
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    CLASS[_lo:_hi] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PRIME = 0x9E3779B97F4A7C15 | 1
#: Bytes of text handled at once; a longer document forms a block of its own.
BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2**64, at least n + 1 of each."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        inverse = pow(_PRIME, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (_PRIME, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 capitals made small; the length stays."""
    out = _FOLD[data]
    if len(data) > 1:
        second = data[1:]
        capital = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        out[1:][capital] += np.uint8(32)
    return out


class Block(NamedTuple):
    """Some consecutive texts of an Arrow array."""

    first: int  #: index of the first text
    data: np.ndarray  #: their bytes
    offsets: np.ndarray  #: int64 bounds of the texts in data, one more than there are texts


class Tokens(NamedTuple):
    """The tokens of a block in order; ``bounds[i]:bounds[i + 1]`` are those of its i-th text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[Block]:
    """Cut an array of texts (nulls count as empty) into blocks of about ``size`` bytes without copying."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        if not len(chunk):
            continue
        large = pa.types.is_large_string(chunk.type)
        if chunk.null_count:
            chunk = chunk.fill_null("")
        _, raw, values = chunk.buffers()
        bounds = np.frombuffer(raw, np.int64 if large else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield Block(at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            at = to


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column as one contiguous array."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.string()) if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)) else column


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal spans wherever they lie."""
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start])


def tokens(block: Block, symbols: bool = False) -> Tokens:
    """Words (maximal runs of word bytes) of a block, folded and hashed; with ``symbols`` runs of other visible bytes too."""
    data, offsets = block.data, block.offsets
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Tokens(empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    kind = CLASS[data]
    if not symbols:
        kind = np.where(kind == 1, kind, np.uint8(0))
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[offsets] = True
    edges = np.flatnonzero(change)
    inside = kind[edges[:-1]] > 0
    start, end = edges[:-1][inside], edges[1:][inside]
    return Tokens(start, end, span_hashes(fold(data), start, end), np.searchsorted(start, offsets).astype(np.int64))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n consecutive token hashes (also across texts: callers mask those)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += hashes[k : k + size]
    return mix(out)


def text_batches(docs: DataFrame, worker, schema: str, *columns: str) -> DataFrame:
    """``docs`` reduced to doc_id, text and ``columns``, run through ``worker`` (Arrow batches to Arrow batches)."""
    return docs.select("doc_id", "text", *columns).mapInArrow(worker, schema)

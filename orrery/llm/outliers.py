"""Quality rules (operator 9): robust multivariate outliers.

Every text gets a vector of transformed statistics (:data:`STATISTICS`), each on a scale where ordinary texts lie close
together; pseudo-counts keep the statistics of short texts near the ordinary value. For every language and source, the
minimum-covariance-determinant estimate of location and scatter is sought: from two starts (distances by medians and
interquartile ranges, summed and greatest), concentration steps take the mean and covariance of the ``COVERED`` share of
the texts that lie closest, until the logarithm of the determinant falls by no more than ``TOLERANCE``; the start that ends
with the smaller determinant is used. Every step lowers it by more than that and the floors bound it from below, so the
steps end by themselves; groups that have settled take no part in further ones. Scatter is rescaled
so that the median squared distance is that of a chi-square. A text whose squared Mahalanobis distance exceeds the
chi-square's quantile for ``TAIL``, times ``SLACK``, is rejected.

All texts of a group take part in all its steps, wherever they lie: tasks count distances in fine bins and sum moments, and
only these small sums meet. A step takes whole bins, the nearest ones that hold at least the covered share. The vectors
of a task's texts lie packed by language and source (up to ``PACKED`` texts together), so a step joins a group's parameters
once to thousands of texts, and a hot group has many rows.
``FLOOR`` is added to all variances, so that a statistic without spread can't reject by itself.

Groups of fewer than ``MIN_GROUP`` texts are joined by language, and those that still are smaller to one rest; a rest of
fewer than ``MIN_GROUP`` texts is too small to judge: distance is null and the texts stay.

Cases: null and empty texts have the statistics of no words; null languages and sources are groups like others; null
ids are judged; rows are judged one by one, so repeated rows count as often as they occur; an empty table gives an
empty result; the result has the columns doc_id, lang, source, grouped_by, distance and kept only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CLASS, NO_SOURCE, blocks, stored, table, texts_of, tokens

STATISTICS = ["words", "word_length", "symbols", "capitals", "digits", "repeated", "line_length"]
DIM = len(STATISTICS)
COVERED = 0.75
#: Fall of the determinant's logarithm under which a start has settled.
TOLERANCE = 1e-4
PACKED = 1 << 15
MIN_GROUP = 60
TAIL = 1e-4
SLACK = 1.4
FLOOR = np.array([0.35, 0.06, 0.15, 0.12, 0.4, 0.2, 0.3]) ** 2
#: Bins of the squared distance: 16 to an octave, from 2**-8 on.
BINS, PER_OCTAVE = 512, 16
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def chi_square(p: float, k: int = DIM) -> float:
    """The p-quantile of the chi-square of k degrees of freedom, by bisection of its series."""
    import math

    def below(x: float) -> float:
        term = total = 1 / (k / 2)
        n = 1
        while term > total * 1e-16:
            term *= x / 2 / (k / 2 + n)
            total += term
            n += 1
        return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))

    lo, hi = 1e-9, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    out = [np.zeros((0, DIM))]
    for block in blocks(texts):
        found = tokens(block)
        data, offsets = block.data, block.offsets
        n = np.diff(found.bounds).astype(float)

        def count(mask: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
            sums = np.r_[0, np.cumsum(mask)]
            return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

        size = np.diff(offsets).astype(float)
        text = np.repeat(np.arange(len(n), dtype=np.uint64), np.diff(found.bounds))
        own = np.unique((text << np.uint64(40)) | (found.hash >> np.uint64(24)))
        distinct = np.bincount((own >> np.uint64(40)).astype(np.int64), minlength=len(n))
        letters = count(CLASS[data] == 1)
        lines = count(data == 10) + 1
        # A long text repeats words by itself: the share of distinct words is compared with a power of the length.
        out.append(
            np.stack(
                [
                    np.log1p(n) / 2, np.log((letters + 100) / (n + 20)), np.log((count(CLASS[data] == 2) + 3) / (size + 75) + 0.03), np.log((count(_UPPER[data]) + 4) / (size + 100) + 0.03),
                    np.log((count(_DIGIT[data]) + 2) / (size + 200) + 0.02), np.log((distinct + 10) / (n + 12)) + 0.18 * np.log1p(n / 60), np.log((n + 30) / (lines + 2)) / 2,
                ], axis=1,
            )
        )
    return np.concatenate(out)


def squared(x: np.ndarray, center: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    d = x - center
    return np.einsum("ni,ij,nj->n", d, inverse, d)


def bins(distance: np.ndarray) -> np.ndarray:
    """The bin of each squared distance: bin b ends at 2 ** ((b + 1) / PER_OCTAVE - 8)."""
    return np.clip(np.floor((np.log2(np.maximum(distance, 1e-30)) + 8) * PER_OCTAVE), 0, BINS - 1).astype(np.int32)


def started(x: np.ndarray, medians: np.ndarray, spread: np.ndarray) -> list[np.ndarray]:
    """The distances of the two starts."""
    z = ((x - medians) ** 2) / (spread**2 + FLOOR)
    return [z.sum(axis=1), z.max(axis=1) * DIM]


def vectors(docs: DataFrame) -> DataFrame:
    """g (group), lang, source, ids and their statistics x (packed doubles), of many texts a row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text", *(F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")))

    def worker(batches):
        held: list[tuple] = []

        def packed():
            ids, x = pa.concat_arrays([i for i, _, _ in held]), np.concatenate([v for _, _, v in held])
            names = pa.concat_tables([t for _, t, _ in held]).combine_chunks()
            codes: dict[tuple, int] = {}
            code = np.array([codes.setdefault(k, len(codes)) for k in zip(names.column(0).to_pylist(), names.column(1).to_pylist(), strict=True)])
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(codes) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids.take(pa.array(order)))
            x = np.ascontiguousarray(x[order])
            return pa.RecordBatch.from_arrays(
                [pa.array([k[j] for k in codes], pa.string()) for j in (0, 1)] + [lists, pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array(np.diff(ends))], ["lang", "source", "ids", "x", "n"]
            )

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0), pa.table([batch.column(2), batch.column(3)], ["lang", "source"]), statistics(texts_of(batch))))
                size += batch.num_rows
            if size >= PACKED:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    slim = stored(named.mapInArrow(worker, f"lang string, source string, ids array<{kind}>, x binary, n long"))
    keyed = slim.withColumns({"l": F.coalesce("lang", F.lit(NO_SOURCE)), "s": F.coalesce("source", F.lit(NO_SOURCE))})
    counts = keyed.groupBy("l", "s").agg(F.sum("n").alias("n"))
    large = F.col("n") >= MIN_GROUP
    rest = counts.where(~large).groupBy("l").agg(F.sum("n").alias("m"))
    groups = counts.join(rest, "l", "left").select("l", "s", F.when(large, F.concat_ws("/", "l", "s")).when(F.col("m") >= MIN_GROUP, F.concat("l", F.lit("/*"))).otherwise("*").alias("g"))
    return keyed.join(groups, ["l", "s"]).select("g", "lang", "source", "ids", "x", "n")


def _matrix(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.float64).reshape(-1, DIM)


def _distances(params: list, x: np.ndarray) -> list[np.ndarray]:
    """Squared distances for each start, by a group's parameters."""
    params = [np.array(p) for p in params]
    if len(params) == 1:
        return started(x, params[0][:DIM], params[0][DIM:])
    return [squared(x, p[:DIM], p[DIM:].reshape(DIM, DIM)) for p in params]


def _histogram(joined: DataFrame) -> DataFrame:
    """g, start, bin and n (texts) of rows (g, x, params)."""

    def worker(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for s, d in enumerate(_distances(row["params"], _matrix(row["x"]))):
                    sums[row["g"], s] = sums.get((row["g"], s), 0) + np.bincount(bins(d), minlength=BINS)
        found = [(g, s, b, int(v[b])) for (g, s), v in sums.items() for b in np.flatnonzero(v).tolist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["g", "start", "bin", "n"])

    return joined.select("g", "x", "params").mapInArrow(worker, "g string, start int, bin int, n long").groupBy("g", "start", "bin").agg(F.sum("n").alias("n"))


def _cuts(histogram: DataFrame, share: float) -> DataFrame:
    """g and cuts: for each start, the last of the nearest bins that hold ``share`` of the texts."""
    w = Window.partitionBy("g", "start")
    running = histogram.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    ends = running.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("g", "start").agg(F.min("bin").alias("bin"))
    return ends.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "bin"))), lambda e: e["bin"]).alias("cuts"))


def _moments(joined: DataFrame) -> DataFrame:
    """g and params: for each start, center and inverse scatter of the texts within its cut, and the logarithm of its determinant."""

    def worker(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x = _matrix(row["x"])
                for s, d in enumerate(_distances(row["params"], x)):
                    near = x[bins(d) <= row["cuts"][s]]
                    sums[row["g"], s] = sums.get((row["g"], s), 0) + np.r_[len(near), near.sum(axis=0), (near.T @ near).ravel()]
        found = [(g, s, v.tolist()) for (g, s), v in sums.items()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.list_(pa.float64())), strict=True)], ["g", "start", "m"])

    width = 1 + DIM + DIM * DIM
    summed = joined.mapInArrow(worker, "g string, start int, m array<double>").groupBy("g", "start").agg(*(F.sum(F.col("m")[k]).alias(f"m{k}") for k in range(width)))

    def estimate(batches):
        for batch in batches:
            rows = []
            for row in np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(width)], axis=1) if batch.num_rows else []:
                rows.append(fitted(row[0], row[1 : 1 + DIM], row[1 + DIM :].reshape(DIM, DIM)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in rows], pa.list_(pa.float64())), pa.array([d for _, d in rows], pa.float64())], ["g", "start", "p", "logdet"])

    return summed.mapInArrow(estimate, "g string, start int, p array<double>, logdet double")


def fitted(n: float, total: np.ndarray, products: np.ndarray) -> tuple[list[float], float]:
    """Center and inverse scatter in a row, and the logarithm of the scatter's determinant, from moments."""
    center = total / n
    scatter = products / n - np.outer(center, center) + np.diag(FLOOR)
    return [*center, *np.linalg.inv(scatter).ravel()], float(np.linalg.slogdet(scatter)[1])


def _quartiles(every: DataFrame) -> DataFrame:
    """g, n and the quartiles q0, q1 ... of each statistic."""

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = _matrix(row["x"])
                yield pa.RecordBatch.from_arrays([pa.array([row["g"]] * len(x), pa.string()), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(DIM))], ["g", *(f"x{k}" for k in range(DIM))])

    single = every.select("g", "x").mapInArrow(unpack, "g string, " + ", ".join(f"x{k} double" for k in range(DIM)))
    return single.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(f"x{k}", [0.25, 0.5, 0.75], 10000).alias(f"q{k}") for k in range(DIM)))


def judged(docs: DataFrame, covered: float = COVERED, tolerance: float = TOLERANCE, tail: float = TAIL, slack: float = SLACK) -> DataFrame:
    """doc_id, lang, source, grouped_by, distance (squared, rescaled, 4 places) and kept for every row of ``docs``."""
    every = stored(vectors(docs))
    middle = _quartiles(every).where((F.col("n") >= MIN_GROUP) | (F.col("g") != "*"))
    params = stored(middle.select("g", F.array(F.array(*(F.col(f"q{k}")[1] for k in range(DIM)), *((F.col(f"q{k}")[2] - F.col(f"q{k}")[0]) / 1.349 for k in range(DIM)))).alias("params")))
    state, settled = None, []
    while True:
        joined = every.select("g", "x").join(params, "g")
        cuts = stored(_cuts(_histogram(joined), covered))
        found = _moments(joined.join(cuts, "g"))
        if state is not None:  # a start that no longer gains keeps the better estimate
            old = state.select("g", "start", F.col("p").alias("old_p"), F.col("logdet").alias("old"))
            fell = F.col("logdet") < F.col("old") - tolerance
            found = found.join(old, ["g", "start"]).select("g", "start", F.when(fell, F.col("p")).otherwise(F.col("old_p")).alias("p"), F.when(fell, F.col("logdet")).otherwise(F.col("old")).alias("logdet"), fell.alias("fell"))
        else:
            found = found.withColumn("fell", F.lit(True))
        found = stored(found.withColumn("open", F.max("fell").over(Window.partitionBy("g"))))
        settled.append(found.where("NOT open"))
        state = found.where("open")
        if not state.limit(1).count():
            break
        params = state.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "p"))), lambda e: e["p"]).alias("params"))
    ended = settled[0]
    for more in settled[1:]:
        ended = ended.unionByName(more)
    best = stored(ended.groupBy("g").agg(F.min(F.struct("logdet", "start", "p")).alias("b")).select("g", F.array("b.p", "b.p").alias("params")))
    medians = _cuts(_histogram(every.select("g", "x").join(best, "g")), 0.5).select("g", F.col("cuts")[0].alias("median_bin"))
    final = stored(best.join(medians, "g"))
    half, limit = chi_square(0.5), chi_square(1 - tail) * slack
    kind = docs.schema["doc_id"].dataType.simpleString()

    def worker(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["g", "lang", "source", "x", "params", "median_bin"]).to_pylist()):
                ids, x, n = batch.column(0).slice(i, 1).flatten(), _matrix(row["x"]), len(row["x"]) // (8 * DIM)
                distance = np.zeros(n)
                if row["params"] is not None:
                    p = np.array(row["params"][0])
                    median = 2 ** ((row["median_bin"] + 0.5) / PER_OCTAVE - 8)
                    # Scatter is only ever widened: floors already hold narrow groups.
                    distance = np.round(squared(x, p[:DIM], p[DIM:].reshape(DIM, DIM)) * min(1.0, half / median), 4)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([row[c]] * n, pa.string()) for c in ("lang", "source", "g")), pa.array(distance) if row["params"] is not None else pa.nulls(n, pa.float64()), pa.array(distance <= limit)],
                    ["doc_id", "lang", "source", "grouped_by", "distance", "kept"],
                )

    rows = every.join(final, "g", "left").select("ids", "g", "lang", "source", "x", "params", "median_bin")
    return rows.mapInArrow(worker, f"doc_id {kind}, lang string, source string, grouped_by string, distance double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table ``documents``, judged within its language and source."""
    return judged(table(spark, sf_dir, "documents"))

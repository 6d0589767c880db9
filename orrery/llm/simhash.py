"""SimHash near-deduplication, every pair within the radius (operator 3).

Fingerprint: 192 bits, the signs of the summed +-1 patterns of a document's distinct words (words as in
:mod:`.decontaminate`), kept as six words of 32 bits. Two documents are near copies if their fingerprints differ in at
most ``radius`` bits.

Search: equal fingerprints are one. Two steps find every pair within ``radius``, or connect it by others:

1. Copies meet cheaply. For each of its six words, a fingerprint emits the word and every variant of it within one
   flipped bit: 33 variants. Every pair within 17 bits shares one for certain, others perhaps. Variants shuffle packed,
   12 bytes each; each member of a bucket is checked against the smallest one. What is near gets one label.
2. An exact search links what the first step left apart. A fingerprint is cut into twelve keys of 16 bits. Two that differ
   in at most 30 bits differ in at most two bits in one of the first seven keys, or in at most one in one of the last
   five: if not, they'd differ in 7 x 3 + 5 x 2 = 31. So each key value's members are compared with all whose key is
   within that reach, by exclusive or and bit count. Members of one label needn't be compared. Points, 32 bytes each, are
   dealt into groups of about ``GROUP``, and a task compares two groups; each task sends only the links that joined two
   classes there, fewer than it has classes. Comparisons grow with the square of the number of different fingerprints,
   by arithmetic 1.6 for a hundred pairs where groups are full and keys even, more where they aren't: no pair is left out.

Groups are the connected components of verified pairs (smallest labels with pointer jumping, every round written to
the shared folder). The smallest doc_id of a group stays.

Cases: null ids, and texts without a word (null, empty, symbols only), take no part and stay; rows that share an id
are one document as to what stays or goes; ties in the size of a bit's sum count as 0; an empty table gives no pairs;
other columns pass through :func:`deduplicated`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix, stored, table, texts_of, tokens

WORDS = 6
RADIUS = 30
#: Keys of 16 bits that the exact search cuts a fingerprint into.
KEYS = WORDS * 2
#: Fingerprints of one group of the exact search, give or take.
GROUP = 1 << 20
#: Pairs that are compared at once.
TILE = 1 << 16
#: Members of one class and key value from which they aren't compared with their own class.
CROWD = 64
#: Entries of 12 bytes that one search task should hold at most, give or take.
TASK_ENTRIES = 4_000_000
_LANES = (WORDS * 32) // 64
_FPS = [f"f{k}" for k in range(_LANES)]


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the texts that have a word, and their fingerprints as rows of WORDS uint32."""
    index, rows = [np.zeros(0, np.int64)], [np.zeros((0, WORDS), np.uint32)]
    for block in blocks(texts):
        found = tokens(block)
        count = np.diff(found.bounds)
        text = np.repeat(np.arange(len(count), dtype=np.uint64), count)
        own = np.unique((text << np.uint64(40)) | (found.hash >> np.uint64(24)))
        if not len(own):
            continue
        which, word = (own >> np.uint64(40)).astype(np.int64), own & np.uint64((1 << 40) - 1)
        lanes = np.stack([mix(word + np.uint64((k + 1) << 44)) for k in range(_LANES)], axis=1)
        # Sums of bits in 8-bit lanes of 64-bit words, over runs of at most 255 words of a text.
        ends = np.flatnonzero(np.r_[which[1:] != which[:-1], True])
        starts = np.r_[0, ends[:-1] + 1]
        runs = np.concatenate([np.arange(a, b + 1, 255) for a, b in zip(starts, ends, strict=True)]) if (ends - starts).max() >= 255 else starts
        sums = []
        for lo in range(0, len(runs), 64):  # bounds the unpacked bits
            part = runs[lo : lo + 64]
            to = runs[lo + 64] if lo + 64 < len(runs) else len(own)
            bits = np.unpackbits(lanes[part[0] : to].view(np.uint8), axis=1)
            sums.append(np.add.reduceat(bits.view(np.uint64), part - part[0], axis=0).view(np.uint8))
        ones = np.add.reduceat(np.concatenate(sums).astype(np.int32), np.searchsorted(runs, starts), axis=0)
        signs = ones * 2 > (ends - starts + 1)[:, None]
        index.append(which[starts] + block.first)
        rows.append(np.ascontiguousarray(np.packbits(signs, axis=1)).view(np.uint32))
    return np.concatenate(index), np.concatenate(rows)


def variants(words: np.ndarray) -> np.ndarray:
    """The 33 variants within one bit of each of an array of uint32 words, one row for each word."""
    masks = np.r_[np.uint32(0), np.uint32(1) << np.arange(32, dtype=np.uint32)]
    return words[:, None] ^ masks[None, :]


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint as longs f0..., and fp, a hash of it that serves as its name."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def worker(batches):
        for batch in batches:
            index, rows = fingerprints(texts_of(batch))
            longs = rows.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), *(pa.array(np.ascontiguousarray(longs[:, k])) for k in range(_LANES))], ["doc_id", *_FPS])

    found = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(worker, f"doc_id {kind}, " + ", ".join(f"{f} long" for f in _FPS))
    return found.withColumn("fp", F.xxhash64(*_FPS))


def _collisions(points: DataFrame, tasks: int) -> DataFrame:
    """key, lo, id, size for every member of a bucket of two or more; lo is the bucket's smallest member."""
    parts = 4 * tasks

    def emit(batches):
        for batch in batches:
            names = batch.column(0).to_numpy()
            words = np.stack([batch.column(k + 1).to_numpy() for k in range(_LANES)], axis=1).view(np.uint32)
            for t in range(WORDS):
                keys = variants(words[:, t]).ravel()
                ids = np.repeat(names, 33)
                part = (mix(keys.astype(np.uint64) + np.uint64((t + 1) << 36)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                keys, ids = keys[order], ids[order]
                full = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full.astype(np.int32)), pa.array(np.full(len(full), t, np.int32)),
                        pa.array([keys[bounds[k] : bounds[k + 1]].tobytes() for k in full], pa.binary()), pa.array([ids[bounds[k] : bounds[k + 1]].tobytes() for k in full], pa.binary()),
                    ], ["part", "t", "keys", "ids"],
                )

    def meet(batches):
        gathered: dict[tuple[int, int], tuple[list, list]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                a, b = gathered.setdefault((row["part"], row["t"]), ([], []))
                a.append(row["keys"])
                b.append(row["ids"])
        for (_, t), (keys, ids) in gathered.items():
            key, name = np.frombuffer(b"".join(keys), np.uint32), np.frombuffer(b"".join(ids), np.int64)
            order = np.lexsort((name, key))
            key, name = key[order], name[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            keep = np.repeat(size > 1, size)
            if keep.any():
                lo = np.repeat(name[first], size)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[keep].astype(np.int64) | (t << 32), lo[keep], name[keep], np.repeat(size, size)[keep])], ["key", "lo", "id", "size"])

    emitted = points.select("fp", *_FPS).repartition(tasks).mapInArrow(emit, "part int, t int, keys binary, ids binary")
    return emitted.repartition(tasks, "part", "t").mapInArrow(meet, "key long, lo long, id long, size long")


def _within(pairs: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """pairs (a, b) with near, whether their fingerprints differ in at most radius bits."""
    left, right = (points.select(F.col("fp").alias(x), *(F.col(f).alias(f"{x}{f}") for f in _FPS)) for x in "ab")
    distance = sum((F.bit_count(F.col(f"a{f}").bitwiseXOR(F.col(f"b{f}"))) for f in _FPS[1:]), F.bit_count(F.col(f"a{_FPS[0]}").bitwiseXOR(F.col(f"b{_FPS[0]}"))))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (distance <= radius).alias("near"))


def stars(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified pairs (a, b) of fingerprint names: in every bucket the smallest member and those near it."""
    spark = points.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points.count() * WORDS * 33 // TASK_ENTRIES))
    met = _collisions(points, tasks)
    return _within(met.select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct(), points, radius).where("near").select("a", "b")


def reaches(radius: int) -> list[int]:
    """For each key, the bits in which two fingerprints within ``radius`` may differ there: they keep to it in one key at least."""
    least, more = divmod(radius + 1, KEYS)
    return [least - 1 + (t < more) for t in range(KEYS)]


def masks(bits: int, width: int = 16) -> np.ndarray:
    """All keys of so many bits that differ from 0 in at most ``bits`` of them."""
    every = np.arange(1 << width)
    return every[np.bitwise_count(every) <= bits]


class Classes:
    """A union-find over class numbers that remembers which links joined two classes."""

    def __init__(self, count: int):
        self.root, self.links, self._stale = np.arange(count), [], 0

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in np.unique(np.stack([left, right], axis=1), axis=0).tolist():
            x, y = self.find(a), self.find(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.links.append((x, y))
                self._stale += 1
        if self._stale > 1000:  # so that most members of a class are seen to be of one
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
            self._stale = 0


def _compared(a: list[np.ndarray], b: list[np.ndarray], of_a: np.ndarray, of_b: np.ndarray, radius: int, classes: Classes, room: tuple) -> None:
    """Compare all of a with all of b (lanes of fingerprints, and their class numbers) and join the classes of those within radius."""
    many = len(of_b)
    for c in range(0, many, TILE):
        to = min(many, c + TILE)
        step = max(1, TILE // (to - c))
        for r in range(0, len(of_a), step):
            end = min(len(of_a), r + step)
            bits, one, two = (x[: (end - r) * (to - c)].reshape(end - r, to - c) for x in room)
            np.bitwise_count(np.bitwise_xor(a[0][r:end, None], b[0][c:to], out=bits), out=one)
            for k in range(1, _LANES - 1):  # the last lane is that of the key and only read for what is left
                one += np.bitwise_count(np.bitwise_xor(a[k][r:end, None], b[k][c:to], out=bits), out=two)
            if int(one.min()) > radius:
                continue
            left, right = classes.root[of_a[r:end]], classes.root[of_b[c:to]]
            i, j = np.nonzero((one <= radius) & (left[:, None] != right))
            near = one[i, j] + np.bitwise_count(a[-1][r + i] ^ b[-1][c + j]) <= radius
            if near.any():
                classes.join(left[i[near]], right[j[near]])


def linked(a: np.ndarray, b: np.ndarray | None, of_a: np.ndarray, of_b: np.ndarray | None, keys: list[int], radius: int, classes: Classes) -> None:
    """Join the classes of all fingerprints of a and b (b None: of a) that are within radius and keep to the reach of one of these keys.

    Fingerprints are rows of longs, of_a and of_b their class numbers. Each key value's members are compared with all whose key is within reach;
    where few have a value, values that differ in their low bits only are taken together.
    """
    width = min(16, max(0, (max(len(a), 0 if b is None else len(b)) >> 4).bit_length() - 1))
    room = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8), np.empty(TILE, np.uint8)
    for t in keys:
        reach = reaches(radius)[t]
        if reach < 0:
            continue
        flips, lane = masks(reach, width), t * 16 // 64

        def by_key(prints: np.ndarray, of: np.ndarray, t: int = t, lane: int = lane) -> tuple:
            key = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), KEYS)[:, t] >> np.uint16(16 - width)
            order = np.argsort(key, kind="stable")
            lanes = [np.ascontiguousarray(prints[order, k]).view(np.uint64) for k in range(_LANES) if k != lane]
            return [*lanes, np.ascontiguousarray(prints[order, lane]).view(np.uint64)], of[order], np.r_[0, np.cumsum(np.bincount(key, minlength=1 << width))]

        left, of_left, at = by_key(a, of_a)
        right, of_right, begin = (left, of_left, at) if b is None else by_key(b, of_b)
        for key in np.flatnonzero(np.diff(at)).tolist():
            others = flips ^ key
            if b is None:
                others = others[others >= key]
            first = begin[others]
            size = begin[others + 1] - first
            ends = np.cumsum(size)
            if not ends[-1]:
                continue
            place = np.repeat(first - ends + size, size)
            place += np.arange(len(place))
            lo, hi = int(at[key]), int(at[key + 1])
            own, theirs = [x[lo:hi] for x in left], [x[place] for x in right]
            of_own, of_theirs = of_left[lo:hi], of_right[place]
            if hi - lo > CROWD:  # large classes aren't compared with themselves
                now, then = classes.root[of_own], classes.root[of_theirs]
                for name, count in zip(*np.unique(now, return_counts=True), strict=True):
                    if count > CROWD:
                        some, rest = now == name, then != name
                        _compared([x[some] for x in own], [x[rest] for x in theirs], of_own[some], of_theirs[rest], radius, classes, room)
                        left_over = now[~some]
                        own, of_own, now = [x[~some] for x in own], of_own[~some], left_over
            _compared(own, theirs, of_own, of_theirs, radius, classes, room)


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of labels that connect whatever all pairs of points (f0..., label) within ``radius`` connect, of different labels.

    Points are dealt into groups; a task compares two groups, or one with itself, by all keys or some.
    """
    groups = max(1, -(-points.count() // GROUP))
    shares = next(k for k in (12, 6, 4, 3, 2, 1) if k == 1 or k * groups <= KEYS)
    pairs = [(i, j) for i in range(groups) for j in range(i, groups)]
    tasks = [[n * shares + k for n, pair in enumerate(pairs) if g in pair for k in range(shares)] for g in range(groups)]

    def deal(batches):
        for batch in batches:
            prints = np.stack([batch.column(k).to_numpy() for k in range(_LANES + 1)], axis=1)
            group = mix(np.bitwise_xor.reduce(prints[:, :_LANES].view(np.uint64), axis=1)) % np.uint64(groups)
            for g in np.unique(group).tolist():
                raw = prints[group == g].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(tasks[g], pa.int32()), pa.array([g] * len(tasks[g]), pa.int32()), pa.array([raw] * len(tasks[g]), pa.binary())], ["task", "own", "points"])

    def search(batches):
        task, parts = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                task = row["task"]
                parts.setdefault(row["own"], []).append(row["points"])
        if task is None:
            return
        i, j = pairs[task // shares]
        both = [np.frombuffer(b"".join(parts.pop(g, [])), np.int64).reshape(-1, _LANES + 1) for g in ([i] if i == j else [i, j])]
        names, of = np.unique(np.concatenate([x[:, _LANES] for x in both]), return_inverse=True)
        of = [of[: len(both[0])], of[len(both[0]) :]]
        classes = Classes(len(names))
        linked(both[0][:, :_LANES], both[1][:, :_LANES] if i < j else None, of[0], of[1], list(range(task % shares, KEYS, shares)), radius, classes)
        found = np.array(classes.links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(names[found[:, k]]) for k in range(2)], ["a", "b"])

    dealt = points.select(*_FPS, "label").mapInArrow(deal, "task int, own int, points binary")
    return dealt.repartitionById(len(pairs) * shares, "task").mapInArrow(search, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """v and label (the smallest vertex of its component) for every vertex of pairs (a, b)."""
    both = stored(pairs.union(pairs.select("b", "a")).toDF("v", "w").distinct())
    labels = stored(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("n"))
        better = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "n").alias("label"))
        jump = better.join(labels.select(F.col("v").alias("label"), F.col("label").alias("far")), "label").select("v", "old", F.least("label", "far").alias("label"))
        jump = stored(jump)
        changed = jump.where("label <> old").limit(1).count()
        labels = jump.select("v", "label")
        if not changed:
            return labels


def classified(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """points with label, the same for all that chains of pairs within ``radius`` connect."""
    first = components(stored(stars(points, radius))).withColumnRenamed("v", "fp")
    points = stored(points.join(first, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    second = components(stored(links(points, radius))).withColumnRenamed("label", "last")
    return points.join(second.withColumnRenamed("v", "label"), "label", "left").withColumn("label", F.coalesce("last", "label")).drop("last")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for each document that goes: doc_id, the kept_doc_id that stays for it, and group_size."""
    prints = stored(_fingerprinted(docs))
    points = stored(prints.groupBy("fp", *_FPS).agg(F.lit(1).alias("one")).drop("one"))
    labels = classified(points, radius)
    named = prints.select("doc_id", "fp").distinct().join(labels.select("fp", "label"), "fp").select("doc_id", "label")
    groups = named.groupBy("label").agg(F.min("doc_id").alias("kept_doc_id"), F.count_distinct("doc_id").alias("group_size")).where("group_size > 1")
    gone = named.join(groups, "label").where("doc_id <> kept_doc_id")
    # Rows that share an id but not a text may be in two groups: the smallest is named.
    return gone.groupBy("doc_id").agg(F.min("kept_doc_id").alias("kept_doc_id"), F.max("group_size").alias("group_size"))


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of every group of near copies."""
    return docs.join(near_duplicates(docs, radius).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near copies in the whole table ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))

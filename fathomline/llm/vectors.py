"""The most similar vectors of every vector by multi-index hashing.

Unit vectors are centred and turned by learned rotations (iterative quantisation on a bounded sample), and the signs of
the turned coordinates are their binary codes.  A code is cut into substrings, and each substring is an index of its own.
Two codes that differ in fewer bits than there are substrings agree in at least one of them (pigeonhole), so looking up
each substring of a vector finds every code within that Hamming radius, and most beyond it.  What a substring's bucket
holds is reranked by the cosine of the original floats in double precision.

Equal vectors are searched once, whatever their number.  A bucket above a bound is dealt into blocks, every two of which
are compared in a task of their own; no bucket is compared in one piece because many vectors share it, and none of its
pairs is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import materialise

DIMENSIONS = 64
NEIGHBOURS = 5
LEAST_SIMILARITY = 0.85
SAMPLE = 20_000  # vectors from which rotations are learned; a bound on what reaches the driver
LARGEST_BUCKET = 8_192
_MEETING = 0.88  # chance that two vectors at the least similarity meet in some bucket, from which the number of indexes follows


def valid_vectors(rows: DataFrame, key: str = "id", vector: str = "vec", stamp: str = "last_seen_at", dimensions: int = DIMENSIONS) -> DataFrame:
    """``id, stamp, vec`` of rows with an id and a vector of that many finite numbers that are not all zero."""
    v = F.col(vector)
    whole = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(key).alias("id"), F.col(stamp).alias("stamp"), v.cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & whole)


def index_shape(n: int, least: float) -> tuple[int, int]:
    """Bits of a substring and number of substrings for ``n`` vectors.

    Buckets grow as the 0.4th power of the number of vectors.  A bit of two vectors at angle a differs with chance a / pi;
    the number of substrings keeps the chance that two vectors at the least similarity meet the same at every size.
    """
    bits = max(3, math.ceil(0.6 * math.log2(max(n, 2))) - 4)
    meet = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(1 - _MEETING) / math.log(1 - meet)))


def learn_rotations(sample: np.ndarray, blocks: int, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centre and ``blocks`` rotations side by side; each alternates between signs and the rotation that fits them."""
    d = sample.shape[1]
    centre = sample.mean(axis=0) if len(sample) else np.zeros(d)
    x = sample - centre
    parts = []
    for b in range(blocks):
        r, _ = np.linalg.qr(np.random.default_rng(1000 + b).normal(size=(d, d)))
        for _ in range(steps if len(x) > 1 else 0):
            signs = np.where(x @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(signs.T @ x)
            r = w.T @ u.T
        parts.append(r)
    return centre, np.concatenate(parts, axis=1)


def _unit(flat: np.ndarray, dimensions: int) -> np.ndarray:
    x = flat.reshape(-1, dimensions).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _flat(column: pa.Array) -> np.ndarray:
    """The floats of a column of fixed-size binary values."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32)


def _with_codes(vectors: DataFrame, centre: np.ndarray, rotations: np.ndarray, bits: int, indexes: int, dimensions: int) -> DataFrame:
    per = dimensions // bits
    picks = [(i // per * dimensions + i % per * bits) for i in range(indexes)]
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.asarray(batch.column(1).flatten(), dtype=np.float32)
            signs = ((_unit(raw, dimensions) - centre) @ rotations) >= 0
            codes = np.stack([(signs[:, p : p + bits] @ weights) + (i << bits) for i, p in enumerate(picks)], axis=1)
            offsets = pa.array(np.arange(0, codes.size + 1, indexes, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int64)))
            blob = raw.reshape(-1, dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in blob], pa.binary()), lists], names=["g", "v", "buckets"])

    return vectors.select("g", "vec").mapInArrow(run, "g bigint, v binary, buckets array<bigint>")


def _blocks(rows: DataFrame, largest: int) -> DataFrame:
    """Rows (bucket, g, v) in which a bucket of more than ``largest`` rows is replaced by cells that each hold two of its blocks.

    A hash deals the rows of such a bucket into three or more blocks of about half of ``largest``.  Every two blocks meet in
    one cell, so all pairs of the bucket are still compared; a row is sent once for each other block of its bucket.
    """
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    large = materialise(sizes.where(F.col("rows") > largest).select("bucket", F.ceil(F.col("rows") / (largest / 2)).alias("blocks")), "large-buckets")
    if large.isEmpty():
        return rows
    own = F.pmod(F.xxhash64("g", F.lit(11)), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: j != own)
    cells = F.transform(others, lambda j: F.xxhash64("bucket", F.least(own, j), F.greatest(own, j)))
    dealt = rows.join(large, "bucket", "left").withColumn("cells", F.when(F.col("blocks").isNull(), F.array("bucket")).otherwise(cells))
    return dealt.select(F.explode("cells").alias("bucket"), "g", "v")


def _first_of_each(x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For the rows ``at`` their ``k`` best others by (rounded cosine in double precision, position), as pairs of positions."""
    rows, cols = [], []
    for a in range(0, len(at), 128):
        own = at[a : a + 128]
        s = np.round(x[own] @ x.T, 6)
        s[np.arange(len(own)), own] = -2
        last = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        above, tied = s > last, s == last
        # of those tied with the k-th, the first positions fill what is left of k
        above |= tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True))
        r, c = np.nonzero(above)
        rows.append(own[r])
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _rank_bucket(g: np.ndarray, raw: np.ndarray, k: int, least: float, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector of a bucket at least its ``k`` best others with a rounded cosine of at least ``least``; ties go to the smaller id."""
    order = np.argsort(g, kind="stable")  # positions are in the order of the ids
    g, raw = g[order], raw.reshape(len(g), dimensions)[order]
    x = _unit(raw, dimensions)
    low = x.astype(np.float32)
    n, take = len(g), min(k + 3, len(g) - 1)
    rows, cols = [], []
    for a in range(0, n, 1024):  # blocks of queries against the bucket
        s = low[a : a + 1024] @ low.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near = s >= least - 1e-4
        full = np.flatnonzero(near.sum(axis=1) > take)
        near[full] = False
        r, c = np.nonzero(near)
        rows.append(r + a)
        cols.append(c)
        if len(full):
            r, c = _first_of_each(x, full + a, k)
            rows.append(r)
            cols.append(c)
    r, c = np.concatenate(rows), np.concatenate(cols)
    exact = np.round(np.einsum("ij,ij->i", x[r], x[c]), 6)
    keep = exact >= least
    return g[r[keep]], g[c[keep]], exact[keep]


def _search(k: int, least: float, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None  # the bucket that may go on in the next batch

        def out(b: np.ndarray, g: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
            found = [_rank_bucket(g[i:j], raw[i:j], k, least, dimensions) for i, j in zip(cuts[:-1], cuts[1:]) if j - i > 1]
            columns = [np.concatenate([f[c] for f in found]) if found else np.empty(0) for c in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))], names=["g", "h", "similarity"])

        for batch in batches:
            if not batch.num_rows:
                continue
            b, g = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raw = _flat(batch.column(2)).reshape(-1, dimensions)
            if rest is not None:
                b, g, raw = np.r_[rest[0], b], np.r_[rest[1], g], np.concatenate([rest[2], raw])
            last = int(np.searchsorted(b, b[-1], side="left")) if b[0] <= b[-1] else 0
            rest = (b[last:], g[last:], raw[last:])
            if last:
                yield out(b[:last], g[:last], raw[:last])
        if rest is not None:
            yield out(*rest)

    return run


def nearest_vectors(rows: DataFrame, k: int = NEIGHBOURS, least: float = LEAST_SIMILARITY, dimensions: int = DIMENSIONS, largest: int = LARGEST_BUCKET) -> DataFrame:
    """``id, neighbour, similarity, rank``: up to ``k`` most similar other ids of each id with at least that cosine.

    Cosines are taken in double precision and rounded to 6 decimals; ties go to the smaller id.  Of rows that repeat an id
    the one with the largest (stamp, hash of the vector) counts.  Null, short, long, infinite and zero vectors take no
    part.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    valid = valid_vectors(rows, dimensions=dimensions).withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(7), "vec"))
    # equal vectors: the smallest id of each group stands for it; only keys and hashes are shuffled here
    newest = valid.groupBy("id").agg(F.max(F.struct("stamp", "h1", "h2")).alias("r")).select("id", "r.h1", "r.h2")
    order = Window.partitionBy("h1", "h2").orderBy("id")
    # one id more than k, since an id is never its own neighbour; each map task sends at most that many of a group
    firsts = materialise(newest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1), "equal-vectors")
    leaders = firsts.where("n = 1").select("h1", "h2", F.col("id").alias("g"))
    n = leaders.count()
    if n == 0:
        return spark.createDataFrame([], "id bigint, neighbour bigint, similarity double, rank int")
    lead = leaders.select(F.col("g").alias("id"), "h1", "h2")
    # repeated rows of an id go in the same exchange as the join
    vectors = valid.select("id", "h1", "h2", "vec").join(lead, ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"]).select(F.col("id").alias("g"), "vec")
    bits, indexes = index_shape(n, least)
    share = min(1.0, SAMPLE / n)
    picked = vectors.where(F.pmod(F.xxhash64("g"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec").limit(SAMPLE + SAMPLE // 10)
    sample = np.asarray([r.vec for r in picked.collect()], dtype=np.float64).reshape(-1, dimensions)
    sample /= np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    centre, rotations = learn_rotations(sample, -(-indexes // (dimensions // bits)))
    coded = materialise(_with_codes(vectors, centre, rotations, bits, indexes, dimensions), "codes")
    spread = _blocks(coded.select(F.explode("buckets").alias("bucket"), "g", "v"), largest)
    ordered = spread.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "g", "v")
    pairs = ordered.mapInArrow(_search(k, least, dimensions), "g bigint, h bigint, similarity double")
    # at most (k + 3) entries of each bucket or cell come together for one vector
    best = pairs.groupBy("g").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("s"), "h"))), 1, k + 1).alias("near"))
    groups = firsts.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("g"), "ids", "h1", "h2")
    # the ids behind each neighbouring vector; a vector is its own neighbour where several ids have it
    entries = best.select("g", F.explode("near").alias("e")).select("g", F.col("e.s").alias("s"), F.col("e.h").alias("h"))
    entries = entries.join(groups.select(F.col("g").alias("h"), "ids"), "h").select("g", "s", "ids")
    entries = entries.unionByName(groups.where(F.size("ids") > 1).select("g", F.lit(-1.0).alias("s"), "ids"))
    lists = entries.groupBy("g").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("s").alias("s"), i.alias("i")))))), 1, k + 1).alias("near"))
    members = newest.join(groups.select("h1", "h2", "g"), ["h1", "h2"]).select("id", "g")
    own = members.join(lists, "g").select("id", F.slice(F.filter("near", lambda e: e["i"] != F.col("id")), 1, k).alias("near"))
    return own.select("id", F.posexplode("near").alias("p", "e")).select("id", F.col("e.i").alias("neighbour"), (-F.col("e.s")).alias("similarity"), (F.col("p") + 1).cast("int").alias("rank"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """``id_a < id_b`` of pairs in which one is among the neighbours of the other, each once."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()

"""Centroid clustering on subvector dictionaries.

Vectors become integers, floor(scale * x). They are stored in chunks; a chunk's dimensions are
cut into blocks of equal width, and each block is replaced, without loss, by its distinct
subvectors and a code for each vector. A round computes the exact squared distances of every
distinct subvector to every centroid's block once a chunk, and a vector's distance is the sum
of its codes' entries; sums of a cluster are counts of codes times the dictionary. The width is
the one that makes a chunk's round cheapest by its own counts of distinct subvectors, so exact
copies, rounded values and wide ranges each get dictionaries that pay. A dictionary belongs to
a chunk, as in columnar files: nothing is joined, shuffled or broadcast by subvector, whatever
the number of distinct ones.

Chunks are a table in the shared folder. A round is one pass over it that brings back, summed
by Spark, one row of sums for each centroid; the driver holds the centroids alone. Everything
is integer arithmetic: distances stay below 2^62, sums are decimals of 38 digits.

Defined cases: vectors with another number of components, with a null or not finite one, or
with one of |x| >= LARGEST / scale, whose squared distances need not fit a long, are not kept.
Null ids are clustered but start no centroid; repeated rows count each, and equal hashes (of
repeated ids) are ordered by their components. With fewer vectors than centroids there are
fewer centroids, with none of an id none and no rows. Ties go to the smaller number; an empty
centroid stays. An inertia beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm.common import column, map_arrow, only, written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3"
#: Scaled components are smaller: 64 * (2 * 2^27)^2 = 2^62.
LARGEST = 1 << 27
#: Vectors of a chunk.
CHUNK = 4096
#: Cost of one lookup and addition against one multiplication and addition.
LOOKUP = 1.5


# ---------------------------------------------------------------- dictionaries


def encode(vectors: np.ndarray, centroids: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes (blocks, n) into one dictionary (entries, width), the first entry of each block
    (blocks + 1), and the width. Codes of double width come from pairs of codes."""
    n, dims = vectors.shape
    codes, sizes, firsts = [], [], []
    for d in range(dims):
        _, first, code = np.unique(vectors[:, d], return_index=True, return_inverse=True)
        codes.append(code.astype(np.int64))
        sizes.append(len(first))
        firsts.append(first)
    width, best = 1, None
    while True:
        cost = centroids * (width * sum(sizes) + LOOKUP * n * len(codes))
        if best is None or cost < best[0]:
            best = cost, width, codes, sizes, firsts
        if len(codes) % 2:
            break
        pairs = [np.unique(codes[k] * sizes[k + 1] + codes[k + 1], return_index=True, return_inverse=True) for k in range(0, len(codes), 2)]
        codes, sizes, firsts = [p[2].astype(np.int64) for p in pairs], [len(p[1]) for p in pairs], [p[1] for p in pairs]
        width *= 2
    _, width, codes, sizes, firsts = best
    starts = np.concatenate([[0], np.cumsum(sizes)])
    dictionary = np.concatenate([vectors[f, k * width : (k + 1) * width] for k, f in enumerate(firsts)])
    return np.stack(codes) + starts[:-1, None], dictionary, starts, width


def distances(codes: np.ndarray, dictionary: np.ndarray, starts: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (n, centroids): partial ones of each distinct subvector, by code."""
    width = dictionary.shape[1]
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    for b, code in enumerate(codes):
        entries = dictionary[starts[b] : starts[b + 1]]
        part = np.zeros((len(entries), len(centroids)), np.int64)
        for w in range(width):
            apart = entries[:, w, None] - centroids[None, :, b * width + w]
            part += apart * apart
        total += part[code - starts[b]]
    return total


def sums(codes: np.ndarray, dictionary: np.ndarray, starts: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Sums (k, dimensions): how often a cluster has a code, times its subvector."""
    out = []
    for b, code in enumerate(codes):
        size = starts[b + 1] - starts[b]
        counts = np.bincount(cluster * size + code - starts[b], minlength=k * size).reshape(k, size)
        out.append(counts @ dictionary[starts[b] : starts[b + 1]])
    return np.concatenate(out, axis=1)


# ---------------------------------------------------------------- chunks


def _integers(array: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept rows' numbers and their integer vectors."""
    size = np.asarray(array.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dims)
    values = array.take(pa.array(rows)).flatten()
    given = np.asarray(values.is_valid()).reshape(-1, dims)
    x = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        scaled = scale * x
    good = (given & np.isfinite(scaled) & (np.abs(scaled) < LARGEST)).all(axis=1)
    return rows[good], np.floor(scaled[good]).astype(np.int64)


def chunks(vectors: DataFrame, dims: int, scale: int, k: int, size: int = CHUNK) -> DataFrame:
    """Encoded chunks of `vectors` (id, vector): ids, codes, dictionary, starts, width."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for part in batches:
            for at in range(0, part.num_rows, size):
                some = part.slice(at, size)
                rows, values = _integers(column(some, "vector"), dims, scale)
                if not len(rows):
                    continue
                codes, dictionary, starts, width = encode(values, k)
                ids = column(some, "id").take(pa.array(rows))
                small = dictionary.astype(np.int16) if (np.abs(dictionary) < 1 << 15).all() else dictionary.astype(np.int32)
                # codes count from their block's first entry, as the first places are kept
                inner = codes - starts[:-1, None]
                inner = inner.astype(np.min_scalar_type(int(inner.max())))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (inner, small, starts.astype(np.int64))),
                        *(pa.array([v], pa.int32()) for v in (width, inner.itemsize, small.itemsize)),
                    ],
                    ["ids", "codes", "dictionary", "starts", "width", "code_bytes", "value_bytes"],
                )

    schema = f"ids array<{kind}>, codes binary, dictionary binary, starts binary, width int, code_bytes int, value_bytes int"
    return map_arrow(vectors, run, schema)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """ids, codes, dictionary and starts of each chunk."""
    for part in batches:
        for row in range(part.num_rows):
            get = lambda name, r=row, p=part: column(p, name)[r]
            starts = np.frombuffer(get("starts").as_buffer(), np.int64)
            codes = np.frombuffer(get("codes").as_buffer(), f"<u{get('code_bytes').as_py()}").reshape(len(starts) - 1, -1)
            dictionary = np.frombuffer(get("dictionary").as_buffer(), f"<i{get('value_bytes').as_py()}")
            yield (
                get("ids").values,
                codes.astype(np.int64) + starts[:-1, None],
                dictionary.astype(np.int64).reshape(-1, get("width").as_py()),
                starts,
            )


# ---------------------------------------------------------------- rounds


def first_centroids(vectors: DataFrame, dims: int, scale: int, k: int, salt: str) -> list[list[int]]:
    """The k kept vectors with the least hash of their ids."""
    rows = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256))
    numbers = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    known = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= LARGEST / scale))
    kept = rows.filter((F.size("vector") == dims) & F.coalesce(known, F.lit(False)) & F.col("h").isNotNull())
    return [list(r["v"]) for r in kept.select("h", numbers.alias("v")).orderBy("h", "v").limit(k).collect()]


def _pass(stored: DataFrame, centroids: list[list[int]]) -> list:
    """For each centroid: its vectors' number, the sum of their distances, their sums."""
    held, dims = np.array(centroids, np.int64), len(centroids[0])
    names = ["cluster", "n", "far", *(f"s{d}" for d in range(dims))]

    def run(batches):
        k = len(held)
        n, far, total = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for _, codes, dictionary, starts in _opened(batches):
            apart = distances(codes, dictionary, starts, held)
            cluster = apart.argmin(axis=1)
            n += np.bincount(cluster, minlength=k)
            total += sums(codes, dictionary, starts, cluster, k)
            near = apart[np.arange(len(cluster)), cluster]
            for c in range(k):
                # halves keep the sum of many large distances exact
                mine = near[cluster == c]
                far[c] += (int((mine >> 31).sum()) << 31) + int((mine & 0x7FFFFFFF).sum())
        if n.any():
            arrays = [pa.array(np.arange(k), pa.int32()), pa.array(n), pa.array([str(x) for x in far]), *(pa.array(total[:, d]) for d in range(dims))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "cluster int, n bigint, far string, " + ", ".join(f"s{d} bigint" for d in range(dims))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    summed = map_arrow(stored, run, schema).groupBy("cluster").agg(*(wide(c) for c in names[1:]))
    return sorted(tuple(map(int, r)) for r in summed.collect())


def cluster(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    salt: str = SALT,
    chunk: int = CHUNK,
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = only(vectors, id=id, vector=vector)
    held = first_centroids(rows, dimensions, scale, centroids, salt)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not held:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    stored = written(chunks(rows, dimensions, scale, centroids, chunk))
    for _ in range(rounds):
        for number, n, _, *total in _pass(stored, held):
            if n:
                held[number] = [s // n for s in total]
    fits = lambda x: x if x < 1 << 63 else None
    inertia = {number: far for number, _, far, *_ in _pass(stored, held)}
    everything = fits(sum(inertia.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in held]
    final = np.array(held, np.int64)

    def run(batches):
        own = pa.array([fits(inertia.get(c, 0)) for c in range(len(final))], pa.int64())
        for ids, codes, dictionary, starts in _opened(batches):
            apart = distances(codes, dictionary, starts, final)
            number = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(number, pa.int32()),
                    pa.array(apart[np.arange(len(number)), number]),
                    own.take(pa.array(number)),
                    pa.array([everything] * len(number), pa.int64()),
                    pa.array(digests).take(pa.array(number)),
                ],
                ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return map_arrow(stored, run, schema).withColumnRenamed("id", id)
